"""The queries of this subpackage: one for each operator, with production parameters over whole tables."""

from __future__ import annotations

import importlib

_QUERIES = {
    "op1_ngram_jaccard_join": "jaccard",
    "op2_histogram_shards": "sharding",
    "op3_sentence_spans": "spans",
    "op4_token_files": "token_files",
    "op5_positional_index": "contamination",
    "op6_tiff_pages": "tiff",
    "op7_language_id": "langid",
    "op8_log_bilinear_scores": "lm",
    "op9_bpe_automaton": "bpe",
    "op10_quality_by_compression": "quality",
    "op11_sketched_divergence": "divergence",
    "op12_ownership_frequency": "ownership",
}


def _module(name: str):
    return importlib.import_module(f"{__package__}.{_QUERIES[name]}")


def _call(name: str):
    def query(spark, sf_dir):
        return getattr(_module(name), name)(spark, sf_dir)

    query.__name__ = name
    return query


def queries() -> dict:
    return {name: _call(name) for name in _QUERIES}


def oracle_sql() -> dict:
    return {name: _module(name).ORACLE_SQL for name in _QUERIES if hasattr(_module(name), "ORACLE_SQL")}
