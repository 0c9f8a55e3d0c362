"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns a frame.

All but the last return the columns of documents. A stage that an input table feeds reads it from sf_dir.

Every stage reads the columns of documents alone, whatever others there are; takes texts of any length whole; keeps repeated rows
or drops them all alike; and gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .bpe import encode_decode
from .contamination import benchmark_matches, flags
from .jaccard import jaccard_components
from .langid import UNDETERMINED, identify
from .spans import remove_repeated_spans

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least confidence of a language that is taken as known.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: not `und` (null texts, texts without letters) and of no lower score than LEAST_SCORE.

    Rows without an id go. Languages that are equally likely count as the first in order of names.
    """
    found = identify(ship(spark), docs.where("doc_id IS NOT NULL").select(*COLUMNS))
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of the least doc_id (all rows of that id, should there be several).

    Texts without words (null, empty, blank) link with nothing and stay.
    """
    groups = jaccard_components(ship(spark), docs)
    first = groups.where("doc_id = component_id").select(F.col("doc_id").alias("first_id")).distinct()
    kept = docs.join(first, F.col("doc_id") == F.col("first_id"), "left_semi").select(*COLUMNS)
    return kept


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without sentences that repeat; n_chars follows the text, and is null for a null one.

    Rows of one id with different texts are documents of their own.
    """
    cut = remove_repeated_spans(ship(spark), docs.select(*COLUMNS))
    return cut.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the table benchmark; of an id that a contaminated row has, no row stays.

    Null texts have no words and stay.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    bad = flags(benchmark_matches(ship(spark), docs, items)).where("contaminated").select(F.col("doc_id").alias("bad_id"))
    return docs.join(bad, F.col("doc_id") == F.col("bad_id"), "left_anti").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text, of every row; a null text is an empty one."""
    return encode_decode(docs, with_ids=False)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("decontaminated", decontaminated),
    ("tokens", tokens),
]
