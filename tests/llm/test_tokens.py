"""Encoding, token files and sharding."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from sigspark.llm import _pretoken, token_files
from sigspark.llm._shared import new_path
from sigspark.llm.bpe import automaton, encode_decode
from sigspark.llm.sharding import shard_documents


@pytest.fixture(scope="module")
def library():
    return _pretoken.library(_pretoken.vocabulary_path())


def test_automaton_equals_library(library):
    rnd = random.Random(5)
    signs = "aaabthe  \n\t'sstlremdve10!?.é中 ́ \U0001f600Ⅷ²\r"
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(40))) for _ in range(3000)]
    texts += ["<|endoftext|>", "a<|endoftext|> b's<|endoftext|><|endoftext|>", "a" * 700, " " * 900, "", "'ll 've x'S"]
    coder = _pretoken.WordCoder(_pretoken.vocabulary_path(), automaton(_pretoken.vocabulary_path()).encode_words, most=500)
    import pyarrow as pa

    from sigspark.llm import _text as T

    for a, b, data, offs in T.chunks(pa.array(texts), 4000):
        ids, at = coder(data, offs)
        for k in range(a, b):
            got = ids[at[k - a] : at[k - a + 1]].tolist()
            want = library.encode(texts[k], add_special_tokens=False).ids
            assert got == want, texts[k]
            assert automaton(_pretoken.vocabulary_path()).decode(np.array(got, np.int64)).decode() == library.decode(want, skip_special_tokens=False)


def test_encode_decode_rows(spark, docs, corpus, none, library):
    got = {r["doc_id"]: r for r in encode_decode(docs).collect()}
    assert len(got) == len(corpus)
    for doc_id, text, *_ in corpus:
        ids = library.encode(text or "", add_special_tokens=False).ids
        row = got[doc_id]
        assert row["n_tokens"] == len(ids) and row["decoded"] == (text or "")
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert encode_decode(none).collect() == []


def test_values_round_trip():
    for values in ([], [0], [255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1, 7], range(1000)):
        v = np.array(values, np.uint32)
        control, data = token_files.encode_values(v)
        assert (token_files.decode_values(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(v)) == v).all()
        assert len(control) == -(-len(v) // 4)


@pytest.mark.parametrize("file_bytes", [1 << 26, 20_000])
def test_token_files(spark, docs, corpus, library, file_bytes):
    folder = new_path(spark, "test-tokens")
    manifest = token_files.write_token_files(spark, docs, folder, file_bytes=file_bytes)
    got = {r["doc_id"]: r for r in token_files.read_token_files(spark, folder, manifest).collect()}
    start = 0
    for doc_id, text, *_ in sorted(corpus, key=lambda r: r[0]):
        raw = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
        row = got[doc_id]
        assert (row["start"], row["n_tokens"], bytes(row["ids"]), row["ids_crc32"]) == (start, len(raw) // 4, raw, zlib.crc32(raw))
        start += len(raw) // 4


def test_token_files_of_nothing(spark, none):
    folder = new_path(spark, "test-tokens")
    manifest = token_files.write_token_files(spark, none, folder)
    assert token_files.read_token_files(spark, folder, manifest).collect() == []


@pytest.mark.parametrize("rows_each", [50_000, 10])
def test_shards(spark, docs, corpus, none, rows_each):
    rows = [r.asDict() for r in shard_documents(spark, docs, shards=4, rows_each=rows_each).collect()]
    text = {r[0]: r[1] or "" for r in corpus}
    assert len(rows) == len(corpus)
    total = sum(len(t.encode()) + 1 for t in text.values())
    longest = max(len(t.encode()) + 1 for t in text.values())
    for s in range(4):
        own = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 4) <= longest + 0.01 * total
    for r in rows:
        raw = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    assert shard_documents(spark, none).collect() == []


def test_shards_cut_a_large_group(spark):
    frame = spark.createDataFrame([(i, "same text" if i % 3 else f"text {i}") for i in range(3000)], "doc_id long, text string")
    rows = shard_documents(spark, frame, shards=8, rows_each=100).collect()
    sizes = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 40
    assert len({(r["shard"], r["slot"]) for r in rows}) == 3000
