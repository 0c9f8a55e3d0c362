"""What all operators promise: other columns, whatever their names, change nothing; texts over a chunk are read whole; rows of
one id are judged by their own text. And plain versions of language identification and sharding."""

import collections
import hashlib
import math
import random
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigspark.llm import _pretoken, bpe, contamination, jaccard, langid, lm, pipeline, quality, sharding, spans, tiff, token_files
from sigspark.llm._shared import new_path, release, shared_dir

NAMES = "n key node part size shard slot law h ids n_tokens held_out row known lm slog page media n_bytes score predicted quality n_hit n_words items spans places marked_id component_id n_shingles lead kind label cluster old_text copies x start first file".split()


def matches(spark, docs):
    items = spark.createDataFrame([("bench-7", "alpha beta gamma delta"), ("bench-8", "w100 w101 w102")], "item_id string, text string")
    return contamination.flags(contamination.benchmark_matches(spark, docs, items.withColumns({c: F.lit("x") for c in NAMES if c not in ("text", "item_id")})))


def tokens(spark, docs):
    folder = new_path(spark, "test-tokens")
    return token_files.read_token_files(spark, folder, token_files.write_token_files(spark, docs, folder))


def scored(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    return quality.score(spark, docs, quality.fit(docs, labels))


OPERATORS = {
    1: lambda spark, docs: jaccard.jaccard_components(spark, docs).drop("node"),
    2: lambda spark, docs: sharding.shard_documents(spark, docs, shards=4),
    3: lambda spark, docs: spans.remove_repeated_spans(spark, docs).select("doc_id", "text", "n_removed"),
    4: tokens,
    5: matches,
    6: lambda spark, docs: tiff.media_pages(tiff.text_media(docs), with_samples=False),
    7: lambda spark, docs: langid.identify(spark, docs).select("doc_id", "lang_pred", F.round("score", 9).alias("score")),
    8: lambda spark, docs: lm.score_documents(spark, docs, steps=4).withColumns({c: F.round(c, 6) for c in ("score", "base_score")}),
    9: lambda spark, docs: bpe.encode_decode(docs, with_ids=False),
    10: scored,
}


@pytest.fixture(scope="module")
def some(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(0, 40))), ("en", "de")[i % 2]) for i in range(40)]
    rows += [(41, "Alpha beta, gamma: delta!", "en"), (42, None, None), (43, "", "de")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).cache()


@pytest.mark.parametrize("n", OPERATORS)
def test_clashing_columns(spark, some, n):
    plain, other = (sorted(map(str, OPERATORS[n](spark, d).collect())) for d in (some, some.withColumns({c: F.lit("x") for c in NAMES})))
    assert plain == other and len(plain) == 43


@pytest.fixture(scope="module")
def long_rows():
    rng = random.Random(9)
    text = " ".join(f"w{rng.randrange(20_000)}" for _ in range(420_000))
    assert len(text) > 1 << 21
    near = text.replace("w7 ", "changed ")
    return [(1, text, "en"), (2, near, "en"), (3, "alpha beta gamma delta " + text[: 1 << 20] + " end.", "en"), (4, "é" * 1_200_000, "fr"), (5, "short words", "en")]


@pytest.fixture(scope="module")
def long_docs(spark, long_rows):
    return spark.createDataFrame(long_rows, "doc_id long, text string, lang string").coalesce(1).cache()


@pytest.mark.parametrize("n", OPERATORS)
def test_texts_over_a_chunk(spark, long_docs, long_rows, n):
    got = {r["doc_id"]: r for r in OPERATORS[n](spark, long_docs).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t) for d, t, _ in long_rows}
    raw = {d: t.encode() for d, t, _ in long_rows}
    library = _pretoken.library(_pretoken.vocabulary_path())
    if n == 1:
        assert [got[d]["component_id"] for d in (1, 2, 3, 4, 5)] == [1, 1, 3, 4, 5]
        for d, w in words.items():
            assert got[d]["n_shingles"] == len({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    elif n == 2:
        assert all(got[d]["text_crc32"] == zlib.crc32(raw[d]) and got[d]["size"] == len(raw[d]) + 1 for d in got)
    elif n == 3:
        assert got[1]["text"] == long_rows[0][1] and len(got[3]["text"].split()) < 100 and len(got[2]["text"]) < len(raw[2]) / 2
    elif n in (4, 9):
        for d, t, _ in long_rows:
            ids = library.encode(t, add_special_tokens=False).ids
            if n == 9:
                assert got[d]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and got[d]["decoded_sha256"] == hashlib.sha256(raw[d]).hexdigest()
            else:
                assert got[d]["ids_crc32"] == zlib.crc32(np.array([*ids, 2], "<u4").tobytes())
    elif n == 5:
        want = {d: ("bench-7",) if d == 3 else () for d in got}
        for d, w in words.items():
            if any(w[k : k + 3] == ["w100", "w101", "w102"] for k in range(len(w))):
                want[d] += ("bench-8",)
            assert got[d]["items_sha256"] == hashlib.sha256(",".join(sorted(want[d])).encode()).hexdigest()
            assert got[d]["n_words"] == len(w)
    elif n == 6:
        assert all(got[d]["payload_sha256"] == hashlib.sha256(raw[d].ljust(-(-len(raw[d]) // 64) * 64, b"\0")).hexdigest() for d in got)
    elif n == 8:
        assert all(got[d]["n_tokens"] == len(words[d]) + 1 for d in got)


def test_contamination_of_one_id_with_different_texts(spark):
    phrase = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = spark.createDataFrame([(1, phrase), (1, "clean words only"), (1, phrase), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([("b", phrase), ("a", phrase.upper()), ("c", " ".join(phrase.split()[:4]))], "item_id string, text string")
    for most in (1_000_000, 16):
        got = sorted((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), tuple(r["spans"])) for r in contamination.benchmark_matches(spark, docs, items, most_terms=most).collect())
        assert got == [(1, 3, 0, (), ()), (1, 14, 14, ("a", "b", "c"), (0, 14)), (1, 14, 14, ("a", "b", "c"), (0, 14)), (2, 0, 0, (), ())]


def test_long_items_are_parted(spark):
    rng = random.Random(5)
    item = [f"w{rng.randrange(60)}" for _ in range(300)]
    rows = [(k, " ".join(["x"] + item[k * 7 : k * 7 + rng.randrange(10, 40)] + ["y"])) for k in range(40)]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    whole, parted = ({r["doc_id"]: r for r in contamination.benchmark_matches(spark, docs, items, near_span=20, most_terms=m).collect()} for m in (10**6, 60))
    assert whole == parted and 10 < sum(r["n_hit"] > 0 for r in whole.values()) < 40


def test_token_files_of_one_id_are_the_same_each_time(spark):
    rows = [(7, f"text number {k}") for k in range(30)] + [(3, "first")]
    twice = [[(r["doc_id"], r["start"], r["ids_crc32"]) for r in sorted(tokens(spark, spark.createDataFrame(rows[::step], "doc_id long, text string").repartition(3)).collect(), key=lambda r: r["start"])] for step in (1, -1)]
    assert twice[0] == twice[1] and twice[0][0][0] == 3


@pytest.mark.parametrize("text", ["́̈ 12", "12 34", "́", "!?", "⃝"])
def test_texts_without_letters(spark, some, text):
    frame = some.union(spark.createDataFrame([(99, text, "en")], some.schema))
    [row] = langid.identify(spark, frame).where("doc_id = 99").collect()
    assert (row["lang_pred"], row["score"]) == ("und", 0)


def plain_grams(text):
    """Counts of the hashed n-grams of a text."""
    signs = []
    for c in text:
        kind = unicodedata.category(c)[0]
        if kind in "LM":
            signs.append(ord(c.lower()[0]) if kind == "L" else ord(c) | 1 << 31)
        elif signs and signs[-1]:
            signs.append(0)
    out, full = collections.Counter(), 0xFFFFFFFFFFFFFFFF
    for k in langid.ORDERS:
        for i in range(len(signs) - k + 1):
            code = 0
            for s in signs[i : i + k]:
                code = (code * 0x100000001B3 + s + 1) & full
            x = (code + k) & full
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = ((x ^ x >> shift) * factor) & full
            out[((x ^ x >> 31) >> 20) % langid.COLUMNS] += 1
    return out


def test_language_equals_plain_version(spark):
    rng = random.Random(4)
    letters = {"aa": "abcde ", "bb": "defgh́ ", "cc": "xyzé ß"}
    rows = [(i, "".join(rng.choice(letters[lang]) for _ in range(rng.randrange(5, 60))), lang) for i, lang in enumerate(rng.choice(list(letters)) for _ in range(120))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learn = frame.where(~langid.held_out())
    model = langid.fit(spark, learn)
    ids = {r["doc_id"] for r in learn.collect()}
    assert ids == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 3 != 1}
    df = collections.Counter(c for i, t, _ in rows if i in ids for c in plain_grams(t))
    n = sum(any(unicodedata.category(c)[0] == "L" for c in t) for i, t, _ in rows if i in ids)
    idf = {c: math.log((1 + n) / (1 + df[c])) + 1 for c in range(langid.COLUMNS)}
    assert all(model.idf[c] == pytest.approx(idf[c], rel=1e-6) for c in df)
    got = {r["doc_id"]: r for r in langid.predict(spark, frame, model).collect()}
    for i, t, _ in rows:
        value = {c: (1 + math.log(k)) * idf[c] for c, k in plain_grams(t).items()}
        norm = math.sqrt(sum(x * x for x in value.values()))
        logits = [(sum(x / norm * float(model.weights[c, k]) for c, x in value.items()) + model.bias[k]) / model.temperature for k in range(3)]
        chance = [math.exp(x) / sum(map(math.exp, logits)) for x in logits]
        assert got[i]["score"] == pytest.approx(max(chance), abs=1e-5)
        assert got[i]["lang_pred"] == model.labels[int(np.argmax(chance))]
    held = [r for r in got.values() if r["doc_id"] not in ids]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.95


def test_ftrl_equals_plain_steps():
    rng = np.random.default_rng(6)
    learner = langid.Ftrl(6, 3, alpha=0.5, beta=1.0, l1=0.05, l2=0.2)
    z, n = np.zeros((7, 3)), np.zeros((7, 3))  # the last row is the bias
    weight = lambda z, n: 0.0 if abs(z) <= 0.05 else -(z - math.copysign(0.05, z)) / ((1.0 + math.sqrt(n)) / 0.5 + 0.2)
    for _ in range(60):
        columns, label = rng.choice(6, 3, replace=False), int(rng.integers(3))
        values = rng.random(3)
        w = [[weight(z[r, k], n[r, k]) for k in range(3)] for r in range(7)]
        logits = [sum(values[j] * w[c][k] for j, c in enumerate(columns)) + w[6][k] for k in range(3)]
        chance = [math.exp(x) / sum(map(math.exp, logits)) for x in logits]
        for j, c in [*enumerate(columns), (None, 6)]:
            for k in range(3):
                g = (chance[k] - (k == label)) * (1.0 if j is None else values[j])
                z[c, k] += g - (math.sqrt(n[c, k] + g * g) - math.sqrt(n[c, k])) / 0.5 * w[c][k]
                n[c, k] += g * g
        learner.update(columns, values, label)
    got, bias = learner.weights()
    assert got == pytest.approx(np.array([[weight(z[r, k], n[r, k]) for k in range(3)] for r in range(6)])) and bias == pytest.approx([weight(z[6, k], n[6, k]) for k in range(3)])
    assert (got == 0).any()


def test_shards_equal_plain_version(spark):
    """Cuts at the given order's places: slots follow the order of (hash, id), equal texts stay together where their bytes allow it."""
    rng = random.Random(3)
    rows = [(i, f"text {rng.randrange(150)} " * rng.randrange(1, 9) if i % 4 else f"group {i % 12}") for i in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    key = {r["doc_id"]: (r["h"] ^ -(1 << 63), r["doc_id"]) for r in frame.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    for each in (50_000, 40):
        got = {r["doc_id"]: r for r in sharding.shard_documents(spark, frame, shards=5, tolerance=0.05, rows_each=each).collect()}
        order = sorted(key, key=lambda d: (key[d][0] % (1 << 64), key[d][1]))
        want, slot = [], collections.Counter()
        for d in order:
            want.append((got[d]["shard"], slot[got[d]["shard"]]))
            slot[got[d]["shard"]] += 1
        assert [(got[d]["shard"], got[d]["slot"]) for d in order] == want  # gapless along the order
        assert [s for s, _ in want] == sorted(s for s, _ in want)
        text = dict(rows)
        together = collections.defaultdict(set)
        for d in order:
            together[text[d]].add(got[d]["shard"])
        mean = sum(len(t) + 1 for _, t in rows) / 5
        assert all(len(s) == 1 or sum(len(t) + 1 for _, t in rows if t == x) > 0.05 * mean for x, s in together.items())


def test_pipeline_stages_of_odd_tables(spark, small):
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (3, "words of one text " * 30, "en", "s", None), (3, "words of other text " * 40, "en", "s", 5), (3, "words of other text " * 40, "en", "s", 5), (None, "no id here", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0), docs.withColumns({c: F.lit("x") for c in NAMES})):
        for name, stage in pipeline.STAGES:
            frame = stage(spark, frame, small)
            if name != "tokens":
                assert frame.columns == list(pipeline.COLUMNS)
        assert frame.where("doc_id IS NULL").count() == 0


def test_shared_folder(spark):
    class Far:
        sparkContext = type("C", (), {"getConf": lambda self: {}, "master": "spark://host:7077"})()
        conf = {}

    with pytest.raises(ValueError):
        shared_dir(Far())
    assert shared_dir(spark)


def test_release_deletes_tables(spark, some):
    out = sharding.shard_documents(spark, some)
    assert out.count() == 43
    release(spark)
    with pytest.raises(Exception):
        sharding.shard_documents(spark, some.limit(3)).sparkSession.read.parquet(out.inputFiles()[0]).collect()


def test_arrow_of_large_strings():
    from sigspark.llm import _text as T

    data, offs = T.text_arrays(pa.array(["a", None, "bc"], pa.large_string()).slice(1))
    assert data.tobytes() == b"bc" and offs.tolist() == [0, 0, 2]
