"""Similarity join and substring dedup against plain versions."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigspark.llm import _text as T
from sigspark.llm import jaccard, spans
from sigspark.llm.jaccard import jaccard_components
from sigspark.llm.spans import remove_repeated_spans


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(rows, percent=75, width=5):
    sets = []
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets.append((doc_id, {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())))
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {d: (len(s), find(d)) for d, s in sets}


@pytest.mark.parametrize("tight", [False, True])
def test_components_equal_brute_force(spark, docs, corpus, monkeypatch, tight):
    options = {}
    if tight:  # frequent classes, uncounted groups and the rounds over large clusters
        monkeypatch.setattr(jaccard, "FREQUENT_DF", 2)
        monkeypatch.setattr(jaccard, "PAIRED", 2)
        options = {"cluster_tokens": 50}
    want = brute([(r[0], r[1]) for r in corpus])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(spark, docs, **options).collect()}
    assert got == want


def test_nodes_beyond_a_broadcast(spark, docs, corpus, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_NODES", 0)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(spark, docs).collect()}
    assert got == brute([(r[0], r[1]) for r in corpus])


def test_a_line_that_all_documents_share(spark, monkeypatch):
    """A large group of one signature without links but two: pivots are taken in rounds, no list of all pairs is made."""
    monkeypatch.setattr(jaccard, "PAIRED", 2)
    monkeypatch.setattr(jaccard, "FREQUENT_DF", 10**9)
    rng, keys = random.Random(2), []
    rows = [(d, "the same line of words here " + " ".join(f"o{rng.randrange(10**9)}" for _ in range(12))) for d in range(70)]
    rows += [(70, rows[3][1] + " more"), (71, rows[3][1].upper() + " more words"), (72, rows[40][1])]
    put = jaccard.Stage.put
    monkeypatch.setattr(jaccard.Stage, "put", lambda self, df, key: keys.append(key) or put(self, df, key))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(spark, frame, cluster_tokens=50).collect()}
    assert got == brute(rows)
    assert sum(k == "pivots" for k in keys) > 2


def test_repeated_rows_and_clashing_columns(spark, docs, corpus):
    frame = docs.union(docs).withColumn("node", F.lit("x")).withColumn("n", F.lit(1)).withColumn("component_id", F.lit(2))
    got = jaccard_components(spark, frame)
    assert got.count() == 2 * len(corpus)
    assert got.distinct().count() == len(corpus)


def test_empty_table(spark, none):
    assert jaccard_components(spark, none).collect() == []
    assert remove_repeated_spans(spark, none).collect() == []


def test_repeated_passages_go_and_first_stays(spark, docs, corpus):
    got = {r["doc_id"]: r for r in remove_repeated_spans(spark, docs).collect()}
    assert len(got) == len(corpus)
    seen = {}
    for doc_id in sorted(got):
        w = lower(got[doc_id]["text"]).split()
        for k in range(len(w) - 49):
            assert seen.setdefault(tuple(w[k : k + 50]), doc_id) == doc_id
    first = {}
    for doc_id, text, *_ in sorted(corpus, key=lambda r: r[0]):
        if text and len(text.split()) > 60:
            first.setdefault(text, doc_id)
    kept = [d for t, d in first.items() if got[d]["n_removed"] == 0]
    assert all(got[d]["text"] == dict((r[0], r[1]) for r in corpus)[d] for d in kept) and kept
    nulls = [r[0] for r in corpus if r[1] is None]
    assert all(got[d]["text"] is None and got[d]["n_removed"] == 0 for d in nulls)


def test_spans_keep_rows_without_id_and_replace_clashing_columns(spark):
    text = "One two three four five six. Seven eight nine ten eleven twelve. "
    frame = spark.createDataFrame([(None, text, 5), (1, text, 5), (2, text + "More of it here.", 5), (2, text + "More of it here.", 5)], "doc_id long, text string, n_removed int")
    got = sorted(((r["doc_id"] or 0, r["text"], r["n_removed"]) for r in remove_repeated_spans(spark, frame, 2, 10, 12).collect()), key=str)
    assert got[0] == (0, text, 0) and got[1] == (1, text, 0)
    assert got[2] == got[3] and "One two" not in got[2][1]


def plain_spans(rows, sentences, words, long_words):
    """{(doc_id, text): text without its repeated pieces}, by loops over words; only the order of words is asked of the library."""

    def pieces(text):
        found = [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        raw = np.frombuffer(text.encode(), np.uint8)
        rank = T.word_hashes(raw, np.array([0, len(raw)]))[0].tolist() if found else []
        last = [k + 1 == len(found) or w[-1] in ".!?" or "\n" in text[b : found[k + 1][1]] for k, (w, _, b) in enumerate(found)]
        cut, start = set(), 0
        for k, end in enumerate(last):
            if end:
                cut.add(k)
                for a in range(start, k - long_words + 1):
                    least = min(rank[a : a + long_words + 1])
                    cut.add(max(i for i in range(a, a + long_words + 1) if rank[i] == least))
                start = k + 1
        out, a = [], 0
        for k in sorted(cut):
            out.append([lower(w) for w, _, _ in found[a : k + 1]])
            a = k + 1
        starts = [0]
        for p in out:
            starts.append(starts[-1] + len(p))
        bounds = [0] + [found[i][1] for i in starts[1:-1]] + [len(text)] if found else [0, len(text)]
        return out, bounds

    docs = sorted({(d, t) for d, t in rows if t is not None})
    parts = {doc: pieces(doc[1]) for doc in docs}
    seen = collections.defaultdict(set)
    for doc, (own, _) in parts.items():
        n = len(own)
        for i in range(n):
            to = next((j for j in range(i + sentences - 1, n) if sum(map(len, own[i : j + 1])) >= words), None)
            back = next((j for j in range(i - sentences + 1, -1, -1) if sum(map(len, own[j : i + 1])) >= words), None)
            for a, b in ((i, to), (back, i)):
                if a is not None and b is not None:
                    seen[tuple(w for p in own[a : b + 1] for w in p)].add((doc, a, b))
    gone = collections.defaultdict(set)
    for places in seen.values():
        for doc, a, b in sorted(places)[1:]:
            gone[doc] |= set(range(a, b + 1))
    return {doc: "".join(doc[1][x:y] for k, (x, y) in enumerate(zip(bounds, bounds[1:])) if k not in gone[doc]) for doc, (_, bounds) in parts.items()}


@pytest.mark.parametrize("options", [(3, 24, 8), (2, 10, 12), (1, 5, 3)])
def test_spans_equal_plain_version(spark, docs, corpus, options):
    want = plain_spans([(r[0], r[1]) for r in corpus], *options)
    got = {(r["doc_id"], r["old"]): r["text"] for r in remove_repeated_spans(spark, docs.withColumn("old", F.col("text")), *options).collect()}
    assert {k: v for k, v in got.items() if k[1] is not None} == want
    assert sum(want[d] != d[1] for d in want) > 5


def test_one_id_with_different_texts(spark):
    rng = random.Random(1)
    a, b, c = (" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(60)) for x in "abc")
    rows = [(5, a + ". " + b), (5, c), (5, c), (6, b), (6, None), (7, c + ". " + a)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"] is None, len((r["text"] or "").split())) for r in remove_repeated_spans(spark, frame).collect())
    assert [x[0] for x in got] == [5, 5, 5, 6, 6, 7] and got[4][1]
    assert [x[2] for x in got[:3]] == [60, 60, 120] and got[3][2] <= 17 and got[5][2] <= 34
    # the similarity join takes each row's own set
    linked = {(r["n_shingles"], r["component_id"]) for r in jaccard_components(spark, frame).collect()}
    assert linked == {(116, 5), (56, 5), (56, 6), (0, 6), (116, 7)}


@pytest.mark.parametrize("size, distinct, stops", [(51, 51, False), (51, 51, True), (60, 10, False), (51, 20, False)])
def test_every_repeated_passage_of_51_words_goes(spark, size, distinct, stops):
    """Glued to other text, without punctuation or with it anywhere, and of few distinct words."""
    rng, rows, passages = random.Random(7), [], []
    other = lambda: [f"o{rng.randrange(10**9)}" for _ in range(rng.randrange(3, 40))]
    for k in range(300):
        names = [f"w{k}x{rng.randrange(10**6)}" for _ in range(distinct)]
        passage = [rng.choice(names) if distinct < size else names[i] for i in range(size)]
        if stops:
            passage = [w + "." * (rng.random() < 0.1) for w in passage]
        passages.append(set(passage))
        rows += [(d, " ".join(other() + passage + other())) for d in (2 * k, 2 * k + 1)]
    got = {r["doc_id"]: r["text"] for r in remove_repeated_spans(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    for k, words in enumerate(passages):
        assert sum(w in words for w in got[2 * k + 1].split()) <= 25
        if distinct == size:  # no run of the passage occurs in it twice
            assert got[2 * k] == text[2 * k]


def test_a_repeated_line_without_stops_goes(spark):
    """Its last piece, which no run from a piece ends with, goes too."""
    rng = random.Random(3)
    lines = [" ".join(f"t{k}x{i}" for i in range(60)) for k in range(100)]
    rows = [(d, f"o{rng.random()} begins\n{lines[d % 100]}\nends o{rng.random()}") for d in range(200)]
    got = {r["doc_id"]: r["text"] for r in remove_repeated_spans(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, text in rows:
        assert got[d] == text if d < 100 else lines[d - 100] not in got[d] and not re.search(r"t\d+x", got[d])


def test_percent_that_would_lose_links_is_an_error(spark, docs):
    with pytest.raises(ValueError):
        jaccard_components(spark, docs, percent=50)


def test_span_tasks_deal_their_runs_in_small_blobs():
    rng = np.random.default_rng(4)
    words = np.array([f"w{k}" for k in range(5000)])
    rows = [". ".join(" ".join(words[rng.integers(0, 5000, 8)]) for _ in range(400)) + "." for _ in range(1100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1100), pa.int64()), pa.array(rows), pa.array([0] * 1100, pa.int64())], ["doc_id", "text", "key"])
    sizes = [sum(len(x.as_buffer()) for x in out.column("blob")) for out in spans._emit((3, 24, 8), 8, iter([batch]))]
    assert sum(sizes) > 34 * 380_000 and max(sizes) < 34 * 360_000
