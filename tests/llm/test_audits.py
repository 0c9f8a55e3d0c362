"""Source divergence and secret scans against plain versions."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.llm import divergence, ownership
from sigspark.llm._shared import release

SCHEMA = "doc_id long, text string, lang string, source string"
CLASH = "n df term total p q low v item value rank part slot k hash found row kind start end live spans owner repo n_rows verdict".split()


@pytest.fixture(scope="module")
def papers(spark):
    rng = random.Random(2)
    words = [f"{c}{d}or" for c in "abcdefghij" for d in "éuxyz"] + ["the", "THE", "ÜBER", "über", "x" * 300]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(30))) + rng.choice([".", "1a2b", "-", " ", "\x00z"]), rng.choice(["en", "de", "fr"]), rng.choice(["s1", "s2", "s3", "é4"])) for i in range(90)]
    rows += [(200, None, "en", "void"), (201, "", "it", None), (202, "12 34", None, "s1"), (203, "only once", "pt", "s1"), (204, "twice here", "pt", "s2"), (5, rows[5][1], rows[5][2], rows[5][3]), (None, "the the the", "en", "s1")]
    rows.append((205, "über " * 300_000 + "rare", "en", "s2"))
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def plain_divergence(rows, least=3, top=200):
    docs = [(r["lang"] or "", r["source"] or "", [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r["text"] or "")]) for r in rows]
    groups = sorted({d[:2] for d in docs})
    out = []
    for lang in {g[0] for g in groups}:
        df = collections.Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = sorted(t for t in df if df[t] >= least)
        count = {g: collections.Counter(t for d in docs if d[:2] == g for t in d[2] if df[t] >= least) for g in groups if g[0] == lang}
        whole = sum(count.values(), collections.Counter())
        p = {g: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept} for g, c in [*count.items(), (None, whole)]}
        for g in count:
            pairs = [(sum((p[g][t] - p[h][t]) ** 2 // p[h][t] for t in kept), h[1]) for h in count if h != g]
            terms = [((p[g][t] - p[None][t]) ** 2 // p[None][t], t) for t in kept if count[g][t] and p[g][t] > p[None][t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(*g, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


COLUMNS = ("lang", "source", "part", "item", "value", "rank")


@pytest.mark.parametrize("width, top", [(divergence.WIDTH, 200), (8, 200), (1, 2)])
def test_divergence_equals_plain_version(spark, papers, width, top):
    """A sketch too small to rule out anything gives the same rows."""
    got = sorted(tuple(r[c] for c in COLUMNS) for r in divergence.source_divergence(spark, papers, top=top, width=width).collect())
    assert got == plain_divergence(papers.collect(), top=top) and any(g[2] == "pair" and g[4] == 0 for g in got)


def test_divergence_of_odd_tables(spark, papers):
    few = papers.where("text IS NULL OR length(text) < 200")
    want = sorted(map(tuple, divergence.source_divergence(spark, few, width=1 << 12).collect()))
    other = divergence.source_divergence(spark, few.withColumns({c: F.lit("x") for c in CLASH}), width=1 << 12)
    assert sorted(map(tuple, other.collect())) == want
    assert divergence.source_divergence(spark, papers.limit(0), width=1 << 12).collect() == []
    with pytest.raises(ValueError):
        divergence.source_divergence(spark, papers, least=256)
    release(spark)


def test_sketch_never_underestimates(spark, papers):
    rows = papers.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    df = collections.Counter((r["lang"], t) for r in rows.collect() for t in {re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r["text"])})
    import pyarrow as pa

    for width in (16, 1 << 16):
        sketch = divergence.document_sketch(rows, width, 3)
        estimate = {}
        for lang, term in df:
            cells = divergence._cells(divergence._hashes(pa.array([lang])), divergence._hashes(pa.array([term])), width, 3)
            estimate[lang, term] = min(int(row[c[0]]) for row, c in zip(sketch, cells))
        assert all(estimate[k] >= min(n, 255) for k, n in df.items())
    assert np.mean([estimate[k] == n for k, n in df.items()]) > 0.99


def test_shares_are_exact(spark):
    rng = random.Random(7)
    rows = [(c, c + rng.randrange(10 ** rng.randrange(1, 15)), rng.randrange(1, 10 ** rng.randrange(1, 9))) for c in (rng.randrange(10 ** rng.randrange(1, 15)) for _ in range(500))] + [(0, 0, 1), (10**15, 10**15, 1)]
    got = spark.createDataFrame(rows, "c long, n long, v long").select("c", "n", "v", divergence.share("c", "n", "v").alias("p")).collect()
    assert all(r["p"] == 1 + 10**9 * (r["c"] + 1) // (r["n"] + r["v"]) for r in got)


HEXA = "0123456789abcdef"


@pytest.fixture(scope="module")
def code(spark):
    rng = random.Random(4)
    make = lambda signs, n: "".join(rng.choices(signs, k=n))
    copied, twice, bare = "AKIA" + make("ABCDEFGH234567", 16), make("abcdefXYZ123456+/", 24), "Zk" + make("ghijkGHIJ789_", 30)
    rows = []
    for i in range(40):
        parts = ["é\U0001f600 text"]
        parts += [f"key {copied}"] * (i % 3 == 0) + [f"Secret: '{twice}'"] * (i in (4, 5)) + [f"see {bare} or /{bare}/"] * (i == 7)
        parts += [f"pass {make('qrstQRST456', 20)}x9"] * (i % 5 == 0) + [f'API_KEY="{make(HEXA, 32)}"', "password = short"] * (i % 4 == 1)
        parts += ["secret = token: abcdefghijkl0123", "Token==/etc/passwd:x", "AKIA", "AKIAAKIA0", make(HEXA, 15), make(HEXA, 16), "changeme-1234abcdXYZ", "Key paſſword:abcdefghijklmn"] * (i % 7 == 2)
        rows.append((i, " ".join(parts), ("en", "fr", None)[i % 3 % 2 * 2], (f"s{i % 4}", None)[i == 8]))
    rows += [(50, None, "en", "s1"), (51, "", None, None), rows[7], (52, rows[7][1], "de", rows[7][3]), (None, "token=abcdefghijklmnop", "en", "s"), (53, "word " * 300_000 + f"{make(HEXA, 40)} end", "en", "s9")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def plain_secrets(rows):
    """By the contract for base matches; bare tokens are those of one owner that overlap no base match."""
    assign = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    live = lambda v: len(v) > 15 and len(set(v)) > 9 and re.search("[A-Za-z]", v) and re.search("[0-9]", v) and not any(w in v.lower() for w in ownership.PLACEHOLDERS)
    found, owners, repos, times = [], collections.defaultdict(set), collections.defaultdict(set), collections.Counter()
    for r in rows:
        text, own = r["text"] or "", []
        own += [(m.start(), 0, m.end(), m[2]) for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 12]
        own += [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        own += [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        taken = {x for a, _, b, _ in own for x in range(a, b)}
        own += [(m.start(), 3, m.end(), m[0]) for m in re.finditer("[A-Za-z0-9+/_=-]+", text) if live(m[0]) and not taken & set(range(m.start(), m.end()))]
        found.append(sorted(own))
        for v in {x[3] for x in own}:
            owners[v].add(r["source"] or "")
            repos[v].add((r["source"] or "", r["lang"] or ""))
            times[v] += 1
    out = []
    for r, own in zip(rows, found):
        spans = []
        for a, k, b, v in own:
            verdict = "copied" if len(owners[v]) > 2 else "owned" if len(owners[v]) == 1 and live(v) else "unclear"
            if k < 3 or verdict == "owned":
                spans.append((a, k, b, verdict, times[v], len(repos[v]), len(owners[v]), hashlib.sha256(v.encode()).hexdigest()))
        out.append((r["doc_id"], tuple(spans)))
    return sorted(out)


def scan(spark, docs):
    return ownership.find_secrets(spark, docs, repo="lang", owner="source")


def test_secrets_equal_plain_version(spark, code, monkeypatch):
    rows = [r for r in code.collect() if r["doc_id"] is not None]
    want = plain_secrets(rows)
    for hot in (ownership.HOT_VALUES, 0):  # the ways of hot and of other values
        monkeypatch.setattr(ownership, "HOT_VALUES", hot)
        found = scan(spark, code)
        got = sorted((r["doc_id"], tuple((*s[:7], bytes(s[7]).hex()) for s in r["spans"])) for r in found.collect())
        assert got == want
    kinds = collections.Counter((s[1], s[3]) for _, spans in want for s in spans)
    assert {(0, "unclear"), (0, "owned"), (1, "copied"), (2, "owned"), (3, "owned")} <= set(kinds)
    text = lambda spans: ",".join(f"{ownership.KINDS[s[1]]}:{s[0]}:{s[2]}" for s in spans)
    plain = sorted((d, *(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(text([s for s in spans if s[1] < 3]).encode()).hexdigest(), text(spans)) for d, spans in want)
    assert sorted(map(tuple, ownership.digest(found).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans").collect())) == plain


def test_hot_values_are_joined_by_broadcast(spark):
    rows = [(i, "token=" + ("abcdefghijkl0123" if i % 3 else f"abcdefghij{i + 13_572_468}"), "en", f"s{i % 5}") for i in range(900)]
    got = scan(spark, spark.createDataFrame(rows, SCHEMA)).collect()
    assert collections.Counter(s["verdict"] for r in got for s in r["spans"]) == {"copied": 600, "owned": 300}
    assert {s["n_rows"] for r in got for s in r["spans"]} == {600, 1}


def test_secrets_of_odd_tables(spark, code):
    few = code.where("text IS NULL OR length(text) < 500")
    plain, other = (sorted(map(str, scan(spark, d).collect())) for d in (few, few.withColumns({c: F.lit("x") for c in CLASH})))
    assert plain == other
    assert scan(spark, code.limit(0)).collect() == []
    release(spark)
