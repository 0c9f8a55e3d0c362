"""Decontamination, language identification, language model, quality and media against plain versions."""

import collections
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from sigspark.llm import langid, lm, quality, tiff
from sigspark.llm.contamination import benchmark_matches, flags


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def items(spark, corpus):
    texts = [r[1] for r in corpus if r[1] and len(r[1].split()) > 40]
    rows = [(1, " ".join(texts[0].split()[10:40])), (2, "two words"), (30, "nothing of it occurs here at all in any of these documents no no no"), (4, None), (5, " ?! "), (6, " ".join(texts[3].split()[5:17]).upper()), (None, texts[1]), (7, "of of of of of of of of of of of of of of")]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("rarest", [1, 3, 13])
def test_contamination(spark, docs, corpus, items, rarest):
    windows = collections.defaultdict(set)
    for r in items.collect():
        w = ALNUM.findall(lower(r["text"]))
        for k in range(max(1, len(w) - 12)) if w and r["item_id"] is not None else ():
            windows[tuple(w[k : k + 13])].add(r["item_id"])
    got = {r["doc_id"]: r for r in flags(benchmark_matches(spark, docs, items, rarest=rarest)).collect()}
    assert len(got) == len(corpus)
    for doc_id, text, *_ in corpus:
        w, hit, found = ALNUM.findall(lower(text)), set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                own = windows.get(tuple(w[k : k + size]))
                if own:
                    hit |= set(range(k, k + size))
                    found |= own
        r = got[doc_id]
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w))


def test_contamination_in_blocks_and_repeated_items(spark, docs, items):
    more = items.union(items).unionByName(docs.where("length(text) > 300").select(F.lit(30).cast("long").alias("item_id"), "text").limit(2))
    whole = {r["doc_id"]: r for r in benchmark_matches(spark, docs, more).collect()}
    parts = {r["doc_id"]: r for r in benchmark_matches(spark, docs, more, most_terms=60).collect()}
    assert whole == parts and any("30" in r["items"] for r in whole.values())


def test_contamination_of_nothing(spark, docs, none, items):
    assert benchmark_matches(spark, none, items).collect() == []
    assert flags(benchmark_matches(spark, docs, items.limit(0))).where("n_hit > 0").count() == 0


def test_proximity(spark):
    item = "alpha beta gamma"
    docs = spark.createDataFrame([(1, "gamma x alpha y beta"), (2, "alpha " + "x " * 40 + "beta gamma"), (3, "alpha beta")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_near"] for r in benchmark_matches(spark, docs, spark.createDataFrame([(1, item)], "item_id long, text string"), near_span=6).collect()}
    assert got == {1: 1, 2: 0, 3: 0}


LANGUAGES = {"aa": "the of and th er in", "bb": "que de la ción os", "cc": "der und sch ein ö"}


@pytest.fixture(scope="module")
def spoken(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(240):
        lang = rnd.choice(list(LANGUAGES))
        parts = LANGUAGES[lang].split()
        rows.append((i, " ".join("".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(4, 40))), lang))
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "123 !!!", "cc"), (903, "the and of the", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language(spark, spoken):
    got = {r["doc_id"]: r for r in langid.identify(spark, spoken.withColumn("score", F.lit("x")), fit_rows=120).collect()}
    held = [r for r in got.values() if r["doc_id"] < 900 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    assert got[903]["lang_pred"] == "aa" and all(0 <= r["score"] <= 1 for r in got.values())


def test_language_of_nothing(spark, spoken):
    assert langid.identify(spark, spoken.limit(0)).collect() == []
    assert {r["lang_pred"] for r in langid.predict(spark, spoken, None).collect()} == {"und"}
    assert langid.fit(spark, spoken.withColumn("lang", F.lit(None).cast("string"))) is None


def test_calibration_lowers_loss():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 300)
    z = 8 * (np.eye(3)[np.where(rng.random(300) < 0.7, y, rng.integers(0, 3, 300))])
    assert langid.calibrate(z, y) > 2


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def plain_score(model, words, count):
    """The log10 probability of a text by loops over all alternatives, and the probabilities' sums."""
    groups, r = model.ready.groups, model.ready
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    key, _ = lm.chunk_words(data, np.array([0, len(data)]))
    known = {int(k): i for i, k in enumerate(model.heavy)}
    end = len(known)
    symbols = [known.get(int(k), end + 1 + int(k) % 64) for k in key] + [end]
    total, sums, two, one = 0.0, [], end, end
    for k, symbol in enumerate(symbols):
        hat = r.near[groups.place[one]].astype(float) + r.far[groups.place[two]].astype(float)
        chance = {}
        top = [math.exp(sum(hat * q)) for q in r.of_groups.astype(float)]
        for g in range(len(top)):
            own = range(groups.start[g], groups.start[g + 1])
            each = [math.exp(sum(hat * r.of_places[p].astype(float))) for p in own]
            for p, x in zip(own, each):
                chance[p] = top[g] / sum(top) * x / sum(each)
        sums.append(sum(chance.values()))
        total += math.log10(chance[groups.place[symbol]])
        if symbol > end:
            total += model.class_log[symbol - end - 1] + math.log10(count[words[k]] + 1)
        two, one = one, symbol
    return total, sums


def test_language_model(spark, docs, corpus):
    model = []
    got = {r["doc_id"]: r for r in lm.score_documents(spark, docs, steps=30, details=model).collect()}
    tokens = {r[0]: split(r[1]) + ["\n"] for r in corpus}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    count = collections.Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(count.values()), len(count)
    assert len(got) == len(corpus)
    for d, ws in tokens.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(ws), sum(count[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), abs=1e-6)
    short = sorted((r for r in corpus if len(split(r[1])) < 60), key=lambda r: r[0])
    assert {len(split(r[1])) for r in short} > {0, 1, 2}
    for d, text, *_ in short:
        want, sums = plain_score(model[0], split(text), count)
        assert got[d]["score"] == pytest.approx(want, abs=1e-3) and sums == pytest.approx([1] * len(sums))
    # the words of a class and one unseen share its probability
    kinds = collections.Counter()
    known = {int(k) for k in model[0].heavy}
    for w, c in count.items():
        key = int(lm.chunk_words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0][0]) if w != "\n" else None
        if key is not None and key not in known:
            kinds[key % 64] += c + 1
    assert kinds and all(10 ** -model[0].class_log[k] == pytest.approx(x + 1) for k, x in kinds.items())


def test_language_model_learns_what_follows():
    rng = np.random.default_rng(2)
    groups = lm.Groups.of(np.full(40, 100))
    one = rng.integers(0, 40, 60_000)
    symbol = np.where(rng.random(60_000) < 0.7, (one + 3) % 40, rng.integers(0, 40, 60_000))
    net = lm.LogBilinear(groups)
    two = rng.integers(0, 40, 60_000)
    before = net.ready().log10(two, one, symbol).mean()
    net.train(*(groups.place[x] for x in (two, one, symbol)), rng)
    after = net.ready().log10(two, one, symbol).mean()
    assert before < -1.5 and after > -1.1


def test_copies_are_averaged_by_their_changes():
    pack = lambda task, rows, times, change: pa.scalar(np.int64(task).tobytes() + np.array(rows, np.int64).tobytes() + np.array(times, np.float32).tobytes() + np.array(change, np.float32).tobytes(), pa.binary())
    got = np.frombuffer(lm._mean_change(1, [pack(1, [0, 5], [1, 2], [[1, 2], [3, 4]]), pack(0, [5], [6], [[7, 8]])]), np.float32).reshape(-1, 2)
    assert got[0].tolist() == [1, 2] and got[5].tolist() == [6, 7] and not got[1:5].any()


def test_language_model_grows_with_the_learning_corpus():
    sizes = [lm.vocabulary_for(10**k) for k in range(6, 13)]
    assert sizes == sorted(sizes) and len(set(sizes)) == len(sizes) and lm.vocabulary_for(10**9) > 10_000


def test_held_out_documents_teach_nothing(spark, docs, corpus):
    held = F.pmod("doc_id", F.lit(5)) == 2
    other = docs.withColumn("text", F.when(held, F.concat(F.lit("hidden words " * 40), F.coalesce("text", F.lit("")))).otherwise(F.col("text")))
    a, b = ({r["doc_id"]: r for r in lm.score_documents(spark, d, held=held, steps=20).collect()} for d in (docs, other.coalesce(1)))
    for d in a:
        if d % 5 != 2:
            assert (a[d]["score"], a[d]["base_score"], a[d]["n_known"]) == (b[d]["score"], b[d]["base_score"], b[d]["n_known"])
        else:
            assert a[d]["train_tokens"] == b[d]["train_tokens"] and a[d]["score"] > b[d]["score"]


def test_language_model_depends_on_the_table_alone(spark, small):
    """Over 4 MiB of text, of which the first model reads a part: in 1, 8 and 32 partitions and in another order, the same scores."""
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    big = rows
    for k in range(1, 12):
        big = big.unionByName(rows.select((F.col("doc_id") + 10_000 * k).alias("doc_id"), F.concat("text", F.lit(f" w{k} x{k}")).alias("text")))
    big = big.unionByName(rows.select((F.col("doc_id") + 900_000).alias("doc_id"), "text")).cache()
    assert big.agg(F.sum(F.octet_length("text"))).first()[0] > 1 << 22
    seen = []
    for frame in (big.coalesce(1), big.repartition(8), big.repartition(32).sort(F.col("doc_id").desc())):
        seen.append({r["doc_id"]: (r["score"], round(r["base_score"], 6)) for r in lm.score_documents(spark, frame, fit_rows=50).collect()})
    assert seen[0] == seen[1] == seen[2]
    assert all(seen[0][r["doc_id"]] == seen[0][r["doc_id"] + 900_000] for r in rows.collect())  # equal texts


def test_language_model_repeated_rows_and_nothing(spark, docs, corpus, none):
    twice = lm.score_documents(spark, docs.union(docs), steps=20)
    assert twice.count() == 2 * len(corpus)
    assert lm.score_documents(spark, none).collect() == []
    held = lm.score_documents(spark, docs, held=F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in held)


def test_quality(spark):
    rnd = random.Random(6)
    good = "the of and to in is was with that for this are by from".split()
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        words = [rnd.choice(good) + rnd.choice(["", "er", "ing", "tion"]) for _ in range(rnd.randrange(20, 80))]
        rows.append((i, " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words)))
        labels.append((i, int(not bad)))
    rows += [(900, None), (901, ""), (902, "x")]
    labels += [(900, 0), (901, None), (None, 1), (903, 1), (1, 1)]
    d, labelled = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.score(spark, d, quality.fit(d, labelled)).collect()}
    held = [i for i in range(300) if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == int(i % 3 != 0) for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values()) and len(got) == 303
    # plain version of the score, and of what was learnt from
    model = quality.fit(d, labelled)
    text = {i: (t or "").encode() for i, t in rows}
    for i, r in got.items():
        blocks = [text[i][k : k + 256] for k in range(0, len(text[i]), 256)]
        sizes = [sum(len(zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False).compress(b)) for b in blocks) for x in (model.bad, model.good)]
        z = min(6, max(-6, ((sizes[0] - sizes[1]) / max(1, len(text[i])) - model.mean) / model.scale))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-(model.weights[0] + model.weights[1] * z))))
    hidden = [text[i].decode() for i in held if len(text[i]) > 100]
    assert not any(t.encode() in model.good + model.bad for t in hidden)
    lied = labelled.withColumn("quality", F.when(F.col("doc_id").isin(held), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.fit(d, lied)
    assert (again.good, again.bad) == (model.good, model.bad) and again.weights == pytest.approx(model.weights)
    small = quality.fit(d, labelled, fit_bytes=2000)
    assert len(small.good) + len(small.bad) <= 4000
    assert quality.fit(d, labelled.where("quality = 1")) is None
    assert {r["score"] for r in quality.score(spark, d, None).collect()} == {0.5}
    assert quality.score(spark, d.limit(0), None).collect() == []


def test_quality_dictionaries_hold_whole_texts():
    texts = [bytes([65 + k]) * n for k, n in enumerate((10, 20, 30, 40, 500, 60, 5))]
    assert quality.divide(texts, 50) == ([texts[0], texts[2], texts[6]], [texts[1], texts[3], texts[4], texts[5]])
    assert quality.divide(texts[:1], 50) == ([texts[0]], [texts[0]]) and quality.divide(texts[4:5], 50) == ([], [texts[4]])
    for size in (10, 10**6):
        build, rest = quality.divide(texts, size)
        assert sorted(build + rest) == sorted(texts) and sum(map(len, build)) <= size
    model = quality.Model(b"", b"some words of a dictionary")
    assert model.difference(b"some words of a dictionary") > model.difference(b"") - 1


def test_quality_of_long_texts_keeps_its_evidence():
    rnd = random.Random(8)
    good, bad = ([" ".join("".join(rnd.choice(letters) for _ in range(5)) for _ in range(60)) for _ in range(80)] for letters in ("abcdef", "ghijkl"))
    model = quality.Model(*("\n".join(t[:40]).encode() for t in (good, bad)))
    x = np.array([model.difference(t.encode()) for t in bad[40:] + good[40:]])
    model.mean, model.scale = x.mean(), x.std()
    model.weights = quality.logistic(quality.curve((x - model.mean) / model.scale), np.repeat([0.0, 1.0], 40))
    for text, label in (("\n".join(good[40:48]), 1), ("\n".join(bad[40:48]), 0)):  # some blocks
        once, often = (model.scores(np.array([model.difference(text.encode() * n)]))[0] for n in (1, 500))
        assert (once > 0.5) == (often > 0.5) == (label == 1) and abs(once - often) < 0.05
    joined = model.scores(np.array([model.difference("\n".join(good[40:] * 50).encode())]))[0]
    assert joined > 0.5


def test_tiff_round_trips():
    r = np.random.default_rng(1)
    for shape in ((5, 7), (70, 64), (33, 20, 3), (1, 64)):
        for flat in (False, True):
            image = (np.repeat(r.integers(0, 4, (shape[0],) + (1,) * (len(shape) - 1)), shape[1], 1) * np.ones(shape)).astype(np.uint8) if flat else r.integers(0, 256, shape).astype(np.uint8)
            for codec in (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS):
                for options in ({}, {"rows_per_strip": 8}, {"tile": (16, 16)}, {"order": ">"}):
                    raw = tiff.write_tiff([image, image[:3]], codec, predictor=flat, **options)
                    pages = list(tiff.read_tiff(raw))
                    assert len(pages) == 2 and (pages[0].reshape(shape) == image).all()
    data = bytes(r.integers(0, 40, 60_000).astype(np.uint8))
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data and tiff.unpack_bits(tiff.pack_bits(data)) == data


def test_lzw_known_bytes():
    # 7 7 7 8 8 7 7 6 6, the worked example of the format's description
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    raw = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == raw and tiff.lzw_decode(raw) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_media(spark, docs, corpus, none):
    got = {r["doc_id"]: r for r in tiff.media_pages(tiff.text_media(docs, predictor=True)).collect()}
    for doc_id, text, *_ in corpus:
        raw = (text or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = got[doc_id]
        assert (r["n_bytes"], bytes(r["pixels"]), r["payload_sha256"], r["tail_crc32"], r["error"]) == (len(raw), payload, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), None)
    assert tiff.media_pages(tiff.text_media(none)).collect() == []


def test_broken_media(spark):
    good = tiff.write_tiff([np.zeros((4, 4), np.uint8)] * 3, tiff.LZW)
    rows = [(1, good), (2, good[:-9]), (3, b"nothing"), (4, None), (5, b"")]
    got = tiff.media_pages(spark.createDataFrame(rows, "doc_id long, media binary").withColumn("n_bytes", F.lit(0).cast("long"))).collect()
    assert sum(r["doc_id"] == 1 and r["error"] is None for r in got) == 3
    assert all(any(r["doc_id"] == k and r["error"] for r in got) for k in (2, 3, 4, 5))


def _file(tags, data=b"", order="<", big=False):
    """A file of one page: tags are (tag, letter, values); values of tag 273 are moved behind the header."""
    kinds, word = {"H": 3, "I": 4, "Q": 16}, "Q" if big else "I"
    wide = 8 if big else 4
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + ("HHHQ" if big else "HI"), *((43, 8, 0, 16 + len(data)) if big else (42, 8 + len(data))))
    out, more = b"", b""
    at = len(head) + len(data) + struct.calcsize("=" + ("Q" if big else "H")) + len(tags) * (20 if big else 12) + wide
    for tag, letter, values in sorted(tags):
        raw = struct.pack(f"{order}{len(values)}{letter}", *((v + len(head) if tag == 273 else v) for v in values))
        if len(raw) > wide:
            more, raw = more + raw, struct.pack(order + word, at + len(more))
        out += struct.pack(order + "HH" + word, tag, kinds[letter], len(values)) + raw.ljust(wide, b"\0")
    return head + data + struct.pack(order + ("Q" if big else "H"), len(tags)) + out + struct.pack(order + word, 0) + more


@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("order", "<>")
def test_samples_of_other_sizes(order, big):
    r = np.random.default_rng(3)
    for kind, predictor in (("u2", 1), ("u2", 2), ("u4", 2), ("f4", 1), ("f4", 2), ("f4", 3), ("f8", 3), ("f2", 3)):
        image = r.integers(0, 60000, (5, 7, 2)).astype(kind) if kind[0] == "u" else r.normal(size=(5, 7, 2)).astype(kind)
        size, whole = image.dtype.itemsize, image.view(f"u{image.dtype.itemsize}")
        if predictor == 2:
            whole = np.concatenate([whole[:, :1], whole[:, 1:] - whole[:, :-1]], axis=1)
        raw = whole.astype(f"{order}u{size}").tobytes()
        if predictor == 3:
            planes = image.astype(f">{kind}").view(np.uint8).reshape(5, 14, size).transpose(0, 2, 1).reshape(5, size * 7, 2)
            raw = np.concatenate([planes[:, :1], planes[:, 1:] - planes[:, :-1]], axis=1).astype(np.uint8).tobytes()
        raw = zlib.compress(raw)
        tags = [(256, "H", [7]), (257, "H", [5]), (258, "H", [8 * size] * 2), (259, "H", [8]), (273, "I", [0]), (277, "H", [2]), (279, "I", [len(raw)]), (317, "H", [predictor]), (339, "H", [3 if kind[0] == "f" else 1] * 2)]
        [page] = tiff.read_tiff(_file(tags, raw, order, big))
        assert page.dtype.kind == kind[0] and (page == image).all(), (kind, predictor)
    for bits in (1, 2, 4):
        image = r.integers(0, 1 << bits, (5, 9, 1)).astype(np.uint8)
        raw = b"".join(np.packbits(np.unpackbits(row.reshape(-1, 1), axis=1)[:, 8 - bits :].ravel()).tobytes() for row in image)
        tags = [(256, "H", [9]), (257, "H", [5]), (258, "H", [bits]), (259, "H", [1]), (273, "I", [0]), (279, "I", [len(raw)])]
        [page] = tiff.read_tiff(_file(tags, raw, order, big))
        assert (page == image).all()


def test_claims_beyond_the_data_are_errors(spark):
    good = [(256, "I", [64]), (257, "I", [2]), (258, "H", [8]), (259, "H", [1]), (273, "I", [0]), (279, "I", [128])]
    other = lambda **new: [(t, k, new.get(f"t{t}", v)) for t, k, v in good]
    files = [
        _file(other(t256=[4_000_000], t257=[4_000_000]), bytes(128)),
        _file(other(t256=[4_000_000], t257=[4_000_000], t259=[8]), zlib.compress(bytes(10**6))),
        _file([*good, (278, "I", [1])], bytes(128)),  # one strip of two
        _file(other(t279=[64]), bytes(128)),
        _file(other(t256=[0]), bytes(128)),
        _file([*good, (317, "H", [9])], bytes(128)),
        _file(good[:-2], bytes(128)),
        b"II*\0\xff\xff\xff\x7f",
        _file(good, bytes(128))[:-40],
    ]
    rows = [(k, f) for k, f in enumerate([_file(good, bytes(range(128))), *files])]
    got = {r["doc_id"]: r for r in tiff.media_pages(spark.createDataFrame(rows, "doc_id long, media binary").withColumn("n_bytes", F.lit(0).cast("long"))).collect()}
    assert got[0]["error"] is None and bytes(got[0]["pixels"]) == bytes(range(128))
    assert len(got) == len(rows) and all(got[k]["error"] for k in range(1, len(rows)))


def test_deflate_bombs_stop_at_the_strip():
    raw = zlib.compress(bytes(200_000_000), 9)
    tags = [(256, "I", [64]), (257, "I", [2]), (258, "H", [8]), (259, "H", [8]), (273, "I", [0]), (279, "I", [len(raw)])]
    assert len(tiff._decode(raw, tiff.DEFLATE, 128)) == 128
    [page] = tiff.read_tiff(_file(tags, raw))
    assert page.shape == (2, 64, 1)


def test_pipeline(spark, small):
    from sigspark.llm import pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    n = docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == list(pipeline.COLUMNS), name
        docs = docs.cache()
    left = docs.count()
    out = pipeline.STAGES[-1][1](spark, docs, small)
    assert 0.5 * n < left < n and out.count() == left


def test_language_model_copies_train_on_every_position(monkeypatch):
    texts = [" ".join(f"w{(3 * k + i) % 17}" for i in range(5 * k)) for k in range(40)]
    held = [k % 5 == 0 for k in range(40)]
    heavy = np.unique(np.concatenate([lm.chunk_words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0] for t in texts if t]))
    net = lm.LogBilinear(lm.Groups.of(np.ones(len(heavy) + 1 + lm.CLASSES)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(texts), pa.array(held)], ["doc_id", "text", "held_out"])
    seen = []
    train = lm.LogBilinear.train
    monkeypatch.setattr(lm.LogBilinear, "train", lambda self, u, v, w, *rest: (seen.append(len(w)), train(self, u, v, w, *rest)))
    sent = type("Sent", (), {"value": (heavy, net, lm.STRIDE, 1)})
    list(lm._emit_counts(sent, 8, iter([batch])))
    assert sum(seen) == sum(5 * k + 1 for k in range(40) if not held[k])


def test_repeated_contexts_are_scored_once(monkeypatch):
    rng = np.random.default_rng(9)
    counts = rng.integers(1, 400, 120)
    model = lm.LogBilinear(lm.Groups.of(counts)).ready()
    some = rng.integers(0, 120, (3, 40))
    two, one, symbol = some[:, rng.integers(0, 40, 5000)]
    groups, place = model.groups, model.groups.place
    hat, w = model.near[place[one]] + model.far[place[two]], place[symbol]
    log_sum = lambda x: np.log(np.exp(x).sum(axis=1))
    want = (hat * model.of_groups[groups.group[w]]).sum(axis=1) - log_sum(hat @ model.of_groups.T)
    for i, k in enumerate(w):
        a, b = groups.start[groups.group[k]], groups.start[groups.group[k] + 1]
        if b - a > 1:
            want[i] += hat[i] @ model.of_places[k] - log_sum(hat[i : i + 1] @ model.of_places[a:b].T)[0]
    seen, plain = [], lm._log_sum
    monkeypatch.setattr(lm, "_log_sum", lambda score: seen.append(len(score)) or plain(score))
    assert np.allclose(model.log10(two, one, symbol), want / np.log(10), rtol=0, atol=1e-12) and sum(seen) <= 80


def test_noise_drawn_by_a_table_is_that_of_a_search():
    rng = np.random.default_rng(4)
    for share in (rng.dirichlet(np.full(5000, 0.1)), np.array([0.5, 0.0, 0.0, 0.5]), np.ones(1), np.append(1 - 1e-9, np.full(3000, 1e-9 / 3000))):
        ends = np.cumsum(share)
        x = np.concatenate([rng.random(20_000) * ends[-1], ends, [0.0], np.nextafter(ends, 0)])
        x = x[: len(x) // 3 * 3].reshape(-1, 3)
        assert np.array_equal(lm.Draws(ends)(x), np.searchsorted(ends, x, "right"))
