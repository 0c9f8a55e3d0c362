"""Secret scans by corpus-wide ownership frequency (operator 12).

One pass finds candidate credentials in every whole text: assignments to a key's name, access key ids, hexadecimal runs, and bare
tokens that look live. Their values are hashed (SHA-256), and each hash is counted over the corpus by the distinct repositories and
owners that hold it. A value that several owners hold is a copied example; one that looks live and has a single owner is that
owner's own credential; all others stay unclear. Bare tokens count as secrets only if they are an owner's own.

Candidates are few against the text, so only (row, place, hash) leave the first pass. A value that many rows hold is counted in
parts before it is shuffled, and its counts go back by a broadcast of at most HOT_VALUES such values; the others are joined.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ._shared import Stage

#: Kinds in the order in which spans of one start are listed; the last is the method's own.
KINDS = ("assign", "access", "hex", "owned")
#: Owners from which on a value is a widely copied example.
COPIED = 3
#: A value that more than one in so many candidates has is hot; there are fewer such values than this.
HOT_VALUES = 10_000

#: Names of keys, and words that mark a value as a placeholder.
KEYS = ("password", "passwd", "secret", "token", "api_?key")
PLACEHOLDERS = ("example", "sample", "dummy", "changeme", "placeholder", "password", "secret", "xxxx", "123456789", "0000000")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(map(_either, KEYS)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
BARE = "[A-Za-z0-9+/_=-]+"
#: Least length of what each kind is judged by.
LEAST = {"assign": 12, "access": 18, "hex": 16, "owned": 16}

_ASSIGN, _KEYS = re.compile(ASSIGN), tuple(k.split("_")[0] for k in KEYS)
_ACCESS, _HEX, _BARE = (re.compile(f"{p[:-1]}{{{n},}}") for p, n in ((ACCESS, LEAST["access"] - 4), (HEX, LEAST["hex"]), (BARE, LEAST["owned"])))


def looks_live(value: str) -> bool:
    """Whether a value could be a credential in use: 16 signs or more, at least ten different ones, with an ASCII letter and a digit, and
    no placeholder's word."""
    low = value.lower()
    return len(value) >= LEAST["owned"] and len(set(value)) >= 10 and re.search("[a-z]", low) is not None and re.search("[0-9]", low) is not None and not any(w in low for w in PLACEHOLDERS)


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(kind's index, start, end, value) of a text in code points: base matches, and bare live-looking tokens that overlap none."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        out += [(0, m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(1, m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text)]
    out += [(2, m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    taken = sorted((a, b) for _, a, b, _ in out)
    at, reach = 0, -1  # the end of what begins before a token's end
    for m in _BARE.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= m.start() and looks_live(m[0]):
            out.append((3, m.start(), m.end(), m[0]))
    return sorted(out, key=lambda c: (c[1], c[0]))


_FOUND = "row long, doc_id long, repo string, owner string, found array<struct<kind:int,start:long,end:long,live:boolean,hash:binary>>"


def _scan(batches):
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("live", pa.bool_()), ("hash", pa.binary())]))
    row = TaskContext.get().partitionId() << 36
    for batch in batches:
        found = []
        for text in batch.column(1):
            found.append([{"kind": k, "start": a, "end": b, "live": looks_live(v), "hash": hashlib.sha256(v.encode()).digest()} for k, a, b, v in candidates(text.as_py() or "")])
        rows = pa.array(range(row, row + len(found)), pa.int64())
        row += len(found)
        yield pa.RecordBatch.from_arrays([rows, batch.column(0), batch.column(2), batch.column(3), pa.array(found, span)], ["row", "doc_id", "repo", "owner", "found"])


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_rows, n_repos, n_owners) of each candidate value: rows, distinct repositories and distinct owners that hold it.

    A repository is known by its owner and its name.
    """
    each = found.select("repo", "owner", F.explode(F.array_distinct(F.transform("found", lambda c: c["hash"]))).alias("hash"))
    by_repo = each.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_rows"), F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def verdict(copied: int = COPIED) -> Column:
    """`copied` from that many owners on, `owned` for a live-looking value of a single owner, else `unclear`."""
    return F.when(F.col("n_owners") >= copied, "copied").when((F.col("n_owners") == 1) & F.col("live"), "owned").otherwise("unclear")


def find_secrets(spark: SparkSession, docs: DataFrame, repo: Column | str = "repo", owner: Column | str = "owner", copied: int = COPIED) -> DataFrame:
    """doc_id and spans of every row: an array of (start, kind, end, verdict, n_rows, n_repos, n_owners, hash) by start and kind, kind as
    an index of KINDS; base matches with any verdict, bare tokens only if they are `owned`.

    A null text is empty and has no spans; null repositories and owners count as ''. Repeated rows give repeated rows, and each counts in
    n_rows. Rows without an id are left out; other columns, whatever their names, are not read. Texts of any length are read
    whole. An empty table gives an empty result. Tables it writes stay until `release`.
    """
    stage = Stage(spark, "secrets")
    name = lambda c: F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), name(repo).alias("repo"), name(owner).alias("owner")).where("doc_id IS NOT NULL")
    found = stage.put(rows.mapInArrow(_scan, _FOUND), "found")
    values = stage.put(ownership(found.where("size(found) > 0")), "values")
    total = values.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    is_hot = F.col("n_rows") * HOT_VALUES > total  # fewer than HOT_VALUES values, so they may go to all tasks
    hot, cold = F.broadcast(values.where(is_hot & (F.col("n_rows") > 100))), values.where(~is_hot | (F.col("n_rows") <= 100))
    each = found.where("size(found) > 0").select("row", "doc_id", F.explode("found").alias("c")).select("row", "doc_id", "c.*")
    known = each.join(hot, "hash").unionByName(each.join(hot.select("hash"), "hash", "left_anti").join(cold, "hash"))
    span = F.struct("start", "kind", "end", verdict(copied).alias("verdict"), "n_rows", "n_repos", "n_owners", "hash")
    listed = known.select("row", "doc_id", span.alias("s")).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list("s")).alias("spans"))
    kept = listed.select("doc_id", F.filter("spans", lambda s: (s["kind"] < 3) | (s["verdict"] == "owned")).alias("spans"))
    return kept.unionByName(found.where("size(found) = 0").select("doc_id", F.array().cast(kept.schema["spans"].dataType).alias("spans")))


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and the number of spans of each verdict."""
    of = lambda field, value: F.size(F.filter("spans", lambda s: s[field] == value)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select(
        "doc_id",
        *(of("kind", k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(_text(base), 256).alias("base_sha256"),
        _text(F.col("spans")).alias("spans"),
        *(of("verdict", v).alias(f"n_{v}") for v in ("copied", "owned", "unclear")),
    )


def op12_ownership_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of documents; a source is an owner, and its documents of one language a repository."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(find_secrets(ship(spark), docs, repo="lang", owner="source"))


def _sql() -> str:
    kinds = [(k, p.replace("'", "''")) for k, p in enumerate((ASSIGN, ACCESS, HEX, BARE))]
    pieces = " UNION ALL ".join(f"SELECT r, {k} AS kind, string_split_regex(text, '{p}') AS p, regexp_extract_all(text, '{p}') AS m FROM t" for k, p in kinds)
    judged = f"CASE kind WHEN 0 THEN regexp_extract(m[i], '{kinds[0][1]}', 2) ELSE m[i] END"
    least = " OR ".join(f"(kind = {k} AND length(v) >= {n})" for k, n in enumerate(LEAST.values()))
    words = " AND ".join(f"NOT contains(lower(v), '{w}')" for w in PLACEHOLDERS)
    names = "['" + "', '".join(KINDS) + "'][kind + 1]"
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS repo, coalesce(source, '') AS owner
           FROM documents WHERE doc_id IS NOT NULL),
pieces AS ({pieces}),
each AS (SELECT r, kind, {judged} AS v, length(m[i]) AS n,
                list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS s
         FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM pieces)),
long_enough AS (SELECT r, kind, v, s::BIGINT AS s, (s + n)::BIGINT AS e,
                length(v) >= {LEAST["owned"]} AND len(list_distinct(string_split(v, ''))) >= 10 AND regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]') AND {words} AS live
         FROM each WHERE {least}),
found AS (SELECT * FROM long_enough AS x WHERE kind < 3 OR (live AND NOT EXISTS (SELECT 1 FROM long_enough AS y WHERE y.r = x.r AND y.kind < 3 AND y.s < x.e AND x.s < y.e))),
owners AS (SELECT v, count(DISTINCT owner) AS n_owners FROM found JOIN t USING (r) GROUP BY v),
judged AS (SELECT *, CASE WHEN n_owners >= {COPIED} THEN 'copied' WHEN n_owners = 1 AND live THEN 'owned' ELSE 'unclear' END AS verdict
           FROM found JOIN owners USING (v)),
listed AS (SELECT *, {names} || ':' || s || ':' || e AS span FROM judged WHERE kind < 3 OR verdict = 'owned')
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY s, kind) FILTER (kind < 3), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY s, kind), '') AS spans,
       count(*) FILTER (verdict = 'copied') AS n_copied, count(*) FILTER (verdict = 'owned') AS n_owned, count(*) FILTER (verdict = 'unclear') AS n_unclear
FROM t LEFT JOIN listed USING (r) GROUP BY r, doc_id"""


ORACLE_SQL = _sql()
