"""N-gram Jaccard self-join of documents by token-combination prefixes (operator 1).

A document is the set of its distinct word shingles. Documents of one set form a *node*; only nodes are compared.
All nodes order their tokens alike, rare ones first. Tokens of the rare class count one by one; tokens of the
frequent class are dealt to sub-classes, of which two shared tokens are needed. The prefix of a node is extended until
the tokens beyond what the classes may share unnoticed reach n - ceil(t*n) + 1: two nodes of similarity t or more then
share a single rare token or a pair of frequent tokens of one sub-class. These are the signatures. Nodes of one
signature are candidates. The tokens that two nodes share among their single signatures are counted, too: with c of them and p
tokens given singly, no more than c + max(n - p) tokens can be common, so pairs below the needed overlap go before any set is read. All
others are verified on their whole sets. A signature travels as 13 bytes whatever the number of parts: four of the signature, the
node and the step of its size; sizes themselves are joined to the counted pairs.

No list of all pairs is made. Signatures first part the nodes into clusters without candidates across. A cluster of
bounded size is solved in one task that holds its sets: a node is counted against all nodes that are not yet in its component, at
once, over the cluster's tokens. Larger clusters are solved in rounds over the whole cluster: the nodes of a signature are
verified against one pivot, links are contracted to components, and only signatures that still span several components
stay, until the pairs across components are few enough to verify all of them. Either way a pair is verified or already
inside one component, and components are exact. Each round takes twice the pivots of the one before, and a node that was
a pivot leaves the signature's group, since all its pairs there are known.

Document counts of tokens are lossy counts: each run of documents (FLUSH_TOKENS) sums its own and drops what occurs once in
it, so a token's count is short by the number of runs at most, and a token of all documents costs one entry a run. They
set the common order of tokens, nothing else.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from ._shared import Stage, free_shuffles, parts_for, texts, total_bytes

#: Most tokens of the frequent class, whose table every executor holds: 12 bytes each.
FREQUENT_TOKENS = 400_000
#: Least count that makes a token frequent.
FREQUENT_DF = 4
#: Tokens whose repetitions are counted at once.
FLUSH_TOKENS = 4_000_000
#: Most nodes whose ids are sent to all executors; beyond it a join selects them.
BROADCAST_NODES = 2_000_000
#: Most tokens of a cluster that one task solves: 8 bytes each.
CLUSTER_TOKENS = 4_000_000
#: Largest group of a single token whose pairs are counted; of larger ones the nodes stay together uncounted.
PAIRED = 32
#: Steps of set size to an octave.
STEPS = 12
_SMALL, _SMALL_TOO = 8, 12  # sets under the first use single tokens only; up to the second, these too
_FOUR_THIRDS = np.log(4 / 3)


def _need(n: np.ndarray, percent: int) -> np.ndarray:
    """Length of the plain prefix: n - ceil(t*n) + 1."""
    return n - (-(-n * percent // 100)) + 1


def _chunk_sets(data, offs, width):
    """Per chunk: (document, token) pairs in order, set sizes and set digests."""
    words, first = T.word_hashes(data, offs)
    doc, token = T.unique_pairs(*T.shingles(words, first, width))
    rows = len(offs) - 1
    sizes = np.bincount(doc, minlength=rows)
    ends = np.cumsum(sizes)
    total = np.zeros(len(token) + 1, np.uint64)
    np.cumsum(T.mix(token ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=total[1:])
    digest = T.mix(total[ends] - total[ends - sizes] + sizes.astype(np.uint64)).view(np.int64)
    return doc, token, sizes, digest


def _split_parts(key: np.ndarray, bits: int) -> np.ndarray:
    """Where each of the 2**bits parts begins in the sorted keys."""
    return np.searchsorted(key >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))


def size_steps(n: np.ndarray) -> np.ndarray:
    """The size on a logarithmic scale, in one byte; the largest share the last step."""
    return np.minimum(np.log2(np.maximum(n, 1)) * STEPS, 255).astype(np.uint8)


def frequent_tokens(docs: DataFrame, volume: int, width: int, limit: int = FREQUENT_TOKENS) -> tuple[np.ndarray, np.ndarray, int]:
    """(sorted token prefixes of bits+32 bits as uint64, counts, bits) of the most frequent tokens, `limit` at most.

    Lossy counts over all documents (copies within a run count once). They only set the common order of tokens: a mistaken
    count would cost time, never a link.
    """
    parts = parts_for(volume / 6, 4_000_000)
    bits = parts.bit_length() - 1
    shift = np.uint64(32 - bits)

    def emit(batches):
        held, seen, n = [], np.zeros(0, np.int64), 0

        def flush():
            key, times = np.unique(np.concatenate(held), return_counts=True)
            key, times = key[times > 1], times[times > 1].astype(np.uint32)
            at = _split_parts(key, bits)
            low = ((key >> shift) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            rows = [p for p in range(parts) if at[p] < at[p + 1]]
            blobs = [[x[at[p] : at[p + 1]].tobytes() for p in rows] for x in (low, times)]
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)], ["part", "tokens", "times"])

        for batch in batches:
            for _, _, data, offs in T.chunks(batch.column(1)):
                doc, token, sizes, digest = _chunk_sets(data, offs, width)
                fresh, once = np.unique(digest, return_index=True)
                keep = np.zeros(len(sizes), bool)
                keep[once[~np.isin(fresh, seen)]] = True
                seen = np.union1d(seen, fresh)
                held.append(token[keep[doc]])
                n += len(held[-1])
                if n > FLUSH_TOKENS:
                    yield flush()
                    held, seen, n = [], seen[:0], 0
                    T.trim()
        if n:
            yield flush()

    def count(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        tokens, times = (np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column(c)]) for c in ("tokens", "times"))
        token, inverse = np.unique(tokens, return_inverse=True)
        df = np.bincount(inverse, times, len(token)).astype(np.int64)
        often = df >= FREQUENT_DF
        token = (np.uint64(part) << np.uint64(32)) | token[often].astype(np.uint64)
        return pa.table({"token": pa.array(token.view(np.int64)), "df": pa.array(df[often])})

    counted = docs.mapInArrow(emit, "part int, tokens binary, times binary").repartitionById(parts, F.col("part")).groupBy("part").applyInArrow(count, "token long, df long")
    rows = counted.orderBy(F.desc("df"), "token").limit(limit).toPandas()
    token = rows["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], rows["df"].to_numpy(np.int64)[order], bits


def _signatures(doc, token, sizes, df, percent):
    """(document, signature) singly and in pairs, and the number of leading tokens of each document given singly.

    The tokens of a chunk carry their document counts, 0 for the rare class.
    """
    order = np.lexsort((token, df, doc))
    doc, token, df = doc[order], token[order], df[order]
    first = np.concatenate([[0], np.cumsum(sizes)])
    rank = np.arange(len(doc)) - first[doc]
    need = _need(sizes, percent)
    rare = np.bincount(doc[df == 0], minlength=len(sizes))
    out = []
    # singles: the rare tokens of the prefix; for small sets, whatever their class
    single = (rank < need[doc]) & ((df == 0) | (sizes[doc] <= _SMALL_TOO))
    singles = doc[single], T.mix(token[single] + np.uint64(1))
    leading = np.where(sizes <= _SMALL_TOO, np.minimum(need, sizes), np.minimum(need, rare))
    # pairs: of sets that need more than their rare tokens
    more = np.flatnonzero((need > rare) & (sizes >= _SMALL))
    for d in more:
        tail = token[first[d] + rare[d] : first[d + 1]]
        lack = int(need[d] - rare[d])
        g = int(np.log(sizes[d]) / _FOUR_THIRDS)
        for step in (g, g + 1):
            classes = 1 << max(0, int(np.log2(max(1.0, (4 / 3) ** step / 32))))
            sub = (T.mix(tail) % np.uint64(classes)).astype(np.int64)
            # a token counts unless it is the first of its sub-class in the prefix
            fresh = np.ones(len(tail), bool)
            fresh[np.unique(sub, return_index=True)[1]] = False
            reach = int(np.searchsorted(np.cumsum(fresh), lack)) + 1
            if reach > len(tail):
                # too few tokens for pairs in this dealing: all of them, and singly too; cannot occur for whole sets over _SMALL
                reach = len(tail)
            prefix, sub = tail[:reach], sub[:reach]
            by = np.argsort(sub, kind="stable")
            prefix, sub = np.sort(prefix)[np.argsort(sub[np.argsort(prefix)], kind="stable")], sub[by]
            edge = np.flatnonzero(np.concatenate([[True], sub[1:] != sub[:-1], [True]]))
            salt = np.uint64(1_000_003 * step + 7)
            made = []
            for a, b in zip(edge[:-1], edge[1:]):
                if b - a > 1:
                    i, j = np.triu_indices(b - a, 1)
                    made.append(T.mix(prefix[a + i] * np.uint64(3) + T.mix(prefix[a + j] + salt)))
            if made:
                made = np.concatenate(made)
                out.append((np.full(len(made), d), made))
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    pairs = tuple(np.concatenate([x[k] for x in out]) for k in (0, 1)) if out else none
    return singles, pairs, leading


def _emit_signatures(frequent, width, percent, parts, batches):
    """(part, blob): the signatures of a run of documents for one part, singly or in pairs, and from part 2 * parts on, documents with
    their nodes."""
    known, counts, known_bits = frequent.value
    bits = parts.bit_length() - 1
    context = TaskContext.get()
    facts_part = 2 * parts + (context.partitionId() if context else 0) % _fact_parts(parts)
    schema = pa.schema([("part", pa.int32()), ("blob", pa.binary())])
    held, facts, n = ([], []), [], 0

    def flush():
        rows, blobs = [facts_part], [np.concatenate(facts, axis=1).tobytes()]
        for kind in (0, 1):
            if not held[kind]:
                continue
            sig, node, step = (np.concatenate([x[k] for x in held[kind]]) for k in range(3))
            order = np.lexsort((node, sig))
            sig, node = sig[order], node[order]
            keep = np.ones(len(sig), bool)
            keep[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
            sig, node, step = sig[keep], node[keep], step[order][keep]
            at = _split_parts(sig, bits)
            low = ((sig >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            for p in range(parts):
                a, b = at[p], at[p + 1]
                if a < b:
                    blobs.append(low[a:b].tobytes() + node[a:b].tobytes() + step[a:b].tobytes())
                    rows.append(p + kind * parts)
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(blobs, pa.binary())], schema=schema)

    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b, data, offs in T.chunks(batch.column(1)):
            doc, token, sizes, digest = _chunk_sets(data, offs, width)
            _, once = np.unique(digest, return_index=True)
            keep = np.zeros(len(sizes), bool)
            keep[once] = True
            keep &= sizes > 0
            doc, token = doc[keep[doc]], token[keep[doc]]
            df = np.zeros(len(token), np.int64)
            if len(known):
                short = token >> np.uint64(32 - known_bits)
                i = np.minimum(np.searchsorted(known, short), len(known) - 1)
                df = np.where(known[i] == short, counts[i], 0)
            *both, lead = _signatures(doc, token, np.where(keep, sizes, 0), df, percent)
            facts.append(np.array([ids[a:b], sizes, digest, lead], np.int64))
            step = size_steps(sizes)
            for kind, (sdoc, sig) in enumerate(both):
                if len(sig):
                    held[kind].append((sig, digest[sdoc], step[sdoc]))
                    n += len(sig)
            if n > 1_000_000:
                yield flush()
                held, facts, n = ([], []), [], 0
                T.trim()
    if facts:
        yield flush()


def _fact_parts(parts: int) -> int:
    return max(1, parts // 16)


def _read_blob(buffer) -> tuple[np.ndarray, ...]:
    """(signature, node, size step) of each entry."""
    raw = np.frombuffer(buffer, np.uint8)
    n = len(raw) // 13
    return raw[: 4 * n].view(np.uint32), raw[4 * n : 12 * n].copy().view(np.int64), raw[12 * n :]


_TOLD = "kind byte, a long, b long, n long, lead long"
_DOCUMENT, _PAIR, _GROUP = 0, 1, 2


def _told(kind: int, *columns: np.ndarray) -> pa.Table:
    n = len(columns[0])
    rest = [pa.nulls(n, pa.int64())] * (4 - len(columns))
    return pa.table([pa.array(np.full(n, kind, np.int8)), *(pa.array(c) for c in columns), *rest], names=["kind", "a", "b", "n", "lead"])


def _candidates(percent: int, parts: int, table: pa.Table) -> pa.Table:
    """What a part tells: documents (doc_id, node, n, lead), counted pairs (a, b, shared) and groups (group, node).

    A group is parted where the sizes of its nodes leave a gap that no link can cross. Small groups of single tokens give
    their pairs; the others stay groups, one of each set of nodes.
    """
    part = table.column("part")[0].as_py()
    if part >= 2 * parts:
        doc_id, n, node, lead = np.concatenate([np.frombuffer(x.as_buffer(), np.int64).reshape(4, -1) for x in table.column("blob")], axis=1)
        return _told(_DOCUMENT, doc_id, node, n, lead)
    single = part < parts
    widest = int(np.ceil(np.log2(100 / percent) * STEPS))
    read = [_read_blob(x.as_buffer()) for x in table.column("blob")]
    sig, node, step = (np.concatenate([x[k] for x in read]) for k in range(3))
    del read
    order = np.lexsort((node, step, sig))
    sig, node, step = sig[order], node[order], step[order].astype(np.int16)
    keep = np.ones(len(sig), bool)
    keep[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
    sig, node, step = sig[keep], node[keep], step[keep]
    begin = np.flatnonzero(np.concatenate([[True], (sig[1:] != sig[:-1]) | (step[1:] - step[:-1] > widest)]))
    length = np.diff(np.append(begin, len(sig)))
    none = np.zeros(0, np.int64)
    found = [(none, none)]
    if single:
        for m in range(2, PAIRED + 1):
            at = begin[length == m]
            if not len(at):
                continue
            i, j = np.triu_indices(m, 1)
            x, y = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            near = step[y] - step[x] <= widest
            x, y = node[x[near]], node[y[near]]
            found.append((np.minimum(x, y), np.maximum(x, y)))
    a, b = (np.concatenate([f[k] for f in found]) for k in range(2))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else none
    shared = np.diff(np.append(new, len(a)))
    several = length > (PAIRED if single else 1)
    node, length = node[np.repeat(several, length)], length[several]
    begin = np.cumsum(length) - length
    mixed = np.zeros(len(node) + 1, np.uint64)
    np.cumsum(T.mix(node.view(np.uint64)), out=mixed[1:])
    group = T.mix(mixed[begin + length] - mixed[begin] + length.astype(np.uint64)).view(np.int64)
    _, once = np.unique(group, return_index=True)
    pick = np.zeros(len(group), bool)
    pick[once] = True
    member = np.repeat(pick, length)
    out = pa.concat_tables([_told(_PAIR, a[new], b[new], shared), _told(_GROUP, np.repeat(group, length)[member], node[member])])
    T.trim()
    return out


def _emit_sets(wanted, width, batches):
    """(node, tokens) of the documents with wanted ids."""
    schema = pa.schema([("node", pa.int64()), ("tokens", pa.binary())])
    for batch in batches:
        if wanted is not None:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            known = wanted.value
            i = np.minimum(np.searchsorted(known, ids), max(len(known) - 1, 0))
            batch = batch.filter(pa.array(known[i] == ids if len(known) else np.zeros(len(ids), bool)))
        for a, b, data, offs in T.chunks(batch.column(1)):
            _, token, sizes, digest = _chunk_sets(data, offs, width)
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([pa.array(digest), pa.array([token[e - s : e].tobytes() for e, s in zip(ends, sizes)], pa.binary())], schema=schema)


def _linked(percent, batches):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])
    for batch in batches:
        out = np.zeros(batch.num_rows, bool)
        for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                continue
            if len(x) > len(y):
                x, y = y, x
            i = np.searchsorted(y, x)
            i[i == len(y)] = 0
            both = int(np.count_nonzero(y[i] == x))
            out[k] = 100 * both >= percent * (len(x) + len(y) - both)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], schema=schema)


def solve_cluster(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The least index of the component of each set."""
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    comp = np.arange(n)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(size) - size
    mark = np.zeros(int(token.max()) + 1, np.int32)
    for x in np.argsort(size, kind="stable"):
        open_ = (comp != comp[x]) & (size >= size[x]) & (100 * size[x] >= percent * size)
        if not open_.any():
            continue
        own = token[begin[x] : begin[x] + size[x]]
        mark[own] = 1
        others = np.flatnonzero(open_)
        if 2 * size[others].sum() < len(token):
            both = np.array([mark[token[begin[y] : begin[y] + size[y]]].sum() for y in others])
        else:
            both = np.add.reduceat(mark[token], begin)[others]
        mark[own] = 0
        for y in others[100 * both >= percent * (size[x] + size[others] - both)]:
            a, b = comp[x], comp[y]
            if a != b:
                comp[comp == max(a, b)] = min(a, b)
    return comp


def _solve(percent: int, table: pa.Table) -> pa.Table:
    """(node, label) of the clusters of one bin."""
    cluster, node = (table.column(c).to_numpy() for c in ("cluster", "node"))
    tokens = table.column("tokens").combine_chunks()
    order = np.lexsort((node, cluster))
    edge = np.flatnonzero(np.concatenate([[True], cluster[order][1:] != cluster[order][:-1], [True]]))
    label = np.empty(len(node), np.int64)
    for a, b in zip(edge[:-1], edge[1:]):
        rows = order[a:b]
        rows = rows[np.concatenate([[True], node[rows][1:] != node[rows][:-1]])]
        sets = [np.frombuffer(tokens[int(i)].as_buffer(), np.uint64) for i in rows]
        own = node[rows][solve_cluster(sets, percent)] if len(sets) > 1 else node[rows]
        label[order[a:b]] = own[np.searchsorted(node[rows], node[order[a:b]])]
    T.trim()
    return pa.table({"node": node, "label": label})


def components(stage: Stage, edges: DataFrame, key: str) -> DataFrame:
    """(node, label) of all nodes of the edges (a, b): label is the least node of the component.

    Least labels of neighbours, then a jump to the label's label, until nothing changes; every round is a written table.
    """
    both = stage.put(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), f"{key}-edges")
    label = stage.put(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), f"{key}-label")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = label.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = label.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = low.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("next", "label")).alias("label"))
        new = stage.put(new, f"{key}-next")
        moved = new.where("label <> was").limit(1).count()
        label = stage.put(new.select("node", "label"), f"{key}-label")
        if not moved:
            stage.drop(f"{key}-edges", f"{key}-next")
            return label


def jaccard_components(spark: SparkSession, docs: DataFrame, percent: int = 75, width: int = 5, cluster_tokens: int = CLUSTER_TOKENS) -> DataFrame:
    """One row per document: doc_id, n_shingles, node, component_id.

    Two documents link when 100 * |A and B| >= percent * |A or B| over their shingle sets; component_id is the least
    doc_id reachable by links. A null, empty or blank text has no shingles, no node and links with nothing; a text under
    `width` words is one shingle. Repeated rows give repeated rows; rows without an id are left out; an empty table gives
    an empty result.

    Size steps of pair signatures fit a percent of 75 or more; below that links would be lost, so it is an error.
    """
    if not 75 <= percent <= 100:
        raise ValueError(f"percent {percent} is not from 75 to 100")
    docs = texts(docs)
    _, volume = total_bytes(docs)
    stage = Stage(spark, "jaccard")
    known, counts, known_bits = frequent_tokens(docs, volume, width)
    frequent = spark.sparkContext.broadcast((known, counts, known_bits))
    free_shuffles(spark)
    parts = parts_for(volume / 14, 500_000)
    emitted = docs.mapInArrow(lambda it: _emit_signatures(frequent, width, percent, parts, it), "part int, blob binary")
    # a task for each part, so that no two meet in one
    dealt = emitted.repartitionById(2 * parts + _fact_parts(parts), F.col("part")).groupBy("part")
    told = stage.put(dealt.applyInArrow(lambda t: _candidates(percent, parts, t), _TOLD), "told")
    free_shuffles(spark)
    sets = stage.put(told.where(F.col("kind") == _DOCUMENT).select(F.col("a").alias("doc_id"), "n", F.when(F.col("n") > 0, F.col("b")).alias("node"), "lead"), "sets")
    nodes = stage.put(sets.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("lead").alias("lead")), "nodes")
    pairs = told.where(F.col("kind") == _PAIR).groupBy("a", "b").agg(F.sum("n").alias("shared"))
    for side in "ab":
        own = nodes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), (F.col("n") - F.col("lead")).alias(f"slack_{side}"))
        pairs = pairs.join(own, side)
    total = F.col("n_a") + F.col("n_b")
    # a link needs an overlap of total * percent / (100 + percent), which no larger than the smaller set is
    enough = (F.least(F.col("shared") + F.greatest("slack_a", "slack_b"), "n_a", "n_b")) * (100 + percent) >= percent * total
    pairs = stage.put(pairs.where(enough).select("a", "b"), "pairs")
    groups = stage.put(told.where(F.col("kind") == _GROUP).select(F.col("a").alias("group"), F.col("b").alias("node")).distinct(), "groups")
    stage.drop("told")
    edges = groups.join(groups.groupBy("group").agg(F.min("node").alias("b")), "group").select(F.col("node").alias("a"), "b").union(pairs)
    member = components(stage, edges, "cluster").withColumnRenamed("label", "cluster").join(nodes.drop("lead"), "node")
    member = stage.put(member, "member")
    member = stage.put(member.join(member.groupBy("cluster").agg(F.sum("n").alias("tokens")), "cluster"), "member")
    facts = member.agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("tokens"), F.lit(0)).alias("most")).first()
    if facts["k"] <= BROADCAST_NODES:
        ids = np.sort(member.select("doc_id").toPandas()["doc_id"].to_numpy(np.int64))
        wanted = spark.sparkContext.broadcast(ids)
        chosen = docs
    else:
        wanted, chosen = None, docs.join(member.select("doc_id"), "doc_id", "left_semi")
    tokens = chosen.mapInArrow(lambda it: _emit_sets(wanted, width, it), "node long, tokens binary")
    bins = parts_for(facts["n"], 1_000_000, 32)
    small = member.where(F.col("tokens") <= cluster_tokens).select("node", "cluster", F.pmod(F.xxhash64("cluster"), F.lit(bins)).alias("bin"))
    label = stage.put(tokens.join(small, "node").groupBy("bin").applyInArrow(lambda t: _solve(percent, t), "node long, label long").where("node <> label").distinct(), "solved")
    if facts["most"] > cluster_tokens:
        big = member.where(F.col("tokens") > cluster_tokens).select("node")
        own = stage.put(tokens.join(big, "node"), "tokens")
        two = pairs.withColumn("group", F.xxhash64("a", "b"))
        two = two.select("group", F.col("a").alias("node")).union(two.select("group", F.col("b").alias("node")))
        sized = stage.put(groups.union(two).join(member.where(F.col("tokens") > cluster_tokens).select("node", "n"), "node").select("group", "node", "n"), "sized")
        label = label.union(_rounds(spark, stage, sized, own, percent))
    full = nodes.join(label, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))
    least = full.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = stage.put(full.join(least, "label").select("node", "component_id"), "named")
    stage.drop(*[k for k in stage.paths if k not in ("sets", "named")])
    out = sets.join(named, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "node", F.coalesce("component_id", "doc_id").alias("component_id"))


def _rounds(spark: SparkSession, stage: Stage, groups: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """(node, label) of the nodes in large clusters that have a link."""

    def verify(pairs: DataFrame, key: str) -> DataFrame:
        x = tokens.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
        y = tokens.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
        ready = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
        return stage.put(ready.mapInArrow(lambda it: _linked(percent, it), "a long, b long, linked boolean"), key)

    label = None  # (node, label) of nodes that have a link; others are their own
    done: list[str] = []
    round_ = 0
    while True:
        here = groups.withColumn("comp", F.col("node"))
        if label is not None:
            here = groups.join(label, "node", "left").select("group", "node", "n", F.coalesce("label", "node").alias("comp"))
        several = here.groupBy("group").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by("node", F.xxhash64("node", F.lit(round_))).alias("first"), F.count(F.lit(1)).alias("m"))
        open_ = stage.put(here.join(several.where("lo <> hi").select("group", "first", "m"), "group"), "open")
        per = open_.groupBy("group", "comp").agg(F.count(F.lit(1)).alias("k"))
        cost = per.groupBy("group").agg((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))).alias("c"), F.sum("k").alias("m"))
        total = cost.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.coalesce(F.sum("m"), F.lit(0)).alias("m")).first()
        if not total["m"]:
            break
        last = total["c"] <= 8 * total["m"]
        other = open_
        if not last:
            # the first and about 2**round others
            chosen = (F.col("node") == F.col("first")) | (F.pmod(F.xxhash64("node", F.lit(round_)), F.col("m")) < 1 << min(round_, 40))
            other = stage.put(open_.where(chosen).select("group", "node", "comp", "n"), "pivots")
            groups = stage.put(open_.join(other.select("group", "node"), ["group", "node"], "left_anti").select("group", "node", "n"), f"left{round_ % 2}")
        other = other.select("group", F.col("node").alias("node2"), F.col("comp").alias("comp2"), F.col("n").alias("n2"))
        pairs = open_.join(other, "group").where(("node < node2" if last else "node <> node2") + " AND comp <> comp2")
        pairs = pairs.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"), "n", "n2")
        pairs = pairs.where(100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")).select("a", "b").distinct()
        for key in done:
            pairs = pairs.join(spark.read.parquet(stage.paths[key]).select("a", "b"), ["a", "b"], "left_anti")
        checked = verify(pairs, f"checked{round_}")
        done.append(f"checked{round_}")
        links = checked.where("linked")
        if label is not None:
            la, lb = label.select(F.col("node").alias("a"), F.col("label").alias("la")), label.select(F.col("node").alias("b"), F.col("label").alias("lb"))
            links = links.join(la, "a", "left").join(lb, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
        fresh = components(stage, links.select("a", "b"), f"cc{round_}")
        if label is None:
            label = stage.put(fresh, "label0")
        else:
            moved = label.join(fresh.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
            new = fresh.join(label, "node", "left_anti")
            label = stage.put(moved.union(new), f"label{round_ % 2}")
        stage.drop(f"cc{round_}-label")
        round_ += 1
        if last:
            break
    return label if label is not None else groups.select("node", F.col("node").alias("label")).limit(0)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of documents at similarity 0.75 over 5-word shingles."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_components(spark, docs).select("doc_id", "n_shingles", "component_id")
