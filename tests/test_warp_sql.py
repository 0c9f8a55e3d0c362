"""Run-capped warping distances against a row-wise recursion in SQL, on a few short traces."""

import duckdb
import numpy as np
import pytest

from sigspark.functions import kernels as K


def _capped_sql(open_begin: bool = False, open_end: bool = False, weight: int = 1, runs: int = 3) -> str:
    """Row-wise recursion: the state holds a list of (cost, length, begin) for each column and run state."""
    inf = "1e300"
    n = 2 * runs + 1
    cell = f"{{'c': {inf}, 'n': 0, 'j': 0}}"
    c = "abs(u[i + 1] - v[{j}])"

    def best(parts: str) -> str:
        # the first of least cost: sort by cost, then by state
        return f"list_sort(list_transform({parts}, lambda s, k: {{'c': s.c, 'k': k, 'n': s.n, 'j': s.j}}))[1]"

    def step(source: str, cost: str) -> str:
        return f"CASE WHEN ({source}).c >= {inf} THEN {cell} ELSE {{'c': ({source}).c + {cost}, 'n': ({source}).n + 1, 'j': ({source}).j}} END"

    # rows: list over columns of the states 0..runs (diagonal and vertical); then the horizontal ones by shifts
    verticals = ", ".join(step(f"rows[j][{k}]", c.format(j="j")) for k in range(2, runs + 1))
    others = "list_concat([rows[j][1]], rows[j][%d:%d])" % (runs + 2, n)
    diag = f"CASE WHEN j = 1 THEN {cell} ELSE {step(best('rows[j - 1]'), f'{weight} * ' + c.format(j='j'))} END"
    base = f"list_transform(range(1, len(v) + 1), lambda j: [{diag}, {step(best(others), c.format(j='j'))}{', ' + verticals if verticals else ''}])"
    start = f"CASE WHEN {'true' if open_begin else 'j = 1'} THEN {{'c': {weight} * {c.format(j='j').replace('i + 1', '1')}, 'n': 1, 'j': j - 1}} ELSE {cell} END"
    first = f"list_transform(range(1, len(v) + 1), lambda j: list_concat([{start}], list_transform(range({runs}), lambda k: {cell})))"

    def horizontal(rows: str, row: str, allowed: bool) -> str:
        out = rows
        for k in range(1, runs + 1):
            if not allowed:
                out = f"list_transform({out}, lambda x: list_append(x, {cell}))"
                continue
            source = best(f"h[j - 1][1:{runs + 1}]") if k == 1 else f"h[j - 1][{runs + k}]"
            cost = f"abs(u[{row}] - v[j])"
            out = f"(SELECT list_transform(range(1, len(h) + 1), lambda j: list_append(h[j], CASE WHEN j = 1 THEN {cell} ELSE {step(source, cost)} END)) FROM (SELECT {out} AS h))"
        return out

    final = f"list_transform(rows, lambda x: {best('x')})"
    pick = "f[len(f)]" if not open_end else "list_sort(list_transform(f, lambda s, k: {'c': s.c, 'e': k - 1, 'n': s.n, 'j': s.j}))[1]"
    end = "len(v) - 1" if not open_end else "x.e"
    norm = "x.c / x.n" if weight == 1 else f"x.c / (len(u) + {end} - x.j + 1)"
    return (
        f"WITH RECURSIVE @PAIRS@, r AS (SELECT a, b, u, v, 0 AS i, {horizontal(first, '1', not open_begin)} AS rows FROM q "
        f"UNION ALL SELECT a, b, u, v, i + 1, {horizontal(base.replace('i + 1', 'i + 2'), 'i + 2', True)} FROM r WHERE i + 1 < len(u)), "
        f"z AS (SELECT a, b, u, v, {final} AS f FROM r WHERE i = len(u) - 1), w AS (SELECT a, b, u, v, {pick} AS x FROM z) "
        f"SELECT a, b, round(x.c, 6) AS dist, round({norm}, 6) AS norm_dist FROM w"
    )


@pytest.mark.parametrize("options,sql", [({}, {}), ({"open_begin": True, "open_end": True}, {"open_begin": True, "open_end": True}), ({"step": "symmetric2"}, {"weight": 2})])
def test_capped_equals_sql(options, sql):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(12, 16))
    con = duckdb.connect()
    con.execute("CREATE TABLE g (k BIGINT, m DOUBLE[])")
    con.executemany("INSERT INTO g VALUES (?, ?)", [(i, v.tolist()) for i, v in enumerate(x)])
    pairs = "q AS (SELECT x.k AS a, y.k AS b, x.m AS u, y.m AS v FROM g x JOIN g y ON x.k < y.k)"
    text = _capped_sql(**sql).replace("@PAIRS@", pairs)
    for a, b, dist, norm in con.execute(text).fetchall():
        w = K.Warp(np.abs(x[a][:, None] - x[b][None, :])[None], max_run=3, **options)
        assert w.dist[0] == pytest.approx(dist, abs=1e-6) and w.norm[0] == pytest.approx(norm, abs=1e-6)
