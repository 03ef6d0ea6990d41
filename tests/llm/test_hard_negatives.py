"""Hard negatives against brute force on odd tables, and the query against its SQL."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest

from tidewell.llm import hard_negatives as h
from tidewell.llm import queries as q


def brute(rows, step):
    rows, out = sorted({(i, str(c), tuple(v)) for i, c, v in rows}), []
    dim = max((len(v) for *_, v in rows), default=0)
    rows = [(i, c, (*v, *[0] * (dim - len(v)))) for i, c, v in rows]
    for i, c, v in rows:
        if i % step:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), j, d) for j, d, w in rows if j != i]
        for p, j, _ in sorted(x for x in scored if x[2] == c)[:5]:
            fit = sorted(x for x in scored if x[2] != c and 30 * -p <= 100 * -x[0] <= 90 * -p)[:10]
            out += [(i, j, n + 1, k, -p, -s) for n, (s, k, _) in enumerate(fit)]
    return sorted(out)


def planted(seed: int, n: int, dim: int, top: int):
    r = random.Random(seed)
    rows = [(k, r.choice("aaabc"), [r.randint(-top, top) for _ in range(dim)]) for k in range(n)]
    hot = [r.randint(0, top) for _ in range(dim)]
    return [(k, c, hot if r.random() < 0.3 else v) for k, c, v in rows]


@pytest.mark.parametrize(("n", "dim", "top", "tree"), [(400, 6, 20, 64), (300, 1, 5, 4096), (150, 3, 10**9, 50), (40, 4, 3, 7)])
def test_equals_brute_force(spark, monkeypatch, n, dim, top, tree):
    monkeypatch.setattr(h, "TREE_ROWS", tree)
    monkeypatch.setattr(h, "BLOCK", 8)
    monkeypatch.setattr(h, "LEAF", 4)
    monkeypatch.setattr(h, "BLOCKS", 2)
    rows = planted(n, n, dim, top)
    rows += rows[:5]  # repeated rows count once
    df = spark.createDataFrame([(i, c, v, 1, "x") for i, c, v in rows], "id long, label string, vector array<long>, rank int, tree string").repartition(3)
    got = sorted(tuple(x) for x in h.hard_negatives(df, "id % 10 = 0").collect())
    assert got == brute(rows, 10) and got


def test_short_vectors_and_empty_tables(spark):
    rows = [(0, 1, [4, 4]), (1, 1, [4, 3, 9]), (2, 2, [2]), (3, 2, []), (4, 2, [1, 1, 1])]
    df = spark.createDataFrame(rows, "id long, label int, vector array<int>")
    assert sorted(tuple(x) for x in h.hard_negatives(df).collect()) == brute(rows, 100)
    assert h.hard_negatives(df.limit(0)).count() == 0
    assert h.hard_negatives(df.where("id > 0")).count() == 0  # no anchors


def test_bounds_hold_all_products():
    rng = np.random.default_rng(1)
    points = rng.integers(-50, 50, (300, 5))
    tree = h.Tree(np.arange(300), np.array(["x", "y"] * 150), points)
    anchor = rng.integers(-50, 50, 5)
    low, high = (x[0] for x in tree.bounds(anchor[None, :]))
    for k, (first, last) in enumerate(tree.children):
        if first < 0:
            scores = tree.points[tree.rows[last] : tree.rows[last + 1]] @ anchor
            assert low[k] <= scores.min() and scores.max() <= high[k]
        else:
            assert low[k] <= low[first:last].min() and high[first:last].max() <= high[k]
    assert sorted(tree.ids.tolist()) == list(range(300))


def test_query_equals_sql_with_odd_vectors(spark, tmp_path):
    r = random.Random(2)
    rows = [(k, [r.uniform(-1, 1) for _ in range(8)], r.randint(0, 9)) for k in range(700)]
    rows += [(700, None, 1), (701, [None] * 8, 2), (800, [float("nan")] * 8, 3), (801, [float("inf")] * 8, 3), (900, [0.5] * 8, None), (None, [0.5] * 8, 3), (1000, [0.0] * 8, 4), (1001, rows[0][1], 5)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    df = q.op13_hard_negatives(spark, str(tmp_path))
    want = con.sql(q.ORACLE_SQL["op13_hard_negatives"])
    assert want.columns == df.columns
    assert sorted(tuple(x) for x in df.collect()) == sorted(want.fetchall())
