"""Ranks, running sums, quantiles and neighbour information in many tasks, against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import neighbours, ordered, screen


@pytest.mark.parametrize("q", [[0.0, 0.05, 0.5, 0.95, 1.0]])
def test_quantiles_and_ranks_equal_numpy(spark, q):
    rng = np.random.default_rng(3)
    data = {"wide": rng.normal(size=700) * 1e6, "ties": rng.integers(0, 4, 500).astype(float), "hot": np.where(rng.random(600) < 0.7, 0.0, rng.normal(size=600)), "one": np.array([7.5]), "two": np.array([1.0, 2.0])}
    rows = [(f, float(v)) for f, x in data.items() for v in x] + [("wide", None), ("none", None)]
    df = spark.createDataFrame(rows, "feature string, value double").repartition(4)
    got = {r.feature: r.edge for r in ordered.exact_quantiles(df, ["feature"], q).collect()}
    assert got["none"] is None
    for f, x in data.items():
        assert got[f] == pytest.approx(np.quantile(x, q).tolist())
    ranks = {(r.feature, r.value): (r["count"], r["rank"]) for r in ordered.average_ranks(df.where("value is not null"), ["feature"], "value").collect()}
    for f, x in data.items():
        for v in np.unique(x):
            assert ranks[f, v] == ((x == v).sum(), (x < v).sum() + ((x == v).sum() + 1) / 2)
    assert ordered.exact_quantiles(df.where("feature = 'two'"), [], [0.25]).first().edge == pytest.approx([1.25])


def ross(x: np.ndarray, y: np.ndarray, k: int = 3) -> float:
    """The estimator written out over all pairs."""
    psi = lambda n: -0.5772156649015329 + sum(1 / i for i in range(1, int(n)))
    keep = np.array([(y == c).sum() > 1 for c in y])
    x, y = x[keep], y[keep]
    gap, parts = np.abs(x[:, None] - x[None, :]), []
    for i in range(len(x)):
        size = int((y == y[i]).sum())
        near = np.sort(np.delete(gap[i], i)[np.delete(y, i) == y[i]])
        n = min(k, size - 1)
        r = near[n - 1]
        parts.append(psi(n) - psi(size) - psi((gap[i] < r).sum() if r > 0 else (gap[i] == 0).sum()))
    return max(0.0, psi(len(x)) + float(np.mean(parts)))


def test_neighbour_information_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(screen, "CHUNKS", 7)
    rng, rows, want = np.random.default_rng(8), [], {}
    y = rng.integers(0, 2, 150)
    y[:1] = 5  # a class of one row is left out
    y[1:3] = 6  # a class of two has one neighbour
    for f, x in {"tied": rng.integers(0, 6, 150).astype(float), "apart": y + rng.normal(size=150) * 0.2, "noise": rng.normal(size=150), "constant": np.ones(150)}.items():
        x = np.floor(x * 1024) / 1024
        rows += [(f, k, float(v), int(c)) for k, (v, c) in enumerate(zip(x, y, strict=True))]
        want[f] = ross(x, y)
    df = spark.createDataFrame(rows, "feature string, id long, value double, y int").repartition(3)
    got = {r.feature: r.mi for r in screen.neighbour_mi(df, ["feature"], ["id"]).collect()}
    assert got == pytest.approx(want, abs=1e-9) and want["apart"] > 0.3
    rounds = screen.mi_rounds(df, ["id"], rounds=3).collect()
    assert len(rounds) == 12 and {r["round"] for r in rounds} == {0, 1, 2}
    assert {r.feature for r in screen.mi_screen(df, ["id"], rounds=3, floor=1).collect()} <= {"apart", "tied"}
    assert screen.mi_screen(df, ["id"], rounds=2, floor=10).count() == 4  # the first round would leave too few


def test_rounds_in_chunks_equal_all_pairs(spark, monkeypatch):
    """Noise drawn in the tasks is Spark's, and chunks of few rows, ties across none of them, give the estimator."""
    rng, data = np.random.default_rng(4), {}
    y = rng.integers(0, 2, 400)
    y[:1], y[1:3], y[3:9] = 5, 6, 7  # classes of one, two and few rows
    for f, x in {"tied": rng.integers(0, 6, 400).astype(float), "apart": y + rng.normal(size=400) * 0.2, "constant": np.ones(400), "hot": np.where(rng.random(400) < 0.7, 0.0, rng.normal(size=400))}.items():
        data[f] = np.where(np.arange(400) % 97 == 0, -10240.0, x)
    df = spark.createDataFrame([(f, k, None if v == -10240 else float(v), int(c)) for f, x in data.items() for k, (v, c) in enumerate(zip(x, y, strict=True))], "feature string, id long, value double, y int").repartition(3)
    hashes = df.select("feature", "id", *(F.xxhash64("feature", "id", F.lit(1), F.lit(n)).alias(f"h{n}") for n in (1, 2)), F.xxhash64("feature", "id").alias("seed")).orderBy("feature", "id").toPandas()
    seed = hashes.seed.to_numpy().view(np.uint64)
    for n in (1, 2):
        assert (neighbours.hash_int(neighbours.hash_int(seed, 1), n).view(np.int64) == hashes[f"h{n}"].to_numpy()).all()
    noise = {f: neighbours.normal(seed[hashes.feature == f], 1) for f in data}
    want = {f: ross(x / (x.std() or 1.0) + 1e-10 * max(1.0, np.abs(x).mean() / (x.std() or 1.0)) * noise[f], y) for f, x in data.items()}
    for rows in (1 << 17, 60):
        monkeypatch.setattr(neighbours, "ROWS", rows)
        got = {r.feature: r.mi for r in screen.mi_rounds(df, ["id"], rounds=2).where("round = 1").collect()}
        assert got == pytest.approx(want, abs=1e-6)
