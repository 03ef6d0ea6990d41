"""Stability selection as published: features are normalised before they are scaled at random."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import linear, models

N, D = 600, 5


@pytest.fixture(scope="module")
def planted(spark):
    """Feature 0 decides and is counted in a tiny unit from a large mean; 4 is constant, the others are noise."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(N, D))
    y = (x[:, 0] + 0.8 * rng.normal(size=N) > 0.7).astype(float)
    x[:, 0] = 1e3 + 1e-4 * x[:, 0]
    x[:, 4] = 0.1
    rows = [(k, v.tolist(), float(t)) for k, (v, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "row_id long, x array<double>, label double").repartition(3).cache()


def lasso(x, y, cost):
    """|w| + |b| + cost * sum of log losses, as liblinear has it: proximal gradient steps with momentum."""
    x = np.append(x, np.ones((len(x), 1)), axis=1)
    step = 4 / (cost * np.linalg.eigvalsh(x.T @ x)[-1])
    w = ahead = np.zeros(x.shape[1])
    t = 1.0
    for _ in range(20_000):
        z = ahead - step * cost * (x.T @ (1 / (1 + np.exp(-x @ ahead)) - y))
        new = np.sign(z) * np.maximum(np.abs(z) - step, 0)
        up = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / up * (new - w), new, up
    return w


def test_scores_equal_refits_on_normalised_features(planted):
    groups, cost, n = [[0, 1, 4], [2, 3]], 0.6, 5
    scores = models.stability_scores(planted, D, groups, n=n, cost=cost, seed=3, normalize=True)
    rows = planted.withColumn("use", F.pmod(F.xxhash64("row_id", F.lit(3)), F.lit(1000)) < 750).collect()
    x, y, use = (np.array([r[c] for r in rows]) for c in ("x", "label", "use"))
    x = x - x.mean(axis=0)
    x[:, :4] /= np.sqrt((x[:, :4] ** 2).sum(axis=0))
    x[:, 4] = 0.0
    random = np.random.default_rng(3)
    for places, found in zip(groups, scores, strict=True):
        scales = np.where(random.random((n, len(places))) < 0.5, 0.5, 1.0)
        hits = sum(np.abs(lasso(x[use][:, places] * s, y[use], cost)[:-1]) > 1e-9 for s in scales)
        assert [found[k] for k in places] == pytest.approx((hits / n).tolist())
    assert scores[0][0] > 0 == scores[0][4]


def test_units_do_not_decide(planted, monkeypatch):
    found = models.stability_scores(planted, D, [[0, 1, 4], [2, 3]], n=20, cost=0.6, normalize=True)
    assert found[0][0] == 1.0 and found[0][4] == 0.0
    other = planted.withColumn("x", F.transform("x", lambda v, k: v * F.pow(F.lit(100.0), k) - 5))
    assert models.stability_scores(other, D, [[0, 1, 4], [2, 3]], n=20, cost=0.6, normalize=True) == found
    calls = []
    monkeypatch.setattr(models, "stability_scores", lambda *args, **options: calls.append(options) or [{0: 1.0, 1: 0.0}])
    models.stability_select(planted, D, {"a": {"s": [0, 1]}})
    assert len(calls) == 2 and all(c["normalize"] for c in calls)


def test_moments_and_penalised_intercept(planted):
    n, mean, squares = linear.moments(planted, D)
    x = np.array([r.x for r in planted.select("x").collect()])
    assert n == N and mean == pytest.approx(x.mean(axis=0)) and squares[4] == 0
    assert squares[:4] == pytest.approx(((x - x.mean(axis=0)) ** 2).sum(axis=0)[:4], rel=1e-6)
    own = planted.withColumn("x", F.slice("x", 2, 3))
    rows = own.collect()
    for part in (1.0, 8.0):
        what = linear.Fits(np.ones((1, 3)), np.full(1, 0.002), np.zeros(1), np.full(1, -1))
        found = linear.fit_many(own, 3, what, intercept=part)[0]
        # a coefficient of a column of 1 / part bears the penalty once
        want = lasso_with(np.array([r.x for r in rows]), np.array([r.label for r in rows]), 1 / (0.002 * N), part)
        assert found == pytest.approx(want, abs=1e-4)


def lasso_with(x, y, cost, part):
    """The same with ``part`` times the penalty on the intercept."""
    wide = np.append(x, np.full((len(x), 1), 1 / part), axis=1)
    step = 4 / (cost * np.linalg.eigvalsh(wide.T @ wide)[-1])
    w = np.zeros(wide.shape[1])
    for _ in range(20_000):
        z = w - step * cost * (wide.T @ (1 / (1 + np.exp(-wide @ w)) - y))
        w = np.sign(z) * np.maximum(np.abs(z) - step, 0)
    return np.append(w[:-1], w[-1] / part)


def test_equal_refits_are_fitted_once(planted, monkeypatch):
    """Two pairs of features have eight scales, however many refits; the query's first stage is not fitted again."""
    sizes, fit = [], linear.fit_many
    monkeypatch.setattr(linear, "fit_many", lambda rows, d, what, **more: sizes.append(len(what)) or fit(rows, d, what, **more))
    families = {"a": {"s": [0, 1], "t": [2, 3]}}
    scores, kept = models.stability_stages(planted, D, families, n=100, cost=0.6)
    assert len(sizes) <= 2 and max(sizes) <= 8 and [set(s) for s in scores] == [{0, 1}, {2, 3}]
    assert kept == models.stability_select(planted, D, families, n=100, cost=0.6)
