"""Models fitted together against spark.ml's fits one by one."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector

from tidewell.operators import linear


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 5)) * [1, 3, 0.5, 1, 0] + [0, 1, 0, 2, 7]
    y = (x[:, 0] - x[:, 1] / 2 + rng.normal(size=400) > 0).astype(float)
    table = [(k, v.tolist(), float(t), k % 4) for k, (v, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(table, "row_id long, x array<double>, label double, fold int").repartition(3).cache()


def test_grid_without_folds_equals_single_fits(rows):
    reg, mix, folds = [0.001, 0.02, 0.2, 0.05], [1.0, 0.5, 0.0, 1.0], [-1, 2]
    what = linear.fits(reg, mix, folds, np.ones(5))
    found = linear.fit_many(rows, 5, linear.standard(rows, 5, what))
    k = 0
    for r, m in zip(reg, mix, strict=True):
        for f in folds:
            own = rows.where(f"fold <> {f}").withColumn("features", array_to_vector("x"))
            model = LogisticRegression(regParam=r, elasticNetParam=m, tol=1e-10, maxIter=500).fit(own)
            assert found[k] == pytest.approx([*model.coefficients.toArray(), model.intercept], abs=2e-4)
            k += 1


def test_scales_change_the_penalty_and_zero_leaves_out(rows):
    scales = np.array([[1, 1, 1, 1, 1], [0.5, 1, 1, 1, 1], [0, 1, 1, 1, 0]], float)
    what = linear.Fits(scales, np.full(3, 0.05), np.zeros(3), np.full(3, -1))
    found = linear.fit_many(rows, 5, what)
    for w, s in zip(found, scales, strict=True):
        own = rows.withColumn("features", array_to_vector(linear.F.zip_with("x", linear.F.array(*map(linear.F.lit, s.tolist())), lambda a, b: a * b)))
        model = LogisticRegression(regParam=0.05, elasticNetParam=1.0, standardization=False, tol=1e-10, maxIter=500).fit(own)
        assert w == pytest.approx([*(model.coefficients.toArray() * s), model.intercept], abs=2e-4)
    assert abs(found[1][0]) < abs(found[0][0]) and found[2][0] == 0 == found[2][4]


def test_scores_are_of_rows_not_seen_and_state_is_bounded(rows, monkeypatch):
    what = linear.fits([0.01, 0.1], [1.0, 0.0], [0, 1, 2, 3], np.ones(5))
    whole = linear.fit_many(rows, 5, what)
    monkeypatch.setattr(linear, "STATE", 100)
    assert linear.fit_many(rows, 5, what) == pytest.approx(whole, abs=1e-6)
    scored = linear.score_many(rows, 5, whole, what, "row_id").collect()
    assert len(scored) == 2 * rows.count() and all(what.fold[r.model] == r.fold == r.row_id % 4 for r in scored)
    x = {r.row_id: (r.x, r.label) for r in rows.collect()}
    for r in scored[:50]:
        z = float(np.dot(whole[r.model][:5], x[r.row_id][0]) + whole[r.model][5])
        assert r.score == pytest.approx(1 / (1 + np.exp(-z))) and r.y == x[r.row_id][1]
    one = rows.select("*", linear.probability(whole[0]).alias("p")).where("row_id = 4").first()
    assert one.p == pytest.approx(1 / (1 + np.exp(-(np.dot(whole[0][:5], one.x) + whole[0][5]))))
