"""Values of the model operators: searches against loops of single fits, stacking, stability selection."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidewell.operators import metrics, models


@pytest.fixture(scope="module")
def planted(spark):
    """Two families, each of which sees one half of what makes the label."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(600, 6))
    y = (x[:, 0] + x[:, 3] + 0.3 * rng.normal(size=600) > 0).astype(float)
    rows = [(k, v.tolist(), float(t), k % 3, "train" if k % 4 else "test", "ios" if k % 2 else "android") for k, (v, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "row_id long, x array<double>, label double, fold int, role string, device string").withColumn("features", array_to_vector("x")).repartition(2).cache()


def test_grid_search_equals_a_loop_of_single_fits(planted):
    params = [{"regParam": r, "elasticNetParam": m} for r in (0.003, 0.3) for m in (0.0, 1.0)]
    best, means = models.grid_search(planted, "lr", params, "log_likelihood")
    want = []
    for p in params:
        parts = []
        for fold in range(3):
            model = LogisticRegression(**p, tol=1e-10, maxIter=300).fit(planted.where(f"fold <> {fold}"))
            parts.append(metrics.log_likelihood(models.predictions(model, planted.where(f"fold = {fold}")), []).first()["log_likelihood"])
        want.append(float(np.mean(parts)))
    got = {r.params: r.mean for r in means.collect()}
    assert [got[k] for k in range(4)] == pytest.approx(want, rel=1e-4)
    assert best == params[int(np.argmax(want))]


def test_grid_search_of_other_kinds_runs_side_by_side(planted):
    params = [{"maxDepth": 1, "seed": 1}, {"maxDepth": 4, "seed": 1}]
    best, means = models.grid_search(planted, "dt", params, "acc")
    assert best == params[1] and means.count() == 2


def test_stacking_beats_each_family_on_unseen_rows(planted):
    train, test = planted.where("role = 'train'"), planted.where("role = 'test'")
    stack = models.Stacking({"a": [0, 1, 2], "b": [3, 4, 5]}, costs=(0.01, 1.0), sizes=(2, 6), top=(5, 15))
    fitted = stack.fit(train)
    unseen = fitted.unseen.collect()
    assert len(unseen) == 2 * train.count() and {(r.family, r.fold) for r in unseen} == {(f, k) for f in "ab" for k in range(3)}
    scored = models.predictions(fitted, test).cache()
    own = lambda c: metrics.auc(scored.select("y", "pred", F.col(c).alias("score")), []).first()["auc"]
    assert own("score") > max(own("p_a"), own("p_b")) + 0.1
    assert metrics.binary_report(scored, []).first()["balanced_acc"] > 0.85
    # a family's held-out probabilities come from a model without the row's fold
    if fitted.chosen["a"][0].startswith("net"):
        reg = 1 / (stack.costs[int(fitted.chosen["a"][0][3:])] * train.count())
        part = train.where("fold <> 0").withColumn("features", array_to_vector(F.slice("x", 1, 3)))
        model = LogisticRegression(regParam=reg, elasticNetParam=1.0, standardization=False, tol=1e-10, maxIter=300).fit(part)
        p = {r.row_id: float(r.probability[1]) for r in model.transform(train.where("fold = 0").withColumn("features", array_to_vector(F.slice("x", 1, 3)))).collect()}
        assert all(r.probability == pytest.approx(p[r.row_id], abs=1e-3) for r in unseen if r.family == "a" and r.fold == 0)


def test_stability_scores_equal_single_refits_and_find_what_matters(planted):
    scores = models.stability_scores(planted, 6, [[0, 1, 2], [3, 4, 5]], n=6, cost=0.05, seed=3)
    masked = planted.where(F.pmod(F.xxhash64("row_id", F.lit(3)), F.lit(1000)) < 750)
    random, reg = np.random.default_rng(3), 1 / (0.05 * masked.count())
    for places, found in zip([[0, 1, 2], [3, 4, 5]], scores, strict=True):
        scales, hits = np.where(random.random((6, 3)) < 0.5, 0.5, 1.0), np.zeros(3)
        for s in scales:
            x = array_to_vector(F.array(*(F.col("x")[k] * float(c) for k, c in zip(places, s, strict=True))))
            fit = LogisticRegression(regParam=reg, elasticNetParam=1.0, standardization=False, tol=1e-10, maxIter=300).fit(masked.withColumn("features", x))
            hits += np.abs(fit.coefficients.toArray()) > 1e-8
        assert [found[k] for k in places] == pytest.approx((hits / 6).tolist())
    kept = models.stability_select(planted, 6, {"a": {"s": [0, 1, 2]}, "b": {"s": [3, 4], "t": [5]}}, n=40, cost=0.02)
    assert set(kept) <= {"a", "b"} and all(set(v) <= {0, 3} for v in kept.values())


def test_models_of_devices_fall_back(planted):
    one_class = planted.withColumn("label", F.when(F.col("device") == "ios", 1.0).otherwise(F.col("label"))).withColumn("device", F.when(F.col("row_id") % 50 == 0, "other").otherwise(F.col("device")))
    train = one_class.where("role = 'train' and device <> 'other'")
    out = models.PerDevice("dt", {"maxDepth": 3}).fit(train).transform(one_class)
    assert out.count() == 600 and {r.score for r in out.where("device = 'ios'").select("score").distinct().collect()} == {1.0}
    whole = models.make_estimator("dt", {"maxDepth": 3}).fit(train)
    want = {r.row_id: r.score for r in models.predictions(whole, one_class.where("device = 'other'")).collect()}
    assert {r.row_id: r.score for r in out.where("device = 'other'").collect()} == want


def test_staged_scores_equal_smaller_models(planted):
    rows = planted.coalesce(1).cache()
    whole = models.boosted("features", 5).fit(rows)
    got = {(r.row_id, r["size"]): r.p for r in models.staged(whole, rows, (2, 5), ["row_id"]).collect()}
    for size in (2, 5):
        want = models.boosted("features", size).fit(rows).transform(rows).select("row_id", "probability").collect()
        assert all(got[r.row_id, size] == pytest.approx(float(r.probability[1])) for r in want)


def test_pooled_baseline_learns_from_windows(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 200)
    x = [(rng.normal(size=(6, 3)) + (np.arange(6)[:, None] * 0.4 if c else 0)).tolist() for c in y]
    rows = spark.createDataFrame([(k, v, float(c)) for k, (v, c) in enumerate(zip(x, y, strict=True))], "row_id long, x array<array<double>>, label double")
    model = models.pooled_baseline(rows.where("row_id < 150"), 18)
    scored = models.predictions(model, rows.where("row_id >= 150").withColumn("features", models.flat_tensor(F.col("x"))))
    assert metrics.binary_report(scored, []).first()["balanced_acc"] > 0.85


def test_boosting_with_written_weights_separates_a_corner(planted):
    fitted = models.AdaBoost(rounds=8, maxDepth=1).fit(planted)
    one = models.AdaBoost(rounds=1, maxDepth=1).fit(planted)
    acc = lambda m: metrics.binary_report(models.predictions(m, planted), []).first()["acc"]
    assert len(fitted.trees) > 3 and acc(fitted) > acc(one) + 0.05


def test_beta_weights_have_the_moments_of_their_distribution(spark):
    from tidewell.operators import embed

    for alpha in (0.2, 0.4, 1.0):
        got = np.array([r.lam for r in spark.range(20_000).select(embed.beta("id", alpha, 3).alias("lam")).collect()])
        assert got.min() >= 0 and got.max() <= 1 and got.mean() == pytest.approx(0.5, abs=0.02)
        assert got.var() == pytest.approx(1 / (4 * (2 * alpha + 1)), rel=0.05)
