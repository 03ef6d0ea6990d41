"""Collaborative filling, feature selection and classification against the same rules in plain numpy."""

from __future__ import annotations

import numpy as np
import pytest

from tidewell.operators import cf, scale


def filled(x: np.ndarray, least_days: float) -> np.ndarray:
    """The published rules on one feature's matrix of people by days."""
    x, missing = x.copy(), np.isnan(x)
    if not (missing.mean(axis=0) < 0.75).sum() > len(x[0]) * least_days:
        return np.nan_to_num(x)
    z = np.nan_to_num(x)
    z[[len(set(r)) == 1 for r in z.tolist()], 0] += 1e-4
    sim = np.corrcoef(z)
    for d in range(x.shape[1]):
        gap, has = np.flatnonzero(missing[:, d]), np.flatnonzero(~missing[:, d])
        s = sim[np.ix_(gap, has)]
        x[gap, d] = np.clip(np.round((s * x[has, d]).sum(axis=1) / (s.sum(axis=1) + 1e-4)), 1, 3)
    x[[len(set(r)) == 1 for r in x.tolist()], 0] += 1e-4
    return x


@pytest.mark.parametrize("least_days", [-1.0, 0.5])
def test_fill_equals_the_rules(spark, monkeypatch, least_days):
    monkeypatch.setattr(scale, "PEOPLE", 4)
    rng, rows, want = np.random.default_rng(4), [], {}
    for name, rate in (("f", 0.3), ("sparse", 0.85), ("whole", 0.0), ("none", 1.0)):
        x = rng.integers(1, 4, (13, 7)).astype(float)
        x[rng.random(x.shape) < rate] = np.nan
        x[3], x[5, :] = (2.0 if rate < 1 else np.nan), np.nan  # a constant series and an empty one
        if name == "f":
            x[:, 4] = np.nan  # a day without donors
        rows += [(name, p, d, None if np.isnan(v) else float(v)) for p, r in enumerate(x) for d, v in enumerate(r)]
        out = filled(x, least_days)
        want |= {(name, p, d): v for p, r in enumerate(out) for d, v in enumerate(r)}
    long = spark.createDataFrame(rows, "feature string, pid long, day int, value double").repartition(3)
    got = {(r.feature, r.pid, r.day): r.value for r in scale.cf_impute(long, least_days=least_days).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())
    if least_days < 0:
        assert {got["f", p, 4] for p in range(13)} == {1.0}


def planted(seed: int, people: int, features: int, noise: float = 0.7):
    """Day series that follow one of two shapes by the label, for the first features only."""
    rng = np.random.default_rng(seed)
    y, shapes = rng.integers(0, 2, people), rng.normal(size=(features, 2, 12))
    x = np.array([[shapes[f, y[p] if f < 2 else rng.integers(0, 2)] + rng.normal(size=12) * noise for p in range(people)] for f in range(features)])
    return np.round(x, 3), y


def test_feature_results_equal_a_loop_over_folds(spark, monkeypatch):
    monkeypatch.setattr(cf, "BLOCK", 7)
    x, y = planted(1, 30, 3)
    fold = np.arange(30) % 3
    memory = spark.createDataFrame([(f"f{f}", p, d, float(v)) for f in range(3) for p in range(30) for d, v in enumerate(x[f, p])], "feature string, pid long, day int, value double")
    labels = spark.createDataFrame([(p, int(y[p]), int(fold[p])) for p in range(30)], "pid long, y int, fold int")
    got = {(r.feature, r.fold): r for r in cf.feature_results(memory, labels).collect()}
    for f in range(3):
        sim = np.round(np.corrcoef(x[f]) ** 2, 9)
        for k in range(3):
            train, valid = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            own = sim[np.ix_(train, train)].copy()
            np.fill_diagonal(own, 0)
            score = own @ y[train] / (own.sum(axis=1) + 1e-6)
            limit = (score[y[train] == 1].mean() + score[y[train] == 0].mean()) / 2
            far = sim[np.ix_(valid, train)]
            far = np.where(far < np.percentile(far, 25), 0, far)
            pred = far @ y[train] / (far.sum(axis=1) + 1e-6) > limit
            r = got[f"f{f}", k]
            assert (r.threshold, r.valid_acc) == pytest.approx((limit, (pred == (y[valid] == 1)).mean()))
            hit = score > limit
            assert r.train_balanced_acc == pytest.approx((hit[y[train] == 1].mean() + 1 - hit[y[train] == 0].mean()) / 2)


def test_classifier_picks_what_was_planted_and_predicts_new_people(spark):
    x, y = planted(7, 90, 8, 1.3)  # noisy: features that recall everything in training are not listed
    rows = [(p, int(y[p]), p % 5, f"f{f}", d, float(v)) for f in range(8) for p in range(90) for d, v in enumerate(x[f, p])]
    df = spark.createDataFrame(rows, "pid long, y int, fold int, feature string, day int, value double")
    model = cf.CollaborativeFilter(top=0.25).fit(df.where("pid < 70"))
    assert set(model.chosen) <= {"f0", "f1"} and model.chosen
    pred = {r.pid: r.pred for r in model.transform(df.where("pid >= 70").drop("y", "fold")).collect()}
    assert len(pred) == 20 and np.mean([pred[p] == y[p] for p in pred]) > 0.7
