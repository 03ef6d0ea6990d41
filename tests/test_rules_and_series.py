"""Rule selection, correlations of constant series, collaborative filtering of new people, whole tensors."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tidewell.functions.scalar import correlation
from tidewell.operators import cf, rules, scale, screen, windows
from tidewell.plans import published, registry  # noqa: F401  published registers the algorithms


def test_correlation_of_constant_single_and_null_groups(spark):
    rows = [("a", 1.0, 1.0), ("a", 2.0, 4.0), ("a", 3.0, 2.0), ("b", 5.0, 1.0), ("b", 5.0, 2.0), ("c", 1.0, 1.0), ("d", None, 1.0), ("d", None, 2.0)]
    df = spark.createDataFrame(rows, "feature string, value double, y double")
    got = {r.feature: r.r for r in df.groupBy("feature").agg(correlation("value", "y").alias("r")).collect()}
    assert abs(got["a"] - np.corrcoef([1, 2, 3], [1, 4, 2])[0, 1]) < 1e-12 and got["b"] is got["c"] is got["d"] is None
    assert [r.feature for r in screen.corr_screen(df, []).collect()] == ["a"]
    assert {r.feature: r.rho is None for r in screen.spearman(df, []).collect()} == {"a": False, "b": True, "c": True}
    long = spark.createDataFrame([("f", 1, 1, 2.0), ("f", 1, 2, 2.0), ("f", 2, 1, 1.0), ("f", 2, 2, None)], "feature string, pid long, day int, value double")
    assert scale.cf_impute(long).count() == 4


def contrast(spark, rows):
    names = ("antecedent", "consequent", "support_pos", "confidence_pos", "lift_pos", "support_neg", "confidence_neg", "lift_neg")
    df = spark.createDataFrame(rows, "antecedent array<int>, consequent array<int>, " + ", ".join(f"{n} double" for n in names[2:]))
    return df.withColumns({f"{c}_diff": F.col(f"{c}_pos") - F.col(f"{c}_neg") for c in ("support", "confidence", "lift")})


def test_thresholds_rise_by_the_median_of_rules_that_both_groups_have(spark):
    rows = [([1], [2], 0.5, 0.8, 1.0, 0.3, 0.6, 1.0), ([3], [2], 0.5, 0.8, 1.0, 0.5, 0.8, 1.0), ([4], [2], 0.25, 0.9, 1.0, 0.0, 0.0, 0.0)]
    # medians over the first two: 0.1 and 0.1
    kept = rules.passing_rules(contrast(spark, rows), 0.3, 0.6).collect()
    assert sorted(r.antecedent[0] for r in kept) == [1, 3]
    assert len(rules.passing_rules(contrast(spark, rows[2:]), 0.25, 0.9).collect()) == 1


def test_rules_are_chosen_by_signed_interest_on_each_side(spark):
    rows = [([1], [9], 0.4, 0.8, 2.0, 0.1, 0.5, 1.0), ([2], [9], 0.1, 0.8, 2.0, 0.4, 0.5, 1.0), ([1, 3], [9], 0.4, 0.8, 2.0, 0.1, 0.5, 1.0), ([5], [9], 0.0, 0.0, 0.0, 0.3, 0.6, 1.5)]
    made = {tuple(r.antecedent): r for r in rules.rule_interest(contrast(spark, rows), size="antecedent").collect()}
    assert abs(made[1,].interest - 0.3 * 0.3) < 1e-12 and made[2,].interest < 0
    assert abs(made[1,].supp_delta - (2 * 0.3 + (0.5 - 0.4) * 0.5) / 0.9) < 1e-12
    assert abs(made[5,].interest - 0.5 * 0.6) < 1e-12
    best = rules.select_rules(contrast(spark, rows), k=2).orderBy("sided", "rank").collect()
    assert [(tuple(r.antecedent), r.sided) for r in best] == [((5,), 1), ((1, 3), 2), ((2,), 2)]


def test_new_people_are_scored_against_the_memory(spark):
    series = {1: [1, 2, 3, 4], 2: [4, 3, 2, 5], 3: [1, 1, 2, 1]}
    memory = spark.createDataFrame([("f", p, k, float(v)) for p, vs in series.items() for k, v in enumerate(vs)], "feature string, pid long, day int, value double")
    new = spark.createDataFrame([("f", 7, k, float(v)) for k, v in enumerate([2, 4, 6, 8])] + [("f", 8, 0, 1.0)], "feature string, pid long, day int, value double")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "pid long, y int")
    r2 = {p: np.corrcoef([2, 4, 6, 8], vs)[0, 1] ** 2 for p, vs in series.items()}
    got = {r.pid: r.score for r in cf.sim_score(memory, labels, new, floor_q=None).collect()}
    assert abs(got[7] - r2[1] / (sum(r2.values()) + 1e-6)) < 1e-8 and got[8] == 0.0
    assert cf.midpoint_threshold(memory, labels).count() == 1
    assert cf.similarity(memory).count() == 6


def test_blocks_of_people_give_all_pairs(spark, monkeypatch):
    r = np.random.default_rng(2)
    rows = [("f", p, k, float(r.integers(0, 5))) for p in range(30) for k in range(8) if r.random() < 0.8]
    memory = spark.createDataFrame(rows, "feature string, pid long, day int, value double")
    whole = sorted(map(tuple, cf.similarity(memory).collect()))
    monkeypatch.setattr(cf, "BLOCK", 7)
    assert sorted(map(tuple, cf.similarity(memory).collect())) == whole and len(whole) == 30 * 29


def test_a_tensor_has_every_day(spark):
    day = dt.date(2024, 1, 28)
    window = spark.createDataFrame([(1, day, day, "f", 3.0), (1, day, dt.date(2024, 1, 1), "g", 2.0)], "pid long, label_date date, date date, feature string, value double")
    x = windows.window_tensor(window, ["f", "g"]).first().x
    assert len(x) == 28 and x[27] == [3.0, 0.0] and x[0] == [0.0, 2.0] and x[5] == [0.0, 0.0]


def test_published_pipelines_are_registered():
    names = {"saeb", "wang", "wahle", "canzian", "farhan", "lu", "chikersal", "xu_interpretable", "xu_personalized"}
    assert {f"ml_{n}" for n in names} <= set(registry.ALGORITHMS)
    assert registry.load_algorithm("ml_saeb", {"maxIter": 5}).params == {"maxIter": 5}
