"""Small literal tables with values worked out by hand, one for each rule that is easy to get wrong."""

from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.functions import scalar
from tidewell.operators import cf, embed, metrics, models, quality, rules, scale, trend, windows
from tidewell.plans import registry, splits
from tidewell.sources import io

D = dt.date


def test_binarise_directions_and_equal_thresholds(spark):
    rows = spark.createDataFrame([(1.0,), (2.5,), (3.0,)], "s double")
    up = [r[0] for r in rows.select(io.binarise(F.col("s"), 2.0, 3.0)).collect()]
    down = [r[0] for r in rows.select(io.binarise(F.col("s"), 3.0, 1.0)).collect()]
    assert up == [False, False, True] and down == [True, False, False]
    with pytest.raises(ValueError):
        io.binarise(F.col("s"), 1.0, 1.0)


def test_surveys_are_read_united_and_looked_up(spark, tmp_path):
    (tmp_path / "ema.csv").write_text("pid,date,PSS.1,phq4_EMA\na,2020-01-01,NaN,3\na,2020-01-01,2,5\n")
    (tmp_path / "pre.csv").write_text("pid,date,phq4_EMA,x_PRE\nb,2020-01-02,9,1\n")
    (tmp_path / "platform.csv").write_text("pid,platform\na,ios;android\n")
    ema, pre = (io.scan_csv(spark, str(tmp_path / f"{n}.csv"), "A_1") for n in ("ema", "pre"))
    got = io.survey_labels({"ema": ema, "pre": pre}, "phq4_EMA", (3.0, 4.0)).collect()
    assert [(r.pid, r.score, r.y) for r in got] == [("a#A_1", 5.0, True)]
    assert io.union_years([ema, pre]).count() == 3
    assert ema.where("`PSS.1` is null").count() == 1
    assert io.scan_participants(spark, str(tmp_path / "platform.csv"), "A_1").first().device == "ios"
    with pytest.raises(KeyError):
        io.find_survey({"ema": ema}, "none")
    assert io.dataset_registry("/r", ["A_1"])["A_1"]["surveys"] == "/r/A_1/SurveyData"


def test_pid_lists_take_over_another_targets(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"t": {"A_1": {"all": ["a", "b"]}}}')
    got = io.read_pid_lists(spark, str(tmp_path / "l.json"), {"u": "t"}).collect()
    assert sorted((r.pred_target, r.pid) for r in got) == [("t", "a"), ("t", "b"), ("u", "a"), ("u", "b")]


def test_window_is_28_days_with_the_label_day(spark):
    labels = spark.createDataFrame([(1, D(2024, 1, 28)), (2, D(2024, 1, 28))], "pid long, label_date date")
    daily = spark.createDataFrame([(1, D(2024, 1, 1), "f", 1.0), (1, D(2023, 12, 31), "f", 9.0), (1, D(2024, 1, 28), "f", 3.0), (1, D(2024, 1, 29), "f", 9.0)], "pid long, date date, feature string, value double")
    for window in (windows.label_windows(labels, daily), windows.label_windows_by_range(labels, daily)):
        assert sorted(r.value for r in window.collect()) == [1.0, 3.0]
    padded = windows.padded_windows(labels, daily)
    assert padded.count() == 28 and padded.where("value is not null").count() == 2
    row = windows.window_stats(padded, 14, ("sum", "mean", "last")).first()
    assert (row["sum"], row["mean"], row["last"]) == (3.0, 3.0, 3.0)


def test_sum_of_nothing_is_zero_and_lookup_fails_on_strangers(spark):
    none = spark.createDataFrame([(1, D(2024, 1, 5), D(2024, 1, 5), "f", None)], "pid long, label_date date, date date, feature string, value double")
    row = windows.window_stats(none).first()
    assert row["sum"] == 0.0 and row["mean"] is None
    dim = spark.createDataFrame([(2, "ios")], "pid long, device string")
    with pytest.raises(Exception, match="no participant 1"):
        windows.lookup(none, dim).collect()


def test_breakpoint_finds_the_bend(spark):
    values = [0.0, 1.0, 2.2, 2.9, 4.1, 2.0, 0.1, -2.1]
    weeks = spark.createDataFrame([(1, D(2024, 3, 1), "f", "weekday", k, v) for k, v in enumerate(values)], "pid long, label_date date, feature string, part string, week int, mean double")
    row = trend.breakpoint_slopes(weeks).first()
    assert row.bend == 4.0 and row.slope_before > 0.9 and row.slope_after < -1.9


def test_tertiles_fall_back_to_fewer_bins(spark):
    rows = [("a", float(v)) for v in (1, 2, 3, 4, 5, 6)] + [("b", float(v)) for v in (1, 1, 1, 5, 9, 9)] + [("c", 2.0)] * 3
    df = spark.createDataFrame([(p, "f", v) for p, v in rows], "pid string, feature string, value double")
    got = {}
    for r in scale.tertiles(df, ["pid"]).collect():
        got.setdefault(r.pid, set()).add(r.level)
    assert got["a"] == {"l", "m", "h"} and got["b"] == {"l", "h"} and got["c"] == {"m"}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=20))
def test_robust_norm_stays_in_bounds(spark, values):
    df = spark.createDataFrame([(1, "f", v) for v in values], "pid long, feature string, value double")
    assert all(-2 <= r.value <= 2 for r in scale.robust_norm(df, ["pid"]).collect())


def test_metrics_of_empty_margins_and_auc(spark):
    pred = spark.createDataFrame([(0, 0, 0.1), (0, 0, 0.2)], "y int, pred int, score double")
    r = metrics.binary_report(pred, []).first()
    assert (r.precision, r.recall, r.mcc, r.kappa, r.f1) == (1.0, 1.0, 1.0, 1.0, 1.0)
    assert metrics.auc(pred, []).first().auc == 1.0
    tied = spark.createDataFrame([(1, 1, 0.5), (0, 1, 0.5)], "y int, pred int, score double")
    assert metrics.auc(tied, []).first().auc == 0.5
    monotone = spark.createDataFrame([(1, 1, 0.9), (0, 0, 0.3), (1, 0, 0.2)], "y int, pred int, score double")
    cubed = monotone.withColumn("score", F.pow("score", F.lit(3)))
    assert metrics.auc(monotone, []).first() == metrics.auc(cubed, []).first()


def test_splits_are_disjoint_and_cover(spark):
    points = spark.createDataFrame([(k % 7, f"A_{k % 7 % 2 + 1}", D(2024, 1, 1 + k)) for k in range(25)], "pid long, ds_key string, label_date date")
    plan = splits.split_plan("single", points, k=3, repeats=1)
    assert plan.groupBy("split_id", "pid").count().where("count > 1").count() == 0
    assert plan.where("role = 'test'").count() == 7
    within = splits.within_user(points)
    assert within.where("role = 'test'").groupBy("pid").count().agg(F.min("count")).first()[0] == 1
    folds = splits.group_folds(points, "pid", 3)
    assert folds.count() == 7 and folds.select("pid").distinct().count() == 7
    one = splits.one_validation_row(points)
    assert one.where("validation").count() == 7
    assert splits.fold_count(points.withColumn("y", F.col("pid") < 2), "y", "pid") == 2


def test_oversample_and_smote_level_the_classes(spark):
    rows = spark.createDataFrame([(k, int(k < 3), [float(k), 1.0]) for k in range(10)], "id long, y int, x array<double>")
    counts = {r.y: r["count"] for r in splits.oversample(rows, "y", ["id"]).groupBy("y").count().collect()}
    assert counts == {0: 7, 1: 7}
    made = splits.smote(rows, "y", "id", "x").collect()
    assert len(made) == 4 and all(r.y == 1 and 0 <= r.x[0] <= 2 for r in made)


def test_closed_rules_drop_parts(spark):
    r = spark.createDataFrame([([1], [3]), ([1, 2], [3]), ([4], [3])], "antecedent array<int>, consequent array<int>")
    assert sorted(x.antecedent for x in rules.closed_rules(r).collect()) == [[1, 2], [4]]
    assert rules.threshold_policy(12, 100, {"full": {"s": 1}, "tiny": {"s": 2}}) == {"s": 2}


def test_knn_far_votes_count_reversed_and_self_is_skipped(spark):
    rows = spark.createDataFrame([(1, [0.0], 1), (2, [0.1], 1), (3, [5.0], 0)], "id long, x array<double>, y int")
    near = {r.id: r.pred for r in embed.knn_vote(rows, rows, 1, self_exclude=True).collect()}
    assert near == {1: 1, 2: 1, 3: 1}
    far = {r.id: r.pred for r in embed.knn_vote(rows, rows.where("id = 1"), 1, "far").collect()}
    assert far == {1: 1}


def test_permutations_are_far_apart(spark):
    got = [r.order for r in embed.hamming_permutations(spark, 4, 3).orderBy("class").collect()]
    assert got[0] == [0, 1, 2, 3] and all(a != b for a, b in zip(got[0], got[1], strict=True))


def test_profiles_votes_and_missing_grid(spark):
    long = spark.createDataFrame([(1, "w", "f", 2, 5.0), (1, "w", "f", 1, 4.0)], "pid long, slice string, feature string, day int, value double")
    assert cf.profiles(long).first().profile == [4.0, 5.0]
    rows = spark.createDataFrame([("A", 1, D(2024, 1, 1), "f", 1.0), ("A", 2, D(2024, 1, 2), "f", None)], "ds_key string, pid long, date date, feature string, value double")
    assert quality.grid_na_rate(rows).first().na_rate == 0.75
    assert quality.kept_features(rows, 0.5).count() == 0


def test_registry_and_overrides():
    @registry.register("plain")
    def make(params: dict) -> registry.Algorithm:
        return registry.Algorithm(lambda windows, role: windows, "lr", params)

    found = registry.load_algorithm("plain", {"maxIter": 3}, {"maxIter": 5, "regParam": None})
    assert found.params == {"maxIter": 5} and found.make().getMaxIter() == 5
    assert registry.Catalog().with_dataset("A_1", "/x").with_target("t", 1, 2).thresholds == {"t": (1, 2)}


def test_boosting_learns_what_one_stump_cannot(spark):
    from pyspark.ml.functions import array_to_vector

    rows = spark.createDataFrame([([float(k)], float(3 <= k < 7)) for k in range(10)], "x array<double>, label double").withColumn("features", array_to_vector("x"))
    model = models.make_estimator("adaboost", {"rounds": 6, "maxDepth": 1}).fit(rows)
    out = models.predictions(model, rows)
    assert out.where("y = pred").count() >= 9


def test_scalar_helpers(spark):
    row = spark.createDataFrame([(2.5, -5.0, "m")], "a double, b double, l string").select(scalar.half_even(F.col("a")), scalar.clip(F.col("b"), -2, 2), scalar.ordinal(F.col("l"))).first()
    assert tuple(row) == (2.0, -2.0, 2)


def test_labels_columns_go_along_with_their_windows(spark):
    """Statistics keep the label's columns where the participant's rows lie: no exchange brings them back."""
    labels = spark.createDataFrame([(1, "2024-01-03", True), (1, "2024-01-05", False), (2, "2024-01-03", None)], "pid long, label_date string, y boolean").withColumn("label_date", F.to_date("label_date"))
    daily = spark.createDataFrame([(1, "2024-01-02", "a", 1.0), (1, "2024-01-03", "a", 3.0), (2, "2024-01-03", "a", 5.0)], "pid long, date string, feature string, value double").withColumn("date", F.to_date("date"))
    made = windows.window_stats(windows.label_windows(labels.repartition(3, "pid"), daily.repartition(3, "pid"), 14), 14, ("mean",), ("y",))
    assert sorted(((r.pid, r.label_date.day, r.y, r["mean"]) for r in made.collect()), key=repr) == [(1, 3, True, 2.0), (1, 5, False, 2.0), (2, 3, None, 5.0)]
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2 * 2  # the two repartitions, once in each form of the plan
