"""Results that float noise in a sum or product must not decide."""

from __future__ import annotations

import datetime as dt

from tidewell import queries as q
from tidewell.operators import trend
from tidewell.plans import splits


def test_share_of_people_that_is_a_whole_number(spark):
    """180 * 0.35 is 62.99999999999999 in floats."""
    people = spark.range(180).selectExpr("id AS pid", "'A_1' AS ds_key")
    assert splits.mining_holdout(people).where("mining").count() == 63
    # 100 * 0.29 is 28.999999999999996
    assert splits.pid_split(people.where("pid < 100"), 0.29).where("role = 'test'").count() == 29


def test_score_on_the_edge_of_a_bin(spark, tmp_path):
    at = dt.datetime(2024, 1, 3, 12)
    rows = [(k, at - dt.timedelta(days=k), 1, "error", v) for k, v in enumerate((143.14, 37.79, 69.07))]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    assert [(r.bin, r.n) for r in q.QUERIES["score_hist"](spark, str(tmp_path)).collect()] == [(6, 1)]  # the sum is 249.99999999999997 in any order


def test_bends_at_both_ends_are_one_line(spark):
    """Nearly straight weeks: the first and the last bend fit the same line, so the earlier counts."""
    rows = [(1, dt.date(2024, 1, 24), "f", "weekend", k, 92.5275 * k + e) for k, e in enumerate((0.0, 0.002, 0.0))]
    weeks = spark.createDataFrame(rows, "pid long, label_date date, feature string, part string, week int, mean double")
    assert [r.bend for r in trend.breakpoint_slopes(weeks).collect()] == [0.0]
