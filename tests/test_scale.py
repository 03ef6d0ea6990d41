"""What grows with the table: partitions by participant, blocks of people, tables written between passes."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from tidewell.operators import cf, ordered, scale, windows
from tidewell.plans import views

DIR = "/root/testdata/sf0.001"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_windows_stay_by_participant(spark, monkeypatch):
    """Labels, roll-up and statistics of windows: three exchanges by pid of events and people, and the distinct people."""
    monkeypatch.setattr(views, "EVENTS", 100)
    stats = windows.window_stats(views.windows(spark, DIR, 14), 14, ("mean",))
    assert exchanges(stats) <= 4
    assert stats.rdd.getNumPartitions() >= views.events(spark, DIR).count() // 100


def test_padded_windows_exchange_no_cells(spark):
    daily = views.daily(spark, DIR)
    padded = windows.padded_windows(views.labels(spark, DIR), daily, catalogue=daily)
    assert exchanges(padded) <= 6  # none but those of the labels, the roll-up and the catalogue


def test_padded_windows_keep_repeated_rows(spark):
    day = dt.date(2024, 1, 10)
    labels = spark.createDataFrame([(1, day, True)], "pid bigint, label_date date, y boolean")
    daily = spark.createDataFrame([(1, day, "a", 1.0), (1, day, "a", 2.0), (1, day, "b", None), (2, day, "c", 3.0)], "pid bigint, date date, feature string, value double")
    rows = windows.padded_windows(labels, daily, 3, catalogue=daily)
    assert rows.columns == ["pid", "date", "feature", "label_date", "y", "value"]
    n = {f: sorted(((r.date, r.value) for r in rows.collect() if r.feature == f), key=str) for f in "abc"}
    assert [len(n[f]) for f in "abc"] == [4, 3, 3]
    assert [v for _, v in n["a"]] == [1.0, 2.0, None, None] or sorted(v for _, v in n["a"] if v) == [1.0, 2.0]


def test_cut_is_a_compressed_table(spark):
    rows = ordered.cut(spark.range(1000).selectExpr("id", "id % 3 as k"))
    assert rows.count() == 1000 and all(f.endswith(".zstd.parquet") for f in rows.inputFiles())


@pytest.fixture(scope="module")
def memory(spark):
    random = np.random.default_rng(1)
    rows = [("f", p, d, float(random.integers(0, 9))) for p in range(60) for d in range(8) if random.random() < 0.7]
    labels = [(p, p % 3 == 0, p % 5) for p in range(60)]
    return spark.createDataFrame(rows, "feature string, pid bigint, day int, value double"), spark.createDataFrame(labels, "pid bigint, y boolean, fold int")


def test_copies_of_series_are_bounded(spark, memory, monkeypatch):
    """Beside blocks of a few people: as many copies of a series as blocks of the asked, and one block of the others."""
    seen = []
    keep = cf.blocks

    def counted(people, days, least=1):
        made = keep(people, days, least)
        seen.append(made)
        return made

    monkeypatch.setattr(cf, "BLOCK", 2)
    monkeypatch.setattr(cf, "blocks", counted)
    rows, labels = memory
    few = sorted((r.pid, round(r.score, 9)) for r in cf.sim_score(rows, labels).collect())
    asked, others = seen[0]
    assert rows.selectExpr("1L as people", "8 as span").selectExpr("60L as people", "span").select(asked.alias("a"), others.alias("o")).first() == (8, 1)
    monkeypatch.setattr(cf, "CELLS", 100)  # blocks of both sides
    many = sorted((r.pid, round(r.score, 9)) for r in cf.sim_score(rows, labels).collect())
    results = sorted(map(tuple, cf.feature_results(rows, labels).collect()))
    monkeypatch.setattr(cf, "BLOCK", 2048)
    monkeypatch.setattr(cf, "CELLS", 1 << 22)
    assert few == many == sorted((r.pid, round(r.score, 9)) for r in cf.sim_score(rows, labels).collect())
    assert np.allclose([r[1:] for r in results], [r[1:] for r in sorted(map(tuple, cf.feature_results(rows, labels).collect()))])


def test_fill_over_blocks_of_givers(spark, memory, monkeypatch):
    rows, _ = memory
    cells = rows.select("feature", "pid").distinct().crossJoin(rows.select("day").distinct()).join(rows, ["feature", "pid", "day"], "left")
    whole = sorted(map(tuple, scale.cf_impute(cells).collect()))
    monkeypatch.setattr(scale, "PEOPLE", 7)
    monkeypatch.setattr(scale, "CELLS", 100)
    assert sorted(map(tuple, scale.cf_impute(cells).collect())) == whole


def test_frames_across_batches(spark):
    """Each window's frame is whole, also that of a null key, and small frames come to Python in one batch."""
    import pandas as pd
    from pyspark.sql import functions as F

    from tidewell.operators import embed

    rows = spark.range(200).select(F.when(F.col("id") % 7 > 0, F.col("id") % 7).alias("k"), "id")
    total = lambda g: pd.DataFrame({"k": g.k[:1], "n": [len(g)], "total": [g.id.sum()], "start": [int(g.index[0])]})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        made = embed.map_windows(rows, ["k"], total, "k bigint, n bigint, total bigint, start int")
        found = {r.k: (r.n, r.total, r.start) for r in made.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {k or None: (len(range(k, 200, 7)), sum(range(k, 200, 7)), 0) for k in range(7)}
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().executedPlan().toString()
