"""The evaluation of a published pipeline makes its features once."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidewell.plans import published, registry


def test_features_are_made_once(spark):
    table = [(p, f"2024-01-{d:02d}", f"f_{k}:n:allday", float((p * 7 + d * (3 + k)) % 11)) for p in range(12) for d in range(1, 13) for k in range(2)]
    daily = spark.createDataFrame(table, "pid long, date string, feature string, value double").withColumn("date", F.to_date("date"))
    points = [(p, f"2024-01-{d:02d}", bool((p + d) % 2), "A_1", "ios", "train" if d < 12 else "test") for p in range(12) for d in (9, 10, 11, 12)]
    points = spark.createDataFrame(points, "pid long, label_date string, y boolean, ds_key string, device string, role string").withColumn("label_date", F.to_date("label_date"))
    window = points.select("pid", "label_date").join(daily, "pid").where("date <= label_date")
    algorithm, calls = registry.load_algorithm("ml_saeb"), []

    def counted(rows):
        calls.append(rows)
        return published.mean_features(rows)

    found = {r.role: r.n for r in published.evaluate(replace(algorithm, features=counted), window, points).collect()}
    assert found == {"train": 36, "test": 12} and len(calls) == 1
