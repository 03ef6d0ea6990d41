"""The entity-by-day views over the event tables that the queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.streaming.segments import daily_features


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("pid"), F.col("ts"), F.col("event_type").alias("kind"), "value")


#: Events of a partition at most, about: what a task holds does not grow with the table.
EVENTS = 100_000


def by_person(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Rows in partitions of whole participants, so many as ``events`` ask for: roll-ups, labels and windows that
    are made of them need no other exchange."""
    least = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, events.count() // EVENTS + 1), "pid")


def daily(spark: SparkSession, sf_dir: str, segment: str | None = "allday", stats: tuple[str, ...] = ("n", "sum")) -> DataFrame:
    """Long daily features of one segment (None: all)."""
    rows = events(spark, sf_dir)
    return daily_features(by_person(rows, rows), segment, stats)


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pid, ds_key, device``: four data sets of two institutions and two phases."""
    pids = table(spark, sf_dir, "events").select(F.col("user_id").alias("pid")).distinct()
    ds = F.concat_ws("_", F.when(F.col("pid") % 4 < 2, "A").otherwise("B"), (F.col("pid") % 2 * 2 + 1).cast("string"))
    return pids.select("pid", ds.alias("ds_key"), F.when(F.col("pid") % 3 == 0, "android").otherwise("ios").alias("device"))


def labels(spark: SparkSession, sf_dir: str, threshold: float = 50.0) -> DataFrame:
    """``pid, label_date, score, y``: Wednesdays and Sundays, trailing 7-day sum of error values."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("pid"), F.col("ts").cast("date").alias("date"), F.col("event_type").alias("kind"), "value")
    span = e.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    dates = F.broadcast(span).select(F.explode(F.sequence("a", "b")).alias("label_date")).where(F.weekday("label_date").isin(2, 6))
    points = by_person(e.select("pid").distinct(), e).crossJoin(F.broadcast(dates))  # a calendar: a row a day
    errors = by_person(e.where("kind = 'error'"), e).groupBy("pid", "date").agg(F.sum("value").alias("value"))
    gap = F.datediff("label_date", "date")
    # joined by participant alone, whose labels and days are few: the week is no row a day
    week = points.join(errors.withColumnRenamed("pid", "__pid"), (F.col("pid") == F.col("__pid")) & (gap >= 0) & (gap < 7), "left")
    scored = week.groupBy("pid", "label_date").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("score"))
    return scored.withColumn("y", F.round("score", 6) >= threshold)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with data set and device."""
    return labels(spark, sf_dir).join(participants(spark, sf_dir), "pid")


def windows(spark: SparkSession, sf_dir: str, days: int = 28) -> DataFrame:
    from tidewell.operators.windows import label_windows

    return label_windows(labels(spark, sf_dir), daily(spark, sf_dir), days)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, split, y, pred, score`` from quality labels: a fixed rule, for metric queries."""
    rows = table(spark, sf_dir, "labels").where("quality is not null AND toxic is not null")
    score = F.pmod(F.col("doc_id") * 37 + F.col("toxic") * 50, F.lit(101)) / 101.0
    return rows.select("doc_id", (F.col("doc_id") % 4).alias("split"), F.col("quality").alias("y"), score.alias("score"), (score > 0.4).cast("int").alias("pred"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"), "label")
