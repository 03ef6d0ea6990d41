"""Day-segment features of an event log, in batch and as streams.

Events: ``pid, ts timestamp, kind, value``. Streams need a ``timestamp`` with time zone; a
``timestamp_ntz`` column is cast in the session's zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.scalar import is_weekday, segment_of


def segmented(events: DataFrame) -> DataFrame:
    """Each event twice: in its segment of the day and in allday."""
    return events.withColumn("date", F.to_date("ts")).withColumn("segment", F.explode(F.array(segment_of("ts"), F.lit("allday"))))


def daily_features(events: DataFrame, segment: str | None = None, stats: tuple[str, ...] = ("n", "sum", "mean", "max")) -> DataFrame:
    """Long ``pid, date, feature, value``: number, sum, mean and greatest value by kind and segment (None: all)."""
    of = {"n": F.count("*").cast("double"), "sum": F.sum("value"), "mean": F.avg("value"), "max": F.max("value")}
    cells = events.withColumn("date", F.to_date("ts")).withColumn("segment", F.lit("allday")) if segment == "allday" else segmented(events)
    cells = cells.where(F.col("segment") == segment) if segment else cells
    stats = [s for s in of if s in stats]
    rolled = cells.groupBy("pid", "date", "kind", "segment").agg(*(of[s].alias(s) for s in stats))
    long = rolled.unpivot(["pid", "date", "kind", "segment"], stats, "stat", "value")
    return long.select("pid", "date", F.concat(F.lit("f_"), "kind", F.lit(":"), "stat", F.lit(":"), "segment").alias("feature"), "value")


def history_features(daily: DataFrame, days: tuple[int, ...] = (7, 14)) -> DataFrame:
    """Mean of the trailing days that have the feature, by day: one window over the day number for each span."""
    n = F.datediff("date", F.lit("1970-01-01").cast("date"))
    own = Window.partitionBy("pid", "feature").orderBy(n)
    return daily.select("pid", "date", "feature", *(F.avg("value").over(own.rangeBetween(1 - d, 0)).alias(f"hist_{d}") for d in days))


def part_of_week(daily: DataFrame) -> DataFrame:
    """Sum of a feature over the weekdays (to Friday) and the weekend (to Sunday) of each week."""
    part = F.when(is_weekday("date"), "weekday").otherwise("weekend")
    return daily.groupBy("pid", "feature", F.to_date(F.date_trunc("week", "date")).alias("week"), part.alias("part")).agg(F.sum("value").alias("value"))


def timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_daily(events: DataFrame, late: str = "1 day") -> DataFrame:
    """The roll-up by tumbling day window: state is one day and what may come late."""
    by_day = timed(events).withWatermark("ts", late).withColumn("segment", F.explode(F.array(segment_of("ts"), F.lit("allday"))))
    return by_day.groupBy(F.window("ts", "1 day"), "pid", "kind", "segment").agg(F.count("*").alias("n"), F.sum("value").alias("sum")).select("pid", F.to_date("window.start").alias("date"), "kind", "segment", "n", "sum")


def stream_history(events: DataFrame, days: int = 14, late: str = "1 day") -> DataFrame:
    """Sums over sliding windows of ``days`` that move by a day; ``date`` is the window's last day."""
    windows = timed(events).withWatermark("ts", late).groupBy(F.window("ts", f"{days} days", "1 day"), "pid", "kind")
    return windows.agg(F.count("*").alias("n"), F.sum("value").alias("sum")).select("pid", F.date_sub(F.to_date("window.end"), 1).alias("date"), "kind", "n", "sum")


def stream_first_answers(surveys: DataFrame, late: str = "1 day") -> DataFrame:
    """The first answer of each pid and date that comes in time; later ones are dropped."""
    return timed(surveys).withWatermark("ts", late).withColumn("date", F.to_date("ts")).dropDuplicatesWithinWatermark(["pid", "date"])


def run_available(stream: DataFrame, path: str) -> DataFrame:
    """Runs a stream over what is there now, appending to Parquet files under ``path``, and reads them.

    Rows come out once their window is past the watermark, so state stays bounded and nothing goes
    through the driver; windows that late events may still change are not in the result. ``path`` also
    holds the checkpoint: a second run goes on where the first one stopped.
    """
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
