"""Missingness, coverage, pivots, distributions and set operations on long features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.ordered import exact_quantiles
def na_rates(long: DataFrame, by: list[str]) -> DataFrame:
    return long.groupBy(*by).agg(F.avg(F.col("value").isNull().cast("double")).alias("na_rate"), F.count("*").alias("n"))


def kept_features(long: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Features with fewer nulls than ``threshold`` of their rows: for training data only."""
    return na_rates(long, ["feature"]).where(F.col("na_rate") < threshold).select("feature")


def kept_rows(long: DataFrame, keys: list[str], share: float = 0.5) -> DataFrame:
    """Rows (by key) with fewer nulls than ``share`` of their columns."""
    return na_rates(long, keys).where(F.col("na_rate") < share).select(*keys)


def kept_everywhere(long: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Features whose missing rate is below ``threshold`` in every data set."""
    return na_rates(long, ["ds_key", "feature"]).groupBy("feature").agg(F.max("na_rate").alias("worst")).where(F.col("worst") < threshold)


def grid_na_rate(long: DataFrame) -> DataFrame:
    """Missing rate over the whole pid by date grid of each data set and feature, absent rows included."""
    size = long.groupBy("ds_key").agg((F.countDistinct("pid") * F.countDistinct("date")).alias("cells"))
    held = long.groupBy("ds_key", "feature").agg(F.count("value").alias("held"))
    return held.join(F.broadcast(size), "ds_key").select("ds_key", "feature", (1 - F.col("held") / F.col("cells")).alias("na_rate"))


def grid_na_summary(long: DataFrame) -> DataFrame:
    return grid_na_rate(long).groupBy("feature").agg(F.avg("na_rate").alias("mean"), F.stddev_samp("na_rate").alias("std"))


def pivot_days(long: DataFrame, days: list) -> DataFrame:
    """A row for each pid and feature, a column for each of the given days."""
    return long.where(F.col("date").isin(days)).groupBy("pid", "feature").pivot("date", days).agg(F.first("value"))


def trimmed_daily_mean(long: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Daily mean of the values strictly between two percentiles of the feature."""
    edges = exact_quantiles(long, ["feature"], [low, high])
    inside = long.join(F.broadcast(edges), "feature").where((F.col("value") > F.col("edge")[0]) & (F.col("value") < F.col("edge")[1]))
    return inside.groupBy("feature", "date").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


def points_per_pid(points: DataFrame) -> DataFrame:
    """Datapoints and days of a participant: mean and standard deviation by data set."""
    each = points.groupBy("ds_key", "pid").agg(F.count("*").alias("n"), F.countDistinct("date").alias("days"))
    return each.groupBy("ds_key").agg(F.avg("n").alias("mean_n"), F.stddev_samp("n").alias("std_n"), F.avg("days").alias("mean_days"), F.stddev_samp("days").alias("std_days"))


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int, by: list[str]) -> DataFrame:
    """Counts of equal bins from 1; bin 0 lies below, bin ``bins`` + 1 at or above ``high``."""
    return rows.where(F.col(value).isNotNull()).groupBy(*by, F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def kernel_density(rows: DataFrame, value: str, points: list[float], bandwidth: float) -> DataFrame:
    """Gaussian density at given points: one aggregation, no sample is gathered."""
    grid = rows.sparkSession.createDataFrame([(float(p),) for p in points], "point double")
    z = (F.col("point") - F.col(value)) / bandwidth
    return rows.select(value).crossJoin(F.broadcast(grid)).groupBy("point").agg((F.sum(F.exp(-z * z / 2)) / F.count("*") / (bandwidth * (2 * 3.141592653589793) ** 0.5)).alias("density"))


def mean_sem(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"))


def least_groups(rows: DataFrame, label: str, group: str) -> DataFrame:
    """Distinct groups of the class that has fewest."""
    return rows.groupBy(label).agg(F.countDistinct(group).alias("n")).agg(F.min("n").alias("least"))


def class_counts(rows: DataFrame, label: str) -> DataFrame:
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    return counts.withColumn("least", F.min("n").over(Window.partitionBy(F.lit(1))))


def mode_of_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The commonest number of rows of a key; the smallest of several."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("times"))
    return sizes.agg(F.max_by("n", F.struct("times", (-F.col("n")).alias("m"))).alias("mode"))


def merge_folds(results: DataFrame, by: list[str]) -> DataFrame:
    """List by fold and mean of each metric."""
    return results.groupBy(*by, "metric").agg(F.transform(F.array_sort(F.collect_list(F.struct("fold", "value"))), lambda r: r["value"]).alias("values"), F.avg("value").alias("mean"))


def shared(tables: list[DataFrame]) -> DataFrame:
    """Rows that are in every table."""
    return reduce(lambda a, b: a.intersect(b), tables)


def only_in(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of one table that the other lacks."""
    return a.subtract(b)


def in_all_groups(rows: DataFrame, item: str, group: str) -> DataFrame:
    """Items found in every group."""
    total = rows.agg(F.countDistinct(group).alias("total"))
    return rows.groupBy(item).agg(F.countDistinct(group).alias("n")).crossJoin(F.broadcast(total)).where("n = total").select(item)
