"""Label-anchored windows over long daily features and what is computed inside them.

Long form throughout: ``pid, date, feature, value`` and labels ``pid, label_date, ...``; a window row has
both. One aggregation then covers any number of features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.scalar import is_weekday, slope_of

POINT = ["pid", "label_date"]


def label_windows(labels: DataFrame, daily: DataFrame, days: int = 28) -> DataFrame:
    """Each label's rows of the ``days`` days that end with its day; labels without any row drop out.

    The join is by participant alone: nothing is spread over days, and a roll-up that lies by participant is
    joined and summed up where it is. The work is a participant's labels times rows.
    """
    own, gap = [c for c in labels.columns if c != "pid"], F.datediff("label_date", "date")
    joined = labels.join(daily, "pid").where((gap >= 0) & (gap < days))
    return joined.select("pid", "date", *own, *(c for c in daily.columns if c not in ("pid", "date")))


def label_windows_by_range(labels: DataFrame, daily: DataFrame, days: int = 28) -> DataFrame:
    """The same as a range join: better when labels are few and windows long."""
    gap = F.datediff("label_date", "date")
    return labels.join(daily, "pid").where((gap >= 0) & (gap < days))


def padded_windows(labels: DataFrame, daily: DataFrame, days: int = 28, catalogue: DataFrame | None = None) -> DataFrame:
    """Exactly ``days`` rows for each label with any row and each feature it has; missing days have a null value.

    With a ``catalogue`` (``feature``, a row a feature) each such label has all of its features.
    """
    own, more = labels.columns, [c for c in daily.columns if c not in ("pid", "date", "feature")]
    held = label_windows(labels, daily, days).groupBy(*own, "feature").agg(F.collect_list(F.struct("date", *more)).alias("__held"))
    if catalogue is not None:  # a label's features stay beside it in a map: no row a day, feature and label is exchanged
        maps = held.groupBy(*own).agg(F.map_from_entries(F.collect_list(F.struct("feature", "__held"))).alias("__map"))
        every = maps.crossJoin(F.broadcast(catalogue.select("feature").distinct()))
        held = every.withColumn("__held", F.coalesce(F.try_element_at("__map", F.col("feature")), F.array().cast(held.schema["__held"].dataType)))
    lacking = F.array_except(F.sequence(F.date_sub("label_date", days - 1), "label_date"), F.col("__held.date"))
    empty = F.transform(lacking, lambda d: F.struct(d.alias("date"), *(F.lit(None).cast(daily.schema[c].dataType).alias(c) for c in more)))
    rows = held.select(*own, "feature", F.explode(F.concat("__held", empty)).alias("__row"))
    return rows.select("pid", "__row.date", "feature", *(c for c in own if c != "pid"), *(f"__row.{c}" for c in more))


def daily_with_labels(daily: DataFrame, labels: DataFrame, dim: DataFrame) -> DataFrame:
    """Daily rows with the label of their day, if any, and the participant's device."""
    return lookup(daily.join(labels.withColumnRenamed("label_date", "date"), ["pid", "date"], "left"), dim)


def lookup(rows: DataFrame, dim: DataFrame) -> DataFrame:
    """Device of each pid; a pid that the dimension lacks is an error when the row is read."""
    joined = rows.join(dim.select("pid", "device"), "pid", "left")
    return joined.withColumn("device", F.coalesce("device", F.raise_error(F.concat(F.lit("no participant "), F.col("pid").cast("string"))).cast("string")))


def only_pids(rows: DataFrame, pids: DataFrame) -> DataFrame:
    return rows.join(pids, "pid", "left_semi")


def without_pids(rows: DataFrame, pids: DataFrame) -> DataFrame:
    return rows.join(pids, "pid", "left_anti")


def min_responses(points: DataFrame, n: int = 2, keys: tuple[str, ...] = ("pid",)) -> DataFrame:
    """Datapoints of participants who have at least ``n``."""
    return points.withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).where(F.col("__n") >= n).drop("__n")


def last_day(window: DataFrame) -> DataFrame:
    return window.where("date = label_date")


def window_stats(window: DataFrame, days: int = 14, stats: tuple[str, ...] = ("mean", "sum", "std", "min", "max"), keep: tuple[str, ...] = ()) -> DataFrame:
    """Statistics of the last ``days`` days by label and feature: mean, sum (0 if empty), std, min, max,
    median, last, slope, mad (mean absolute deviation from the mean), pop_std. Columns of the label in ``keep``
    stay, so that no join has to bring them back."""
    recent = window.where(F.col("date") > F.date_sub("label_date", days))
    x = F.col("value")
    made = {
        "mean": F.avg(x), "sum": F.coalesce(F.sum(x), F.lit(0.0)), "std": F.stddev_samp(x), "pop_std": F.stddev_pop(x), "min": F.min(x), "max": F.max(x),
        "median": F.percentile(x, 0.5), "last": F.max(F.when(F.col("date") == F.col("label_date"), x)), "slope": slope_of(F.datediff("date", F.date_sub("label_date", days - 1)), x, 1e-7),
    }
    keys = [*POINT, *keep, "feature"]
    if "mad" in stats:
        recent = recent.withColumn("__mean", F.avg(x).over(Window.partitionBy(*keys)))
        made["mad"] = F.avg(F.abs(x - F.col("__mean")))
    return recent.groupBy(*keys).agg(*(made[s].alias(s) for s in stats))


def weekday_stats(window: DataFrame) -> DataFrame:
    """Mean and standard deviation on weekdays and on weekends, by label and feature."""
    x, week = F.col("value"), is_weekday("date")
    split = {"weekday": F.when(week, x), "weekend": F.when(~week, x)}
    return window.groupBy(*POINT, "feature").agg(*(f(c).alias(f"{part}_{name}") for part, c in split.items() for name, f in (("mean", F.avg), ("std", F.stddev_samp))))


def first_row(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def day_index(rows: DataFrame) -> DataFrame:
    """Number of each row within its pid by date, from 0."""
    return rows.withColumn("day_index", F.row_number().over(Window.partitionBy("pid").orderBy("date")) - 1)


def window_tensor(window: DataFrame, features: list[str], fill: float = 0.0, days: int = 28) -> DataFrame:
    """``x array<array<double>>`` by label: exactly ``days`` days that end with the label's, by feature.

    Nulls and days without rows are ``fill``. A label without any row has no tensor.
    """
    wide = window.groupBy(*POINT, "date").pivot("feature", features).agg(F.first("value"))
    number = (days - 1 - F.datediff("label_date", "date")).cast("int")
    row = F.struct(number.alias("k"), F.array(*(F.coalesce(F.col(f"`{f}`"), F.lit(fill)) for f in features)).alias("x"))
    held = wide.where((number >= 0) & (number < days)).groupBy(*POINT).agg(F.map_from_entries(F.collect_list(row)).alias("held"))
    empty = F.array(*(F.lit(fill) for _ in features))
    return held.select(*POINT, F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda k: F.coalesce(F.try_element_at("held", k), empty)).alias("x"))


def select_features(tensor: Column, places: list[int]) -> Column:
    """Some features of each day of a tensor."""
    return F.transform(tensor, lambda day: F.array(*(day[k] for k in places)))


def add_channel(tensor: Column) -> Column:
    return F.transform(tensor, lambda day: F.transform(day, lambda x: F.array(x)))


def wide(long: DataFrame, keys: list[str], features: list[str], value: str = "value") -> DataFrame:
    """Long to wide with the list of features given, so no scan looks for them."""
    return long.groupBy(*keys).pivot("feature", features).agg(F.first(value))


def long(wide_rows: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    return wide_rows.unpivot(keys, [F.col(f"`{f}`").alias(f) for f in features], "feature", "value")
