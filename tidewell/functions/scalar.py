"""Column functions and the feature-name grammar ``type:name[_norm|_dis]:segment``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed segment names of the feature grammar.
SEGMENTS = ["morning", "afternoon", "evening", "night", "allday", "7dhist", "14dhist", "weekday", "weekend"]
SENTINEL = -10240


def day_key(pid: Column | str, date: Column | str) -> Column:
    """``pid@yyyy-MM-dd``."""
    return F.concat_ws("@", F.col(pid) if isinstance(pid, str) else pid, F.date_format(date, "yyyy-MM-dd"))


def segment_of(ts: Column | str) -> Column:
    """Night 0-6, morning 6-12, afternoon 12-18, evening 18-24."""
    h = F.hour(ts)
    return F.when(h < 6, "night").when(h < 12, "morning").when(h < 18, "afternoon").otherwise("evening")


def feature_parts(feature: Column | str) -> list[Column]:
    """``ftype, name, version, segment``; the version is raw, norm or dis."""
    parts = F.split(feature, ":")
    version = F.when(parts[1].endswith("_norm"), "norm").when(parts[1].endswith("_dis"), "dis").otherwise("raw")
    return [parts[0].alias("ftype"), F.regexp_replace(parts[1], "_(norm|dis)$", "").alias("name"), version.alias("version"), parts[2].alias("segment")]


def feature_name(ftype: Column, name: Column, version: Column, segment: Column) -> Column:
    """The name with another version put in."""
    return F.concat_ws(":", ftype, F.when(version == "raw", name).otherwise(F.concat_ws("_", name, version)), segment)


def feature_catalog(features: DataFrame) -> DataFrame:
    """``feature, ftype, name, version, segment`` of a table with a ``feature`` column."""
    return features.select("feature").distinct().select("feature", *feature_parts("feature"))


def prune(long: DataFrame, families: list[str], version: str | None = None) -> DataFrame:
    """Rows of some feature families, and of one version if given."""
    ftype, _, kind, _ = feature_parts("feature")
    keep = ftype.isin(families)
    return long.where(keep & (kind == version) if version else keep)


def where_in(df: DataFrame, wanted: dict) -> DataFrame:
    """Rows whose columns equal a value or are in a list."""
    for name, value in wanted.items():
        df = df.where(F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return df


def is_weekday(date: Column | str) -> Column:
    return F.weekday(date) < 5


def device_flag(device: Column | str) -> Column:
    return F.when(F.col(device) == "ios", 1).otherwise(0) if isinstance(device, str) else F.when(device == "ios", 1).otherwise(0)


def ordinal(level: Column) -> Column:
    """l, m, h: 1, 2, 3; anything else null."""
    return F.when(level == "l", 1).when(level == "m", 2).when(level == "h", 3)


def one_hot(label: Column, n: int = 2) -> Column:
    return F.array(*(F.when(label == k, 1.0).otherwise(0.0) for k in range(n)))


def study_day(date: Column, start: Column, days: int = 70) -> Column:
    """Days since the start, null outside the first ``days`` days."""
    d = F.datediff(date, start)
    return F.when((d >= 0) & (d < days), d)


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def half_even(x: Column) -> Column:
    return F.bround(x)


def fill_sentinel(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.fill(SENTINEL, columns)


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, kind in df.dtypes if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")]


def row_mean(columns: list[str]) -> Column:
    """Mean of the columns of a row that are not null."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0))
    n = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return F.when(n > 0, total / n)


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson's r as an aggregate over pairs without nulls; null where either side is constant or nothing is left."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    ok = x.isNotNull() & y.isNotNull()
    x, y = F.when(ok, x.cast("double")), F.when(ok, y.cast("double"))
    constant = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
    return F.when(~constant, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def slope_of(x: Column, y: Column, eps: float = 0.0) -> Column:
    """Least-squares slope as an aggregate over pairs without nulls; null if the denominator is 0."""
    ok = x.isNotNull() & y.isNotNull()
    x, y = F.when(ok, x.cast("double")), F.when(ok, y.cast("double"))
    n = F.count(x)
    low = n * F.sum(x * x) - F.sum(x) * F.sum(x) + F.lit(eps)
    return F.when(low != 0, (n * F.sum(x * y) - F.sum(x) * F.sum(y)) / low)
