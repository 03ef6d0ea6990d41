"""Scans and sinks: feature, survey and participant tables, split lists, datapoints and results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where each kind of table lies below a data set's folder.
FOLDERS = {"features": "FeatureData", "surveys": "SurveyData", "participants": "ParticipantsInfoData"}
#: Surveys in the order in which a target is looked up; dep is in the weekly and end-of-term files.
SURVEY_ORDER = ("dep_weekly", "dep_endterm", "ema", "pre", "post")


def dataset_registry(root: str, ds_keys: list[str]) -> dict[str, dict[str, str]]:
    """Folder of each kind of table for each data set key."""
    return {key: {kind: f"{root}/{key}/{folder}" for kind, folder in FOLDERS.items()} for key in ds_keys}


def qualified(pid: Column | str, ds_key: Column | str) -> Column:
    """``pid#ds_key``."""
    return F.concat_ws("#", pid, ds_key)


def scan_csv(spark: SparkSession, path: str, ds_key: str, strings: tuple[str, ...] = ()) -> DataFrame:
    """A CSV table: pid qualified, date a date, columns in ``strings`` text, all others double (NaN: null).

    ``file_pos`` keeps the order of rows in the file, which later rules need.
    """
    raw = spark.read.csv(path, header=True).withColumn("file_pos", F.monotonically_increasing_id())
    quoted = {c: F.col(f"`{c}`") for c in raw.columns}
    casts = {c: F.when(~F.isnan(x.cast("double")), x.cast("double")) for c, x in quoted.items() if c not in ("pid", "date", "file_pos", *strings)}
    out = raw.select(qualified("pid", F.lit(ds_key)).alias("pid"), *([F.to_date("date").alias("date")] if "date" in raw.columns else []), *(casts.get(c, quoted[c]).alias(c) for c in raw.columns if c not in ("pid", "date")))
    return out.withColumn("ds_key", F.lit(ds_key))


def scan_participants(spark: SparkSession, path: str, ds_key: str) -> DataFrame:
    """``pid, device, ds_key``; the first of several platforms counts."""
    rows = scan_csv(spark, path, ds_key, strings=("platform",))
    return rows.select("pid", F.split("platform", ";")[0].alias("device"), "ds_key")


def union_years(parts: list[DataFrame]) -> DataFrame:
    """Tables of several years whose columns differ; a missing column is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def find_survey(surveys: dict[str, DataFrame], target: str, order: tuple[str, ...] = SURVEY_ORDER) -> DataFrame:
    """``pid, date, score, file_pos``: the first survey in order that has the target."""
    for name in order:
        if name in surveys and target in surveys[name].columns:
            return surveys[name].select("pid", "date", F.col(f"`{target}`").alias("score"), "file_pos")
    raise KeyError(target)


def dedupe_last(rows: DataFrame, keys: list[str], order: str = "file_pos") -> DataFrame:
    """The last row of each key in file order."""
    last = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def survey_labels(surveys: dict[str, DataFrame], target: str, thresholds: tuple[float, float] | None = None) -> DataFrame:
    """``pid, date, score, y``: last answer of each day, nulls dropped, binarised by (false, true) thresholds."""
    rows = dedupe_last(find_survey(surveys, target).where("score is not null"), ["pid", "date"])
    y = F.col("score") >= 0.5 if thresholds is None else binarise(F.col("score"), *thresholds)
    return rows.select("pid", "date", "score", y.alias("y"))


def binarise(score: Column, as_false: float, as_true: float) -> Column:
    """True on the far side of ``as_true``, seen from ``as_false``; values between the two are false."""
    if as_false == as_true:
        raise ValueError("equal thresholds give no direction")
    return score >= as_true if as_true > as_false else score <= as_true


def binarise_by(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """The same for a table of ``target, threshold_as_false, threshold_as_true``, one row a target."""
    up = F.col("threshold_as_true") > F.col("threshold_as_false")
    y = F.when(up, F.col("score") >= F.col("threshold_as_true")).otherwise(F.col("score") <= F.col("threshold_as_true"))
    return rows.join(F.broadcast(thresholds), "target").withColumn("y", y)


def read_pid_lists(spark: SparkSession, path: str, fallback: dict[str, str] | None = None) -> DataFrame:
    """``pred_target, ds_key, fold, pid`` of a JSON file {target: {ds: {fold: [pid]}}}.

    ``fallback`` names, for a target without lists, the target whose lists it takes over.
    """
    kind = T.MapType(T.StringType(), T.MapType(T.StringType(), T.MapType(T.StringType(), T.ArrayType(T.StringType()))))
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", kind)).alias("pred_target", "a")).select("pred_target", F.explode("a").alias("ds_key", "b"))
    rows = rows.select("pred_target", "ds_key", F.explode("b").alias("fold", "pids")).select("pred_target", "ds_key", "fold", F.explode("pids").alias("pid"))
    for new, old in (fallback or {}).items():
        rows = rows.union(rows.where(F.col("pred_target") == old).withColumn("pred_target", F.lit(new)))
    return rows


def write_datapoints(datapoints: DataFrame, path: str) -> None:
    datapoints.write.mode("overwrite").partitionBy("pred_target", "ds_key").parquet(path)


def load_datapoints(spark: SparkSession, path: str, targets: list[str], ds_keys: list[str]) -> DataFrame:
    """Only the partitions of these targets and data sets are read."""
    return spark.read.parquet(path).where(F.col("pred_target").isin(targets) & F.col("ds_key").isin(ds_keys))


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").partitionBy("eval_task", "model").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)
