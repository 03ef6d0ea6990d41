"""A query for each operator over the given tables, with equivalent SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import scalar
from tidewell.operators import cf, embed, metrics, models, quality, rules, scale, screen, trend, windows
from tidewell.operators.ordered import cut
from tidewell.plans import published, registry, splits, views
from tidewell.sources import io
from tidewell.streaming import segments

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Reals are compared to 6 digits; the small shift moves exact halves off the rounding edge, alike on both sides.
_SQL = {"r": "round(CAST({0} AS DOUBLE) + 3e-9, 6) + 0.0", "i": "CAST({0} AS BIGINT)", "d": "CAST({0} AS DATE)", "s": "CAST({0} AS VARCHAR)", "b": "CAST({0} AS BOOLEAN)"}
_SPARK = {"r": lambda c: F.round(c.cast("double") + 3e-9, 6) + F.lit(0.0), "i": lambda c: c.cast("bigint"), "d": lambda c: c.cast("date"), "s": lambda c: c.cast("string"), "b": lambda c: c.cast("boolean")}

PRELUDE = """
WITH RECURSIVE ev AS (
  SELECT user_id AS pid, ts, CAST(ts AS DATE) AS date, extract('hour' FROM ts) AS hour, event_type AS kind, value FROM events
), seg AS (
  SELECT *, CASE WHEN hour < 6 THEN 'night' WHEN hour < 12 THEN 'morning' WHEN hour < 18 THEN 'afternoon' ELSE 'evening' END AS segment FROM ev
  UNION ALL SELECT *, 'allday' FROM ev
), roll AS (
  SELECT pid, date, kind, segment, CAST(count(*) AS DOUBLE) AS n, sum(value) AS total, avg(value) AS mean, max(value) AS top FROM seg GROUP BY ALL
), feats AS (
  SELECT pid, date, 'f_' || kind || ':n:' || segment AS feature, n AS value FROM roll UNION ALL
  SELECT pid, date, 'f_' || kind || ':sum:' || segment, total FROM roll UNION ALL
  SELECT pid, date, 'f_' || kind || ':mean:' || segment, mean FROM roll UNION ALL
  SELECT pid, date, 'f_' || kind || ':max:' || segment, top FROM roll
), daily AS (
  SELECT * FROM feats WHERE feature LIKE '%:n:allday' OR feature LIKE '%:sum:allday'
), dim AS (
  SELECT DISTINCT pid, (CASE WHEN pid % 4 < 2 THEN 'A' ELSE 'B' END) || '_' || (pid % 2 * 2 + 1) AS ds_key, CASE WHEN pid % 3 = 0 THEN 'android' ELSE 'ios' END AS device FROM ev
), cal AS (
  SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS label_date FROM ev
), lab AS (
  SELECT p.pid, c.label_date, coalesce(sum(e.value), 0) AS score
  FROM (SELECT DISTINCT pid FROM ev) p CROSS JOIN (SELECT * FROM cal WHERE isodow(label_date) IN (3, 7)) c
  LEFT JOIN (SELECT * FROM ev WHERE kind = 'error') e ON e.pid = p.pid AND e.date BETWEEN c.label_date - 6 AND c.label_date
  GROUP BY ALL
), lb AS (
  SELECT *, round(score, 6) >= 50 AS y FROM lab
), pts AS (
  SELECT lb.*, ds_key, device FROM lb JOIN dim USING (pid)
), win AS (
  SELECT lb.*, d.date, d.feature, d.value FROM lb JOIN daily d ON d.pid = lb.pid AND d.date BETWEEN lb.label_date - 27 AND lb.label_date
), long AS (
  SELECT pts.ds_key, daily.* FROM daily JOIN (SELECT DISTINCT pid, ds_key FROM pts) pts USING (pid)
), grid AS (
  SELECT dim.ds_key, dim.pid, c.label_date AS date, f.feature, d.value
  FROM dim CROSS JOIN cal c CROSS JOIN (SELECT DISTINCT feature FROM daily) f
  LEFT JOIN daily d ON d.pid = dim.pid AND d.date = c.label_date AND d.feature = f.feature
), pred AS (
  SELECT doc_id, doc_id % 4 AS split, quality AS y, ((doc_id * 37 + toxic * 50) % 101) / 101.0 AS score, CAST(((doc_id * 37 + toxic * 50) % 101) / 101.0 > 0.4 AS INT) AS pred
  FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL
)
"""


def query(name: str, columns: str, sql: str | None = None) -> Callable:
    """Registers a query; ``columns`` lists kind:name, by which both sides are cast and rounded alike."""
    spec = [c.split(":") for c in columns.split()]

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(spark, sf_dir).select(*(_SPARK[k](F.col(f"`{c}`")).alias(c) for k, c in spec))
        if sql:
            picked = ", ".join(f"{_SQL[k].format(c)} AS {c}" for k, c in spec)
            ORACLE_SQL[name] = f"{PRELUDE} SELECT {picked} FROM ({sql}) q"
        return f

    return add


def _long(s: SparkSession, d: str) -> DataFrame:
    """Daily features with the participant's data set."""
    return views.daily(s, d).join(views.participants(s, d), "pid")


def _grid(s: SparkSession, d: str) -> DataFrame:
    """The same with a null row for each day and feature that a participant lacks."""
    daily = views.daily(s, d)
    span = daily.agg(F.min("date").alias("a"), F.max("date").alias("b")).select(F.explode(F.sequence("a", "b")).alias("date"))
    cells = views.participants(s, d).crossJoin(F.broadcast(span)).crossJoin(F.broadcast(daily.select("feature").distinct()))
    return cells.join(daily, ["pid", "date", "feature"], "left")


def _means(s: SparkSession, d: str) -> DataFrame:
    """``pid, label_date, score, y, feature, value``: means of the last 14 days. The labels' columns go along, so
    that all is made where a participant's rows lie."""
    window = windows.label_windows(views.labels(s, d), views.daily(s, d), 14)
    return windows.window_stats(window, 14, ("mean",), ("score", "y")).withColumnRenamed("mean", "value")


def _labelled(s: SparkSession, d: str) -> DataFrame:
    """Means of the last 14 days by label and feature, with y and data set: the matrix of most models."""
    return _means(s, d).join(views.participants(s, d), "pid")


LABELLED = "SELECT w.pid, w.label_date, feature, avg(value) AS value, pts.y, pts.ds_key, pts.device FROM win w JOIN pts USING (pid, label_date) WHERE date > w.label_date - 14 GROUP BY ALL"


# --- time segments, scans and scalar functions


@query("seg_rollup", "i:pid d:date s:feature r:value", "SELECT * FROM feats")
def _(s, d):
    return segments.daily_features(views.events(s, d))


@query("history_features", "i:pid d:date s:feature r:hist_7 r:hist_14", """
SELECT pid, date, feature, avg(value) OVER (PARTITION BY pid, feature ORDER BY date RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS hist_7,
  avg(value) OVER (PARTITION BY pid, feature ORDER BY date RANGE BETWEEN INTERVAL 13 DAY PRECEDING AND CURRENT ROW) AS hist_14 FROM daily""")
def _(s, d):
    return segments.history_features(views.daily(s, d))


@query("part_of_week", "i:pid s:feature d:week s:part r:value", "SELECT pid, feature, date_trunc('week', date) AS week, CASE WHEN isodow(date) < 6 THEN 'weekday' ELSE 'weekend' END AS part, sum(value) AS value FROM daily GROUP BY ALL")
def _(s, d):
    return segments.part_of_week(views.daily(s, d))


@query("feature_catalog", "s:feature s:ftype s:name s:version s:segment", "SELECT DISTINCT feature, split_part(feature, ':', 1) AS ftype, split_part(feature, ':', 2) AS name, 'raw' AS version, split_part(feature, ':', 3) AS segment FROM feats")
def _(s, d):
    return scalar.feature_catalog(segments.daily_features(views.events(s, d)))


@query("prune_families", "i:pid d:date s:feature r:value", "SELECT * FROM daily WHERE feature LIKE 'f_click:%' OR feature LIKE 'f_view:%'")
def _(s, d):
    return scalar.prune(views.daily(s, d), ["f_click", "f_view"], "raw")


@query("scalar_functions", "i:pid s:qualified s:day_key b:weekday i:device i:level r:clipped i:study_day i:one", """
SELECT pid, pid || '#' || ds_key AS qualified, pid || '@' || strftime(label_date, '%Y-%m-%d') AS day_key, isodow(label_date) < 6 AS weekday, CASE WHEN device = 'ios' THEN 1 ELSE 0 END AS device,
  CASE WHEN score < 20 THEN 1 WHEN score < 60 THEN 2 ELSE 3 END AS level, greatest(-2, least(2, (score - 50) / 20)) AS clipped,
  CASE WHEN label_date - DATE '2024-01-05' BETWEEN 0 AND 69 THEN label_date - DATE '2024-01-05' END AS study_day, CASE WHEN y THEN 1 ELSE 0 END AS one FROM pts""")
def _(s, d):
    p, score = views.points(s, d), F.col("score")
    level = scalar.ordinal(F.when(score < 20, "l").when(score < 60, "m").otherwise("h"))
    start = F.lit("2024-01-05").cast("date")
    return p.select("pid", io.qualified(F.col("pid").cast("string"), "ds_key").alias("qualified"), scalar.day_key(F.col("pid").cast("string"), "label_date").alias("day_key"), scalar.is_weekday("label_date").alias("weekday"), scalar.device_flag("device").alias("device"), level.alias("level"), scalar.clip((score - 50) / 20, -2, 2).alias("clipped"), scalar.study_day(F.col("label_date"), start).alias("study_day"), scalar.one_hot(F.col("y").cast("int"))[1].alias("one"))


@query("scoring_math", "i:vec_id r:sum_abs r:log_norm i:half_even", """
SELECT vec_id, list_sum(list_transform(embedding::DOUBLE[], lambda x: abs(x))) AS sum_abs, ln(1 + list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS log_norm, round_even(CAST(embedding[1] AS DOUBLE) * 2, 0) AS half_even FROM embeddings""")
def _(s, d):
    v = views.table(s, d, "embeddings").withColumn("e", F.col("embedding").cast("array<double>"))
    total = lambda f: F.aggregate(F.transform("e", f), F.lit(0.0), lambda a, b: a + b)
    return v.select("vec_id", total(lambda x: F.abs(x)).alias("sum_abs"), F.log(1 + total(lambda x: F.pow(x, F.lit(2)))).alias("log_norm"), scalar.half_even(F.col("e")[0] * 2).alias("half_even"))


@query("binarize_survey", "i:pid d:label_date r:score b:y", "SELECT pid, label_date, score, y FROM lb")
def _(s, d):
    return views.labels(s, d)


@query("binarize_by_table", "i:c_custkey s:target b:y", """
SELECT c_custkey, target, CASE WHEN t > f THEN score >= t ELSE score <= t END AS y FROM
  (SELECT c_custkey, c_mktsegment AS target, c_acctbal AS score FROM customer) JOIN (VALUES ('BUILDING', 1000, 2000), ('MACHINERY', 3000, 2500)) v(target, f, t) USING (target)""")
def _(s, d):
    th = s.createDataFrame([("BUILDING", 1000.0, 2000.0), ("MACHINERY", 3000.0, 2500.0)], "target string, threshold_as_false double, threshold_as_true double")
    return io.binarise_by(views.table(s, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("target"), F.col("c_acctbal").alias("score")), th)


@query("row_filter", "i:o_orderkey s:o_orderstatus s:o_orderpriority", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def _(s, d):
    return scalar.where_in(views.table(s, d, "orders"), {"o_orderstatus": "F", "o_orderpriority": ["1-URGENT", "2-HIGH"]})


@query("datapoint_store", "s:pred_target s:ds_key i:pid d:label_date b:y", "SELECT 'error' AS pred_target, ds_key, pid, label_date, y FROM pts WHERE ds_key IN ('A_1', 'B_3')")
def _(s, d):
    path = _scratch(s, "datapoints")
    io.write_datapoints(views.points(s, d).withColumn("pred_target", F.lit("error")), path)
    return io.load_datapoints(s, path, ["error"], ["A_1", "B_3"])


def _scratch(s: SparkSession, name: str) -> str:
    """A folder that all executors share."""
    import uuid

    base = s.conf.get("spark.checkpoint.dir", None) or s.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("csv_round_trip", "i:c_custkey s:c_mktsegment r:c_acctbal", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def _(s, d):
    path = _scratch(s, "csv")
    io.write_csv(views.table(s, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), path)
    return io.read_csv(s, path, "c_custkey bigint, c_mktsegment string, c_acctbal double")


def _study_files(s: SparkSession, d: str) -> str:
    """Surveys, participants and participant lists in the layout of the published data, made from the tables."""
    root = _scratch(s, "study")
    c, o = views.table(s, d, "customer"), views.table(s, d, "orders")
    for year in (1, 2):
        own = c.where(F.col("c_custkey") % 2 == year - 1)
        own.select(F.col("c_custkey").alias("pid"), F.when(F.col("c_custkey") % 3 == 0, "android;ios").otherwise("ios").alias("platform")).write.csv(f"{root}/C_{year}/ParticipantsInfoData/platform.csv", header=True)
        answers = o.join(own, o["o_custkey"] == own["c_custkey"]).select(F.col("o_custkey").alias("pid"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_totalprice").alias(f"price.{year}"), F.col("o_orderkey").alias("score_EMA"))
        answers.write.csv(f"{root}/C_{year}/SurveyData/ema.csv", header=True)
    lists = c.groupBy("c_mktsegment", "c_nationkey").agg(F.sort_array(F.collect_list(F.col("c_custkey").cast("string"))).alias("pids"))
    nested = lists.groupBy("c_mktsegment").agg(F.map_from_entries(F.collect_list(F.struct(F.col("c_nationkey").cast("string"), F.create_map(F.lit("all"), "pids")))).alias("m"))
    nested.select("c_mktsegment", F.to_json(F.create_map("c_mktsegment", "m")).alias("value")).write.partitionBy("c_mktsegment").text(f"{root}/pids")  # a file a target
    return root


@query("scan_surveys", "s:pid d:date s:ds_key r:p1 r:p2 r:score", """
SELECT o_custkey || '#C_' || y AS pid, CAST(o_orderdate AS DATE) AS date, 'C_' || y AS ds_key, CASE WHEN y = 1 THEN o_totalprice END AS p1, CASE WHEN y = 2 THEN o_totalprice END AS p2, o_orderkey AS score FROM (SELECT *, o_custkey % 2 + 1 AS y FROM orders)""")
def _(s, d):
    """CSV scan with dotted names, qualified ids, and a union of years whose columns differ."""
    folders = io.dataset_registry(_study_files(s, d), ["C_1", "C_2"])
    both = io.union_years([io.scan_csv(s, f"{folders[k]['surveys']}/ema.csv", k) for k in folders])
    return both.select("pid", "date", "ds_key", F.col("`price.1`").alias("p1"), F.col("`price.2`").alias("p2"), F.col("score_EMA").alias("score"))


@query("scan_participants", "s:pid s:device s:ds_key", "SELECT c_custkey || '#C_' || (c_custkey % 2 + 1) AS pid, CASE WHEN c_custkey % 3 = 0 THEN 'android' ELSE 'ios' END AS device, 'C_' || (c_custkey % 2 + 1) AS ds_key FROM customer")
def _(s, d):
    folders = io.dataset_registry(_study_files(s, d), ["C_1", "C_2"])
    return io.union_years([io.scan_participants(s, f"{folders[k]['participants']}/platform.csv", k) for k in folders])


@query("survey_labels", "s:pid d:date r:score b:y", "SELECT o_custkey || '#C_1' AS pid, CAST(o_orderdate AS DATE) AS date, max(o_orderkey) AS score, max(o_orderkey) >= 20000 AS y FROM orders WHERE o_custkey % 2 = 0 GROUP BY ALL")
def _(s, d):
    """A target looked up in the surveys, one answer a day, binarised."""
    ema = io.scan_csv(s, f"{_study_files(s, d)}/C_1/SurveyData/ema.csv", "C_1")
    # the order of rows in a file that Spark wrote is arbitrary: order keys stand for it
    return io.survey_labels({"ema": ema.withColumn("file_pos", F.col("score_EMA")), "pre": ema.limit(0)}, "score_EMA", (10000.0, 20000.0))


@query("pid_lists", "s:pred_target s:ds_key s:fold s:pid", """
SELECT t AS pred_target, CAST(c_nationkey AS VARCHAR) AS ds_key, 'all' AS fold, CAST(c_custkey AS VARCHAR) AS pid FROM customer, LATERAL (SELECT unnest(CASE WHEN c_mktsegment = 'BUILDING' THEN ['BUILDING', 'HOUSES'] ELSE [c_mktsegment] END) AS t)""")
def _(s, d):
    return io.read_pid_lists(s, f"{_study_files(s, d)}/pids", {"HOUSES": "BUILDING"})


@query("unit_scale", "i:pid d:date s:feature r:value", "SELECT pid, date, feature, value * CASE WHEN feature LIKE '%:sum:%' THEN 0.001 WHEN feature = 'f_click:n:allday' THEN 60 ELSE 1 END AS value FROM daily")
def _(s, d):
    factors = {"f_click:n:allday": 60.0, **{f"f_{k}:sum:allday": 0.001 for k in ("click", "error", "purchase", "signup", "view")}}
    return scale.unit_scale(views.daily(s, d), factors)


@query("days_only_in", "i:pid d:date", "SELECT pid, date FROM ev WHERE kind = 'click' EXCEPT SELECT pid, date FROM ev WHERE kind = 'purchase'")
def _(s, d):
    e = views.events(s, d).withColumn("date", F.to_date("ts"))
    return quality.only_in(*(e.where(F.col("kind") == k).select("pid", "date") for k in ("click", "purchase")))


@query("fill_sentinel", "s:feature r:total", "SELECT feature, sum(coalesce(value, -10240)) AS total FROM grid GROUP BY feature")
def _(s, d):
    return scalar.fill_sentinel(_grid(s, d), ["value"]).groupBy("feature").agg(F.sum("value").alias("total"))


# --- joins and windows


@query("label_window_28", "i:pid d:label_date s:feature i:n r:total", "SELECT pid, label_date, feature, count(*) AS n, sum(value) AS total FROM win GROUP BY ALL")
def _(s, d):
    return views.windows(s, d).groupBy("pid", "label_date", "feature").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("label_window_range", "i:pid d:label_date i:n", "SELECT pid, label_date, count(*) AS n FROM win WHERE date > label_date - 7 GROUP BY ALL")
def _(s, d):
    return windows.label_windows_by_range(views.labels(s, d), views.daily(s, d), 7).groupBy("pid", "label_date").agg(F.count("*").alias("n"))


@query("spine_fill", "i:pid d:label_date s:feature i:days i:held", """
SELECT l.pid, l.label_date, f.feature, 28 AS days, count(w.value) AS held FROM (SELECT DISTINCT pid, label_date FROM win) l CROSS JOIN (SELECT DISTINCT feature FROM daily) f
LEFT JOIN win w ON w.pid = l.pid AND w.label_date = l.label_date AND w.feature = f.feature GROUP BY ALL""")
def _(s, d):
    """Every feature of the catalogue for every label."""
    daily = views.daily(s, d)
    return windows.padded_windows(views.labels(s, d), daily, catalogue=daily).groupBy("pid", "label_date", "feature").agg(F.count("*").alias("days"), F.count("value").alias("held"))


@query("daily_with_labels", "i:pid d:date s:feature r:value b:y s:device", "SELECT d.pid, d.date, feature, value, y, device FROM daily d JOIN dim USING (pid) LEFT JOIN lb ON lb.pid = d.pid AND lb.label_date = d.date")
def _(s, d):
    return windows.daily_with_labels(views.daily(s, d), views.labels(s, d), views.participants(s, d))


@query("semi_anti_pids", "i:pid s:side", "SELECT pid, CASE WHEN device = 'ios' THEN 'in' ELSE 'out' END AS side FROM dim")
def _(s, d):
    people = views.participants(s, d)
    ios = people.where("device = 'ios'")
    return windows.only_pids(people, ios).select("pid", F.lit("in").alias("side")).union(windows.without_pids(people, ios).select("pid", F.lit("out").alias("side")))


@query("min_responses", "i:pid d:label_date", "SELECT pid, label_date FROM lb WHERE score > 100 QUALIFY count(*) OVER (PARTITION BY pid) >= 2")
def _(s, d):
    return windows.min_responses(views.labels(s, d).where("score > 100"))


@query("last_day", "i:pid d:label_date s:feature r:value", "SELECT pid, label_date, feature, value FROM win WHERE date = label_date")
def _(s, d):
    return windows.last_day(views.windows(s, d))


@query("stats14", "i:pid d:label_date s:feature r:mean r:sum r:std r:min r:max r:last", """
SELECT pid, label_date, feature, avg(value) AS mean, sum(value) AS sum, stddev_samp(value) AS std, min(value) AS min, max(value) AS max, max(value) FILTER (WHERE date = label_date) AS last FROM win WHERE date > label_date - 14 GROUP BY ALL""")
def _(s, d):
    return windows.window_stats(views.windows(s, d, 14), 14, ("mean", "sum", "std", "min", "max", "last"))


@query("mad14", "i:pid d:label_date s:feature r:median r:mad r:mean", """
SELECT pid, label_date, feature, quantile_cont(value, 0.5) AS median, avg(abs(value - m)) AS mad, avg(value) AS mean FROM (SELECT *, avg(value) OVER (PARTITION BY pid, label_date, feature) AS m FROM win WHERE date > label_date - 14) GROUP BY ALL""")
def _(s, d):
    return windows.window_stats(views.windows(s, d, 14), 14, ("median", "mad", "mean"))


@query("slope14", "i:pid d:label_date s:feature r:slope r:pop_std", """
SELECT pid, label_date, feature, (count(*) * sum(x * value) - sum(x) * sum(value)) / (count(*) * sum(x * x) - sum(x) * sum(x) + 1e-7) AS slope, stddev_pop(value) AS pop_std
FROM (SELECT *, CAST(date - (label_date - 13) AS DOUBLE) AS x FROM win WHERE date > label_date - 14) GROUP BY ALL""")
def _(s, d):
    return windows.window_stats(views.windows(s, d, 14), 14, ("slope", "pop_std"))


@query("wk_wkend_stats", "i:pid d:label_date s:feature r:weekday_mean r:weekday_std r:weekend_mean r:weekend_std", """
SELECT pid, label_date, feature, avg(value) FILTER (WHERE isodow(date) < 6) AS weekday_mean, stddev_samp(value) FILTER (WHERE isodow(date) < 6) AS weekday_std,
  avg(value) FILTER (WHERE isodow(date) > 5) AS weekend_mean, stddev_samp(value) FILTER (WHERE isodow(date) > 5) AS weekend_std FROM win GROUP BY ALL""")
def _(s, d):
    return windows.weekday_stats(views.windows(s, d))


WEEKS = """
wk AS (
  SELECT pid, label_date, feature, CASE WHEN isodow(date) < 6 THEN 'weekday' ELSE 'weekend' END AS part, CAST(date_trunc('week', date) AS DATE) AS start, avg(value) AS mean FROM win GROUP BY ALL
), wi AS (
  SELECT *, CAST((start - min(start) OVER g) / 7 AS INT) AS week, row_number() OVER (g ORDER BY start) AS i, count(*) OVER g AS n FROM wk WINDOW g AS (PARTITION BY pid, label_date, feature, part)
), wh AS (
  SELECT *, i <= CASE WHEN part = 'weekday' THEN ceil(n / 2.0) ELSE floor(n / 2.0) END AS first FROM wi
)"""


def _weeks_sql(sql: str) -> str:
    return f"WITH {WEEKS} {sql}"


def _ols(x: str, y: str, where: str) -> str:
    x, y = (f"CASE WHEN {where} THEN CAST({v} AS DOUBLE) END" for v in (x, y))
    n = f"count({x})"
    low = f"({n} * sum(({x}) * ({x})) - sum({x}) * sum({x}))"
    return f"CASE WHEN {low} <> 0 THEN ({n} * sum(({x}) * ({y})) - sum({x}) * sum({y})) / {low} END"


@query("iso_week_means", "i:pid d:label_date s:feature s:part d:start r:mean i:week", _weeks_sql("SELECT * FROM wi"))
def _(s, d):
    return trend.week_means(views.windows(s, d))


@query("half_means", "i:pid d:label_date s:feature s:part r:mean_all r:mean_first r:mean_second", _weeks_sql("SELECT pid, label_date, feature, part, avg(mean) AS mean_all, avg(mean) FILTER (WHERE first) AS mean_first, avg(mean) FILTER (WHERE NOT first) AS mean_second FROM wh GROUP BY ALL"))
def _(s, d):
    return trend.half_means(trend.week_means(views.windows(s, d)))


@query("half_slopes", "i:pid d:label_date s:feature s:part r:slope_all r:slope_first r:slope_second", _weeks_sql(f"SELECT pid, label_date, feature, part, {_ols('week', 'mean', 'true')} AS slope_all, {_ols('week', 'mean', 'first')} AS slope_first, {_ols('week', 'mean', 'NOT first')} AS slope_second FROM wh GROUP BY pid, label_date, feature, part"))
def _(s, d):
    return trend.half_slopes(trend.week_means(views.windows(s, d)))


#: Residual of y ~ 1 + x + (x - b)+ for every week b, from centred sums; then the best bend and both slopes.
BENDS = f"""
bp AS (
  SELECT a.pid, a.label_date, a.feature, a.part, CAST(b.week AS DOUBLE) AS b, CAST(a.week AS DOUBLE) AS x, a.mean AS y, greatest(CAST(a.week - b.week AS DOUBLE), 0) AS h FROM wi a JOIN wi b USING (pid, label_date, feature, part)
), bc AS (
  SELECT *, x - avg(x) OVER g AS dx, y - avg(y) OVER g AS dy, h - avg(h) OVER g AS dh FROM bp WINDOW g AS (PARTITION BY pid, label_date, feature, part, b)
), bs AS (
  SELECT pid, label_date, feature, part, b, count(*) AS n, sum(dx * dx) AS xx, sum(dh * dh) AS hh, sum(dx * dh) AS xh, sum(dx * dy) AS xy, sum(dh * dy) AS hy, sum(dy * dy) AS yy FROM bc GROUP BY ALL
), br AS (
  SELECT *, yy - CASE WHEN abs(xx * hh - xh * xh) > 1e-9 THEN (xy * xy * hh - 2 * xy * hy * xh + hy * hy * xx) / (xx * hh - xh * xh) WHEN xx > 0 THEN xy * xy / xx ELSE 0 END AS rest FROM bs
), bb AS (
  SELECT pid, label_date, feature, part, b AS bend FROM br WHERE rest > 1e-10 * yy QUALIFY row_number() OVER (PARTITION BY pid, label_date, feature, part ORDER BY round(n * ln(sqrt(rest) / n) + 3 * ln(n), 6), b) = 1
), bk2 AS (
  SELECT pid, label_date, feature, part, bend, {_ols('week', 'mean', 'week <= bend')} AS slope_before, {_ols('week', 'mean', 'week >= bend')} AS slope_after FROM wi JOIN bb USING (pid, label_date, feature, part) GROUP BY pid, label_date, feature, part, bend
)"""


@query("breakpoint", "i:pid d:label_date s:feature s:part r:bend r:slope_before r:slope_after", f"WITH {WEEKS}, {BENDS} SELECT * FROM bk2")
def _(s, d):
    return trend.breakpoint_slopes(trend.week_means(views.windows(s, d)))


@query("weekly_trends", "i:pid d:label_date s:feature s:part r:mean_all r:mean_first r:mean_second r:slope_all r:slope_first r:slope_second r:bend r:slope_before r:slope_after", f"""
WITH {WEEKS}, {BENDS}, hm AS (
  SELECT pid, label_date, feature, part, avg(mean) AS mean_all, avg(mean) FILTER (WHERE first) AS mean_first, avg(mean) FILTER (WHERE NOT first) AS mean_second,
    {_ols('week', 'mean', 'true')} AS slope_all, {_ols('week', 'mean', 'first')} AS slope_first, {_ols('week', 'mean', 'NOT first')} AS slope_second FROM wh GROUP BY pid, label_date, feature, part
) SELECT * FROM hm LEFT JOIN bk2 USING (pid, label_date, feature, part)""")
def _(s, d):
    return trend.weekly_trends(views.windows(s, d))


_NAMES = [f"f_{k}:{t}:allday" for k in ("click", "error", "purchase", "signup", "view") for t in ("n", "sum")]


@query("window_tensor", "i:pid d:label_date i:days i:wide r:moment", f"""
SELECT pid, label_date, 28 AS days, 10 AS wide, sum(value * (28 - (label_date - date)) * list_position({_NAMES}, feature)) AS moment FROM win GROUP BY ALL""")
def _(s, d):
    t = windows.window_tensor(views.windows(s, d), _NAMES)
    weighted = F.flatten(F.transform(windows.select_features(F.col("x"), list(range(10))), lambda day, i: F.transform(day, lambda v, j: v * (i + 1) * (j + 1))))
    channel = windows.add_channel(F.col("x"))
    return t.select("pid", "label_date", F.size(channel).alias("days"), F.size(channel[0]).alias("wide"), F.aggregate(weighted, F.lit(0.0), lambda a, b: a + b).alias("moment"))


@query("dedupe_last", "i:o_custkey d:o_orderdate i:o_orderkey", "SELECT o_custkey, CAST(o_orderdate AS DATE) AS o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL")
def _(s, d):
    o = views.table(s, d, "orders").withColumn("o_orderdate", F.to_date("o_orderdate"))
    return io.dedupe_last(o, ["o_custkey", "o_orderdate"], "o_orderkey")


@query("first_order", "i:o_custkey i:o_orderkey", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def _(s, d):
    return windows.first_row(views.table(s, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("day_index", "i:pid d:date i:day_index", "SELECT pid, date, row_number() OVER (PARTITION BY pid ORDER BY date) - 1 AS day_index FROM (SELECT DISTINCT pid, date FROM ev)")
def _(s, d):
    return windows.day_index(views.daily(s, d).select("pid", "date").distinct())


# --- quality


@query("na_rates", "s:ds_key s:feature r:na_rate i:n", "SELECT ds_key, feature, avg(CAST(value IS NULL AS DOUBLE)) AS na_rate, count(*) AS n FROM grid GROUP BY ALL")
def _(s, d):
    return quality.na_rates(_grid(s, d), ["ds_key", "feature"])


@query("kept_columns_rows", "i:pid d:date", "SELECT pid, date FROM grid GROUP BY ALL HAVING avg(CAST(value IS NULL AS DOUBLE)) < 0.7")
def _(s, d):
    return quality.kept_rows(_grid(s, d), ["pid", "date"], 0.7)


@query("kept_features", "s:feature", "SELECT feature FROM grid GROUP BY feature HAVING avg(CAST(value IS NULL AS DOUBLE)) < 0.8")
def _(s, d):
    return quality.kept_features(_grid(s, d), 0.8)


@query("kept_everywhere", "s:feature r:worst", "SELECT feature, max(r) AS worst FROM (SELECT ds_key, feature, avg(CAST(value IS NULL AS DOUBLE)) AS r FROM grid GROUP BY ALL) GROUP BY feature HAVING max(r) < 0.9")
def _(s, d):
    return quality.kept_everywhere(_grid(s, d))


@query("na_grid", "s:feature r:mean r:std", """
SELECT feature, avg(r) AS mean, stddev_samp(r) AS std FROM (SELECT l.ds_key, feature, 1 - count(value) / any_value(cells) AS r FROM long l JOIN (SELECT ds_key, count(DISTINCT pid) * count(DISTINCT date) AS cells FROM long GROUP BY ds_key) USING (ds_key) GROUP BY l.ds_key, feature) GROUP BY feature""")
def _(s, d):
    return quality.grid_na_summary(_long(s, d))


@query("pivot_days", "i:pid s:feature r:d1 r:d2", "SELECT pid, feature, max(value) FILTER (WHERE date = DATE '2024-01-10') AS d1, max(value) FILTER (WHERE date = DATE '2024-01-11') AS d2 FROM daily WHERE date IN (DATE '2024-01-10', DATE '2024-01-11') GROUP BY ALL")
def _(s, d):
    import datetime as dt

    days = [dt.date(2024, 1, 10), dt.date(2024, 1, 11)]
    return quality.pivot_days(views.daily(s, d), days).toDF("pid", "feature", "d1", "d2")


@query("trimmed_daily_mean", "s:feature d:date r:mean i:n", "SELECT d.feature, date, avg(value) AS mean, count(*) AS n FROM daily d JOIN (SELECT feature, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM daily GROUP BY feature) q ON q.feature = d.feature AND value > lo AND value < hi GROUP BY ALL")
def _(s, d):
    return quality.trimmed_daily_mean(views.daily(s, d))


@query("points_per_pid", "s:ds_key r:mean_n r:std_n r:mean_days r:std_days", "SELECT ds_key, avg(n) AS mean_n, stddev_samp(n) AS std_n, avg(days) AS mean_days, stddev_samp(days) AS std_days FROM (SELECT ds_key, pid, count(*) AS n, count(DISTINCT date) AS days FROM long GROUP BY ALL) GROUP BY ds_key")
def _(s, d):
    return quality.points_per_pid(_long(s, d))


@query("score_hist", "s:ds_key i:bin i:n", "SELECT ds_key, CASE WHEN score < 0 THEN 0 WHEN score >= 500 THEN 11 ELSE CAST(floor(score / 50) AS INT) + 1 END AS bin, count(*) AS n FROM pts GROUP BY ALL")
def _(s, d):
    # as for y, to 6 digits: a score of 50 is in the bin from 50 on, however its sum came about
    return quality.histogram(views.points(s, d).withColumn("score", F.round("score", 6)), "score", 0.0, 500.0, 10, ["ds_key"])


@query("score_density", "r:point r:density", "SELECT point, sum(exp(-(((point - score) / 25.0) ** 2) / 2)) / count(*) / (25.0 * sqrt(2 * pi())) AS density FROM lb, (VALUES (0.0), (100.0), (200.0)) p(point) GROUP BY point")
def _(s, d):
    return quality.kernel_density(views.labels(s, d), "score", [0.0, 100.0, 200.0], 25.0)


@query("mean_sem", "s:ds_key r:mean r:sem", "SELECT ds_key, avg(score) AS mean, stddev_samp(score) / sqrt(count(*)) AS sem FROM pts GROUP BY ds_key")
def _(s, d):
    return quality.mean_sem(views.points(s, d), "score", ["ds_key"])


@query("least_groups", "i:least", "SELECT min(n) AS least FROM (SELECT y, count(DISTINCT pid) AS n FROM lb GROUP BY y)")
def _(s, d):
    return quality.least_groups(views.labels(s, d), "y", "pid")


@query("class_counts", "b:y i:n i:least", "SELECT y, count(*) AS n, min(count(*)) OVER () AS least FROM lb GROUP BY y")
def _(s, d):
    return quality.class_counts(views.labels(s, d), "y")


@query("mode_of_counts", "i:mode", "SELECT n AS mode FROM (SELECT n, count(*) AS t FROM (SELECT pid, count(*) AS n FROM daily GROUP BY pid) GROUP BY n ORDER BY t DESC, n LIMIT 1)")
def _(s, d):
    return quality.mode_of_counts(views.daily(s, d), ["pid"])


@query("row_mean", "i:pid d:date r:mean", "SELECT pid, date, avg(value) AS mean FROM daily GROUP BY ALL")
def _(s, d):
    columns = [f"c{k}" for k in range(len(_NAMES))]
    wide = windows.wide(views.daily(s, d), ["pid", "date"], _NAMES).toDF("pid", "date", *columns)
    return wide.select("pid", "date", scalar.row_mean(columns).alias("mean"))


@query("wide_and_long", "i:pid d:date s:feature r:value", "SELECT pid, date, feature, value FROM daily")
def _(s, d):
    wide = windows.wide(views.daily(s, d), ["pid", "date"], _NAMES)
    return windows.long(wide, ["pid", "date"], _NAMES).where("value is not null")


@query("merge_folds", "s:metric r:mean i:n", "SELECT 'acc' AS metric, avg(a) AS mean, count(*) AS n FROM (SELECT split, avg(CAST(y = pred AS DOUBLE)) AS a FROM pred GROUP BY split)")
def _(s, d):
    rows = views.predictions(s, d).groupBy(F.col("split").alias("fold")).agg(F.avg((F.col("y") == F.col("pred")).cast("double")).alias("value")).withColumn("metric", F.lit("acc"))
    return quality.merge_folds(rows, []).withColumn("n", F.size("values"))


@query("in_all_datasets", "s:feature", "SELECT feature FROM long GROUP BY feature HAVING count(DISTINCT ds_key) = (SELECT count(DISTINCT ds_key) FROM long)")
def _(s, d):
    return quality.in_all_groups(_long(s, d), "feature", "ds_key")


@query("shared_days", "d:date", "SELECT date FROM ev WHERE kind = 'click' INTERSECT SELECT date FROM ev WHERE kind = 'purchase'")
def _(s, d):
    e = views.events(s, d).withColumn("date", F.to_date("ts"))
    return quality.shared([e.where(F.col("kind") == k).select("date") for k in ("click", "purchase")])


@query("top_k_customers", "s:c_mktsegment i:c_custkey i:rank", "SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer QUALIFY rank <= 5")
def _(s, d):
    w = Window.partitionBy("c_mktsegment").orderBy(F.col("c_acctbal").desc(), "c_custkey")
    return views.table(s, d, "customer").withColumn("rank", F.row_number().over(w)).where("rank <= 5")


# --- normalisation and imputation

_KEYS = "i:pid d:date s:feature"


@query("robust_norm", f"{_KEYS} r:value", """
SELECT d.pid, date, d.feature, greatest(-2, least(2, (value - m) / CASE WHEN hi - lo = 0 THEN 1 ELSE hi - lo END)) AS value FROM daily d
JOIN (SELECT pid, feature, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.95) AS hi FROM daily GROUP BY ALL) q ON q.pid = d.pid AND q.feature = d.feature""")
def _(s, d):
    return scale.robust_norm(views.daily(s, d), ["pid"])


@query("tertiles", f"{_KEYS} s:level", """
SELECT d.pid, date, d.feature, CASE WHEN lo < a AND a < b AND b < hi THEN CASE WHEN value <= a THEN 'l' WHEN value <= b THEN 'm' ELSE 'h' END
  WHEN lo < m AND m < hi THEN CASE WHEN value <= m THEN 'l' ELSE 'h' END ELSE 'm' END AS level FROM daily d
JOIN (SELECT pid, feature, quantile_cont(value, 1/3.0::DOUBLE) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 2/3.0::DOUBLE) AS b, min(value) AS lo, max(value) AS hi FROM daily GROUP BY ALL) q ON q.pid = d.pid AND q.feature = d.feature""")
def _(s, d):
    return scale.tertiles(views.daily(s, d), ["pid"])


@query("robust_unit", f"{_KEYS} r:value", """
SELECT d.pid, date, d.feature, (value - m) / CASE WHEN hi - lo = 0 THEN 1 ELSE (hi - lo) / 3.2897072539029444 END AS value FROM long d
JOIN (SELECT ds_key, feature, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.95) AS hi FROM long GROUP BY ALL) q ON q.ds_key = d.ds_key AND q.feature = d.feature""")
def _(s, d):
    return scale.unit_robust(_long(s, d), ["ds_key"])


@query("impute_mean", f"{_KEYS} r:value", "SELECT pid, date, feature, coalesce(value, avg(value) OVER (PARTITION BY ds_key, feature), 0) AS value FROM grid")
def _(s, d):
    return scale.impute(_grid(s, d), ["ds_key"])


@query("impute_median", f"{_KEYS} r:value", "SELECT g.pid, date, g.feature, coalesce(value, m, 0) AS value FROM grid g JOIN (SELECT pid, feature, quantile_cont(value, 0.5) AS m FROM grid GROUP BY ALL) q ON q.pid = g.pid AND q.feature = g.feature")
def _(s, d):
    return scale.impute(_grid(s, d), ["pid"], "median")


@query("window_norm", "i:pid d:label_date d:date s:feature r:value", """
SELECT w.pid, w.label_date, date, w.feature, greatest(-2, least(2, (value - m) / (hi - lo + 1e-9))) AS value FROM win w
JOIN (SELECT pid, label_date, feature, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.95) AS hi FROM win GROUP BY ALL) q ON q.pid = w.pid AND q.label_date = w.label_date AND q.feature = w.feature""")
def _(s, d):
    return scale.window_norm(views.windows(s, d))


@query("window_norm_standard", "i:pid d:label_date s:feature r:least", "SELECT pid, label_date, feature, (min(value) - avg(value)) / (stddev_pop(value) + 1e-9) AS least FROM win GROUP BY ALL")
def _(s, d):
    return scale.window_norm(views.windows(s, d), "standard").groupBy("pid", "label_date", "feature").agg(F.min("value").alias("least"))


def _model_rows(s: SparkSession, d: str) -> DataFrame:
    """Every datapoint and feature, null where the last 14 days have none."""
    stats = cut(_labelled(s, d).select("pid", "label_date", "feature", "value"))
    cells = views.labels(s, d).select("pid", "label_date").crossJoin(F.broadcast(stats.select("feature").distinct()))
    return cells.join(stats, ["pid", "label_date", "feature"], "left")


@query("prepare_train", "i:pid d:label_date s:feature r:value", f"""
WITH st AS ({LABELLED}), ce AS (SELECT lb.pid, lb.label_date, f.feature, st.value FROM lb CROSS JOIN (SELECT DISTINCT feature FROM st) f LEFT JOIN st ON st.pid = lb.pid AND st.label_date = lb.label_date AND st.feature = f.feature),
c1 AS (SELECT * FROM ce QUALIFY avg(CAST(value IS NULL AS DOUBLE)) OVER (PARTITION BY feature) < 0.9), c2 AS (SELECT * FROM c1 QUALIFY avg(CAST(value IS NULL AS DOUBLE)) OVER (PARTITION BY pid, label_date) < 0.5),
sc AS (SELECT pid, label_date, c2.feature, (value - m) / CASE WHEN hi - lo = 0 THEN 1 ELSE (hi - lo) / 3.2897072539029444 END AS value FROM c2 JOIN (SELECT feature, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.95) AS hi FROM c2 GROUP BY feature) q USING (feature))
SELECT pid, label_date, feature, coalesce(value, avg(value) OVER (PARTITION BY feature), 0) AS value FROM sc""")
def _(s, d):
    return scale.prepare(_model_rows(s, d), "train")


def _levels_by_day(s: SparkSession, d: str) -> DataFrame:
    """Ordinal levels by day on a full grid; people are compared within their data set."""
    first = views.daily(s, d).agg(F.min("date").alias("first"))
    level = F.when(F.col("value") < 20, 1.0).when(F.col("value") < 60, 2.0).when(F.col("value").isNotNull(), 3.0)
    return _grid(s, d).crossJoin(F.broadcast(first)).select(F.concat_ws("/", "ds_key", "feature").alias("feature"), "pid", F.datediff("date", "first").alias("day"), level.alias("value"))


def _cf_sql(least_days: str) -> str:
    """From the published rules: zero-filled series, a constant one with 1e-4 on day 0; no donors give 0, clipped to 1."""
    return f"""
WITH l AS (SELECT ds_key || '/' || feature AS feature, pid, date - (SELECT min(date) FROM daily) AS day, CASE WHEN value < 20 THEN 1 WHEN value < 60 THEN 2 WHEN value IS NOT NULL THEN 3 END AS value FROM grid),
f AS (SELECT feature, pid, day, coalesce(value, 0) + CASE WHEN day = 0 AND min(coalesce(value, 0)) OVER own = max(coalesce(value, 0)) OVER own THEN 1e-4 ELSE 0 END AS v FROM l WINDOW own AS (PARTITION BY feature, pid)),
sim AS (SELECT a.feature, a.pid AS a, b.pid AS b, covar_pop(a.v, b.v) / (stddev_pop(a.v) * stddev_pop(b.v)) AS sim FROM f a JOIN f b ON a.feature = b.feature AND a.day = b.day AND a.pid <> b.pid GROUP BY ALL),
g AS (SELECT m.feature, m.day, m.pid, sum(sim * dn.value) / (sum(sim) + 1e-4) AS guess FROM l m JOIN l dn ON m.value IS NULL AND dn.value IS NOT NULL AND m.feature = dn.feature AND m.day = dn.day JOIN sim ON sim.feature = m.feature AND a = m.pid AND b = dn.pid GROUP BY ALL),
dense AS (SELECT feature, count(*) FILTER (WHERE na < 0.75) > count(*) * {least_days} AS dense FROM (SELECT feature, day, avg(CAST(value IS NULL AS INT)) AS na FROM l GROUP BY ALL) GROUP BY feature),
r AS (SELECT l.feature, l.pid, l.day, dense, CASE WHEN dense THEN coalesce(l.value, greatest(1, least(3, round_even(coalesce(guess, 0), 0)))) ELSE coalesce(l.value, 0) END AS value FROM l JOIN dense USING (feature) LEFT JOIN g ON g.feature = l.feature AND g.day = l.day AND g.pid = l.pid)
SELECT feature, pid, day, value + CASE WHEN dense AND day = 0 AND min(value) OVER own = max(value) OVER own THEN 1e-4 ELSE 0 END AS value FROM r WINDOW own AS (PARTITION BY feature, pid)"""


@query("cf_impute", "s:feature i:pid i:day r:value", _cf_sql("-1"))
def _(s, d):
    return scale.cf_impute(_levels_by_day(s, d))


@query("cf_impute_test", "s:feature i:pid i:day r:value", _cf_sql("0.5"))
def _(s, d):
    """As for a test set: features that are empty on most days are filled with 0."""
    return scale.cf_impute(_levels_by_day(s, d), least_days=0.5)


# --- splits


@query("within_user_split", "i:pid d:label_date s:role", "SELECT pid, label_date, CASE WHEN row_number() OVER (PARTITION BY pid ORDER BY label_date DESC) <= ceil(count(*) OVER (PARTITION BY pid) * 0.2) THEN 'test' ELSE 'train' END AS role FROM lb")
def _(s, d):
    return splits.within_user(views.labels(s, d))


@query("one_validation_row", "i:pid d:label_date b:validation b:train", """
SELECT pid, label_date, i = 1 AS validation, i > 1 OR n = 1 AS train FROM (
  SELECT pid, label_date, count(*) OVER (PARTITION BY pid) AS n, row_number() OVER (PARTITION BY pid ORDER BY ((label_date - DATE '1970-01-01') * 7919 + pid * 31) % 1009, label_date) AS i FROM lb)""")
def _(s, d):
    return splits.one_validation_row(views.labels(s, d))


def _shuffled(seed: str = "0") -> str:
    return f"(pid * 7919 + {seed} * 104729) % 1009"


@query("group_fold", "i:pid i:fold", f"""
SELECT pid, CASE WHEN t < 5 THEN t ELSE 9 - t END AS fold FROM (
  SELECT pid, (row_number() OVER (ORDER BY p DESC, n DESC, {_shuffled()}, pid) - 1) % 10 AS t FROM (SELECT pid, count(*) AS n, sum(CAST(y AS INT)) AS p FROM lb GROUP BY pid))""")
def _(s, d):
    return splits.group_folds(views.labels(s, d), "pid", 5, 0, "y")


@query("fold_check", "i:fold i:train_rows i:train_positives b:one_class", f"""
WITH fo AS (SELECT fold, count(*) AS n, sum(CAST(y AS INT)) AS p FROM lb JOIN (SELECT pid, CASE WHEN t < 5 THEN t ELSE 9 - t END AS fold FROM (
  SELECT pid, (row_number() OVER (ORDER BY p DESC, n DESC, {_shuffled()}, pid) - 1) % 10 AS t FROM (SELECT pid, count(*) AS n, sum(CAST(y AS INT)) AS p FROM lb GROUP BY pid))) USING (pid) GROUP BY fold)
SELECT fold, sum(n) OVER () - n AS train_rows, sum(p) OVER () - p AS train_positives, sum(p) OVER () - p IN (0, sum(n) OVER () - n) AS one_class FROM fo""")
def _(s, d):
    p = views.labels(s, d)
    return splits.fold_classes(p.join(splits.group_folds(p, "pid", 5, 0, "y"), "pid"), "y")


_PAIRS = "SELECT a.ds_key AS ka, b.ds_key AS kb, split_part(a.ds_key, '_', 1) = split_part(b.ds_key, '_', 1) AS inst, split_part(a.ds_key, '_', 2) = split_part(b.ds_key, '_', 2) AS phase FROM (SELECT DISTINCT ds_key FROM dim) a, (SELECT DISTINCT ds_key FROM dim) b"
_PLAN = "s:split_id s:role s:ds_key i:pid"


@query("one_each_plan", _PLAN, f"SELECT ka || '>' || kb AS split_id, role, ds_key, pid FROM (SELECT ka, kb, 'train' AS role, ka AS ds_key FROM ({_PAIRS}) WHERE ka <> kb UNION ALL SELECT ka, kb, 'test', kb FROM ({_PAIRS}) WHERE ka <> kb) JOIN dim USING (ds_key)")
def _(s, d):
    return splits.split_plan("one_each", views.points(s, d))


@query("allbutone_plan", _PLAN, f"SELECT ka AS split_id, CASE WHEN ka = kb THEN 'test' ELSE 'train' END AS role, ds_key, pid FROM ({_PAIRS}) JOIN dim ON kb = ds_key")
def _(s, d):
    return splits.split_plan("allbutone", views.points(s, d))


def _pair_plan(rule: str) -> str:
    return f"SELECT ka || ':' || kb AS split_id, CASE WHEN ds_key IN (ka, kb) THEN 'test' ELSE 'train' END AS role, ds_key, pid FROM ({_PAIRS}) CROSS JOIN dim WHERE ka < kb AND ({rule})"


@query("crossgroup_plan", _PLAN, _pair_plan("inst OR phase"))
def _(s, d):
    return splits.split_plan("crossgroup", views.points(s, d))


@query("crossperiod_plan", _PLAN, _pair_plan("(CAST(split_part(ka, '_', 2) AS INT) < 2.5) = (CAST(split_part(kb, '_', 2) AS INT) < 2.5)"))
def _(s, d):
    return splits.split_plan("crossperiod", views.points(s, d))


def _two_years(s: SparkSession, d: str) -> DataFrame:
    """Customers as participants: those of even keys took part in two years of their institution."""
    c = views.table(s, d, "customer").select(F.col("c_custkey").alias("pid"))
    years = F.explode(F.when(F.col("pid") % 2 == 0, F.array(F.lit("1"), F.lit("2"))).otherwise(F.array(F.lit("1"))))
    return c.select("pid", years.alias("y")).select("pid", F.concat(F.lit("C_"), "y").alias("ds_key"))


@query("overlap_plan", _PLAN, """
SELECT ka || '>' || kb AS split_id, role, ds_key, c_custkey AS pid FROM (VALUES ('C_1', 'C_2', 'train', 'C_1'), ('C_1', 'C_2', 'test', 'C_2'), ('C_2', 'C_1', 'train', 'C_2'), ('C_2', 'C_1', 'test', 'C_1')) v(ka, kb, role, ds_key) CROSS JOIN customer WHERE c_custkey % 2 = 0""")
def _(s, d):
    return splits.split_plan("overlap", _two_years(s, d))


@query("single_cv_plan", _PLAN, """
SELECT ds_key || '/' || repeat || '/' || t AS split_id, CASE WHEN fold = t THEN 'test' ELSE 'train' END AS role, ds_key, pid FROM (
  SELECT ds_key, pid, repeat, (row_number() OVER (PARTITION BY ds_key, repeat ORDER BY (pid * 7919 + repeat * 104729) % 1009, pid) - 1) % 5 AS fold FROM dim, range(2) r(repeat)), range(5) f(t)""")
def _(s, d):
    return splits.split_plan("single", views.points(s, d))


@query("pid_split", "i:pid d:label_date s:role", f"""
SELECT pid, label_date, CASE WHEN i <= floor(n * 0.2) THEN 'test' ELSE 'train' END AS role FROM lb JOIN (SELECT pid, row_number() OVER (PARTITION BY ds_key ORDER BY {_shuffled()}, pid) AS i, count(*) OVER (PARTITION BY ds_key) AS n FROM dim) USING (pid)""")
def _(s, d):
    return splits.pid_split(views.points(s, d))


@query("learning_curve", "r:fraction i:repeat s:ds_key i:pid", """
SELECT fraction, repeat, ds_key, pid FROM (SELECT fraction, repeat, ds_key, pid, row_number() OVER (PARTITION BY ds_key, fraction, repeat ORDER BY (pid * 7919 + repeat * 104729) % 1009, pid) AS i, count(*) OVER (PARTITION BY ds_key, fraction, repeat) AS n
FROM dim, (VALUES (0.1), (0.5)) f(fraction), range(2) r(repeat)) WHERE i <= ceil(round(CAST(fraction AS DOUBLE) * n, 9))""")
def _(s, d):
    return splits.learning_curve(views.points(s, d), [0.1, 0.5], 2)


@query("mining_holdout", "i:pid b:mining", f"SELECT pid, row_number() OVER (ORDER BY {_shuffled()}, pid) <= floor(count(*) OVER () * 0.35) AS mining FROM dim")
def _(s, d):
    return splits.mining_holdout(views.points(s, d))


@query("oversample", "i:pid d:label_date b:y i:copy", """
SELECT pid, label_date, y, unnest(range(1, CAST(most // n + CASE WHEN i < most % n THEN 1 ELSE 0 END + 1 AS BIGINT))) AS copy FROM (
  SELECT *, row_number() OVER (PARTITION BY y ORDER BY pid, label_date) - 1 AS i, count(*) OVER (PARTITION BY y) AS n, greatest((SELECT count(*) FROM lb WHERE y), (SELECT count(*) FROM lb WHERE NOT y)) AS most FROM lb)""")
def _(s, d):
    return splits.oversample(views.labels(s, d), "y", ["pid", "label_date"])


@query("smote", "i:label i:n i:dims", "SELECT label, (SELECT max(n) FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)) - count(*) AS n, 64 AS dims FROM embeddings GROUP BY label HAVING n > 0")
def _(s, d):
    v = views.vectors(s, d).withColumn("x", F.col("x").cast("array<double>"))
    return splits.smote(v, "label", "id", "x").groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dims"))


# --- metrics


@query("binary_report", "i:split i:tp i:fn i:fp i:tn r:acc r:balanced_acc r:precision r:recall r:f1 r:f1_neg r:mcc r:kappa", """
SELECT *, (tp + tn) / n AS acc, (re + sp) / 2 AS balanced_acc, pr AS precision, re AS recall, CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END AS f1, CASE WHEN npv + sp = 0 THEN 0 ELSE 2 * npv * sp / (npv + sp) END AS f1_neg,
  CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 1 ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END AS mcc, CASE WHEN pe = 1 THEN 1 ELSE ((tp + tn) / n - pe) / (1 - pe) END AS kappa
FROM (SELECT *, CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp) END AS pr, CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn) END AS re, CASE WHEN tn + fp = 0 THEN 1 ELSE tn / (tn + fp) END AS sp, CASE WHEN tn + fn = 0 THEN 1 ELSE tn / (tn + fn) END AS npv, ((tp + fp) * (tp + fn) + (tn + fp) * (tn + fn)) / (n * n) AS pe
  FROM (SELECT split, CAST(sum(CAST(y = 1 AND pred = 1 AS INT)) AS DOUBLE) AS tp, CAST(sum(CAST(y = 1 AND pred = 0 AS INT)) AS DOUBLE) AS fn, CAST(sum(CAST(y = 0 AND pred = 1 AS INT)) AS DOUBLE) AS fp, CAST(sum(CAST(y = 0 AND pred = 0 AS INT)) AS DOUBLE) AS tn, CAST(count(*) AS DOUBLE) AS n FROM pred GROUP BY split))""")
def _(s, d):
    return metrics.binary_report(views.predictions(s, d), ["split"])


@query("auc_rank", "i:split r:auc", """
SELECT split, CASE WHEN p = 0 OR p = n THEN (CASE WHEN p = 0 THEN 1 ELSE sum(CAST(y = 1 AND pred = 1 AS INT)) / p END + CASE WHEN p = n THEN 1 ELSE sum(CAST(y = 0 AND pred = 0 AS INT)) / (n - p) END) / 2
  ELSE (sum(CASE WHEN y = 1 THEN r END) - p * (p + 1) / 2) / (p * (n - p)) END AS auc FROM (
  SELECT split, y, pred, rank() OVER (PARTITION BY split ORDER BY score) + (count(*) OVER (PARTITION BY split, score) - 1) / 2.0 AS r, CAST(sum(y) OVER (PARTITION BY split) AS DOUBLE) AS p, count(*) OVER (PARTITION BY split) AS n FROM pred) GROUP BY split, p, n""")
def _(s, d):
    return metrics.auc(views.predictions(s, d), ["split"])


@query("multiclass_report", "i:split i:class i:support r:precision r:recall r:f1 r:acc r:macro_precision r:macro_recall r:macro_f1 r:weighted_precision r:weighted_recall r:weighted_f1", """
SELECT split, class, support, pr AS precision, re AS recall, f1, acc, avg(pr) OVER s AS macro_precision, avg(re) OVER s AS macro_recall, avg(f1) OVER s AS macro_f1,
  sum(pr * support) OVER s / sum(support) OVER s AS weighted_precision, sum(re * support) OVER s / sum(support) OVER s AS weighted_recall, sum(f1 * support) OVER s / sum(support) OVER s AS weighted_f1 FROM (SELECT *, CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END AS f1 FROM (
  SELECT p.split, class, count(*) FILTER (WHERE y = class) AS support, CASE WHEN count(*) FILTER (WHERE pred = class) = 0 THEN 1 ELSE count(*) FILTER (WHERE y = class AND pred = class) / count(*) FILTER (WHERE pred = class) END AS pr,
    CASE WHEN count(*) FILTER (WHERE y = class) = 0 THEN 1 ELSE count(*) FILTER (WHERE y = class AND pred = class) / count(*) FILTER (WHERE y = class) END AS re, avg(CAST((y = class) = (pred = class) AS DOUBLE)) AS acc FROM pred p, (VALUES (0), (1)) c(class) GROUP BY ALL)) WINDOW s AS (PARTITION BY split)""")
def _(s, d):
    return metrics.multiclass_report(views.predictions(s, d), ["split"])


@query("one_vs_rest_auc", "i:split i:class r:auc r:macro_auc r:weighted_auc", """
WITH l AS (SELECT vec_id % 3 AS split, c AS class, round(embedding[c + 1]::DOUBLE, 3) AS score, label = c AS own FROM embeddings, range(10) r(c) WHERE label IS NOT NULL AND embedding IS NOT NULL),
a AS (SELECT split, class, sum(CASE WHEN own THEN r ELSE 0 END) AS ranks, count(*) FILTER (WHERE own) AS p, count(*) FILTER (WHERE NOT own) AS q FROM (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY split, class, score) - 1) / 2 AS r FROM l WINDOW w AS (PARTITION BY split, class ORDER BY score)) GROUP BY ALL),
u AS (SELECT split, class, p, CASE WHEN p > 0 AND q > 0 THEN (ranks - p * (p + 1) / 2) / (CAST(p AS DOUBLE) * q) END AS auc FROM a)
SELECT split, class, auc, avg(auc) OVER s AS macro_auc, sum(auc * p) OVER s / sum(CASE WHEN auc IS NOT NULL THEN p END) OVER s AS weighted_auc FROM u WINDOW s AS (PARTITION BY split)""")
def _(s, d):
    """A vector's first ten components as scores of the ten classes."""
    v = views.vectors(s, d).where("label is not null and x is not null")
    scores = F.array(*(F.struct(F.lit(c).alias("class"), F.round(F.col("x")[c].cast("double"), 3).alias("score")) for c in range(10)))
    return metrics.one_vs_rest_auc(v.select((F.col("id") % 3).alias("split"), F.col("label").alias("y"), scores.alias("scores")), ["split"])


@query("log_likelihood", "i:split r:log_likelihood", "SELECT split, sum(CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END) AS log_likelihood FROM (SELECT *, greatest(1e-15, least(1 - 1e-15, CAST(score AS DOUBLE))) AS p FROM pred) GROUP BY split")
def _(s, d):
    return metrics.log_likelihood(views.predictions(s, d), ["split"])


@query("best_threshold", "i:split r:threshold r:balanced_acc", """
SELECT split, score AS threshold, ba AS balanced_acc FROM (SELECT t.split, t.score, round((avg(CASE WHEN y = 1 THEN CAST(p.score >= t.score AS DOUBLE) END) + avg(CASE WHEN y = 0 THEN CAST(p.score < t.score AS DOUBLE) END)) / 2, 9) AS ba FROM (SELECT DISTINCT split, score FROM pred) t JOIN pred p USING (split) GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY split ORDER BY ba DESC, score DESC) = 1""")
def _(s, d):
    return metrics.best_threshold(views.predictions(s, d), ["split"])


def _history(s: SparkSession, d: str) -> DataFrame:
    """Days as epochs of a model for each event kind: the mean value is the loss, the greatest the metric."""
    e = views.events(s, d)
    return e.groupBy(F.col("kind").alias("model"), (F.dayofmonth("ts") - 1).alias("epoch")).agg(F.round(F.avg("value"), 6).alias("loss"), F.round(F.max("value"), 6).alias("metric"))


_HISTORY = "SELECT kind AS model, day(date) - 1 AS epoch, round(avg(value), 6) AS loss, round(max(value), 6) AS metric FROM ev GROUP BY ALL"


@query("best_epoch", "s:model i:epoch r:loss", f"SELECT * FROM ({_HISTORY}) QUALIFY row_number() OVER (PARTITION BY model ORDER BY loss, epoch) = 1")
def _(s, d):
    return metrics.best_row(_history(s, d), "loss")


@query("running_best", "s:model i:epoch r:metric", f"""
SELECT model, epoch, metric FROM (SELECT model, min(epoch) AS epoch, any_value(metric) AS metric FROM (SELECT * FROM ({_HISTORY}) QUALIFY loss > coalesce(max(loss) OVER (PARTITION BY model ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e300)) GROUP BY model, epoch)
QUALIFY row_number() OVER (PARTITION BY model ORDER BY metric DESC, epoch) = 1""")
def _(s, d):
    return metrics.running_best(_history(s, d), "loss", "metric")


def _results(s: SparkSession, d: str) -> DataFrame:
    o = views.table(s, d, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("ds_test")).agg(F.avg("o_totalprice").alias("value")).withColumn("metric", F.lit("price"))


@query("results_pivot", "s:model r:f r:o r:average r:sem", """
SELECT model, max(v) FILTER (WHERE ds = 'F') AS f, max(v) FILTER (WHERE ds = 'O') AS o, avg(v) AS average, stddev_samp(v) / sqrt(count(v)) AS sem FROM (SELECT o_orderpriority AS model, o_orderstatus AS ds, avg(o_totalprice) AS v FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL) GROUP BY model""")
def _(s, d):
    return metrics.results_pivot(_results(s, d), "price", ["F", "O"]).withColumnsRenamed({"F": "f", "O": "o"})


@query("result_store", "s:eval_task s:model s:ds_test r:value", "SELECT 'orders' AS eval_task, o_orderpriority AS model, o_orderstatus AS ds_test, avg(o_totalprice) AS value FROM orders GROUP BY ALL")
def _(s, d):
    path = _scratch(s, "results")
    io.write_results(_results(s, d).withColumn("eval_task", F.lit("orders")), path)
    return io.read_results(s, path)


@query("model_order", "s:model r:mean r:std", "SELECT o_orderpriority AS model, avg(v) AS mean, stddev_samp(v) AS std FROM (SELECT o_orderpriority, o_orderstatus, avg(o_totalprice) AS v FROM orders GROUP BY ALL) GROUP BY ALL")
def _(s, d):
    return metrics.model_order(_results(s, d), "price")


# --- screens


@query("corr_screen", "s:ds_key s:feature r:r i:n", f"SELECT ds_key, feature, corr(value, CAST(y AS INT)) AS r, count(*) AS n FROM ({LABELLED}) GROUP BY ALL HAVING abs(r) > 0.05")
def _(s, d):
    return screen.corr_screen(_labelled(s, d).withColumn("y", F.col("y").cast("int")), ["ds_key"])


def _ranked(by: str) -> str:
    """SQL of rank correlations by ``by`` and feature."""
    return f"""SELECT {by}feature, corr(rx, ry) AS rho, count(*) AS n FROM (SELECT {by}feature, rank() OVER (PARTITION BY {by}feature ORDER BY value) + (count(*) OVER (PARTITION BY {by}feature, value) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY {by}feature ORDER BY y) + (count(*) OVER (PARTITION BY {by}feature, y) - 1) / 2.0 AS ry FROM (SELECT * REPLACE (round(value, 9) AS value) FROM ({LABELLED}))) GROUP BY ALL"""


_RANKED, _POOLED = _ranked("ds_key, "), _ranked("")


def _spearman(s: SparkSession, d: str) -> DataFrame:
    rows = _labelled(s, d).withColumn("y", F.col("y").cast("int")).withColumn("value", F.round("value", 9))
    return screen.spearman(rows, ["ds_key"])


@query("spearman", "s:ds_key s:feature r:rho i:n", _RANKED)
def _(s, d):
    return _spearman(s, d)


_P = """SELECT *, CASE WHEN abs(rho) >= 1 THEN 0 ELSE 2 * (exp(-z * z / 2) / 2.5066282746310002 * k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))) END AS p
FROM (SELECT *, 1 / (1 + 0.2316419 * z) AS k FROM (SELECT *, (8 * df + 1) / (8 * df + 3) * sqrt(df * ln(1 + rho * rho / (1 - rho * rho))) AS z FROM (SELECT *, CAST(n - 2 AS DOUBLE) AS df FROM r) WHERE df > 0 AND NOT isnan(rho)))"""


@query("significant", "s:ds_key s:feature r:rho r:p", f"WITH r AS ({_RANKED}) SELECT * FROM ({_P}) WHERE p <= 0.05")
def _(s, d):
    return screen.significant(_spearman(s, d))


@query("sign_consistency", "s:feature r:mean_rho b:same_sign i:n_sets r:pooled_rho", f"SELECT a.*, b.rho AS pooled_rho FROM (SELECT feature, avg(rho) AS mean_rho, min(sign(rho)) = max(sign(rho)) AS same_sign, count(*) AS n_sets FROM ({_RANKED}) GROUP BY feature) a JOIN ({_POOLED}) b USING (feature)")
def _(s, d):
    rows = cut(_labelled(s, d).withColumn("y", F.col("y").cast("int")).withColumn("value", F.round("value", 9)).select("ds_key", "feature", "value", "y"))
    return screen.sign_consistency(screen.spearman(rows, ["ds_key"]), screen.spearman(rows, []))


@query("sign_flip", "s:feature r:pre r:post r:product", f"SELECT *, pre * post AS product FROM (SELECT feature, avg(rho) FILTER (WHERE ds_key LIKE '%_1') AS pre, avg(rho) FILTER (WHERE ds_key LIKE '%_3') AS post FROM ({_RANKED}) GROUP BY feature) WHERE pre * post < 0")
def _(s, d):
    rho = _spearman(s, d)
    return screen.sign_flip(rho.where("ds_key LIKE '%_1'"), rho.where("ds_key LIKE '%_3'"))


@query("binned_mi", "s:feature r:mi", f"""
SELECT feature, sum(c / t * ln(c * t / (r * k))) AS mi FROM (SELECT *, sum(c) OVER (PARTITION BY feature) AS t, sum(c) OVER (PARTITION BY feature, bin) AS r, sum(c) OVER (PARTITION BY feature, y) AS k FROM (
  SELECT feature, bin, y, CAST(count(*) AS DOUBLE) AS c FROM (SELECT feature, y, ((rank() OVER (PARTITION BY feature ORDER BY value) - 1) * 5) // count(*) OVER (PARTITION BY feature) AS bin FROM (SELECT * REPLACE (round(value, 9) AS value) FROM ({LABELLED}))) GROUP BY ALL)) GROUP BY feature""")
def _(s, d):
    return screen.binned_mi(_labelled(s, d).withColumn("value", F.round("value", 9)))


def _psi(n: str) -> str:
    x = f"({n} + 10.0)"
    return f"(ln({x}) - 1 / (2 * {x}) - 1 / (12 * {x} ** 2) + 1 / (120 * {x} ** 4) - 1 / (252 * {x} ** 6) - ({' + '.join(f'1 / ({n} + {k}.0)' for k in range(10))}))"


@query("neighbour_mi", "s:feature r:mi", f"""
WITH r AS (SELECT feature, pid, label_date, y, floor(value * 1024) / 1024 AS x, count(*) OVER (PARTITION BY feature, y) AS size FROM ({LABELLED}) WHERE value IS NOT NULL),
g AS (SELECT a.feature, a.pid, a.label_date, any_value(a.size) AS size, list_sort(list(abs(a.x - b.x)) FILTER (WHERE a.y = b.y AND (a.pid <> b.pid OR a.label_date <> b.label_date))) AS near, list(abs(a.x - b.x)) AS far FROM (SELECT * FROM r WHERE size > 1) a JOIN (SELECT * FROM r WHERE size > 1) b ON a.feature = b.feature GROUP BY ALL),
k AS (SELECT feature, size, least(3, size - 1) AS k, near[least(3, size - 1)] AS rad, far FROM g),
m AS (SELECT feature, size, k, len(list_filter(far, lambda t: t < rad OR (rad = 0 AND t = 0))) AS m FROM k)
SELECT feature, greatest(0, {_psi('count(*)')} + avg({_psi('k')}) - avg({_psi('size')}) - avg({_psi('m')})) AS mi FROM m GROUP BY feature""")
def _(s, d):
    rows = _labelled(s, d).withColumn("value", F.floor(F.col("value") * 1024) / 1024)
    return screen.neighbour_mi(rows, ["feature"], ["pid", "label_date"])


@query("mi_screen", "s:feature")
def _(s, d):
    """All features of all day segments over 30 rounds; ten stay at least."""
    window = windows.label_windows(views.labels(s, d), views.daily(s, d, None, ("n", "sum", "mean", "max")), 14)
    means = windows.window_stats(window, 14, ("mean",)).select("pid", "label_date", "feature", F.col("mean").alias("value"))
    return screen.mi_screen(means.join(views.labels(s, d).select("pid", "label_date", "y"), ["pid", "label_date"]), ["pid", "label_date"])


# --- rules


def _coded(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    levels = scale.tertiles(views.daily(s, d, stats=("n",)), ["pid"])
    return levels, rules.item_codes(levels)


_LEVELS = """
lv AS (
  SELECT d.pid, date, d.feature, value, CASE WHEN lo < a AND a < b AND b < hi THEN CASE WHEN value <= a THEN 'l' WHEN value <= b THEN 'm' ELSE 'h' END WHEN lo < m AND m < hi THEN CASE WHEN value <= m THEN 'l' ELSE 'h' END ELSE 'm' END AS level
  FROM (SELECT * FROM daily WHERE feature LIKE '%:n:%') d JOIN (SELECT pid, feature, quantile_cont(value, 1/3.0::DOUBLE) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 2/3.0::DOUBLE) AS b, min(value) AS lo, max(value) AS hi FROM daily GROUP BY ALL) q ON q.pid = d.pid AND q.feature = d.feature
), it AS (
  SELECT *, dense_rank() OVER (ORDER BY feature, level) - 1 AS item FROM lv
), bk AS (
  SELECT pid, date, list_sort(list(DISTINCT item)) AS items FROM it GROUP BY ALL HAVING 5 - count(DISTINCT feature) <= 4 AND count(DISTINCT item) > 1
)"""


def _baskets(s: SparkSession, d: str) -> DataFrame:
    levels, codes = _coded(s, d)
    return rules.baskets(levels, codes, 5, share=0.8)


@query("baskets", "i:pid d:date s:items", f"WITH {_LEVELS} SELECT pid, date, array_to_string(items, ',') AS items FROM bk")
def _(s, d):
    return _baskets(s, d).withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


_PAIR_RULES = """
one AS (
  SELECT g, item, count(*) AS n FROM (SELECT pid % 2 AS g, unnest(items) AS item FROM bk) GROUP BY ALL
), two AS (
  SELECT g, x, z, count(*) AS b FROM (SELECT g, x, unnest(items) AS z FROM (SELECT pid % 2 AS g, unnest(items) AS x, items FROM bk)) WHERE x <> z GROUP BY ALL
), tot AS (
  SELECT pid % 2 AS g, count(*) AS t FROM bk GROUP BY ALL
), pr AS (
  SELECT two.g, x, z, b / t AS support, b / p.n AS confidence, b * t / (p.n * q.n) AS lift FROM two JOIN tot USING (g) JOIN one p ON p.g = two.g AND p.item = x JOIN one q ON q.g = two.g AND q.item = z WHERE b / t >= 0.01 AND b / p.n >= 0.1
)"""


def _group_rules(s: SparkSession, d: str) -> DataFrame:
    return rules.pair_rules(_baskets(s, d).withColumn("g", F.col("pid") % 2), 0.01, 0.1, "g")


@query("pair_rules", "i:g i:x i:z r:support r:confidence r:lift", f"WITH {_LEVELS}, {_PAIR_RULES} SELECT * FROM pr")
def _(s, d):
    return _group_rules(s, d)


def _contrast(s: SparkSession, d: str) -> DataFrame:
    found = _group_rules(s, d)
    return rules.contrast_rules(found.where("g = 0"), found.where("g = 1"), ("x", "z"))


_CONTRAST = "SELECT coalesce(a.x, c.x) AS x, coalesce(a.z, c.z) AS z, coalesce(a.support, 0) AS support_pos, coalesce(c.support, 0) AS support_neg, coalesce(a.confidence, 0) AS confidence_pos, coalesce(c.confidence, 0) AS confidence_neg, coalesce(a.lift, 0) - coalesce(c.lift, 0) AS lift_diff, coalesce(a.lift, 0) AS lift_pos, coalesce(c.lift, 0) AS lift_neg FROM (SELECT * FROM pr WHERE g = 0) a FULL JOIN (SELECT * FROM pr WHERE g = 1) c ON a.x = c.x AND a.z = c.z"


@query("contrast_rules", "i:x i:z r:support_pos r:support_neg r:confidence_pos r:confidence_neg r:lift_diff", f"WITH {_LEVELS}, {_PAIR_RULES} {_CONTRAST}")
def _(s, d):
    return _contrast(s, d)


_INTEREST = """SELECT *, sign(dx) * sign(dc) * abs(dx) ** {w[1]} * abs(dc) ** {w[2]} * {size} ** {w[0]} AS interest, (2 * (support_pos - support_neg) + (y2 - y1) * (support_pos + support_neg)) / (y1 + y2) AS supp_delta, CASE WHEN confidence_pos > 0 AND confidence_neg > 0 THEN 2 ELSE 1 END AS sided FROM (
  SELECT *, CASE WHEN confidence_pos > 0 THEN support_pos / confidence_pos ELSE 0 END - CASE WHEN confidence_neg > 0 THEN support_neg / confidence_neg ELSE 0 END AS dx, confidence_pos - confidence_neg AS dc,
    CASE WHEN lift_pos > 0 THEN confidence_pos / lift_pos ELSE 0 END AS y1, CASE WHEN lift_neg > 0 THEN confidence_neg / lift_neg ELSE 0 END AS y2 FROM c)"""


@query("rule_interest", "i:x i:z r:interest r:supp_delta", f"WITH {_LEVELS}, {_PAIR_RULES}, c AS ({_CONTRAST}) {_INTEREST.format(w=(1, 1.5, 0.5), size=1)}")
def _(s, d):
    return rules.rule_interest(_contrast(s, d), (1.0, 1.5, 0.5))


@query("passing_rules", "i:x i:z r:support_pos r:confidence_pos", f"""
WITH {_LEVELS}, {_PAIR_RULES}, c AS ({_CONTRAST}), md AS (SELECT quantile_cont(abs(support_pos - support_neg), 0.5) AS ms, quantile_cont(abs(confidence_pos - confidence_neg), 0.5) AS mc FROM c WHERE confidence_pos > 0 AND confidence_neg > 0)
SELECT c.* FROM c, md WHERE (support_pos >= 0.02 + ms AND confidence_pos >= 0.2 + mc) OR (support_neg >= 0.02 + ms AND confidence_neg >= 0.2 + mc)""")
def _(s, d):
    return rules.passing_rules(_contrast(s, d), 0.02, 0.2)


#: All subsets of the baskets, at most five items each, by group: frequent sets and their rules.
def _mined(group: str) -> str:
    return f"""
ss AS (SELECT {group} AS g, list_filter(items, lambda v, k: (m >> (k - 1)) & 1 = 1) AS s, count(*) AS n FROM bk, range(1, 32) r(m) WHERE m < (1 << len(items)) GROUP BY ALL),
tt AS (SELECT {group} AS g, count(*) AS t FROM bk GROUP BY ALL), fr AS (SELECT ss.*, t FROM ss JOIN tt USING (g) WHERE n >= ceil(0.02 * t)),
ru AS (SELECT g, list_filter(s, lambda v: v <> y) AS x, [y] AS y, n, t FROM (SELECT *, unnest(s) AS y FROM fr WHERE len(s) > 1)),
fp AS (SELECT ru.g, ru.x, ru.y, ru.n / ru.t AS support, ru.n / a.n AS confidence, ru.n / a.n / (b.n / ru.t) AS lift FROM ru JOIN fr a ON a.g = ru.g AND a.s = ru.x JOIN fr b ON b.g = ru.g AND b.s = ru.y WHERE ru.n / a.n >= 0.1)"""


@query("fp_growth", "s:antecedent s:consequent r:support r:confidence r:lift", f"WITH {_LEVELS}, {_mined('0')} SELECT array_to_string(x, ',') AS antecedent, array_to_string(y, ',') AS consequent, support, confidence, lift FROM fp")
def _(s, d):
    found = rules.mine_rules(_baskets(s, d), 0.02, 0.1)
    return found.select(F.array_join(F.sort_array("antecedent").cast("array<string>"), ",").alias("antecedent"), F.array_join(F.col("consequent").cast("array<string>"), ",").alias("consequent"), "support", "confidence", "lift")


@query("selected_rules", "s:antecedent s:consequent r:interest i:sided i:rank", f"""
WITH {_LEVELS}, {_mined('pid % 2')}, c AS ({_CONTRAST.replace("z", "y").replace("FROM pr", "FROM fp")}), sc AS ({_INTEREST.format(w=(1, 1.5, 0.5), size="len(x)")}),
f5 AS (SELECT *, to_json({{'antecedent': x, 'consequent': y}}) AS name FROM sc QUALIFY row_number() OVER (PARTITION BY sided ORDER BY round(interest, 12) DESC, to_json({{'antecedent': x, 'consequent': y}})) <= 50),
cl AS (SELECT * FROM f5 WHERE NOT EXISTS (SELECT 1 FROM f5 o WHERE o.sided = f5.sided AND o.y = f5.y AND len(o.x) > len(f5.x) AND list_has_all(o.x, f5.x)))
SELECT array_to_string(x, ',') AS antecedent, array_to_string(y, ',') AS consequent, interest, sided, rank FROM (SELECT *, row_number() OVER (PARTITION BY sided ORDER BY round(interest, 12) DESC, name) AS rank FROM cl) WHERE rank <= 10""")
def _(s, d):
    b = _baskets(s, d)
    pos, neg = (rules.mine_rules(b.where(F.col("pid") % 2 == g), 0.02, 0.1).select(F.sort_array("antecedent").alias("antecedent"), "consequent", "support", "confidence", "lift") for g in (0, 1))
    best = rules.select_rules(rules.contrast_rules(pos, neg), (1.0, 1.5, 0.5), 10)
    return best.withColumn("antecedent", F.array_join(F.col("antecedent").cast("array<string>"), ",")).withColumn("consequent", F.array_join(F.col("consequent").cast("array<string>"), ","))


@query("rule_features", "i:pid d:label_date i:rule r:mean r:std", f"""
WITH {_LEVELS}, w AS (SELECT lb.pid, lb.label_date, bk.date, items FROM lb JOIN bk ON bk.pid = lb.pid AND bk.date BETWEEN lb.label_date - 27 AND lb.label_date)
SELECT w.pid, w.label_date, rule, avg(value) AS mean, stddev_samp(value) AS std FROM w JOIN (VALUES (0, [0], 1), (1, [2], 5)) r(rule, antecedent, item) ON list_has_all(items, antecedent) JOIN it ON it.pid = w.pid AND it.date = w.date AND it.item = r.item GROUP BY ALL""")
def _(s, d):
    levels, codes = _coded(s, d)
    days = _baskets(s, d)
    spread = views.labels(s, d).select("pid", "label_date", F.explode(F.sequence(F.date_sub("label_date", 27), "label_date")).alias("date")).join(days, ["pid", "date"])
    made = s.createDataFrame([(0, [0], 1), (1, [2], 5)], "rule int, antecedent array<int>, item int")
    return rules.rule_features(spread, levels.join(F.broadcast(codes), ["feature", "level"]).select("pid", "date", "item", "value"), made)


# --- collaborative filtering


_COHORT = ("ds_key", "feature")


def _memory(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Day series of all people and features, compared within the data set, and each one's last label."""
    day = F.datediff("date", F.lit("2024-01-01").cast("date"))
    last = views.labels(s, d).groupBy("pid").agg(F.max_by("y", "label_date").cast("int").alias("y"))
    return _long(s, d).select("ds_key", "feature", "pid", day.alias("day"), "value"), last


def _sims(memory: str, targets: str, key: str, name: str, rest: str = "") -> str:
    """SQL: r squared of all pairs of target and memory within ``key`` and feature, 0 without a correlation."""
    return f"""
{name}_p AS (SELECT a.{key} AS k, a.feature, a.pid AS a, b.pid AS b FROM (SELECT DISTINCT {key}, feature, pid FROM {targets}) a JOIN (SELECT DISTINCT {key}, feature, pid FROM {memory}) b ON a.{key} = b.{key} AND a.feature = b.feature {rest}),
{name}_r AS (SELECT a.{key} AS k, a.feature, a.pid AS a, b.pid AS b, CASE WHEN min(a.value) = max(a.value) OR min(b.value) = max(b.value) THEN 0 ELSE round(corr(a.value, b.value) ** 2, 9) END AS sim FROM {targets} a JOIN {memory} b ON a.{key} = b.{key} AND a.feature = b.feature AND a.date = b.date {rest} GROUP BY ALL),
{name} AS (SELECT p.*, coalesce(sim, 0) AS sim FROM {name}_p p LEFT JOIN {name}_r r ON r.k = p.k AND r.feature = p.feature AND r.a = p.a AND r.b = p.b)"""


def _score(sims: str, cut: str) -> str:
    sim = "CASE WHEN sim >= low THEN sim ELSE 0 END" if cut else "sim"
    return f"SELECT s.k, s.feature, a AS pid, sum({sim} * y) / (sum({sim}) + 1e-6) AS score FROM {sims} s JOIN (SELECT k, feature, quantile_cont(sim, 0.25) AS low FROM {sims} GROUP BY ALL) q ON q.k = s.k AND q.feature = s.feature JOIN last ON last.pid = b GROUP BY ALL"


_LAST = "last AS (SELECT pid, CAST(max_by(y, label_date) AS INT) AS y FROM lb GROUP BY pid)"
_TH = "th AS (SELECT k, feature, (avg(score) FILTER (WHERE y = 1) + avg(score) FILTER (WHERE y = 0)) / 2 AS threshold FROM ({}) JOIN last USING (pid) GROUP BY ALL)"
_VOTE = """SELECT pid, CAST(v > h AS INT) AS pred, CASE WHEN v <= h THEN 0.5 * v / CASE WHEN h = 0 THEN 1 ELSE h END ELSE 0.5 + 0.5 * (v - h) / CASE WHEN n = h THEN 1 ELSE n - h END END AS prob
FROM (SELECT pid, sum(CAST(coalesce(score > threshold, false) AS INT)) AS v, count(*) AS n, count(*) // 2 AS h FROM sc JOIN th ON th.k = sc.k AND th.feature = sc.feature GROUP BY pid)"""
_WITHIN = f"WITH {_LAST}, {_sims('long', 'long', 'ds_key', 'sims', 'AND a.pid <> b.pid')}, sc AS ({_score('sims', 'low')}), {_TH.format(_score('sims', ''))}"


@query("entity_sim_score", "s:ds_key s:feature i:pid r:score", f"{_WITHIN} SELECT k AS ds_key, feature, pid, score FROM sc")
def _(s, d):
    return cf.sim_score(*_memory(s, d), by=_COHORT)


@query("midpoint_threshold", "s:ds_key s:feature r:threshold", f"{_WITHIN} SELECT k AS ds_key, feature, threshold FROM th")
def _(s, d):
    return cf.midpoint_threshold(*_memory(s, d), by=_COHORT)


@query("cf_vote", "i:pid i:pred r:prob", f"{_WITHIN} {_VOTE}")
def _(s, d):
    rows, y = _memory(s, d)
    return cf.vote(cf.sim_score(rows, y, by=_COHORT), cf.midpoint_threshold(rows, y, by=_COHORT), by=_COHORT)


_NEW = "mem AS (SELECT *, split_part(ds_key, '_', 1) AS inst FROM long WHERE ds_key LIKE '%_1'), new AS (SELECT *, split_part(ds_key, '_', 1) AS inst FROM long WHERE ds_key LIKE '%_3')"


@query("cf_new_people", "i:pid i:pred r:prob", f"WITH {_LAST}, {_NEW}, {_sims('mem', 'mem', 'inst', 'own', 'AND a.pid <> b.pid')}, {_sims('mem', 'new', 'inst', 'far')}, sc AS ({_score('far', 'low')}), {_TH.format(_score('own', ''))} {_VOTE}")
def _(s, d):
    rows, y = _memory(s, d)
    rows, by = rows.withColumn("inst", F.split("ds_key", "_")[0]), ("inst", "feature")
    memory, new = rows.where("ds_key LIKE '%_1'"), rows.where("ds_key LIKE '%_3'")
    return cf.vote(cf.sim_score(memory, y, new, by=by), cf.midpoint_threshold(memory, y, by=by), by=by)


def _judged(rows: str, name: str) -> str:
    """SQL: accuracy, balanced accuracy and recall of ``pred`` by k, feature and fold."""
    return f"""{name} AS (SELECT k, feature, fold, avg(CAST(pred = (y = 1) AS INT)) AS acc, (coalesce(avg(CAST(pred AS INT)) FILTER (WHERE y = 1), 1) + coalesce(1 - avg(CAST(pred AS INT)) FILTER (WHERE y = 0), 1)) / 2 AS balanced, coalesce(avg(CAST(pred AS INT)) FILTER (WHERE y = 1), 1) AS recall
FROM (SELECT r.*, coalesce(score > threshold, false) AS pred FROM {rows} r JOIN th USING (k, feature, fold)) GROUP BY ALL)"""


_FOLDED = f"""WITH {_LAST}, {_sims('long', 'long', 'ds_key', 'sims', 'AND a.pid <> b.pid')},
p5 AS (SELECT s.*, la.y AS ya, lb.y AS yb, a % 5 AS fa, b % 5 AS fb FROM sims s JOIN last la ON la.pid = a JOIN last lb ON lb.pid = b),
tr AS (SELECT k, feature, fold, a AS pid, ya AS y, sum(sim * yb) / (sum(sim) + 1e-6) AS score FROM p5, range(5) f(fold) WHERE fa <> fold AND fb <> fold GROUP BY ALL),
lo AS (SELECT k, feature, fa, quantile_cont(sim, 0.25) AS low FROM p5 WHERE fa <> fb GROUP BY ALL),
va AS (SELECT k, feature, fa AS fold, a AS pid, ya AS y, sum(CASE WHEN sim >= low THEN sim * yb ELSE 0 END) / (sum(CASE WHEN sim >= low THEN sim ELSE 0 END) + 1e-6) AS score FROM p5 JOIN lo USING (k, feature, fa) WHERE fa <> fb GROUP BY ALL),
th AS (SELECT k, feature, fold, (avg(score) FILTER (WHERE y = 1) + avg(score) FILTER (WHERE y = 0)) / 2 AS threshold FROM tr GROUP BY ALL),
{_judged('tr', 'jt')}, {_judged('va', 'jv')},
res AS (SELECT k || '/' || feature AS feature, fold, threshold, jt.balanced, jt.recall, jv.acc FROM jt JOIN jv USING (k, feature, fold) JOIN th USING (k, feature, fold))"""


def _folded_memory(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows, last = _memory(s, d)
    rows = rows.select(F.concat_ws("/", "ds_key", "feature").alias("feature"), "pid", "day", "value")
    return rows, last.withColumn("fold", (F.col("pid") % 5).cast("int"))


@query("cf_feature_results", "s:feature i:fold r:threshold r:train_balanced_acc r:train_recall r:valid_acc", f"{_FOLDED} SELECT feature, fold, threshold, balanced AS train_balanced_acc, recall AS train_recall, acc AS valid_acc FROM res")
def _(s, d):
    return cf.feature_results(*_folded_memory(s, d))


@query("cf_selected_features", "s:feature i:points i:place r:threshold", f"""{_FOLDED},
ls AS (SELECT feature, fold, row_number() OVER (PARTITION BY fold ORDER BY round(balanced, 9) DESC, feature) AS r, count(*) OVER (PARTITION BY fold) AS n FROM res WHERE recall < 0.99 AND acc > 0.53),
pt AS (SELECT feature, sum(CASE WHEN r <= n // 5 THEN n - r ELSE 0 END) AS points FROM ls GROUP BY feature),
pl AS (SELECT *, row_number() OVER (ORDER BY points DESC, feature) AS place, count(*) OVER () AS k FROM pt)
SELECT feature, points, place, t.threshold FROM pl JOIN (SELECT feature, avg(threshold) AS threshold FROM res GROUP BY feature) t USING (feature) WHERE place <= ceil(k * 0.05)""")
def _(s, d):
    return cf.select_features(cf.feature_results(*_folded_memory(s, d)))


@query("cf_classifier", "i:pid i:pred r:prob")
def _(s, d):
    """Fitted on the people of phase 1, within their institution; those of phase 3 are predicted."""
    rows, last = _memory(s, d)
    rows = rows.withColumn("feature", F.concat_ws("/", F.split("ds_key", "_")[0], "feature"))
    known = rows.where("ds_key LIKE '%_1'").join(last, "pid").withColumn("fold", (F.floor(F.col("pid") / 4) % 5).cast("int"))
    return cf.CollaborativeFilter().fit(known).transform(rows.where("ds_key LIKE '%_3'"))


@query("behaviour_profile", "i:pid s:slice s:feature i:days r:first", """
SELECT pid, CASE WHEN isodow(date) < 6 THEN 'weekday' ELSE 'weekend' END AS slice, feature, count(*) AS days, min_by(value, date) AS first FROM daily GROUP BY ALL""")
def _(s, d):
    rows = views.daily(s, d).withColumn("slice", F.when(scalar.is_weekday("date"), "weekday").otherwise("weekend")).withColumnRenamed("date", "day")
    return cf.profiles(rows).withColumn("first", F.col("profile")[0])


@query("rank_aggregate", "s:feature i:points i:place", """
SELECT feature, points, place FROM (SELECT feature, sum(p) AS points, row_number() OVER (ORDER BY sum(p) DESC, feature) AS place, count(*) OVER () AS k FROM (
  SELECT feature, CASE WHEN r <= n // 5 THEN n - r ELSE 0 END AS p FROM (SELECT feature, pid % 5 AS fold, row_number() OVER (PARTITION BY pid % 5 ORDER BY round(avg(value), 6) DESC, feature) AS r, count(*) OVER (PARTITION BY pid % 5) AS n FROM daily GROUP BY feature, pid % 5)) GROUP BY feature) WHERE place <= ceil(k * 0.3)""")
def _(s, d):
    results = views.daily(s, d).groupBy("feature", (F.col("pid") % 5).alias("fold")).agg(F.round(F.avg("value"), 6).alias("m"))
    return cf.rank_aggregate(results, "m", top=0.3)


# --- embeddings

_VEC = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, label FROM embeddings)"


@query("domain_index", "i:pid i:domain", "SELECT pid, row_number() OVER (ORDER BY r, ds_key, pid) - 1 AS domain FROM (SELECT pid, ds_key, row_number() OVER (PARTITION BY ds_key ORDER BY pid) AS r FROM dim)")
def _(s, d):
    return embed.domain_index(views.participants(s, d), "person")


@query("batch_plan", "i:id i:label i:batch", "SELECT vec_id AS id, label, (row_number() OVER (PARTITION BY label ORDER BY (vec_id * 7919) % 1009, vec_id) - 1) // 8 AS batch FROM embeddings")
def _(s, d):
    return embed.batch_plan(views.vectors(s, d), "label", 8, key="id")


@query("batch_plan_across", "i:label i:batch i:n", """
SELECT label, place // 4 AS batch, count(*) AS n FROM (SELECT label, unnest(range(most)) AS place FROM (SELECT label, max(count(*)) OVER () AS most FROM embeddings GROUP BY label)) GROUP BY ALL""")
def _(s, d):
    return embed.batch_plan(views.vectors(s, d), "label", 4, "across", key="id").groupBy("label", "batch").agg(F.count("*").alias("n"))


@query("mixup", "i:id i:other r:lam i:dims")
def _(s, d):
    v = views.vectors(s, d).select("id", F.col("x").cast("array<double>").alias("x"), scalar.one_hot(F.col("label"), 10).alias("y"))
    return embed.mixup(v, 0.4, key="id").withColumn("dims", F.size("x"))


@query("reorder", "i:id i:class r:moment", """
SELECT vec_id AS id, class, list_sum(list_transform(range(64), lambda i: (i + 1) * embedding[o[i // 16 + 1] * 16 + i % 16 + 1]::DOUBLE)) AS moment FROM (SELECT *, CASE WHEN (vec_id * 31) % 100 < 70 THEN 1 + (vec_id * 7919) % 4 ELSE 0 END AS class FROM embeddings)
JOIN (VALUES (0, [0, 1, 2, 3]), (1, [0, 1, 2, 3]), (2, [1, 0, 3, 2]), (3, [2, 3, 0, 1]), (4, [3, 2, 1, 0])) v(class, o) USING (class)""")
def _(s, d):
    """All 64 places of every vector, in blocks of 16, by permutations that are far apart in Hamming distance."""
    vectors = views.vectors(s, d).select("id", F.col("x").cast("array<double>").alias("x"))
    out = embed.reorder(vectors, embed.hamming_permutations(s, 4, 4), block=16, key="id")
    weighted = F.transform("x", lambda v, i: (i + 1) * v)
    return out.withColumn("moment", F.aggregate(weighted, F.lit(0.0), lambda a, b: a + b))


@query("knn_vote", "i:id r:score i:pred", f"""
WITH {_VEC}, p AS (SELECT a.id AS a, b.id AS b, CAST(b.label < 5 AS INT) AS y, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) AS r FROM v a JOIN v b ON a.id % 50 = 0 AND b.id % 50 <> 0)
SELECT a AS id, avg(y) AS score, CAST(avg(y) > 0.5 AS INT) AS pred FROM p WHERE r <= 5 GROUP BY a""")
def _(s, d):
    v = views.vectors(s, d).withColumn("x", F.col("x").cast("array<double>"))
    return embed.knn_vote(v.where("id % 50 <> 0").withColumn("y", (F.col("label") < 5).cast("int")), v.where("id % 50 = 0"), 5)


@query("near_pairs", "i:a_id i:b_id r:distance", f"""
WITH {_VEC}, w AS (SELECT id, list_transform(range(64), lambda i: x[i + 1] + CASE WHEN i = id % 64 THEN 0.05 ELSE 0 END) AS x FROM v)
SELECT * FROM (SELECT v.id AS a_id, w.id AS b_id, list_distance(v.x, w.x) AS distance FROM v, w) WHERE distance <= 0.3""")
def _(s, d):
    """Every vector against all vectors with one place moved a little: each finds its own again."""
    v = views.vectors(s, d).select("id", F.col("x").cast("array<double>").alias("x"))
    moved = v.withColumn("x", F.transform("x", lambda e, i: e + F.when(i == F.col("id") % 64, 0.05).otherwise(0.0)))
    return embed.near_pairs(v, moved, 0.3)


def _centres(s: SparkSession, d: str) -> DataFrame:
    v = views.vectors(s, d).select("label", F.posexplode(F.col("x").cast("array<double>")).alias("k", "v"))
    means = v.groupBy("label", "k").agg(F.avg("v").alias("v"))
    return means.groupBy(F.col("label").alias("cluster")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda r: r["v"]).alias("c"))


_SOFT = f"""{_VEC}, ce AS (SELECT label AS cluster, list(m ORDER BY k) AS c FROM (SELECT label, k, avg(x[k]) AS m FROM v, range(1, 65) r(k) GROUP BY ALL) GROUP BY label),
t AS (SELECT id, cluster, 1 / (1 + list_distance(x, c) ** 2) AS t FROM v, ce), q AS (SELECT id, cluster, t / sum(t) OVER (PARTITION BY id) AS q FROM t),
s AS (SELECT *, q * q / sum(q) OVER (PARTITION BY cluster) AS s FROM q)"""


@query("soft_assign", "i:id i:cluster r:q r:target", f"WITH {_SOFT} SELECT id, cluster, q, s / sum(s) OVER (PARTITION BY id) AS target FROM s")
def _(s, d):
    return embed.soft_assign(views.vectors(s, d).select("id", F.col("x").cast("array<double>").alias("x")), _centres(s, d))


def _assigned(s: SparkSession, d: str) -> DataFrame:
    soft = embed.soft_assign(views.vectors(s, d).select("id", F.col("x").cast("array<double>").alias("x")), _centres(s, d))
    best = soft.groupBy("id").agg(F.max_by("cluster", F.struct(F.round("q", 9), -F.col("cluster"))).alias("cluster"), F.max("q").alias("q"))
    return best.withColumn("pid", F.col("id") % 20)


_ASSIGNED = f"{_SOFT}, asg AS (SELECT id, id % 20 AS pid, cluster, q FROM q QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(q, 9) DESC, cluster) = 1)"


@query("cluster_census", "i:cluster i:n_rows i:n_users", f"WITH {_ASSIGNED} SELECT cluster, count(*) AS n_rows, count(DISTINCT pid) AS n_users FROM asg GROUP BY cluster")
def _(s, d):
    return embed.cluster_census(_assigned(s, d))


@query("clusters_per_user", "i:pid i:n_clusters", f"WITH {_ASSIGNED} SELECT pid, count(DISTINCT cluster) AS n_clusters FROM asg GROUP BY pid")
def _(s, d):
    return embed.clusters_per_user(_assigned(s, d))


@query("change_rate", "r:changed", f"WITH {_ASSIGNED} SELECT avg(CAST(asg.cluster <> v.label AS DOUBLE)) AS changed FROM asg JOIN v USING (id)")
def _(s, d):
    return embed.change_rate(_assigned(s, d), views.vectors(s, d).withColumnRenamed("label", "cluster"))


@query("routed", "i:id i:cluster i:pred", f"WITH {_ASSIGNED} SELECT id, cluster, CASE cluster WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 7 END AS pred FROM asg")
def _(s, d):
    return embed.routed(_assigned(s, d), s.createDataFrame([(0, 1), (1, 0)], "cluster int, pred int"), 7)


_TRIPLE = f"{_VEC}, p AS (SELECT a.id % 25 AS batch, a.id AS a, b.id AS b, a.label = b.label AS same, list_distance(a.x, b.x) AS d FROM v a JOIN v b ON a.id % 25 = b.id % 25 AND a.id <> b.id)"


@query("triplet_semihard", "i:a i:b r:dp r:dn r:loss", f"""
WITH {_TRIPLE} SELECT a, b, dp, dn, greatest(0, 1 + dp - dn) AS loss FROM (SELECT x.a, x.b, x.d AS dp, coalesce(min(n.d) FILTER (WHERE n.d > x.d), max(n.d)) AS dn FROM (SELECT * FROM p WHERE same) x JOIN (SELECT * FROM p WHERE NOT same) n ON n.a = x.a GROUP BY ALL)""")
def _(s, d):
    v = views.vectors(s, d).withColumn("x", F.col("x").cast("array<double>")).withColumn("batch", F.col("id") % 25)
    return embed.triplets(v, block="batch")


@query("triplet_hard", "i:a r:dp r:dn r:loss", f"WITH {_TRIPLE} SELECT *, greatest(0, dp - dn + 1) AS loss FROM (SELECT a, max(d) FILTER (WHERE same) AS dp, min(d) FILTER (WHERE NOT same) AS dn FROM p GROUP BY a) WHERE dp IS NOT NULL AND dn IS NOT NULL")
def _(s, d):
    v = views.vectors(s, d).withColumn("x", F.col("x").cast("array<double>")).withColumn("batch", F.col("id") % 25)
    return embed.triplets(v, mode="hard", block="batch")


@query("domain_divergence", "i:label i:d1 i:d2 r:kl", f"""
WITH {_VEC}, m AS (SELECT id % 3 AS domain, label, k, exp(avg(x[k]) / 2) AS e FROM v, range(1, 65) r(k) GROUP BY ALL), sm AS (SELECT domain, label, k, e / sum(e) OVER (PARTITION BY domain, label) AS p FROM m)
SELECT a.label, a.domain AS d1, b.domain AS d2, sum((a.p - b.p) * ln(a.p / b.p)) / 2 AS kl FROM sm a JOIN sm b ON a.label = b.label AND a.k = b.k AND a.domain < b.domain GROUP BY ALL""")
def _(s, d):
    logits = views.vectors(s, d).select((F.col("id") % 3).alias("domain"), "label", F.posexplode(F.col("x").cast("array<double>")).alias("k", "value"))
    return embed.domain_divergence(logits)


@query("kmeans_census", "i:cluster i:n_rows i:n_users")
def _(s, d):
    v = views.vectors(s, d).select("id", F.col("x").cast("array<double>").alias("x"))
    soft = embed.soft_assign(v, embed.kmeans_centres(v, 5, starts=2))
    best = soft.groupBy("id").agg(F.max_by("cluster", "q").alias("cluster"), F.max("q").alias("q")).withColumn("pid", F.col("id") % 20)
    return embed.cluster_census(best)


@query("mapped_windows", "i:pid d:label_date r:range", "SELECT pid, label_date, max(value) - min(value) AS range FROM win GROUP BY ALL")
def _(s, d):
    import pandas as pd

    def span(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(group.pid[0], group.label_date[0], group.value.max() - group.value.min())], columns=["pid", "label_date", "range"])

    return embed.map_windows(views.windows(s, d).select("pid", "label_date", "value"), ["pid", "label_date"], span, "pid bigint, label_date date, range double")


# --- models: no SQL


def _matrix(s: SparkSession, d: str) -> DataFrame:
    """``row_id, pid, label_date, ds_key, device, x, features, label, role``."""
    from pyspark.ml.functions import array_to_vector

    names = _NAMES
    own = ["pid", "label_date", "y"]
    wide = windows.wide(_means(s, d).drop("score"), own, names)
    x = F.array(*(F.coalesce(F.col(f"`{n}`"), F.lit(0.0)) for n in names))
    rows = splits.within_user(wide.select(*own, x.alias("x")).join(views.participants(s, d), "pid"))
    rows = cut(rows.select(F.xxhash64("pid", "label_date").alias("row_id"), "pid", "label_date", "ds_key", "device", "x", F.col("y").cast("double").alias("label"), "role"))
    return rows.select("row_id", "pid", "label_date", "ds_key", "device", "x", array_to_vector("x").alias("features"), "label", "role")  # models read it many times


def _folded(m: DataFrame, k: int = 5) -> DataFrame:
    """Rows with folds of participants, both classes in every training part."""
    return splits.folds_with_both_classes(m, "pid", "label", splits.fold_count(m, "label", "pid", k))


@query("evaluate_allbutone", "s:split_id s:role r:acc r:balanced_acc r:auc")
def _(s, d):
    return models.evaluate(_matrix(s, d).drop("role"), splits.split_plan("allbutone", views.points(s, d)), "lr")


@query("grid_search", "i:params r:mean")
def _(s, d):
    """The published elastic-net grid over five folds, fitted together."""
    m = _matrix(s, d).where("role = 'train'").cache()
    return models.grid_search(_folded(m), "lr", models.elastic_net_grid(m.count()))[1]


@query("per_device", "i:pid d:label_date s:device i:pred r:score")
def _(s, d):
    return models.per_device(_matrix(s, d), "dt", {"maxDepth": 3})


@query("ada_boost", "i:pid d:label_date i:pred r:score")
def _(s, d):
    m = _matrix(s, d)
    return models.predictions(models.make_estimator("adaboost").fit(m.where("role = 'train'")), m)


@query("stacked", "i:pid d:label_date i:pred r:score r:p_click r:p_error")
def _(s, d):
    """A family for each kind of event; the published grids of costs, sizes and upper sizes."""
    m = _matrix(s, d)
    families: dict[str, list[int]] = {}
    for k, name in enumerate(_NAMES):
        families.setdefault(name.split(":")[0].removeprefix("f_"), []).append(k)
    return models.predictions(models.Stacking(families).fit(_folded(m.where("role = 'train'"))), m)


@query("kernel_svm", "i:pid d:label_date i:pred r:score")
def _(s, d):
    from pyspark.ml.functions import array_to_vector

    m = _matrix(s, d).withColumn("features", array_to_vector(models.random_features(F.col("x"), 10, 64, 0.001)))
    return models.predictions(models.make_estimator("svm").fit(m.where("role = 'train'")), m)


@query("pooled_baseline", "i:pid d:label_date i:pred r:score")
def _(s, d):
    """A perceptron on 28 x 10 windows, normalised within the window, fitted on each person's past."""
    normed = windows.window_tensor(scale.window_norm(views.windows(s, d)), _NAMES)
    points = splits.within_user(views.points(s, d))
    rows = normed.select("pid", "label_date", "x").join(points.select("pid", "label_date", "role", F.col("y").cast("double").alias("label")), ["pid", "label_date"])
    model = models.pooled_baseline(rows.where("role = 'train'"), 280)
    return models.predictions(model, rows.withColumn("features", models.flat_tensor(F.col("x"))))


@query("domain_curve", "r:fraction i:repeat i:n r:accuracy r:balanced_acc")
def _(s, d):
    """Data sets told apart: 20 fractions of the participants, 5 repeats."""
    m = splits.pid_split(_matrix(s, d).drop("role", "label"))
    people = m.where("role = 'train'").select("pid").distinct().count()
    return models.domain_curve(m, "ds_key", models.log_spaced(1.4 / people))


@query("person_curve", "r:fraction i:repeat i:n r:accuracy r:balanced_acc")
def _(s, d):
    """Persons told apart by daily features: 20 fractions of each person's days, one fifth of them kept for the test."""
    from pyspark.ml.functions import array_to_vector

    wide = windows.wide(views.daily(s, d), ["pid", "date"], _NAMES)
    x = array_to_vector(F.array(*(F.coalesce(F.col(f"`{n}`"), F.lit(0.0)) for n in _NAMES)))
    days = wide.select("pid", "date", x.alias("features")).join(views.participants(s, d), "pid")
    rows = splits.row_split(days.withColumn("row_id", F.col("pid") * 1000 + F.datediff("date", F.lit("2024-01-01").cast("date"))))
    average = rows.count() / rows.select("pid").distinct().count()
    return models.domain_curve(rows.withColumn("person", F.col("pid").cast("string")), "person", models.log_spaced(1.4 / average), 1, "row", 11, many=True)


@query("row_split", "i:pid d:label_date s:role", f"""
SELECT pid, label_date, CASE WHEN i <= ceil(round(n * 0.2, 9)) THEN 'test' ELSE 'train' END AS role FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY (r * 7919) % 1009, r) AS i, count(*) OVER (PARTITION BY pid) AS n FROM (SELECT pid, label_date, pid * 1000 + (label_date - DATE '2024-01-01') AS r FROM lb))""")
def _(s, d):
    return splits.row_split(_numbered_points(s, d))


def _numbered_points(s: SparkSession, d: str) -> DataFrame:
    return views.points(s, d).withColumn("row_id", F.col("pid") * 1000 + F.datediff("label_date", F.lit("2024-01-01").cast("date")))


_ROWS = "g AS (SELECT * FROM (VALUES (0, 0.02), (1, 0.1), (2, 0.5), (3, 1.0)) f(number, fraction), range(2) r(repeat)), p AS (SELECT pid, ds_key, pid * 1000 + (label_date - DATE '2024-01-01') AS row_id FROM pts)"


@query("learning_rows_pid", "i:number i:repeat i:row_id", f"""
WITH {_ROWS}, q AS (SELECT ds_key, pid, count(*) AS n FROM p GROUP BY ALL),
c AS (SELECT *, round(CAST(fraction AS DOUBLE) * people, 9) AS share FROM (SELECT q.*, g.*, row_number() OVER (PARTITION BY ds_key, number, repeat ORDER BY (pid * 7919 + repeat * 104729) % 1009, pid) AS i, count(*) OVER (PARTITION BY ds_key, number, repeat) AS people FROM q, g)),
j AS (SELECT p.row_id, c.*, row_number() OVER (PARTITION BY number, repeat, p.pid ORDER BY (row_id * 7919 + repeat * 104729) % 1009, row_id) AS j FROM p JOIN c USING (ds_key, pid) WHERE i <= ceil(share))
SELECT number, repeat, row_id FROM j WHERE share >= 1 OR j <= ceil(round(share * n, 9))""")
def _(s, d):
    return splits.learning_rows(_numbered_points(s, d), [0.02, 0.1, 0.5, 1.0], 2)


@query("learning_rows_row", "i:number i:repeat i:row_id", f"""
WITH {_ROWS}, j AS (SELECT p.row_id, g.*, row_number() OVER (PARTITION BY number, repeat, pid ORDER BY (row_id * 7919 + repeat * 104729) % 1009, row_id) AS j, count(*) OVER (PARTITION BY number, repeat, pid) AS n FROM p, g)
SELECT number, repeat, row_id FROM j WHERE j <= ceil(round(CAST(fraction AS DOUBLE) * n, 9))""")
def _(s, d):
    return splits.learning_rows(_numbered_points(s, d), [0.02, 0.1, 0.5, 1.0], 2, "row")


@query("stability_select", "i:family i:segment s:feature r:frequency b:kept")
def _(s, d):
    """All features of all day segments: 200 refits of each segment of each kind of event, then of each kind."""
    window = windows.label_windows(views.labels(s, d), views.daily(s, d, None, ("n", "sum", "mean", "max")), 14)
    long = scale.prepare(windows.window_stats(window, 14, ("mean",)).select("pid", "label_date", "feature", F.col("mean").alias("value")), "train", row_na=2.0)
    names = sorted(r.feature for r in long.select("feature").distinct().collect())
    rows = published.matrix(long, views.points(s, d), names).withColumn("row_id", F.xxhash64("pid", "label_date")).cache()
    families: dict[str, dict[str, list[int]]] = {}
    for k, name in enumerate(names):
        kind, _, segment = name.split(":")
        families.setdefault(kind, {}).setdefault(segment, []).append(k)
    groups = [(f, g, places) for f, parts in families.items() for g, places in parts.items()]
    scores, selected = models.stability_stages(rows, len(names), families)
    kept = {k for places in selected.values() for k in places}
    order = {f: k for k, f in enumerate(families)}
    table = [(order[f], n, names[k], v, k in kept) for n, ((f, _, _), found) in enumerate(zip(groups, scores, strict=True)) for k, v in found.items()]
    rows.unpersist()
    return s.createDataFrame(table, "family int, segment int, feature string, frequency double, kept boolean")


# --- published pipelines: feature matrices with SQL, fits without


def _named(stats: dict[str, str], days: int = 14) -> str:
    """SQL of ``feature#stat`` rows."""
    return " UNION ALL ".join(f"SELECT pid, label_date, feature || '#{name}' AS feature, {agg} AS value FROM (SELECT *, CAST(date - (label_date - 13) AS DOUBLE) AS x FROM win WHERE date > label_date - {days}) GROUP BY pid, label_date, win.feature" for name, agg in stats.items()).replace("GROUP BY pid, label_date, win.feature", "GROUP BY pid, label_date, feature")


_SLOPE = "(count(*) * sum(x * value) - sum(x) * sum(value)) / (count(*) * sum(x * x) - sum(x) * sum(x) + 1e-7)"


@query("features_trend", "i:pid d:label_date s:feature r:value", _named({"mean": "avg(value)", "std": "stddev_samp(value)", "slope": _SLOPE}))
def _(s, d):
    return published.trend_features(views.windows(s, d))


@query("features_broad", "i:pid d:label_date s:feature r:value", f"SELECT pid, label_date, feature, value FROM win WHERE date = label_date UNION ALL {_named({'mean': 'avg(value)', 'sum': 'sum(value)', 'std': 'stddev_samp(value)', 'min': 'min(value)', 'max': 'max(value)'})}")
def _(s, d):
    return published.broad_features(views.windows(s, d))


#: Pipelines whose whole grid is searched in their query: elastic nets, all fits of which are one batch.
_SEARCHED = ("saeb", "wang")


def _published(name: str) -> None:
    @query(f"published_{name}", "s:role i:n r:acc r:balanced_acc r:auc")
    def _(s, d):
        points = splits.within_user(views.points(s, d).drop("score"))
        return published.evaluate(registry.load_algorithm(f"ml_{name}"), views.windows(s, d), points, search=name in _SEARCHED)


for _name in ("saeb", "wang", "wahle", "canzian", "farhan", "lu", "chikersal", "xu_interpretable", "xu_personalized"):
    _published(_name)


# --- streams: the event log read as a stream


def _stream(s: SparkSession, d: str) -> DataFrame:
    schema = views.table(s, d, "events").schema
    raw = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return raw.select(F.col("user_id").alias("pid"), "ts", F.col("event_type").alias("kind"), "value")


#: Windows that are past the watermark: a day behind the latest event.
_CLOSED = "<= (SELECT max(ts) - INTERVAL 1 DAY FROM ev)"


@query("stream_daily", "i:pid d:date s:kind s:segment i:n r:sum", f"SELECT pid, date, kind, segment, n, total AS sum FROM roll WHERE date + INTERVAL 1 DAY {_CLOSED}")
def _(s, d):
    return segments.run_available(segments.stream_daily(_stream(s, d)), _scratch(s, "stream_daily"))


@query("stream_history", "i:pid d:date s:kind i:n r:sum", f"SELECT pid, CAST(e.date + CAST(k AS INT) AS DATE) AS date, kind, count(*) AS n, sum(value) AS sum FROM ev e, range(14) r(k) WHERE e.date + CAST(k AS INT) + INTERVAL 1 DAY {_CLOSED} GROUP BY ALL")
def _(s, d):
    return segments.run_available(segments.stream_history(_stream(s, d)), _scratch(s, "stream_history"))


@query("stream_first_answers", "i:pid d:date", "SELECT DISTINCT pid, date FROM ev WHERE kind = 'error'")
def _(s, d):
    first = segments.stream_first_answers(_stream(s, d).where("kind = 'error'"), "60 days").select("pid", "date")
    return segments.run_available(first, _scratch(s, "stream_answers"))


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Events to daily features, survey labels, 28-day windows, 14-day statistics, scaling, split, summary."""
    stats = windows.window_stats(views.windows(s, d, 14), 14, ("mean", "std", "min", "max")).withColumnRenamed("mean", "value")
    scaled = scale.impute(scale.unit_robust(stats.select("pid", "label_date", "feature", "value"), []), [])
    rows = scaled.join(splits.within_user(views.labels(s, d)).select("pid", "label_date", "y", "role"), ["pid", "label_date"])
    return rows.groupBy("role", "feature").agg(F.count("*").alias("n"), F.avg(F.col("y").cast("double")).alias("label_rate"), F.avg("value").alias("mean"))


@query("flagship", "s:role s:feature i:n r:label_rate r:mean", """
WITH st AS (SELECT pid, label_date, feature, avg(value) AS value FROM win WHERE date > label_date - 14 GROUP BY ALL),
q AS (SELECT feature, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.95) AS hi FROM st GROUP BY feature),
ro AS (SELECT pid, label_date, y, CASE WHEN row_number() OVER (PARTITION BY pid ORDER BY label_date DESC) <= ceil(count(*) OVER (PARTITION BY pid) * 0.2) THEN 'test' ELSE 'train' END AS role FROM lb)
SELECT role, st.feature, count(*) AS n, avg(CAST(y AS DOUBLE)) AS label_rate, avg((value - m) / CASE WHEN hi - lo = 0 THEN 1 ELSE (hi - lo) / 3.2897072539029444 END) AS mean FROM st JOIN q USING (feature) JOIN ro USING (pid, label_date) GROUP BY ALL""")
def _(s, d):
    return flagship(s, d)
