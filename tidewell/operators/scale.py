"""Normalisation, discretisation and imputation, by participant, data set or window."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.scalar import clip
from tidewell.operators.ordered import cut, exact_quantiles

#: Distance of the 5 % and 95 % points of a standard normal.
NORMAL_SPAN = 3.2897072539029444

#: People of a block of the collaborative fill who lack values, at least; blocks of a feature at most.
PEOPLE, BLOCKS = 2048, 8
#: Cells (people by days) of a block of those who give values; people of both sides whose similarities are in memory at once.
CELLS, TILE = 1 << 22, (64, 512)


def robust_norm(long: DataFrame, by: list[str], q: tuple[float, float] = (0.05, 0.95), limit: float = 2.0) -> DataFrame:
    """(x - median) / (q95 - q5) within ``by`` and feature, clipped; a zero range counts as 1."""
    keys = [*by, "feature"]
    edges = long.groupBy(*keys).agg(F.percentile("value", F.array(F.lit(q[0]), F.lit(0.5), F.lit(q[1]))).alias("edge"))
    span = F.col("edge")[2] - F.col("edge")[0]
    scaled = (F.col("value") - F.col("edge")[1]) / F.when(span == 0, 1.0).otherwise(span)
    return long.join(edges, keys).withColumn("value", clip(scaled, -limit, limit)).drop("edge")


def _quantiles(long: DataFrame, keys: list[str], q: list[float]) -> DataFrame:
    """``keys, edge array<double>, low, high``: quantiles as SQL's ``quantile_cont`` has them to the last bit, and the ends.

    Between neighbours l and h that is l (1 - d) + h d, the first product fused with the sum, which decides on which
    side of an edge they lie if they differ in their last bit, as sums of the same cents do. The fused sum is made of
    exact products of halves and the exact error of the sum. A key's values are one array.
    """
    rows = long.groupBy(*keys).agg(F.sort_array(F.collect_list(F.col("value").cast("double"))).alias("v"))
    rows = rows.withColumns({f"at{k}": F.lit(float(x)) * (F.size("v") - 1) for k, x in enumerate(q)})
    side = lambda at: F.get("v", F.col(at).cast("int"))
    rows = rows.withColumns({f"{n}{k}": c for k in range(len(q)) for n, c in (("l", side(f"at{k}")), ("h", F.get("v", F.ceil(f"at{k}").cast("int"))), ("d", F.col(f"at{k}") - F.floor(f"at{k}")))})
    each = lambda of: {f"{n}{k}": c for k in range(len(q)) for n, c in of(lambda name: F.col(f"{name}{k}")).items()}  # noqa: B023, E731
    upper = lambda x: x * 134217729.0 - (x * 134217729.0 - x)
    rows = rows.withColumns(each(lambda c: {"w": 1 - c("d"), "p": c("l") * (1 - c("d")), "s": c("h") * c("d")}))
    rows = rows.withColumns(each(lambda c: {"lu": upper(c("l")), "wu": upper(c("w")), "sum": c("p") + c("s")}))
    rows = rows.withColumns(each(lambda c: {"ll": c("l") - c("lu"), "wl": c("w") - c("wu"), "z": c("sum") - c("p")}))
    rows = rows.withColumns(each(lambda c: {"e": ((c("lu") * c("wu") - c("p")) + c("lu") * c("wl") + c("ll") * c("wu")) + c("ll") * c("wl"), "t": (c("p") - (c("sum") - c("z"))) + (c("s") - c("z"))}))

    def edge(k: int) -> Column:
        c = lambda name: F.col(f"{name}{k}")
        fused = c("sum") + (c("t") + c("e"))
        return F.when(c("d") == 0, c("l")).when(F.greatest(F.abs(c("l")), F.abs(c("h"))) < 1e290, fused).otherwise(c("sum"))

    return rows.select(*keys, F.array(*(edge(k) for k in range(len(q)))).alias("edge"), F.get("v", F.lit(0)).alias("low"), F.get("v", F.size("v") - 1).alias("high"))


def tertiles(long: DataFrame, by: list[str]) -> DataFrame:
    """Level l, m or h within ``by`` and feature: right-closed bins at 1/3 and 2/3.

    Where edges coincide there are two bins, l and h, at the median; where those coincide too, all is m.
    """
    keys = [*by, "feature"]
    edges = _quantiles(long, keys, [1 / 3, 0.5, 2 / 3])
    x, e = F.col("value"), F.col("edge")
    three = (F.col("low") < e[0]) & (e[0] < e[2]) & (e[2] < F.col("high"))
    two = (F.col("low") < e[1]) & (e[1] < F.col("high"))
    level = F.when(x.isNull(), None).when(three, F.when(x <= e[0], "l").when(x <= e[2], "m").otherwise("h")).when(two, F.when(x <= e[1], "l").otherwise("h")).otherwise("m")
    return long.join(edges, keys).withColumn("level", level).drop("edge", "low", "high")


def unit_robust(long: DataFrame, by: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """(x - median) / ((q95 - q5) / 3.29): unit variance for a normal. Fitted on itself or on ``fit_on``; a
    feature's quantiles, of however many rows, come from many tasks. ``by`` and features should be few."""
    keys = [*by, "feature"]
    source = long if fit_on is None else fit_on
    edges = exact_quantiles(source, keys, [0.05, 0.5, 0.95])
    span = (F.col("edge")[2] - F.col("edge")[0]) / NORMAL_SPAN
    return long.join(F.broadcast(edges), keys, "left").withColumn("value", (F.col("value") - F.col("edge")[1]) / F.when(span == 0, 1.0).otherwise(span)).drop("edge")


def unit_scale(long: DataFrame, factors: dict[str, float]) -> DataFrame:
    """Each feature's values times its constant, as for a change of unit; 1 for features without one."""
    table = F.create_map(*(F.lit(x) for pair in factors.items() for x in pair)) if factors else F.lit(None).cast("map<string,double>")
    return long.withColumn("value", F.col("value") * F.coalesce(F.try_element_at(table, F.col("feature")), F.lit(1.0)))


def impute(long: DataFrame, by: list[str], how: str = "mean") -> DataFrame:
    """Nulls become the mean (or median) within ``by`` and feature, then 0."""
    keys = [*by, "feature"]
    if how == "mean":
        means = long.groupBy(*keys).agg(F.avg("value").alias("__mean"))
        means = means if by else F.broadcast(means)  # a row a feature
        return long.join(means, keys).withColumn("value", F.coalesce("value", "__mean", F.lit(0.0))).drop("__mean")
    middle = long.groupBy(*keys).agg(F.percentile("value", 0.5).alias("__middle"))
    return long.join(middle, keys).withColumn("value", F.coalesce("value", "__middle", F.lit(0.0))).drop("__middle")


def window_norm(window: DataFrame, method: str = "robust") -> DataFrame:
    """Along the days of each datapoint: robust with range + 1e-9 and clip 2, or standard with population
    deviation + 1e-9; features that are normalised already stay."""
    keys = ["pid", "label_date", "feature"]
    x = F.col("value")
    if method == "robust":
        edges = window.groupBy(*keys).agg(F.percentile("value", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("e"))
        scaled = clip((x - F.col("e")[1]) / (F.col("e")[2] - F.col("e")[0] + 1e-9), -2, 2)
    else:
        edges = window.groupBy(*keys).agg(F.array(F.avg("value"), F.stddev_pop("value")).alias("e"))
        scaled = (x - F.col("e")[0]) / (F.col("e")[1] + 1e-9)
    done = F.split("feature", ":")[1].endswith("_norm")
    return window.join(edges, keys).withColumn("value", F.when(done, x).otherwise(scaled)).drop("e")


def prepare(long: DataFrame, role: str, col_na: float = 0.9, row_na: float = 0.5, fit_on: DataFrame | None = None, columns: DataFrame | None = None) -> DataFrame:
    """Feature rows ready for a model: column filter (training only), row filter, unit-robust scale, mean, 0.

    A test set takes the training columns with ``columns``; scaling fits the set itself unless ``fit_on``.
    """
    keys = ["pid", "label_date"]
    from tidewell.operators.quality import kept_features, kept_rows

    long = cut(long)  # read for each filter and for the scale
    if columns is None and role == "train":
        columns = kept_features(long, col_na)
    if columns is not None:
        long = long.join(F.broadcast(columns), "feature", "left_semi")
    if role == "train":
        long = cut(long.join(kept_rows(long, keys, row_na), keys, "left_semi"))
    return impute(cut(unit_robust(long, [], fit_on)), [])


def cf_impute(long: DataFrame, low: float = 1.0, high: float = 3.0, least_days: float = -1.0, day_na: float = 0.75) -> DataFrame:
    """Collaborative fill of ``feature, pid, day, value``: the values of similar participants on the same day.

    Similarity is Pearson's r of the zero-filled day series of a feature (a constant series gets 1e-4 on day
    0). A null becomes clip(half-even round(sum sim * v / (sum sim + 1e-4))) over those who have a value that
    day: the lower limit where nobody has. A series that is constant when filled gets 1e-4 on day 0, too.
    A feature whose days with a missing rate below ``day_na`` are not more than ``least_days`` of its days is
    too empty and filled with 0 (-1: none is; 0.5 for features met in a test set).

    People of a feature are dealt out to blocks. A pair of blocks gives similarities as a matrix product and,
    with the values and the mask of present values of the one block, numerators and denominators of the
    other's missing cells as two more; only those cells leave the task. Those who give values come whole up to
    ``CELLS``, so that neither the copies of the series nor the rows of a missing cell grow with the people.
    """
    long = cut(long)
    people = long.groupBy("feature").agg(F.count_distinct("pid").alias("people"), F.array_sort(F.collect_set("day")).alias("days"))
    present = long.where("value is not null").groupBy("feature", "day").agg(F.count_distinct("pid").alias("n"))
    full = present.join(people, "feature").groupBy("feature").agg(F.count_if(1 - F.col("n") / F.col("people") < day_na).alias("full"))
    features = people.join(full, "feature", "left").withColumn("dense", F.coalesce("full", F.lit(0)) > F.size("days") * F.lit(least_days))

    point = F.struct(F.col("day").cast("int").alias("day"), F.col("value").cast("double").alias("value"))
    series = long.groupBy("feature", "pid").agg(F.collect_list(point).alias("points"), F.count_if(F.col("value").isNull()).alias("missing"))
    wide = F.ceil(F.col("people") * F.size("days") / CELLS)
    asked = F.greatest(F.least(F.ceil(F.col("people") / PEOPLE), F.lit(BLOCKS)), wide).cast("int")
    sizes = features.where("dense").select("feature", asked.alias("asked"), F.greatest(wide, F.lit(1)).cast("int").alias("others"))
    placed = series.join(F.broadcast(sizes), "feature")  # a row a feature
    columns = ["feature", "i", "j", "side", "pid", F.col("points.day").alias("day"), F.col("points.value").alias("value")]
    place = lambda n: F.pmod(F.xxhash64("pid"), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = placed.where("missing > 0").withColumn("side", F.lit("a")).withColumn("i", place("asked")).withColumn("j", upto("others")).select(*columns)
    giving = placed.withColumn("side", F.lit("b")).withColumn("j", place("others")).withColumn("i", upto("asked")).select(*columns)
    all_days = {r["feature"]: r["days"] for r in features.where("dense").select("feature", "days").collect()}  # a row a feature
    kind = long.schema["pid"].dataType.simpleString()

    def fill(group: pa.Table) -> pa.Table:
        days = np.array(all_days[group["feature"][0].as_py()], np.int64)

        def matrix(side: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
            part = group.filter(pc.equal(group["side"], side)).combine_chunks()
            x = np.full((part.num_rows, len(days)), np.nan)
            row = np.repeat(np.arange(part.num_rows), pc.list_value_length(part["day"]).to_numpy())
            x[row, np.searchsorted(days, pc.list_flatten(part["day"]).to_numpy())] = pc.list_flatten(part["value"]).to_numpy(zero_copy_only=False)
            z = np.nan_to_num(x)
            if 0 in days:
                z[z.min(axis=1, initial=np.inf) == z.max(axis=1, initial=-np.inf), np.searchsorted(days, 0)] += 1e-4
            z = z - z.mean(axis=1, keepdims=True)
            norm = np.sqrt((z * z).sum(axis=1, keepdims=True))
            return part["pid"], x, np.divide(z, norm, out=np.zeros_like(z), where=norm > 0)

        (pid, x, z), (_, v, w) = matrix("a"), matrix("b")
        sums, donors = np.zeros((len(x), 2 * len(days))), np.concatenate([np.nan_to_num(v), ~np.isnan(v)], axis=1)
        for k in range(0, len(x), TILE[0]):
            for m in range(0, len(w), TILE[1]):
                sums[k : k + TILE[0]] += (z[k : k + TILE[0]] @ w[m : m + TILE[1]].T) @ donors[m : m + TILE[1]]
        row, day = np.nonzero(np.isnan(x))
        over, under = sums[row, day], sums[row, len(days) + day]
        first = group["feature"].slice(0, 1).combine_chunks()
        return pa.table([first.take(pa.array(np.zeros(len(row), np.int64))), pid.take(pa.array(row)), pa.array(days[day]), pa.array(over), pa.array(under)], names=["feature", "pid", "day", "over", "under"])

    parts = asking.unionByName(giving).groupBy("feature", "i", "j").applyInArrow(fill, f"feature string, pid {kind}, day bigint, over double, under double")
    guess = parts.groupBy("feature", "pid", "day").agg((F.sum("over") / (F.sum("under") + 1e-4)).alias("guess"))
    filled = long.join(guess, ["feature", "pid", "day"], "left").join(features.select("feature", "dense"), "feature")
    value = F.when(F.col("dense"), F.coalesce("value", clip(F.bround("guess"), low, high))).otherwise(F.coalesce("value", F.lit(0.0)))
    filled = filled.withColumn("value", value)
    own = Window.partitionBy("feature", "pid")  # a row a day
    still = F.col("dense") & (F.col("day") == 0) & (F.min("value").over(own) == F.max("value").over(own))
    return filled.withColumn("value", F.col("value") + F.when(still, 1e-4).otherwise(0.0)).select(*long.columns)
