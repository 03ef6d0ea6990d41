"""Feature screens: correlation, rank correlation, mutual information, sign reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.scalar import correlation
from tidewell.operators import neighbours
from tidewell.operators.ordered import average_ranks, binned, cut, running

#: Chunks of a class in which neighbours are looked for.
CHUNKS = 32


def corr_screen(long: DataFrame, by: list[str], least: float = 0.05) -> DataFrame:
    """Features whose absolute correlation with ``y`` exceeds ``least``; a constant feature has none."""
    rows = long.where("value is not null AND y is not null")
    return rows.groupBy(*by, "feature").agg(correlation("value", "y").alias("r"), F.count("*").alias("n")).where(F.abs("r") > least)


def spearman(long: DataFrame, by: list[str]) -> DataFrame:
    """rho, n and a two-sided p-value (normal approximation of t, Wallace's transform) by feature.

    A constant feature or a single row has no rho and no p. Ranks come from counts of distinct values, the
    correlation from counts of distinct pairs.
    """
    keys = [*by, "feature"]
    rows = long.where("value is not null AND y is not null").select(*keys, F.col("value").cast("double").alias("value"), F.col("y").cast("double").alias("y"))
    pairs = rows.groupBy(*keys, "value", "y").agg(F.count("*").alias("pairs"))
    rank = lambda c, name: average_ranks(rows, keys, c).select(*keys, c, F.col("rank").alias(name))
    both = pairs.join(rank("value", "__x"), [*keys, "value"]).join(rank("y", "__y"), [*keys, "y"])
    w, total = F.col("pairs"), rows.groupBy(*keys).agg(F.count("*").alias("n"))
    x, y = F.col("__x") - (F.col("n") + 1) / 2, F.col("__y") - (F.col("n") + 1) / 2  # ranks less their mean
    made = both.join(F.broadcast(total), keys).groupBy(*keys).agg(F.sum(w * x * y).alias("xy"), F.sum(w * x * x).alias("xx"), F.sum(w * y * y).alias("yy"), F.first("n").alias("n"))
    made = made.select(*keys, F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).alias("rho"), "n")
    df = F.col("n") - 2
    t2 = F.col("rho") * F.col("rho") * df / F.nullif(1 - F.col("rho") * F.col("rho"), F.lit(0.0))
    z = (8 * df + 1) / (8 * df + 3) * F.sqrt(df * F.log1p(t2 / F.nullif(df, F.lit(0))))
    whole = F.abs("rho") >= 1 - 1e-12
    return made.withColumn("p", F.when((df > 0) & ~whole, 2 * (1 - normal_cdf(z))).when(whole, 0.0))


def normal_cdf(z: Column) -> Column:
    """For z >= 0, to 7 digits: fixed coefficients of Abramowitz and Stegun 26.2.17."""
    k = 1 / (1 + 0.2316419 * z)
    poly = k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))
    return 1 - F.exp(-z * z / 2) / 2.5066282746310002 * poly


def significant(rows: DataFrame, level: float = 0.05) -> DataFrame:
    return rows.where(F.col("p") <= level)


def sign_consistency(rho: DataFrame, pooled: DataFrame | None = None) -> DataFrame:
    """Mean rho over data sets and whether all have the same sign, by feature; with ``pooled`` (feature, rho
    of all data sets' rows together) its rho as ``pooled_rho``."""
    s = F.signum("rho")
    found = rho.groupBy("feature").agg(F.avg("rho").alias("mean_rho"), (F.min(s) == F.max(s)).alias("same_sign"), F.count("*").alias("n_sets"))
    return found if pooled is None else found.join(pooled.select("feature", F.col("rho").alias("pooled_rho")), "feature", "left")


def sign_flip(pre: DataFrame, post: DataFrame) -> DataFrame:
    """Features whose mean rho changes sign between two periods, most opposed first."""
    a, b = (t.groupBy("feature").agg(F.avg("rho").alias(name)) for t, name in ((pre, "pre"), (post, "post")))
    return a.join(b, "feature").withColumn("product", F.col("pre") * F.col("post")).where("product < 0").orderBy("product", "feature")


def binned_mi(long: DataFrame, bins: int = 5) -> DataFrame:
    """Mutual information (nats) of each feature's rank bins and ``y``, from one contingency table."""
    rows = long.where("value is not null AND y is not null")
    w = Window.partitionBy("feature")  # a row a bin and class
    counts = rows.groupBy("feature", "value", "y").agg(F.count("*").alias("pairs"))
    total = rows.groupBy("feature").agg(F.count("*").alias("total"))
    below = running(cut(rows.groupBy("feature", "value").agg(F.count("*").alias("count"))), ["feature"], "value", ["count"]).select("feature", "value", "below_count")
    placed = counts.join(below, ["feature", "value"]).join(F.broadcast(total), "feature").withColumn("bin", F.floor(F.col("below_count") * bins / F.col("total")))
    cells = placed.groupBy("feature", "bin", "y").agg(F.sum("pairs").cast("double").alias("n"))
    total, row, col = F.sum("n").over(w), F.sum("n").over(Window.partitionBy("feature", "bin")), F.sum("n").over(Window.partitionBy("feature", "y"))
    parts = cells.withColumn("part", F.col("n") / total * F.log(F.col("n") * total / (row * col)))
    return parts.groupBy("feature").agg(F.sum("part").alias("mi"))


def digamma(n: Column) -> Column:
    """Of whole numbers from 1 on, to 12 digits."""
    return neighbours.digamma(n, F.log)


def neighbour_mi(long: DataFrame, keys: list[str], row: list[str], k: int = 3) -> DataFrame:
    """``keys, mi``: mutual information (nats) of ``value`` and the class ``y`` by nearest neighbours, not below 0.

    Ross's estimator: r is the distance to the k-th nearest value of the same class (fewer in a smaller class),
    m the number of values of any class closer than r (at r = 0: equal ones); mi = psi(n) + mean psi(k) -
    mean psi(class size) - mean psi(m). Classes of one row are left out. ``row`` names a row within ``keys``.

    A value's k-th neighbour is among the k before and the k behind it in the order of its class. Classes are
    cut into chunks of that order, each with the k last rows of the chunk before and the k first of the next;
    m comes from running counts over all values and the ends of all intervals.
    """
    rows = long.where("value is not null AND y is not null").select(*keys, *row, F.col("value").cast("double").alias("value"), "y")
    sizes = rows.groupBy(*keys, "y").agg(F.count("*").alias("size")).where("size > 1")
    rows = cut(rows.join(F.broadcast(sizes), [*keys, "y"]))
    own = [*keys, "y"]
    chunked = binned(rows, own, "value", CHUNKS)
    edge = Window.partitionBy(*own, "__bin")
    names = [*row, "value"]
    ends = chunked.withColumn("__first", F.row_number().over(edge.orderBy(*["value", *row]))).withColumn("__last", F.row_number().over(edge.orderBy(F.desc("value"), *(F.desc(c) for c in row))))
    ends = ends.where((F.col("__first") <= k) | (F.col("__last") <= k)).select(*own, *names, "__bin", "size")
    # a chunk may hold few rows: what the neighbours lend is found in the order of all chunks' ends
    around = Window.partitionBy(*own).orderBy("value", *row)  # at most 2 k rows a chunk
    place = ends.withColumn("__next", F.collect_list("__bin").over(around.rowsBetween(1, k))).withColumn("__prior", F.collect_list("__bin").over(around.rowsBetween(-k, -1)))
    lent = place.withColumn("__to", F.explode(F.array_distinct(F.concat("__next", "__prior")))).where(F.col("__to") != F.col("__bin"))
    lent = lent.select(*own, *names, "size", F.col("__to").alias("__bin"), F.lit(True).alias("__lent"))
    chunk = Window.partitionBy(*own, "__bin").orderBy("value", *row)
    every = chunked.select(*own, *names, "size", "__bin", F.lit(False).alias("__lent")).unionByName(lent)
    gaps = every.withColumns({f"__a{j}": F.lag("value", j).over(chunk) for j in range(1, k + 1)} | {f"__b{j}": F.lead("value", j).over(chunk) for j in range(1, k + 1)}).where("NOT __lent")

    far, x = F.least(F.lit(k), F.col("size") - 1), F.col("value")
    options = []
    for n in range(1, k + 1):  # n neighbours: j before and n - j behind
        for j in range(n + 1):
            left, right = (F.col(f"__a{j}") if j else x), (F.col(f"__b{n - j}") if n - j else x)
            options.append(F.when((far == n) & left.isNotNull() & right.isNotNull(), F.struct(F.greatest(x - left, right - x).alias("r"), left.alias("left"), right.alias("right"))))
    gaps = cut(gaps.withColumn("o", F.least(*options)).select(*keys, *row, "value", "size", far.alias("k"), "o.*"))
    r, same = F.col("r"), F.col("r") == 0
    by_left = (x - F.col("left")) == r  # that end is a value: it is taken as it stands, without a rounding
    low, high = F.when(by_left, F.col("left")).otherwise(x - r), F.when((F.col("right") - x) == r, F.col("right")).otherwise(x + r)
    # at one place come first those who count what is less, then the values, then those who count what is not greater
    query = lambda at, sign, first: F.struct(at.alias("at"), F.when(first, 0).otherwise(2).alias("turn"), F.lit(0).alias("one"), F.lit(sign).alias("sign"))
    value = F.struct(x.alias("at"), F.lit(1).alias("turn"), F.lit(1).alias("one"), F.lit(0).alias("sign"))
    events = gaps.select(*keys, *row, F.explode(F.array(value, query(low, -1, same), query(high, 1, ~same))).alias("e")).select(*keys, *row, "e.*")
    counted = running(events, keys, "at", ["one"], ("turn",))
    m = counted.where("sign <> 0").groupBy(*keys, *row).agg(F.sum(F.col("sign") * F.col("below_one")).alias("m"))
    parts = gaps.join(m, [*keys, *row]).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(digamma(F.col("k"))).alias("a"), F.avg(digamma(F.col("size"))).alias("b"), F.avg(digamma(F.col("m"))).alias("c"))
    return parts.select(*keys, F.greatest(F.lit(0.0), digamma(F.col("n")) + F.col("a") - F.col("b") - F.col("c")).alias("mi"))


def mi_rounds(long: DataFrame, row: list[str], rounds: int = 30, k: int = 3) -> DataFrame:
    """``round, feature, mi`` for values of unit deviation with a tiny noise, drawn anew in each round from hashes.

    Nulls count as the placeholder -10240. All rounds of all features are one pass, and a task draws a row's
    rounds itself: no row of a round is exchanged.
    """
    filled = long.where("y is not null").withColumn("value", F.coalesce(F.col("value").cast("double"), F.lit(-10240.0)))
    spread = filled.groupBy("feature").agg(F.stddev_pop("value").alias("s"), F.avg(F.abs("value")).alias("mean"))
    scaled = filled.join(F.broadcast(spread), "feature").withColumn("s", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0))
    noise = 1e-10 * F.greatest(F.lit(1.0), F.col("mean") / F.col("s"))
    rows = scaled.select("feature", F.xxhash64("feature", *row).alias("seed"), (F.col("value") / F.col("s")).alias("value"), noise.alias("noise"), "y")
    return neighbours.mi_rounds(rows, rounds, k)


def mi_screen(long: DataFrame, row: list[str], rounds: int = 30, floor: int = 10, k: int = 3) -> DataFrame:
    """Features that are in the top half by mutual information > 0 in every round.

    Stops before a round that would leave fewer than ``floor``; the first may, too, and then all stay.
    """
    long = cut(long)  # read for the names, the spread and the rounds
    kept = {r.feature for r in long.select("feature").distinct().collect()}  # feature names only
    half = Window.partitionBy("round").orderBy(F.desc("mi"), "feature")
    top = mi_rounds(long, row, rounds, k).where("mi > 0").withColumn("place", F.row_number().over(half)).where(F.col("place") <= len(kept) // 2)
    chosen: dict[int, set[str]] = {}
    for r in top.collect():  # names by round
        chosen.setdefault(r["round"], set()).add(r["feature"])
    for n in range(rounds):
        left = kept & chosen.get(n, set())
        if len(left) < floor:
            break
        kept = left
    return long.sparkSession.createDataFrame([(f,) for f in sorted(kept)], "feature string")
