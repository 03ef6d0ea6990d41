"""Week means, half means, slopes and breakpoints of windows in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.scalar import is_weekday, slope_of

KEY = ["pid", "label_date", "feature"]
#: A fit that leaves less than this share of the squares is exact but for float noise.
NO_RESIDUE = 1e-10


def week_means(window: DataFrame) -> DataFrame:
    """Mean of each ISO week, weekdays and weekends apart; ``week`` counts from the window's first."""
    rows = window.withColumn("part", F.when(is_weekday("date"), "weekday").otherwise("weekend")).withColumn("start", F.to_date(F.date_trunc("week", "date")))
    means = rows.groupBy(*KEY, "part", "start").agg(F.avg("value").alias("mean"))
    first = F.min("start").over(Window.partitionBy(*KEY, "part"))
    return means.withColumn("week", (F.datediff("start", first) / 7).cast("int"))


def half_means(weeks: DataFrame) -> DataFrame:
    """Means over the first and the second half of the weeks; weekdays split at ceil(n/2), weekends at floor."""
    part = Window.partitionBy(*KEY, "part")
    n = F.count("*").over(part)
    cut = F.when(F.col("part") == "weekday", F.ceil(n / 2)).otherwise(F.floor(n / 2))
    rows = weeks.withColumn("first", F.row_number().over(part.orderBy("start")) <= cut)
    x = F.col("mean")
    return rows.groupBy(*KEY, "part").agg(F.avg(x).alias("mean_all"), F.avg(F.when(F.col("first"), x)).alias("mean_first"), F.avg(F.when(~F.col("first"), x)).alias("mean_second"))


def half_slopes(weeks: DataFrame) -> DataFrame:
    """Slopes of the week means over all weeks and both halves."""
    part = Window.partitionBy(*KEY, "part")
    n = F.count("*").over(part)
    cut = F.when(F.col("part") == "weekday", F.ceil(n / 2)).otherwise(F.floor(n / 2))
    rows = weeks.withColumn("first", F.row_number().over(part.orderBy("start")) <= cut)
    x, y = F.col("week"), F.col("mean")
    return rows.groupBy(*KEY, "part").agg(slope_of(x, y).alias("slope_all"), slope_of(F.when(F.col("first"), x), y).alias("slope_first"), slope_of(F.when(~F.col("first"), x), y).alias("slope_second"))


def slope(window: DataFrame, eps: float = 0.0) -> DataFrame:
    return window.groupBy(*KEY).agg(slope_of(F.datediff("date", "label_date"), F.col("value"), eps).alias("slope"))


def breakpoint_slopes(weeks: DataFrame) -> DataFrame:
    """Best bend of y ~ 1 + x + (x - b)+ over the weeks b, by n ln(rss/n) + 3 ln n with rss the residual norm.

    Exact fits (NO_RESIDUE) are rejected, ties go to the earlier week. Returns the bend and the slopes of
    the weeks up to it and from it on. A part's weeks, a handful, are gathered in one array, and all its bends
    are scored inside one expression: one shuffle, no pairs.
    """
    key = [*KEY, "part"]
    known = weeks.where("mean is not null").select(*key, F.col("week").cast("double").alias("x"), F.col("mean").alias("y"))
    parts = known.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("w"), F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    total = lambda of, where="w": F.aggregate(where, F.lit(0.0), lambda s, p: s + of(p))
    dx, dy = (lambda p: p.x - F.col("mx")), (lambda p: p.y - F.col("my"))
    parts = parts.withColumns({"xx": total(lambda p: dx(p) * dx(p)), "xy": total(lambda p: dx(p) * dy(p)), "yy": total(lambda p: dy(p) * dy(p))})
    hinge = lambda p, b: F.greatest(p.x - b, F.lit(0.0))
    bends = parts.withColumn("bends", F.transform("w", lambda q: F.struct(q.x.alias("b"), (total(lambda p: hinge(p, q.x)) / F.col("n")).alias("mh"))))
    dh = lambda p, c: hinge(p, c.b) - c.mh
    sums = F.transform("bends", lambda c: F.struct(c.b.alias("b"), total(lambda p: dh(p, c) * dh(p, c)).alias("hh"), total(lambda p: dx(p) * dh(p, c)).alias("xh"), total(lambda p: dh(p, c) * dy(p)).alias("hy")))
    xx, xy, yy, n = (F.col(c) for c in ("xx", "xy", "yy", "n"))

    def left(c: Column) -> Column:
        det = xx * c.hh - c.xh * c.xh
        both = (xy * xy * c.hh - 2 * xy * c.hy * c.xh + c.hy * c.hy * xx) / F.nullif(det, F.lit(0.0))
        return yy - F.when(F.abs(det) > 1e-9, both).when(xx > 0, xy * xy / F.nullif(xx, F.lit(0.0))).otherwise(0.0)

    rest = bends.withColumn("bends", sums).withColumn("bends", F.transform("bends", lambda c: F.struct(c.b.alias("b"), left(c).alias("left"))))
    good = F.filter("bends", lambda c: c.left > NO_RESIDUE * yy)
    scored = F.transform(good, lambda c: F.struct(F.round(n * F.log(F.sqrt(c.left) / n) + 3 * F.log(n), 6).alias("score"), c.b.alias("b")))
    best = rest.withColumn("bend", F.array_min(scored).b).where("bend is not null")

    def slope_in(side: Column) -> Column:
        m, sx, sy = F.size(side), total(lambda p: p.x, side), total(lambda p: p.y, side)
        low = m * total(lambda p: p.x * p.x, side) - sx * sx
        return F.when(low != 0, (m * total(lambda p: p.x * p.y, side) - sx * sy) / F.nullif(low, F.lit(0.0)))

    sides = best.withColumns({"before": F.filter("w", lambda p: p.x <= F.col("bend")), "after": F.filter("w", lambda p: p.x >= F.col("bend"))})
    return sides.select(*key, "bend", slope_in(F.col("before")).alias("slope_before"), slope_in(F.col("after")).alias("slope_after"))


def weekly_trends(window: DataFrame) -> DataFrame:
    """All of the above for each label, feature and part of the week."""
    weeks, key = week_means(window), [*KEY, "part"]
    return half_means(weeks).join(half_slopes(weeks), key).join(breakpoint_slopes(weeks), key, "left")
