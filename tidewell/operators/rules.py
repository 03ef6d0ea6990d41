"""Day baskets, association rules, group contrasts and rule features."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def item_codes(levels: DataFrame) -> DataFrame:
    """``feature, level, item``: numbers of the (feature, level) pairs in order; as many rows as kinds."""
    kinds = levels.where("level is not null").select("feature", "level").distinct()
    return kinds.withColumn("item", F.row_number().over(Window.orderBy("feature", "level")) - 1)


def baskets(levels: DataFrame, codes: DataFrame, n_features: int, share: float = 0.5) -> DataFrame:
    """``pid, date, items``: one basket for each person-day with more than one item, unless more than
    ``share`` of the features are missing."""
    coded = levels.where("level is not null").join(F.broadcast(codes), ["feature", "level"])
    days = coded.groupBy("pid", "date").agg(F.sort_array(F.collect_set("item")).alias("items"), F.countDistinct("feature").alias("held"))
    return days.where((n_features - F.col("held") <= share * n_features) & (F.size("items") > 1)).drop("held")


def mine_rules(days: DataFrame, min_supp: float = 0.5, min_conf: float = 0.7) -> DataFrame:
    """``antecedent, consequent, support, confidence, lift`` by FP-Growth; consequents are single items."""
    return FPGrowth(itemsCol="items", minSupport=min_supp, minConfidence=min_conf).fit(days).associationRules


def pair_rules(days: DataFrame, min_supp: float, min_conf: float, group: str | None = None) -> DataFrame:
    """Rules of two single items, from counts alone; with ``group`` those of each group, in one pass."""
    by = [group] if group else []
    # a basket also counts as a pair of each item with itself, and of nothing with nothing
    none = F.array(F.struct(F.lit(-1).alias("x"), F.lit(-1).alias("z")))
    pairs = F.flatten(F.transform("items", lambda x: F.transform("items", lambda z: F.struct(x.alias("x"), z.alias("z")))))
    counts = days.select(*by, F.explode(F.concat(none, pairs)).alias("p")).groupBy(*by, "p.x", "p.z").agg(F.count("*").alias("both"))
    # kinds of items are few: their counts go to every task that has pairs
    one = counts.where("x = z AND x >= 0")
    total = counts.where("x < 0").select(*by, F.col("both").alias("total"))
    joined = counts.where("x <> z").join(one.select(*by, "x", F.col("both").alias("nx")), [*by, "x"]).join(one.select(*by, "z", F.col("both").alias("nz")), [*by, "z"])
    joined = joined.join(F.broadcast(total), by) if by else joined.crossJoin(F.broadcast(total))
    made = joined.select(*by, "x", "z", (F.col("both") / F.col("total")).alias("support"), (F.col("both") / F.col("nx")).alias("confidence"), (F.col("both") * F.col("total") / (F.col("nx") * F.col("nz"))).alias("lift"))
    return made.where((F.col("support") >= min_supp) & (F.col("confidence") >= min_conf))


def contrast_rules(pos: DataFrame, neg: DataFrame, on: tuple[str, str] = ("antecedent", "consequent")) -> DataFrame:
    """Rules of both groups side by side, absent ones 0, with the differences."""
    names = ("support", "confidence", "lift")
    a, b = (t.select(*on, *(F.col(c).alias(f"{c}_{s}") for c in names)) for t, s in ((pos, "pos"), (neg, "neg")))
    both = a.join(b, list(on), "full_outer").na.fill(0.0, [f"{c}_{s}" for c in names for s in ("pos", "neg")])
    return both.withColumns({f"{c}_diff": F.col(f"{c}_pos") - F.col(f"{c}_neg") for c in names})


def two_sided() -> Column:
    """Whether both groups have the rule."""
    return (F.col("confidence_pos") > 0) & (F.col("confidence_neg") > 0)


def passing_rules(rules: DataFrame, supp: float, conf: float) -> DataFrame:
    """Rules that in either group reach the least support and confidence, each raised by its median absolute
    difference over the rules that both groups have (by nothing if there is none)."""
    middle = rules.where(two_sided()).agg(*(F.coalesce(F.percentile(F.abs(f"{c}_diff"), 0.5), F.lit(0.0)).alias(m) for c, m in (("support", "ms"), ("confidence", "mc"))))
    ok = lambda g: (F.col(f"support_{g}") >= supp + F.col("ms")) & (F.col(f"confidence_{g}") >= conf + F.col("mc"))
    return rules.crossJoin(F.broadcast(middle)).where(ok("pos") | ok("neg")).drop("ms", "mc")


def rule_interest(rules: DataFrame, w: tuple[float, float, float] = (1.0, 1.0, 1.0), size: str | None = None) -> DataFrame:
    """``interest``: sign(dx) sign(dc) |X|^w1 |dx|^w2 |dc|^w3, with dx the difference of the antecedent's
    shares (support / confidence) and dc that of the confidences; and ``supp_delta``.

    supp_delta = (2 ds + (y2 - y1)(s1 + s2)) / (y1 + y2), with y the consequent's shares (confidence /
    lift). A group without the rule has 0 for all of them.
    """
    share = lambda top, low: F.coalesce(F.try_divide(F.col(top), F.col(low)), F.lit(0.0))
    x1, x2 = (share(f"support_{g}", f"confidence_{g}") for g in ("pos", "neg"))
    y1, y2 = (share(f"confidence_{g}", f"lift_{g}") for g in ("pos", "neg"))
    dx, dc = x1 - x2, F.col("confidence_diff")
    n = F.size(size) if size else F.lit(1)
    made = F.signum(dx) * F.signum(dc) * F.pow(n, F.lit(w[0])) * F.pow(F.abs(dx), F.lit(w[1])) * F.pow(F.abs(dc), F.lit(w[2]))
    delta = F.try_divide(2 * F.col("support_diff") + (y2 - y1) * (F.col("support_pos") + F.col("support_neg")), y1 + y2)
    return rules.withColumn("interest", made).withColumn("supp_delta", delta)


def closed_rules(rules: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Without rules whose antecedent and consequent are parts of another rule's of the list, one of them proper."""
    keys = keys or []
    a = rules.withColumn("__id", F.xxhash64(*[F.to_json(F.struct(c)) for c in ("antecedent", "consequent")]))
    b = a.select(*keys, F.col("antecedent").alias("x2"), F.col("consequent").alias("y2"), F.col("__id").alias("other"))
    # a containing rule shares an item of the consequent: an equal join, then the test of containment
    left = a.select(*keys, "antecedent", "consequent", "__id", F.col("consequent")[0].alias("item"))
    right = b.withColumn("item", F.explode("y2"))
    inside = (F.size(F.array_except("antecedent", "x2")) == 0) & (F.size(F.array_except("consequent", "y2")) == 0) & ((F.size("antecedent") < F.size("x2")) | (F.size("consequent") < F.size("y2")))
    covered = left.join(right, [*keys, "item"]).where((F.col("__id") != F.col("other")) & inside).select("__id").distinct()
    return a.join(covered, "__id", "left_anti").drop("__id")


def select_rules(rules: DataFrame, w: tuple[float, float, float] = (1.0, 1.0, 1.0), k: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """Of the rules that both groups have, and again of those that one has, the k of greatest (signed)
    interest among the closed ones of the first 5k; by further keys. ``sided``: 2 or 1, ``rank`` within it."""
    scored = rule_interest(rules, w, "antecedent").withColumn("sided", F.when(two_sided(), 2).otherwise(1))
    keys = [*by, "sided"]
    order = Window.partitionBy(*keys).orderBy(F.round("interest", 12).desc(), F.to_json(F.struct("antecedent", "consequent")))
    first = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 5 * k).drop("rank")
    closed = closed_rules(first, keys)
    return closed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rule_features(days: DataFrame, levels: DataFrame, rules: DataFrame, role: str = "train") -> DataFrame:
    """Mean and standard deviation of each rule's consequent feature over the days on which all antecedent
    levels hold, by datapoint. ``days``: pid, label_date, date, items. ``levels``: pid, date, item, value.
    ``rules``: rule, antecedent, item (of the consequent). Training drops empty rules, tests keep them.
    """
    first = rules.withColumn("__a", F.col("antecedent")[0])
    match = days.withColumn("__a", F.explode("items")).join(F.broadcast(first), "__a").where(F.size(F.array_except("antecedent", "items")) == 0)
    values = match.join(levels, ["pid", "date", "item"]).groupBy("pid", "label_date", "rule").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    if role == "train":
        return values
    grid = days.select("pid", "label_date").distinct().crossJoin(F.broadcast(rules.select("rule")))
    return grid.join(values, ["pid", "label_date", "rule"], "left")


def threshold_policy(n_pids: int, n_points: int, table: dict[str, dict], overlap: bool = False) -> dict:
    """Parameters by cohort size: overlap first, then tiny (<= 15), small (<= 30, or < 15 datapoints), full."""
    name = "overlap" if overlap else "tiny" if n_pids <= 15 else "small" if n_pids <= 30 or n_points < 15 else "full"
    return table.get(name, table["full"])
