"""Split protocols as a relation ``split_id, role, ds_key, pid`` and folds, all from hashes of keys.

A hash of the key and a seed orders participants, so results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.embed import nearest


def shuffled(key: Column | str, seed: int) -> Column:
    """A pseudo-random order that both Spark and SQL engines can compute: integer arithmetic on the key."""
    k = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.pmod(k.cast("bigint"), F.lit(1009)) * 7919 + seed * 104729, F.lit(1009))


def global_number(rows: DataFrame, order: list[Column], tie: str) -> DataFrame:
    """``n``: the row number by ``order``, then ``tie``, from 0, without sorting all rows in one task.

    Rows are counted by order key; only those counts are summed up in one go, and rows are numbered
    within their key. Keys should be few beside rows: sizes, hash classes.
    """
    keyed = rows.select("*", *(c.alias(f"__k{i}") for i, c in enumerate(order)))
    keys = [f"__k{i}" for i in range(len(order))]
    counts = keyed.groupBy(*keys).agg(F.count("*").alias("__c"))
    before = counts.select(*keys, (F.sum("__c").over(Window.orderBy(*keys)) - F.col("__c")).alias("__before"))
    own = F.row_number().over(Window.partitionBy(*keys).orderBy(tie)) - 1
    return keyed.withColumn("__own", own).join(before, keys).withColumn("n", F.col("__before") + F.col("__own")).drop(*keys, "__own", "__before")


def group_folds(rows: DataFrame, group: str, k: int = 5, seed: int = 0, stratify: str | None = None) -> DataFrame:
    """``group, fold``: groups by size (positives first if stratified) dealt out there and back again."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"), (F.sum(F.col(stratify).cast("int")) if stratify else F.lit(0)).alias("positives"))
    numbered = global_number(sizes.withColumnRenamed("n", "size"), [-F.col("positives"), -F.col("size"), shuffled(group, seed)], group)
    turn = F.col("n") % (2 * k)
    return numbered.select(group, F.when(turn < k, turn).otherwise(2 * k - 1 - turn).cast("int").alias("fold"))


def fold_count(rows: DataFrame, label: str, group: str, k: int = 5) -> int:
    """min(k, groups in the class that has fewest)."""
    from tidewell.operators.quality import least_groups

    return min(k, least_groups(rows, label, group).first()["least"] or k)


def fold_classes(rows: DataFrame, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``fold, by, train_rows, train_positives, one_class`` of each fold's training part: all other folds."""
    folds = rows.groupBy("fold", *by).agg(F.sum(F.col(label).cast("int")).alias("p"), F.count("*").alias("n"))
    all_ = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    other_p, other_n = F.sum("p").over(all_) - F.col("p"), F.sum("n").over(all_) - F.col("n")
    return folds.select("fold", *by, other_n.alias("train_rows"), other_p.alias("train_positives"), ((other_p == 0) | (other_p == other_n)).alias("one_class"))


def check_folds(rows: DataFrame, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Folds whose training part has a single class, by further keys if given."""
    return fold_classes(rows, label, by).where("one_class").select("fold", *by)


def folds_with_both_classes(rows: DataFrame, group: str, label: str, k: int = 5, seed: int = 0, tries: int = 20) -> DataFrame:
    """Stratified folds of the first seed for which no training part has a single class."""
    for s in range(seed, seed + tries):
        folded = rows.join(group_folds(rows, group, k, s, label), group)
        if not check_folds(folded, label).head(1):
            return folded
    raise ValueError("no seed gives folds with both classes")


def within_user(points: DataFrame, share: float = 0.2, order: str = "label_date") -> DataFrame:
    """``role``: the last ceil(share * n) rows of each pid are test; a single row is test."""
    mine = Window.partitionBy("pid")
    late = F.row_number().over(mine.orderBy(F.col(order).desc())) <= F.ceil(F.count("*").over(mine) * share)
    return points.withColumn("role", F.when(late, "test").otherwise("train"))


def one_validation_row(points: DataFrame, seed: int = 0, order: str = "label_date") -> DataFrame:
    """``validation``: one row of each pid; ``train``: all others, and the single row of a pid."""
    mine = Window.partitionBy("pid")
    n = F.row_number().over(mine.orderBy(F.pmod(F.datediff(order, F.lit("1970-01-01").cast("date")) * 7919 + F.col("pid").cast("bigint") * 31 + seed, F.lit(1009)), order))
    return points.withColumn("validation", n == 1).withColumn("train", (n > 1) | (F.count("*").over(mine) == 1))


def _years(rows: DataFrame) -> DataFrame:
    """Distinct data sets with institution and phase, from ``institution_phase`` keys."""
    parts = F.split("ds_key", "_")
    return rows.select("ds_key").distinct().select("ds_key", parts[0].alias("institution"), parts[1].cast("int").alias("phase"))


def split_plan(protocol: str, points: DataFrame, k: int = 5, repeats: int = 2, seed: int = 0) -> DataFrame:
    """``split_id, role, ds_key, pid`` for a protocol.

    single: repeated grouped cross-validation in each data set. one_each: train on one, test on every
    other. overlap: train on a year, test on the same people in another year of the institution.
    allbutone: leave one out. crossgroup: pairs that share institution or phase are the test sets.
    crossperiod: pairs of phases that are both up to 2 or both from 3 are the test sets.
    """
    people = points.select("ds_key", "pid").distinct()
    keys = _years(points)
    a, b = (keys.select(*(F.col(c).alias(f"{p}_{c}") for c in keys.columns)) for p in ("a", "b"))
    few = a.crossJoin(F.broadcast(b))  # data sets, not rows: as many as there are study-years

    def placed(plan: DataFrame) -> DataFrame:
        return plan.join(people, "ds_key").select("split_id", "role", "ds_key", "pid")

    def two_roles(pairs: DataFrame) -> DataFrame:
        name = F.concat_ws(">", "a_ds_key", "b_ds_key")
        ends = F.explode(F.array(F.struct(F.lit("train").alias("role"), F.col("a_ds_key").alias("ds_key")), F.struct(F.lit("test").alias("role"), F.col("b_ds_key").alias("ds_key"))))
        return pairs.select(name.alias("split_id"), ends.alias("e")).select("split_id", "e.*")

    if protocol == "single":
        repeat = points.sparkSession.range(repeats).select(F.col("id").alias("repeat"))
        order = Window.partitionBy("ds_key", "repeat").orderBy(F.pmod(F.col("pid").cast("bigint") * 7919 + (F.col("repeat") + seed) * 104729, F.lit(1009)), "pid")
        folds = people.crossJoin(F.broadcast(repeat)).withColumn("fold", (F.row_number().over(order) - 1) % k)
        each = folds.withColumn("test_fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        return each.select(F.concat_ws("/", "ds_key", "repeat", "test_fold").alias("split_id"), F.when(F.col("fold") == F.col("test_fold"), "test").otherwise("train").alias("role"), "ds_key", "pid")
    if protocol == "one_each":
        return placed(two_roles(few.where("a_ds_key <> b_ds_key")))
    if protocol == "overlap":
        plan = placed(two_roles(few.where("a_ds_key <> b_ds_key AND a_institution = b_institution")))
        both = Window.partitionBy("split_id", "pid")
        return plan.withColumn("roles", F.size(F.collect_set("role").over(both))).where("roles = 2").drop("roles")
    if protocol == "allbutone":
        return placed(few.select(F.col("a_ds_key").alias("split_id"), F.when(F.col("a_ds_key") == F.col("b_ds_key"), "test").otherwise("train").alias("role"), F.col("b_ds_key").alias("ds_key")))
    same = {"crossgroup": "a_institution = b_institution OR a_phase = b_phase", "crossperiod": "(a_phase < 2.5) = (b_phase < 2.5)"}[protocol]
    pairs = few.where(f"a_ds_key < b_ds_key AND ({same})").select(F.concat_ws(":", "a_ds_key", "b_ds_key").alias("split_id"), "a_ds_key", "b_ds_key")
    every = pairs.crossJoin(F.broadcast(keys.select("ds_key")))
    held = (F.col("ds_key") == F.col("a_ds_key")) | (F.col("ds_key") == F.col("b_ds_key"))
    return placed(every.select("split_id", F.when(held, "test").otherwise("train").alias("role"), "ds_key"))


def plan_rows(points: DataFrame, plan: DataFrame) -> DataFrame:
    """Datapoints of every split and role; a datapoint comes once for each split it is in."""
    return points.join(plan, ["ds_key", "pid"])


def pid_split(points: DataFrame, share: float = 0.2, seed: int = 0) -> DataFrame:
    """``role`` by participant: floor(share * n) of each data set's are test."""
    people = points.select("ds_key", "pid").distinct()
    mine = Window.partitionBy("ds_key")
    n = F.row_number().over(mine.orderBy(shuffled("pid", seed), "pid"))
    roles = people.withColumn("role", F.when(n <= F.floor(F.round(F.count("*").over(mine) * share, 9)), "test").otherwise("train"))
    return points.join(roles, ["ds_key", "pid"])


def learning_curve(points: DataFrame, fractions: list[float], repeats: int = 5, seed: int = 0) -> DataFrame:
    """Participants for each fraction and repeat: the first ceil(fraction * n) in the repeat's order."""
    people = points.select("ds_key", "pid").distinct()
    grid = points.sparkSession.createDataFrame([(float(f), r) for f in fractions for r in range(repeats)], "fraction double, repeat int")
    mine = Window.partitionBy("ds_key", "fraction", "repeat")
    order = F.pmod(F.col("pid").cast("bigint") * 7919 + (F.col("repeat") + seed) * 104729, F.lit(1009))
    ranked = people.crossJoin(F.broadcast(grid)).withColumn("n", F.row_number().over(mine.orderBy(order, "pid"))).withColumn("of", F.count("*").over(mine))
    return ranked.where(F.col("n") <= F.ceil(F.round(F.col("fraction") * F.col("of"), 9))).select("fraction", "repeat", "ds_key", "pid")


def row_split(rows: DataFrame, share: float = 0.2, seed: int = 0, key: str = "row_id", by: tuple[str, ...] = ("pid",)) -> DataFrame:
    """``role`` by row: ceil(share * n) of each person's rows are test, in the order of a hash of the row."""
    mine = Window.partitionBy(*by)
    n = F.row_number().over(mine.orderBy(shuffled(key, seed), key))
    return rows.withColumn("role", F.when(n <= F.ceil(F.round(F.count("*").over(mine) * share, 9)), "test").otherwise("train"))


def learning_rows(rows: DataFrame, fractions: list[float], repeats: int = 5, unit: str = "pid", seed: int = 0, key: str = "row_id") -> DataFrame:
    """``number, fraction, repeat, key``: the rows of each fraction and repeat; ``number`` counts the fractions.

    With ``unit`` "pid" the first ceil(fraction * n) participants of a data set give all their rows, in the
    repeat's order; of a share below one participant, that one gives ceil(share * rows). With "row" each
    person gives ceil(fraction * rows).
    """
    spark = rows.sparkSession
    grid = F.broadcast(spark.createDataFrame([(k, float(f), r) for k, f in enumerate(fractions) for r in range(repeats)], "number int, fraction double, repeat int"))
    order = lambda c: F.pmod(F.pmod(F.col(c).cast("bigint"), F.lit(1009)) * 7919 + (F.col("repeat") + seed) * 104729, F.lit(1009))
    rows = rows.select(key, "ds_key", "pid")
    person = Window.partitionBy("number", "repeat", "pid", "ds_key").orderBy(order(key), key)
    if unit == "row":
        sizes = rows.groupBy("ds_key", "pid").agg(F.count("*").alias("of"))
        spread = rows.join(sizes, ["ds_key", "pid"]).crossJoin(grid).withColumn("i", F.row_number().over(person))
        return spread.where(F.col("i") <= F.ceil(F.round(F.col("fraction") * F.col("of"), 9))).select("number", "fraction", "repeat", key)
    people = rows.groupBy("ds_key", "pid").agg(F.count("*").alias("of"))
    mine = Window.partitionBy("ds_key", "number", "repeat")
    chosen = people.crossJoin(grid).withColumn("i", F.row_number().over(mine.orderBy(order("pid"), "pid"))).withColumn("share", F.round(F.col("fraction") * F.count("*").over(mine), 9))
    chosen = chosen.where(F.col("i") <= F.ceil("share"))
    spread = rows.join(chosen, ["ds_key", "pid"]).withColumn("j", F.row_number().over(person))
    return spread.where((F.col("share") >= 1) | (F.col("j") <= F.ceil(F.round(F.col("share") * F.col("of"), 9)))).select("number", "fraction", "repeat", key)


def mining_holdout(points: DataFrame, share: float = 0.35, seed: int = 0) -> DataFrame:
    """``mining``: floor(share * n) of all participants are held for rule mining."""
    people = points.select("pid").distinct()
    total = people.agg(F.count("*").alias("total"))
    numbered = global_number(people, [shuffled("pid", seed)], "pid").crossJoin(F.broadcast(total))
    # a product such as 90000 * 0.35 lies just below the whole number it stands for
    return numbered.select("pid", (F.col("n") < F.floor(F.round(F.col("total") * share, 9))).alias("mining"))


def oversample(rows: DataFrame, label: str, order: list[str]) -> DataFrame:
    """Every class brought up to the largest by repeating its rows in order, evenly; ``copy`` numbers them."""
    counts = rows.groupBy(label).agg(F.count("*").alias("__n"))
    counts = counts.withColumn("__most", F.max("__n").over(Window.partitionBy(F.lit(1))))
    numbered = rows.withColumn("__i", F.row_number().over(Window.partitionBy(label).orderBy(*order)) - 1).join(F.broadcast(counts), label)
    times = F.floor(F.col("__most") / F.col("__n")) + F.when(F.col("__i") < F.col("__most") % F.col("__n"), 1).otherwise(0)
    return numbered.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), times.cast("bigint")))).drop("__n", "__most", "__i")


def smote(rows: DataFrame, label: str, key: str, vector: str, k: int = 2, seed: int = 0) -> DataFrame:
    """New rows of each smaller class between a member and one of its k nearest of the class."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    lacking = counts.withColumn("lack", F.max("n").over(Window.partitionBy(F.lit(1))) - F.col("n")).where("lack > 0 AND n > 1")
    small = rows.join(F.broadcast(lacking), label)
    points = small.select(label, F.col(key).alias("id"), F.col(vector).alias("x"))
    close = nearest(points, points, k, [label], apart=True).select(label, F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.col("rank").alias("near"))
    a, b = small.select(label, "lack", "n", F.col(key).alias("a"), F.col(vector).alias("__x")), small.select(label, F.col(key).alias("b"), F.col(vector).alias("__y"))
    near = close.where(F.col("near") <= k).join(a, [label, "a"]).join(b, [label, "b"])
    per = F.ceil(F.col("lack") / F.col("n"))
    made = near.where(F.col("near") == 1 + F.pmod(F.xxhash64("a", F.lit(seed)), F.least(F.lit(k), F.col("n") - 1))).withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), per.cast("bigint"))))
    made = made.withColumn("m", F.row_number().over(Window.partitionBy(label).orderBy("i", F.xxhash64("a", F.lit(seed))))).where("m <= lack")
    u = F.pmod(F.xxhash64("a", "i", F.lit(seed)), F.lit(1000003)) / 1000003.0
    return made.select(F.col("a").alias(key), label, F.zip_with("__x", "__y", lambda p, q: p + u * (q - p)).alias(vector))
