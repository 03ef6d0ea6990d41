"""Metrics of predictions ``y, pred, score`` by any keys, and result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.ordered import cut, running


def _rate(top: Column, low: Column, empty: float) -> Column:
    return F.when(low == 0, empty).otherwise(top / low)


def binary_report(pred: DataFrame, by: list[str]) -> DataFrame:
    """Counts and rates. Without predicted (actual) positives precision (recall) is 1, without negatives
    specificity is 1, MCC is 1 if a margin is 0, kappa is 1 if chance agreement is, F1 is 0 if both are 0."""
    y, p = F.col("y") == 1, F.col("pred") == 1
    count = lambda c: F.sum(c.cast("double"))
    t = pred.groupBy(*by).agg(count(y & p).alias("tp"), count(y & ~p).alias("fn"), count(~y & p).alias("fp"), count(~y & ~p).alias("tn"))
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    n = tp + fn + fp + tn
    t = t.withColumns({"acc": (tp + tn) / n, "precision": _rate(tp, tp + fp, 1.0), "recall": _rate(tp, tp + fn, 1.0), "specificity": _rate(tn, tn + fp, 1.0), "npv": _rate(tn, tn + fn, 1.0)})
    pr, re, sp, npv = (F.col(c) for c in ("precision", "recall", "specificity", "npv"))
    margins = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    chance = ((tp + fp) * (tp + fn) + (tn + fp) * (tn + fn)) / (n * n)
    return t.withColumns({"balanced_acc": (re + sp) / 2, "f1": _rate(2 * pr * re, pr + re, 0.0), "f1_neg": _rate(2 * npv * sp, npv + sp, 0.0), "mcc": F.when(margins == 0, 1.0).otherwise((tp * tn - fp * fn) / F.sqrt(margins)), "kappa": F.when(chance == 1, 1.0).otherwise((F.col("acc") - chance) / (1 - chance))})


def auc(pred: DataFrame, by: list[str]) -> DataFrame:
    """Area under the ROC curve, from counts by score; with one class, the balanced accuracy.

    Scores are counted first, so only distinct scores are ordered; ties count a half.
    """
    y = F.col("y") == 1
    counts = cut(pred.groupBy(*by, "score").agg(F.sum(y.cast("double")).alias("p"), F.sum((~y).cast("double")).alias("q")))
    areas = running(counts, by, "score", ["q"]).groupBy(*by).agg(F.sum(F.col("p") * (F.col("below_q") + F.col("q") / 2)).alias("area"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    both = areas.join(binary_report(pred, by).select(*by, "balanced_acc"), by) if by else areas.crossJoin(binary_report(pred, by).select("balanced_acc"))
    return both.select(*by, F.when((F.col("p") == 0) | (F.col("q") == 0), F.col("balanced_acc")).otherwise(F.col("area") / (F.col("p") * F.col("q"))).alias("auc"))


def multiclass_report(pred: DataFrame, by: list[str]) -> DataFrame:
    """Per class: precision, recall, f1, acc (one against the rest), support; with macro and weighted means of the first three."""
    ends = pred.select(*by, F.explode(F.array(F.struct(F.col("y").alias("class"), F.lit(1).alias("actual"), (F.col("y") == F.col("pred")).cast("int").alias("hit")), F.struct(F.col("pred").alias("class"), F.lit(0).alias("actual"), F.lit(0).alias("hit")))).alias("e")).select(*by, "e.*")
    t = ends.groupBy(*by, "class").agg(F.sum("hit").alias("tp"), F.sum("actual").alias("support"), F.sum(1 - F.col("actual")).alias("predicted"))
    n = F.sum("support").over(Window.partitionBy(*by))
    t = t.withColumns({"precision": _rate(F.col("tp"), F.col("predicted"), 1.0), "recall": _rate(F.col("tp"), F.col("support"), 1.0), "acc": (n - F.col("support") - F.col("predicted") + 2 * F.col("tp")) / n})
    t = t.withColumn("f1", _rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0))
    all_ = Window.partitionBy(*by)  # a row a class
    means = {f"macro_{c}": F.avg(c).over(all_) for c in ("precision", "recall", "f1")}
    means |= {f"weighted_{c}": F.sum(F.col(c) * F.col("support")).over(all_) / F.sum("support").over(all_) for c in ("precision", "recall", "f1")}
    return t.withColumns(means)


def one_vs_rest_auc(pred: DataFrame, by: list[str], scores: str = "scores") -> DataFrame:
    """``by, class, auc, macro_auc, weighted_auc``: each class's score against the rest, ties a half.

    ``scores``: an array of ``struct<class, score>`` a row. A class that no row or every row has has no area
    and counts in no mean; weights are the classes' rows.
    """
    long = pred.select(*by, "y", F.explode(scores).alias("s")).select(*by, F.col("s.class").alias("class"), F.col("s.score").alias("score"), (F.col("y") == F.col("s.class")).alias("own"))
    keys = [*by, "class"]
    counts = cut(long.groupBy(*keys, "score").agg(F.count_if("own").cast("double").alias("p"), F.count_if(~F.col("own")).cast("double").alias("q")))
    areas = running(counts, keys, "score", ["q"]).groupBy(*keys).agg(F.sum(F.col("p") * (F.col("below_q") + F.col("q") / 2)).alias("area"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    found = areas.withColumn("auc", F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("area") / (F.col("p") * F.col("q"))))
    all_ = Window.partitionBy(*by)  # a row a class
    weight = F.when(F.col("auc").isNotNull(), F.col("p"))
    return found.select(*keys, "auc", F.avg("auc").over(all_).alias("macro_auc"), (F.sum(F.col("auc") * weight).over(all_) / F.sum(weight).over(all_)).alias("weighted_auc"))


def log_likelihood(pred: DataFrame, by: list[str], eps: float = 1e-15) -> DataFrame:
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col("score")))
    return pred.groupBy(*by).agg(F.sum(F.when(F.col("y") == 1, F.log(p)).otherwise(F.log(1 - p))).alias("log_likelihood"))


def best_threshold(pred: DataFrame, by: list[str]) -> DataFrame:
    """Score from which on to say positive for the best balanced accuracy; the highest of several.

    With one class there is no balanced accuracy, and the highest score is returned.
    """
    y = F.col("y") == 1
    counts = cut(pred.groupBy(*by, "score").agg(F.sum(y.cast("double")).alias("p"), F.sum((~y).cast("double")).alias("q")))
    totals = counts.groupBy(*by).agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q"))
    ordered = running(counts, by, "score", ["p", "q"])
    ordered = ordered.join(F.broadcast(totals), by) if by else ordered.crossJoin(F.broadcast(totals))
    share = lambda c: F.try_divide(F.col(f"all_{c}") - F.col(f"below_{c}"), F.col(f"all_{c}"))  # noqa: E731  of those from the score on
    scored = ordered.withColumn("balanced_acc", F.round((share("p") + 1 - share("q")) / 2, 9))
    return scored.groupBy(*by).agg(F.max_by("score", F.struct("balanced_acc", "score")).alias("threshold"), F.max("balanced_acc").alias("balanced_acc"))


def best_row(history: DataFrame, metric: str, mode: str = "min", limit: int = 1000, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """The epoch with the least (greatest) metric among the first ``limit``; the earlier of several."""
    early = history.where(F.col("epoch") < limit).where(F.col(metric).isNotNull())
    pick = F.min_by("epoch", F.struct(metric, "epoch")) if mode == "min" else F.max_by("epoch", F.struct(F.col(metric), -F.col("epoch")))
    return early.groupBy(*by).agg(pick.alias("epoch"), (F.min(metric) if mode == "min" else F.max(metric)).alias(metric))


def running_best(history: DataFrame, a: str, b: str, limit: int = 1000, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """The best ``b`` among the epochs at which ``a`` had its best so far."""
    before = Window.partitionBy(*by).orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    best = history.where(F.col("epoch") < limit).withColumn("held", F.max_by(F.struct("epoch", b), F.struct(F.col(a), -F.col("epoch"))).over(before))
    return best.groupBy(*by).agg(F.max_by("held", F.struct(F.col(f"held.{b}"), -F.col("epoch"))).alias("h")).select(*by, "h.*")


def results_pivot(results: DataFrame, metric: str, sets: list[str]) -> DataFrame:
    """Models by test sets with the row's mean and standard error."""
    own = results.where(F.col("metric") == metric)
    table = own.groupBy("model").pivot("ds_test", sets).agg(F.avg("value"))
    rows = own.where(F.col("ds_test").isin(sets)).groupBy("model", "ds_test").agg(F.avg("value").alias("v")).groupBy("model").agg(F.avg("v").alias("average"), (F.stddev_samp("v") / F.sqrt(F.count("v"))).alias("sem"))
    return table.join(rows, "model")


def model_order(results: DataFrame, metric: str) -> DataFrame:
    rows = results.where(F.col("metric") == metric).groupBy("model").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return rows.orderBy(F.col("mean").desc(), "model")
