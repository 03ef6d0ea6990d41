"""Estimators, grids, selection and evaluation on spark.ml."""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators import forest, linear
from tidewell.operators.metrics import auc, best_threshold, binary_report, log_likelihood
from tidewell.operators.ordered import cut
from tidewell.plans.splits import learning_rows, plan_rows

KINDS = {"rf": RandomForestClassifier, "dt": DecisionTreeClassifier, "lr": LogisticRegression, "mlp": MultilayerPerceptronClassifier, "svm": LinearSVC, "gbt": GBTClassifier}

#: Costs of a family's lasso and sizes of its boosted model: the published grids. Sizes of the upper model, up to the published base's 50.
COSTS, SIZES, TOP = tuple(10.0**k for k in range(-4, 5)), tuple(range(4, 41, 4)), tuple(range(10, 51, 10))


def make_estimator(kind: str, params: dict | None = None) -> Estimator:
    """A classifier on ``features`` and ``label``; "adaboost" gives :class:`AdaBoost`."""
    return AdaBoost(**(params or {})) if kind == "adaboost" else KINDS[kind](**{"labelCol": "label", "featuresCol": "features", **(params or {})})


def predictions(model, rows: DataFrame) -> DataFrame:  # noqa: ANN001
    """The rows with ``y, pred, score``; a model without probabilities gets the logistic of its margin."""
    out = model.transform(rows)
    if "score" not in out.columns:
        score = vector_to_array("probability")[1] if "probability" in out.columns else 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
        out = out.withColumn("score", score).withColumn("pred", F.col("prediction").cast("int"))
    return out.withColumn("y", F.col("label").cast("int"))


def grid(**values: list) -> list[dict]:
    """All combinations of parameter values."""
    out: list[dict] = [{}]
    for name, options in values.items():
        out = [{**o, name: v} for o in out for v in options]
    return out


def elastic_net_grid(n: int) -> list[dict]:
    return [{"regParam": 1 / (c * n), "elasticNetParam": r} for r in (0.0, 0.5, 1.0) for c in (0.1, 1.0, 10.0)]


def lasso_grid(n: int) -> list[dict]:
    return [{"regParam": 1 / (2.0**e * n), "elasticNetParam": 1.0} for e in range(-15, 16)]


def svm_grid(n: int) -> list[dict]:
    return [{"regParam": 1 / (c * n)} for c in (0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0, 10000.0)]


def at_once(jobs: list[Callable[[], object]], parallelism: int = 8) -> list:
    """Results of Spark jobs that the driver starts side by side; their plans share the cluster."""
    with ThreadPoolExecutor(max(1, min(parallelism, len(jobs)))) as pool:
        return list(pool.map(lambda job: job(), jobs))


def grid_search(rows: DataFrame, kind: str | Callable[[dict], object], params: list[dict], metric: str = "balanced_acc") -> tuple[dict, DataFrame]:
    """Best parameters by the mean metric over the folds in ``fold``, and all means (``params, mean``).

    Elastic-net grids of ``lr`` over ``x`` are fitted together, all folds at once; other kinds are fitted side
    by side. Either way the held-out scores of all fits make one relation, whose metrics are one aggregation.
    """
    rows = linear.compact(rows)
    folds = [r.fold for r in rows.select("fold").distinct().orderBy("fold").collect()]
    if kind == "lr" and "x" in rows.columns and all(set(p) <= {"regParam", "elasticNetParam"} for p in params):
        d = len(rows.select("x").first()["x"])
        what = linear.standard(rows, d, linear.fits([p.get("regParam", 0.0) for p in params], [p.get("elasticNetParam", 0.0) for p in params], folds, np.ones(d)))
        scored = linear.score_many(rows, d, linear.fit_many(rows, d, what), what)
        scored = scored.select(F.floor(F.col("model") / len(folds)).cast("int").alias("params"), "fold", "y", (F.col("score") > 0.5).cast("int").alias("pred"), "score")
    else:

        def held_out(number: int, fold: int) -> DataFrame:
            estimator = kind(params[number]) if callable(kind) else make_estimator(kind, params[number])
            model = estimator.fit(rows.where(F.col("fold") != fold))
            return predictions(model, rows.where(F.col("fold") == fold)).select(F.lit(number).alias("params"), F.lit(fold).alias("fold"), "y", "pred", "score")

        parts = at_once([lambda n=n, f=f: held_out(n, f) for n in range(len(params)) for f in folds])
        scored = reduce(DataFrame.union, parts)
    found = metrics(scored, ["params", "fold"]).groupBy("params").agg(F.avg(metric).alias("mean"))
    means = rows.sparkSession.createDataFrame([(r["params"], r["mean"]) for r in found.collect()], "params int, mean double")  # a row a parameter
    rows.unpersist()
    return params[means.orderBy(F.desc_nulls_last("mean"), "params").first()["params"]], means


def metrics(pred: DataFrame, by: list[str]) -> DataFrame:
    parts = [binary_report(pred, by), auc(pred, by), log_likelihood(pred, by)]
    for part in parts[1:]:
        parts[0] = parts[0].join(part, by) if by else parts[0].crossJoin(part)
    return parts[0]


def evaluate(points: DataFrame, plan: DataFrame, kind: str, params: dict | None = None) -> DataFrame:
    """``split_id, role, <metrics>``: one fit on the training rows of each split, all rows scored, one aggregation."""
    rows = plan_rows(points, plan).cache()
    scored = None
    for split in [r.split_id for r in plan.select("split_id").distinct().orderBy("split_id").collect()]:
        own = rows.where(F.col("split_id") == split)
        out = predictions(make_estimator(kind, params).fit(own.where("role = 'train'")), own).select("split_id", "role", "y", "pred", "score")
        scored = out if scored is None else scored.union(out)
    found = metrics(scored, ["split_id", "role"]).collect()  # a row a split and role
    rows.unpersist()
    return points.sparkSession.createDataFrame(found)


def random_features(vector: Column, n_in: int, n_out: int = 64, gamma: float = 0.1, seed: int = 0) -> Column:
    """Random Fourier features of an array: a linear model on them approximates an RBF kernel."""
    random = np.random.default_rng(seed)
    w, b = random.normal(0, math.sqrt(2 * gamma), (n_out, n_in)), random.uniform(0, 2 * math.pi, n_out)
    dot = lambda row: F.aggregate(F.zip_with(vector, F.array(*map(F.lit, row.tolist())), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    return F.array(*(F.cos(dot(w[k]) + float(b[k])) * math.sqrt(2 / n_out) for k in range(n_out)))


class AdaBoost:
    """SAMME over trees of spark.ml: each round refits with the weights of rows that were missed raised."""

    def __init__(self, rounds: int = 10, maxDepth: int = 2, rate: float = 1.0, seed: int = 0):  # noqa: N803
        self.rounds, self.depth, self.rate, self.seed, self.trees = rounds, maxDepth, rate, seed, []

    def fit(self, rows: DataFrame) -> AdaBoost:
        made = AdaBoost(self.rounds, self.depth, self.rate, self.seed)
        held = linear.compact(rows.select("features", "label", F.lit(1.0).alias("w")))
        for r in range(self.rounds):
            tree = DecisionTreeClassifier(maxDepth=self.depth, weightCol="w", seed=self.seed + r).fit(held)
            scored = tree.transform(held).withColumn("miss", (F.col("prediction") != F.col("label")).cast("double"))
            miss = scored.agg(F.sum(F.col("miss") * F.col("w")), F.sum("w")).first()
            error = min(max((miss[0] or 0.0) / miss[1], 1e-10), 1 - 1e-10)
            alpha = self.rate * math.log((1 - error) / error)
            made.trees.append((alpha, tree))
            if alpha <= 0 or error <= 1e-9:
                break
            # the weights of a round are written once: later rounds neither keep nor run the earlier trees
            held = cut(scored.select("features", "label", (F.col("w") * F.exp(alpha * F.col("miss"))).alias("w")))
        return made

    def transform(self, rows: DataFrame) -> DataFrame:
        total = F.lit(0.0)
        for k, (alpha, tree) in enumerate(self.trees):
            rows = tree.transform(rows).withColumn(f"vote_{k}", F.col("prediction")).drop("prediction", "rawPrediction", "probability")
            total = total + alpha * (2 * F.col(f"vote_{k}") - 1)
        span = sum(abs(a) for a, _ in self.trees) or 1.0
        return rows.withColumn("score", (total / span + 1) / 2).withColumn("pred", (F.col("score") > 0.5).cast("int")).drop(*(f"vote_{k}" for k in range(len(self.trees))))


class PerDevice:
    """A model for each device: a device whose training rows have one class predicts it, one without
    training rows takes the model of all rows."""

    def __init__(self, kind: str, params: dict | None = None):
        self.kind, self.params, self.models, self.single = kind, params, {}, {}

    def fit(self, rows: DataFrame) -> PerDevice:
        made = PerDevice(self.kind, self.params)
        counts = rows.groupBy("device").agg(F.sum("label").alias("p"), F.count("*").alias("n")).collect()  # a row a device
        for c in counts:
            if c.p in (0, c.n):
                made.single[c.device] = 1.0 if c.p else 0.0
            else:
                made.models[c.device] = make_estimator(self.kind, self.params).fit(rows.where(F.col("device") == c.device))
        made.models[None] = make_estimator(self.kind, self.params).fit(rows)
        return made

    def transform(self, rows: DataFrame) -> DataFrame:
        """The rows with ``score`` and ``pred``."""
        known = [*self.single, *(d for d in self.models if d is not None)]
        out = predictions(self.models[None], rows.where(~F.col("device").isin(known) if known else F.lit(True))).select(*rows.columns, "score", "pred")
        for device, one in self.single.items():
            own = rows.where(F.col("device") == device)
            out = out.union(own.select(*rows.columns, F.lit(one).alias("score"), F.lit(int(one)).alias("pred")))
        for device, model in self.models.items():
            if device is not None:
                out = out.union(predictions(model, rows.where(F.col("device") == device)).select(*rows.columns, "score", "pred"))
        return out


def per_device(rows: DataFrame, kind: str, params: dict | None = None) -> DataFrame:
    """All rows with ``y, pred, score`` of :class:`PerDevice` fitted on those of role train."""
    return predictions(PerDevice(kind, params).fit(rows.where("role = 'train'")), rows)


class MultiTask:
    """:func:`multi_task` over the devices as tasks: each row is scored by its task's coefficients, and
    positive from the score on that is best on the training rows of all tasks."""

    def __init__(self, n_features: int, g1: float = 0.01, g2: float = 1.0, column: str = "device"):
        self.n, self.g1, self.g2, self.column, self.parts, self.threshold = n_features, g1, g2, column, {}, 0.5

    def fit(self, rows: DataFrame) -> MultiTask:
        made = MultiTask(self.n, self.g1, self.g2, self.column)
        tasks = sorted(r[0] for r in rows.select(self.column).distinct().collect())
        models, c = multi_task(rows.withColumn("task", F.col(self.column)), tasks, self.n, self.g1, self.g2)
        made.parts = {t: ((m.coefficients.toArray() * c).tolist(), float(m.intercept)) for t, m in models.items()}
        scored = made._scored(rows).withColumn("y", F.col("label").cast("int"))
        made.threshold = best_threshold(scored, []).first()["threshold"]
        return made

    def _scored(self, rows: DataFrame) -> DataFrame:
        margin = F.lit(0.0)
        for task, (weights, intercept) in self.parts.items():
            dot = F.aggregate(F.zip_with("x", F.array(*map(F.lit, weights)), lambda x, w: x * w), F.lit(intercept), lambda s, v: s + v)
            margin = F.when(F.col(self.column) == task, dot).otherwise(margin)
        return rows.withColumn("score", 1 / (1 + F.exp(-margin)))

    def transform(self, rows: DataFrame) -> DataFrame:
        return self._scored(rows).withColumn("pred", (F.col("score") >= self.threshold).cast("int"))


def multi_task(rows: DataFrame, tasks: list[str], n_features: int, g1: float, g2: float, p: int = 1, k: int = 1, rounds: int = 10) -> tuple[dict, np.ndarray]:
    """Lasso models of several tasks on features scaled by a shared c, which follows their coefficients:
    c = (g1 |sum alpha^p| / g2)^(1/(p+k)) sign; stops when c moves by less than 0.01."""
    c = np.ones(n_features)
    rows, models = rows.cache(), {}
    for _ in range(rounds):
        scaled = rows.withColumn("features", array_to_vector(F.zip_with("x", F.array(*map(F.lit, c.tolist())), lambda x, s: x * s)))
        models = {t: LogisticRegression(elasticNetParam=1.0, regParam=g1).fit(scaled.where(F.col("task") == t)) for t in tasks}
        total = sum(np.abs(m.coefficients.toArray()) ** p for m in models.values())
        new = (g1 * np.abs(total) / g2) ** (1 / (p + k)) * np.sign(total)
        moved, c = np.abs(new - c).sum(), new
        if moved < 0.01:
            break
    rows.unpersist()
    return models, c


def staged(model, rows: DataFrame, sizes: tuple[int, ...], keep: list[str]) -> DataFrame:  # noqa: ANN001
    """``size, p`` beside ``keep``: positive probabilities of a boosted model's first trees.

    One transform gives each tree's leaf; what a leaf adds is read from the trees, leaves from left to right.
    """

    def leaves(node) -> list[float]:  # noqa: ANN001
        return [node.prediction()] if node.subtreeDepth() == 0 else leaves(node.leftChild()) + leaves(node.rightChild())

    added = [[w * v for v in leaves(tree._java_obj.rootNode())] for tree, w in zip(model.trees, model.treeWeights, strict=True)]
    values = F.array(*(F.array(*map(F.lit, v)) for v in added))
    parts = F.zip_with(vector_to_array("__leaf"), values, lambda leaf, v: v[leaf.cast("int")])
    rows = model.copy().setLeafCol("__leaf").transform(rows).select(*keep, parts.alias("__parts"))
    margin = lambda size: F.aggregate(F.slice("__parts", 1, size), F.lit(0.0), lambda s, v: s + v)
    options = F.array(*(F.struct(F.lit(size).alias("size"), (1 / (1 + F.exp(-2 * margin(size)))).alias("p")) for size in sizes))
    return rows.select(*keep, F.explode(options).alias("o")).select(*keep, "o.size", "o.p")


def boosted(features: str, size: int, seed: int = 0) -> GBTClassifier:
    return GBTClassifier(featuresCol=features, labelCol="label", maxIter=size, maxDepth=3, stepSize=0.1, seed=seed)


class Stacking(Estimator):
    """A model a feature family, and a boosted model on their positive probabilities.

    ``families`` names the places in ``x`` of each family. All their elastic nets, of every cost and without
    every fold, are fitted together; of a boosted model one fit a fold gives all sizes. A family takes the
    option with the best mean F1 over the folds. The upper model learns from probabilities that come from
    models which never saw the row: ``row_id, family, fold, probability``, kept as ``unseen``. Its size is
    chosen by the same folds. Rows: ``row_id bigint, x, label, fold``.
    """

    def __init__(self, families: dict[str, list[int]], costs: tuple[float, ...] | None = None, sizes: tuple[int, ...] | None = None, top: tuple[int, ...] | None = None):
        super().__init__()
        self.families, self.costs, self.sizes, self.top = families, costs or COSTS, sizes or SIZES, top or TOP

    def _fit(self, rows: DataFrame) -> StackingModel:
        rows = linear.compact(rows.select("row_id", F.col("x").cast("array<double>").alias("x"), F.col("label").cast("double").alias("label"), F.col("fold").cast("bigint").alias("fold")))
        facts = rows.groupBy("fold").agg(F.count("*").alias("n")).orderBy("fold").collect()
        folds, n, d = [r["fold"] for r in facts], sum(r["n"] for r in facts), len(rows.select("x").first()["x"])
        names = list(self.families)

        member = np.array([[k in self.families[f] for k in range(d)] for f in names], float)
        every = [*folds, -1]
        reg = [1 / (c * n) for _ in names for c in self.costs]
        what = linear.fits(reg, [1.0] * len(reg), every, np.repeat(member, len(self.costs), axis=0))
        w = linear.fit_many(rows, d, what)
        nets = linear.score_many(rows, d, w, what, "row_id").withColumn("option", F.floor(F.col("model") / len(every)).cast("int"))
        nets = nets.select((F.floor(F.col("option") / len(self.costs))).cast("int").alias("family"), F.concat(F.lit("net"), (F.col("option") % len(self.costs)).cast("string")).alias("option"), "row_id", "fold", "y", F.col("score").alias("p"))

        vector = {f: array_to_vector(F.array(*(F.col("x")[k] for k in self.families[f]))) for f in names}

        def trees(number: int, fold: int) -> DataFrame:
            own = rows.select("row_id", "fold", "label", vector[names[number]].alias("features"))
            out = staged(boosted("features", max(self.sizes)).fit(own.where(F.col("fold") != fold)), own.where(F.col("fold") == fold), self.sizes, ["row_id", "fold", "label"])
            return out.select(F.lit(number).alias("family"), F.concat(F.lit("trees"), F.col("size").cast("string")).alias("option"), "row_id", "fold", F.col("label").cast("int").alias("y"), "p")

        options = cut(reduce(DataFrame.union, [nets, *at_once([lambda k=k, f=f: trees(k, f) for k in range(len(names)) for f in folds])]))
        reports = binary_report(options.withColumn("pred", (F.col("p") > 0.5).cast("int")), ["family", "option", "fold"])
        order = Window.partitionBy("family").orderBy(F.desc("f1"), "option")
        scores = reports.groupBy("family", "option").agg(F.avg("f1").alias("f1")).withColumn("place", F.row_number().over(order)).where("place = 1")
        chosen = {names[r.family]: (r.option, r.f1) for r in scores.collect()}  # a row a family
        picked = rows.sparkSession.createDataFrame([(k, chosen[f][0], f) for k, f in enumerate(names)], "family int, option string, name string")
        unseen = cut(options.join(F.broadcast(picked), ["family", "option"]).select("row_id", F.col("name").alias("family"), "fold", "y", F.col("p").alias("probability")))

        wide = unseen.groupBy("row_id", "fold", "y").pivot("family", names).agg(F.first("probability"))
        upper = wide.select("row_id", "fold", F.col("y").cast("double").alias("label"), array_to_vector(F.array(*(F.col(f"`{f}`") for f in names))).alias("features"))
        upper = linear.compact(upper)
        kept = at_once([lambda f=f: staged(boosted("features", max(self.top)).fit(upper.where(F.col("fold") != f)), upper.where(F.col("fold") == f), self.top, ["fold", "label"]) for f in folds])
        tried = reduce(DataFrame.union, kept).select("size", "fold", F.col("label").cast("int").alias("y"), (F.col("p") > 0.5).cast("int").alias("pred"))
        size = binary_report(tried, ["size", "fold"]).groupBy("size").agg(F.avg("f1").alias("f1")).orderBy(F.desc("f1"), "size").first()["size"]

        def member_model(number: int) -> tuple[str, list[int], object]:
            option, places = chosen[names[number]][0], self.families[names[number]]
            if option.startswith("net"):
                return "net", places, w[(number * len(self.costs) + int(option[3:])) * len(every) + len(folds)]
            return "trees", places, boosted("features", int(option[5:])).fit(rows.select("label", vector[names[number]].alias("features")))

        made = at_once([lambda k=k: member_model(k) for k in range(len(names))])
        final = boosted("features", size).fit(upper)
        for held in (upper, rows):
            held.unpersist()
        return StackingModel(dict(zip(names, made, strict=True)), final, {f: chosen[f] for f in names}, size, unseen)


class StackingModel(Model):
    """``pred, score`` from the families' positive probabilities, which stay as ``p_<family>``."""

    def __init__(self, members: dict[str, tuple], final, chosen: dict, size: int, unseen: DataFrame):  # noqa: ANN001
        super().__init__()
        self.members, self.final, self.chosen, self.size, self.unseen = members, final, chosen, size, unseen

    def _transform(self, rows: DataFrame) -> DataFrame:
        own = rows.columns
        for name, (kind, places, model) in self.members.items():
            if kind == "net":
                rows = rows.withColumn(f"p_{name}", linear.probability(model))
                continue
            vector = array_to_vector(F.array(*(F.col("x")[k] for k in places)))
            scored = model.transform(rows.drop("features").withColumn("features", vector)).withColumn(f"p_{name}", vector_to_array("probability")[1])
            rows = scored.drop("rawPrediction", "probability", "prediction")
        columns = [f"p_{n}" for n in self.members]
        scored = self.final.transform(rows.drop("features").withColumn("features", array_to_vector(F.array(*(F.col(f"`{c}`") for c in columns)))))
        scored = scored.withColumn("score", vector_to_array("probability")[1]).withColumn("pred", F.col("prediction").cast("int"))
        return scored.select(*(c for c in own if c != "features"), *(f"`{c}`" for c in columns), "score", "pred")


def stability_scores(rows: DataFrame, d: int, groups: list[list[int]], n: int = 200, scaling: float = 0.5, frac: float = 0.75, cost: float = 1.0, seed: int = 0, normalize: bool = False) -> list[dict[int, float]]:
    """For each group of places in ``x`` the share of n lasso fits in which each has a coefficient.

    Each fit scales the group's features by 1 or ``scaling`` at random; all share one mask of ``frac`` of the
    rows, by hash of ``row_id``, that holds both classes. All fits of all groups are one batch. ``normalize``, as
    published: features are first centred and divided by the root of their squares' sum over all rows, so that
    units do not decide, and the intercept has a coefficient's penalty. Otherwise ``x`` is taken as it stands.
    """
    norm, constant = 1.0, np.zeros(d, bool)
    if normalize:
        total, mean, squares = linear.moments(rows, d)
        # features of unit deviation; what is left of the published norm, alike for all, goes into the penalty
        norm, constant = math.sqrt(max(1, total)), squares <= 0
        facts = F.array(*(F.struct(F.lit(float(m)), F.lit(float(s))) for m, s in zip(mean, np.where(constant, 0.0, norm / np.sqrt(np.where(constant, 1, squares))), strict=True)))
        rows = rows.withColumn("x", F.zip_with(F.col("x").cast("array<double>"), facts, lambda x, f: (x - f["col1"]) * f["col2"]))
    facts = []
    for turn in range(20):
        masked = rows.where(F.pmod(F.xxhash64("row_id", F.lit(seed + turn)), F.lit(1000)) < frac * 1000).select("x", "label")
        facts = masked.agg(F.count("*"), F.min("label"), F.max("label")).first()
        if facts[0] and facts[1] != facts[2]:
            break
    masked, random = linear.compact(masked), np.random.default_rng(seed)
    scales = np.zeros((len(groups) * n, d))
    for g, places in enumerate(groups):
        scales[g * n : (g + 1) * n, places] = np.where(random.random((n, len(places))) < 0.5, scaling, 1.0)
    scales[:, constant] = 0.0
    scales, same = np.unique(scales, axis=0, return_inverse=True)  # rows and penalty are alike, so equal scales are one fit
    reg = norm / (cost * max(1, facts[0]))
    what = linear.Fits(scales, np.full(len(scales), reg), np.zeros(len(scales)), np.full(len(scales), -1))
    w = linear.fit_many(masked, d, what, intercept=1 / norm if normalize else 0.0)
    masked.unpersist()
    hits = (np.abs(w[same.ravel(), :d]) > 1e-10).reshape(len(groups), n, d).mean(axis=1)
    return [{k: float(hits[g, k]) for k in places} for g, places in enumerate(groups)]


def stability_stages(rows: DataFrame, d: int, families: dict[str, dict[str, list[int]]], **options) -> tuple[list[dict[int, float]], dict[str, list[int]]]:  # noqa: ANN003
    """The scores of each segment that has places, in order, and what :func:`stability_select` keeps."""
    options = {"normalize": True, **options}
    above = lambda scores: [k for k, s in scores.items() if s > float(np.median(list(scores.values())))]
    segments = [(f, places) for f, parts in families.items() for places in parts.values() if places]
    by_segment = stability_scores(rows, d, [p for _, p in segments], **options)
    first: dict[str, list[int]] = {}
    for (family, _), scores in zip(segments, by_segment, strict=True):
        first.setdefault(family, []).extend(above(scores))
    pooled = [f for f, places in first.items() if places]
    second = stability_scores(rows, d, [first[f] for f in pooled], **options) if pooled else []
    return by_segment, {f: sorted(above(scores)) for f, scores in zip(pooled, second, strict=True) if above(scores)}


def stability_select(rows: DataFrame, d: int, families: dict[str, dict[str, list[int]]], **options) -> dict[str, list[int]]:  # noqa: ANN003
    """Places in ``x`` that are selected more often than the median of their segment, then, of those together,
    more often than the median of their family: ``families[family][segment]`` lists places. Features are normalised
    as published, if the options don't say otherwise."""
    return stability_stages(rows, d, families, **options)[1]


def importance_screen(rows: DataFrame, n_features: int, folds: int, rounds: int = 3, votes: float = 0.5, seed: int = 0) -> list[int]:
    """Features with non-zero forest importance in more than half of the folds, three times over."""
    kept = list(range(n_features))
    for r in range(rounds):
        counts = np.zeros(len(kept))
        picked = rows.withColumn("features", array_to_vector(F.array(*(F.col("x")[k] for k in kept))))
        for fold in range(folds):
            model = RandomForestClassifier(numTrees=10, seed=seed + r).fit(picked.where(F.col("fold") != fold))
            counts += model.featureImportances.toArray() > 0
        kept = [k for k, c in zip(kept, counts, strict=True) if c > votes * folds] or kept
    return kept


def log_spaced(smallest: float, n: int = 20) -> list[float]:
    """n fractions from the smallest to 1, at equal ratios."""
    return [float(f) for f in np.logspace(math.log10(min(1.0, smallest)), 0, n)]


def domain_curve(rows: DataFrame, domain: str, fractions: list[float], repeats: int = 5, unit: str = "pid", depth: int = 3, seed: int = 0, many: bool = False) -> DataFrame:
    """``fraction, repeat, n, accuracy, balanced_acc`` of a forest that tells the domain from ``features``.

    Rows: ``row_id, ds_key, pid, features, role`` and the domain, a data set or a person. A fraction is one of
    the participants of each data set or, with ``unit`` "row", of the rows of each person; a share of less than
    one participant is that share of one participant's rows (:func:`learning_rows`). ``balanced_acc`` is the
    mean recall of the domains. Forests are fitted side by side, and their predictions are one aggregation.
    ``many``: the domains grow with the table, as persons do; all forests are grown together (:mod:`forest`).
    """
    if many:
        of = cut(rows.select("row_id", "ds_key", "pid", "features", "role", domain))
        picked = learning_rows(of.where("role = 'train'").select("row_id", "ds_key", "pid"), fractions, repeats, unit, seed)
        picked = cut(picked.select("row_id", (F.col("number") * repeats + F.col("repeat")).alias("fit")))
        sizes = {r.fit: r.n for r in picked.groupBy("fit").agg(F.count("*").alias("n")).collect()}  # a row a fit
        found = forest.class_curve(of, domain, picked, len(fractions) * repeats, depth, seed).collect()
        table = [(float(fractions[x.fit // repeats]), x.fit % repeats, sizes[x.fit], x.accuracy, x.balanced_acc) for x in sorted(found)]
        return rows.sparkSession.createDataFrame(table, "fraction double, repeat int, n long, accuracy double, balanced_acc double")
    indexed = linear.compact(StringIndexer(inputCol=domain, outputCol="label").fit(rows).transform(rows).select("row_id", "ds_key", "pid", "features", "label", "role"))
    picked = cut(learning_rows(indexed.where("role = 'train'").select("row_id", "ds_key", "pid"), fractions, repeats, unit, seed))
    test = indexed.where("role = 'test'")

    def tried(number: int, repeat: int) -> DataFrame:
        own = indexed.join(F.broadcast(picked.where((F.col("number") == number) & (F.col("repeat") == repeat)).select("row_id")), "row_id", "left_semi").coalesce(1)
        model = RandomForestClassifier(numTrees=10, maxDepth=depth, seed=seed).fit(own)
        hit = (F.col("prediction") == F.col("label")).cast("double")
        return model.transform(test).groupBy("label").agg(F.sum(hit).alias("hit"), F.count("*").alias("n")).agg((F.sum("hit") / F.sum("n")).alias("accuracy"), F.avg(F.col("hit") / F.col("n")).alias("balanced_acc"))

    jobs = [(k, r) for k in range(len(fractions)) for r in range(repeats)]
    sizes = {(r.number, r.repeat): r.n for r in picked.groupBy("number", "repeat").agg(F.count("*").alias("n")).collect()}  # a row a fit
    found = at_once([lambda k=k, r=r: tried(k, r).first() for k, r in jobs])
    indexed.unpersist()
    table = [(float(fractions[k]), r, sizes[k, r], x.accuracy, x.balanced_acc) for (k, r), x in zip(jobs, found, strict=True)]
    return rows.sparkSession.createDataFrame(table, "fraction double, repeat int, n long, accuracy double, balanced_acc double")


def flat_tensor(x: Column) -> Column:
    """A window tensor as one vector: the pooled baseline's input."""
    return array_to_vector(F.flatten(x))


def pooled_baseline(tensors: DataFrame, width: int, kind: str = "mlp", params: dict | None = None):  # noqa: ANN201
    """A model of ``kind`` on flattened windows ``x`` (days by features, ``width`` numbers) of all data sets together.

    The default is a perceptron with one hidden layer of 16. Missing days are expected as 0.
    """
    layers = {"layers": [width, 16, 2], "maxIter": 100, "seed": 1} if kind == "mlp" else {}
    rows = linear.compact(tensors.select(flat_tensor(F.col("x")).alias("features"), F.col("label").cast("double").alias("label")))
    model = make_estimator(kind, {**layers, **(params or {})}).fit(rows)
    rows.unpersist()
    return model
