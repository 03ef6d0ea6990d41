"""Published pipelines by name: features of label windows and a classifier, evaluated on any split.

Each is registered under the name that :func:`tidewell.plans.registry.load_algorithm` takes. ``fit(window,
points)`` gives a model and ``predict(window, points)`` its ``pid, label_date, y, pred, score``. A window has
``pid, label_date, date, feature, value``, points have ``pid, label_date, y, ds_key, device``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators import cf, linear, models, rules, scale, trend, windows
from tidewell.operators.ordered import cut
from tidewell.plans.registry import register
from tidewell.plans.splits import fold_count, folds_with_both_classes

POINT = ["pid", "label_date"]


def named_stats(window: DataFrame, stats: tuple[str, ...], days: int = 14) -> DataFrame:
    """Statistics of the last days as features of their own, ``feature#stat``."""
    made = windows.window_stats(window, days, stats)
    long = made.unpivot([*POINT, "feature"], list(stats), "stat", "value")
    return long.select(*POINT, F.concat_ws("#", "feature", "stat").alias("feature"), "value")


def mean_features(window: DataFrame) -> DataFrame:
    return windows.window_stats(window, 14, ("mean",)).select(*POINT, "feature", F.col("mean").alias("value"))


def trend_features(window: DataFrame) -> DataFrame:
    return named_stats(window, ("mean", "std", "slope"))


def broad_features(window: DataFrame) -> DataFrame:
    """The label day's values, and mean, sum, std, min and max."""
    last = windows.last_day(window).select(*POINT, "feature", "value")
    return last.unionByName(named_stats(window, ("mean", "sum", "std", "min", "max")))


def weekly_features(window: DataFrame) -> DataFrame:
    """Means, slopes and breakpoints of the weeks, weekdays and weekends apart."""
    made = trend.weekly_trends(window)
    columns = [c for c in made.columns if c not in (*POINT, "feature", "part")]
    long = made.unpivot([*POINT, "feature", "part"], columns, "stat", "value")
    return long.select(*POINT, F.concat_ws("#", "feature", "part", "stat").alias("feature"), "value")


def matrix(long: DataFrame, points: DataFrame, names: list[str]) -> DataFrame:
    """Points with ``x, features, label``: the features in order, 0 where there is none after scaling."""
    wide = windows.wide(long, POINT, names)
    x = F.array(*(F.coalesce(F.col(f"`{n}`"), F.lit(0.0)) for n in names))
    rows = points.join(wide.select(*POINT, x.alias("x")), POINT)
    return rows.select(*points.columns, "x", array_to_vector("x").alias("features"), F.col("y").cast("double").alias("label"))


@dataclass(frozen=True)
class Published:
    """Features, scaled as training or test data, and an estimator with a grid of parameters.

    ``linear`` marks elastic nets, whose search is one batch. ``grid(n)`` lists parameters for n training rows; without ``search`` the first of it, updated by
    ``params``, is used, with it the best by ``metric`` over grouped folds with both classes.
    """

    features: Callable[[DataFrame], DataFrame]
    estimator: Callable[[dict, int], object]
    grid: Callable[[int], list[dict]]
    metric: str = "balanced_acc"
    params: dict = field(default_factory=dict)
    names: tuple[str, ...] = ()
    model: object = None
    linear: bool = False

    def prepared(self, window: DataFrame, role: str, names: tuple[str, ...] = ()) -> DataFrame:
        columns = window.sparkSession.createDataFrame([(n,) for n in names], "feature string") if names else None
        return scale.prepare(self.features(window), role, columns=columns)

    def fit(self, window: DataFrame, points: DataFrame, search: bool = False, folds: int = 5) -> Published:
        long = self.prepared(window, "train")
        names = tuple(r.feature for r in long.select("feature").distinct().orderBy("feature").collect())  # feature names only
        rows = cut(matrix(long, points, list(names)))
        options = [{**p, **self.params} for p in self.grid(rows.count())]
        best = options[0]
        if search:
            k = fold_count(rows, "label", "pid", folds)
            folded = folds_with_both_classes(rows, "pid", "label", k)
            best = models.grid_search(folded, "lr" if self.linear else lambda p: self.estimator(p, len(names)), options, self.metric)[0]
        return replace(self, names=names, params=best, model=self.estimator(best, len(names)).fit(linear.compact(rows)))

    def predict(self, window: DataFrame, points: DataFrame) -> DataFrame:
        rows = matrix(self.prepared(window, "test", self.names), points, list(self.names))
        return models.predictions(self.model, rows).select(*points.columns, "pred", "score")


def _kind(kind: str) -> Callable[[dict, int], object]:
    return lambda params, n: models.make_estimator(params.get("kind", kind), {k: v for k, v in params.items() if k != "kind"})


class KernelMachine:
    """A linear machine on random Fourier features of ``x``, in place of an RBF kernel."""

    def __init__(self, n_in: int, params: dict, n_out: int = 64):
        self.n_in, self.n_out, self.params, self.model = n_in, n_out, params, None

    def _rows(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("features", array_to_vector(models.random_features(F.col("x"), self.n_in, self.n_out, 1 / max(1, self.n_in))))

    def fit(self, rows: DataFrame) -> KernelMachine:
        made = KernelMachine(self.n_in, self.params, self.n_out)
        made.model = models.make_estimator("svm", self.params).fit(self._rows(rows))
        return made

    def transform(self, rows: DataFrame) -> DataFrame:
        return self.model.transform(self._rows(rows))


def _kernel_or_forest(params: dict, n: int) -> object:
    return models.make_estimator("rf", {k: v for k, v in params.items() if k != "kind"}) if params.get("kind") == "rf" else KernelMachine(n, {k: v for k, v in params.items() if k != "kind"})


def _cost(values: list[float], n: int) -> list[dict]:
    return [{"regParam": 1 / (c * n)} for c in values]


@register("ml_saeb")
def saeb(params: dict) -> Published:
    return Published(mean_features, _kind("lr"), models.elastic_net_grid, params=params, linear=True)


@register("ml_wang")
def wang(params: dict) -> Published:
    return Published(trend_features, _kind("lr"), models.lasso_grid, "log_likelihood", params, linear=True)


@register("ml_wahle")
def wahle(params: dict) -> Published:
    forests = [{"kind": "rf", "numTrees": 450, "maxDepth": d} for d in (1, 2, 3, 4, 5)]
    return Published(broad_features, _kernel_or_forest, lambda n: [*_cost([0.015625, 0.03125, 0.125, 0.5, 2, 8, 32, 64], n), *forests], params=params)


@register("ml_canzian")
def canzian(params: dict) -> Published:
    return Published(mean_features, _kernel_or_forest, lambda n: _cost([0.03125, 0.125, 0.5, 2, 8, 32], n), params=params)


@register("ml_farhan")
def farhan(params: dict) -> Published:
    return Published(mean_features, lambda p, n: models.PerDevice("svm", p), models.svm_grid, "f1", params)


@register("ml_lu")
def lu(params: dict) -> Published:
    grid = [{"g1": a, "g2": b} for a in (0.001, 0.01, 0.1, 1.0, 10.0) for b in (0.001, 0.01, 0.1, 1.0, 10.0)]
    return Published(mean_features, lambda p, n: models.MultiTask(n, **p), lambda n: [{"g1": 0.01, "g2": 1.0}, *grid], params=params)


@dataclass(frozen=True)
class Stacked(Published):
    """Weekly trends, stability-selected by segment and then by family, and :class:`models.Stacking` over the families.

    A feature's family is the part of its name before the first colon; its segment is the rest up to the
    statistic, weekdays and weekends apart.
    """

    rounds: int = 200
    options: dict = field(default_factory=dict)

    def fit(self, window: DataFrame, points: DataFrame, search: bool = True, folds: int = 5) -> Stacked:
        long = cut(self.prepared(window, "train"))
        names = sorted(r.feature for r in long.select("feature").distinct().collect())  # feature names only
        rows = matrix(long, points, names).withColumn("row_id", F.xxhash64(*POINT))
        rows = cut(rows)
        families: dict[str, dict[str, list[int]]] = {}
        for k, name in enumerate(names):
            family, rest = name.split(":", 1)
            families.setdefault(family, {}).setdefault(rest.rpartition("#")[0], []).append(k)
        kept = models.stability_select(rows, len(names), families, n=self.rounds)
        kept = kept or {f: [k for places in parts.values() for k in places] for f, parts in families.items()}
        order = [k for places in kept.values() for k in places]
        at = {k: n for n, k in enumerate(order)}
        narrow = rows.withColumn("x", F.array(*(F.col("x")[k] for k in order)))
        folded = folds_with_both_classes(narrow, "pid", "label", fold_count(narrow, "label", "pid", folds))
        stack = models.Stacking({f: [at[k] for k in places] for f, places in kept.items()}, **self.options)
        return replace(self, names=tuple(names[k] for k in order), model=stack.fit(folded))


@register("ml_chikersal")
def chikersal(params: dict) -> Stacked:
    options = {k: tuple(v) for k, v in params.items() if k in ("costs", "sizes", "top")}
    return Stacked(weekly_features, _kind("lr"), lambda n: [{}], rounds=params.get("rounds", 200), options=options)


@dataclass(frozen=True)
class Interpretable:
    """Rules that differ between the days of positive and of negative points; boosted trees on their features."""

    params: dict = field(default_factory=dict)
    codes: DataFrame | None = None
    kept: list = field(default_factory=list)
    model: object = None

    def _days(self, window: DataFrame, codes: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
        daily = window.select("pid", "date", "feature", "value").distinct()
        levels = scale.tertiles(daily, ["pid"])
        codes = rules.item_codes(levels) if codes is None else codes
        n = max(1, daily.select("feature").distinct().count())
        return levels, codes, rules.baskets(levels, codes, n, self.params.get("share", 0.8))

    def _features(self, window: DataFrame, levels: DataFrame, codes: DataFrame, days: DataFrame, role: str) -> DataFrame:
        spread = window.select(*POINT, "date").distinct().join(days, ["pid", "date"])
        table = window.sparkSession.createDataFrame(self.kept, "rule int, antecedent array<int>, item int")
        coded = levels.join(F.broadcast(codes), ["feature", "level"]).select("pid", "date", "item", "value")
        made = rules.rule_features(spread, coded, table, role).unpivot([*POINT, "rule"], ["mean", "std"], "stat", "value")
        return made.select(*POINT, F.concat_ws("#", F.col("rule").cast("string"), "stat").alias("feature"), "value")

    def _names(self) -> list[str]:
        return [f"{r[0]}#{s}" for r in self.kept for s in ("mean", "std")]

    def fit(self, window: DataFrame, points: DataFrame, search: bool = False, folds: int = 5) -> Interpretable:
        levels, codes, days = self._days(window, None)
        least, weights = self.params.get("least", (0.02, 0.1)), self.params.get("weights", (1.0, 1.5, 0.5))
        of = window.select(*POINT, "date").distinct().join(points.select(*POINT, "y"), POINT).join(days, ["pid", "date"])
        pos, neg = (rules.mine_rules(of.where(F.col("y") == bool(g)).select("items"), *least).withColumn("antecedent", F.sort_array("antecedent")) for g in (1, 0))
        best = rules.select_rules(rules.passing_rules(rules.contrast_rules(pos, neg), *least), weights, self.params.get("k", 10))
        kept = [(k, list(r.antecedent), int(r.consequent[0])) for k, r in enumerate(best.orderBy("sided", "rank").collect())]  # at most 2k rules
        made = replace(self, codes=codes, kept=kept)
        if not kept:
            raise ValueError("no rule differs between the groups")
        long = scale.prepare(made._features(window, levels, codes, days, "train"), "train", col_na=2.0, row_na=2.0)
        rows = matrix(long, points, made._names())
        return replace(made, model=models.make_estimator("adaboost", {"rounds": self.params.get("rounds", 10)}).fit(rows))

    def predict(self, window: DataFrame, points: DataFrame) -> DataFrame:
        levels, codes, days = self._days(window, self.codes)
        long = scale.prepare(self._features(window, levels, codes, days, "test"), "test")
        return models.predictions(self.model, matrix(long, points, self._names())).select(*points.columns, "pred", "score")


@register("ml_xu_interpretable")
def interpretable(params: dict) -> Interpretable:
    return Interpretable(params)


@dataclass(frozen=True)
class Personalized:
    """Collaborative filtering: each day series of a point votes by the labels of training points that it correlates with.

    Levels of weekdays and of weekends apart are series of their own, filled collaboratively; the few that
    rank best over folds of participants vote (:class:`cf.CollaborativeFilter`).
    """

    params: dict = field(default_factory=dict)
    model: cf.CollaborativeFilterModel | None = None

    @staticmethod
    def _series(window: DataFrame, role: str) -> DataFrame:
        level = scale.tertiles(window.select("pid", "date", "feature", "value").distinct(), ["pid"])
        code = F.when(F.col("level") == "l", 1.0).when(F.col("level") == "m", 2.0).when(F.col("level") == "h", 3.0)
        days = window.select(*POINT, "date").distinct().withColumn("slice", F.when(F.weekday("date") < 5, "wkdy").otherwise("wkend"))
        point = F.concat_ws("@", F.col("pid").cast("string"), F.date_format("label_date", "yyyy-MM-dd"))
        place = F.row_number().over(Window.partitionBy(*POINT, "slice").orderBy("date")) - 1
        days = days.withColumn("day", place).select("pid", "date", "slice", "day", point.alias("point"))
        long = days.join(level.select("pid", "date", "feature", code.alias("value")), ["pid", "date"])
        long = long.select(F.concat_ws("::", "slice", "feature").alias("feature"), F.col("point").alias("pid"), "day", "value")
        # a cell for every day of a series, also where a point has no value
        cells = long.select("feature", "pid").distinct().join(long.select("feature", "day").distinct(), "feature")
        return scale.cf_impute(cells.join(long, ["feature", "pid", "day"], "left"), least_days=-1.0 if role == "train" else 0.5)

    def fit(self, window: DataFrame, points: DataFrame, search: bool = False, folds: int = 40) -> Personalized:
        folded = folds_with_both_classes(points, "pid", "y", fold_count(points, "y", "pid", folds))
        name = F.concat_ws("@", F.col("pid").cast("string"), F.date_format("label_date", "yyyy-MM-dd"))
        labels = folded.select(name.alias("pid"), F.col("y").cast("int").alias("y"), "fold")
        return Personalized(self.params, cf.CollaborativeFilter(**self.params).fit(cut(self._series(window, "train").join(labels, "pid"))))

    def predict(self, window: DataFrame, points: DataFrame) -> DataFrame:
        voted = self.model.transform(self._series(window, "test")).select(F.col("pid").alias("__point"), "pred", F.col("prob").alias("score"))
        name = F.concat_ws("@", F.col("pid").cast("string"), F.date_format("label_date", "yyyy-MM-dd"))
        # a point without a day in any selected series has no vote, which is no majority
        joined = points.withColumn("__point", name).join(voted, "__point", "left").drop("__point")
        return joined.withColumns({"pred": F.coalesce("pred", F.lit(0)), "score": F.coalesce("score", F.lit(0.0))})


@register("ml_xu_personalized")
def personalized(params: dict) -> Personalized:
    return Personalized(params)


def evaluate(algorithm, window: DataFrame, points: DataFrame, search: bool = False) -> DataFrame:  # noqa: ANN001
    """``role, n`` and metrics of both roles of ``points`` (pid, label_date, y, ds_key, device, role), fitted
    on train. Windows and points are checkpoints while it is fitted; what is gathered is a row a role.

    Features of a :class:`Published` are of a point alone, so they are made once, where the windows lie, in place of
    once for the fit and once a prediction; the windows themselves are not written."""
    if isinstance(algorithm, Published):
        window, algorithm = algorithm.features(window), replace(algorithm, features=lambda made: made)
    points = cut(points)
    window = cut(window.join(points.select(*POINT, "role"), POINT))
    part = lambda role: (window.where(F.col("role") == role).drop("role"), points.where(F.col("role") == role))
    fitted = algorithm.fit(*part("train"), search=search)
    scored = [fitted.predict(*part(role)) for role in ("train", "test")]
    both = scored[0].unionByName(scored[1]).select("role", F.col("y").cast("int").alias("y"), "pred", "score")
    both = cut(both)
    found = models.metrics(both, ["role"]).join(both.groupBy("role").agg(F.count("*").alias("n")), "role")
    rows, schema = found.collect(), found.schema
    return points.sparkSession.createDataFrame(rows, schema)
