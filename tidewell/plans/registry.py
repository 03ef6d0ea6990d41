"""Named algorithms: a feature function and an estimator, with parameters by model and global ones over them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tidewell.operators import models


@dataclass(frozen=True)
class Algorithm:
    """``prepare(windows, role)`` makes ``features, label`` rows; ``estimator`` and ``params`` fit them.

    The classifier contract is spark.ml's: ``fit`` gives a model, ``transform`` adds prediction and
    probability.
    """

    prepare: Callable[[DataFrame, str], DataFrame]
    estimator: str
    params: dict = field(default_factory=dict)

    def make(self):  # noqa: ANN201
        return models.make_estimator(self.estimator, self.params)


ALGORITHMS: dict[str, Callable[[dict], Algorithm]] = {}


def register(name: str) -> Callable:
    def add(factory: Callable[[dict], Algorithm]) -> Callable[[dict], Algorithm]:
        ALGORITHMS[name] = factory
        return factory

    return add


def load_algorithm(name: str, params: dict | None = None, overrides: dict | None = None) -> Algorithm:
    """The algorithm of that name; global overrides win over its own parameters."""
    return ALGORITHMS[name](resolve(params or {}, overrides or {}))


def resolve(own: dict, overrides: dict) -> dict:
    return {**own, **{k: v for k, v in overrides.items() if v is not None}}


@dataclass(frozen=True)
class Catalog:
    """Data sets and targets by configuration: another one is another row."""

    datasets: dict[str, str] = field(default_factory=dict)
    thresholds: dict[str, tuple[float, float]] = field(default_factory=dict)

    def with_dataset(self, ds_key: str, path: str) -> Catalog:
        return Catalog({**self.datasets, ds_key: path}, self.thresholds)

    def with_target(self, target: str, as_false: float, as_true: float) -> Catalog:
        return Catalog(self.datasets, {**self.thresholds, target: (as_false, as_true)})
