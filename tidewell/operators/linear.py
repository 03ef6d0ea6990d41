"""Many penalised logistic models fitted together: one pass over the rows improves all of them.

Grids of penalties, folds, feature families and resampled scales differ only in a few numbers a model. A
task turns its rows into one matrix and adds up each model's gradient and curvature; the sums of a model
meet in one row, and the driver, which holds the coefficients, takes a Newton step with the penalties. So
a search costs about as many passes as a single model, whatever the number of models.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.ordered import cut

#: Numbers of curvature that a task sums up for all models at most; more models go in several runs.
STATE = 1 << 20
#: Rows of a matrix in a task.
ROWS = 4096
#: Rows of a partition of a compacted table at least; parts whose sums the driver adds up itself at most.
PART, FEW = 20_000, 4


@dataclass(frozen=True)
class Fits:
    """What each of M models over d features is fitted to.

    ``scales`` (M, d): features are multiplied by it, 0 leaves one out. ``l1``, ``l2`` (M): penalties on the
    scaled coefficients, beside the mean log loss. ``fold`` (M): rows of this fold are kept out, -1 for none.
    """

    scales: np.ndarray
    l1: np.ndarray
    l2: np.ndarray
    fold: np.ndarray

    def __len__(self) -> int:
        return len(self.l1)

    def part(self, keep: np.ndarray | slice) -> Fits:
        return Fits(self.scales[keep], self.l1[keep], self.l2[keep], self.fold[keep])


def fits(reg: list[float], mix: list[float], folds: list[int], scales: np.ndarray) -> Fits:
    """Elastic nets by total penalty and its L1 share, one a pair of lists' entries, each without each fold."""
    n, d = len(reg), scales.shape[-1]
    scales = np.broadcast_to(scales, (n, d))
    l1, l2 = np.array(reg) * np.array(mix), np.array(reg) * (1 - np.array(mix))
    k = len(folds)
    return Fits(np.repeat(scales, k, axis=0), np.repeat(l1, k), np.repeat(l2, k), np.tile(np.array(folds, np.int64), n))


def _matrices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            part = batch.slice(k, ROWS)
            x = np.ones((part.num_rows, d + 1))
            x[:, :d] = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            yield x, part.column("label").to_numpy(), part.column("fold").to_numpy()


def _input(rows: DataFrame, *more: Column) -> DataFrame:
    fold = F.col("fold").cast("bigint") if "fold" in rows.columns else F.lit(0).cast("bigint")
    return rows.select(F.col("x").cast("array<double>").alias("x"), F.col("label").cast("double").alias("label"), F.coalesce(fold, F.lit(0)).alias("fold"), *more)


def compact(rows: DataFrame) -> DataFrame:
    """A checkpoint of the rows, cached in partitions of at least ``PART`` rows: a fit is many short passes over
    the same rows, and neither their plan nor their lineage should come along with each."""
    held = cut(rows)
    return held.coalesce(max(1, held.count() // PART)).cache()


def _added(parts: DataFrame) -> dict[int, np.ndarray]:
    """``model, sums binary`` added up by model: by the tasks of a shuffle, or here if there are few parts."""
    if parts.rdd.getNumPartitions() <= FEW:
        total: dict[int, np.ndarray] = {}
        for r in parts.collect():
            total[r.model] = total.get(r.model, 0) + np.frombuffer(bytes(r.sums))
        return total

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_py()) for b in group["sums"])
        return pa.table([group["model"].slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["model", "sums"])

    return {r.model: np.frombuffer(bytes(r.sums)) for r in parts.groupBy("model").applyInArrow(add, "model bigint, sums binary").collect()}


def _sums(rows: DataFrame, w: np.ndarray, fold: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log loss, gradient and curvature of each model over its rows and its ``own`` columns (M, k), as means."""
    m, d, k = len(w), w.shape[1] - 1, own.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m, 2 + k + k * k))
        for x, y, held in _matrices(batches, d):
            use = (held[:, None] != fold).astype(float)
            z = x @ w.T
            p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            total[:, 0] += use.sum(axis=0)
            total[:, 1] += (use * (np.logaddexp(0, z) - y[:, None] * z)).sum(axis=0)
            total[:, 2 : k + 2] += np.take_along_axis(((p - y[:, None]) * use).T @ x, own, axis=1)
            curved = p * (1 - p) * use
            for j in range(m):
                mine = x[:, own[j]]
                total[j, k + 2 :] += ((mine * curved[:, j : j + 1]).T @ mine).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(m), pa.int64()), pa.array([t.tobytes() for t in total], pa.binary())], ["model", "sums"])

    added = _added(rows.mapInArrow(run, "model bigint, sums binary"))
    total = np.array([added[j] for j in range(m)]) if added else np.zeros((m, 2 + k + k * k))
    n = np.maximum(total[:, :1], 1)
    return total[:, 1] / n[:, 0], total[:, 2 : k + 2] / n, (total[:, k + 2 :] / n).reshape(m, k, k)


def deviations(rows: DataFrame, d: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Standard deviation of each feature over all rows, and without the rows of each fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for x, _, held in _matrices(batches, d):
            for f in np.unique(held).tolist():
                mine = x[held == f][:, :d]
                total[f] = total.get(f, 0) + np.concatenate([[len(mine)], mine.sum(axis=0), (mine * mine).sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([t.tobytes() for t in total.values()], pa.binary())], ["model", "sums"])

    by_fold = _added(_input(rows).mapInArrow(run, "model bigint, sums binary"))
    total = sum(by_fold.values(), np.zeros(2 * d + 1))

    def spread(t: np.ndarray) -> np.ndarray:
        n = max(t[0], 2)
        squares = t[d + 1 :] - t[1 : d + 1] ** 2 / n
        return np.sqrt(np.where(squares > 1e-12 * np.maximum(t[d + 1 :], 1e-300), squares, 0.0) / (n - 1))

    return spread(total), {f: spread(total - t) for f, t in by_fold.items()}


def moments(rows: DataFrame, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and sums of squared deviations of each feature; those of a feature that is constant but for
    float noise are 0. Deviations are from the mean, in a pass of their own, so that a large mean costs no digits."""

    def added(center: np.ndarray, power: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(d + 1)
            for x, _, _ in _matrices(batches, d):
                total += np.append(((x[:, :d] - center) ** power).sum(axis=0), len(x))
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["model", "sums"])

        return _added(_input(rows).mapInArrow(run, "model bigint, sums binary")).get(0, np.zeros(d + 1))

    total = added(np.zeros(d), 1)
    n, mean = int(total[d]), total[:d] / max(1, total[d])
    squares = added(mean, 2)[:d]
    return n, mean, np.where(squares > 1e-24 * n * mean**2, squares, 0.0)


def standard(rows: DataFrame, d: int, what: Fits) -> Fits:
    """The same models on features of unit deviation over their own rows, as spark.ml standardises them."""
    whole, without = deviations(rows, d)
    spread = np.array([without.get(f, whole) for f in what.fold.tolist()])
    return Fits(what.scales * np.where(spread > 0, 1 / np.where(spread > 0, spread, 1), 0.0), what.l1, what.l2, what.fold)


def _step(w: np.ndarray, gradient: np.ndarray, curve: np.ndarray, l1: np.ndarray, l2: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Minimum of each model's quadratic with its penalties, by coordinate descent over all models at once."""
    new, slope = w.copy(), gradient.copy()
    diagonal = np.einsum("mkk->mk", curve) + l2 + 1e-12
    for _ in range(500):
        moved = 0.0
        for k in range(w.shape[1]):
            pull = new[:, k] * diagonal[:, k] - slope[:, k] - l2[:, k] * new[:, k]
            value = np.where(free[:, k], np.sign(pull) * np.maximum(np.abs(pull) - l1[:, k], 0) / diagonal[:, k], 0.0)
            change = value - new[:, k]
            new[:, k] = value
            slope += change[:, None] * curve[:, k, :]
            moved = max(moved, float(np.max(np.abs(change) * np.sqrt(diagonal[:, k]), initial=0)))
        if moved < 1e-9:
            break
    return new


def fit_many(rows: DataFrame, d: int, what: Fits, rounds: int = 50, tolerance: float = 1e-8, intercept: float = 0.0) -> np.ndarray:
    """Coefficients (M, d + 1), the last an intercept, for ``x`` as it stands.

    The intercept is not penalised, or with ``intercept`` times a model's ``l1``.

    ``rows``: ``x array<double>`` of d numbers without nulls, ``label`` 0 or 1 and, for models that keep a fold
    out, ``fold``. A model without rows has coefficients of 0. Each model stops when its objective has.
    """
    # a model's own columns: its features, the intercept, and as padding the intercept again, held at no change
    count = (what.scales > 0).sum(axis=1)
    k = int(count.max(initial=0)) + 1
    room = max(1, STATE // k**2)
    if len(what) > room:
        return np.concatenate([fit_many(rows, d, what.part(slice(at, at + room)), rounds, tolerance, intercept) for at in range(0, len(what), room)])
    own = np.full((len(what), k), d)
    for j, n in enumerate(count.tolist()):
        own[j, :n] = np.flatnonzero(what.scales[j] > 0)
    free = np.arange(k) <= count[:, None]
    inverse = 1 / np.where(own < d, np.take_along_axis(np.append(what.scales, np.ones((len(what), 1)), axis=1), own, axis=1), 1)
    l1, l2 = what.l1[:, None] * inverse * np.where(own < d, 1.0, intercept * free), what.l2[:, None] * inverse**2 * (own < d)
    rows, w = _input(rows), np.zeros((len(what), k))
    best, base, goal = w.copy(), w.copy(), w.copy()
    value, share = np.full(len(what), np.inf), np.ones(len(what))
    live = np.arange(len(what))

    def spread(narrow: np.ndarray, which: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(which), d + 1))
        np.add.at(wide, (np.arange(len(which))[:, None], own[which]), np.where(free[which], narrow, 0.0))
        return wide

    for _ in range(rounds):
        loss, gradient, curve = _sums(rows, spread(w[live], live), what.fold[live], own[live])
        now = loss + (l1[live] * np.abs(w[live]) + l2[live] * w[live] ** 2 / 2).sum(axis=1)
        better = now <= value[live] + 1e-14
        done = better & (value[live] - now <= tolerance * np.abs(now)) & np.isfinite(value[live])
        up = live[better]
        best[up], value[up], base[up], share[up] = w[up], now[better], w[up], 1.0
        goal[up] = _step(w[up], gradient[better], curve[better], l1[up], l2[up], free[up])
        worse = live[~better]
        share[worse] /= 2  # overshot: half the step from the last good place
        done |= share[live] < 1e-6
        live = live[~done]
        if not len(live):
            break
        w[live] = base[live] + share[live, None] * (goal[live] - base[live])
    return spread(best, np.arange(len(what)))


def probability(w: np.ndarray) -> Column:
    """A model's positive probability as a column of ``x``."""
    terms = F.zip_with("x", F.array(*(F.lit(float(c)) for c in w[:-1])), lambda a, b: a * b)
    return 1 / (1 + F.exp(-F.aggregate(terms, F.lit(float(w[-1])), lambda s, v: s + v)))


def score_many(rows: DataFrame, d: int, w: np.ndarray, what: Fits, key: str | None = None) -> DataFrame:
    """``model, fold, y, score`` (and ``key bigint``) of each model on the rows of the fold that it has not seen.

    Models that have seen all rows (fold -1) score none. One pass, a row a row and model of its fold.
    """
    kind = "model int, fold bigint, y int, score double" + (f", {key} bigint" if key else "")
    source = _input(rows, (F.col(key) if key else F.lit(0)).cast("bigint").alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                x, y, held = next(_matrices(iter([part]), d))
                row, model = np.nonzero(held[:, None] == what.fold)
                z = np.einsum("nd,nd->n", x[row], w[model])
                columns = [pa.array(model.astype(np.int32)), pa.array(held[row]), pa.array(y[row].astype(np.int32)), pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))]
                names = ["model", "fold", "y", "score"]
                yield pa.RecordBatch.from_arrays([*columns, *([part.column("key").take(pa.array(row))] if key else [])], [*names, *([key] if key else [])])

    return source.mapInArrow(run, kind)
