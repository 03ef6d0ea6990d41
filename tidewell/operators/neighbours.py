"""Mutual information by nearest neighbours over many rounds of noise, in chunks of a feature's values.

Only the values themselves move, once a pass: a task has a chunk of one feature and draws every round's noise
itself. A chunk is an interval of noisy values. What a neighbour search needs from beyond its ends are a few
values of each class (``lent``); what lies beyond the ends of a row's interval is counted where it lies. Both
concern at most k rows a class and end, however many rows a chunk has.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.ordered import cut

#: Rows of a chunk, about; equal values share one.
ROWS = 1 << 17
#: Deviations that the noise never reaches: its uniform numbers are at least 2**-31.
REACH = 7.0

_P = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def hash_int(seed: np.ndarray, n: int) -> np.ndarray:
    """``xxhash64`` of columns whose hash is ``seed`` and one more int."""
    h = (seed + _P[4] + np.uint64(4)) ^ np.uint64(n * int(_P[0]) & 0xFFFFFFFFFFFFFFFF)
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * _P[1] + _P[2]
    h = (h ^ (h >> np.uint64(33))) * _P[1]
    h = (h ^ (h >> np.uint64(29))) * _P[2]
    return h ^ (h >> np.uint64(32))


def normal(seed: np.ndarray, number: int) -> np.ndarray:
    """A round's standard normal numbers of the rows whose keys hash to ``seed``."""
    turn = hash_int(seed, number)
    uniform = lambda n: ((hash_int(turn, n) & np.uint64((1 << 30) - 1)).astype(float) + 0.5) / (1 << 30)
    return np.sqrt(-2 * np.log(uniform(1))) * np.cos(uniform(2) * 6.283185307179586)


def digamma(n, log=np.log):  # noqa: ANN001, ANN201
    """Of whole numbers from 1 on, to 12 digits: ten steps up, then the asymptotic series. For a Column, ``log`` is Spark's."""
    x = n + 10.0
    return log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6) - reduce(lambda a, b: a + b, [1 / (n + float(k)) for k in range(10)])


class Chunk:
    """Rows of a chunk in order of their plain values, and those within the noise's reach of its ends."""

    def __init__(self, rows: pa.Table, low: float, high: float, noise: float):
        value = rows["value"].to_numpy()
        order = np.argsort(value, kind="stable")
        self.low, self.high, self.noise, self.reach = low, high, noise, REACH * noise
        self.value, self.seed, self.kind = value[order], rows["seed"].to_numpy()[order].view(np.uint64), rows["kind"].to_numpy()[order]
        self.first = int(np.searchsorted(self.value, low + self.reach, side="right"))  # from here to last rows are inside in every round
        self.last = max(self.first, int(np.searchsorted(self.value, high - self.reach, side="right")))

    def noisy(self, number: int, at: slice | np.ndarray) -> np.ndarray:
        return self.value[at] + self.noise * normal(self.seed[at], number)

    def inside(self, x: np.ndarray) -> np.ndarray:
        return (x > self.low) & (x <= self.high)

    def ends(self, rounds: int, k: int) -> Iterator[tuple[int, int, list[float], list[float]]]:
        """``round, class`` and its k least and k greatest noisy values inside."""
        n = len(self.value)
        for kind in np.unique(self.kind).tolist():
            mine = np.flatnonzero(self.kind == kind)
            sure = self.value[mine[(mine >= self.first) & (mine < self.last)]]
            if len(sure) < 2 * k or not n:
                low = high = mine
            else:  # others cannot come among the first k, whatever the noise
                low, high = mine[self.value[mine] <= sure[k - 1] + 2 * self.reach], mine[self.value[mine] >= sure[-k] - 2 * self.reach]
            for number in range(rounds):
                a, b = (np.sort(x[self.inside(x)]) for x in (self.noisy(number, low), self.noisy(number, high)))
                if len(a):
                    yield number, kind, a[:k].tolist(), b[-k:].tolist()

    def size(self, number: int) -> int:
        """Rows inside in a round."""
        return self.last - self.first + sum(int(self.inside(self.noisy(number, s)).sum()) for s in (slice(0, self.first), slice(self.last, None)))

    def count(self, number: int, at: np.ndarray, equal: np.ndarray) -> list[int]:
        """Rows inside below each value, or up to it where ``equal``."""
        head, found = None, []
        for v, eq in zip(at.tolist(), equal.tolist(), strict=True):
            a, b = int(np.searchsorted(self.value, v - self.reach)), int(np.searchsorted(self.value, v + self.reach, side="right"))
            a, below = (0, 0) if a <= self.first else (a, a - self.first)
            if a and head is None:
                x = self.noisy(number, slice(0, self.first))
                head = int(self.inside(x).sum())
            x = self.noisy(number, slice(a, b))
            x = x[self.inside(x)]
            found.append((head + below if a else 0) + int((x <= v if eq else x < v).sum()))
        return found


def nearest(x: np.ndarray, left: np.ndarray, right: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distance of the k-th nearest of the others for each of the sorted ``x``, and the interval that it spans.

    ``left`` and ``right`` are sorted values beyond the ends. An end that is a value is taken as it stands.
    """
    every = np.concatenate([np.full(k, -np.inf), left, x, right, np.full(k, np.inf)])
    at = k + len(left) + np.arange(len(x))
    best = a = b = None
    for j in range(k + 1):  # j before and k - j behind
        low, high = every[at - j], every[at + k - j]
        r = np.maximum(x - low, high - x)
        if best is None:
            best, a, b = r, low, high
            continue
        # of equal distances the one with the lesser ends, as in an order of (r, left, right)
        closer = (r < best) | ((r == best) & ((low < a) | ((low == a) & (high < b))))
        best, a, b = np.where(closer, r, best), np.where(closer, low, a), np.where(closer, high, b)
    return best, np.where(x - a == best, a, x - best), np.where(b - x == best, b, x + best)


_PARTS = "feature string, round int, n bigint, total double, id bigint, bin int, at double, sign int, equal boolean"


def mi_rounds(rows: DataFrame, rounds: int, k: int) -> DataFrame:
    """``round, feature, mi`` of ``feature, seed, value, noise, y``: Ross's estimator, as
    :func:`tidewell.operators.screen.neighbour_mi`, on ``value`` plus ``noise`` (one number a feature) times normal
    numbers drawn anew in each round from ``seed``, the hash of a row's keys."""
    rows = cut(rows.select("feature", F.col("seed").cast("bigint").alias("seed"), "value", "noise", F.xxhash64("y").alias("kind")))
    sizes: dict[str, dict[int, int]] = {}
    for r in rows.groupBy("feature", "kind").agg(F.count("*").alias("n")).collect():  # a row a feature and class
        if r.n > 1:
            sizes.setdefault(r.feature, {})[r.kind] = r.n
    chunks = max(1, -(-max((sum(s.values()) for s in sizes.values()), default=1) // ROWS))
    points = F.percentile_approx("value", F.array(*(F.lit(j / chunks) for j in range(1, chunks))), F.lit(10_000)) if chunks > 1 else F.array().cast("array<double>")
    # a cut lies beyond the noise of the values that it follows
    facts = {r.feature: (r.noise, sorted({c + 2 * REACH * r.noise for c in r.cuts})) for r in rows.groupBy("feature").agg(F.first("noise").alias("noise"), points.alias("cuts")).collect()}
    spark = rows.sparkSession
    table = spark.createDataFrame([(f, c, REACH * a) for f, (a, c) in facts.items()], "feature string, cuts array<double>, reach double")
    kinds = spark.createDataFrame([(f, c) for f, s in sizes.items() for c in s], "feature string, kind bigint")
    placed = rows.join(F.broadcast(kinds), ["feature", "kind"], "left_semi").join(F.broadcast(table), "feature")
    bin_of = lambda x: F.size(F.filter("cuts", lambda c: c < x))
    # a row within the noise's reach of a cut goes to both sides, and each round says where it is
    both = F.sequence(bin_of(F.col("value") - F.col("reach")), bin_of(F.col("value") + F.col("reach")))
    placed = placed.select("feature", "seed", "value", "kind", F.explode(both).alias("bin"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(len(facts) * chunks, 4000))
    grouped = placed.repartition(tasks, "feature", "bin").groupBy("feature", "bin")

    def chunk(group: pa.Table, feature: str, at: int) -> Chunk:
        noise, cuts = facts[feature]
        return Chunk(group, cuts[at - 1] if at else -np.inf, cuts[at] if at < len(cuts) else np.inf, noise)

    def ends(key: tuple, group: pa.Table) -> pa.Table:
        feature, at = key[0].as_py(), key[1].as_py()
        own = chunk(group, feature, at)
        found = [(feature, at, number, kind, 0, a, b) for number, kind, a, b in own.ends(rounds, k)]
        found += [(feature, at, number, None, own.size(number), None, None) for number in range(rounds)]
        types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=["feature", "bin", "round", "kind", "n", "least", "greatest"])

    def lend(key: tuple, group: pa.Table) -> pa.Table:
        parts = sorted(zip(*(group[c].to_pylist() for c in ("bin", "least", "greatest")), strict=True))
        left, right, held = [], [], []
        for _, _, greatest in parts:
            left.append(held)
            held = sorted(held + greatest)[-k:]
        held = []
        for _, least, _ in reversed(parts):
            right.append(held)
            held = sorted(held + least)[:k]
        n, lists = len(parts), pa.list_(pa.float64())
        columns = [pa.array([x.as_py()] * n, t) for x, t in zip(key, (pa.string(), pa.int32(), pa.int64()), strict=True)]
        return pa.table([*columns, pa.array([p[0] for p in parts], pa.int32()), pa.array(left, lists), pa.array(right[::-1], lists)], names=["feature", "round", "kind", "bin", "left", "right"])

    def measure(key: tuple, group: pa.Table, lent: pa.Table) -> pa.Table:
        feature, at = key[0].as_py(), key[1].as_py()
        own, cuts, sums, asked = chunk(group, feature, at), np.array(facts[feature][1]), [], []
        beyond = {(n, c): (a, b) for n, c, a, b in zip(*(lent[x].to_pylist() for x in ("round", "kind", "left", "right")), strict=True)}
        for number in range(rounds):
            x = own.noisy(number, slice(None))
            keep = own.inside(x)
            x, kind = x[keep], own.kind[keep]
            every, n, total = np.sort(x), 0, 0.0
            for c, size in sizes[feature].items():
                mine = np.sort(x[kind == c])
                if not len(mine):
                    continue
                left, right = beyond.get((number, c), ([], []))
                far = min(k, size - 1)
                r, low, high = nearest(mine, np.array(left, float), np.array(right, float), far)
                out = (low <= own.low) | (high > own.high)
                same = r == 0
                a = np.where(same, np.searchsorted(every, low), np.searchsorted(every, low, side="right"))
                b = np.where(same, np.searchsorted(every, high, side="right"), np.searchsorted(every, high))
                times = np.bincount((b - a)[~out])
                m = np.flatnonzero(times)
                total += float((digamma(m) * times[m]).sum()) - len(mine) * float(digamma(np.array(far)) - digamma(np.array(size)))
                for j in np.flatnonzero(out).tolist():
                    for v, sign in ((low[j], -1), (high[j], 1)):
                        asked.append((number, (at << 40) | (n + j), int(np.searchsorted(cuts, v)), float(v), sign, bool(same[j]) == (sign > 0)))
                n += len(mine)
            sums.append((number, n, total))
        left, right = [*zip(*sums, strict=True)], [*zip(*asked, strict=True)] if asked else [()] * 6
        s, q = len(sums), len(asked)
        columns = [
            pa.array([feature] * (s + q), pa.string()), pa.array([*left[0], *right[0]], pa.int32()), pa.array([*left[1], *[None] * q], pa.int64()), pa.array([*left[2], *[None] * q], pa.float64()),
            *(pa.array([*[None] * s, *c], t) for c, t in zip(right[1:], (pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.bool_()), strict=True)),
        ]
        return pa.table(columns, names=[c.split()[0] for c in _PARTS.split(", ")])

    def answer(key: tuple, group: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["feature", "bin", "round", "id", "sign", "count"]
        types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
        if not asked.num_rows:
            return pa.table([pa.array([], t) for t in types], names=names)
        feature, at = key[0].as_py(), key[1].as_py()
        number, v, equal = (asked[c].to_numpy() for c in ("round", "at", "equal"))
        counts = np.zeros(len(v), np.int64)
        if group.num_rows:
            own = chunk(group, feature, at)
            for r in np.unique(number).tolist():
                which = np.flatnonzero(number == r)
                counts[which] = own.count(r, v[which], equal[which])
        columns = [pa.array([feature] * len(v), types[0]), pa.array([at] * len(v), types[1]), asked["round"], asked["id"], asked["sign"], pa.array(counts, types[5])]
        return pa.table(columns, names=names)

    facts_of = cut(grouped.applyInArrow(ends, "feature string, bin int, round int, kind bigint, n bigint, least array<double>, greatest array<double>"))
    lent = facts_of.where("kind IS NOT NULL").select("feature", "round", "kind", "bin", "least", "greatest").groupBy("feature", "round", "kind")
    lent = lent.applyInArrow(lend, "feature string, round int, kind bigint, bin int, left array<double>, right array<double>")
    parts = cut(grouped.cogroup(lent.groupBy("feature", "bin")).applyInArrow(measure, _PARTS))
    asked = parts.where("id IS NOT NULL").select("feature", "bin", "round", "id", "at", "sign", "equal")
    earlier = Window.partitionBy("feature", "round").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # a row a chunk
    # a chunk without rows may hold an interval's end, too
    places = table.select("feature", F.explode(F.sequence(F.lit(0), F.size("cuts"))).alias("bin")).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    inside = places.join(facts_of.where("kind IS NULL").select("feature", "bin", "round", "n"), ["feature", "bin", "round"], "left")
    before = inside.select("feature", "bin", "round", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    counted = grouped.cogroup(asked.groupBy("feature", "bin")).applyInArrow(answer, "feature string, bin int, round int, id bigint, sign int, count bigint")
    m = counted.join(before, ["feature", "bin", "round"]).groupBy("feature", "round", "id").agg(F.sum(F.col("sign") * (F.col("before") + F.col("count"))).alias("m"))
    edges = m.groupBy("feature", "round").agg(F.sum(digamma(F.col("m"), F.log)).alias("edges"))
    whole = parts.where("id IS NULL").groupBy("feature", "round").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).join(edges, ["feature", "round"], "left")
    found = digamma(F.col("n"), F.log) - (F.col("total") + F.coalesce("edges", F.lit(0.0))) / F.col("n")
    return whole.select("round", "feature", F.greatest(F.lit(0.0), found).alias("mi"))
