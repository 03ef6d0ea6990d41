"""Hard negatives by inner product, searched in sort-tile-recursive packed R-trees.

Rows are dealt out by class and by tiles of two coordinates, and each task packs what it gets into trees
of bounded size by sort-tile-recursive order. A node knows the least and the greatest value of each
coordinate below it, hence an interval that holds all inner products with an anchor, the least id and
whether all rows are of one class. Blocks of anchors meet all trees; a queue opens nodes from the highest
bound on, and drops those whose interval misses every wanted window or that cannot reach a window's
current k-th best row.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm._shared import written

#: Rows of a tree at most, of a leaf, and children of an inner node.
TREE_ROWS, LEAF, FAN = 4096, 128, 8
#: Anchors that are searched together, and blocks of them that one task takes at most.
BLOCK, BLOCKS = 256, 512
#: Trees that one task searches in turn at most, keeping each block's best rows.
GROUP = 256


def _tile_order(points: np.ndarray, size: int) -> np.ndarray:
    """Rows in sort-tile-recursive order for nodes of ``size`` rows: slabs by the widest coordinate, each sorted on."""
    dims = np.argsort(-points.var(axis=0), kind="stable")[:3]

    def tile(rows: np.ndarray, depth: int) -> np.ndarray:
        rows = rows[np.argsort(points[rows, dims[depth]], kind="stable")]
        left, pages = len(dims) - depth, -(-len(rows) // size)
        if left == 1 or pages < 2:
            return rows
        slabs = int(np.ceil(pages ** (1 / left)))
        step = -(-pages // slabs) * size
        return np.concatenate([tile(rows[k : k + step], depth + 1) for k in range(0, len(rows), step)])

    return tile(np.arange(len(points)), 0) if len(points) and len(dims) else np.arange(len(points))


class Tree:
    """An STR-packed R-tree over integer vectors with ids and classes; nodes are numbered from the leaves up."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, points: np.ndarray):
        names, code = np.unique(labels, return_inverse=True)
        order = np.argsort(code, kind="stable")
        starts = np.searchsorted(code[order], np.arange(len(names) + 1))
        # each class is packed by itself, in whole leaves, so that most nodes are of one class
        order = np.concatenate([order[a:b][_tile_order(points[order[a:b]], LEAF)] for a, b in zip(starts, starts[1:], strict=False)])
        cut = np.concatenate([np.arange(a, b, LEAF) for a, b in zip(starts, starts[1:], strict=False)])
        self.ids, self.points, self.names, self.code = ids[order], points[order], names, code[order]
        self.rows = np.append(cut, len(order))
        low, high = np.minimum.reduceat(self.points, cut, axis=0), np.maximum.reduceat(self.points, cut, axis=0)
        least = np.minimum.reduceat(self.ids, cut)
        kind = self.code[cut]
        self.children: list[tuple[int, int]] = [(-1, k) for k in range(len(cut))]
        lows, highs, leasts, kinds, base = [low], [high], [least], [kind], 0
        while len(low) > 1:
            cut = np.arange(0, len(low), FAN)
            self.children += [(base + k, base + min(k + FAN, len(low))) for k in cut.tolist()]
            base += len(low)
            low, high, least = np.minimum.reduceat(low, cut, axis=0), np.maximum.reduceat(high, cut, axis=0), np.minimum.reduceat(least, cut)
            kind = np.where(np.minimum.reduceat(kind, cut) == np.maximum.reduceat(kind, cut), kind[cut], -1)
            lows, highs, leasts, kinds = [*lows, low], [*highs, high], [*leasts, least], [*kinds, kind]
        self.low, self.high, self.least, self.kind = np.concatenate(lows), np.concatenate(highs), np.concatenate(leasts), np.concatenate(kinds)

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of each anchor with anything in each node."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return up @ self.low.T + down @ self.high.T, up @ self.high.T + down @ self.low.T

    def search(self, anchor: np.ndarray, wanted: int, own: bool, lows: np.ndarray, highs: np.ndarray, best: list[Best], skip: int | None) -> None:
        """Adds rows to the best of each window. ``wanted``: the anchor's class here (-2: none); ``own``: only that class, else all others.

        ``lows`` and ``highs``: the bounds of the anchor with each node.
        """
        usable = self.kind == wanted if own else self.kind != wanted
        usable |= self.kind < 0
        queue = [(-int(highs[-1]), len(self.kind) - 1)]
        while queue:
            top, node = heapq.heappop(queue)
            if not any(w.open(int(lows[node]), -top, int(self.least[node])) for w in best):
                continue
            first, last = self.children[node]
            if first >= 0:
                for child in range(first, last):
                    if usable[child]:
                        heapq.heappush(queue, (-int(highs[child]), child))
                continue
            part = slice(self.rows[last], self.rows[last + 1])
            scores, ids, kind = self.points[part] @ anchor, self.ids[part], self.kind[node]
            if (kind == wanted) != own:
                continue
            top = scores.max()
            for w in best:
                if top >= w.least():
                    w.add(scores, ids, skip)


class Best:
    """The k best rows by score from ``low`` to ``high``, ties by smaller id."""

    __slots__ = ("high", "k", "low", "rows")

    def __init__(self, k: int, low: float = -np.inf, high: float = np.inf):
        self.k, self.low, self.high, self.rows = k, low, high, []

    def open(self, lowest: int, highest: int, least_id: int) -> bool:
        """Whether a node of these bounds can hold a row that belongs here."""
        if highest < self.low or lowest > self.high or self.low > self.high:
            return False
        if len(self.rows) < self.k:
            return True
        score, number = self.rows[-1]
        return (-min(highest, self.high), least_id) < (score, number)

    def least(self) -> float:
        """The score below which no row is taken any more."""
        return self.low if len(self.rows) < self.k else max(self.low, -self.rows[-1][0])

    def add(self, scores: np.ndarray, ids: np.ndarray, skip: int | None) -> None:
        fits = np.flatnonzero((scores >= self.least()) & (scores <= self.high))
        if len(fits):
            more = {(-int(s), int(i)) for s, i in zip(scores[fits], ids[fits], strict=True) if i != skip}
            self.rows = sorted(more.union(self.rows))[: self.k]


def _exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether all inner products are exact in doubles."""
    return a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2**52


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.result_type(np.min_scalar_type(int(x.min(initial=0))), np.min_scalar_type(int(x.max(initial=0)))))


def _trees(rows: DataFrame) -> DataFrame:
    """``tree, blob``: the rows of each partition in packed trees, in the order they come."""

    def packed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        points = table.column("vector").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        tree = Tree(table.column("id").to_numpy(), np.array(table.column("label").to_pylist()), points)
        for name in ("points", "low", "high"):
            setattr(tree, name, _narrow(getattr(tree, name)))
        return pa.RecordBatch.from_arrays([pa.array([int(tree.ids.min())]), pa.array([pickle.dumps(tree.__dict__)], pa.binary())], ["tree", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, room = [], TREE_ROWS
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, room))
                at, room = at + room, room - held[-1].num_rows
                if not room:
                    yield packed(held)
                    held, room = [], TREE_ROWS
        if held:
            yield packed(held)

    return rows.mapInArrow(run, "tree bigint, blob binary")


def _search(trees: DataFrame, blocks: DataFrame, own: bool, k: int) -> DataFrame:
    """``anchor_id, window, id, score``: the k best rows of each window of each anchor, with their ``rank`` from 1.

    Groups of trees meet shards of blocks, both bounded; a task keeps the best rows of a block over the
    trees of its group, so what goes on to be merged is k rows for each window and group.
    """
    n_trees, n_blocks = trees.count(), blocks.count()
    groups = max(-(-n_trees // GROUP), min(n_trees, int(trees.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 1)
    shards = max(1, -(-n_blocks // BLOCKS))
    left = trees.withColumn("g", F.pmod(F.xxhash64("tree"), F.lit(groups)).cast("int")).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = blocks.withColumn("s", F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    tasks = groups * shards
    pairs = left.repartition(tasks, "g", "s").hint("shuffle_hash").join(right.repartition(tasks, "g", "s"), ["g", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, anchors, vectors, best = None, [], None, []

        def out() -> pa.RecordBatch:
            rows = [(a[0], n, i, -s) for a, windows in zip(anchors, best, strict=True) for n, w in enumerate(windows) for s, i in w.rows]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["anchor_id", "window", "id", "score"])

        for batch in batches:
            for block, blob, members in zip(*(batch.column(c) for c in ("block", "blob", "anchors")), strict=True):
                if key != block.as_py():
                    if key is not None:
                        yield out()
                    key, anchors = block.as_py(), pickle.loads(members.as_py())
                    vectors = np.array([a[2] for a in anchors], np.int64)
                    best = [[Best(k, *w) for w in a[3]] for a in anchors]
                tree = Tree.__new__(Tree)
                tree.__dict__ |= pickle.loads(blob.as_py())
                kind = np.float64 if _exact(vectors, tree.points) else np.int64
                tree.points, tree.low, tree.high = tree.points.astype(kind), tree.low.astype(kind), tree.high.astype(kind)
                lows, highs = tree.bounds(vectors.astype(kind))
                names = {name: n for n, name in enumerate(tree.names.tolist())}
                for n, (number, label, _, _) in enumerate(anchors):
                    tree.search(vectors[n].astype(kind), names.get(label, -2), own, lows[n], highs[n], best[n], number)
        if key is not None:
            yield out()

    found = pairs.select("block", "blob", "anchors").mapInArrow(run, "anchor_id bigint, window int, id bigint, score bigint")
    rows = F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("lower"), "id")))
    best = found.groupBy("anchor_id", "window").agg(F.slice(rows, 1, k).alias("rows"))
    best = best.select("anchor_id", "window", F.posexplode("rows").alias("at", "row"))
    return best.select("anchor_id", "window", F.col("row.id").alias("id"), (-F.col("row.lower")).alias("score"), (F.col("at") + 1).alias("rank"))


def _blocks(anchors: DataFrame) -> DataFrame:
    """``block, anchors``: up to BLOCK anchors ``id, label, vector, windows`` in one value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                part = batch.slice(k, BLOCK)
                windows = [[(-np.inf, np.inf) if w["low"] is None else (w["low"], w["high"]) for w in x] for x in part.column("windows").to_pylist()]
                rows = list(zip(part.column("id").to_pylist(), part.column("label").to_pylist(), part.column("vector").to_pylist(), windows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([rows[0][0]], pa.int64()), pa.array([pickle.dumps(rows)], pa.binary())], ["block", "anchors"])

    return anchors.mapInArrow(run, "block bigint, anchors binary")


def hard_negatives(rows: DataFrame, anchor: str = "id % 100 = 0", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """Rows of other classes whose score lies between ``low`` and ``high`` per cent of a positive's.

    ``rows``: ``id bigint, label, vector array<bigint>`` without nulls; other columns are not read. Rows with
    the condition ``anchor`` are anchors; the score of a row is its inner product with the anchor, higher ones
    come first, ties by smaller id. An anchor's positives are its first ``positives`` other rows of its label.
    Returns ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each the first
    ``negatives`` rows of other labels with low * positive <= 100 * negative <= high * positive. Anchors without
    positives, and positives without such rows, give none. Repeated rows count once. Shorter vectors count as padded with zeros. An empty table gives an
    empty table. Rows that differ under one id are all searched, and such an anchor has one list for its vectors.
    """
    rows = rows.select(F.col("id").cast("bigint").alias("id"), F.col("label").cast("string").alias("label"), F.col("vector").cast("array<bigint>").alias("vector"))
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).first()
    dim, count = max(1, facts["dim"] or 1), facts["n"]
    rows = rows.withColumn("vector", F.concat("vector", F.array_repeat(F.lit(0).cast("bigint"), F.lit(dim) - F.size("vector"))))
    tiles = max(1, -(-count // TREE_ROWS))
    slabs = int(np.ceil(np.sqrt(tiles)))
    edges = rows.agg(F.percentile_approx(F.col("vector")[0], [k / slabs for k in range(1, slabs)]).alias("e")).first()["e"] if slabs > 1 else []
    slab = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col("vector")[0])) if edges else F.lit(0)
    second = F.col("vector")[min(1, dim - 1)]
    tiled = rows.withColumn("slab", slab).withColumn("second", second).repartitionByRange(tiles, "label", "slab", "second", "id").sortWithinPartitions("label", "slab", "second", "id")
    trees, anchors = written(_trees(tiled.select("id", "label", "vector")), "trees"), written(rows.where(anchor).distinct(), "anchors")

    all_scores = F.array(F.expr("named_struct('place', 1, 'low', cast(null as bigint), 'high', cast(null as bigint))"))
    first = _search(trees, _blocks(anchors.withColumn("windows", all_scores)), True, positives)
    paired = written(first.select("anchor_id", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # low * positive <= 100 * score <= high * positive, in whole numbers
    share = lambda round_to, per_cent: F.expr(f"cast({round_to}(cast(positive_score as decimal(20, 0)) * {per_cent} / 100) as bigint)")
    bounds = F.struct("place", share("ceil", low).alias("low"), share("floor", high).alias("high"))
    windows = paired.groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(bounds)).alias("windows"))
    found = _search(trees, _blocks(anchors.join(windows, "id")), False, negatives)
    out = found.withColumn("place", F.col("window") + 1).join(paired, ["anchor_id", "place"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


HARD_NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_dot_product(a.e, v.e) AS BIGINT) AS score
  FROM v a JOIN v ON a.vec_id % 100 = 0 AND v.vec_id <> a.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS "rank", vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10
"""
