"""Near-duplicate vectors by spherical-cap filters.

Filter directions are a random product code: a unit vector is rotated and cut into blocks, each block has
its own small book of random words, and any choice of one word a block is a direction. A vector belongs
to every direction whose inner product with it exceeds a threshold, and to a least number of best ones; list decoding finds them without
looking at all directions, from the sorted sums of the two halves. Vectors that share a filter are
compared exactly, in double precision. The books grow with the table so that a filter keeps about as many
vectors; several rotations make lists even.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm._shared import written
from tidewell.llm.components import components

BLOCKS, TABLES = 4, 4
#: Filters that a vector has in each rotation on average.
LIST = 10
#: Filters that a vector has in each rotation at least.
LEAST = 8
#: Members of a filter that one task compares with as many others.
PART = 512


def _code(dim: int, table: int, words: int) -> tuple[np.ndarray, np.ndarray, int]:
    """A rotation, and books[block, word, place]; dimensions are padded to whole blocks."""
    width = -(-dim // BLOCKS)
    random = np.random.default_rng([dim, table, words])
    turn = np.linalg.qr(random.standard_normal((width * BLOCKS, width * BLOCKS)))[0][:dim]
    books = random.standard_normal((BLOCKS, words, width))
    return turn, books / np.linalg.norm(books, axis=2, keepdims=True) / np.sqrt(BLOCKS), width


def decode(unit: np.ndarray, table: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and direction of every filter that a row's vector exceeds."""
    dim = unit.shape[1]
    turn, books, width = _code(dim, table, words)
    scores = np.einsum("npw,pkw->npk", (unit @ turn).reshape(len(unit), BLOCKS, width), books)
    threshold = NormalDist().inv_cdf(1 - min(0.5, LIST / words**BLOCKS)) / np.sqrt(width * BLOCKS)
    halves = [(scores[:, k, :, None] + scores[:, k + 1, None, :]).reshape(len(unit), -1) for k in (0, 2)]
    order = [np.argsort(-h, axis=1, kind="stable") for h in halves]
    left, right = (np.take_along_axis(h, o, 1) for h, o in zip(halves, order, strict=True))
    # a vector that lies badly to the code takes the LEAST best directions: their ranks i, j have i * j <= LEAST
    top = min(LEAST, left.shape[1])
    best = -np.sort(-(left[:, :top, None] + right[:, None, :top]).reshape(len(unit), -1), axis=1)
    threshold = np.minimum(threshold, best[:, min(LEAST, best.shape[1]) - 1] - 1e-12)
    rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(left.shape[1]):
        live = np.flatnonzero(left[:, i] + right[:, 0] >= threshold)
        if not len(live):
            break
        for j in range(right.shape[1]):
            live = live[left[live, i] + right[live, j] >= threshold[live]]
            if not len(live):
                break
            rows.append(live)
            found.append(order[0][live, i] * words**2 + order[1][live, j])
    return np.concatenate(rows), np.concatenate(found)


def _filters(nodes: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                vectors, node = part.column("vector").to_pylist(), part.column("node").to_numpy()
                by_dim: dict[int, list[int]] = {}
                for k, v in enumerate(vectors):
                    by_dim.setdefault(len(v), []).append(k)
                for dim, rows in by_dim.items():
                    unit = np.array([vectors[k] for k in rows], np.float64)
                    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                    for table in range(TABLES):
                        row, direction = decode(unit, table, words)
                        key = (direction * TABLES + table) * 65536 + dim
                        yield pa.RecordBatch.from_arrays([pa.array(node[rows][row]), pa.array(key)], ["node", "key"])

    return nodes.select("node", "vector").mapInArrow(run, "node bigint, key bigint")


def _verify(dealt: DataFrame, threshold: float) -> DataFrame:
    """Linked pairs of ``key, i, j, part, node, vector``, which come in order of key, i, j."""

    def pairs(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        part, node = np.array([r[3] for r in rows]), np.array([r[4] for r in rows], np.int64)
        unit = np.array([r[5] for r in rows], np.float64)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        mixed = rows[0][1] != rows[0][2]
        a, b = np.nonzero(np.triu(unit @ unit.T >= threshold, 1))
        keep = (part[a] != part[b]) | (not mixed)
        a, b = node[a[keep]], node[b[keep]]
        return zip(np.maximum(a, b).tolist(), np.minimum(a, b).tolist(), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found = [], set()

        def out() -> pa.RecordBatch:
            a, b = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "part", "node", "vector")), strict=True):
                if held and row[:3] != held[0][:3]:
                    found.update(pairs(held) if len(held) > 1 else ())
                    held = []
                    if len(found) > 100_000:
                        yield out()
                        found.clear()
                held.append(row)
        found.update(pairs(held) if len(held) > 1 else ())
        yield out()

    ordered = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return ordered.mapInArrow(run, "a bigint, b bigint").distinct()


def cap_links(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row (id named as ``id_col``).

    Vectors of one length are linked if their cosine in double precision is at least ``threshold``. Null,
    empty and zero vectors and those with null or non-finite components link with nothing and are their
    own component. Equal vectors are linked and handled once: ``n_links`` counts all rows, ties and
    repeated ids included. ``component_id`` is the smallest id that links reach; other columns are not
    read. The filters find a pair at the threshold with a chance well above 0.99; none below it is linked.
    """
    good = F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.select("id", F.when(good, F.col("vector")).alias("vector")).withColumn("node", F.when(F.col("vector").isNotNull(), F.xxhash64("vector")))
    # the squares of very large or small components would not fit a double: such vectors are brought to unit size
    most = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    rows = rows.withColumn("vector", F.when(most.between(1e-100, 1e100), F.col("vector")).otherwise(F.transform("vector", lambda x: x / most)))
    nodes = written(rows.where("vector is not null").groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("size"), F.first("vector").alias("vector")), "vectors")
    words = max(4, int(np.ceil(max(1, nodes.count()) ** (1 / BLOCKS))))

    keys = written(_filters(nodes, words), "filters")
    sizes = keys.groupBy("key").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"), F.count("*").alias("n")).where("n > 1")
    dealt = keys.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node").distinct()
    links = written(_verify(dealt.join(nodes.select("node", "vector"), "node"), threshold), "vector_links")

    both = links.union(links.select("b", "a"))
    degree = both.join(nodes.select(F.col("node").alias("b"), "size"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("size").alias("others"))
    parts = nodes.select("node", "least", "size").join(degree, "node", "left").join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = written(parts, "vector_parts")
    least = parts.groupBy("component").agg(F.min("least").alias("component_id"))
    named = parts.join(least, "component").select("node", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("id", "node").join(named, "node", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


CAP_LINKS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
), r AS (
  SELECT vec_id AS node, vec_id AS root FROM v
  UNION
  SELECT l.b, r.root FROM r JOIN l ON l.a = r.node
), c AS (
  SELECT node, min(root) AS component_id FROM r GROUP BY node
), n AS (
  SELECT a, count(*) AS n FROM l GROUP BY a
)
SELECT node AS vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, node = component_id AS kept FROM c LEFT JOIN n ON n.a = c.node
"""
