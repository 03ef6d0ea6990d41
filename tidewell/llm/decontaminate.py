"""Benchmark decontamination by greedy string tiling.

Seeds of five words join a text with the benchmark items that share one. For each such item the longest
common run of words is marked, again and again, never overlapping in the text or the item, by running
Karp-Rabin: rolling hashes of all free runs of a length, the greatest length that still matches. Tiles may
lie in any order, so a passage whose sentences were moved is still covered. The share of the item's words
under tiles decides. Work and memory for a text and an item follow the sum of their lengths, not the
product: pairs of places are never listed, however repetitive both are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm._shared import written
from tidewell.llm._text import mix64, shingles, slices, text_bytes, words

WORDS = 5
#: Words of benchmark items in one pass over the documents at most, if an item has no more: 8 bytes each are broadcast.
PASS_WORDS = 4_000_000
#: Pairs of a text's seed and an item that are looked at together.
PAIRS = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)


class _Runs:
    """Rolling hashes of the free runs of a sequence of words."""

    def __init__(self, sequence: np.ndarray):
        self.words = sequence
        n = len(sequence)
        power = np.full(n + 1, _BASE, np.uint64)
        power[0] = 1
        self.power = np.multiply.accumulate(power)
        # sums of word * base ** place: a run's is brought to a common power to compare
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(sequence * self.power[:n], out=self.sums[1:])
        self.free = np.ones(n, bool)

    def hashes(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of free runs of a length, and hashes."""
        n = len(self.words)
        if n < length:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        taken = np.concatenate([[0], np.cumsum(~self.free)])
        starts = np.flatnonzero(taken[length:] == taken[:-length])
        return starts, mix64((self.sums[starts + length] - self.sums[starts]) * self.power[n - starts])

    def mark(self, start: int, length: int) -> None:
        self.free[start : start + length] = False


def tiles(text: np.ndarray, item: np.ndarray, least: int = WORDS) -> list[tuple[int, int, int]]:
    """Greedy tiling: (start in text, start in item, words) of each tile, longest first.

    Ties: earlier in the text, then in the item. The two sequences are hashes of words.
    """
    # both hash with powers of one base, brought to the same exponent: the texts' lengths differ
    size = max(len(text), len(item))
    pad = lambda x: np.concatenate([x, np.zeros(size - len(x), np.uint64)])
    a, b = _Runs(pad(text)), _Runs(pad(item))
    a.free[len(text) :] = b.free[len(item) :] = False
    found: list[tuple[int, int, int]] = []
    most = min(len(text), len(item))
    while most >= least:
        low, high = least - 1, most  # the greatest length with a common run
        while low < high:
            length = (low + high + 1) // 2
            if np.isin(a.hashes(length)[1], b.hashes(length)[1]).any():
                low = length
            else:
                high = length - 1
        if low < least:
            break
        (p, text_runs), (q, item_runs) = a.hashes(low), b.hashes(low)
        order = np.argsort(item_runs, kind="stable")
        item_runs, q = item_runs[order], q[order]
        first, last = np.searchsorted(item_runs, text_runs, "left"), np.searchsorted(item_runs, text_runs, "right")
        moved = False
        for k in np.flatnonzero(last > first).tolist():
            start = int(p[k])
            if not a.free[start : start + low].all():
                continue
            for other in q[first[k] : last[k]].tolist():
                if b.free[other : other + low].all() and (text[start : start + low] == item[other : other + low]).all():
                    a.mark(start, low)
                    b.mark(other, low)
                    found.append((start, other, low))
                    moved = True
                    break
            if not b.free[: len(item)].any():
                break
        most = low if moved else low - 1
    return found


def _passes(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """Benchmark items in bounded blocks; one block is on the driver at a time."""
    sized = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).where("text is not null")
    block, size = [], 0
    for row in sized.toLocalIterator():
        n = len(row.text) // 2 + 1
        if block and size + n > PASS_WORDS:
            yield block
            block, size = [], 0
        block.append((row.item, row.text))
        size += n
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, least_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs of a document and a benchmark item whose tiles cover ``least_share`` of the item's words.

    Returns ``id, item_id, n_words, n_tiled, n_tiles, longest, coverage``, and ``copy``, the hash of the
    text. Words are runs of letters, digits and non-ASCII signs, A-Z as a-z. Items of fewer than five
    words or without text match nothing, nor do null or empty texts; repeated rows give repeated pairs.
    The benchmark is a stated query set: it meets all documents block by block, and a block, at most
    PASS_WORDS words or one item, is what is broadcast. Of several blocks each is a pass over the documents
    whose result is written before the next block is read. No shuffle.
    """
    spark, schema = docs.sparkSession, "id bigint, copy bigint, item_id bigint, n_words int, n_tiled int, n_tiles int, longest int, coverage double"
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("copy"), F.col(text_col).alias("text"))
    blocks = _passes(benchmark, item_col, item_text_col)
    block, following = next(blocks, None), next(blocks, None)
    if block is None:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    if following is None:
        return source.mapInArrow(_matcher(spark.sparkContext.broadcast(_seeds(block)), least_share), schema).withColumnRenamed("id", id_col)
    out = spark.createDataFrame([], schema)
    while block is not None:
        shared = spark.sparkContext.broadcast(_seeds(block))
        out = out.union(written(source.mapInArrow(_matcher(shared, least_share), schema), "contamination"))
        shared.destroy()
        block, following = following, next(blocks, None)
    return out.withColumnRenamed("id", id_col)


def _seeds(block: list[tuple[int, str]]) -> dict:
    """The items' words, and in order of hash each item's different seeds and how often it has each."""
    data, ends = text_bytes(pa.array([t for _, t in block], pa.string()))
    hashes, rows = words(data, ends)
    first = np.searchsorted(rows, np.arange(len(block) + 1))
    seeds, seed_rows = shingles(hashes, rows, WORDS, len(block))
    whole = np.diff(first)[seed_rows] >= WORDS if len(seed_rows) else np.zeros(0, bool)
    seeds, seed_rows, often = _distinct(seeds[whole], seed_rows[whole])
    return {"items": [x for x, _ in block], "words": [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)], "seeds": seeds, "rows": seed_rows, "often": often}


def _distinct(seeds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (seed, row) in order, and how often each comes."""
    order = np.lexsort((rows, seeds))
    seeds, rows = seeds[order], rows[order]
    new = np.ones(len(seeds), bool)
    new[1:] = (seeds[1:] != seeds[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    return seeds[first], rows[first], np.diff(np.append(first, len(seeds)))


def _met(seeds: np.ndarray, rows: np.ndarray, known: dict, n_rows: int) -> list[tuple[int, int, int]]:
    """(row, item, places of the item whose seed the row has) of all that share a seed."""
    seeds, rows, _ = _distinct(seeds, rows)
    low, high = np.searchsorted(known["seeds"], seeds, "left"), np.searchsorted(known["seeds"], seeds, "right")
    sums: dict[int, int] = {}
    width, n_items = high - low, len(known["items"])
    edges = np.searchsorted(np.cumsum(width), np.arange(PAIRS, int(width.sum()) + PAIRS, PAIRS), "left") + 1
    edges = [0, *np.unique(np.minimum(edges, len(seeds))).tolist()]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        n = width[a:b]
        at = np.repeat(low[a:b] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pair, place = np.unique(np.repeat(rows[a:b], n) * n_items + known["rows"][at], return_inverse=True)
        for x, often in zip(pair.tolist(), np.bincount(place, known["often"][at], len(pair)).astype(np.int64).tolist(), strict=True):
            sums[x] = sums.get(x, 0) + often
    return [(x // n_items, x % n_items, often) for x, often in sorted(sums.items())]


def _near(text: np.ndarray, seeds: np.ndarray, item_seeds: np.ndarray) -> np.ndarray:
    """The words of the text under seeds of the item; between two stretches of them a word that no text has."""
    hit = np.flatnonzero(np.isin(seeds, item_seeds))
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + WORDS, -1)
    under = np.cumsum(edge[:-1]) > 0
    gap = under & ~np.concatenate([[True], under[:-1]])
    kept = text[under]
    return np.insert(kept, np.cumsum(under)[gap] - 1, 0)


def _matcher(shared, least_share: float):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        # most hashes are ruled out by their low 22 bits
        filter_bits = np.zeros(1 << 22, bool)
        filter_bits[(known["seeds"] & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        own_seeds: dict[int, np.ndarray] = {}
        for part in slices(batches):
            hashes, rows = words(*text_bytes(part.column("text")))
            first = np.searchsorted(rows, np.arange(part.num_rows + 1))
            seeds, seed_rows = shingles(hashes, rows, WORDS, part.num_rows)
            seed_first = np.searchsorted(seed_rows, np.arange(part.num_rows + 1))
            maybe = np.flatnonzero(filter_bits[(seeds & np.uint64((1 << 22) - 1)).astype(np.int64)] & (np.diff(first)[seed_rows] >= WORDS))
            out = []
            for row, item, places in _met(seeds[maybe], seed_rows[maybe], known, part.num_rows):
                item_words = known["words"][item]
                if WORDS * places < least_share * len(item_words):
                    continue
                if item not in own_seeds:
                    own_seeds[item] = shingles(item_words, np.zeros(len(item_words), np.int64), WORDS, 1)[0]
                near = _near(hashes[first[row] : first[row + 1]], seeds[seed_first[row] : seed_first[row + 1]], own_seeds[item])
                got = [x for _, _, x in tiles(near, item_words)]
                n = sum(got)
                if n >= least_share * len(item_words):
                    out.append((part.column("id")[row].as_py(), part.column("copy")[row].as_py(), known["items"][item], len(item_words), n, len(got), max(got), n / len(item_words)))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
                names = ["id", "copy", "item_id", "n_words", "n_tiled", "n_tiles", "longest", "coverage"]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run
