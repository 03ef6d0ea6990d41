"""Near-duplicates by ProbMinHash, banding and verification.

Each distinct shingle (five words) of a text is a Poisson process of rate 1; an arrival falls on a random
register, and a register keeps the shingle that came first. Two texts' registers agree with probability
equal to the probability Jaccard similarity of their weights, which for equal weights is the Jaccard
similarity of the sets, on which links are defined.
Arrivals are drawn in order of time, and a shingle stops as soon as its time is past the latest first
arrival of the text's registers, so a text of n shingles costs about n + m ln m draws.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm._shared import join_hot, written
from tidewell.llm._text import mix64, shingles, slices, span_hashes, text_bytes, words
from tidewell.llm.components import components

REGISTERS, BANDS, ROWS = 160, 25, 5
WORDS = 5


def weighted_shingles(column: pa.Array, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of each distinct shingle, in order of row and hash.

    A text without a word has one shingle, the hash of its bytes; a null or empty text has none.
    """
    data, ends = text_bytes(column)
    hashes, rows = shingles(*words(data, ends), k, len(column))
    bare = np.flatnonzero((np.bincount(rows, minlength=len(column)) == 0) & (np.diff(ends) > 0))
    if len(bare):
        rows, hashes = np.concatenate([rows, bare]), np.concatenate([hashes, span_hashes(data, ends[bare], ends[bare + 1])])
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    return rows[first], hashes[first], np.diff(np.append(first, len(rows)))


def prob_minhash(rows: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n_rows: int, registers: int = REGISTERS) -> np.ndarray:
    """The shingle in each register of each row (0 in rows without shingles)."""
    first = np.full(n_rows * registers, np.inf)
    held = np.zeros(n_rows * registers, np.uint64)
    live, time, drawn, batch = np.arange(len(rows)), np.zeros(len(rows)), 0, 1
    while len(live):
        # the next arrivals of every shingle that may still be first somewhere
        for_each = np.arange(drawn + 1, drawn + batch + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        bits = mix64(hashes[live][:, None] ^ for_each)
        wait = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / weights[live][:, None]
        when = time[live][:, None] + np.cumsum(wait, axis=1)
        register = ((mix64(bits + np.uint64(1)) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        place = (rows[live][:, None] * registers + register).ravel()
        np.minimum.at(first, place, when.ravel())
        won = np.flatnonzero(first[place] == when.ravel())
        held[place[won]] = hashes[live][won // batch]
        time[live] = when[:, -1]
        latest = first.reshape(n_rows, registers).max(axis=1)
        live = live[time[live] < latest[rows[live]]]
        drawn += batch
        batch = max(1, min(2 * batch, 65536 // max(1, len(live)))) if drawn > 2 else 1
    return held.reshape(n_rows, registers)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, copy, node, n, bands array<long>`` of each row.

    ``node`` is a hash of the weighted shingles: rows with the same are copies. ``copy`` is a hash of
    the text. ``node`` and ``bands`` are null for a null or empty text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            n = part.num_rows
            rows, hashes, counts = weighted_shingles(part.column("text"))
            held = prob_minhash(rows, hashes, np.ones(len(rows)), n)
            node = np.zeros(n, np.uint64)
            np.add.at(node, rows, mix64(hashes ^ (counts.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))))
            size = np.bincount(rows, minlength=n)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (n, BANDS)).copy()
            for r in range(ROWS):
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + held[:, r * BANDS : (r + 1) * BANDS])
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("copy"), pa.array(mix64(node).view(np.int64), mask=size == 0), pa.array(size), pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * n + 1, BANDS, dtype=np.int32)), _signed(key.ravel()))],
                ["id", "copy", "node", "n", "bands"],
            )

    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("copy"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "id bigint, copy bigint, node bigint, n bigint, bands array<bigint>")


def _sets(docs: DataFrame) -> DataFrame:
    """``node, set`` of ``id, text``: the sorted 64-bit hashes of the shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows, hashes, counts = weighted_shingles(part.column("text"))
            node = np.zeros(part.num_rows, np.uint64)
            np.add.at(node, rows, mix64(hashes ^ (counts.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))))
            wide = hashes.astype("<u8")
            ends = np.searchsorted(rows, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays([pa.array(mix64(node).view(np.int64)), pa.array([wide[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["node", "set"])

    return docs.mapInArrow(run, "node bigint, set binary")


def _verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those pairs ``a, b`` whose shingle sets have a Jaccard similarity of at least ``threshold``."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                common = len(np.intersect1d(x, y, assume_unique=True)) if threshold * max(len(x), len(y)) <= min(len(x), len(y)) else 0
                keep.append(common >= threshold * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint")


#: Members of a bucket, and shingles of theirs, that one task compares with as many others.
BLOCK, BLOCK_SHINGLES = 1024, 500_000


def _across(members: DataFrame, threshold: float) -> DataFrame:
    """Links ``a, b`` between members of a bucket that are in different components.

    ``members``: key, node, component, bands, set. A bucket is dealt out as pairs of blocks of about
    BLOCK members; a pair of members is looked at only in the first band that they share. Each is
    verified in place on the whole sets: only set sizes rule a pair out.
    """
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.octet_length("set")) / (8 * BLOCK_SHINGLES))).cast("int")
    sizes = members.groupBy("key").agg(blocks.alias("blocks"))
    dealt = members.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", other).select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component", "bands", "set")

    def run(group: pa.Table) -> pa.Table:
        node, component, block = (group.column(c).to_numpy() for c in ("node", "component", "block"))
        bands = np.array(group.column("bands").to_pylist(), np.int64)
        sets = group.column("set").to_pylist()
        size = np.array([len(x) // 8 for x in sets])
        starts = np.cumsum(size) - size
        shingle, place = np.unique(np.frombuffer(b"".join(sets), "<u8"), return_inverse=True)
        place, held = place.astype(np.int32), np.zeros(len(shingle), bool)
        key, i, j = (group.column(c)[0].as_py() for c in ("key", "i", "j"))
        band = int(np.flatnonzero(bands[0] == key)[0])
        found = [np.zeros((0, 2), np.int64)]
        for x in range(len(node)):
            y = np.flatnonzero((component != component[x]) & (node > node[x]) & ((i == j) | (block != block[x])) & (np.minimum(size, size[x]) >= threshold * np.maximum(size, size[x])))
            y = y[~(bands[y][:, :band] == bands[x][:band]).any(1)]
            if not len(y):
                continue
            own = place[starts[x] : starts[x] + size[x]]
            held[own] = True
            n = size[y]
            first = np.cumsum(n) - n
            at = np.arange(n.sum()) + np.repeat(starts[y] - first, n)
            common = np.add.reduceat(held[place[at]].astype(np.int64), first)
            held[own] = False
            y = y[common >= threshold * (n + size[x] - common)]
            found.append(np.stack([np.full(len(y), node[x]), node[y]], 1))
        found = np.concatenate(found)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return dealt.groupBy("key", "i", "j").applyInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``id, copy, class_id, class_size, kept`` (id named as ``id_col``).

    Documents are linked if their sets of five-word shingles have a Jaccard similarity of ``threshold``
    or more (fewer words: one shingle of all; no word: the bytes); classes are the connected parts,
    ``class_id`` their smallest id (null ids are smallest), ``kept`` marks the row with the smallest id,
    then the smallest text hash ``copy``; rows that repeat id and text are all marked alike. A null or
    empty text is a class of its own. Ids are cast to bigint; other columns are not read.

    Copies are joined by their hash before anything else. In each bucket of a band all members are
    compared with the one that shares most buckets; only members that stay unconnected are compared with
    the others of the bucket, in blocks. All candidates are verified on whole shingle sets.
    """
    rows = written(sketches(docs, id_col, text_col), "sketches")
    nodes = written(rows.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.first("bands").alias("bands")), "nodes")
    keys = nodes.select("node", F.explode("bands").alias("key"))
    full = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = written(keys.join(full, "key"), "members")
    score = members.groupBy("node").agg(F.sum("size").alias("score"))
    scored = members.select("key", "node").join(score, "node")
    leads = scored.groupBy("key").agg(F.max_by("node", F.struct("score", "node")).alias("lead"))
    pairs = scored.join(leads, "key").where("node <> lead").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
    pairs = written(pairs, "pairs")

    # whole texts of one document for each node that has a bucket in common with another
    wanted = nodes.join(score, "node", "left_semi").select("id").distinct()
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    texts = source.join(wanted.hint("shuffle_hash"), source["id"].eqNullSafe(wanted["id"]), "left_semi")
    sets = written(_sets(texts.select("text")).groupBy("node").agg(F.first("set").alias("set")), "sets")
    links = written(_verify(pairs, sets, threshold), "links")

    first = written(members.select("node").distinct().join(components(links), "node", "left").select("node", F.coalesce("component", "node").alias("component")), "first")
    placed = members.select("key", "node").join(first, "node")
    split = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    apart = placed.join(split, "key").join(nodes.select("node", "bands"), "node").join(sets, "node")
    more = _across(apart, threshold)
    found = written(components(links.union(more)), "classes")

    named = rows.select("id", "copy", "node").join(found, "node", "left").withColumn("class", F.coalesce("component", "node"))
    named = written(named.select("id", "copy", "class"), "named")
    some = named.where("class is not null")
    least = written(some.groupBy("class").agg(F.min(F.struct("id", "copy")).alias("least"), F.count("*").alias("class_size")), "class_sums")
    out = join_hot(some, least, ["class"], "class_size").unionByName(named.where("class is null"), allowMissingColumns=True)
    own = F.struct("id", "copy")
    return out.select(F.col("id").alias(id_col), "copy", F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("least.id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), (F.col("class").isNull() | own.eqNullSafe(F.col("least"))).alias("kept"))
