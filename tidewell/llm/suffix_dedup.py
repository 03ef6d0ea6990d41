"""Removes bytes under long strings that also start earlier, by a distributed merge sort of suffixes.

1. A content-defined choice of anchors (the least hash of K-byte grams in a window) cuts the starts of a
   text into segments: equal strings of ``length`` bytes have their anchor at the same distance. A segment
   whose whole bytes came before is a repeat; the rest is decided by suffixes, but only where an anchor's
   gram occurs in two different segments: elsewhere no string of ``length`` bytes can be repeated.
2. Each task sorts those segments, a segment standing for the suffixes that start in it, into front-coded
   runs (shared prefix length and the rest), one for each bucket of anchor grams: equal strings have equal
   anchors, so they meet. A gram with very many segments is dealt out further, suffix by suffix.
3. A bucket unfolds each run into its sorted suffixes (to ``length`` bytes) and merges the runs with a loser
   tree. A head carries its common prefix with the last winner; heads with different prefixes are ordered
   by that alone, equal ones are compared from there on, so no known prefix is compared again. Equal
   neighbours are repeats of the earliest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm._shared import bucketed, written
from tidewell.llm._text import mix64, slices, span_hashes, text_bytes

GRAM = 32
#: Low bits of an anchor key that hold its place; a longer text is cut into overlapping pieces.
PLACE_BITS = 24
PIECE = 1 << 23
#: Segments that a task gathers before it sorts them.
GATHER_SEGMENTS, GATHER_WANTED = 250_000, 60_000
#: Segments and suffixes of a bucket and bytes of a bucket of texts, about.
BUCKET_SEGMENTS, BUCKET_SUFFIXES, BUCKET_BYTES = 300_000, 300_000, 64 << 20
#: Different segments of one gram from which on its suffixes are dealt out singly.
HOT_SEGMENTS = 4000
#: Files that may come from bucketing without a shuffle.
SMALL_FILES = 4096

_SPANS = "id bigint, copy bigint, spans binary"


def _window_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def segments(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Row, first start (in data), number of starts, gram hash and content hash of each segment."""
    parts: list[tuple[np.ndarray, ...]] = []
    for piece in range(0, max(1, len(data) - length + 1), PIECE):
        some = data[piece : piece + PIECE + length - 1]
        n = len(some) - length + 1
        if n < 1:
            break
        place = np.arange(len(some) - GRAM + 1)
        gram = span_hashes(some, place, place + GRAM)
        keys = (gram >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | place.astype(np.uint64)
        anchor = (_window_min(keys, length - GRAM + 1) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[piece : piece + len(some)]
        valid = row[:n] == row[length - 1 :]
        new = np.ones(n, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:n] != row[: n - 1]) | (valid[1:] != valid[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, n))
        first, count = first[valid[first]], count[valid[first]]
        at = anchor[first]
        whole = span_hashes(some, first, first + count + length - 1)
        content = mix64(whole ^ ((at - first) * 1024 + count).astype(np.uint64))
        parts.append((row[first], first + piece, count, gram[at], content))
    if not parts:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    return tuple(map(np.concatenate, zip(*parts, strict=True)))


def _packed_spans(ids: np.ndarray, copies: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row a document: its spans as pairs of 32-bit (64-bit from 4 GB on would not fit a string) offsets."""
    if not len(ids):
        return
    order = np.lexsort((starts, copies, ids))
    ids, copies, starts, stops = ids[order], copies[order], starts[order], stops[order]
    same = (ids[1:] == ids[:-1]) & (copies[1:] == copies[:-1])
    joined = np.zeros(len(ids), bool)
    joined[1:] = same & (starts[1:] <= stops[:-1])
    first = np.flatnonzero(~joined)
    starts, stops = starts[first], np.maximum.reduceat(stops, first)
    ids, copies = ids[first], copies[first]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (copies[1:] != copies[:-1])
    bounds = [*np.flatnonzero(new).tolist(), len(ids)]
    pairs = np.stack([starts, stops], 1).astype("<u4")
    yield pa.RecordBatch.from_arrays([pa.array(ids[bounds[:-1]]), pa.array(copies[bounds[:-1]]), pa.array([pairs[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], ["id", "copy", "spans"])


def _first_of_class(order_keys: tuple[np.ndarray, ...], *class_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sort by class, then order; and which sorted places start a class."""
    order = np.lexsort((*order_keys[::-1], *class_keys[::-1]))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in class_keys])
    return order, new


def _segment_blobs(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """``bucket, n, cells`` of segments that are first in their slice, and with bucket -1 spans of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> Iterator[pa.RecordBatch]:
            ids, copies, starts, counts, gram, content = map(np.concatenate, zip(*held, strict=True))
            order, new = _first_of_class((ids, copies, starts), content)
            again = order[~new]
            # a row that repeats id and text is the same document: equal places are not copies
            first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))[~new]]
            again = again[(ids[again] != ids[first]) | (copies[again] != copies[first]) | (starts[again] != starts[first])]
            for batch in _packed_spans(ids[again], copies[again], starts[again], starts[again] + counts[again] + length - 1):
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, -1, np.int32)), batch.column("id"), batch.column("copy"), batch.column("spans"), *(pa.nulls(n, pa.binary()) for _ in range(4))], names)
            keep = order[new]
            # anchors have small hashes: mixed again, they spread evenly
            bucket = ((mix64(gram[keep]) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            keep = keep[np.argsort(bucket, kind="stable")]
            bounds = np.searchsorted(np.sort(bucket), np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(bounds)).tolist():
                some = keep[bounds[b] : bounds[b + 1]]
                keys, place = np.unique(np.stack([ids[some], copies[some]], 1), axis=0, return_inverse=True)
                cells = [keys.astype("<i8").tobytes(), place.astype("<u4" if len(keys) > 65535 else "<u2").tobytes(), starts[some].astype("<u4").tobytes() + counts[some].astype(np.uint8).tobytes(), (mix64(gram[some]) & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), content[some].astype("<u8").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), *(pa.array([c], pa.binary()) for c in cells)], names)

        names = ["bucket", "id", "copy", "keys", "place", "where", "gram", "content"]
        for part in slices(batches):
            data, ends = text_bytes(part.column("text"))
            row, first, count, gram, content = segments(data, ends, length)
            held.append((part.column("id").to_numpy()[row], part.column("copy").to_numpy()[row], first - ends[row], count, gram, content))
            if sum(len(x[0]) for x in held) > GATHER_SEGMENTS:
                yield from out()
                held = []
        if held:
            yield from out()

    return docs.mapInArrow(run, "bucket int, id bigint, copy bigint, keys binary, place binary, where binary, gram binary, content binary")


def _settle_segments(blobs: DataFrame, length: int) -> DataFrame:
    """``id, copy, spans, kind, n``: kind 0, spans of whole repeats; 1, starts of segments whose suffixes
    must be sorted; 2, the same for grams with very many segments. ``n`` counts starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets: dict[int, list[dict]] = {}
        for batch in batches:
            yield from _tagged(_passed_on(batch, "bucket"), 0)
            for x in batch.filter(pa.array(batch.column("bucket").to_numpy() >= 0)).to_pylist():
                buckets.setdefault(x["bucket"], []).append(x)
        for same in buckets.values():
            cols: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for x in same:
                keys, n = np.frombuffer(x["keys"], "<i8").reshape(-1, 2), len(x["gram"]) // 4
                place = np.frombuffer(x["place"], "<u4" if len(x["place"]) == 4 * n else "<u2")
                for col, value in zip(cols, (keys[place, 0], keys[place, 1], np.frombuffer(x["where"][: 4 * n], "<u4").astype(np.int64), np.frombuffer(x["where"][4 * n :], np.uint8).astype(np.int64), np.frombuffer(x["gram"], "<u4"), np.frombuffer(x["content"], "<u8")), strict=True):
                    col.append(value)
            ids, copies, starts, counts, gram, content = map(np.concatenate, cols)
            order, new = _first_of_class((ids, copies, starts), gram, content)
            again = order[~new]
            first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))[~new]]
            again = again[(ids[again] != ids[first]) | (copies[again] != copies[first]) | (starts[again] != starts[first])]
            yield from _tagged(_packed_spans(ids[again], copies[again], starts[again], starts[again] + counts[again] + length - 1), 0)
            kept = order[new]
            fresh = np.ones(len(kept), bool)
            fresh[1:] = gram[kept][1:] != gram[kept][:-1]
            size = np.diff(np.append(np.flatnonzero(fresh), len(kept)))
            for kind, which in ((1, (size > 1) & (size <= HOT_SEGMENTS)), (2, size > HOT_SEGMENTS)):
                several = kept[np.repeat(which, size)]
                yield from _tagged(_packed_spans(ids[several], copies[several], starts[several], starts[several] + counts[several]), kind)

    return blobs.mapInArrow(run, f"{_SPANS}, kind int, n bigint")


def _passed_on(batch: pa.RecordBatch, number: str) -> Iterator[pa.RecordBatch]:
    """Spans that a slice has found by itself: rows with a negative number."""
    some = batch.filter(pa.array(batch.column(number).to_numpy() < 0))
    if some.num_rows:
        yield pa.RecordBatch.from_arrays([some.column("id"), some.column("copy"), some.column("keys")], ["id", "copy", "spans"])


def _tagged(batches: Iterator[pa.RecordBatch], kind: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        pairs = [np.frombuffer(x, "<u4").reshape(-1, 2).astype(np.int64) for x in b.column("spans").to_pylist()]
        n = [int((x[:, 1] - x[:, 0]).sum()) for x in pairs]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, kind, np.int32)), pa.array(n, pa.int64())], [*b.schema.names, "kind", "n"])


def front_code(strings: np.ndarray, width: int, sizes: np.ndarray | None = None) -> tuple[np.ndarray, bytes]:
    """Common prefix of each sorted string with the one before, and all the rests, joined.

    ``sizes``: bytes of each string that count; the strings are padded with zeros to ``width``.
    """
    grid = np.frombuffer(strings.tobytes(), np.uint8).reshape(-1, width)
    differs = np.ones((len(grid), width + 1), bool)
    differs[1:, :width] = grid[1:] != grid[:-1]
    differs[0, :width] = True
    shared, place = differs.argmax(axis=1), np.arange(width)
    if sizes is None:
        return shared, grid[place >= shared[:, None]].tobytes()
    shared = np.minimum(shared, sizes)
    return shared, grid[(place >= shared[:, None]) & (place < sizes[:, None])].tobytes()


def merge_runs(runs: list[tuple[list[int], bytes]], length: int) -> Iterator[tuple[int, int, bool]]:
    """Merges front-coded runs: (run, place in run, equal to the one before) in sorted order.

    Ties go to the lower run. A loser tree over the runs' heads; ``shared`` of a head is its common prefix
    with the last winner (for a loser: with the winner it lost to), which is all that most plays look at.
    """
    k = 1 << max(1, len(runs) - 1).bit_length() if len(runs) > 1 else 2
    heads, shared = [b""] * k, [-1] * k
    place, at = [0] * k, [0] * k

    def advance(r: int) -> None:
        lcps, rest = runs[r]
        p = place[r]
        if p == len(lcps):
            shared[r] = -1  # nothing is left: loses to all
            return
        lcp = lcps[p]
        cut = at[r] + length - lcp
        heads[r] = heads[r][:lcp] + rest[at[r] : cut]
        at[r], place[r], shared[r] = cut, p + 1, lcp

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's prefix is then that with the winner."""
        x, y = shared[a], shared[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return (a, b)
        s, t = heads[a], heads[b]
        if s == t:
            low, high = (a, b) if a < b else (b, a)
            shared[high] = length
            return low, high
        n = x
        while s[n] == t[n]:
            n += 1
        low, high = (a, b) if s[n] < t[n] else (b, a)
        shared[high] = n
        return low, high

    for r in range(len(runs)):
        advance(r)
        if shared[r] >= 0:
            shared[r] = 0
    losers, winners = [0] * k, [*([0] * k), *range(k)]
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1]
    while shared[best] >= 0:
        yield best, place[best] - 1, shared[best] == length
        advance(best)
        node = (best + k) >> 1
        while node:
            other = losers[node]
            best, losers[node] = play(best, other)
            node >>= 1


def _marked(size: int, ends: np.ndarray, spans: pa.Array) -> np.ndarray:
    """Which starts of a slice the rows' spans hold."""
    edge = np.zeros(size + 1, np.int32)
    for row, held in enumerate(spans.to_pylist()):
        if held:
            pairs = np.frombuffer(b"".join(held), "<u4").reshape(-1, 2).astype(np.int64) + ends[row]
            np.add.at(edge, pairs[:, 0], 1)
            np.add.at(edge, pairs[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def _runs(joined: DataFrame, buckets: int, length: int) -> DataFrame:
    """``bucket, keys, where, run``: front-coded sorted segments of a task's texts for each bucket."""
    width = 2 * length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> Iterator[pa.RecordBatch]:
            bucket, ids, copies, starts, counts, strings = map(np.concatenate, zip(*held, strict=True))
            order = np.argsort(strings, kind="stable")
            order = order[np.argsort(bucket[order], kind="stable")]
            bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(bounds)).tolist():
                some = order[bounds[b] : bounds[b + 1]]
                shared, rest = front_code(strings[some], width, counts[some] + length - 1)
                keys, place = np.unique(np.stack([ids[some], copies[some]], 1), axis=0, return_inverse=True)
                where = np.stack([place, starts[some], counts[some], shared], 1).astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *(pa.array([c], pa.binary()) for c in (keys.astype("<i8").tobytes(), where, rest))], ["bucket", "keys", "where", "run"])

        for part in slices(batches):
            data, ends = text_bytes(part.column("text"))
            row, first, count, gram, _ = segments(data, ends, length)
            singly = _marked(len(data), ends, part.column("singly"))[first]
            keep = _marked(len(data), ends, part.column("spans"))[first]
            one = np.repeat(first[singly], count[singly]) + (np.arange(count[singly].sum()) - np.repeat(np.cumsum(count[singly]) - count[singly], count[singly]))
            rows = np.concatenate([row[keep], np.repeat(row[singly], count[singly])])
            starts, counts = np.concatenate([first[keep], one]), np.concatenate([count[keep], np.ones(len(one), np.int64)])
            spread = mix64(np.concatenate([gram[keep], span_hashes(data, one, one + length)]))
            bucket = ((spread >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            padded = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(width, np.uint8)]), width)[starts].copy()
            padded[np.arange(width) >= (counts + length - 1)[:, None]] = 0
            held.append((bucket, part.column("id").to_numpy()[rows], part.column("copy").to_numpy()[rows], starts - ends[rows], counts, padded.view(f"S{width}").ravel()))
            if sum(len(x[0]) for x in held) > GATHER_WANTED:
                yield from out()
                held = []
        if held:
            yield from out()

    return joined.mapInArrow(run, "bucket int, keys binary, where binary, run binary")


def _unfolded(x: dict, length: int) -> tuple[np.ndarray, ...]:
    """Id, copy, start and bytes of the suffixes of a run of segments, sorted by bytes, then place."""
    width = 2 * length - GRAM
    where, keys = np.frombuffer(x["where"], "<u4").reshape(-1, 4).astype(np.int64), np.frombuffer(x["keys"], "<i8").reshape(-1, 2)
    grid, rest, at, last = np.zeros((len(where), width), np.uint8), np.frombuffer(x["run"], np.uint8), 0, None
    for k, (size, shared) in enumerate(zip((where[:, 2] + length - 1).tolist(), where[:, 3].tolist(), strict=True)):
        line = grid[k]
        if shared:
            line[:shared] = last[:shared]
        line[shared:size] = rest[at : at + size - shared]
        at, last = at + size - shared, line
    segment, step = np.nonzero(np.arange(width - length + 1) < where[:, 2, None])
    strings = np.lib.stride_tricks.sliding_window_view(grid, length, axis=1)[segment, step].view(f"S{length}").ravel()
    ids, copies, starts = keys[where[segment, 0], 0], keys[where[segment, 0], 1], where[segment, 1] + step
    order = np.lexsort((starts, copies, ids))
    order = order[np.argsort(strings[order], kind="stable")]
    return ids[order], copies[order], starts[order], strings[order]


def _merged(runs: DataFrame, length: int) -> DataFrame:
    """Spans of suffixes that equal an earlier one, from the merge of each bucket's runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets: dict[int, list[dict]] = {}
        for batch in batches:
            for x in batch.to_pylist():
                buckets.setdefault(x["bucket"], []).append(x)
        for same in buckets.values():
            places, coded = [], []
            while same:
                ids, copies, starts, strings = _unfolded(same.pop(), length)
                new = np.ones(len(ids), bool)
                new[1:] = strings[1:] != strings[:-1]
                first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
                again = ~new & ((ids != ids[first]) | (copies != copies[first]) | (starts != starts[first]))
                yield from _packed_spans(ids[again], copies[again], starts[again], starts[again] + length)
                places.append(np.stack([ids, copies, starts], 1)[new])
                shared, rest = front_code(strings[new], length)
                coded.append((shared.tolist(), rest))
            found: list[tuple[int, int, int]] = []
            group: list[tuple[int, int]] = []

            def close(group: list[tuple[int, int]], found: list, places: list) -> None:
                all_ = [tuple(places[r][p].tolist()) for r, p in group]
                least = min(all_)
                found += [x for x in all_ if x != least]

            last = (0, 0)
            for r, p, equal in merge_runs(coded, length):
                if equal:
                    group += [(r, p)] if group else [last, (r, p)]
                elif group:
                    close(group, found, places)
                    group = []
                last = (r, p)
            if group:
                close(group, found, places)
            if found:
                x = np.array(found, np.int64)
                yield from _packed_spans(x[:, 0], x[:, 1], x[:, 2], x[:, 2] + length)

    return runs.mapInArrow(run, _SPANS)


def suffix_dedup(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept binary`` of every row.

    Bytes of the UTF-8 text go if a ``length``-byte string over them also starts earlier: at a smaller id
    (null first), then smaller text hash, or earlier in the same text. Overlaps count; strings are judged
    on the input and never cross texts. ``kept`` joins what is left. A null text counts as empty. Rows
    that repeat id and text are one document: they do not remove each other and come back alike. Whole
    segments count as equal if 64-bit hashes of their bytes, places and lengths are; all other strings are
    compared byte by byte. Other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    least_id = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(least_id)).alias("id"), F.col(id_col).isNull().alias("no_id"), F.xxhash64(text).alias("copy"), text.alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]

    # the texts are bucketed by document once; both joins below find them in place
    # (fewer buckets than shuffle partitions would be dealt anew)
    n_buckets = max(size // BUCKET_BYTES + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = rows if rows.rdd.getNumPartitions() * n_buckets <= SMALL_FILES else rows.repartition(int(n_buckets), "id", "copy")
    texts = bucketed(spread, "suffix_texts", int(n_buckets), "id", "copy")

    buckets = int(size // (BUCKET_SEGMENTS * 35)) + 2
    blobs = _segment_blobs(rows.select("id", "copy", "text"), length, buckets)
    # slices' own repeats ride along as a bucket of their own, dealt at random
    target = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
    dealt = blobs.repartitionById(buckets, target)
    settled = written(_settle_segments(dealt, length), "segments")

    of_kind = lambda k: F.collect_list(F.when(F.col("kind") == k, F.col("spans")))
    asked = settled.where("kind > 0")
    wanted = asked.groupBy("id", "copy").agg(of_kind(1).alias("spans"), of_kind(2).alias("singly"))
    joined = texts.select("id", "copy", "text").join(wanted.hint("shuffle_hash"), ["id", "copy"])
    buckets = int((asked.agg(F.sum("n")).first()[0] or 0) // BUCKET_SUFFIXES) + 2
    merged = written(_merged(_runs(joined, buckets, length).repartitionById(buckets, F.col("bucket")), length), "suffixes")

    spans = settled.where("kind = 0").select("id", "copy", "spans").union(merged).groupBy("id", "copy").agg(F.collect_list("spans").alias("spans"))
    cut = texts.join(spans, ["id", "copy"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = []
            for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                raw = np.frombuffer(text.encode(), np.uint8)
                edge = np.zeros(len(raw) + 1, np.int64)
                if spans:
                    pairs = np.frombuffer(b"".join(spans), "<u4").reshape(-1, 2)
                    np.add.at(edge, pairs[:, 0], 1)
                    np.add.at(edge, pairs[:, 1], -1)
                gone = np.cumsum(edge[:-1]) > 0
                out.append((len(raw), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()), raw[~gone].tobytes()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True))], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    cut = cut.select(F.when(~F.col("no_id"), F.col("id")).alias("id"), "text", "spans")
    return cut.mapInArrow(run, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary").withColumnRenamed("id", id_col)


def suffix_digest(deduped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts and the hash of what :func:`suffix_dedup` kept of each row; an empty table gives none."""
    return deduped.select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
