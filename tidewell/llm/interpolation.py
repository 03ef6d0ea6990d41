"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates of words, pairs and triples (a word after none, one or two
words of history) with a uniform one:

    p1(w)     = l1 * c(w) / N                 + (1 - l1) / (V + 1)
    p2(w|v)   = l2[c(v)] * c(v w) / c(v)      + (1 - l2) * p1(w)
    p3(w|u v) = l3[c(u v)] * c(u v w) / c(u v) + (1 - l3) * p2(w|v)

A weight depends on the bucket of its history's count, the binary logarithm. The weights are learned by
expectation maximisation on the tokens of a tenth of the training documents, with the counts of the other
nine tenths; scores then use the counts of all training documents.

Tokens are counted by requests and replies. A slice is some documents whose tokens one task can hold. It
sends each bucket of n-gram hashes the ones it holds, distinct and with its own counts; a bucket adds up
and sends every slice the totals of its n-grams, in the order asked. A frequent n-gram costs its bucket
one entry a slice, however often it occurs. Slices and replies are bucketed tables, so that they meet in
place, first for the held-out tokens, then for the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm._shared import bucketed, written
from tidewell.llm._text import _LOWER, mix64, slices, span_hashes, text_bytes, word_spans

#: Tokens of a slice, about; one document with more is a slice of its own.
SLICE_TOKENS = 1_500_000
#: Requests of a bucket, about, and requests a token that are reckoned with.
BUCKET_REQUESTS, REQUESTS_A_TOKEN = 1_500_000, 1.6
#: Bits of a pair's or triple's hash that travel, beyond the binary logarithm of all tokens: about one
#: n-gram in 2 ** SPARE_BITS is taken for another, at any size. Words travel with all 64 bits.
SPARE_BITS = 20
#: Tokens whose probabilities are worked out together.
SCORE_TOKENS = 1 << 18
#: One of so many training documents is held out for the weights.
HELD_PART = 10
#: Histories by the binary logarithm of their count; ratios of two estimates by steps of 2 ** (1 / RATIO_STEPS).
COUNT_BUCKETS, RATIO_STEPS, RATIO_RANGE = 64, 16, 64
RATIO_BINS = 2 * RATIO_STEPS * RATIO_RANGE + 2
MOST_WEIGHT = 0.9999

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_END, _START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token, and the tokens of each row; a row ends with an end token."""
    data, ends = text_bytes(column)
    starts, stops, rows = word_spans(data, ends, _BLANK)
    size = np.bincount(rows, minlength=len(column)) + 1
    word = np.full(len(rows) + len(column), _END, np.uint64)
    inner = np.ones(len(word), bool)
    inner[np.cumsum(size) - 1] = False
    word[inner] = span_hashes(_LOWER[data], starts, stops)
    return word, size


# --- packed numbers: planes of bytes, so that what is small or alike compresses


def _packed(*columns: tuple[np.ndarray, int]) -> bytes:
    """Columns of unsigned numbers as byte planes, the low ``width`` bytes of each."""
    planes = [np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes() for x, width in columns]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, *columns: tuple[int, int]) -> list[np.ndarray]:
    """The columns, each of a length and a width, of :func:`_packed`."""
    data = np.frombuffer(pa.decompress(raw, sum(n * width for n, width in columns), codec="zstd"), np.uint8)
    out, at = [], 0
    for n, width in columns:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = data[at : at + n * width].reshape(width, n).T
        out.append(wide.view("<u8").ravel())
        at += n * width
    return out


# --- slices


def _slices(docs: DataFrame, train: Column, id_col: str, text_col: str, slice_tokens: int) -> DataFrame:
    """``slice, n_docs, n_tokens, n_words, train_docs, train_tokens, held_docs, held_tokens, ids, rows, words, local``.

    ``rows``: tokens and marks (1 training, 2 held out) of each document; ``words``: the distinct hashes,
    most frequent first; ``local``: each token's place in them.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    train = F.coalesce(train, F.lit(False))
    held = train & (F.pmod(F.xxhash64(F.col(id_col), text), F.lit(HELD_PART)) == 0)
    mark = train.cast("int") + 2 * held.cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32

        def out(number: int) -> pa.RecordBatch:
            ids, marks, word, size = ([x[k] for x in held_back] for k in range(4))
            ids, marks, word, size = pa.concat_arrays(ids), np.concatenate(marks), np.concatenate(word), np.concatenate(size)
            words, local, often = np.unique(word, return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            totals = [x for bit in (1, 2) for x in ((marks & bit > 0).sum(), size[marks & bit > 0].sum())]
            numbers = [first + number, len(marks), len(word), len(words), *totals]
            cells = [_packed((size, 4), (marks, 1)), _packed((words[order], 8)), _packed((place[local], 4))]
            columns = [pa.array([int(x)], pa.int64()) for x in numbers] + [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)] + [pa.array([c], pa.binary()) for c in cells]
            return pa.RecordBatch.from_arrays(columns, names)

        held_back: list[tuple] = []
        total = number = 0
        for part in slices(batches):
            word, size = tokens(part.column("text"))
            if held_back and total + len(word) > slice_tokens:
                yield out(number)
                held_back, total, number = [], 0, number + 1
            # copies: the columns themselves would keep the batch's texts
            held_back.append((part.column("id").take(pa.array(range(part.num_rows))), part.column("mark").to_numpy().copy(), word, size))
            total += len(word)
        if held_back:
            yield out(number)

    numbers = ["slice", "n_docs", "n_tokens", "n_words", "train_docs", "train_tokens", "held_docs", "held_tokens"]
    names = [*numbers, "ids", "rows", "words", "local"]
    schema = ", ".join([*(f"{c} bigint" for c in numbers), f"ids array<{id_type}>", "rows binary", "words binary", "local binary"])
    return docs.select(F.col(id_col).alias("id"), mark.alias("mark"), text.alias("text")).mapInArrow(run, schema)


class _Slice:
    """A slice's documents and, for words, pairs and triples, its sorted distinct keys and each token's place in them."""

    def __init__(self, row: dict):
        self.number = row["slice"]
        size, marks = _unpacked(row["rows"], (row["n_docs"], 4), (row["n_docs"], 1))
        self.size, self.marks = size.astype(np.int64), marks.astype(np.int64)
        (self.words,) = _unpacked(row["words"], (row["n_words"], 8))
        self.local = _unpacked(row["local"], (row["n_tokens"], 4))[0].astype(np.int32)
        self.starts = np.cumsum(self.size) - self.size

    def shifted(self, x: np.ndarray, at_start: int | np.uint64) -> np.ndarray:
        """What each token has one place before it in its document."""
        before = np.empty_like(x)
        before[1:] = x[:-1]
        before[self.starts] = at_start
        return before

    def per_token(self, by_doc: np.ndarray) -> np.ndarray:
        return np.repeat(by_doc, self.size)

    def kinds(self, key_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys and places of words, then pairs, then triples; one kind is held at a time."""
        shift = np.uint64(64 - key_bits)
        key = mix64(self.words)
        order = np.argsort(key)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        yield key[order], place[self.local]
        del key, order, place
        gram = self.words[self.local]
        before = self.shifted(gram, _START)
        gram = mix64(gram ^ mix64(before + np.uint64(1)))
        yield _ranked(gram >> shift)
        before = self.shifted(before, _START)
        gram = mix64(gram ^ mix64(before + np.uint64(2)))
        del before
        yield _ranked(gram >> shift)


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and each one's place in them."""
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    place = np.empty(len(key), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return key[new], place


def _bucket_edges(keys: np.ndarray, key_bits: int, buckets: int) -> list[tuple[int, int, int]]:
    """Bucket, first and end of each bucket's keys among sorted ones: equal ranges of the key space."""
    bucket = (keys >> np.uint64(key_bits - 32)) * np.uint64(buckets) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return list(zip(bucket[first].tolist(), first.tolist(), [*first[1:].tolist(), len(keys)], strict=True))


def _requests(table: DataFrame, key_bits: int, buckets: int) -> DataFrame:
    """``bucket, slice, kind, n, first, width, cells``: the keys of a slice in a bucket and its counts of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                some = _Slice(batch.slice(at, 1).to_pylist()[0])
                own, held = (some.per_token(some.marks & bit > 0) for bit in (1, 2))
                for kind, (keys, place) in enumerate(some.kinds(key_bits)):
                    n, m = np.bincount(place[own], minlength=len(keys)), np.bincount(place[held], minlength=len(keys))
                    steps = np.diff(keys, prepend=keys[:1])
                    rows = []
                    for bucket, a, b in _bucket_edges(keys, 64 if kind == 0 else key_bits, buckets):
                        width = max(1, (int(steps[a + 1 : b].max(initial=0)).bit_length() + 7) // 8)
                        step = steps[a:b].copy()
                        step[0] = 0
                        rows.append((bucket, some.number, kind, b - a, int(keys[a : a + 1].view(np.int64)[0]), width, _packed((step, width), (n[a:b], 4), (m[a:b], 4))))
                    for k in range(0, len(rows), 256):
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[k : k + 256], strict=True), types, strict=True)], names)

    names = ["bucket", "slice", "kind", "n", "first", "width", "cells"]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    return table.drop("ids").mapInArrow(run, "bucket int, slice bigint, kind int, n int, first bigint, width int, cells binary")


def _replies(requests: DataFrame) -> DataFrame:
    """``slice, kind, bucket, n, n_held, cells``: for each request the counts of its keys in all training
    documents and, for keys that the slice has in held-out documents, in those that are not held out.

    With ``kind`` -1 and a slice of its own, ``n`` is the number of distinct training words in a bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets: dict[int, list[dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                buckets.setdefault(row["bucket"], []).append(row)
        for bucket in list(buckets):
            asked, rows, words = buckets.pop(bucket), [], 0
            for kind in range(3):
                same = [r for r in asked if r["kind"] == kind]
                if not same:
                    continue
                cells = [_unpacked(r.pop("cells"), (r["n"], r["width"]), (r["n"], 4), (r["n"], 4)) for r in same]
                keys = np.concatenate([np.cumsum(step) + np.int64(r["first"]).astype(np.uint64) for r, (step, _, _) in zip(same, cells, strict=True)])
                all_, held = (np.concatenate([c[k].astype(np.uint32) for c in cells]) for k in (1, 2))
                del cells
                keys, place = _ranked(keys)
                all_sum, held_sum = (np.bincount(place, x, len(keys)).astype(np.int64) for x in (all_, held))
                words += int((all_sum > 0).sum()) if kind == 0 else 0
                at = 0
                for r in same:
                    own = place[at : at + r["n"]]
                    again = own[held[at : at + r["n"]] > 0]
                    rows.append((r["slice"], kind, bucket, r["n"], len(again), _packed((all_sum[own], 8), (all_sum[again] - held_sum[again], 8))))
                    at += r["n"]
            rows.append((-1 - bucket, -1, bucket, words, 0, b""))
            for k in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[k : k + 256], strict=True), types, strict=True)], names)

    names = ["slice", "kind", "bucket", "n", "n_held", "cells"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return requests.mapInArrow(run, "slice bigint, kind int, bucket int, n int, n_held int, cells binary")


def _counts(some: _Slice, replies: list[dict], key_bits: int, held: bool) -> list[np.ndarray]:
    """Counts of each token's word, pair and triple; with ``held`` those outside held-out documents, true
    only at the tokens of held-out documents."""
    out = []
    marks = some.per_token(some.marks & 2 > 0) if held else None
    for kind, (keys, place) in enumerate(some.kinds(key_bits)):
        own = sorted((r for r in replies if r["kind"] == kind), key=lambda r: r["bucket"])
        counts = np.concatenate([_unpacked(r["cells"], (r["n"], 8), (r["n_held"], 8))[int(held)].astype(np.int64) for r in own])
        if held:
            full = np.zeros(len(keys), np.int64)
            full[np.bincount(place[marks], minlength=len(keys)) > 0] = counts
            counts = full
        out.append(counts[place])
    return out


# --- the mixture


@dataclass(frozen=True)
class Mixture:
    """Training tokens, distinct words and documents, and ``weights[level][bucket of the history's count]``."""

    n: int
    v: int
    docs: int
    weights: list[np.ndarray]

    def estimates(self, level: int, counts: list[np.ndarray], histories: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bucket of the history, maximum-likelihood estimate and lower mixture of a level (0: words)."""
        lower = np.full(len(counts[0]), 1 / (self.v + 1))
        for k in range(level):
            bucket = _bucket(histories[k])
            weight = self.weights[k][bucket]
            lower = weight * counts[k] / np.maximum(histories[k], 1) + (1 - weight) * lower
        return _bucket(histories[level]), counts[level] / np.maximum(histories[level], 1), lower

    def probability(self, counts: list[np.ndarray], histories: list[np.ndarray]) -> np.ndarray:
        bucket, own, lower = self.estimates(2, counts, histories)
        weight = self.weights[2][bucket]
        return weight * own + (1 - weight) * lower


def _bucket(count: np.ndarray) -> np.ndarray:
    """0 for a history never seen, else 1 + the binary logarithm of its count."""
    return np.where(count > 0, 1 + np.log2(np.maximum(count, 1)).astype(np.int64), 0)


def ratio_bin(ratio: np.ndarray) -> np.ndarray:
    """0 for 0, else the rounded logarithm to the base 2 ** (1 / RATIO_STEPS)."""
    limit = RATIO_STEPS * RATIO_RANGE
    step = np.rint(np.log2(np.maximum(ratio, 1e-300)) * RATIO_STEPS)
    return np.where(ratio > 0, np.clip(step, -limit, limit) + limit + 1, 0).astype(np.int64)


def expectation_maximisation(events: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weight of the upper of two estimates for each history bucket.

    ``events[bucket, bin]`` counts held-out tokens by :func:`ratio_bin` of upper by lower estimate. A
    bucket without events has the weight of all events together (a half without any), bucket 0 has 0.
    """
    ratio = np.concatenate([[0.0], 2.0 ** (np.arange(-RATIO_STEPS * RATIO_RANGE, RATIO_STEPS * RATIO_RANGE + 1) / RATIO_STEPS)])

    def fit(rows: np.ndarray) -> np.ndarray:
        weight, size = np.full((len(rows), 1), 0.5), np.maximum(rows.sum(1, keepdims=True), 1)
        for _ in range(rounds):
            weight = (rows * (weight * ratio / (weight * ratio + 1 - weight))).sum(1, keepdims=True) / size
            weight = np.clip(weight, 0, MOST_WEIGHT)
        return weight[:, 0]

    seen = events[1:].sum(0, keepdims=True)
    weights = np.where(events.sum(1) > 0, fit(events), fit(seen)[0] if seen.sum() else 0.5)
    weights[0] = 0
    return weights


def _learned(events: DataFrame, v: int, n: int, docs: int) -> Mixture:
    """The mixture's weights, level by level, from held-out tokens that Spark counts by history and ratio.

    ``n`` and ``docs`` are those of the documents that are not held out. What the driver sees of a level
    is a table of COUNT_BUCKETS x RATIO_BINS counts, whatever the input.
    """
    weights: list[np.ndarray] = []
    for level in range(3):
        known = Mixture(n, v, docs, list(weights))

        def run(batches: Iterator[pa.RecordBatch], level: int = level, known: Mixture = known) -> Iterator[pa.RecordBatch]:
            found = np.zeros((COUNT_BUCKETS, RATIO_BINS), np.int64)
            for batch in batches:
                for row in batch.to_pylist():
                    c = [x.astype(np.int64) for x in _unpacked(row["cells"], *[(row["n"], 8)] * 5)]
                    bucket, own, lower = known.estimates(level, c[:3], [np.full(row["n"], n), *c[3:]])
                    np.add.at(found, (bucket, ratio_bin(own / lower)), 1)
            bucket, bin_ = np.nonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(bin_.astype(np.int32)), pa.array(found[bucket, bin_])], ["bucket", "bin", "n"])

        table = np.zeros((COUNT_BUCKETS, RATIO_BINS))
        summed = events.mapInArrow(run, "bucket int, bin int, n bigint").groupBy("bucket", "bin").agg(F.sum("n").alias("n"))
        for row in summed.collect():
            table[row.bucket, row.bin] = row.n
        weights.append(expectation_maximisation(table))
    return Mixture(n, v, docs, weights)


def _held_events(joined: DataFrame, key_bits: int, docs: int) -> DataFrame:
    """``n, cells``: for held-out tokens the counts of word, pair and triple and of the histories of pair
    and triple, without the held-out documents' own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                some = _Slice(row)
                held = some.per_token(some.marks & 2 > 0)
                counts = _counts(some, row["replies"], key_bits, True)
                columns = [x[held] for x in (*counts, *(some.shifted(x, docs) for x in counts[:2]))]
                yield pa.RecordBatch.from_arrays([pa.array([len(columns[0])], pa.int64()), pa.array([_packed(*((x, 8) for x in columns))], pa.binary())], ["n", "cells"])

    return joined.drop("ids").where("held_docs > 0").mapInArrow(run, "n bigint, cells binary")


def _scored(joined: DataFrame, key_bits: int, model: Mixture, id_type: str) -> DataFrame:
    """``id, n_tokens, n_known, base, score`` of each document of each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ids = batch.column("ids")[at].values
                row = batch.drop_columns("ids").slice(at, 1).to_pylist()[0]
                some = _Slice(row)
                counts = _counts(some, row.pop("replies"), key_bits, False)
                histories = [some.shifted(x, model.docs) for x in counts[:2]]
                log = np.empty(len(counts[0]))
                for k in range(0, len(log), SCORE_TOKENS):
                    part = slice(k, k + SCORE_TOKENS)
                    own = [x[part] for x in counts]
                    log[part] = np.log10(model.probability(own, [np.full(len(own[0]), model.n), *(x[part] for x in histories)]))
                sums = [np.add.reduceat(x, some.starts) for x in ((counts[0] > 0).astype(np.int64), np.log10(counts[0] + 1.0), log)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(some.size), *map(pa.array, sums)], ["id", "n_tokens", "n_known", "base", "score"])

    return joined.mapInArrow(run, f"id {id_type}, n_tokens bigint, n_known bigint, base double, score double")


def lm_scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", slice_tokens: int = SLICE_TOKENS, bucket_requests: int = BUCKET_REQUESTS) -> DataFrame:
    """``id, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Tokens are runs of bytes other than blanks, A-Z as a-z, then an end token; a null text counts as
    empty. ``base_score`` is the add-one unigram log10 probability, ``score`` that of the interpolated
    model. Counts are of all rows that ``train`` marks (null: not); without any, every word is unknown and
    ``score`` is 0. Every row counts and is scored by itself, rows that repeat id and text and null ids
    included; other columns are not read. Words are told apart by 64-bit hashes, pairs and triples by
    narrower ones that grow with the input (SPARE_BITS).

    A slice asks each bucket once, so buckets times slices blobs travel, at most one for each n-gram of a slice.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = docs.schema[id_col].dataType.simpleString()

    table = bucketed(_slices(docs, train, id_col, text_col, slice_tokens), "lm_slices", parts, "slice")
    totals = table.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_tokens", "train_docs", "train_tokens", "held_docs", "held_tokens"))).first()
    key_bits = min(64, max(32, SPARE_BITS + int(totals.n_tokens).bit_length()))
    buckets = int(totals.n_tokens * REQUESTS_A_TOKEN / bucket_requests) + 2
    asked = _requests(table, key_bits, buckets).repartitionById(buckets, F.col("bucket"))
    replies = bucketed(_replies(asked).repartition(parts, "slice"), "lm_replies", parts, "slice")
    v = replies.where("kind = -1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    grouped = replies.where("kind >= 0").groupBy("slice").agg(F.collect_list(F.struct("kind", "bucket", "n", "n_held", "cells")).alias("replies"))
    joined = table.join(grouped.hint("shuffle_hash"), "slice")
    left_n, left_docs = totals.train_tokens - totals.held_tokens, totals.train_docs - totals.held_docs
    events = written(_held_events(joined, key_bits, left_docs), "lm_events")
    weights = _learned(events, v, left_n, left_docs).weights
    scored = _scored(joined, key_bits, Mixture(totals.train_tokens, v, totals.train_docs, weights), id_type)
    smooth = float(np.log10(totals.train_tokens + v + 1))
    train_tokens = F.lit(totals.train_tokens).cast("bigint").alias("train_tokens")
    return scored.select(F.col("id").alias(id_col), "n_tokens", "n_known", train_tokens, (F.col("base") - F.col("n_tokens") * smooth).alias("base_score"), "score")
