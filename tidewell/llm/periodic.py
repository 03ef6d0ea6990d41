"""Periodic runs of words by block convolution at dyadic scales.

A run of period q with B <= q < 2B and at least three periods holds a whole block of B words that starts
at a multiple of B and stands again q words on. So at each scale B every aligned block is matched with
the window of starts B to 2B - 1 words behind it: the sum of squared differences of word numbers, from an
exact number-theoretic transform, is zero just where the block occurs. The distances found are seeds:
along each of them the equal stretches of the text are extended as far as they go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm._text import slices

#: Primes k * 2^m + 1 below 2^32 with a primitive root: fixed values.
PRIMES = ((2013265921, 31), (3221225473, 5), (2281701377, 3))
#: Numbers of a batch of transforms.
BATCH = 1 << 18

_ROOTS: dict[tuple[int, int, bool], list[np.ndarray]] = {}


def _roots(size: int, prime: int, root: int, inverse: bool) -> list[np.ndarray]:
    """For each half length, from the longest on, the powers of the root of unity of twice that length."""
    if (size, prime, inverse) not in _ROOTS:
        out, half = [], size // 2
        while half:
            w = pow(root, (prime - 1) // (2 * half), prime)
            w = pow(w, -1, prime) if inverse else w
            powers, n = np.ones(half, np.uint64), 1
            while n < half:
                powers[n : 2 * n] = powers[:n][: half - n] * np.uint64(pow(w, n, prime)) % np.uint64(prime)
                n *= 2
            out.append(powers)
            half //= 2
        _ROOTS[size, prime, inverse] = out
    return _ROOTS[size, prime, inverse]


def _spectrum(x: np.ndarray, prime: int, root: int) -> np.ndarray:
    """Transforms of the rows of x, in bit-reversed order."""
    p, rows, size = np.uint64(prime), len(x), x.shape[1]
    for w in _roots(size, prime, root, False):
        both = x.reshape(rows, -1, 2, len(w))
        a, b = both[:, :, 0], both[:, :, 1]
        x = np.stack([(a + b) % p, (a + (p - b)) % p * w % p], axis=2)
    return x.reshape(rows, size)


def _signal(x: np.ndarray, prime: int, root: int) -> np.ndarray:
    """Rows whose transforms, in bit-reversed order, are the rows of x."""
    p, rows, size = np.uint64(prime), len(x), x.shape[1]
    for w in reversed(_roots(size, prime, root, True)):
        both = x.reshape(rows, -1, 2, len(w))
        a, b = both[:, :, 0], both[:, :, 1] * w % p
        x = np.stack([(a + b) % p, (a + (p - b)) % p], axis=2)
    return x.reshape(rows, size) * np.uint64(pow(size, -1, prime)) % p


def occurrences(ids: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks and distances size <= d < 2 * size at which ids[start:start + size] stands again.

    ``ids`` are from 1 on. A difference is exact if the primes' product exceeds the largest sum possible.
    """
    need, most = [], 1
    for prime in PRIMES:
        if most <= size * int(ids.max()) ** 2:
            need.append(prime)
            most *= prime[0]
    padded = np.concatenate([ids, np.zeros(3 * size, ids.dtype)])
    blocks, distances = [], []
    for k in range(0, len(starts), max(1, BATCH // (2 * size))):
        at = starts[k : k + max(1, BATCH // (2 * size))]
        block = padded[at[:, None] + np.arange(size)].astype(np.uint64)
        window = padded[at[:, None] + np.arange(size, 3 * size)].astype(np.uint64)
        window[:, -1] = 0  # no start needs it
        zero = np.ones((len(at), size), bool)
        for prime, root in need:
            p = np.uint64(prime)
            reverse = np.zeros((len(at), 2 * size), np.uint64)
            reverse[:, :size] = block[:, ::-1]
            product = _signal(_spectrum(reverse, prime, root) * _spectrum(window % p, prime, root) % p, prime, root)[:, size - 1 : 2 * size - 1]
            squares = np.zeros((len(at), 2 * size + 1), np.uint64)
            np.cumsum(window * window % p, axis=1, out=squares[:, 1:])
            theirs = (squares[:, size : 2 * size] - squares[:, :size]) % p
            ours = (block * block % p).sum(axis=1) % p
            zero &= (ours[:, None] + theirs) % p == (product + product) % p
        row, d = np.nonzero(zero)
        blocks.append(at[row])
        distances.append(d + size)
    return np.concatenate(blocks), np.concatenate(distances)


def find_runs(ids: np.ndarray, least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """``start, length, period`` of all maximal runs of at least ``exponent`` periods and ``least`` words.

    ``ids`` are word numbers from 1 on. A block with a word that does not stand again within the window
    cannot occur there and is not convolved. A block inside a known run of period p <= B / 2 meets its
    copies at many distances, but a run of longer period that holds it maps the known run's start or end
    onto those of the run behind it, so only these distances are seeds. Thus a scale has a bounded number
    of seeds a block. Periods come in ascending order, so a stretch keeps the smallest of its periods.
    """
    n, found = len(ids), {}
    order = np.argsort(ids, kind="stable")
    again = np.full(n, n, np.int64)  # words until the same word comes again
    same = ids[order[1:]] == ids[order[:-1]]
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    worst, size = again, 1
    # of the run that covers a word and the words behind it longest: its start and end, and its period
    first, last, period = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    while exponent * size <= n and len(worst):
        starts = np.flatnonzero(worst < 2 * size) * size
        starts = starts[starts + 2 * size <= n]
        inside = (last[starts] >= starts + size) & (2 * period[starts] <= size)
        starts = starts[~(inside & (last[starts] >= np.minimum(starts + 3 * size - 1, n)))]
        if len(starts):
            block, d = occurrences(ids, starts, size)
            there = np.minimum(block + d, n - 1)
            inside = (last[block] >= block + size) & (2 * period[block] <= size)
            inside &= (last[there] >= there + size) & (period[there] == period[block])
            d = d[~inside | (first[there] - first[block] == d) | (last[there] - last[block] == d)]
            for q in np.unique(d).tolist():
                breaks = np.flatnonzero(ids[:-q] != ids[q:])
                begin, end = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [n - q]])
                long = np.flatnonzero(end - begin + q >= max(least, exponent * q))
                for s, e in zip(begin[long].tolist(), end[long].tolist(), strict=True):
                    if (s, e + q - s) not in found:
                        found[s, e + q - s] = q
                        newer = last[s : e + q] < e + q
                        for array, value in ((first, s), (last, e + q), (period, q)):
                            array[s : e + q][newer] = value
        size *= 2
        worst = np.maximum(worst[: len(worst) // 2 * 2 : 2], worst[1::2])
    return sorted((s, length, q) for (s, length), q in found.items())


def without_repeats(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Marks the words that stay: those that no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def periodic_runs(docs: DataFrame, least: int = 6, exponent: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of repeated word groups in each whole text, and the text without the repeats.

    Returns ``id_col, n_words long, runs array<struct<start, length, period: long>>`` in order of start and
    period, and ``collapsed string``: the words that stay, joined by one space; one row for each input row,
    other columns are not read. Words are the longest runs of bytes other than ASCII white space; places
    count from 0. A run is a stretch with smallest period q, of at least ``least`` words and ``exponent``
    (at least 3) periods, that cannot be extended. A null or empty text has no words. Repeated rows and
    null ids come back as they are; an empty table gives an empty table. No shuffle: a task looks at about
    1 MB of text at a time, at a longer text alone, with memory by its length.
    """
    if exponent < 3:
        raise ValueError("blocks find runs of at least three periods")
    kind = docs.schema[id_col].dataType.simpleString()
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            counts, found, texts = [], [], []
            for text in part.column("text"):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                number: dict[bytes, int] = {}
                ids = np.fromiter((number.setdefault(w, len(number) + 1) for w in words), np.int64, len(words))
                runs = find_runs(ids, least, exponent) if len(number) < len(words) else []
                if runs:
                    words = [words[k] for k in np.flatnonzero(without_repeats(len(ids), runs)).tolist()]
                counts.append(len(ids))
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                texts.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(counts, pa.int64()), pa.array(found, pa.list_(run_type)), pa.array(texts, pa.binary()).cast(pa.string())],
                ["id", "n_words", "runs", "collapsed"],
            )

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return out.mapInArrow(run, schema).withColumnRenamed("id", id_col)
