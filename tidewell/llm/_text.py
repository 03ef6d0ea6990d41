"""Small helpers for the tasks of this subpackage: bounded slices of Arrow batches, word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a task looks at together; a longer document is looked at alone.
SLICE_BYTES = 1 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_SEP = np.ones(256, dtype=bool)
_LOWER = np.arange(256, dtype=np.uint8)
for _c in range(256):
    if 48 <= _c <= 57 or 97 <= _c <= 122 or 65 <= _c <= 90 or _c >= 128:
        _SEP[_c] = False
    if 65 <= _c <= 90:
        _LOWER[_c] = _c + 32


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each piece holds at most ``limit`` bytes of text or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, ends = text_bytes(batch.column(text))
        start = 0
        while start < batch.num_rows:
            base = ends[start]
            stop = int(np.searchsorted(ends, base + limit, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty), and row offsets into them; no copy."""
    column = column.cast(pa.string()) if not pa.types.is_string(column.type) else column
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, SLICE_BYTES + 65536)
        inverse = np.uint64(pow(int(_MULT), -1, 1 << 64))
        up, down = np.full(size, _MULT, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        _POWERS["up"], _POWERS["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each data[start:stop], from prefix sums."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix64((sums[stops] - sums[starts]) * down[starts])


def word_spans(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, stops and rows of the words: longest runs of bytes that ``sep`` does not mark; none crosses a row."""
    word = ~sep[data]
    starts_here = word.copy()
    starts_here[1:] &= ~word[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    starts_here[inner] = word[inner]
    ends_here = word.copy()
    ends_here[:-1] &= ~word[1:]
    ends_here[inner - 1] = word[inner - 1]
    starts, stops = np.flatnonzero(starts_here), np.flatnonzero(ends_here) + 1
    return starts, stops, np.searchsorted(offsets, starts, side="right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word; letters A-Z count as a-z, other ASCII signs separate words."""
    starts, stops, rows = word_spans(data, offsets)
    return span_hashes(_LOWER[data], starts, stops), rows


def shingles(hashes: np.ndarray, rows: np.ndarray, k: int, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of k words; a row with fewer words has one run of all of them."""
    n = len(hashes)
    if not n:
        return hashes, rows
    out = hashes.copy()
    per_row = np.bincount(rows, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(per_row)])
    place = np.arange(n) - first[rows]
    left = per_row[rows] - place
    for j in range(1, k):
        ok = np.flatnonzero(left > j)
        out[ok] = mix64(out[ok] * np.uint64(0x9E3779B97F4A7C15) + hashes[ok + j])
    whole = (left >= k) | (place == 0)
    return out[whole], rows[whole]
