"""Byte-level BPE by a vectorised forest of segment trees.

Each pre-token is a row of leaves, one a byte. A leaf holds the rank of the pair that starts there,
inner nodes hold the leftmost minimum, so a root names the next merge. A merge changes three leaves
(the pair, its left and its right live neighbour), each a logarithmic path of node updates. Rows of
one size class are merged together with numpy; pieces seen before come from a bounded cache.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm._text import slices

#: Pieces kept in a worker's cache at most; then it starts afresh.
CACHE_PIECES = 400_000
#: Nodes of one forest at most.
FOREST_NODES = 1 << 18
#: Bytes from which a piece has a tree of its own.
LONG_PIECE = 128

_LOADED: dict[tuple[str, str], Bpe] = {}
_INF = 1 << 62
_NONE = np.int64(_INF)


class Bpe:
    """Ranks of a tiktoken file and the split pattern; encodes pieces, texts and decodes ids."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.width = max(ranks.values()) + 1
        self.bytes = {b: a for a, b in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.width + right] = rank
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        # an open-addressed table of the same pairs: most look-ups end at the first slot
        self.slots = 1 << (4 * len(pairs)).bit_length()
        self.table = np.full(self.slots, -1, np.int64)
        self.values = np.full(self.slots, -1, np.int64)
        todo, value, step = self.pair_keys, self.pair_ranks, 0
        while len(todo):
            slot = (self._slot(todo) + step) & (self.slots - 1)
            free = np.flatnonzero(self.table[slot] < 0)
            free = free[np.unique(slot[free], return_index=True)[1]]
            self.table[slot[free]], self.values[slot[free]] = todo[free], value[free]
            keep = np.ones(len(todo), bool)
            keep[free] = False
            todo, value, step = todo[keep], value[keep], step + 1
        self.probes = step
        self.cache: dict[str, bytes] = {}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64) & (self.slots - 1)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, -1 for none or if an id is -1."""
        keys = left.astype(np.int64) * self.width + right
        keys[(left < 0) | (right < 0)] = _INF
        first = self._slot(keys)
        got = self.table[first]
        out = np.where(got == keys, self.values[first], -1)
        more, step = np.flatnonzero((got >= 0) & (got != keys)), 1
        while len(more) and step < self.probes:
            slot = (first[more] + step) & (self.slots - 1)
            got = self.table[slot]
            hit = got == keys[more]
            out[more[hit]] = self.values[slot[hit]]
            more, step = more[(got >= 0) & ~hit], step + 1
        return out

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece; the pieces together make one forest, its arrays laid out flat."""
        size = 2
        while size < max(map(len, pieces)):
            size *= 2
        n, bits, wide = len(pieces), size.bit_length(), size + 1
        held = np.arange(wide) < np.array([len(p) for p in pieces])[:, None]
        token = np.full(n * wide, -1, np.int32)
        token[held.ravel()] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.tile(np.minimum(np.arange(1, size + 2, dtype=np.int32), size), n)
        before = np.tile(np.concatenate([[size], np.arange(size)]).astype(np.int32), n)

        def leaf(rank: np.ndarray, place: np.ndarray) -> np.ndarray:
            return np.where(rank >= 0, (rank << bits) | place, _NONE)

        grid = token.reshape(n, wide)
        tree = np.full((n, 2 * size), _NONE, np.int64)
        tree[:, size:] = leaf(self._rank(grid[:, :size].ravel(), grid[:, 1:].ravel()).reshape(n, size), np.arange(size))
        level = size // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        tree = tree.ravel()

        rows = np.flatnonzero(tree[1 :: 2 * size] < _NONE)
        low = (1 << bits) - 1
        while len(rows):
            base, top = rows * wide, rows * (2 * size)
            root = tree[top + 1]
            at, rank = root & low, root >> bits
            gone = after[base + at]
            right, left = after[base + gone], before[base + at]
            token[base + at], token[base + gone] = rank, -1
            after[base + at], before[base + right] = right, at
            values = leaf(self._rank(np.concatenate([rank, token[base + left]]), np.concatenate([token[base + right], rank])), np.concatenate([at, left]))
            tree[top + size + gone] = _NONE
            tree[top + size + at] = values[: len(rows)]
            has = left < size
            tree[(top + size + left)[has]] = values[len(rows) :][has]
            nodes = [gone + size, at + size, np.where(has, left, at) + size]
            for _ in range(bits - 1):  # children of all three paths are done before their parents
                nodes = [x >> 1 for x in nodes]
                for x in nodes:
                    here = top + x
                    tree[here] = np.minimum(tree[here + x], tree[here + x + 1])
            rows = rows[tree[top + 1] < _NONE]
        alive = token >= 0
        flat, ends = token[alive].astype("<u4").tobytes(), (4 * np.cumsum(alive.reshape(n, wide).sum(1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def merge_long(self, piece: bytes) -> bytes:
        """The same tree for a single long piece, on plain lists."""
        n, size = len(piece), 1 << (len(piece) - 1).bit_length()
        token = [*self.byte_ids[np.frombuffer(piece, np.uint8)].tolist(), -1]
        after, before = [*range(1, n + 1), n], [n, *range(n)]
        ranks, width, bits = self.pairs, self.width, size.bit_length()
        tree = [_INF] * (2 * size)
        for i in range(n - 1):
            rank = ranks.get(token[i] * width + token[i + 1])
            if rank is not None:
                tree[size + i] = rank << bits | i
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        while tree[1] < _INF:
            at, rank = tree[1] & ((1 << bits) - 1), tree[1] >> bits
            gone = after[at]
            right, left = after[gone], before[at]
            token[at], token[gone], after[at], before[right] = rank, -1, right, at
            for place, pair in ((gone, -1), (at, rank * width + token[right] if right < n else -1), (left, token[left] * width + rank if left < n else -1)):
                if place < n:
                    found, node = ranks.get(pair), (place + size) >> 1
                    tree[place + size] = _INF if found is None else found << bits | place
                    while node:
                        least = min(tree[2 * node], tree[2 * node + 1])
                        if tree[node] == least:
                            break
                        tree[node] = least
                        node >>= 1
        return np.array([t for t in token if t >= 0], "<u4").tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Puts the ids of pieces into the cache as little-endian 32-bit integers."""
        todo: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                self.cache[piece] = rank.to_bytes(4, "little")
            elif len(raw) > LONG_PIECE:
                self.cache[piece] = self.merge_long(raw)
            else:
                todo.setdefault((len(raw) - 1).bit_length(), []).append((piece, raw))
        for bits, same in todo.items():
            step = max(1, FOREST_NODES >> (bits + 1))
            for k in range(0, len(same), step):
                part = same[k : k + step]
                self.cache.update(zip((piece for piece, _ in part), self.merge([raw for _, raw in part]), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        found = [self.pattern.findall(t) if t else [] for t in texts]
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        new = set().union(*found) - self.cache.keys()
        self.learn(new)
        out = [b"".join(map(self.cache.__getitem__, pieces)) for pieces in found]
        for piece in [p for p in new if len(p) > 64]:  # long pieces hardly come again
            del self.cache[piece]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def load(path: str, pattern: str) -> Bpe:
    """One encoder for each worker process."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Bpe(path, pattern)
    return _LOADED[path, pattern]


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes whole texts with a rank file and decodes the ids again.

    Returns ``id_col, n_tokens long, ids binary (little-endian unsigned 32-bit), decoded binary``, one
    row for each input row; other columns are not read. A null or empty text has no ids. Repeated rows
    and null ids come back as they are; an empty table gives an empty table. ``pattern`` decides what
    is encoded: bytes outside its matches would be lost, and the usual patterns match everything.
    No shuffle: each task keeps a bounded piece cache and looks at about 1 MB of text at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks_path, pattern)
        for part in slices(batches):
            ids = bpe.encode(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.binary())],
                ["id", "n_tokens", "ids", "decoded"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens bigint, ids binary, decoded binary")
    return out.withColumnRenamed("id", id_col)


def bpe_digest(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256`` of what :func:`bpe_encode` returns."""
    return encoded.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
