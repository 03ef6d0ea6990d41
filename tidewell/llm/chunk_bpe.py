"""BPE encoding by content-defined chunks: shared chunks are encoded once, joins are repaired until they agree.

A rolling hash over the last sixteen bytes cuts texts where its low bits are zero, so equal passages get
equal chunks wherever they stand. Spark counts the chunks of the corpus; the most frequent are encoded
once, in a stage of their own, and go to all tasks as a table of bounded size; every other chunk is
encoded where it is met and kept in a bounded cache. A chunk's ids are those of the chunk alone. They
are wrong near its ends, as the split pattern sees text on both sides of a cut; there a window of text
is encoded again, from a split before the cut that cannot depend on it, until one of its splits falls
on a split of a following chunk. From such a place on both scans of the text are the same, so the
chunk's ids hold.
"""

from __future__ import annotations

import json
import os
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm._text import slices, span_hashes, text_bytes

#: Bytes of a chunk at least, and the low bits of the rolling hash that are zero at a cut.
LEAST, BITS = 128, 10
#: Bytes of text in the table of shared chunks at most; it goes to every task.
TABLE_BYTES = 8 << 20
#: Chunks, and windows at joins, in each of the two generations of a worker's cache.
CACHE = 8_000
#: Bytes by which the end of a text may change the splits before it: a split is decided at most three characters on.
LOOK = 16
#: Pieces between splits that a worker keeps, and their characters at most.
PIECES, PIECE = 400_000, 64
#: The split pattern of byte-level tokenizer files: a fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes after a cut that the first window takes in.
WINDOW = 40

_GEAR = (np.random.default_rng(12).integers(0, 1 << 32, 256, np.uint64)).astype(np.uint32)
_LOADED: dict[str, ChunkBpe] = {}


def cuts(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """For each text data[offsets[k]:offsets[k + 1]] the places, from its start, where its chunks begin.

    They lie at character starts, at least ``LEAST`` bytes apart, and depend on the sixteen bytes before them.
    """
    h = _GEAR[data]
    for step in (1, 2, 4, 8):
        if len(h) > step:
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    # entry i covers bytes up to i; a cut stands after it, before a byte that starts a character
    low = np.flatnonzero((h[:-1] >> np.uint32(32 - BITS) == 0) & (data[1:] & 0xC0 != 0x80)) + 1 if len(h) else np.zeros(0, np.int64)
    bounds = np.searchsorted(low, offsets).tolist()
    starts, low, out = offsets.tolist(), low.tolist(), []
    for k in range(len(starts) - 1):
        begin, end = starts[k], starts[k + 1]
        mine, last = [0], begin
        for x in low[bounds[k] : bounds[k + 1]]:
            if x - last >= LEAST and end - x >= LEAST:
                mine.append(x - begin)
                last = x
        out.append(mine)
    return out


class Encoded:
    """Ids of a text on its own as little-endian 32-bit integers; its splits by the bytes of text and of ids before them."""

    __slots__ = ("ids", "places", "splits")

    def __init__(self, ids: bytes, splits: Iterable[int], places: Iterable[int]):
        self.ids, self.splits, self.places = ids, array("I", splits), array("I", places)

    def part(self, start: int, stop: int | None = None) -> bytes:
        """Ids between two splits, given by their numbers."""
        return self.ids[self.places[start] : None if stop is None else self.places[stop]]


class ChunkBpe:
    """A tokenizer file with byte-level splits; added tokens are found first, as the library does."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            added = json.load(file)["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError("only added tokens that match as they stand are known")
        self.added = {t["content"]: t["id"] for t in added}
        # the byte-level alphabet: printable Latin-1 signs stand for themselves, the other bytes for signs from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        alphabet = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, k in vocab.items():
            self.bytes[k] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self.split = regex.compile(SPLIT)
        self.odd = self._odd_characters()
        self.pieces: dict[str, bytes] = {}
        self.shared: dict[bytes, Encoded] = {}
        self.young: dict[bytes, Encoded] = {}
        self.old: dict[bytes, Encoded] = {}

    def _odd_characters(self) -> regex.Pattern:
        """Matches characters that the library's pattern does not class as the same pattern does here, and all beyond the first plane."""
        chars = [chr(c) for c in range(0x10000) if not 0xD800 <= c <= 0xDFFF]
        odd = set()
        for before in "a1!":
            text = "".join(f"\n{before}{c}" for c in chars)
            here = {m.start() for m in self.split.finditer(text)}
            there = {start for _, (start, _) in self.library.pre_tokenizer.pre_tokenize_str(text)}
            odd |= {c for k, c in enumerate(chars) if (3 * k + 2 in here) != (3 * k + 2 in there)}
        return regex.compile("[\U00010000-\U0010ffff" + "".join(map(regex.escape, sorted(odd))) + "]")

    def _learn_pieces(self, new: list[str]) -> None:
        """Ids of pieces from the library; words after a space go as one text, which it splits before each space."""
        words = [p for p in new if p[0] == " " and p[1:].isalpha()]
        for k in range(0, len(words), 2000):
            part = words[k : k + 2000]
            e = self.library.encode("".join(part), add_special_tokens=False)
            ids, number = np.array(e.ids, "<u4"), np.array(e.word_ids, np.int64)
            ends = np.flatnonzero(np.append(number[1:] != number[:-1], True)) + 1
            if np.array_equal(np.cumsum(self.length[ids])[ends - 1], list(accumulate(len(p.encode()) for p in part))):
                raw = ids.tobytes()
                self.pieces.update(zip(part, (raw[4 * i : 4 * j] for i, j in zip([0, *ends.tolist()], ends.tolist(), strict=False)), strict=True))
        rest = [p for p in new if p not in self.pieces]
        for k in range(0, len(rest), 2000):
            part = rest[k : k + 2000]
            self.pieces.update((p, array("I", e.ids).tobytes()) for p, e in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False), strict=True))

    def alone(self, texts: list[bytes]) -> list[Encoded]:
        """Each text, free of added tokens, encoded by itself: split here, each new piece's ids from the library."""
        plain = [t.decode() for t in texts]
        found = [None if not t.isascii() and self.odd.search(t) else self.split.findall(t) for t in plain]
        if len(self.pieces) > PIECES:
            self.pieces.clear()
        new = [p for p in set().union(*filter(None, found)) if p not in self.pieces]
        self._learn_pieces(new)
        out = []
        for text, f in zip(plain, found, strict=True):
            if f is not None:
                ids = list(map(self.pieces.__getitem__, f))
                size = map(len, f) if text.isascii() else map(len, map(str.encode, f))
                out.append(Encoded(b"".join(ids), accumulate(size, initial=0), accumulate(map(len, ids), initial=0)))
                continue
            e = self.library.encode(text, add_special_tokens=False)
            ids, words = np.array(e.ids, "<u4"), np.array(e.word_ids, np.int64)
            tokens = np.concatenate([[0], np.flatnonzero(words[1:] != words[:-1]) + 1, [len(ids)]])
            out.append(Encoded(ids.tobytes(), np.concatenate([[0], np.cumsum(self.length[ids])])[tokens].tolist(), (4 * tokens).tolist()))
        for piece in new:  # long pieces hardly come again
            if len(piece) > PIECE:
                del self.pieces[piece]
        return out

    def known(self, text: bytes) -> Encoded | None:
        got = self.shared.get(text) or self.young.get(text)
        if got is None and (got := self.old.get(text)):
            self.young[text] = got
        return got

    def learn(self, texts: set[bytes]) -> None:
        new = [t for t in texts if not self.known(t)]
        for k in range(0, len(new), 500):
            part = new[k : k + 500]
            self.young.update(zip(part, self.alone(part), strict=True))

    def rest(self) -> None:
        """Between slices: the older generation of the cache goes when the younger is full."""
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}

    def anchor(self, e: Encoded, size: int, least: int) -> int:
        """Number of the last split that text after the chunk cannot change; ``least`` if there is none after it."""
        return max(least, bisect_right(e.splits, size - LOOK) - 1)

    def window(self, text: bytes, start: int, stop: int) -> bytes:
        while stop < len(text) and text[stop] & 0xC0 == 0x80:
            stop += 1
        return text[start:stop]

    def join(self, text: bytes, starts: list[int]) -> list[bytes]:
        """Ids of a text from those of its chunks, in pieces; the chunks must be known."""
        chunks = [self.known(text[a:b]) for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]
        out, k, split = [], 0, 0
        while k + 1 < len(chunks):
            here, base = chunks[k], starts[k]
            last = self.anchor(here, starts[k + 1] - base, split)
            out.append(here.part(split, last))
            begin, ahead, found = base + here.splits[last], WINDOW, None
            while found is None:
                piece = self.window(text, begin, starts[k + 1] + ahead)
                again = self.known(piece)
                if again is None:
                    again = self.alone([piece])[0]
                whole = begin + len(piece) == len(text)
                found = self.agreement(again, begin, len(piece) if whole else len(piece) - LOOK, starts, chunks, k)
                if found is None:
                    if whole:
                        out.append(again.ids)
                        return out
                    ahead *= 2
            stop, k, split = found
            out.append(again.part(0, stop))
        out.append(chunks[k].part(split))
        return out

    def agreement(self, again: Encoded, begin: int, sure: int, starts: list[int], chunks: list[Encoded], k: int) -> tuple[int, int, int] | None:
        """The first split of a window, chunk and split of the chunk that fall together behind the cut after chunk k."""
        for n in range(bisect_left(again.splits, starts[k + 1] - begin), len(again.splits)):
            if again.splits[n] > sure:
                return None
            at = begin + again.splits[n]
            j = bisect_right(starts, at) - 1
            splits, place = chunks[j].splits, at - starts[j]
            found = bisect_left(splits, place)
            if found < len(splits) and splits[found] == place:
                return n, j, found
        return None

    def encode(self, column: pa.Array) -> list[bytes]:
        """Ids of the texts of a string column, as little-endian unsigned 32-bit integers."""
        texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in column.cast(pa.binary())]
        pieces: list[list[bytes | int]] = [[t] if t else [] for t in texts]
        for token, number in self.added.items():
            if token_bytes := token.encode():
                for row in (k for k, t in enumerate(texts) if token_bytes in t):
                    split = []
                    for p in pieces[row]:
                        parts = p.split(token_bytes) if isinstance(p, bytes) else [p]
                        split += [x for part in parts for x in (number, part)][1:]
                    pieces[row] = split
        plain = [p for row in pieces for p in row if isinstance(p, bytes)]
        offsets = np.cumsum([0, *map(len, plain)])
        found = cuts(np.frombuffer(b"".join(plain), np.uint8), offsets)
        self.learn({p[a:b] for p, starts in zip(plain, found, strict=True) for a, b in zip(starts, [*starts[1:], len(p)], strict=True)})
        likely = set()  # the windows at joins, as they are unless chunks are odd
        for p, starts in zip(plain, found, strict=True):
            for a, b in zip(starts, starts[1:], strict=False):
                e = self.known(p[a:b])
                likely.add(self.window(p, a + e.splits[self.anchor(e, b - a, 0)], b + WINDOW))
        self.learn(likely)
        cut, out = iter(found), []
        for row in pieces:
            parts = []
            for p in row:
                parts += self.join(p, next(cut)) if isinstance(p, bytes) else [p.to_bytes(4, "little")]
            out.append(b"".join(parts))
        self.rest()
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids, added tokens included."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def load(path: str) -> ChunkBpe:
    """One encoder for each worker process."""
    if path not in _LOADED:
        _LOADED[path] = ChunkBpe(path)
    return _LOADED[path]


def _chunk_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and stops of all chunks of some texts."""
    parts = [np.array(mine, np.int64) + start for mine, start in zip(cuts(data, offsets), offsets.tolist(), strict=False) if start >= 0]
    starts = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    stops = np.concatenate([starts[1:], offsets[-1:]]) if len(starts) else starts
    keep = stops > starts
    starts, stops = starts[keep], stops[keep]
    return span_hashes(data, starts, stops).view(np.int64), starts, stops


def shared_chunks(texts: DataFrame, path: str, table_bytes: int = TABLE_BYTES) -> list[tuple[bytes, bytes, bytes, bytes]]:
    """The most frequent chunks of column ``text`` that occur at least twice, each encoded once.

    Counts take in every chunk of every text; those that save most bytes come first, until the table's
    bound. Two scans, and shuffles of a hash and a count a chunk and of the chosen chunks.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            data, offsets = text_bytes(part.column("text"))
            h, starts, stops = _chunk_hashes(data, offsets)
            one, first, n = np.unique(h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(n), pa.array((stops - starts)[first])], ["hash", "n", "size"])

    counts = texts.mapInArrow(counted, "hash bigint, n bigint, size bigint").groupBy("hash").agg(F.sum("n").alias("n"), F.max("size").alias("size"))
    gain = (F.col("n") - 1) * F.col("size")
    best = counts.where("n > 1").orderBy(gain.desc(), "hash").limit(table_bytes // LEAST).collect()
    room, chosen = table_bytes, set()
    for row in best:
        if row["size"] <= room:
            room -= row["size"]
            chosen.add(row["hash"])
    if not chosen:
        return []
    wanted = np.array(sorted(chosen), np.int64)

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in slices(batches):
            data, offsets = text_bytes(part.column("text"))
            h, starts, stops = _chunk_hashes(data, offsets)
            at = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h)
            rows = [(x, data[starts[k] : stops[k]].tobytes()) for k, x in zip(at.tolist(), h[at].tolist(), strict=True) if not (x in seen or seen.add(x))]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.binary())], ["hash", "chunk"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            chunks = [c for c in batch.column("chunk").to_pylist() if not any(t.encode() in c for t in bpe.added)]
            made = bpe.alone(chunks)
            columns = [chunks, [e.ids for e in made], [e.splits.tobytes() for e in made], [e.places.tobytes() for e in made]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["chunk", "ids", "splits", "places"])

    one = texts.mapInArrow(picked, "hash bigint, chunk binary").groupBy("hash").agg(F.min("chunk").alias("chunk"))
    return [tuple(map(bytes, r)) for r in one.select("chunk").mapInArrow(encoded, "chunk binary, ids binary, splits binary, places binary").collect()]


def chunk_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Encodes whole texts as the tokenizer file's library does without special tokens around them, and decodes the ids.

    Returns ``id_col, n_tokens long, ids binary (little-endian unsigned 32-bit), decoded string``, one row
    for each input row; other columns are not read. An added token's string in a text becomes that token.
    A null or empty text has no ids and decodes to an empty text. Repeated rows and null ids come back as
    they are; an empty table gives an empty table. A very long text is looked at alone, with memory by its
    length. The table of shared chunks is bounded and may lose nothing but speed.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    table = rows.sparkSession.sparkContext.broadcast(shared_chunks(rows.select("text"), path, table_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        bpe.shared = {}
        for chunk, ids, *places in table.value:
            bpe.shared[chunk] = Encoded(ids, *(array("I", p) for p in places))
        for part in slices(batches):
            ids = bpe.encode(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.string())],
                ["id", "n_tokens", "ids", "decoded"],
            )

    return rows.mapInArrow(run, f"id {kind}, n_tokens bigint, ids binary, decoded string").withColumnRenamed("id", id_col)
