"""Token ids as packed blocks with Elias-Fano document boundaries.

The file format: a Parquet data set of blocks. A block has the ids of some documents, concatenated as
little-endian unsigned integers of the least width that holds the vocabulary (2 or 4 bytes), and the
documents' end offsets as an Elias-Fano code: ``low`` has the low bits of each offset packed, ``high``
the unary gaps of the rest, ``samples`` the place of every 64th one bit. :class:`Boundaries` selects an
offset from these without a table of 64-bit offsets: about 2 + log2(ids / documents) bits a document.
Blocks are numbered in ascending document order by (shard, block).
"""

from __future__ import annotations

import codecs
import json
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from tidewell.llm._text import slices

#: Ids in a block at most, if a single document has no more.
BLOCK_IDS = 1 << 21
#: Chunks between blanks in a worker's cache; beyond, it keeps only the short ones, which come again most.
CACHE_CHUNKS = 400_000
KEPT_BYTES = 9
#: Bytes of text whose chunks are made distinct together.
ENCODE_BYTES = 1 << 20
SAMPLE = 64
#: Signs that the library's pre-tokenizer parts from letters before them.
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())

BLOCKS = "shard int, block int, base bigint, n_docs int, n_tokens bigint, width int, doc_ids array<bigint>, ids binary, low_bits int, low binary, high binary, samples binary"

_POPULATION = np.array([bin(b).count("1") for b in range(256)], np.int64)
_LOADED: dict[tuple[str, int], ChunkEncoder] = {}


class Boundaries:
    """A non-decreasing sequence of offsets as Elias-Fano code."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits = n, low_bits
        self.low, self.high, self.samples = (np.frombuffer(x, t) for x, t in ((low, np.uint8), (high, np.uint8), (samples, "<u4")))

    @classmethod
    def of(cls, offsets: np.ndarray) -> Boundaries:
        offsets = np.asarray(offsets, np.int64)
        n, top = len(offsets), int(offsets[-1]) if len(offsets) else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        ones = (offsets >> low_bits) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        low = np.packbits(((offsets[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8).ravel(), bitorder="little")
        return cls(n, low_bits, low.tobytes(), np.packbits(bits, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def select(self, k: int) -> int:
        """The k-th offset: from the nearest sample on, whole bytes are skipped by their count of ones."""
        if not 0 <= k < self.n:
            raise IndexError(k)
        place = int(self.samples[k // SAMPLE])
        left, byte = k % SAMPLE, place >> 3
        word = int(self.high[byte]) >> (place & 7) << (place & 7)
        while (ones := int(_POPULATION[word])) <= left:
            left, byte = left - ones, byte + 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        one = 8 * byte + (word & -word).bit_length() - 1
        first = k * self.low_bits
        window = int.from_bytes(self.low[first >> 3 : (first + self.low_bits + 7) >> 3].tobytes(), "little")
        return ((one - k) << self.low_bits) | ((window >> (first & 7)) & ((1 << self.low_bits) - 1))


class ChunkEncoder:
    """Ids of chunks between blanks as the library encodes whole texts, for a tokenizer that drops white
    space, puts texts into normal form C and lower case, and has word ends.

    Most new chunks are words of letters in that form already, each a pre-token of its own: they go to the
    library's model at once, as one text in the byte alphabet, cut at the tokens that end a word. A chunk
    of such a word and ASCII punctuation after it is put together from both. All other chunks are encoded each
    by itself, and texts with one of the tokenizer's added tokens as a whole. ASCII letters are
    lower-cased up front.
    """

    def __init__(self, path: str, width: int):
        self.tokenizer = Tokenizer.from_file(path)
        self.width, self.kind = width, {2: "<u2", 4: "<u4"}[width]
        self.cache: dict[bytes, bytes] = {b"": b""}
        whole = json.loads(self.tokenizer.to_str())
        self.added = [x["content"].encode().lower() for x in whole["added_tokens"]]
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        vocab, end = whole["model"]["vocab"], whole["model"]["end_of_word_suffix"]
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(end)]] = True
        # the byte alphabet of byte-level tokenizers: printable bytes stand for themselves, others follow from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        table = [chr(b) if b in shown else "" for b in range(256)]
        for k, b in enumerate(b for b in range(256) if b not in shown):
            table[b] = chr(256 + k)
        table[32] = " "  # between words
        self.alphabet = "".join(table)

    def _words(self, words: list[bytes]) -> None:
        for k in range(0, len(words), 4096):
            part = words[k : k + 4096]
            text, _ = codecs.charmap_decode(b" ".join(part), "strict", self.alphabet)
            ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part):  # a word that is more than one pre-token
                self._others(part)
                continue
            flat, stops = ids.tobytes(), (self.width * stops).tolist()
            self.cache.update(zip(part, [flat[a:b] for a, b in zip([0, *stops], stops, strict=False)], strict=True))

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(found.ids, self.kind).tobytes() for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _others(self, chunks: list[bytes]) -> None:
        if not chunks:
            return
        self.cache.update(zip(chunks, self._whole([c.decode() for c in chunks]), strict=True))

    def learn(self, chunks: set[bytes]) -> None:
        cache = self.cache
        words = [c for c in chunks if c.isalpha()]
        joint, others = {}, set()
        for c in chunks.difference(words):
            stem = c.rstrip(MARKS)
            if stem.isalpha() or (stem and _is_plain(stem.decode())):
                joint[c] = stem
                others.add(c[len(stem) :])
            else:
                others.add(c)
        words += set(joint.values())
        self._words(list(filterfalse(cache.__contains__, dict.fromkeys(words))))
        self._others(list(filterfalse(cache.__contains__, others)))
        cache.update({c: cache[x] + cache[c[len(x) :]] for c, x in joint.items()})

    def encode(self, texts: list[str | None], end: bytes) -> list[bytes]:
        lower = [t.encode().lower() if t else b"" for t in texts]
        special = [k for k, t in enumerate(lower) if any(x in t for x in self.added)]
        whole = dict(zip(special, self._whole([texts[k] for k in special]), strict=True))
        chunks = [t.replace(b"\n", b" ").split(b" ") if t and k not in whole else [] for k, t in enumerate(lower)]
        if len(self.cache) > CACHE_CHUNKS:
            short = {c: ids for c, ids in self.cache.items() if len(c) <= KEPT_BYTES}
            self.cache = short if len(short) < CACHE_CHUNKS // 2 else {b"": b""}
        new = set(filterfalse(self.cache.__contains__, chain.from_iterable(chunks)))
        self.learn(new)
        ids = [b"".join([whole.get(k, b""), *map(self.cache.__getitem__, x), end]) for k, x in enumerate(chunks)]
        for chunk in [x for x in new if len(x) > 64]:  # long chunks hardly come again
            del self.cache[chunk]
        return ids


def _is_plain(word: str) -> bool:
    """Letters only, in normal form C and lower case, so that the tokenizer's normaliser leaves them as they are."""
    return word.isalpha() and word == word.lower() and unicodedata.is_normalized("NFC", word)


def shard_bounds(docs: DataFrame, shards: int, id_col: str = "doc_id") -> list[float]:
    """Ids that cut the documents into about equal shards: quantiles, from the id column alone."""
    known = docs.select(F.col(id_col).alias("id")).where("id is not null")
    return sorted(set(known.approxQuantile("id", [k / shards for k in range(1, shards)], 0.2 / shards)))


def encode_ids(docs: DataFrame, tokenizer_path: str, end_id: int, bounds: list[float], width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, shard, n_tokens, ids binary`` (ids of ``width`` bytes) of whole texts, each with ``end_id`` appended.

    For tokenizers that drop white space before their merges: the library encodes each distinct chunk
    between blanks or line ends once, and the chunks' ids are joined. Ids are those of the library's call
    with ``add_special_tokens=False``: a string of an added token in a text becomes that token. A null text
    counts as empty. A null id stays null; rows that repeat an id are encoded each.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (tokenizer_path, width) not in _LOADED:
            _LOADED[tokenizer_path, width] = ChunkEncoder(tokenizer_path, width)
        encoder = _LOADED[tokenizer_path, width]
        end = np.array([end_id], encoder.kind).tobytes()
        for part in slices(batches, limit=ENCODE_BYTES):
            ids = encoder.encode(part.column("text").to_pylist(), end)
            shard = np.searchsorted(cuts, part.column("id").fill_null(-(1 << 63)).to_numpy(zero_copy_only=False).astype(float), side="right")
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(shard, pa.int32()), pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["id", "shard", "n_tokens", "ids"])

    cuts = np.array(bounds, float)
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, shard int, n_tokens bigint, ids binary")


def write_blocks(encoded: DataFrame, path: str, shards: int, width: int = 2) -> None:
    """Writes ``id, shard, n_tokens, ids`` in ascending id order (null first) as blocks under ``path``.

    The tokens move once, straight to their shard, where a sort within the partition streams them into
    blocks. Rows that share an id go to the same shard, in order of a hash of their ids. An empty table
    gives a readable folder without blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, base, block, at = [], 0, 0, 0, 0

        def made() -> pa.RecordBatch:
            code = Boundaries.of(np.cumsum([n for _, n, _ in held]))
            row = [at, block, base, len(held), total, width, [x for x, _, _ in held], b"".join(x for _, _, x in held), code.low_bits, code.low.tobytes(), code.high.tobytes(), code.samples.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), None, pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        names = [x.split()[0] for x in BLOCKS.split(", ")]
        for batch in batches:
            types[6] = pa.list_(batch.schema.field("id").type)
            for at, x, n, ids in zip(*(batch.column(c).to_pylist() for c in ("shard", "id", "n_tokens", "ids")), strict=True):
                if held and total + n > BLOCK_IDS:
                    yield made()
                    held, base, block, total = [], base + total, block + 1, 0
                held.append((x, n, ids))
                total += n
        if held:
            yield made()

    placed = encoded.repartitionById(shards, F.col("shard")).sortWithinPartitions("id", F.xxhash64("ids"))
    placed.mapInArrow(run, BLOCKS).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_blocks(spark: SparkSession, path: str, id_col: str = "doc_id", ids: bool = True) -> DataFrame:
    """One row a document from the files: ``id_col, start, n_tokens, ids binary (32-bit), ids_crc32``; without ``ids`` if so asked.

    Only shard totals are added up across shards: as many rows as there are shards. A null id comes back
    null, a repeated one once for each row that was written, a folder without blocks as no rows.
    """
    blocks = spark.read.parquet(path)
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    starts = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("shard_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                ends = Boundaries(row["n_docs"], row["low_bits"], row["low"], row["high"], row["samples"])
                starts, sizes, sums, held, first = [], [], [], [], 0
                data = np.frombuffer(row["ids"], {2: "<u2", 4: "<u4"}[row["width"]])
                for k in range(row["n_docs"]):
                    last = ends.select(k)
                    own = data[first:last].astype("<u4").tobytes()
                    starts.append(row["shard_start"] + row["base"] + first)
                    sizes.append(last - first)
                    sums.append(zlib.crc32(own))
                    if ids:
                        held.append(own)
                    first = last
                columns = [batch.column("doc_ids")[at].values, *(pa.array(x, pa.int64()) for x in (starts, sizes, sums))]
                columns += [pa.array(held, pa.binary())] if ids else []
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["id", "start", "n_tokens", "ids_crc32", *["ids"] * ids]
    rows = blocks.join(F.broadcast(starts), "shard").mapInArrow(run, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * ids)
    return rows.withColumnRenamed("id", id_col)
