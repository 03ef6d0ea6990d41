"""Language identification by string kernels.

The kernel of two texts is the number of byte n-grams (n = 1, 2, 3 blended) of a fitted alphabet that both
hold, presence only, over the root of the product of their own numbers of them. Nystroem landmarks give a finite feature map,
one-versus-rest kernel ridge regression is solved on it, and since all of it is linear in the presence
vectors the model folds into one matrix, n-grams by languages: scoring is a batched matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm._text import slices, text_bytes

_LETTER = regex.compile(r"\p{L}")
_LOWER = np.arange(256, dtype=np.int32)
_LOWER[65:91] += 32
#: Cells of a presence table at most.
TABLE_CELLS = 1 << 22
UNKNOWN = "und"
#: Times the sample's size, in different texts, that is ranked for it: hashes spread evenly, so with 20 times
#: as many expected the chance that fewer than the sample's size are in range is below 1e-80.
ROOM = 20
#: A text is foreign below this part of the share of known trigrams that FLOOR_QUANTILE of training texts stay under.
FLOOR_PART, FLOOR_QUANTILE = 2 / 3, 0.01
_LETTER_BYTE = np.zeros(256, bool)
_LETTER_BYTE[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _codes(data: np.ndarray, n: int) -> np.ndarray:
    """Code of the n-gram that starts at each byte; the ranges of different n are apart."""
    low = _LOWER[data]
    if n == 1:
        return low
    if n == 2:
        return 256 + low[:-1] * 256 + low[1:]
    return 256 + 65536 + (low[:-2] * 65536 + low[1:-1] * 256 + low[2:])


@dataclass(frozen=True)
class LanguageModel:
    """``alphabet``: sorted n-gram codes; ``weights``: n-grams by languages; ``bias`` and ``floors``: one a language.

    ``floors`` is the least :meth:`familiarity` of a text in each language.
    """

    languages: list[str]
    alphabet: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    floors: np.ndarray

    def presence(self, column: pa.Array) -> np.ndarray:
        return _presence(column, _index(self.alphabet), len(self.alphabet))

    def scores(self, column: pa.Array) -> np.ndarray:
        held = self.presence(column)
        return held @ self.weights / np.sqrt(np.maximum(held.sum(1, keepdims=True), 1)) + self.bias

    def familiarity(self, column: pa.Array) -> np.ndarray:
        return _familiarity(column, _index(self.alphabet))


_INDEX: dict[int, np.ndarray] = {}


def _index(alphabet: np.ndarray) -> np.ndarray:
    """Place of each code in the alphabet or -1; kept for one alphabet."""
    key = hash(alphabet.tobytes())
    if key not in _INDEX:
        _INDEX.clear()
        table = np.full(256 + 65536 + (1 << 24), -1, np.int16 if len(alphabet) < 1 << 15 else np.int32)
        table[alphabet] = np.arange(len(alphabet))
        _INDEX[key] = table
    return _INDEX[key]


def _presence(column: pa.Array, index: np.ndarray, width: int) -> np.ndarray:
    data, ends = text_bytes(column)
    held = np.zeros((len(column), width), np.float32)
    row = np.repeat(np.arange(len(column)), np.diff(ends))
    for n in (1, 2, 3):
        if len(data) < n:
            break
        place = index[_codes(data, n)]
        inside = np.flatnonzero((place >= 0) & (row[: len(place)] == row[n - 1 :]))
        held[row[inside], place[inside]] = 1
    return held


def _familiarity(column: pa.Array, index: np.ndarray, counted: np.ndarray | None = None) -> np.ndarray:
    """Share of each text's trigrams of letters that are in the alphabet, 1 in a text without any.

    ``counted``: the places of the alphabet that count, all if None.
    """
    data, ends = text_bytes(column)
    if len(data) < 3:
        return np.ones(len(column))
    row, letter = np.repeat(np.arange(len(column)), np.diff(ends)), _LETTER_BYTE[data]
    inside = np.flatnonzero(letter[:-2] & letter[1:-1] & letter[2:] & (row[:-2] == row[2:]))
    place = index[_codes(data, 3)[inside]]
    known = place >= 0 if counted is None else (place >= 0) & counted[place]
    size = np.bincount(row[inside], minlength=len(column))
    return np.where(size > 0, np.bincount(row[inside], known, len(column)) / np.maximum(size, 1), 1.0)


def fit(sample: list[tuple[str, str]], landmarks_per_language: int = 40, max_grams: int = 12_000, ridge: float = 1e-2) -> LanguageModel:
    """Fits on (language, text) pairs in the order given; the first of each language are the landmarks.

    The alphabet is the ``max_grams`` n-grams that most landmarks hold (ties: lower code). A language's
    floor is taken from its own texts; what a landmark alone brought in does not count for it.
    """
    languages = sorted({lang for lang, _ in sample})
    if not languages:
        return LanguageModel([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros(0, np.float32), np.zeros(0))
    marks = [t for lang in languages for t in [x for y, x in sample if y == lang][:landmarks_per_language]]
    grams = []
    for text in marks:
        data = np.frombuffer(text.encode(), np.uint8)
        grams.append(np.unique(np.concatenate([_codes(data, n) for n in (1, 2, 3) if len(data) >= n] or [np.zeros(0, np.int32)])))
    codes, counts = np.unique(np.concatenate(grams), return_counts=True)
    alphabet = np.sort(codes[np.argsort(-counts, kind="stable")[:max_grams]]).astype(np.int64)
    index, shared = _index(alphabet), counts[np.searchsorted(codes, alphabet)] > 1
    floors = np.zeros(len(languages))
    for k, lang in enumerate(languages):
        own = [x for y, x in sample if y == lang]
        share = [_familiarity(pa.array(own[a:b], pa.string()), index, counted) for a, b, counted in ((0, landmarks_per_language, shared), (landmarks_per_language, len(own), None))]
        floors[k] = FLOOR_PART * np.quantile(np.concatenate(share), FLOOR_QUANTILE)

    def unit(texts: list[str]) -> np.ndarray:
        held = _presence(pa.array(texts, pa.string()), index, len(alphabet)).astype(np.float64)
        return held / np.sqrt(np.maximum(held.sum(1, keepdims=True), 1))

    base = unit(marks)
    values, vectors = np.linalg.eigh(base @ base.T)
    kept = values > 1e-8 * values[-1]
    root = vectors[:, kept] / np.sqrt(values[kept])
    features = np.concatenate([unit([t for _, t in sample[k : k + 200]]) @ base.T for k in range(0, len(sample), 200)]) @ root
    target = np.where(np.array([lang for lang, _ in sample])[:, None] == np.array(languages), 1.0, -1.0)
    # every language weighs the same, however many rows it has
    share = np.array([1.0 / sum(y == lang for y, _ in sample) for lang, _ in sample])[:, None]
    centre, middle = (features * share).sum(0) / share.sum(), (target * share).sum(0) / share.sum()
    f, t = (features - centre) * np.sqrt(share), (target - middle) * np.sqrt(share)
    solved = np.linalg.solve(f.T @ f + ridge * np.eye(f.shape[1]), f.T @ t)
    return LanguageModel(languages, alphabet, (base.T @ (root @ solved)).astype(np.float32), (middle - centre @ solved).astype(np.float32), floors)


def predict(docs: DataFrame, model: LanguageModel, keep: list[str], text_col: str = "text", reject: bool = False) -> DataFrame:
    """The columns of ``keep`` with ``lang_pred`` and ``score`` for every row; no shuffle.

    ``lang_pred`` is ``und`` with score 0 if the text is null or has no letter, or if nothing was
    learned. ``score`` is the winner's regression output mapped from [-1, 1] to [0, 1]. Ties go to the
    first language in order. With ``reject``, a text whose familiarity is below its language's floor, as
    in other scripts, other languages or gibberish, is ``und`` as well. Columns of ``keep`` with these two names are replaced.
    """
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # its size is bounded: max_grams by languages
    fields = [f for f in docs.schema.fields if f.name in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], object)
        rows = max(1, TABLE_CELLS // max(1, len(model.alphabet)))
        for part in slices(batches, "__text"):
            for start in range(0, part.num_rows, rows):
                some = part.slice(start, rows)
                texts = some.column("__text")
                known = np.array([bool(t) and _LETTER.search(t) is not None for t in texts.to_pylist()], bool) & bool(model.languages)
                best, score = np.full(some.num_rows, len(names) - 1), np.zeros(some.num_rows)
                if known.any():
                    got = model.scores(texts)
                    best[known] = got.argmax(1)[known]
                    score[known] = np.clip((got.max(1)[known] + 1) / 2, 0, 1)
                    if reject:
                        foreign = known.copy()
                        foreign[known] = model.familiarity(texts)[known] < model.floors[best[known]]
                        best[foreign], score[foreign] = len(names) - 1, 0
                out = [some.column(f.name) for f in fields]
                yield pa.RecordBatch.from_arrays([*out, pa.array(names[best], pa.string()), pa.array(score, pa.float64())], [*(f.name for f in fields), "lang_pred", "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "lang_pred string, score double"])
    source = docs.select(*(F.col(f.name) for f in fields), F.col(text_col).alias("__text"))
    return source.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """The test rows: crc32 of the id as text, mod 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, keep: Column, per_language: int = 250, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options: float) -> LanguageModel:
    """Learns from at most ``per_language`` rows of each language among those that ``keep`` holds.

    The sample is the rows with the least hash of their text, so repeated rows count once. The bound
    on the sample is a bound on what the driver sees.
    """
    rows = docs.where(keep & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    # hashes are even, so a share of their range bounds what is ranked; it is a share of the different
    # texts, as copies add no hashes
    shares = {r.lang: min(1.0, ROOM * per_language / r.n) for r in rows.groupBy("lang").agg(F.count_distinct("key").alias("n")).collect()}
    if not shares:
        return fit([], **options)
    top = F.create_map(*(F.lit(x) for lang, share in shares.items() for x in (lang, int(min(share * 2.0**64 - 2.0**63, 2.0**63 - 1024)))))
    few = rows.select("lang", "key").where(F.col("key") <= top[F.col("lang")]).distinct()
    chosen = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).where(F.col("rank") <= per_language)
    keys = [r.key for r in chosen.select("key").collect()]
    texts = rows.where(F.col("key").isin(keys)).groupBy("lang", "key").agg(F.min("text").alias("text")) if keys else rows.limit(0)
    return fit([(r.lang, r.text) for r in texts.orderBy("lang", "key").collect()], **options)
