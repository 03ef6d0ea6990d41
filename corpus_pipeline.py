"""Stages from raw documents to token ids; each is written as Parquet and read again.

Language ID drops texts without a known language (no letter, or too few of the language's letter
trigrams), line dedup takes repeated line runs out of the texts and drops documents of which almost nothing
is left, MinHash keeps one document of each group of near-duplicates, decontamination drops documents that
hold a benchmark item, and byte-level BPE encodes what is left. Every stage takes and returns empty tables;
other columns are passed on, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import language
from tidewell.llm._shared import finished, written
from tidewell.llm.bpe import bpe_digest, bpe_encode
from tidewell.llm.decontaminate import contamination
from tidewell.llm.line_dedup import line_dedup
from tidewell.llm.minhash import near_duplicates


#: A document goes if line dedup leaves less than this share of its characters.
LEAST_LEFT = 0.1


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; null, empty and letterless texts go."""
    model = language.learn(docs, ~language.held_out())
    marked = language.predict(docs, model, keep=docs.columns, reject=True)
    return marked.where(F.col("lang_pred") != language.UNKNOWN).select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of line runs; ``n_chars`` follows.

    Documents of which less than LEAST_LEFT is left go: a later near copy would otherwise stay as the few
    lines that differ, which resemble nothing any more. Null and empty texts stay as they are. Rows that
    repeat id and text are treated alike.
    """
    before = F.length(F.coalesce(F.col("text"), F.lit("")))
    cut = line_dedup(docs.withColumn("__before", before))
    left = F.length(F.coalesce(F.col("text"), F.lit(""))).cast("bigint")
    kept = cut.where((F.col("n_removed") == 0) | ((F.col("n_removed") < F.col("n_lines")) & (left >= LEAST_LEFT * F.col("__before"))))
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, left).otherwise(F.col("n_chars"))).select(*docs.columns)


def _own_copy(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__own_copy", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id (null ids first); rows that
    repeat id and text become one. Null and empty texts are no one's duplicates."""
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("__id"), F.col("copy").alias("__copy")).distinct()
    own = _own_copy(docs)
    joined = own.join(kept, own["doc_id"].eqNullSafe(kept["__id"]) & (own["__own_copy"] == kept["__copy"]), "left_semi")
    return joined.dropDuplicates(["doc_id", "__own_copy"]).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, repeated rows are treated alike."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = written(contamination(docs, benchmark).select(F.col("doc_id").alias("__id"), F.col("copy").alias("__copy")).distinct(), "contaminated")
    own = _own_copy(docs)
    return own.join(found, own["doc_id"].eqNullSafe(found["__id"]) & (own["__own_copy"] == found["__copy"]), "left_anti").select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of every text's token ids and of the text decoded from them; a null text counts as empty."""
    return bpe_digest(bpe_encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_repeated_lines),
    ("minhash", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("byte_bpe", token_ids),
]

#: SQL does not express language ID or BPE; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        # what a stage wrote on its way is deleted when its result is there
        docs = finished(lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
