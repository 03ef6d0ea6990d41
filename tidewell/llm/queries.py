"""Queries of this subpackage's operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import language
from tidewell.llm._shared import finished, scratch_path
from tidewell.llm.bpe import bpe_digest, bpe_encode
from tidewell.llm.cap_filters import CAP_LINKS_SQL, cap_links
from tidewell.llm.chunk_bpe import chunk_encode
from tidewell.llm.decontaminate import contamination
from tidewell.llm.hard_negatives import HARD_NEGATIVES_SQL, hard_negatives
from tidewell.llm.interpolation import lm_scores
from tidewell.llm.licenses import license_scan, license_sql
from tidewell.llm.line_dedup import line_dedup, line_dedup_sql, line_digest
from tidewell.llm.minhash import near_duplicates
from tidewell.llm.periodic import periodic_runs
from tidewell.llm.suffix_dedup import suffix_dedup, suffix_digest
from tidewell.llm.token_store import encode_ids, read_blocks, shard_bounds, write_blocks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lambda: near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")
    return finished(found, "op1")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(lambda: suffix_digest(suffix_dedup(table(spark, sf_dir, "documents"))), "op2")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token_store")
    docs, shards = table(spark, sf_dir, "documents"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    encoded = encode_ids(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, bounds=shard_bounds(docs, shards))
    write_blocks(encoded, path, shards)
    return read_blocks(spark, path, ids=False)


def op4_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(lambda: cap_links(table(spark, sf_dir, "embeddings")), "op4")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("copy")


def op6_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    scored = finished(lambda: lm_scores(table(spark, sf_dir, "documents"), ~held), "op6")
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe_digest(bpe_encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs, ~language.held_out())
    marked = docs.select("doc_id", language.held_out().alias("held_out"), "text")
    return language.predict(marked, model, keep=["doc_id", "held_out"])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(lambda: line_digest(line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))), "op10")


def planted_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: in documents whose hash ends in 0 the words from one place on are repeated with a period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("words"))
    counted = words.withColumn("n", F.size("words")).withColumn("a", F.expr("g % nullif(n, 0)").cast("int"))
    counted = counted.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)").cast("int"))
    cycle = F.expr("flatten(array_repeat(slice(words, a + 1, p), cast(ceil((n - a) / p) as int)))")
    repeated = F.array_join(F.concat(F.expr("slice(words, 1, a)"), F.slice(cycle, F.lit(1), F.expr("n - a"))), " ")
    return counted.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted_periods(table(spark, sf_dir, "documents")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("shorter"), r.start.alias("start"), r.period.alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))), "")
    found = found.withColumn("best", best).withColumn("length", -F.col("best.shorter"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), "length", F.col("best.period").alias("period"),
        F.expr("1000 * length div best.period").alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = chunk_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components in whole 256ths; where 7 divides the id, the label is that of the next class."""
    rows = table(spark, sf_dir, "embeddings").where("vec_id is not null and label is not null and embedding is not null")
    rows = rows.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vector = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("bigint"))
    return finished(lambda: hard_negatives(rows.select(F.col("vec_id").alias("id"), label.alias("label"), vector.alias("vector"))), "op13")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_token_store": op3_token_store,
    "op4_cap_filters": op4_cap_filters,
    "op5_decontaminate": op5_decontaminate,
    "op6_interpolation": op6_interpolation,
    "op8_licenses": op8_licenses,
    "op7_byte_bpe": op7_byte_bpe,
    "op9_language": op9_language,
    "op10_line_dedup": op10_line_dedup,
    "op11_periodic": op11_periodic,
    "op12_chunk_bpe": op12_chunk_bpe,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op4_cap_filters": CAP_LINKS_SQL,
    "op8_licenses": license_sql(),
    "op10_line_dedup": line_dedup_sql(),
    "op13_hard_negatives": HARD_NEGATIVES_SQL,
}
