"""The pipeline's language stage drops what is in no learned language, and nothing else."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline


def test_foreign_scripts_and_gibberish_go(spark):
    sf_dir, r = "/root/testdata/sf0.001", random.Random(3)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    gibberish = [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9))) for _ in range(n)) for n in (5, 20, 100, 1000)]
    foreign = ["Это предложение написано по-русски и не относится к выученным языкам", "日本語の文章はここにあります", "هذا نص باللغة العربية", "Ez a mondat magyarul van, és nem tartozik egyik tanult nyelvhez sem"]
    planted = spark.createDataFrame([(10**9 + k, t) for k, t in enumerate(gibberish + foreign)], "doc_id long, text string")
    got = corpus_pipeline.known_language(spark, docs.unionByName(planted, allowMissingColumns=True), sf_dir)
    clean = docs.where(F.length("text") > 0)
    kept = {x.doc_id for x in got.collect()}
    assert not {x for x in kept if x >= 10**9}
    assert len(kept) >= 0.99 * clean.count()
