"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm._shared import drop, written


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``node, component`` (the smallest node reached) for every node of ``links(a bigint, b bigint)``.

    Each round replaces the edges by about as many edges to smaller nodes, so that a logarithmic number
    of rounds leaves a star around each smallest node. Every round is written to the shared folder;
    only two sums go to the driver. Nothing is gathered by node except minima.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = _mark(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "least").alias("b"))
        large = written(large.distinct(), name)
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        joined = large.join(least, "a")
        small = joined.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).union(joined.select("a", F.col("least").alias("b")))
        new = written(small.distinct(), name)
        drop(edges)
        drop(large)
        edges, before, seen = new, seen, _mark(new)
        if seen == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]
