"""Ranks, running sums and exact quantiles of one long column in many tasks.

A window over all rows of a feature is one task, however many rows there are. Here the values of a key are
cut into bins at approximate quantiles: rows are ordered within their bin, and a bin starts from the sum of
the bins before it, which is a small table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of a key.
BINS = 64
#: Bytes of rows from which on a written table is broadcast only where a query says so: about what Spark's own
#: limit of 10 MB of hashed rows lets through, here told from the rows in place of their compressed files.
MEMORY = 32 << 20


def cut(rows: DataFrame) -> DataFrame:
    """The rows written to the cluster's shared folder, compressed, and read again: what reads them several times
    neither plans nor computes anew what made them. Without spark.checkpoint.dir, as in tests, the folder lies in
    the warehouse.

    Spark takes a table's size from its files, here a small part of what the rows take in memory, and would collect
    and broadcast tables that grow with the input. A large table therefore asks for merge joins; a broadcast that is
    stated further out, or of the other side, goes before."""
    spark = rows.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    path = f"{base.rstrip('/')}/cut-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(rows.schema).parquet(path)
    return made.hint("merge") if _large(made) else made


def _large(made: DataFrame) -> bool:
    """Whether a written table's rows take more than ``MEMORY``; small files are not looked at."""
    if int(str(made._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < MEMORY >> 7:
        return False
    width = 8 + sum(made._jdf.schema().apply(c).dataType().defaultSize() for c in made.columns)
    return made.count() * width > MEMORY  # counted from the files' footers


def binned(rows: DataFrame, keys: list[str], value: str, bins: int = BINS) -> DataFrame:
    """The rows with ``__bin``: how many of their key's cut points lie below the value; equal values share a bin."""
    points = F.percentile_approx(value, F.array(*(F.lit(k / bins) for k in range(1, bins))), F.lit(10_000))
    cuts = rows.groupBy(*keys).agg(F.array_distinct(points).alias("__cuts"))
    placed = rows.join(F.broadcast(cuts), keys) if keys else rows.crossJoin(F.broadcast(cuts))  # a row a key
    return placed.withColumn("__bin", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")


def running(rows: DataFrame, keys: list[str], value: str, sums: list[str], then: tuple[str, ...] = ()) -> DataFrame:
    """The rows with ``below_<column>``: its sum over all rows of the key that come before by the value, then ``then``.

    Rows that are equal in all of these are in no order, so the value should be distinct or ``then`` decide.
    Keys should be few beside rows (features, data sets): the bins of all keys are a broadcast table.
    """
    placed = binned(rows, keys, value)
    totals = placed.groupBy(*keys, "__bin").agg(*(F.sum(c).alias(f"__{c}") for c in sums))
    earlier = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)  # at most BINS rows
    offsets = totals.select(*keys, "__bin", *(F.coalesce(F.sum(f"__{c}").over(earlier), F.lit(0)).alias(f"__before_{c}") for c in sums))
    own = Window.partitionBy(*keys, "__bin").orderBy(value, *then).rowsBetween(Window.unboundedPreceding, -1)
    made = placed.withColumns({f"__own_{c}": F.coalesce(F.sum(c).over(own), F.lit(0)) for c in sums}).join(F.broadcast(offsets), [*keys, "__bin"])
    made = made.withColumns({f"below_{c}": F.col(f"__before_{c}") + F.col(f"__own_{c}") for c in sums})
    return made.drop("__bin", *(f"__before_{c}" for c in sums), *(f"__own_{c}" for c in sums))


def average_ranks(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, value, count, rank`` of the distinct values: rank from 1, ties with their average."""
    counts = cut(rows.groupBy(*keys, value).agg(F.count("*").alias("count")))
    return running(counts, keys, value, ["count"]).select(*keys, value, "count", (F.col("below_count") + (F.col("count") + 1) / 2).alias("rank"))


def exact_quantiles(rows: DataFrame, keys: list[str], q: list[float], value: str = "value") -> DataFrame:
    """``keys, edge array<double>``: exact quantiles with linear interpolation, nulls left out; as ``percentile``
    gives them, but from counts of distinct values that are ordered in many tasks. A key without values is null."""
    every = cut(rows.groupBy(*keys, value).agg(F.count("*").alias("count")))
    counts = every.where(F.col(value).isNotNull())
    placed = running(counts, keys, value, ["count"]).withColumn("up", F.col("below_count") + F.col("count"))
    total = counts.groupBy(*keys).agg(F.sum("count").alias("total"))
    placed = placed.join(F.broadcast(total), keys) if keys else placed.crossJoin(F.broadcast(total))
    at = [F.lit(float(x)) * (F.col("total") - 1) for x in q]
    inside = lambda rank: (F.col("below_count") <= rank) & (rank < F.col("up"))
    sides = [(F.floor(a), F.ceil(a)) for a in at]
    wanted = placed.where(F.greatest(*(inside(r) for pair in sides for r in pair)))
    v = F.col(value).cast("double")
    ends = [F.max(F.when(inside(r), v)) for pair in sides for r in pair]
    found = wanted.groupBy(*keys).agg(F.first("total").alias("total"), *(e.alias(f"__e{k}") for k, e in enumerate(ends)))

    def value_at(k: int) -> Column:
        low, high = F.col(f"__e{2 * k}"), F.col(f"__e{2 * k + 1}")
        a = at[k]
        return F.when(low == high, low).otherwise((F.ceil(a) - a) * low + (a - F.floor(a)) * high)

    edges = found.select(*keys, F.array(*(value_at(k) for k in range(len(q)))).alias("edge"))
    return every.select(*keys).distinct().join(F.broadcast(edges), keys, "left") if keys else edges
