"""A place that driver and executors share, for written tables that cut lineage, and joins by hot keys."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than this share of all rows is hot: at most so many keys, whose table is broadcast.
HOT = 1 / 1000
#: Paths and tables made inside :func:`finished`, innermost call last.
_OPEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where it is unset, as in tests, one under the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: a cut of lineage that survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, buckets: int, *keys: str) -> DataFrame:
    """Writes a table in buckets of its keys, so that joins on them find it in place."""
    table = f"{name}_{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(f"table {table}")
    df.write.bucketBy(buckets, *keys).option("compression", "zstd").saveAsTable(table)
    return df.sparkSession.table(table)


def finished(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Writes what ``make`` gives and deletes all tables that were written on the way."""
    _OPEN.append([])
    try:
        df = make()
        path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
    finally:
        made = _OPEN.pop()
    for x in made:
        if x.startswith("table "):
            df.sparkSession.sql(f"DROP TABLE {x[6:]}")
        else:
            _delete(df.sparkSession, x)
    if _OPEN:
        _OPEN[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes the files of a table that :func:`written` made and that no plan needs any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    file.getFileSystem(spark._jsc.hadoopConfiguration()).delete(file, True)


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Inner join of rows with a table of distinct keys, whose column ``n`` counts the rows of each key.

    Rows with a hot key meet it where they are; only the others are dealt out by key. Both should be
    written tables, as they are read twice.
    """
    total = rows.agg(F.count("*")).first()[0]
    hot = table.where(F.col(n) > total * HOT)
    apart = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table.where(F.col(n) <= total * HOT), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(apart)
