"""Deletes later copies of repeated runs of lines, with DataFrame operations only.

Line ids are hashes of whole lines. Only lines that occur twice or more can be in a repeated run, so
only they go on. Prefix doubling names the runs of 1, 2, 4, ... lines that start at each of them: the
name of 2m lines is made from the names of m lines here and m lines further on, in one window over the
document. Two runs of m lines are equal if their names are, so a class of equal names is an interval of
the line suffix array with a common prefix of m lines. A run counts if its lines weigh ``min_weight``; a
line weighs one, and one more for every five characters that are not blank.
Every line of a counted run is in a counted run that is minimal at its end or at its start, so only
those intervals are looked up: one aggregation finds the first place of each, and what starts later is
deleted, which is what the maximal runs would delete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm._shared import join_hot, written

#: Characters that weigh as much as a line does.
LETTERS = 5


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    # the hash of the text comes before the lines are dealt out: behind them it would be taken anew for each line
    whole = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("copy"), F.split(text, "\n", -1).alias("lines"))
    rows = whole.select("id", "copy", F.posexplode("lines").alias("pos", "line"))
    weight = 1 + F.floor(F.length(F.replace("line", F.lit(" "))) / LETTERS)
    return rows.select("id", "copy", "pos", F.xxhash64("line").alias("name"), weight.cast("int").alias("weight"))


def repeated_runs(docs: DataFrame, min_weight: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Later copies of minimal counted runs: ``id, copy, pos, n_lines``."""
    lines = written(_lines(docs, id_col, text_col), "lines")
    again = written(lines.groupBy("name").agg(F.count("*").alias("n")).where("n > 1"), "again")
    rows = join_hot(lines, again, ["name"], "n").drop("n").dropDuplicates(["id", "copy", "pos"])

    doc = Window.partitionBy("id", "copy").orderBy("pos")
    rows = rows.withColumn("island", F.col("pos") - F.row_number().over(doc))
    run = Window.partitionBy("id", "copy", "island").orderBy("pos")
    rows = rows.withColumn("sum", F.sum("weight").over(run)).withColumn("total", F.sum("weight").over(Window.partitionBy("id", "copy", "island")))
    rows = rows.where(F.col("total") >= min_weight).withColumn("before", F.col("sum") - F.col("weight"))

    rows, levels = rows.withColumnRenamed("name", "name_0"), 0
    while 2 << levels <= min_weight:
        further = F.lead(f"name_{levels}", 1 << levels).over(run)
        rows = rows.withColumn(f"name_{levels + 1}", F.when(further.isNotNull(), F.xxhash64(f"name_{levels}", further)))
        levels += 1

    def of(m: int) -> Column:
        """The run of m lines from here, if it is there, counts and is minimal at its start or end."""
        level = m.bit_length() - 1
        last = (lambda c: c) if m == 1 else (lambda c: F.lead(c, m - 1).over(run))
        name = F.col(f"name_{level}") if m == 1 << level else F.xxhash64(f"name_{level}", F.lead(f"name_{level}", m - (1 << level)).over(run))
        held = last("sum") - F.col("before") if m > 1 else F.col("weight")
        shorter = F.least(held - (last("weight") if m > 1 else F.col("weight")), held - F.col("weight"))
        return F.when((held >= min_weight) & (shorter < min_weight), F.struct(F.lit(m).alias("n_lines"), name.alias("name")))

    rows = rows.select("id", "copy", "pos", F.array_compact(F.array(*map(of, range(1, min_weight + 1)))).alias("runs"))
    runs = rows.select("id", "copy", "pos", F.explode("runs").alias("run")).select("id", "copy", "pos", "run.*")
    runs = written(runs, "runs")
    first = written(runs.groupBy("n_lines", "name").agg(F.min(F.struct("id", "copy", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1"), "first")
    return join_hot(runs, first, ["n_lines", "name"], "n").where(F.struct("id", "copy", "pos") > F.col("first")).select("id", "copy", "pos", "n_lines")


def line_dedup(docs: DataFrame, min_weight: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row with later copies of repeated line runs taken out of its text.

    Returns the input's columns with the new text, and ``n_lines int, n_removed int``. Lines are what
    ``\\n`` separates. A line goes if a run around it that weighs at least ``min_weight`` (by default a line
    of 20 characters, or five lines) also starts earlier: smaller id, null ids first, then smaller text
    hash, then earlier line; runs are judged on the input. Null texts stay null; the empty text is one
    line. Rows that repeat id and text are one document and come back alike. Columns named ``n_lines``
    or ``n_removed`` are replaced, all others stay, whatever their names.
    """
    removed = repeated_runs(docs, min_weight, id_col, text_col).select(F.col("id").alias("__id"), F.col("copy").alias("__copy_of"), F.explode(F.sequence("pos", F.expr("pos + n_lines - 1"))).alias("pos"))
    removed = removed.groupBy("__id", "__copy_of").agg(F.collect_set("pos").alias("__removed"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.drop("n_lines", "n_removed").withColumn("__copy", F.xxhash64(text))
    joined = own.join(removed, own[id_col].eqNullSafe(removed["__id"]) & (F.col("__copy") == removed["__copy_of"]), "left").drop("__id", "__copy", "__copy_of")
    # the lines are a column of their own, used twice: a text is split once, not again for each line that stays
    joined = joined.withColumn("__lines", F.split(text, "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__removed"))
    new = F.when(F.col("__removed").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.col("__lines")[i]), "\n"))
    counted = joined.withColumns({"n_lines": F.size("__lines"), "n_removed": F.coalesce(F.size("__removed"), F.lit(0)), text_col: new})
    return counted.drop("__removed", "__lines")


def line_dedup_sql(min_weight: int = 5) -> str:
    """DuckDB: all pairs of equal lines, joined up along diagonals; a diagonal's runs are the common runs."""
    return f"""
WITH l AS (
  SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)
), d AS (
  SELECT b.doc_id, b.pos, 1 + length(replace(b.line, ' ', '')) // {LETTERS} AS weight, a.doc_id AS other, b.pos - a.pos AS diagonal
  FROM l a JOIN l b ON a.line = b.line AND (a.doc_id, a.pos) < (b.doc_id, b.pos)
), g AS (
  SELECT *, pos - row_number() OVER (PARTITION BY doc_id, other, diagonal ORDER BY pos) AS island FROM d
), r AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, sum(weight) OVER (PARTITION BY doc_id, other, diagonal, island) AS total FROM g) WHERE total >= {min_weight} GROUP BY ALL
), k AS (
  SELECT l.doc_id, count(*) AS n_lines, count(r.pos) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE r.pos IS NULL), '') AS text
  FROM l LEFT JOIN r USING (doc_id, pos) GROUP BY l.doc_id
)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, sha256(text) AS kept_sha256 FROM k"""


def line_digest(deduped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, line counts and the hash of each text that :func:`line_dedup` left; a null text counts as empty."""
    return deduped.select(id_col, F.col("n_lines").cast("bigint"), F.col("n_removed").cast("bigint"), F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("kept_sha256"))
