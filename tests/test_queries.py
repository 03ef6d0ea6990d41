"""Each query with SQL against DuckDB on the smallest tables; the others must give rows of a fixed schema."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from tidewell import queries as q
from tidewell.operators import models

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    return con


def rows(raw):
    return sorted((tuple(None if v is None or v != v else round(float(v), 6) + 0.0 if isinstance(v, float) else v for v in r) for r in raw), key=repr)


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = q.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    want = duck.sql(q.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert rows(df.select(*columns).collect()) == rows([r[k] for k in at] for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLE_SQL)))
def test_has_rows(spark, monkeypatch, name):
    """The same query functions; only the grids of boosted and upper models are smaller than the published ones."""
    monkeypatch.setattr(models, "SIZES", (2, 4))
    monkeypatch.setattr(models, "TOP", (3, 6))
    df = q.QUERIES[name](spark, DIR)
    rows = df.collect()
    assert rows and all(len(r) == len(df.columns) for r in rows)
    for column in {"score", "prob", "frequency", "accuracy", "acc", "balanced_acc", "auc"} & set(df.columns):
        assert all(r[column] is None or 0 <= r[column] <= 1 for r in rows)
    if name.startswith("published_"):
        assert {r.role: r.n for r in rows}.keys() == {"train", "test"} and sum(r.n for r in rows) == 120
