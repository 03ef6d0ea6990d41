"""Tertiles where the values next to an edge differ in their last bit, as sums of the same cents do: as in SQL."""

from __future__ import annotations

from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa

from tidewell.operators import scale


def test_levels_equal_sql_where_neighbours_are_nearly_equal(spark):
    rng = np.random.default_rng(3)
    days = [4.62 + 0.37, 12.19, 21.71, 26.7, 7.1 + 19.6, 33.48, 39.59, 48.69, 51.62, 99.02, 104.03, 299.15]
    rows = [(1000, k, "f", v) for k, v in enumerate(days)]  # 26.7 and 26.700000000000003 on both sides of a third
    for pid in range(400):
        n = int(rng.integers(4, 30))
        own = np.round(rng.uniform(0, 400, max(2, n // 3)), 2)
        rows += [(pid, k, "f", float(v)) for k, v in enumerate(rng.choice([*own, *np.nextafter(own, 1e3)], n))]
    got = {(r.pid, r.day): r.level for r in scale.tertiles(spark.createDataFrame(rows, "pid long, day long, feature string, value double"), ["pid"]).collect()}
    con = duckdb.connect()
    con.register("daily", pa.table(dict(zip(("pid", "day", "feature", "value"), map(list, zip(*rows, strict=True)), strict=True))))
    want = con.sql("""SELECT d.pid, day, CASE WHEN lo < a AND a < b AND b < hi THEN CASE WHEN value <= a THEN 'l' WHEN value <= b THEN 'm' ELSE 'h' END
      WHEN lo < m AND m < hi THEN CASE WHEN value <= m THEN 'l' ELSE 'h' END ELSE 'm' END AS level FROM daily d
      JOIN (SELECT pid, quantile_cont(value, 1/3.0::DOUBLE) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 2/3.0::DOUBLE) AS b, min(value) AS lo, max(value) AS hi FROM daily GROUP BY ALL) q ON q.pid = d.pid""")
    assert {(p, d): level for p, d, level in want.fetchall()} == got


def test_edges_are_fused_and_null_without_values(spark):
    rng = np.random.default_rng(4)
    table = {k: sorted(np.round(rng.uniform(-50, 400, 8), 2).tolist()) for k in range(200)}
    rows = [(k, "f", v) for k, vs in table.items() for v in vs] + [(900, "f", None), (901, "f", 7.0)]
    found = {r.pid: r for r in scale._quantiles(spark.createDataFrame(rows, "pid long, feature string, value double"), ["pid", "feature"], [1 / 3, 2 / 3]).collect()}
    for k, vs in table.items():
        for q, edge in zip((1 / 3, 2 / 3), found[k].edge, strict=True):
            at = q * 7
            low, d = vs[int(at)], at - int(at)
            assert edge == float(Fraction(low) * Fraction(1 - d) + Fraction(vs[int(at) + 1] * d))
        assert (found[k].low, found[k].high) == (vs[0], vs[-1])
    assert found[900].edge == [None, None] and found[901].edge == [7.0, 7.0]
