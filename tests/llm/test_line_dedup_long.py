"""A text of very many lines is rebuilt in time that grows with its length."""

from __future__ import annotations

import time

from tidewell.llm.line_dedup import line_dedup


def test_a_hundred_thousand_lines_take_seconds(spark):
    lines = [f"this is line number {k} of a long text" for k in range(100_000)]
    lines[50_000:50_100] = ["a boilerplate line that comes again and again"] * 100
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "first line of another text\n" + lines[7])], "doc_id long, text string")
    line_dedup(docs.limit(0)).collect()
    start = time.time()
    got = {r.doc_id: r for r in line_dedup(docs).collect()}
    assert time.time() - start < 60
    assert (got[1].n_lines, got[1].n_removed) == (100_000, 99) and got[1].text.split("\n") == lines[:50_001] + lines[50_100:]
    assert got[2].text == "first line of another text" and got[2].n_removed == 1
