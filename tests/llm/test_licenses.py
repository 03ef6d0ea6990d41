"""Spans are verified word by word: kin licenses are told apart, scattered runs are no license."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidewell.llm import licenses

APACHE = "you may not use this file except in compliance with the License. You may obtain a copy of the License at"
CASES = {
    "Licensed under the Apache License, Version 2.0 (the License)": "apache-2.0",
    "Licensed under the Apache License, Version 1.1": "apache-1.1",
    "This work is licensed under the GNU General Public License, version 2": "gpl,gpl-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
    "licensed under the GNU Lesser General Public License version 3": "gpl,lgpl-3.0",
    "licensed under the GNU Lesser General Public License, version 2.1 or later": "gpl,lgpl-2.1",
    "This is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "cc-by-nc-4.0",
    "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa-4.0",
    "licensed under a Creative Commons Attribution 3.0 Unported License": "cc-by-3.0",
    "licensed under a Creative Commons Attribution 4.0 International License": "cc-by-4.0",
    "Licensed under CC BY-NC 4.0": "cc-by,cc-by-nc-4.0",
    "subject to the terms of the Mozilla Public License, v. 1.1": "mpl-1.1",
    "Licensed under the MIT License": "mit",
    "Released under the MIT License.": "mit",
    "the mit and the license": "",
    APACHE: "apache",
    APACHE.replace("this file", "this little file").replace("copy of", "copy, of"): "apache",
    "": "",
    "one two": "",
}
BSD = next(text for label, text, _ in licenses.TEMPLATES if label == "bsd")


def scattered():
    """Every run of four words of a template, four strange words after each."""
    w = licenses._split(BSD)
    return " ".join(" ".join(w[k : k + 4]) + f" q{k} r{k} s{k} t{k}" for k in range(len(w) - 3))


def labels(spark, texts, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"id": F.lit(1), "copy": F.lit(2), "label": F.lit("x")})
    return {r.doc_id: r for r in licenses.license_scan(rows, **options).collect()}


def test_labels(spark):
    got = labels(spark, [*CASES, scattered(), " ".join(reversed(BSD.split())), (BSD + " ") * 3, None])
    assert {k: got[k].labels for k in range(len(CASES))} == dict(enumerate(CASES.values()))
    n = len(CASES)
    assert [got[n + k].labels for k in range(4)] == ["", "", "bsd", ""]
    assert got[n + 2].score == 1.0 and got[n + 3].n_words == 0


def by_brute_force(words, template, needed):
    """Best share of the template's words in the longest forward chain of runs within a stretch of the text."""
    n, reach = len(template), max(licenses.GAP, len(template) // (2 * licenses.STRETCH))
    runs = {}
    for q in range(n - 3):
        runs.setdefault(tuple(template[q : q + 4]), []).append(q)
    hits = [(p, q) for p in range(len(words) - 3) for q in runs.get(tuple(words[p : p + 4]), ())]
    found = 0.0
    for low in sorted({p - q for p, q in hits}):
        chains = []
        for p, q in sorted((p, -q) for p, q in hits if low <= p - q <= low + 2 * reach):
            chains.append(max([(c[0] + 1, c[1], p, -q, [*c[4], -q]) for c in chains if c[3] < -q], default=(1, p, p, -q, [-q])))
        places = max(chains)[4]
        held = len({w for q in places for w in range(q, q + 4)}) / n
        if all(any(q <= i and i + 1 < q + 4 for q in places) for i in needed) and max(chains)[2] + 4 - max(chains)[1] <= n + licenses.STRETCH * reach:
            found = max(found, held)
    return found


@pytest.mark.parametrize("seed", range(3))
def test_spans_with_words_put_in_and_left_out(spark, seed):
    r = random.Random(seed)
    texts, want = [], []
    for _ in range(60):
        label, text, phrases = r.choice(licenses.TEMPLATES)
        words = licenses._split(text)
        changed = [x for w in words for x in ([] if r.random() < 0.06 else [w, "zz"] if r.random() < 0.06 else [w])]
        texts.append(" ".join(["aa"] * r.randint(0, 5) + changed))
        want.append((label, by_brute_force(licenses._split(texts[-1]), words, licenses._needed(words, phrases))))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for s in licenses.spans(rows).collect():
        got[s.id, s.label] = max(got.get((s.id, s.label), 0.0), s.share)
    assert {(k, label) for k, (label, share) in enumerate(want) if share >= 0.6} <= set(got)
    assert all(got.get((k, label), 0.0) >= round(share, 9) - 1e-9 for k, (label, share) in enumerate(want) if share >= 0.6)


def test_templates_are_a_table(spark):
    own = licenses.template_table(spark, [("house", "do as you like with this but never sell it", ("never sell it",))])
    got = labels(spark, ["Do as you like with this, but never sell it!", "do as you like with this but always sell it"], templates=own)
    assert (got[0].labels, got[1].labels) == ("house", "")
