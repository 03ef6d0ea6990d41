"""Links are defined on shingle sets: how often a text repeats a passage must not matter."""

from __future__ import annotations

import random

import numpy as np

from tidewell.llm import minhash


def _repeats(seed: int) -> tuple[str, str]:
    """Two texts of one set similarity above 0.8; the first holds a part of it 100 times."""
    r = random.Random(seed)
    words = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(9)) for _ in range(n))
    part, rest, more = words(60), words(180), words(8)
    return " ".join([part] * 100 + [rest]), f"{part} {part} {rest} {more}"


def test_repeated_passages_do_not_hide_a_link(spark):
    rows = [(2 * k + side, text) for k in range(40) for side, text in enumerate(_repeats(k))]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in found} == {x: x - x % 2 for x, _ in rows}


def test_bands_are_those_of_the_set(spark):
    once, often = "one two three four five six seven", "one two three four five six seven " * 2
    own = [set(map(tuple, zip(*(t.split()[k:] for k in range(5)), strict=False))) for t in (often, often * 30)]
    assert own[0] == own[1] and once in often
    bands = [r.bands for r in minhash.sketches(spark.createDataFrame([(1, often), (2, often * 30)], "doc_id long, text string")).collect()]
    assert bands[0] == bands[1]


def test_members_of_a_bucket_are_verified_on_whole_sets(spark):
    """An odd sketch rules nothing out: all pairs of a bucket that are similar are found, in any blocks."""
    r = np.random.default_rng(4)
    base = np.sort(r.choice(1 << 32, 200, replace=False)).astype("<u8")
    sets = [np.sort(np.concatenate([base[: 200 - 7 * k], np.sort(r.choice(1 << 32, 3 * k + 1)).astype("<u8")])) for k in range(12)]
    jaccard = lambda x, y: len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    want = {(a, b) for a in range(12) for b in range(a + 1, 12) if jaccard(sets[a], sets[b]) >= 0.8}
    rows = [(7, k, k, [7, k], x.tobytes()) for k, x in enumerate(sets)]
    members = spark.createDataFrame(rows, "key long, node long, component long, bands array<long>, set binary")
    assert want and {(x.a, x.b) for x in minhash._across(members, 0.8).collect()} == want
