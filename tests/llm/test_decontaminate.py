"""Greedy tiling against a search of all places, long repetitive texts, and whole tables against brute force."""

from __future__ import annotations

import random
import re
import resource

import numpy as np
import pytest

from tidewell.llm import decontaminate
from tidewell.llm._text import mix64


def by_brute_force(text, item, least=5):
    used_text, used_item, out = [False] * len(text), [False] * len(item), []
    while True:
        best = (0, 0, 0)
        for p in range(len(text)):
            for q in range(len(item)):
                n = 0
                while p + n < len(text) and q + n < len(item) and text[p + n] == item[q + n] and not used_text[p + n] and not used_item[q + n]:
                    n += 1
                best = max(best, (n, -p, -q))
        n, p, q = best[0], -best[1], -best[2]
        if n < least:
            return out
        out.append((p, q, n))
        used_text[p : p + n] = used_item[q : q + n] = [True] * n


@pytest.mark.parametrize("letters", ["ab", "abcdef", "a"])
def test_tiles(letters):
    r = random.Random(letters)
    for _ in range(60):
        text, item = ([r.choice(letters) for _ in range(r.randint(0, 40))] for _ in range(2))
        coded = [mix64(np.array([ord(x) for x in s], np.uint64)) for s in (text, item)]
        assert decontaminate.tiles(*coded) == by_brute_force(text, item)


def words(text):
    return re.findall("[0-9a-z\u0080-\U0010ffff]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def test_tables_equal_brute_force(spark, monkeypatch):
    r = random.Random(4)
    vocabulary = ["la", "le", "lu", *(f"w{k}" for k in range(30))]
    items = [" ".join(r.choice(vocabulary[: r.choice([1, 3, 33])]) for _ in range(r.randint(0, 40))) for _ in range(25)] + [None, "", "too short"]

    def shuffled(text):
        w = words(text)
        k = len(w) // 2
        return " ".join([*w[k:], "new", *w[:k]])

    texts = [None, "", "la"] + [" ".join([r.choice(vocabulary) for _ in range(20)] + [shuffled(r.choice(items)).upper()] + [r.choice(vocabulary)]) for _ in range(40)]
    docs = spark.createDataFrame([*enumerate(texts), (7, texts[7])], "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = []
    for x, t in [*enumerate(texts), (7, texts[7])]:
        for y, i in enumerate(items):
            tiles = by_brute_force(words(t), words(i))
            n = sum(n for *_, n in tiles)
            if tiles and n >= 0.5 * len(words(i)):
                want.append((x, y, len(words(i)), n, len(tiles), max(n for *_, n in tiles)))
    assert want
    for size in (decontaminate.PASS_WORDS, 100):  # one pass and several
        monkeypatch.setattr(decontaminate, "PASS_WORDS", size)
        got = decontaminate.contamination(docs, benchmark).collect()
        assert sorted((g.doc_id, g.item_id, g.n_words, g.n_tiled, g.n_tiles, g.longest) for g in got) == sorted(want)


def test_long_repetitive_texts_stay_small(spark):
    docs = spark.createDataFrame([(1, "la " * 200_000), (2, "lo " * 200_000)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "la " * 400), (2, "la lu " * 400)], "item_id long, text string")
    got = decontaminate.contamination(docs, benchmark).collect()
    assert [(g.doc_id, g.item_id, g.n_tiled, g.n_tiles) for g in got] == [(1, 1, 400, 1)]
    code, item = mix64(np.full(200_000, 7, np.uint64)), mix64(np.full(400, 7, np.uint64))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert decontaminate.tiles(code, item) == [(0, 0, 400)]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000  # kB
