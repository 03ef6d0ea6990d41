"""Interpolated scores against a plain count of everything and an EM over single tokens."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import interpolation

START, END = "<s>", "</s>"


def split(text):
    return [*re.findall("[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)})), END]


def counted(texts):
    """Counts of words, pairs and triples, and the number of texts and tokens."""
    grams = [Counter(), Counter(), Counter()]
    for text in texts:
        w = [START, START, *split(text)]
        for k in range(2, len(w)):
            for n in range(3):
                grams[n][tuple(w[k - n : k + 1])] += 1
    return grams, len(texts), sum(grams[0].values())


def tokens_of(text, counts):
    grams, docs, n = counts
    w = [START, START, *split(text)]
    for k in range(2, len(w)):
        c = [grams[m][tuple(w[k - m : k + 1])] for m in range(3)]
        before = docs if k == 2 else grams[0][w[k - 1],]
        pair = docs if k == 2 else grams[1][w[k - 2], w[k - 1]]
        yield c, [n, before, pair]


def bucket(count):
    return 1 + int(math.log2(count)) if count else 0


def weights_of(events, v, n):
    """EM level by level, token by token."""
    weights = []
    for level in range(3):
        by_bucket = {}
        for c, h in events:
            lower = 1 / (v + 1)
            for k in range(level):
                w = weights[k](bucket(h[k]))
                lower = w * c[k] / max(h[k], 1) + (1 - w) * lower
            by_bucket.setdefault(bucket(h[level]), []).append(c[level] / max(h[level], 1) / lower)

        def fit(ratios):
            weight, r = 0.5, np.array(ratios)
            for _ in range(60):
                weight = min(interpolation.MOST_WEIGHT, float((weight * r / (weight * r + 1 - weight)).mean()))
            return weight

        seen = [r for b, rs in by_bucket.items() if b for r in rs]
        table, rest = {b: fit(rs) for b, rs in by_bucket.items()}, fit(seen) if seen else 0.5
        weights.append(lambda b, table=table, rest=rest: 0.0 if b == 0 else table.get(b, rest))
    return weights


def test_scores_equal_a_plain_count(spark):
    r = random.Random(8)
    words = ["".join(r.choice("abcdeABé") for _ in range(r.randint(1, 3))) for _ in range(40)]
    texts = [" ".join(r.choice(words[: 1 + k % 40]) for _ in range(r.randint(0, 60))) for k in range(150)]
    rows = [*enumerate(texts), (3, texts[3]), (3, texts[3]), (None, texts[9]), (200, None), (201, ""), (202, " \t\n"), (203, "unseen words only"), (204, texts[5])]
    docs = spark.createDataFrame([(x, t, 1) for x, t in rows], "doc_id long, text string, slice int").repartition(3)
    train = F.col("doc_id") % 4 != 1  # null for the null id: not trained on
    held = Counter((x.doc_id, x.text) for x in docs.where(train & (F.pmod(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), F.lit(interpolation.HELD_PART)) == 0)).select("doc_id", "text").collect())
    trained = [(x, t) for x, t in rows if x is not None and x % 4 != 1]
    assert held
    all_, left = counted([t for _, t in trained]), counted([t for x, t in trained if (x, t) not in held])
    v = len(all_[0][0])
    weights = weights_of([e for x, t in trained if (x, t) in held for e in tokens_of(t, left)], v, left[2])
    want = []
    for x, t in rows:
        known, base, score, size = 0, 0.0, 0.0, 0
        for c, h in tokens_of(t, all_):
            p = 1 / (v + 1)
            for k in range(3):
                w = weights[k](bucket(h[k]))
                p = w * c[k] / max(h[k], 1) + (1 - w) * p
            known, size, score, base = known + (c[0] > 0), size + 1, score + math.log10(p), base + math.log10((c[0] + 1) / (all_[2] + v + 1))
        want.append((x is not None, x or 0, size, known, round(base, 6), score))
    for options in ({}, {"slice_tokens": 300, "bucket_requests": 700}):
        got = interpolation.lm_scores(docs, train, **options).collect()
        assert all(g.train_tokens == all_[2] for g in got)
        got = sorted((g.doc_id is not None, g.doc_id or 0, g.n_tokens, g.n_known, round(g.base_score, 6), g.score) for g in got)
        assert [g[:5] for g in got] == [w[:5] for w in sorted(want)]
        # the operator counts ratios of estimates by steps of a sixteenth of an octave
        assert all(abs(a[5] - b[5]) <= 0.01 * abs(b[5]) for a, b in zip(got, sorted(want), strict=True))


def test_no_training_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = interpolation.lm_scores(docs, F.lit(False)).orderBy("doc_id").collect()
    assert [(g.n_tokens, g.n_known, g.train_tokens, g.base_score, g.score) for g in got] == [(3, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)]
    assert interpolation.lm_scores(docs.limit(0), F.lit(True)).count() == 0


def test_expectation_maximisation_finds_the_mixture():
    r = np.random.default_rng(1)
    events = np.zeros((interpolation.COUNT_BUCKETS, interpolation.RATIO_BINS))
    upper = r.random(40_000) < 0.6  # each source is sixteen times as likely to give its own tokens
    bins = interpolation.ratio_bin(np.where(np.where(r.random(40_000) < 16 / 17, upper, ~upper), 16.0, 1 / 16))
    np.add.at(events[5], bins, 1)
    weights = interpolation.expectation_maximisation(events)
    assert abs(weights[5] - 0.6) < 0.03 and weights[0] == 0 and weights[9] == pytest.approx(weights[5])
    assert interpolation.expectation_maximisation(0 * events)[3] == 0.5


def test_ratio_bins():
    assert interpolation.ratio_bin(np.array([0.0, 1.0, 2.0, 0.5])).tolist() == [0, 1025, 1041, 1009]
