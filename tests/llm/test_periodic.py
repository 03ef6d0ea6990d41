"""Periodic runs against comparing the words at every distance, and the query against the contract written out."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidewell.llm import periodic
from tidewell.llm import queries as q


def brute(w, least=6, exponent=4):
    found = {}
    for d in range(1, len(w) // exponent + 1):
        i = 0
        while i + d < len(w):
            s = i
            while i + d < len(w) and w[i] == w[i + d]:
                i += 1
            if i > s and i - s + d >= max(least, exponent * d):
                found.setdefault((s, i - s + d), d)
            i += 1
    return sorted((s, n, d) for (s, n), d in found.items())


def some_words(r: random.Random) -> list[int]:
    k, out = r.choice([1, 2, 2, 3, 5]), []
    for _ in range(r.randint(0, 6)):
        out += ([r.randint(1, k) for _ in range(r.randint(1, 9))] * r.randint(1, 8))[: r.randint(1, 60)]
    return out * r.choice([1, 1, 1, 4])


def test_runs_equal_brute_force():
    r = random.Random(1)
    for _ in range(2500):
        w, exponent = some_words(r), r.choice([3, 4, 4, 5])
        assert periodic.find_runs(np.array(w, np.int64), 6, exponent) == brute(w, 6, exponent), w


def test_transforms_count_differences_exactly():
    rng = np.random.default_rng(2)
    for size, top in ((1, 3), (8, 3), (64, 2), (64, 10**6), (512, 4 * 10**8)):
        ids = rng.integers(1, top, 6 * size)
        ids[3 * size : 4 * size] = ids[size : 2 * size]
        starts = np.arange(0, 4 * size + 1, size)
        got = set(zip(*(x.tolist() for x in periodic.occurrences(ids, starts, size)), strict=True))
        assert got == {(s, d) for s in starts.tolist() for d in range(size, 2 * size) if s + d + size <= len(ids) and (ids[s : s + size] == ids[s + d : s + d + size]).all()}


def test_long_and_highly_periodic_texts_stay_cheap():
    for w in (np.ones(100_000, np.int64), np.where(np.arange(100_000) % 997 == 0, 2, 1), np.tile(np.arange(1, 50_001), 4)):
        runs = periodic.find_runs(w)
        assert runs and all(n >= max(6, 4 * p) for _, n, p in runs)
    with pytest.raises(ValueError):
        periodic.periodic_runs(None, exponent=2)


def test_operator_and_query(spark, tmp_path):
    r = random.Random(7)
    texts = ["", None, "   ", "one", "a a a a a a", "x y " * 9 + "z", "é ü\x0btab\tend", "a\x1cb " * 7, " ".join(f"w{k}" for k in range(900))]
    texts += [" ".join(f"v{x}" for x in some_words(r)) for _ in range(120)] + [" ".join(f"u{r.randint(1, 60)}" for _ in range(r.randint(1, 400))) for _ in range(120)]
    rows = [(k, t, "x", 5) for k, t in enumerate(texts)] + [(None, "b b b b b b b", None, None)] + [(5, texts[5], "x", 5)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc_id, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        numbers = {w: k for k, w in enumerate(dict.fromkeys(words))}
        runs = brute([numbers[w] for w in words])
        gone = {i for s, m, d in runs for i in range(s + d, s + m)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        s, m, d = min(((s, m, d) for s, m, d in runs), key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        listed = "".join(f"{s},{m},{d}\n" for s, m, d in sorted(runs, key=lambda x: (x[0], x[2])))
        want.append((doc_id, len(runs), s, m, d, None if d is None else 1000 * m // d, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    got = [tuple(x) for x in q.op11_periodic(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(x[1] > 0 for x in want) > 60
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
