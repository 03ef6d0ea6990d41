"""The ten operators on small awkward tables, each against a brute-force version, and the pipeline."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewell.llm import bpe, cap_filters, components, decontaminate, interpolation, language, licenses, line_dedup, minhash, suffix_dedup, token_store
from tidewell.llm import queries as q

random.seed(5)
WORDS = ["".join(random.choice("abcdefghijklmnop") for _ in range(random.randint(2, 7))) for _ in range(300)]
LONG = " ".join(random.choice(WORDS) for _ in range(60))
SCHEMA = "doc_id long, text string, lang string, score double, n_removed int, node long, label string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


TEXTS = [
    LONG, LONG, LONG + "\n" + prose(1, 40), prose(2, 30) + "\n" + LONG + "\nshort", None, "", "   ", "!!! ---", "é ü ß 日本語 ünïcode", "one", "a b c", "x" * 700, "ab" * 400,
    prose(3, 400), prose(3, 400).replace(" ", "  "), "Line one of the text has enough words to be counted here\n" * 5, "tab\tnewline\n\n\nend", LONG[:150] + prose(4, 30) + LONG[150:],
    "This work is licensed under the GNU General Public License, version 3. CC BY-NC, all rights reserved; cc by", prose(5, 3000),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "xx", 0.5, 7, 1, "l") for k, t in enumerate(TEXTS)]
    rows += [(None, LONG, None, None, None, None, None), (3, TEXTS[3], "xx", 0.5, 7, 1, "l"), (3, TEXTS[3], "xx", 0.5, 7, 1, "l"), (2, prose(9, 50), None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def listed(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# --- 7


def test_bpe_equals_the_library_and_decodes(docs, nothing):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.ids, r.decoded) for r in bpe.bpe_encode(docs, path, pattern).collect())
    want = sorted((x if x is not None else -1, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for x, t in listed(docs))
    assert [(a, bytes(b), bytes(c)) for a, b, c in got] == want
    assert bpe.bpe_encode(nothing, path, pattern).count() == 0


# --- 3


def test_boundaries_select_every_offset():
    for ends in ([], [0], [1, 1, 1, 5], list(range(0, 4000, 7)), [0, 0, 10**9], sorted(random.randrange(10**6) for _ in range(1000))):
        code = token_store.Boundaries.of(np.array(ends, np.int64))
        assert [code.select(k) for k in range(len(ends))] == ends
    with pytest.raises(IndexError):
        code.select(len(ends))


def awkward_texts():
    """Letters that change under normal forms and lower case, marks alone, special tokens, in random order."""
    r = random.Random(1)
    parts = [*"aAbBéÉİıßſŉǅΣςσﬁﬀ\u093c\u0915\u0958ะำ가각ㄱ\u0301\u0308\u0307 \n\t  .,,'s-1٣½²!日本🙂ẞ\u212b\u0345", "e\u0301", "o\u0308", "İ.", "İ,", "'s", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>"]
    return ["".join(r.choice(parts) for _ in range(r.randint(1, 12))) for _ in range(3000)] + ["<|endoftext|>", "İ.", "İ,"]


def test_token_blocks_come_back_in_order(spark, docs, nothing, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK_IDS", 200)
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    docs = docs.union(spark.createDataFrame([(900 + k, t, *[None] * 5) for k, t in enumerate(awkward_texts())], docs.schema))
    for number, table in enumerate((docs, nothing)):
        out = str(tmp_path / f"blocks{number}")
        token_store.write_blocks(token_store.encode_ids(table, path, 2, token_store.shard_bounds(table, 3)), out, 3)
        got = token_store.read_blocks(spark, out).orderBy("start").collect()
        want = sorted(((x is not None, x or 0), library.encode(t or "", add_special_tokens=False).ids + [2]) for x, t in listed(table))
        assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((*k, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for k, i in want)
        assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == [k for k, _ in want]
        assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()


# --- 2


def by_brute_force(rows, length):
    order = sorted({(x is not None, x or 0, t or "") for x, t in rows}, key=lambda r: (r[0], r[1]))
    seen, out = {}, {}
    for r in order:
        raw, cover = r[2].encode(), np.zeros(len(r[2].encode()) + 1, int)
        for i in range(len(raw) - length + 1):
            if raw[i : i + length] in seen:
                cover[i] += 1
                cover[i + length] -= 1
            seen.setdefault(raw[i : i + length], r)
        gone = np.cumsum(cover[:-1]) > 0
        out[r] = (len(raw), int(gone.sum()), bytes(np.frombuffer(raw, np.uint8)[~gone]))
    return out


@pytest.mark.parametrize("hot", [4000, 1])
def test_suffix_dedup_removes_what_came_before(spark, docs, nothing, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_SEGMENTS", hot)
    rows = [r for r in listed(docs) if r != (2, prose(9, 50))]
    table = docs.where(~(F.col("doc_id").eqNullSafe(2) & F.col("lang").isNull()))
    want = by_brute_force(rows, 100)
    got = suffix_dedup.suffix_dedup(table, 100).collect()
    assert len(got) == len(rows)
    kept = Counter((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in got)
    assert kept == Counter((x, *want[x is not None, x or 0, t or ""]) for x, t in rows)
    assert suffix_dedup.suffix_dedup(nothing, 100).count() == 0


def test_loser_tree_merges_front_coded_runs():
    length, runs, flat = 6, [], []
    for r in range(5):
        strings = sorted({"".join(random.choice("ab") for _ in range(length)).encode() for _ in range(random.randint(1, 20))})
        shared, rest = suffix_dedup.front_code(np.array(strings, f"S{length}"), length)
        runs.append((shared.tolist(), rest))
        flat += [(s, r, k) for k, s in enumerate(strings)]
    got = list(suffix_dedup.merge_runs(runs, length))
    flat.sort()
    assert [(r, k) for r, k, _ in got] == [(r, k) for _, r, k in flat]
    assert [e for *_, e in got] == [k > 0 and flat[k][0] == flat[k - 1][0] for k in range(len(flat))]


# --- 10


def lines_by_brute_force(rows, least):
    order = sorted({(x is not None, x or 0, t or "") for x, t in rows})
    places = [(r, p, line) for r in order for p, line in enumerate(r[2].split("\n"))]
    gone = set()
    for j in range(len(places)):
        for i in range(j):
            n = 0
            while j + n < len(places) and places[i + n][2] == places[j + n][2] and places[i + n][0] == places[i][0] and places[j + n][0] == places[j][0]:
                n += 1
            if sum(1 + len(places[j + k][2].replace(" ", "")) // 5 for k in range(n)) >= least:
                gone.update((places[j + k][0], places[j + k][1]) for k in range(n))
    return {r: [line for p, line in enumerate(r[2].split("\n")) if (r, p) not in gone] for r in order}


def test_line_dedup(spark, nothing):
    a, b, c = "first line of seven words is here", "second", "third one"
    rows = [(1, f"{a}\n{b}\n{c}"), (2, f"x y\n{a}\n{b}\nz"), (3, f"{b}\n{c}\n{a}"), (4, None), (5, ""), (6, ""), (None, a), (7, "\n".join([a, b] * 4)), (7, "\n".join([a, b] * 4)), (8, f"{b}\n{b}\n{b}")]
    extra = {c: F.lit(c) for c in ("id", "copy", "pos", "name", "n", "first")}
    docs = spark.createDataFrame([(x, t, 1) for x, t in rows], "doc_id long, text string, n_removed int").withColumns(extra)
    for least in (1, 5, 12):
        want = lines_by_brute_force(rows, least)
        got = line_dedup.line_dedup(docs, least)
        assert got.columns == ["doc_id", "text", *extra, "n_lines", "n_removed"]
        assert all(r.id == "id" and r.copy == "copy" for r in got.collect())
        assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter((x, None if t is None else "\n".join(want[x is not None, x or 0, t or ""])) for x, t in rows)
    assert line_dedup.line_dedup(nothing).count() == 0


# --- 1, components


def tokens(text):
    return re.findall("[0-9a-z\u0080-\U0010ffff]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def grams(text):
    w = tokens(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else ({text} if text else set())


def test_near_duplicates_are_the_connected_parts(spark, nothing):
    base = prose(11, 200).split()
    rows = [(1, " ".join(base)), (2, " ".join(base).upper()), (3, " ".join([*base[:100], "new", *base[100:]])), (4, prose(12, 200)), (5, None), (6, ""), (7, "!!"), (8, "!!"), (9, "one two"), (10, "One  two"), (None, " ".join(base)), (4, prose(12, 200)), (11, " ".join(base[:-30]))]
    rows += [(100 + k, " ".join([*base[:k], "changed", *base[k + 1 :]])) for k in range(0, 200, 4)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets, parent = [grams(t) for _, t in rows], list(range(len(rows)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for j in range(len(rows)):
        for i in range(j):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[top(j)] = top(i)
    least = {}
    for k, (x, _) in enumerate(rows):
        least.setdefault(top(k), []).append((x is not None, x or 0))
    want = Counter((x, (lambda m: m[1] if m[0] else None)(min(least[top(k)])) if sets[k] else x) for k, (x, _) in enumerate(rows))
    assert Counter((r.doc_id, r.class_id) for r in found) == want
    assert {r.doc_id for r in found if r.kept} == {None, 4, 5, 6, 7, 9}
    assert minhash.near_duplicates(nothing).count() == 0


def test_recall_on_a_whole_table(spark):
    """All pairs of the table by exact Jaccard: at least nine in ten links, and no others."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: grams(r.text) for r in docs.select("doc_id", "text").collect()}
    place = {}
    for x, s in sets.items():
        for g in s:
            place.setdefault(g, []).append(x)
    shared = Counter((a, b) for xs in place.values() for i, b in enumerate(xs) for a in xs[:i])
    links = {p for p, n in shared.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n)}
    found = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    joined = sum(found[a] == found[b] for a, b in links)
    assert links and joined >= 0.9 * len(links)
    classes = Counter(found.values())
    linked = {x for p in links for x in p}
    assert all(classes[found[x]] == 1 for x in found if x not in linked)


def test_registers_estimate_probability_jaccard():
    shared = minhash.mix64(np.arange(1, 161, dtype=np.uint64))
    x, y = shared[:120], shared[40:]
    rows = np.repeat([0, 1], 120)
    held = minhash.prob_minhash(rows, np.concatenate([x, y]), np.ones(240), 2, 2000)
    assert abs((held[0] == held[1]).mean() - 0.5) < 0.06


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
    assert components.components(links.limit(0)).count() == 0


# --- 5


def test_decontamination_finds_moved_passages(spark, docs, nothing):
    item = prose(21, 40).split()
    moved = " ".join([*item[20:], *prose(22, 30).split(), *item[:20]])
    benchmark = spark.createDataFrame([(1, " ".join(item)), (2, "too short"), (3, None), (4, prose(23, 40))], "item_id long, text string")
    rows = [(1, " ".join(item).upper()), (2, moved), (3, " ".join(item[:8])), (4, None), (5, ""), (6, prose(24, 300)), (2, moved)]
    got = decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()
    assert sorted((r.doc_id, r.item_id, r.n_tiles, r.coverage) for r in got) == [(1, 1, 1, 1.0), (2, 1, 2, 1.0), (2, 1, 2, 1.0)]
    assert decontaminate.contamination(nothing, benchmark).count() == decontaminate.contamination(docs, benchmark.limit(0)).count() == 0


# --- 8


def test_license_scan(docs, nothing):
    got = {(r.doc_id, r.n_words): r for r in licenses.license_scan(docs).collect()}
    for x, t in listed(docs):
        words = re.findall(licenses.WORD, (t or "").translate({c: c + 32 for c in range(65, 91)}))
        starts = [k for p in licenses.BASE for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = got[x, len(words)]
        assert (r.n_base, r.first_word, r.last_word) == (len(starts), min(starts, default=None), max(starts, default=None))
    assert got[18, 20].base_labels == "cc-by,gpl,reserved" and got[18, 20].labels == "cc-by,gpl,gpl-3.0,reserved"
    assert got[0, 60].labels == "" and got[0, 60].score == 0.0
    assert licenses.license_scan(nothing).count() == 0


# --- 6


def test_scores_and_base(spark, docs, nothing):
    train = F.coalesce(F.col("doc_id") % 3 != 1, F.lit(True))
    got = interpolation.lm_scores(docs, train).collect()
    split = lambda t: [*re.findall("[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)})), None]
    counts = Counter(w for x, t in listed(docs) if x is None or x % 3 != 1 for w in split(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((x if x is not None else -1, len(split(t)), sum(counts[w] > 0 for w in split(t)), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in split(t)), 6)) for x, t in listed(docs))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 for r in got)
    assert interpolation.lm_scores(nothing, train).count() == 0


# --- 9


def test_language_by_held_out_accuracy(spark, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.learn(docs, ~language.held_out(), per_language=60)
    rows = language.predict(docs.withColumn("score", F.lit(7)), model, keep=["doc_id", "lang", "score"]).where(language.held_out()).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.9 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !"), (4, "x")], "doc_id long, text string")
    assert {r.doc_id for r in language.predict(odd, model, keep=["doc_id"]).where("lang_pred = 'und' AND score = 0").collect()} == {1, 2, 3}
    empty = language.learn(nothing, F.lit(True))
    assert {r.lang_pred for r in language.predict(odd, empty, keep=[]).collect()} == {"und"}
    assert language.predict(nothing, model, keep=["doc_id"]).count() == 0


def test_language_sample_counts_texts_not_copies(spark, monkeypatch):
    copies = spark.range(200_000).select(F.lit("aa").alias("lang"), F.concat(F.lit("copied text "), (F.col("id") % 40).cast("string")).alias("text"))
    docs = copies.union(spark.createDataFrame([("bb", "only one text")], "lang string, text string")).withColumn("doc_id", F.lit(1))
    monkeypatch.setattr(language, "fit", lambda sample, **_: Counter(lang for lang, _ in set(sample)))
    assert language.learn(docs, F.lit(True), per_language=4) == {"aa": 4, "bb": 1}
    assert language.learn(docs, F.lit(True), per_language=50) == {"aa": 40, "bb": 1}


# --- 4


def test_vector_links(spark):
    r = np.random.default_rng(3)
    centres = r.standard_normal((40, 16))
    rows = [(k, (centres[k % 40] + 0.12 * r.standard_normal(16)).tolist()) for k in range(400)]
    rows += [(500, rows[0][1]), (501, rows[0][1]), (502, None), (503, [0.0] * 16), (504, [float("nan")] * 16), (505, [None] * 16), (506, []), (507, [1.0, 2.0]), (508, [2.0, 4.0]), (None, rows[5][1]), (0, rows[0][1]), (509, [1e200, 2e200]), (510, [-1e-200, 3e-200])]
    got = cap_filters.cap_links(spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<double>, n_links int")).collect()
    good = [(x, np.array(v) / abs(np.array(v)).max()) for x, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    want, wanted = Counter(), Counter((r.vec_id, r.n_links) for r in got)
    for k, (x, v) in enumerate(good):
        want[x, sum(j != k and len(u) == len(v) and u @ v >= 0.9 * np.linalg.norm(u) * np.linalg.norm(v) for j, (_, u) in enumerate(good))] += 1
    want += Counter((x, 0) for x, v in rows if not (v and None not in v and np.isfinite(v).all() and np.any(v)))
    assert wanted == want
    alone = {r.vec_id: (r.component_id, r.kept) for r in got}
    assert alone[503] == (503, True) and alone[501] == (0, False) and alone[508] == (507, False)
    assert cap_filters.cap_links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# --- pipeline and SQL


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = pipeline.known_language(spark, docs, sf_dir)
    assert known.columns == docs.columns and known.count() > 0.95 * docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = lines_by_brute_force(list(texts.items()), 5)
    cut = {r.doc_id: r.text for r in pipeline.without_repeated_lines(spark, docs, sf_dir).collect()}
    left = {x: "\n".join(k) for (_, x, _), k in want.items() if k}
    assert cut == {x: t for x, t in left.items() if len(t) == len(texts[x]) or len(t) >= 0.1 * len(texts[x])}
    benchmark = [tokens(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    held = {x for x, t in texts.items() if any(" ".join(b) in " ".join(tokens(t)) for b in benchmark)}
    clean = {r.doc_id for r in pipeline.without_benchmark(spark, docs, sf_dir).collect()}
    assert not clean & held and len(clean) >= len(texts) - len(held)
    kept = pipeline.without_near_duplicates(spark, docs.union(docs.limit(3)), sf_dir)
    assert kept.count() == kept.select("doc_id").distinct().count() == minhash.near_duplicates(docs).select("class_id").distinct().count()
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", None, None, None), (2, "", None, None, None), (None, "a line that is long enough to count here\nb", "en", "s", 3), (4, "x", "en", "s", 1)], docs.schema).withColumn("__own", F.lit(1)).withColumn("copy", F.lit("c"))
    for name, stage in pipeline.STAGES[1:4]:
        got = stage(spark, odd, sf_dir)
        assert got.columns == odd.columns and got.count() == (4 if name == "minhash" else 5), name
        assert stage(spark, odd.limit(0), sf_dir).count() == 0
    assert pipeline.known_language(spark, odd.limit(0), sf_dir).count() == pipeline.token_ids(spark, odd.limit(0), sf_dir).count() == 0
    out = pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    row = pipeline.token_ids(spark, docs, sf_dir).where("doc_id = 0").first()
    assert row.decoded_sha256 == hashlib.sha256(texts[0].encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    sf_dir, con = "/root/testdata/sf0.001", duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    df = q.QUERIES[name](spark, sf_dir)
    want = con.sql(q.ORACLE_SQL[name])
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=repr)
