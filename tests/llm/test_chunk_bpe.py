"""Chunked BPE against the library called on whole texts."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidewell.llm import chunk_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", " ", "  ", "\n", "'", "'s", "'re", "ll", "é", "日本", "1", "23", "!", "?!", "\t", "　", "word", " the", "<|endoftext|>", "<|endof", "🙂", "\r\n", "'l"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts(n: int) -> list[str | None]:
    r = random.Random(3)
    made = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 120))) for _ in range(n)]
    return [*made, "a" * 5000, " " * 3000, "'" * 999, "\n " * 700, "x'" * 400, "'re" * 300, "日" * 900, None, "", "<|endoftext|>", "plain words " * 4000]


def test_joins_of_tiny_chunks_equal_the_library(library, monkeypatch):
    monkeypatch.setattr(chunk_bpe, "LEAST", 8)
    monkeypatch.setattr(chunk_bpe, "BITS", 3)
    monkeypatch.setattr(chunk_bpe, "WINDOW", 6)
    texts = odd_texts(800)
    for ids, text in zip(chunk_bpe.ChunkBpe(PATH).encode(pa.array(texts)), texts, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_cuts_depend_on_content_only():
    r = random.Random(4)
    passage = " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(3000)).encode()
    a, b = b"other beginnings, " * 20 + passage, b"x" * 333 + passage
    data = np.frombuffer(a + b, np.uint8)
    first, second = chunk_bpe.cuts(data, np.array([0, len(a), len(a) + len(b)]))
    shared = {a[i:j] for i, j in zip(first, first[1:], strict=False)} & {b[i:j] for i, j in zip(second, second[1:], strict=False)}
    assert sum(map(len, shared)) > 0.8 * len(passage)
    assert all(j - i >= chunk_bpe.LEAST for i, j in zip(first, first[1:], strict=False))


def test_whole_table_with_copies_and_odd_rows(spark, library):
    texts = [*odd_texts(40), *["shared passage of the corpus, long enough to be cut " * 60] * 5]
    rows = [(k if k % 7 else None, t, "x") for k, t in enumerate(texts)] + [(3, texts[3], "x")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(4)
    table = chunk_bpe.shared_chunks(docs.select("text"), PATH)
    assert table and len({c for c, *_ in table}) == len(table) and sum(len(c) for c, *_ in table) <= chunk_bpe.TABLE_BYTES
    for bound in (chunk_bpe.TABLE_BYTES, 200):  # a small table changes nothing
        got = chunk_bpe.chunk_encode(docs, PATH, table_bytes=bound).collect()
        want = [(i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t, _ in rows]
        have = [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in got]
        assert sorted(have, key=repr) == sorted(want, key=repr) and all(r.n_tokens == len(r.ids) // 4 for r in got)
    assert chunk_bpe.chunk_encode(docs.limit(0), PATH).count() == 0
