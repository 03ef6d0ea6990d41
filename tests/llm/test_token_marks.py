"""Words with punctuation after them are put together from both and equal the library's plain call."""

from __future__ import annotations

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidewell.llm import token_store


def test_punctuation_after_words_is_no_chunk_of_its_own(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, library, asked = token_store.ChunkEncoder(path, 2), Tokenizer.from_file(path), []
    others = encoder._others
    monkeypatch.setattr(encoder, "_others", lambda chunks: (asked.extend(chunks), others(chunks)))
    marks = [*(chr(c) for c in range(33, 127) if not chr(c).isalnum()), "###", "!!", ",%%%", "'.", ".'", "<|", "|>", "'"]
    texts = [" ".join(f"{w}{m}" for m in marks) for w in ("Nation", "ménté", "it's", "x1", "Straße", "éte", "don't", "ſ", "İ")]
    texts += ["word's'", "a<|endoftext|>b!!", "́!!", "word≠ ≮", "'s's", "", "!!word!!"]
    got = [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(texts, b"")]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert not [c for c in asked if c.rstrip(token_store.MARKS) in (b"nation", "ménté".encode())]
