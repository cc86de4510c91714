from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxtable.llm import bpe_roundtrip, token_count
from voxtable.llm.common import tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
MODEL = tokenizer(PATH)
ROWS = [
    (1, None), (2, ""), (3, " \t\n"), (4, "The  THE\x0bthe\x1cthe the x"), (5, "it's we'll''ll <|endoftext|>a<|startoftext|> b<|endof text|>"), (6, "é ́e ﬁ İ ß ΑΣ Σ"), (None, "no id"), (7, "twice"), (7, "twice"),
    (8, "word " * 9000), (9, "ab" * 1500 + " " + "x" * 700 + "'s" * 400), (10, "東京都" * 500), (11, "a1!b2?'ll" * 300), (12, "\U0001f600" * 600), (13, " " * 3), (14, "zZ" * 9000),
]


def library(text):
    ids = MODEL.encode(text or "", add_special_tokens=False).ids
    return ids, MODEL.decode(ids, skip_special_tokens=False)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in ROWS], "doc_id bigint, text string, n_tokens string, known int")


@pytest.mark.parametrize("huge, chunk, overlap", [(65_536, 16_384, 256), (20, 40, 4), (0, 7, 1)])
def test_counts_are_the_library_s(docs, huge, chunk, overlap):
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in token_count.token_counts(docs, PATH, huge=huge, chunk=chunk, overlap=overlap).collect())
    assert got == sorted((i or -1, len((t or "").encode()), len(library(t)[0])) for i, t in ROWS)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab'slrev 12!?é́\n <|endoftx>", max_size=90), st.integers(3, 30), st.integers(1, 9))
def test_spliced_chunks_and_joined_trees_are_exact(text, size, overlap):
    encode = lambda s: MODEL.encode(s, add_special_tokens=False)
    tokens, _ = token_count.spliced(encode, text, size, overlap, 15)
    assert [t[2] for t in tokens] == library(text)[0]
    for piece in text.split():
        found = bpe_roundtrip.tree(encode, lambda s: MODEL.encode_batch(s, add_special_tokens=False), piece, size, 15, overlap)
        assert [t[2] for t in found] == library(piece)[0]


def test_roundtrip_is_the_library_s(docs):
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.decoded) for r in bpe_roundtrip.bpe_roundtrip(docs, PATH, texts=True, unsplit=64).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(i or -1, len(library(t)[0]), sha(" ".join(map(str, library(t)[0]))), sha(library(t)[1]), library(t)[1]) for i, t in ROWS]
    assert got == sorted(want)


def test_empty_table(docs):
    assert token_count.token_counts(docs.limit(0), PATH).count() == 0
    assert bpe_roundtrip.bpe_roundtrip(docs.limit(0), PATH).count() == 0
