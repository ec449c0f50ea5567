import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lingoloom.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def own():
    return bpe.codec(PATH, PATTERN)


def test_tree_equals_the_library_on_small_leaves(own, monkeypatch):
    monkeypatch.setattr(bpe, "LEAF", 5)
    monkeypatch.setattr(bpe, "WINDOW", 2)
    rnd = random.Random(1)
    parts = ["a", " ", "  ", "\n", "'", "ll", "é", "ß", "12", "!", "...", "漢", "\x1c", "😀", "the ", "\t", "\r\n", "\x85", "　"]
    for _ in range(4000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 50)))
        ids = own.encode(text)
        assert ids == own.library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_any_text_comes_back(text):
    own = bpe.codec(PATH, PATTERN)
    assert own.encode(text) == own.library.encode_ordinary(text) and own.decode(own.encode(text)).decode() == text


def test_long_runs_and_texts(own):
    for text in ("a" * 50_000, " " * 50_000, "word " * 20_000, "\n" * 20_000 + "x", "x!" * 30_000):
        assert own.encode(text) == own.library.encode_ordinary(text)


def test_columns_nulls_and_clashing_names(spark, own):
    df = spark.createDataFrame([(1, "some text", "n"), (2, None, "n"), (3, "", None), (1, "some text", "n")], "doc_id long, text string, n_tokens string")
    out = bpe.encode(df, PATH, PATTERN, outputs=("tokens", "n_tokens", "ids_sha256", "decoded_sha256", "decoded"))
    rows = sorted(out.collect(), key=lambda r: (r.doc_id, r.n_tokens))
    assert [r.n_tokens for r in rows] == [2, 2, 0, 0]
    assert rows[0].ids_sha256 == hashlib.sha256(np.array(own.library.encode_ordinary("some text"), "<u4").tobytes()).hexdigest()
    assert rows[2].decoded_sha256 == hashlib.sha256(b"").hexdigest() and rows[0].decoded == b"some text"
    assert bpe.decode(out.drop("decoded"), PATH, PATTERN).where("decoded = cast('some text' as binary)").count() == 2
    assert bpe.encode(df.limit(0), PATH, PATTERN).count() == 0
