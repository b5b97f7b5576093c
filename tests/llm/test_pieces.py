"""Encoding and decoding against the library."""

import hashlib

import pytest

P = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from quillon.llm import pieces  # noqa: E402

PATH = P.path("piece_bpe_32k.model")
MODEL = pieces.model_of(open(PATH, "rb").read())
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab ▁\n.,é日", max_size=80))
def test_like_the_library(text):
    ids = MODEL.encode(text)
    assert ids == LIBRARY.encode(text)
    assert MODEL.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 31999) | st.integers(3, 258), max_size=12))
def test_any_ids_decode_like_the_library(ids):
    assert MODEL.decode(ids) == LIBRARY.decode(ids)


def test_long_run():
    text = "ab" * 50_000 + " " * 1000 + "\n" * 100
    assert MODEL.encode(text) == LIBRARY.encode(text)


def test_operator(spark):
    df = spark.createDataFrame([(1, "Hello  wörld", "x"), (2, None, "y"), (3, "", None), (3, "", None)], "doc_id long, text string, n_tokens string")
    got = {(r["doc_id"], r["n_tokens"], r["decoded"]): r for r in pieces.encode(df, PATH, keep=["doc_id"], results=["n_tokens", "ids", "decoded", "ids_sha256"]).collect()}
    ids = LIBRARY.encode("Hello  wörld")
    row = got[(1, len(ids), "Hello  wörld")]
    assert row["ids"] == ids and row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert (2, 0, "") in got and (3, 0, "") in got
    back = pieces.decode(spark.createDataFrame([(1, ids), (2, None)], "k int, ids array<int>"), PATH, keep=["k"]).collect()
    assert {r["k"]: r["decoded"] for r in back} == {1: "Hello  wörld", 2: ""}
    assert pieces.encode(df.limit(0), PATH, keep=["doc_id"]).count() == 0
