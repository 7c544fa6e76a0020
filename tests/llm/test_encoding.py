import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

tiktoken = pytest.importorskip("tiktoken")
public = pytest.importorskip("public_tokenizers")

from tessera.llm import encoding  # noqa: E402

PATH = encoding.default_vocabulary()
ENC = encoding.encoder(PATH)
REF = tiktoken.Encoding("reference", pat_str=public.PATTERN, mergeable_ranks=encoding.read_ranks(PATH), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(t):
    assert ENC.encode(t) == REF.encode_ordinary(t)


@settings(max_examples=300, deadline=None)
@given(st.text("abcdefghinorstuvwyz'ABC123 \t\n\r.,!?äéß中🚀\x1c\x85\xa0", max_size=80))
def test_likely_text(t):
    assert ENC.encode(t) == REF.encode_ordinary(t)


@pytest.mark.parametrize("t", ["", " ", "<|endoftext|>", "a" * 5000, " " * 999 + "x", "word " * 20000, "don't we'll I'VE", "é" * 50, "﻿‮‍", "𝔘𝔫𝔦"])
def test_edge_text(t):
    assert ENC.encode(t) == REF.encode_ordinary(t)


def test_null_is_empty():
    assert ENC.encode(None) == []


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(encoding, "KEPT_PAIRS", 50)
    monkeypatch.setattr(encoding, "KEPT_PIECES", 10)
    e = encoding.Encoder(PATH)
    t = " ".join(f"Name{i}xy" for i in range(300))
    assert e.encode(t) == REF.encode_ordinary(t)
    assert len(e.pieces) <= 10 and len(e.machine.pairs) <= 51


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.integers(1, 7))
def test_utf8_stream(data, step):
    m = encoding.Utf8Stream()
    got = "".join(m.feed(data[i : i + step]) for i in range(0, len(data), step)) + m.end()
    assert got == data.decode("utf-8", "replace")


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_decode_stream(t):
    assert "".join(encoding.decode_stream(ENC.encode(t), ENC.machine.bytes_of)) == t


def test_corpus_round_trip(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello wörld 🚀", "x"), (3, "Hello wörld 🚀", "x"), (4, "long " * 50_000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids2 string")
    got = encoding.decode_corpus(encoding.encode_corpus(df))
    assert got.columns == ["doc_id", "text", "ids2", "ids", "decoded"]
    for r in got.collect():
        assert list(r["ids"]) == ([] if not r["text"] else REF.encode_ordinary(r["text"])) and r["decoded"] == (r["text"] or "")
    bad = encoding.decode_corpus(spark.createDataFrame([([99_999_999],), (None,)], "ids array<int>")).collect()
    assert [r["decoded"] for r in bad] == ["�", None]
    assert encoding.encode_corpus(spark.createDataFrame([], "text string")).count() == 0
    assert np.dtype("int32")


def test_long_pieces_are_streamed():
    machine = encoding.encoder(encoding.default_vocabulary()).machine
    r = random.Random(4)
    for data in (b"a" * 9_000, bytes(r.choice(b"abcdefgh") for _ in range(6_000)), b" " * 5_000, ("é漢字" * 900).encode(), bytes(r.choice(b"=-_*#") for _ in range(5_000))):
        whole = machine.merged(data[:1_500])
        assert list(machine.stream(data[:1_500], every=64)) == whole == list(machine.encode(data[:1_500]))
        ids = list(machine.stream(data))
        assert b"".join(machine.bytes_of[i] for i in ids) == data and ids == list(machine.stream(data, every=100))
        # ids come before the piece has ended
        seen = 0
        ahead = machine.stream((seen := k) and c or c for k, c in enumerate(data))
        next(ahead)
        assert seen < 2_000


def test_decoding_in_portions():
    of = {0: "é".encode()[:1], 1: "é".encode()[1:], 2: b"ab", 3: b"\xff", 4: "漢".encode()[:2]}
    assert list(encoding.decode_stream([2, 0, 1, 2], of)) == ["ab", "é", "ab"]
    assert "".join(encoding.decode_stream([4, 2, 3, 9, 0], of)) == "�ab���"
