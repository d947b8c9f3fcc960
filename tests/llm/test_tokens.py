import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from darb.llm import tokens as tk

pytestmark = pytest.mark.skipif(not os.path.exists(tk.BYTE_BPE), reason="no vocabulary")


@pytest.fixture(scope="module")
def t():
    return tk.tokenizer(tk.BYTE_BPE)


def joined(t, text):
    return tk.join_chunks(t, (tk.encode_chunk(t, c) for c in tk.chunks(text)))


@pytest.mark.parametrize("least,most,bits", [(1, 3, 1), (2, 10, 2), (5, 40, 3), (64, 4096, 8)])
def test_joints_are_repaired_exactly(t, monkeypatch, least, most, bits):
    monkeypatch.setattr(tk, "MIN_CHUNK", least)
    monkeypatch.setattr(tk, "MAX_CHUNK", most)
    monkeypatch.setattr(tk, "CUT_BITS", bits)
    parts = ["'", "s", "ll", "'ll", "'re", " ", "  ", "\n", "\t", "a", "é", "م", "1", "99", "-", "…", "‍", "🏽", "word", "don't", "   ", "　", "<|endoftext|>"]
    rng = random.Random(least)
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(150)))
        assert joined(t, text) == t.whole(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=400))
def test_any_text(text):
    t = tk.tokenizer(tk.BYTE_BPE)
    assert joined(t, text) == t.whole(text)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=3000))
def test_chunks_are_the_text(text):
    assert "".join(tk.chunks(text)) == text


def test_chunks_depend_on_content():
    rng = random.Random(1)
    shared = "".join(rng.choice("abcdefghij klmno") for _ in range(5000))
    a, b = set(tk.chunks("intro " + shared)), set(tk.chunks("quite another beginning, longer " + shared))
    assert len(a & b) >= len(a) - 3


def test_long_pieces_and_long_texts(t):
    for text in ("x" * 20_000, " " * 20_000 + "a", "ab " * 30_000, "é" * 9000, "1" * 9000 + "'s"):
        assert joined(t, text) == t.whole(text)


def test_small_numbers_in_store():
    assert tk.unpack(tk.pack([1, 255])) == [1, 255] and tk.unpack(tk.pack([1, 256, 16384])) == [1, 256, 16384] and tk.unpack(tk.pack([])) == []


def test_corpus_rules(spark, t):
    hot = "The same passage stands in very many documents, word for word. " * 9
    rows = [(1, None), (2, ""), (3, " \n"), (4, "hello world"), (4, "hello world"), (None, "no id"), (5, "<|endoftext|>"), (6, "a" * 100_000)] + [(100 + k, hot + str(k)) for k in range(200)]
    df = spark.createDataFrame([(i, x, b"d", 3, "c") for i, x in rows], "doc_id bigint, text string, digest binary, seq int, chunk string").repartition(5)
    got = sorted(((r.doc_id, list(r.ids)) for r in tk.encode_corpus(df).collect()), key=repr)
    assert got == sorted(((i, t.whole(x or "")) for i, x in set(rows)), key=repr)
    assert tk.encode_corpus(df.limit(0)).count() == 0


def test_hot_chunks_are_salted(spark, t, monkeypatch):
    monkeypatch.setattr(tk, "HOT_ROWS", 5)
    monkeypatch.setattr(tk, "HOT_SHARE", 10)
    hot = "Boilerplate that every document has at its head, long enough to be a chunk of its own. " * 8
    rows = [(k, hot + f"and then {k}") for k in range(60)]
    got = {r.doc_id: list(r.ids) for r in tk.encode_corpus(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: t.whole(x) for i, x in rows}


def test_unbroken_text_joins_in_linear_time(t):
    """Each chunk's encoding is asked for once, and a text without a piece boundary is split a few times over, not once a chunk."""
    text = "abcdefghij" * 60_000
    split, seen = t.pieces, []
    t.pieces = lambda x: seen.append(len(x)) or split(x)
    try:
        parts = [tk.encode_chunk(t, c) for c in tk.chunks(text)]
        seen.clear()
        assert tk.join_chunks(t, iter(parts)) == t.whole(text)
    finally:
        del t.pieces
    assert sum(seen) < 5 * len(text)


def test_parts_are_the_text_and_name_repeated_chunks(spark):
    rng = random.Random(2)
    shared = "".join(rng.choice("abcdefghij klmno") for _ in range(4000))
    rows = [(k, f"{k} " + "".join(rng.choice("pqrstuv wxyz") for _ in range(2000)) + (shared if k % 3 == 0 else "")) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    bitmap, bits = tk.repeated_chunks(df.select("text"))
    names = 0
    for k, text in rows:
        parts = tk.text_parts(text, bitmap, bits)
        assert "".join(p for p, _ in parts) == text
        names += sum(d is not None for _, d in parts)
        assert (len([d for _, d in parts if d]) > 3) == (k % 3 == 0)
    assert names and len(bitmap) * 8 == bits


def test_a_full_bitmap_changes_nothing(spark, t, monkeypatch):
    monkeypatch.setattr(tk, "repeated_chunks", lambda texts: (b"\xff" * (tk.SEGMENT_BITS // 8), tk.SEGMENT_BITS))
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(["bus", "stop", "l'école", "مدرسة", "12", "…"]) for _ in range(rng.randrange(300)))) for k in range(40)]
    got = {r.doc_id: list(r.ids) for r in tk.encode_corpus(spark.createDataFrame(rows * 2, "doc_id bigint, text string")).collect()}
    assert got == {i: t.whole(x) for i, x in rows}
