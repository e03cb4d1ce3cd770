import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scholarframe.llm import pieces
from scholarframe.llm.pieces import PieceEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
SHARED = PieceEncoder(PATH)


def check(texts, encoder=SHARED):
    ids, offsets = encoder.encode(pa.array(texts, pa.string()))
    for i, x in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == LIBRARY.encode(x or "", add_special_tokens=False).ids, x


def test_lookup_applies():
    assert SHARED.pieces


def test_plain_odd_and_empty_texts():
    check([
        None, "", " ", "Hello, World 2024!", "don't we'LL they're 'tis ''s 'x \"'s' a's b'd's 'reed I've", "'", "a'", "'s", "'r", "'l", "ÀÉÎ straße × ÷ ø",
        "tab\tnew\nline\x1cfs\x85next", "é", "İstanbul ΣΑΣ", "<|endoftext|> a <|startoftext|>", "<| |>", "日本語 text", "²³¼", "#$%&&& a1b22c", "x" * 5000, "á", "naïve_under__score",
    ])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abstlrevmdSTREÉé×'’\" 12.,\n\t_-<|>ß\x1c"), max_size=30), max_size=6))
def test_any_text(texts):
    check(texts)


def test_a_full_lookup_starts_anew(monkeypatch):
    monkeypatch.setattr(pieces, "MOST_PIECES", 40)
    rng, fresh = np.random.default_rng(2), PieceEncoder(PATH)
    for _ in range(20):
        check([" ".join("w" + "abcdefghij"[x] for x in rng.integers(0, 10, 6)) + f" z{'q' * int(rng.integers(1, 30))}" for _ in range(5)], fresh)


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_with_equal_polynomial_hashes(n):
    x, y = thue_morse(n), thue_morse(n, "b", "a")
    check([x, y, f"{x} {y}", f"{y}{x}"])


@pytest.mark.parametrize("block", [7, 64])
def test_texts_longer_than_a_block(monkeypatch, block):
    monkeypatch.setattr(pieces, "BLOCK", block)
    check(["It's a text, longer than a block: " + "don't " * 40, "y" * 300, None, "x" * 100 + " é" * 50, "Ω a b c " * 20, " " * 200, "a <|b " * 9, ""])


def test_another_tokenizer_is_encoded_whole():
    path = public_tokenizers.path("byte_bpe_50k.json")
    other, library = PieceEncoder(path), Tokenizer.from_file(path)
    assert not other.pieces
    ids, offsets = other.encode(pa.array(["Hello there", None, "x  y"]))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [library.encode(x, add_special_tokens=False).ids for x in ("Hello there", "", "x  y")]


@pytest.mark.parametrize("n", [0, 1])
def test_empty_columns(n):
    ids, offsets = SHARED.encode(pa.array([None] * n, pa.string()))
    assert len(ids) == 0 and offsets.tolist() == [0] * (n + 1)
