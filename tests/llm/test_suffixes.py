import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scholarframe.llm import suffixes
from scholarframe.llm.suffixes import CommonPrefixes, least_between, sorted_suffixes, suffix_order


def text_of(strings):
    return np.array([x for s in strings for x in (*(c + 1 for c in s), 0)], np.int64)


def brute(text):
    marks = np.flatnonzero(text == 0)
    key = lambda i: (tuple(text[i : marks[np.searchsorted(marks, i)]]), i)
    return sorted(range(len(text)), key=key)


def shared(a, b, depth):
    return next((k for k, (x, y) in enumerate(zip(a[:depth], b[:depth])) if x != y), min(len(a), len(b), depth))


def check(strings, **kwargs):
    text = text_of(strings)
    got = suffix_order(text, **kwargs).tolist()
    assert sorted(got) == list(range(len(text)))
    marks = np.flatnonzero(text == 0)
    suffix = lambda i: tuple(text[i : marks[np.searchsorted(marks, i)]])
    assert [suffix(i) for i in got] == [suffix(i) for i in brute(text)]
    for depth in (1, 4, 50, 254):
        order, common = sorted_suffixes(text, depth, **kwargs)
        assert order.tolist() == got
        assert common.tolist() == [0] + [shared(suffix(a), suffix(b), depth) for a, b in zip(got, got[1:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=14), min_size=1, max_size=8))
def test_small_alphabet(strings):
    check(strings)


@pytest.mark.parametrize("seed", range(4))
def test_long_strings_and_scratch_files(seed):
    rng = np.random.default_rng(seed)
    strings = [rng.integers(0, (2, 5, 60, 250)[seed], int(rng.integers(0, 400))).tolist() for _ in range(12)]
    check(strings + strings[:4] + [[7] * 300, [1, 2] * 90, []], queue_bytes=2000)


def test_recursion(monkeypatch):
    monkeypatch.setattr(suffixes, "MOST_SYMBOLS", 1 << 30)
    rng = np.random.default_rng(0)
    for _ in range(5):
        check([rng.integers(0, 3, 200).tolist() for _ in range(6)])


def test_empty():
    assert suffix_order(np.zeros(0, np.int64)).tolist() == []
    assert suffix_order(np.zeros(2, np.int64)).tolist() == [0, 1]


@pytest.mark.parametrize("symbols", [1, 2, 256, 70000])
def test_common_prefixes(symbols):
    rng = np.random.default_rng(symbols)
    own = rng.integers(1, symbols + 1, 90)
    text = np.r_[own, 0, own[:60], symbols, own[61:], 0, own[40:], 0]
    left, right = rng.integers(0, len(text), (2, 500))
    right[::2] = (left[::2] + 91) % len(text)
    marks = np.flatnonzero(text == 0)
    suffix = lambda i: tuple(text[i : marks[np.searchsorted(marks, i)]])
    for depth in (1, 7, 50):
        assert CommonPrefixes(text, depth).of(left, right).tolist() == [shared(suffix(a), suffix(b), depth) for a, b in zip(left, right)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 255), min_size=1, max_size=40), st.data())
def test_least_between(values, data):
    ranges = [sorted(data.draw(st.tuples(st.integers(0, len(values) - 1), st.integers(1, len(values))))) for _ in range(6)]
    ranges = np.array([(a, max(b, a + 1)) for a, b in ranges])
    assert least_between(np.array(values, np.uint8), ranges[:, 0], ranges[:, 1]).tolist() == [min(values[a:b]) for a, b in ranges.tolist()]
