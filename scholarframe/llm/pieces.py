"""Token ids of whole batches of texts, with the ``tokenizers`` library doing the encoding.

The tokenizer in use is given as a file.  When its pre-tokenizer cuts a text
into pieces that are encoded independently (lower case, white space dropped,
words ending a piece), equal pieces always give equal ids, so a piece is
encoded once per worker and then looked up by its bytes.  The cutting is done
for a block of texts at a time by array operations; a text holding anything
beyond the characters for which these are known to agree with the library goes
through it whole.
"""

from __future__ import annotations

import json
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from scholarframe.llm.columns import flat

#: Pieces that a worker keeps before it starts anew, and the longest of them; the lookup stays below about 80 MB.
MOST_PIECES, KEPT_BYTES = 1 << 19, 64
#: Bytes cut into pieces at a time.
BLOCK = 512 << 10

# The parts of a tokenizer file under which pieces are independent.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

SPACE, LETTER, DIGIT, OTHER, UNKNOWN = 0, 1, 2, 3, 4


def _classes() -> np.ndarray:
    kind = np.full(256, UNKNOWN, np.uint8)
    for c in range(128):
        s = chr(c)
        kind[c] = LETTER if s.isalpha() else DIGIT if s.isdigit() else SPACE if s in " \t\n\v\f\r" else OTHER
    kind[0x1C:0x20] = UNKNOWN  # Python and the library differ on these
    kind[0x80:0xC0] = LETTER  # second bytes, looked at with their first
    kind[0xC3] = LETTER  # U+00C0 to U+00FF, all letters but two
    return kind


CLASS = _classes()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _kinds(buf: np.ndarray) -> np.ndarray:
    kind = CLASS[buf]
    lead = np.flatnonzero(buf[:-1] == 0xC3)
    second = buf[lead + 1]
    kind[lead[(second == 0x97) | (second == 0xB7)]] = UNKNOWN
    return kind


def _cuts(buf: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Ends of blocks of about ``BLOCK`` bytes: the ends of rows or, in a longer row, a space, where no piece is cut."""
    cuts = [0]
    while (at := cuts[-1]) < len(buf):
        stop = min(at + BLOCK, len(buf))
        end = int(offsets[np.searchsorted(offsets, stop, "right") - 1])
        if end > at:
            cuts.append(end)
            continue
        end = int(offsets[np.searchsorted(offsets, at, "right")])
        while stop < end:
            spaces = np.flatnonzero(buf[at:stop] == 32)
            if len(spaces) and spaces[-1]:
                stop = at + int(spaces[-1])
                break
            stop += BLOCK
        cuts.append(min(stop, end))
    return cuts


class PieceEncoder:
    """Encodes batches of texts; ``pieces`` tells whether the lookup applies to the tokenizer."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(Path(path).read_text())
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.pieces = (
            spec["normalizer"] == NORMALIZER
            and split[0].get("pattern") == {"Regex": SPLIT}
            and (split[0].get("behavior"), split[0].get("invert")) == ("Removed", True)
            and [x["type"] for x in split[1:]] == ["ByteLevel"]
            and not split[1]["add_prefix_space"]
            and spec["post_processor"] is None
            and all(x["special"] and x["content"].startswith("<|") for x in spec["added_tokens"])
        )
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.begin = np.zeros(1 << 12, np.int64)
        self.ids = np.zeros(1 << 14, np.uint32)
        self.n = 0

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> None:
        """Puts the ids of pieces behind those that are there; place ``n`` holds the first new piece."""
        # with spaces between, each piece is a word of its own
        found = self.tokenizer.encode(b" ".join(new).decode(), add_special_tokens=False)
        sizes = np.bincount(np.array(found.word_ids, np.int64), minlength=len(new))
        first, used = self.n, int(self.begin[self.n])
        while first + len(new) >= len(self.begin):
            self.begin = np.r_[self.begin, np.zeros_like(self.begin)]
        while used + int(sizes.sum()) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
        self.begin[first + 1 : first + len(new) + 1] = used + np.cumsum(sizes)
        self.ids[used : used + int(sizes.sum())] = found.ids
        self.n += len(new)

    def _look_up(self, distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each piece where its ids begin and how many there are, and the ids; pieces are told apart by all their bytes."""
        if self.n + len(distinct) > MOST_PIECES:
            self._forget()
        get = self.known.get
        at = np.array([get(x, -1) for x in distinct], np.int64)
        missing = np.flatnonzero(at < 0)
        kept = self.n
        if len(missing):
            # long pieces seldom come again: they stand last and are forgotten at once
            size = np.array([len(distinct[i]) for i in missing.tolist()])
            missing = missing[np.argsort(size > KEPT_BYTES, kind="stable")]
            new = [distinct[i] for i in missing.tolist()]
            at[missing] = self.n + np.arange(len(new))
            self._learn(new)
            kept = self.n - int((size > KEPT_BYTES).sum())
            self.known.update(zip(new[: kept - self.n or None], at[missing].tolist(), strict=False))
        first, count = self.begin[at], self.begin[at + 1] - self.begin[at]
        self.n = kept
        return first, count, self.ids

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and ``n + 1`` offsets into them; null texts are empty."""
        if not self.pieces:
            return self._joined([np.array(x, np.uint32) for x in self._whole([x or "" for x in column.to_pylist()])])
        buf, offsets = flat(column)
        n, cuts = len(column), _cuts(buf, offsets)
        blocks = list(zip(cuts, cuts[1:], strict=False))
        strange = np.zeros(n, bool)
        for a, b in blocks:
            odd = a + np.flatnonzero(_kinds(buf[a:b]) == UNKNOWN)
            marks = a + np.flatnonzero((buf[a : b - 1] == 60) & (buf[a + 1 : b] == 124))  # "<|" may begin a special token
            strange[np.searchsorted(offsets, np.r_[odd, marks], "right") - 1] = True
        bounds, parts, done = np.zeros(n + 1, np.int64), [], 0
        for a, b in blocks:
            i, j = np.searchsorted(offsets, a), int(np.searchsorted(offsets, b, "right"))
            ids, before = self._block(buf[a:b], offsets[i:j] - a, strange, int(i))
            bounds[i:j] = done + before
            parts.append(ids)
            done += len(ids)
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        if not strange.any():
            return ids, bounds
        each = [ids[bounds[i] : bounds[i + 1]] for i in range(n)]
        rows = np.flatnonzero(strange).tolist()
        for i, x in zip(rows, self._whole(column.take(pa.array(rows)).to_pylist()), strict=True):
            each[i] = np.array(x, np.uint32)
        return self._joined(each)

    @staticmethod
    def _joined(each: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return (np.concatenate(each) if each else np.zeros(0, np.uint32)), np.r_[0, np.cumsum([len(x) for x in each], dtype=np.int64)]

    def _block(self, buf: np.ndarray, offsets: np.ndarray, strange: np.ndarray, row: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a block, and how many of them come before each of ``offsets``, the first of which begins row ``row``."""
        low, kind = LOWER[buf], _kinds(buf)
        lead = np.flatnonzero(buf == 0xC3)
        second = buf[lead + 1]
        low[lead[(second >= 0x80) & (second <= 0x9E)] + 1] += 32
        edge = np.zeros(len(buf) + 1, bool)
        edge[offsets] = edge[0] = edge[-1] = True
        edge[1:-1] |= kind[1:] != kind[:-1]
        edge[:-1] |= kind == DIGIT
        marks = np.flatnonzero((low == 39) & edge[:-1])
        if len(marks):
            self._contractions(low, kind, edge, marks, np.r_[offsets, len(buf)])
        wanted = kind != SPACE
        if strange.any():
            # the row of each byte; rows that go through the library whole have no pieces here
            wanted &= ~np.repeat(strange[np.clip(np.arange(row - 1, row + len(offsets)), 0, len(strange) - 1)], np.diff(np.r_[0, offsets, len(buf)]))
        starts = np.flatnonzero(edge[:-1] & wanted)
        ends = np.flatnonzero(edge)
        ends = ends[np.searchsorted(ends, starts, "right")]
        # pieces are exactly the bytes that are no white space
        places = np.r_[0, np.cumsum(ends - starts)].astype(np.int32)
        column = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(low[wanted])])
        found = column.dictionary_encode()
        words, at = flat(found.dictionary)
        data, at = words.tobytes(), at.tolist()
        first, count, known = self._look_up([data[i:j] for i, j in zip(at, at[1:], strict=False)])
        index = np.asarray(found.indices)
        first, count = first[index], count[index]
        total = np.r_[0, np.cumsum(count)]
        gather = np.arange(total[-1]) + np.repeat(first - total[:-1], count)
        return known[gather], total[np.searchsorted(starts, offsets)]

    @staticmethod
    def _contractions(low: np.ndarray, kind: np.ndarray, edge: np.ndarray, marks: np.ndarray, offsets: np.ndarray) -> None:
        """An apostrophe that begins a run takes a following s, t, m, d, re, ve or ll with it."""
        padded = np.r_[low, np.zeros(3, np.uint8)]
        room = offsets[np.searchsorted(offsets, marks, "right")] - marks
        one, two = padded[marks + 1], padded[marks + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8)) & (room >= 2)
        pair = one.astype(np.int64) * 256 + two
        long = np.isin(pair, [ord("r") * 256 + ord("e"), ord("v") * 256 + ord("e"), ord("l") * 256 + ord("l")]) & (room >= 3)
        for found, size in ((short, 2), (long & ~short, 3)):
            p = marks[found]
            edge[p + 1] = False
            edge[p + size] = True


@cache
def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process and tokenizer file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return PieceEncoder(path)
