"""Suffix order of many short strings by induced sorting, over queues that can go to disk.

The suffixes of a set of strings, each closed by its own end mark, are sorted
in the manner of external induced sorting.  Suffixes that begin a rise after a
fall are sorted first, by naming the substrings between them and sorting the
strings of names, recursively while the names are few.  All others are then
induced: going through the suffixes in order, the suffix one place to the left
of each joins the queue of its first symbol.  The queues of all symbols, taken
in the order of the symbols, are one priority queue.  What goes through them
are tuples of a suffix and the length of the prefix it has in common with the
one before it: two suffixes that join a queue one after the other share one
symbol more than the least of the lengths met between them.  Whole blocks of
tuples go through the queues at a time, and a queue over its memory bound keeps
its blocks in a scratch file of the task.
"""

from __future__ import annotations

import tempfile
from collections import deque

import numpy as np

#: Bytes of queued suffixes that stay in memory.
QUEUE_BYTES = 96 << 20
#: Strings of names over larger alphabets are sorted by doubling instead of by another induction.
MOST_SYMBOLS = 1024


#: What a length says before anything was met.
UNMET = 255


def _tuples(places: np.ndarray, common: np.ndarray | int) -> np.ndarray:
    """Suffixes with their common prefixes, as the queues hold them."""
    out = np.empty(len(places), [("place", places.dtype), ("common", np.uint8)])
    out["place"], out["common"] = places, common
    return out


class BlockQueues:
    """One first-in first-out queue of blocks of tuples for each symbol, spilling the newest blocks to disk.

    Common prefixes are followed up to ``depth`` symbols, which is below
    ``UNMET``; with a depth of zero they stay zero.
    """

    def __init__(self, symbols: int, depth: int = 0, limit: int = QUEUE_BYTES):
        self.blocks: list[deque] = [deque() for _ in range(symbols)]
        self.limit, self.held, self.file, self.at = limit, 0, None, 0
        self.depth, self.since = depth, np.full(symbols, UNMET, np.uint8)

    def put(self, symbol: int, block: np.ndarray) -> None:
        if self.held + block.nbytes <= self.limit:
            self.held += block.nbytes
            self.blocks[symbol].append(block)
        else:
            self.spill(symbol, block)

    def spill(self, symbol: int, block: np.ndarray) -> None:
        """Puts a block at the end of a queue and of the scratch file."""
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(self.at)
        self.file.write(block.tobytes())
        self.blocks[symbol].append((self.at, len(block), block.dtype))
        self.at += block.nbytes

    def put_by_symbol(self, symbols: np.ndarray, block: np.ndarray) -> None:
        """Each tuple goes to the queue of its symbol; the order within a queue is the block's."""
        if not len(block):
            return
        order = np.argsort(symbols, kind="stable")
        symbols, block = symbols[order], block[order]
        cuts = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(block)], strict=True):
            self.put(int(symbols[a]), block[a:b])

    def induce(self, common: np.ndarray, picked: np.ndarray, symbols: np.ndarray, places: np.ndarray) -> None:
        """Queues ``places``, found left of the tuples ``picked`` of a block with these common prefixes."""
        if not len(places):
            self.since = np.minimum(self.since, common.min()) if self.depth else self.since
            return
        order = np.argsort(symbols, kind="stable")
        symbols, places = symbols[order], places[order]
        cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
        begin, end = [0, *cuts.tolist()], [*cuts.tolist(), len(places)]
        shared = 0
        if self.depth:
            picked = picked[order]
            least = np.empty(len(order), np.uint8)
            least[1:] = least_between(common, np.minimum(picked[:-1], picked[1:] - 1) + 1, picked[1:] + 1)
            own = symbols[begin]
            least[begin] = np.minimum(self.since[own], np.minimum.accumulate(common)[picked[begin]])
            shared = np.minimum(least, self.depth - 1) + np.uint8(1)
            rest = np.full(len(common) + 1, UNMET, np.uint8)
            rest[:-1] = np.minimum.accumulate(common[::-1])[::-1]
            self.since = np.minimum(self.since, rest[0])
            self.since[own] = rest[picked[np.array(end) - 1] + 1]
        block = _tuples(places, shared)
        for c, i, j in zip(symbols[begin].tolist(), begin, end, strict=True):
            self.put(c, block[i:j])

    def get(self, symbol: int) -> np.ndarray | None:
        """The tuples that wait for a symbol, as far as the memory bound allows; None when there are none."""
        queue, found, size = self.blocks[symbol], [], 0
        while queue and (not found or size < self.limit // 4):
            block = queue.popleft()
            if isinstance(block, tuple):
                at, n, kind = block
                self.file.seek(at)
                block = np.frombuffer(self.file.read(n * kind.itemsize), kind)
            else:
                self.held -= block.nbytes
            found.append(block)
            size += block.nbytes
        return None if not found else found[0] if len(found) == 1 else np.concatenate(found)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def least_between(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The least of ``values[start:stop]`` for each of many ranges, none of them empty."""
    out = np.empty(len(start), values.dtype)
    level = np.frexp(stop - start)[1] - 1
    table, width = values, 1
    for k in range(int(level.max()) + 1 if len(level) else 0):
        if k:
            table = np.minimum(table[:-width], table[width:])
            width *= 2
        own = np.flatnonzero(level == k)
        out[own] = np.minimum(table[start[own]], table[stop[own] - width])
    return out


class CommonPrefixes:
    """Comparison of suffixes of one text, up to ``depth`` symbols and to the end of either string."""

    def __init__(self, text: np.ndarray, depth: int):
        self.text, self.depth = text, depth
        marks = np.flatnonzero(text == 0)
        self.room = (np.repeat(marks, np.diff(marks, prepend=-1)) - np.arange(len(text))).astype(np.int32)
        self.bits = int(text.max()).bit_length()
        self.each = 63 // self.bits
        padded = np.r_[text.astype(np.uint64), np.zeros(self.each, np.uint64)]
        self.word = np.zeros(len(text) + 1, np.uint64)
        for k in range(self.each):
            self.word <<= np.uint64(self.bits)
            self.word |= padded[k : k + len(self.word)]

    def pair(self, left: int, right: int) -> int:
        """How many symbols two suffixes share."""
        a, b = (self.text[x : x + self.depth] for x in (left, right))
        n = min(len(a), len(b))
        ends = (a[:n] != b[:n]) | (a[:n] == 0)
        return int(ends.argmax()) if ends.any() else n

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at ``left`` and ``right`` share."""
        found = np.minimum(np.minimum(self.room[left], self.room[right]), self.depth)
        open_ = np.flatnonzero(found > 0)
        for done in range(0, self.depth, self.each):
            unlike = self.word[left[open_] + done] ^ self.word[right[open_] + done]
            ends = unlike != 0
            unlike, at = unlike[ends], open_[ends]
            same, equal = np.zeros(len(at), np.int64), np.ones(len(at), bool)
            for k in range(self.each):
                equal &= unlike >> np.uint64(self.bits * (self.each - 1 - k)) == 0
                same += equal
            found[at] = np.minimum(found[at], done + same)
            # those that are settled, by a difference or by an end, are not looked at again
            open_ = open_[found[open_] > done + self.each]
        return found.astype(np.uint8)


def _places(n: int) -> type:
    """The type of places in a text of ``n`` symbols."""
    return np.int32 if n < 1 << 31 else np.int64


def _rising(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one to its right; end marks count as rising."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = (text[1:] > text[:-1]).view(np.int8) - (text[1:] < text[:-1]).view(np.int8)
    step[text == 0] = 1
    step[-1] = 1
    known = np.where(step != 0, np.arange(n, dtype=_places(n)), _places(n)(n - 1))
    return step[np.minimum.accumulate(known[::-1])[::-1]] > 0


def _names(text: np.ndarray, rising: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each place in ``at`` the rank of the substring up to the next place, both included."""
    symbol = text.astype(np.uint64) * np.uint64(2) + rising
    bits = int(symbol.max()).bit_length()
    each = 63 // bits
    size = np.r_[np.diff(at), 0] + 1
    size[text[at] == 0] = 1
    rank = np.zeros(len(at), np.int64)
    open_, done = np.arange(len(at)), 0
    while len(open_):
        word = np.zeros(len(open_), np.uint64)
        for k in range(done, done + each):
            inside = size[open_] > k
            value = np.zeros(len(open_), np.uint64)
            value[inside] = symbol[at[open_[inside]] + k]
            word = (word << np.uint64(bits)) | value
        order = np.lexsort((word, rank[open_])) if done else np.argsort(word)
        r, w = rank[open_][order], word[order]
        first = np.r_[True, r[1:] != r[:-1]]
        fresh = first | np.r_[True, w[1:] != w[:-1]]
        # names leave gaps: a group's members are told apart within the places the group takes
        place = np.arange(len(order))
        start = np.maximum.accumulate(np.where(first, place, 0))
        new = np.empty(len(order), np.int64)
        new[order] = r + np.maximum.accumulate(np.where(fresh, place, 0)) - start
        rank[open_] = new
        done += each
        longer = size[open_] > done
        open_ = open_[longer]
    return np.unique(rank, return_inverse=True)[1].astype(np.int64)


def _doubled(text: np.ndarray) -> np.ndarray:
    """The order of all suffixes by comparing twice as many symbols each round; end marks in order of place."""
    n = len(text)
    marks = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(marks)
    rank[marks] = np.arange(len(marks))
    end = np.repeat(marks, np.diff(marks, prepend=-1))
    order = np.argsort(rank)
    r = rank[order]
    same = np.r_[False, r[1:] == r[:-1]]
    # a rank is the first place in the order that a group of equals takes
    rank[order] = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    open_, step = np.flatnonzero(same | np.r_[same[1:], False]), 1
    while len(open_):
        # only members of ties are told apart, by the rank of what follows
        own = order[open_]
        follows = rank[np.minimum(own + step, end[own])]
        key = np.argsort(rank[own] * n + follows)
        own, follows = own[key], follows[key]
        r = rank[own]
        same = np.r_[False, (r[1:] == r[:-1]) & (follows[1:] == follows[:-1])]
        order[open_] = own
        rank[own] = np.maximum.accumulate(np.where(same, 0, open_))
        open_ = open_[same | np.r_[same[1:], False]]
        step *= 2
    return order


def suffix_order(text: np.ndarray, queue_bytes: int = QUEUE_BYTES) -> np.ndarray:
    """All places of ``text`` in the order of their suffixes; see :func:`sorted_suffixes`."""
    return sorted_suffixes(text, 0, queue_bytes)[0]


def sorted_suffixes(text: np.ndarray, depth: int = 0, queue_bytes: int = QUEUE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """All places of ``text`` in the order of their suffixes, and what each has in common with the one before it.

    Symbols are positive; 0 marks the end of each string and the last symbol is
    one.  A suffix ends at its string's mark; equal suffixes, and the marks
    themselves, which come first, are ordered by place.  Common prefixes count
    up to ``depth`` symbols, below 255.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    symbols = int(text.max()) + 1
    rising = _rising(text)
    peaks = np.flatnonzero(rising & np.r_[False, ~rising[:-1]] | (text == 0)).astype(_places(n))
    names = _names(text, rising, peaks)
    reduced = np.where(text[peaks] == 0, 0, names + 1)
    if len(np.unique(names[text[peaks] != 0])) == (text[peaks] != 0).sum():
        by_name = np.argsort(np.where(reduced == 0, np.arange(len(peaks)) - len(peaks), reduced), kind="stable")
    elif int(reduced.max()) < MOST_SYMBOLS and len(reduced) < 0.6 * n:
        by_name = suffix_order(reduced, queue_bytes)
    else:
        by_name = _doubled(reduced)
    del names, reduced
    seeds = peaks[by_name]
    depth = depth if symbols > 1 else 0
    prefixes = CommonPrefixes(text, depth) if depth else None

    def shared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return prefixes.of(left, right) if prefixes else np.zeros(len(left), np.uint8)

    def seam(above: list[np.ndarray], below: list[np.ndarray]) -> int:
        """What the last tuples of two lists share; falling and rising suffixes of one symbol meet there."""
        return prefixes.pair(int(above[-1]["place"][-1]), int(below[-1]["place"][-1])) if prefixes and above and below else 0

    # whether there is a suffix to the left, and whether it rises
    wanted = np.zeros(n, np.uint8)
    wanted[1:] = np.where(text[:-1] != 0, 2 + rising[:-1], 0)
    falling, first, rises = (BlockQueues(symbols, depth, queue_bytes) for _ in range(3))
    first.put_by_symbol(text[seeds], _tuples(seeds, np.r_[np.uint8(0), shared(seeds[:-1], seeds[1:])]))
    lower: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    upper: list[list[np.ndarray]] = [[] for _ in range(symbols)]

    def induce(queues: BlockQueues, places: np.ndarray, common: np.ndarray, rise: bool) -> None:
        picked = np.flatnonzero(wanted[places] == 2 + rise)
        before = places[picked] - 1
        queues.induce(common, picked, text[before], before)

    def parts(block: np.ndarray, begin: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and common prefixes of a block, the first of which is ``begin`` unless None."""
        if begin is not None:
            block = block.copy()
            block["common"][0] = begin
        return np.ascontiguousarray(block["place"]), np.ascontiguousarray(block["common"])

    for c in range(symbols):
        while (block := falling.get(c)) is not None:
            places, common = parts(block, None if lower[c] else 0)
            lower[c].append(_tuples(places, common))
            induce(falling, places, common, False)
        met = False
        while (block := first.get(c)) is not None:
            induce(falling, *parts(block, None if met else seam(lower[c], [block[:1]])), False)
            met = True
    # the way back: what a tuple has in common with the one above it stands in that one
    for c in range(symbols - 1, 0, -1):
        while (block := rises.get(c)) is not None:
            places, common = parts(block, None if upper[c] else 0)
            upper[c].append(_tuples(places, common))
            induce(rises, places, common, True)
        above = seam(upper[c], lower[c])
        for block in reversed(lower[c]):
            places, common = parts(block, None)
            induce(rises, places[::-1], np.r_[np.uint8(above), common[:0:-1]], True)
            above = int(common[0])
    for q in (falling, first, rises):
        q.close()
    marks = np.flatnonzero(text == 0)
    order, found = [marks], [np.zeros(len(marks), np.uint8)]
    for c in range(1, symbols):
        order += [block["place"] for block in lower[c]]
        found += [block["common"] for block in lower[c]]
        if upper[c]:
            down = np.concatenate(upper[c])
            order.append(down["place"][::-1])
            found.append(np.r_[np.uint8(seam(lower[c], upper[c])), down["common"][:0:-1]])
    return np.concatenate(order), np.concatenate(found)
