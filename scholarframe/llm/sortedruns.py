"""Sorted runs on disk, merged block by block: what makes a shard larger than memory one sorted order.

Each run holds distinct strings of one length in ascending order, each with a
number.  Runs are written as compressed blocks and merged through a priority
queue of the blocks' last strings: up to the smallest of these, all strings
that any run still has are in memory, so equal ones meet and take the least of
their numbers.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterator

import numpy as np
import zstandard

#: Strings of a block.
BLOCK_ROWS = 1 << 15


class SortedRuns:
    """Runs of strings of ``size`` bytes in scratch files of the task."""

    def __init__(self, size: int, block_rows: int = BLOCK_ROWS):
        self.size, self.block_rows = size, block_rows
        self.file = tempfile.TemporaryFile()
        self.blocks: list[list[tuple[int, int, int]]] = []  # of each run: place, bytes and rows
        self.rows: list[int] = []

    def add(self, blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> int:
        """Writes a run, given as blocks of an array of bytes with a row for each string and of its numbers; gives the run's number."""
        press, own, rows = zstandard.ZstdCompressor(level=1), [], 0
        for strings, numbers in blocks:
            data = press.compress(np.ascontiguousarray(strings).tobytes() + numbers.astype("<i8").tobytes())
            own.append((self.file.seek(0, 2), len(data), len(numbers)))
            self.file.write(data)
            rows += len(numbers)
        self.blocks.append(own)
        self.rows.append(rows)
        return len(self.blocks) - 1

    def _read(self, run: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        at, size, rows = self.blocks[run][block]
        self.file.seek(at)
        raw = zstandard.ZstdDecompressor().decompress(self.file.read(size))
        return np.frombuffer(raw, f"S{self.size}", rows), np.frombuffer(raw, "<i8", rows, rows * self.size)

    def least(self) -> Iterator[np.ndarray]:
        """For each run, in order, the least number that any run has for each of its strings."""
        base = np.r_[0, np.cumsum(self.rows)] * 8
        out = tempfile.TemporaryFile()
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        block, done, ends = [0] * len(self.blocks), [0] * len(self.blocks), []

        def load(run: int) -> None:
            if block[run] < len(self.blocks[run]):
                held[run] = self._read(run, block[run])
                block[run] += 1
                heapq.heappush(ends, (bytes(held[run][0][-1:].view(f"V{self.size}")[0]), run))

        for run in range(len(self.blocks)):
            load(run)
        while ends:
            bound = np.frombuffer(ends[0][0], f"S{self.size}")[0]
            parts = []
            for run, (strings, numbers) in list(held.items()):
                n = int(np.searchsorted(strings, bound, "right"))
                if n:
                    parts.append((run, strings[:n], numbers[:n]))
                    held[run] = strings[n:], numbers[n:]
            strings, numbers = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
            order = np.argsort(strings, kind="stable")
            strings = strings[order]
            first = np.flatnonzero(np.r_[True, strings[1:] != strings[:-1]])
            least = np.empty(len(order), np.int64)
            least[order] = np.repeat(np.minimum.reduceat(numbers[order], first), np.diff(np.r_[first, len(order)]))
            at = 0
            for run, own, _ in parts:
                out.seek(int(base[run]) + 8 * done[run])
                out.write(least[at : at + len(own)].tobytes())
                done[run] += len(own)
                at += len(own)
            while ends and not len(held[ends[0][1]][0]):
                run = heapq.heappop(ends)[1]
                del held[run]
                load(run)
        for run, rows in enumerate(self.rows):
            out.seek(int(base[run]))
            yield np.frombuffer(out.read(8 * rows), np.int64)
        out.close()

    def close(self) -> None:
        self.file.close()
