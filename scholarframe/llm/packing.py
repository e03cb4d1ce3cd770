"""Documents packed into token sequences of a fixed length.

Every document becomes token ids with an end id, cut only when longer than a
sequence.  Pieces are dealt to tasks in a random but repeatable order, and
each task places its own one by one as they come, with a fixed number of open
bins: a bitset tells which amounts of free space are open, so the bin a piece
fits best is one shift and one lowest bit away, and when a new bin is needed
beyond the number the fullest open one closes.  Bins that end with space to
spare, closed or still open, are dissolved, and their pieces come again, dealt
anew by another hash, to the same online packing.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarframe.llm.columns import slices
from scholarframe.llm.pieces import encoder
from scholarframe.session import stored

CAPACITY, OPEN_BINS = 2048, 1024
#: How often pieces may be packed, and how many come to one task after the first time.
PASSES, TOGETHER = 4, 1 << 14


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all documents with the end id after each, and the offsets of these."""
    n = len(offsets) - 1
    bounds = offsets + np.arange(n + 1)
    out = np.empty(len(ids) + n, np.uint32)
    own = np.ones(len(out), bool)
    own[bounds[1:] - 1] = False
    out[own] = ids
    out[bounds[1:] - 1] = end_id
    return out, bounds


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: the pieces of every document, at most ``capacity`` ids each.

    A null text is an empty one, whose only id is the end id.  ``tokenizer`` is
    a tokenizer file that every executor can read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                ids, bounds = with_end(*coder.encode(batch.column(1).slice(a, b - a)), end_id)
                sizes = np.diff(bounds)
                count = -(-sizes // capacity)
                row = np.repeat(np.arange(b - a), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(capacity, sizes[row] - start)
                first = bounds[row] + start
                data = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(first.tolist(), (first + length).tolist(), strict=True)]
                out = [batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.r_[first, bounds[-1]].astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return rows.mapInArrow(each, schema)


class OpenBins:
    """Online best fit over at most ``most`` open bins."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.mask = 0  # bit f is set while a bin with f free places is open
        self.bins: dict[int, list[int]] = defaultdict(list)
        self.open = self.made = 0

    def _take(self, free: int) -> int:
        own = self.bins[free]
        found = own.pop()
        if not own:
            self.mask &= ~(1 << free)
        self.open -= 1
        return found

    def put(self, size: int) -> tuple[int, int]:
        """The bin of the next item, and its place there."""
        fitting = self.mask >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            found = self._take(free)
        else:
            free, found = self.capacity, self.made
            self.made += 1
            if self.open >= self.most and size < self.capacity:
                self._take((self.mask & -self.mask).bit_length() - 1)  # the fullest closes
        left = free - size
        if left:
            self.bins[left].append(found)
            self.mask |= 1 << left
            self.open += 1
        return found, self.capacity - free

    def still_open(self) -> set[int]:
        return {b for own in self.bins.values() for b in own}


def _packed(rows: DataFrame, capacity: int, open_bins: int) -> DataFrame:
    """``rows`` of each task, taken in their order, with a bin, the place there and the bin's use.

    Rows leave when their bin has closed, so a task holds those of its open bins only.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40
        held: pa.Table | None = None

        def leave(table: pa.Table, bin_of: np.ndarray, gone: np.ndarray) -> Iterator[pa.RecordBatch]:
            own = table.filter(pa.array(gone))
            end = own["bin_offset"].to_numpy() + own["length"].to_numpy()
            _, at = np.unique(bin_of[gone], return_inverse=True)
            used = np.zeros(int(at.max()) + 1 if len(at) else 0, np.int64)
            np.maximum.at(used, at, end)
            yield from own.append_column("bin_used", pa.array(used[at])).to_batches(10_000)

        for batch in batches:
            placed = [bins.put(size) for size in batch.column("length").to_pylist()]
            table = pa.Table.from_batches([batch])
            table = table.append_column("bin", pa.array([base + b for b, _ in placed], pa.int64())).append_column("bin_offset", pa.array([x for _, x in placed], pa.int64()))
            table = pa.concat_tables([held, table]) if held is not None else table
            bin_of = table["bin"].to_numpy()
            still = np.isin(bin_of, base + np.array(sorted(bins.still_open()), np.int64))
            yield from leave(table, bin_of, ~still)
            held = table.filter(pa.array(still)).combine_chunks()
        if held is not None:
            yield from leave(held, held["bin"].to_numpy(), np.ones(len(held), bool))

    return rows.mapInArrow(each, f"{schema}, bin long, bin_offset long, bin_used long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, most_free: int | None = None, together: int = TOGETHER, passes: int = PASSES) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; the pieces of a sequence fill it from 0 without gaps.

    Needs the columns ``doc_id``, ``piece`` and ``length``; lengths lie between
    1 and ``capacity``.  Repeated rows are packed each for itself; columns
    named ``bin``, ``bin_offset``, ``bin_used``, ``sequence_id`` or ``offset``
    are replaced.  Bins that end with more than ``most_free`` free places, a
    128th of the capacity by default, are dissolved, and their pieces go through
    the same online packing once more, dealt anew by their hash, ``passes``
    times in all.  No pass looks at lengths before it places a piece.
    """
    most_free = capacity // 128 if most_free is None else most_free
    left = pieces.drop("bin", "bin_offset", "bin_used", "sequence_id", "offset")
    own, done = left.columns, []
    for k in range(passes):
        order = [F.xxhash64(F.lit(k), "doc_id", "piece"), *map(F.col, ("doc_id", "piece", "length"))]
        # later every part holds about `together` small rows, whatever the size of the corpus
        dealt = left.repartition(left.count() // together + 1, order[0]) if k else left.repartition(order[0])
        packed = stored(_packed(dealt.sortWithinPartitions(*order), capacity, open_bins * (4 if k else 1)), "bins")
        wasteful = (F.col("bin_used") < capacity - most_free) & F.lit(k < passes - 1)
        done.append(packed.where(~wasteful).select(*own, (F.col("bin") * passes + k).alias("sequence_id"), F.col("bin_offset").alias("offset")))
        left = packed.where(wasteful).select(*own)
    return reduce(DataFrame.unionByName, done)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with their places in sequences; see :func:`token_pieces` and :func:`pack`."""
    return pack(token_pieces(docs, tokenizer, capacity, end_id, with_ids=with_ids), capacity, open_bins)
