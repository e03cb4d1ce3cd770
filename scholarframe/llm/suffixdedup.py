"""Removal of byte passages that an earlier document holds, by sorting suffixes shard by shard.

A passage counts from ``size`` bytes.  Documents are dealt into slices; three
rounds of small packed rows go between slices and shards, and the texts
themselves are shuffled once.

1. *Anchors.*  Every window of ``size`` bytes is anchored at the smallest hash
   of the ``GRAM``-byte strings in it, so equal windows have equal anchors.
   Each slice sends its distinct anchors; those that no other document has
   come back marked, and their windows are settled.
2. *Segments.*  Neighbouring windows with one anchor form a segment, the bytes
   they cover.  Segments of shared anchors go to the shard of the anchor, equal
   ones of a slice once, with the smallest document that holds them.  An anchor
   whose segments would outgrow a shard is hot: its windows go one by one to the
   shard of the window's own hash, equal ones of a slice once, so what meets
   there is at most one row a slice for each window.
3. *Suffixes.*  A shard sorts the suffixes of its segments by external induced
   sorting, which carries common prefixes along.  Windows side by side with a
   common prefix of ``size`` bytes are equal; the smallest document among them
   decides, and the slices get one bit for each window of each segment they
   sent.  Segments come batch by batch: a shard that is larger than a run is
   sorted run by run, and the runs of its distinct windows are merged from
   disk, so a shard's size is not bounded by memory.

A slice sends a shard at most one row, and none without segments for it, so
there are never more rows than segments, however many slices and shards.

The slices then mark the windows of every document and join them to spans.
"""

from __future__ import annotations

import pickle
import struct
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarframe.llm.columns import BASE, BYTE, flat, gathered, mixed, runs, same_bytes, span_hashes
from scholarframe.llm.sortedruns import SortedRuns
from scholarframe.llm.suffixes import sorted_suffixes

SIZE, GRAM = 50, 24
#: Bytes of a slice and of a shard's share of the texts; a slice grows with the corpus so that rows stay few.
SLICE_BYTES, MOST_SLICE_BYTES, SHARD_BYTES = 2 << 20, 64 << 20, 2 << 20
ANCHORS_TOGETHER = 1 << 20
#: Bytes of segments that are sorted in memory at a time, and of queued suffixes that stay there; larger shards are sorted in runs on disk.
RUN_BYTES, QUEUE_BYTES = 6 << 20, 48 << 20
#: Bytes hashed at a time; the arrays of a block fit into a core's cache.
BLOCK = 1 << 16
#: Segments of an anchor in a slice from which its exact copies are told apart before they are counted.
MANY = 16
NO_ID = np.int64(2**63 - 1)


def gram_hashes(buf: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes that begin at each place, by joining halves."""
    whole, done = None, 0
    part, length, power = BYTE[buf], 1, BASE
    while True:
        if size & length:
            if whole is None:
                whole, done = part, length
            else:
                n = len(buf) - done - length + 1
                whole, done = whole[:n] * np.uint64(power) + part[done : done + n], done + length
        if done == size:
            return mixed(whole)
        n = len(part) - length
        part = part[:n] * np.uint64(power) + part[length : length + n]
        power, length = power * power % (1 << 64), 2 * length


def anchors(buf: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``size`` bytes the place of its smallest gram, the leftmost of equals, and all gram hashes."""
    hashes = gram_hashes(buf, gram)
    width, length = size - gram + 1, 1
    least, place = hashes, np.arange(len(hashes), dtype=np.int32)

    def join(a: np.ndarray, pa_: np.ndarray, b: np.ndarray, pb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        right = b < a
        return np.where(right, b, a), np.where(right, pb, pa_)

    while length * 2 <= width:
        n = len(least) - length
        least, place = join(least[:n], place[:n], least[length:], place[length:])
        length *= 2
    if length < width:
        n, step = len(least) - (width - length), width - length
        least, place = join(least[:n], place[:n], least[step : step + n], place[step : step + n])
    return place, hashes


class Segments:
    """The runs of neighbouring windows with one anchor, of all rows of a slice."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, size: int, gram: int):
        self.buf, self.offsets, self.size = buf, offsets, size
        parts = []
        row = 0
        while row < len(offsets) - 1:
            stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK, "right")) - 1)
            parts.append(self._block(row, min(stop, len(offsets) - 1), gram))
            row = min(stop, len(offsets) - 1)
        self.anchor, self.start, self.windows = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, (np.uint64, np.int64, np.int64)[k]) for k in range(3))
        self.row = np.searchsorted(offsets, self.start, "right") - 1

    def _block(self, row: int, stop: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        base = int(self.offsets[row])
        buf = self.buf[base : int(self.offsets[stop])]
        if len(buf) < self.size:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        place, hashes = anchors(buf, self.size, gram)
        ends = self.offsets[row + 1 : stop + 1] - base
        inside = np.ones(len(place), bool)
        for k in (ends[:-1] if len(ends) else ends).tolist():
            inside[max(0, k - self.size + 1) : k] = False
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | ~inside[:-1]
        first = np.flatnonzero(inside & new)
        after = np.ones(len(place), bool)
        after[:-1] = new[1:] | ~inside[1:]
        last = np.flatnonzero(inside & after)
        # the smallest hashes of windows are small numbers; mixing them again spreads them evenly over buckets
        return mixed(~hashes[place[first]]), first + base, last - first + 1

    def distinct_anchors(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The anchors in order, which of them more than one document of the slice has, and how many distinct segments each has.

        The last as the exponent of the next power of two; exact copies count
        once where an anchor has ``MANY`` segments or more.
        """
        order = np.argsort(self.anchor)
        a, d = self.anchor[order], doc[self.row][order]
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
        if not len(a):
            return a, np.zeros(0, bool), np.zeros(0, np.uint8)
        count = np.diff(np.r_[first, len(a)])
        own = np.sort(order[np.repeat(count >= MANY, count)])
        if len(own):
            key = _hashes(self.buf, self.offsets, self.row[own], self.start[own], self.start[own] + self.windows[own] + self.size - 1)
            by = np.lexsort((key, self.anchor[own]))
            held, key = self.anchor[own][by], key[by]
            unlike = np.r_[True, (key[1:] != key[:-1]) | (held[1:] != held[:-1])]
            count[count >= MANY] = np.add.reduceat(unlike.astype(np.int64), np.flatnonzero(np.r_[True, held[1:] != held[:-1]]))
        return a[first], np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first), np.ceil(np.log2(count)).astype(np.uint8)

    def shared(self, anchors_: np.ndarray, doc: np.ndarray) -> "SharedSegments":
        """The segments whose anchor is among ``anchors_``, equal ones together."""
        at = np.searchsorted(anchors_, self.anchor)
        at[at == len(anchors_)] = 0
        own = np.flatnonzero(anchors_[at] == self.anchor) if len(anchors_) else np.zeros(0, np.int64)
        start, end = self.start[own], self.start[own] + self.windows[own] + self.size - 1
        key = _hashes(self.buf, self.offsets, self.row[own], start, end)
        order = np.lexsort((doc[self.row[own]], key, self.anchor[own]))
        own = own[order]
        first = _firsts(self.buf, start[order], end[order] - start[order], key[order])
        return SharedSegments(own, first, np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(key)])))

    def single_windows(self, anchors_: np.ndarray, doc: np.ndarray) -> "SingleWindows":
        """The windows whose anchor is among ``anchors_``, in the order of their hashes, equal ones together."""
        at = np.searchsorted(anchors_, self.anchor)
        at[at == len(anchors_)] = 0
        own = np.flatnonzero(anchors_[at] == self.anchor) if len(anchors_) else np.zeros(0, np.int64)
        n = self.windows[own]
        start = np.arange(int(n.sum())) + np.repeat(self.start[own] - (np.cumsum(n) - n), n)
        row = np.repeat(self.row[own], n)
        key = _hashes(self.buf, self.offsets, row, start, start + self.size)
        order = np.lexsort((doc[row], key))
        key = key[order]
        first = _firsts(self.buf, start[order], np.full(len(key), self.size), key)
        return SingleWindows(start[order], row[order], key[first], first, np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(key)])))


def _firsts(buf: np.ndarray, start: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a range, sorted by hash, differs from the one before: in its hash, or else in its bytes.

    Equal ranges that an unlike one of the same hash keeps apart count as two,
    which sends one row more and changes no result.
    """
    if not len(key):
        return np.zeros(0, np.int64)
    again = np.flatnonzero(key[1:] == key[:-1]) + 1
    same = same_bytes(buf, start[again], size[again], buf, start[again - 1], size[again - 1])
    new = np.ones(len(key), bool)
    new[again[same]] = False
    return np.flatnonzero(new)


def _distinct(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One of each of the distinct byte ranges, and for every range which of these it is."""
    _, pick, back = np.unique(span_hashes(buf, start, start + size), return_index=True, return_inverse=True)
    if same_bytes(buf, start, size, buf, start[pick[back]], size[pick[back]]).all():
        return pick, back
    # unlike ranges with one hash: told apart by their bytes
    seen: dict[bytes, int] = {}
    back = np.array([seen.setdefault(buf[a : a + n].tobytes(), len(seen)) for a, n in zip(start.tolist(), size.tolist(), strict=True)])
    return np.unique(back, return_index=True)[1], back


class SharedSegments:
    """Occurrences in the order of their distinct segment; ``first`` holds the earliest document of each."""

    def __init__(self, occurrence: np.ndarray, first: np.ndarray, distinct: np.ndarray):
        self.occurrence, self.first, self.distinct = occurrence, first, distinct


class SingleWindows:
    """Windows in the order of their hashes; ``first`` holds the earliest document of each distinct one, ``key`` its hash."""

    def __init__(self, start: np.ndarray, row: np.ndarray, key: np.ndarray, first: np.ndarray, distinct: np.ndarray):
        self.start, self.row, self.key, self.first, self.distinct = start, row, key, first, distinct


def _hashes(buf: np.ndarray, offsets: np.ndarray, rows: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, a block of rows at a time."""
    out, row = np.zeros(len(start), np.uint64), 0
    while row < len(offsets) - 1:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK, "right")) - 1)
        a, b = np.searchsorted(rows, [row, stop])
        base = int(offsets[row])
        out[a:b] = span_hashes(buf[base : int(offsets[min(stop, len(offsets) - 1)])], start[a:b] - base, end[a:b] - base)
        row = stop
    return out


def _ids(table: pa.Table) -> np.ndarray:
    return table["doc_id"].combine_chunks().fill_null(int(NO_ID)).to_numpy() if len(table) else np.zeros(0, np.int64)


def _texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return flat(table["text"].combine_chunks()) if len(table) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))


def _bucket(anchor: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each anchor, by its high bits; sorted anchors have sorted buckets."""
    return ((anchor >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _cuts(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    return list(zip(bucket[first].tolist(), first.tolist(), [*first[1:].tolist(), len(bucket)], strict=True)) if len(bucket) else []


@dataclass
class SortedWindows:
    """The distinct windows of a run of blobs in order, each with the smallest document, and the windows of the blobs by their number there."""

    strings: Callable[[int, int], np.ndarray]  # the bytes of some of the distinct windows
    least: np.ndarray
    number: np.ndarray  # of each window of each blob
    doc: np.ndarray  # of each segment, the document that it was sent for
    windows: np.ndarray  # of each segment
    bounds: np.ndarray  # windows before each blob

    def seen(self, least: np.ndarray) -> list[bytes]:
        """For each blob a bit for each window: whether an earlier document than the sender's holds it."""
        bits = least[self.number] < np.repeat(self.doc, self.windows)
        return [np.packbits(bits[a:b]).tobytes() for a, b in zip(self.bounds, self.bounds[1:], strict=False)]

    def blocks(self, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in range(0, len(self.least), rows):
            yield self.strings(i, i + rows), self.least[i : i + rows]


def _of_segments(blobs: list[bytes], size: int, queue_bytes: int) -> SortedWindows:
    """The windows of blobs of segments, by sorting the segments' suffixes."""
    docs, sizes, data = [], [], []
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n = struct.unpack("<I", raw[:4])[0]
        docs.append(np.frombuffer(raw, "<i8", n, 4))
        sizes.append(np.frombuffer(raw, "<u2", n, 4 + 8 * n).astype(np.int64))
        data.append(np.frombuffer(raw, np.uint8, -1, 4 + 10 * n))
    doc, length, buf = np.concatenate(docs), np.concatenate(sizes), np.concatenate(data)
    start = np.cumsum(length) - length
    pick, back = _distinct(buf, start, length)
    earliest = np.full(len(pick), NO_ID)
    np.minimum.at(earliest, back, doc)
    own_start, own_length = start[pick], length[pick]
    text = np.zeros(int(own_length.sum()) + len(pick), np.uint16)
    at = np.cumsum(own_length + 1) - own_length - 1
    place = np.arange(int(own_length.sum())) + np.repeat(at - (np.cumsum(own_length) - own_length), own_length)
    text[place] = gathered(buf, own_start, own_length).astype(np.uint16) + 1
    owner = np.repeat(np.arange(len(pick)), own_length + 1)
    order, common = sorted_suffixes(text, size, queue_bytes)
    window = np.arange(len(text)) - at[owner] <= own_length[owner] - size
    # a suffix too short to be a window never stands between two equal windows
    own = window[order]
    group = np.cumsum(common < size)[own]
    order = order[own]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    number = np.zeros(len(text), np.int32)
    number[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.r_[first, len(order)]))
    least, shown = np.minimum.reduceat(earliest[owner[order]], first), order[first]
    windows = length - size + 1
    total = np.cumsum(windows)
    number = number[np.arange(int(total[-1])) + np.repeat(at[back] - (total - windows), windows)]
    bounds = np.r_[0, np.cumsum([int((x - size + 1).sum()) for x in sizes])]
    return SortedWindows(lambda i, j: (text[shown[i:j, None] + np.arange(size)] - 1).astype(np.uint8), least, number, doc, windows, bounds)


def _of_windows(blobs: list[bytes], size: int) -> SortedWindows:
    """The windows of blobs of single windows."""
    docs, data = [], []
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n = struct.unpack("<I", raw[:4])[0]
        docs.append(np.frombuffer(raw, "<i8", n, 4))
        data.append(np.frombuffer(raw, np.uint8, n * size, 4 + 8 * n))
    doc, buf = np.concatenate(docs), np.concatenate(data)
    pick, back = _distinct(buf, np.arange(len(doc)) * size, np.full(len(doc), size))
    strings = buf.reshape(-1, size)[pick]
    order = np.argsort(strings.view(f"S{size}").ravel(), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    least = np.full(len(order), NO_ID)
    np.minimum.at(least, place[back], doc)
    return SortedWindows(lambda i, j: strings[order[i:j]], least, place[back], doc, np.ones(len(doc), np.int64), np.r_[0, np.cumsum([len(d) for d in docs])])


def _shard_bits(batches: Iterator[tuple[list[int], list[bytes]]], size: int, sort: Callable[[list[bytes]], SortedWindows], run_bytes: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Slices and bits of a shard, whose blobs come batch by batch; runs of about ``run_bytes`` are sorted one by one, and merged if there are several."""
    keys: list[int] = []
    blobs: list[bytes] = []
    held, merge, waiting = 0, None, None

    def close_run() -> None:
        nonlocal keys, blobs, held, merge, waiting
        run = sort(blobs)
        if merge is None:
            merge, waiting = SortedRuns(size), tempfile.TemporaryFile()
        merge.add(run.blocks(merge.block_rows))
        # what the way back needs; the distinct windows stand in the run
        pickle.dump((keys, run.number, run.doc, run.windows, run.bounds), waiting, protocol=5)
        keys, blobs, held = [], [], 0

    for own, more in batches:
        for key, blob in zip(own, more, strict=True):
            n = zstandard.frame_content_size(blob)
            if blobs and held + n > run_bytes:
                close_run()
            keys.append(key)
            blobs.append(blob)
            held += n
    if merge is None:
        run = sort(blobs)
        yield keys, run.seen(run.least)
        return
    close_run()
    waiting.seek(0)
    for least in merge.least():
        keys, number, doc, windows, bounds = pickle.load(waiting)
        yield keys, SortedWindows(None, least, number, doc, windows, bounds).seen(least)
    merge.close()
    waiting.close()


def repeated_passages(docs: DataFrame, size: int = SIZE, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, spans, kept)`` for every row of ``docs``.

    ``spans`` are the maximal runs of UTF-8 bytes, ``start`` and ``end``, that
    are covered by strings of ``size`` bytes which also start in a document
    with a smaller id, judged on the texts as given; ``kept`` holds the other
    bytes.  Matches never cross documents.  A null text is empty.  Rows with
    the same id take nothing from each other; a row without an id takes nothing
    from others, and gives way to every row with one.  Other columns are
    ignored; an empty table gives an empty result.
    """
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    slice_bytes = int(min(MOST_SLICE_BYTES, max(SLICE_BYTES, total // 4000)))
    slices, shards = int(total // slice_bytes + 1), int(total // SHARD_BYTES + 1)
    run_bytes, queue_bytes = RUN_BYTES, QUEUE_BYTES
    most_segments = SHARD_BYTES // (2 * size - gram)
    buckets = int(total * 2 // (size - gram + 2) // ANCHORS_TOGETHER + 1)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id", "text"), F.lit(slices)).cast("int"))

    def send_anchors(table: pa.Table) -> pa.Table:
        anchor, _, many = Segments(*_texts(table), size, gram).distinct_anchors(_ids(table))
        parts = _cuts(_bucket(anchor, buckets))
        return pa.table({
            "bucket": pa.array([b for b, _, _ in parts], pa.int32()),
            "slice": pa.array([table["slice"][0].as_py()] * len(parts), pa.int32()),
            "anchors": pa.array([anchor[i:j].tobytes() for _, i, j in parts], pa.binary()),
            "many": pa.array([many[i:j].tobytes() for _, i, j in parts], pa.binary()),
        })

    def find_shared(table: pa.Table) -> pa.Table:
        each = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["anchors"]]
        every = np.concatenate(each)
        order = np.argsort(every)
        every = every[order]
        first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, np.int64)
        segments = np.left_shift(1, np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in table["many"]])[order].astype(np.int64))
        hot = every[first[np.add.reduceat(segments, first) > most_segments]] if len(every) else every
        twice = np.unique(every[1:][every[1:] == every[:-1]])

        def among(own: np.ndarray, known: np.ndarray) -> np.ndarray:
            at = np.searchsorted(known, own)
            at[at == len(known)] = 0
            return known[at] == own if len(known) else np.zeros(len(own), bool)

        # two bits an anchor: whether another slice has it, and whether it is hot
        bits = [np.packbits(np.r_[among(own, twice), among(own, hot)]).tobytes() for own in each]
        return pa.table({"bucket": table["bucket"], "slice": table["slice"], "bits": pa.array(bits, pa.binary())})

    def shared_of(table: pa.Table, marks: pa.Table) -> tuple[Segments, SharedSegments, SingleWindows, np.ndarray]:
        doc = _ids(table)
        segments = Segments(*_texts(table), size, gram)
        anchor, here, _ = segments.distinct_anchors(doc)
        hot = np.zeros(len(here), bool)
        bits = {b: x for b, x in zip(marks["bucket"].to_pylist(), marks["bits"].to_pylist(), strict=True)}
        for b, i, j in _cuts(_bucket(anchor, buckets)):
            other, hot[i:j] = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=2 * (j - i)).astype(bool).reshape(2, -1)
            here[i:j] |= other
        return segments, segments.shared(anchor[here & ~hot], doc), segments.single_windows(anchor[here & hot], doc), doc

    def send_segments(table: pa.Table, marks: pa.Table) -> pa.Table:
        out: dict[str, list] = {"shard": [], "slice": [], "segments": []}
        if len(table):
            segments, found, single, doc = shared_of(table, marks)
            own = found.occurrence[found.first]
            length = segments.windows[own] + size - 1
            press = zstandard.ZstdCompressor(level=1)
            for shard, i, j in _cuts(_bucket(segments.anchor[own], shards)):
                data = gathered(segments.buf, segments.start[own[i:j]], length[i:j])
                head = struct.pack("<I", j - i) + doc[segments.row[own[i:j]]].astype("<i8").tobytes() + length[i:j].astype("<u2").tobytes()
                out["shard"].append(shard)
                out["slice"].append(table["slice"][0].as_py())
                out["segments"].append(press.compress(head + data.tobytes()))
            start, holder = single.start[single.first], doc[single.row[single.first]]
            for shard, i, j in _cuts(_bucket(single.key, shards)):
                data = segments.buf[start[i:j, None] + np.arange(size)]
                out["shard"].append(shards + shard)
                out["slice"].append(table["slice"][0].as_py())
                out["segments"].append(press.compress(struct.pack("<I", j - i) + holder[i:j].astype("<i8").tobytes() + data.tobytes()))
        return pa.table({"shard": pa.array(out["shard"], pa.int32()), "slice": pa.array(out["slice"], pa.int32()), "segments": pa.array(out["segments"], pa.binary())})

    def sort_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches)
        shard = first["shard"][0].as_py()
        sort = (lambda blobs: _of_segments(blobs, size, queue_bytes)) if shard < shards else (lambda blobs: _of_windows(blobs, size))
        sent = ((b["slice"].to_pylist(), b["segments"].to_pylist()) for b in chain([first], batches) if len(b))
        for keys, bits in _shard_bits(sent, size, sort, run_bytes):
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard] * len(keys), pa.int32()), "slice": pa.array(keys, pa.int32()), "bits": pa.array(bits, pa.binary())})

    def mark_documents(table: pa.Table, marks: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "spans": pa.array([], span_type), "kept": pa.array([], pa.binary())})
        first = pc.is_valid(marks["anchor_bits"]) if len(marks) else []
        both = [marks.filter(first), marks.filter(pc.invert(first))] if len(marks) else [marks, marks]
        segments, found, single, doc = shared_of(table, both[0].rename_columns(["slice", "bucket", "bits", "shard_bits"]))
        buf, offsets = segments.buf, segments.offsets
        cover = np.zeros(len(buf) + 1, np.int32)
        own = found.occurrence[found.first]
        windows = segments.windows[own]
        bits = dict(zip(both[1]["part"].to_pylist(), both[1]["shard_bits"].to_pylist(), strict=True))
        earlier = [np.unpackbits(np.frombuffer(bits[s], np.uint8), count=int(windows[i:j].sum())).astype(bool) for s, i, j in _cuts(_bucket(segments.anchor[own], shards))]
        earlier = np.concatenate(earlier) if earlier else np.zeros(0, bool)
        place = (np.cumsum(windows) - windows)[found.distinct]
        n = windows[found.distinct]
        total = np.cumsum(n)
        step = np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - n, n)
        late = doc[segments.row[found.occurrence]] > doc[segments.row[own]][found.distinct]
        gone = earlier[step + np.repeat(place, n)] | np.repeat(late, n)
        at = (step + np.repeat(segments.start[found.occurrence], n))[gone]
        earlier = [np.unpackbits(np.frombuffer(bits[shards + s], np.uint8), count=j - i).astype(bool) for s, i, j in _cuts(_bucket(single.key, shards))]
        holder = doc[single.row]
        gone = np.concatenate([np.zeros(0, bool), *earlier])[single.distinct] | (holder > holder[single.first][single.distinct])
        at = np.r_[at, single.start[gone]]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + size, -1)
        covered = np.cumsum(cover[:-1]) > 0
        lo, hi = runs(covered, offsets)
        row = np.searchsorted(offsets, lo, "right") - 1
        kept = np.r_[0, np.cumsum(~covered)][offsets]
        span = pa.StructArray.from_arrays([pa.array((lo - offsets[row]).astype(np.int32)), pa.array((hi - offsets[row]).astype(np.int32))], ["start", "end"])
        return pa.table({
            "doc_id": table["doc_id"],
            "n_bytes": pa.array(np.diff(offsets)),
            "spans": pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(table) + 1)).astype(np.int32)), span),
            "kept": pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(table), [None, pa.py_buffer(kept.astype(np.int64)), pa.py_buffer(buf[~covered])]).cast(pa.binary()),
        })

    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    sent = rows.groupBy("slice").applyInArrow(send_anchors, "bucket int, slice int, anchors binary, many binary")
    marked = sent.groupBy("bucket").applyInArrow(find_shared, "bucket int, slice int, bits binary")
    pieces = rows.groupBy("slice").cogroup(marked.groupBy("slice")).applyInArrow(send_segments, "shard int, slice int, segments binary")
    sorted_ = pieces.groupBy("shard").applyInArrow(sort_shard, "shard int, slice int, bits binary")
    nothing = F.lit(None).cast("binary")
    back = marked.select("slice", F.col("bucket").alias("part"), F.col("bits").alias("anchor_bits"), nothing.alias("shard_bits")).unionByName(
        sorted_.select("slice", F.col("shard").alias("part"), nothing.alias("anchor_bits"), F.col("bits").alias("shard_bits"))
    )
    return rows.groupBy("slice").cogroup(back.groupBy("slice")).applyInArrow(mark_documents, "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
