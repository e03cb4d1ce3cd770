"""Benchmark passages in documents, by a prefix-filtered containment join.

A window is a run of consecutive words of a benchmark item.  Its tokens are
its word shingles; containment of the whole window makes one token, the rarest
in the corpus, a necessary one, so a document position can only begin a window
if the window's rarest shingle occurs at the one place where it would have to
stand.  Positions pass a bound on the document's length on both sides, and
what is left is compared word by word over the whole window: first by the
words' hashes, and where those agree by their bytes.

The benchmark is the query set.  It is read in blocks of a fixed number of
bytes, and only a block is ever broadcast; documents are scanned once to count
the block's shingles and once to match, whatever the size of the benchmark.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarframe.llm.columns import BASE, flat, gathered, mixed, runs, same_bytes, slices, span_hashes
from scholarframe.session import stored

#: Words of a window, words of a shingle, and bytes of benchmark text in a block.
WINDOW, SHINGLE, BLOCK_BYTES = 10, 5, 8 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
INSIDE = np.zeros(256, bool)
INSIDE[48:58] = INSIDE[97:123] = INSIDE[128:] = True

SPANS = "array<struct<start:int,stop:int>>"


@dataclass
class Words:
    """The words of a column of texts: the lowered bytes, where each word lies, its hash, and ``n + 1`` offsets of the rows.

    Words are runs of digits, of letters with A-Z lowered, and of any character
    outside ASCII; in UTF-8 those are exactly the runs of such bytes.
    """

    buf: np.ndarray
    start: np.ndarray
    size: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray


def words_of(column: pa.Array) -> Words:
    buf, offsets = flat(column)
    low = LOWER[buf]
    starts, ends = runs(INSIDE[low], offsets)
    return Words(low, starts, ends - starts, span_hashes(low, starts, ends), np.searchsorted(starts, offsets))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of the ``size`` words that begin at each place, as far as there are so many."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for i in range(1, size):
        out *= np.uint64(BASE)
        out += words[i : i + n]
    return mixed(out)


class Members:
    """Membership of hashes in a fixed set; most others fall at a bitmap."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        self.shift = np.uint64(64 - max(16, int(len(keys)).bit_length() + 5))
        self.map = np.zeros(1 << (64 - int(self.shift)), bool)
        self.map[(self.keys >> self.shift).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes that are members, and their index in ``keys``."""
        at = np.flatnonzero(self.map[(hashes >> self.shift).astype(np.int64)])
        index = np.searchsorted(self.keys, hashes[at])
        index[index == len(self.keys)] = 0
        real = self.keys[index] == hashes[at] if len(self.keys) else np.zeros(len(at), bool)
        return at[real], index[real]


@dataclass
class Vocabulary:
    """The distinct words of a block, told apart by their bytes, with the hash of each."""

    buf: np.ndarray
    start: np.ndarray
    size: np.ndarray
    hashes: np.ndarray

    @staticmethod
    def of(words: Words) -> tuple["Vocabulary", np.ndarray]:
        """The vocabulary, and the number in it of each word."""
        places = pa.py_buffer(np.r_[0, np.cumsum(words.size)])
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words.size), [None, places, pa.py_buffer(gathered(words.buf, words.start, words.size))]).dictionary_encode()
        buf, at = flat(found.dictionary)
        return Vocabulary(buf, at[:-1], np.diff(at), span_hashes(buf, at[:-1], at[1:])), np.asarray(found.indices).astype(np.int64)


@dataclass
class Windows:
    """The distinct windows of one length, as words of the block's vocabulary, and the items that hold them."""

    words: np.ndarray
    hashes: np.ndarray
    items: list[list[int]]

    @property
    def length(self) -> int:
        return self.words.shape[1]

    @property
    def size(self) -> int:
        return min(SHINGLE, self.length)

    def shingles(self) -> np.ndarray:
        """A row of shingle hashes for each window."""
        places = self.length - self.size + 1
        return np.stack([shingle_hashes(self.hashes[:, i : i + self.size].ravel(), self.size)[:: self.size] for i in range(places)], axis=1)


def windows_of(texts: list[str | None], window: int = WINDOW) -> tuple[Vocabulary, list[Windows]]:
    """The vocabulary of a block's items and their distinct windows, by length."""
    words = words_of(pa.array(texts, pa.string()))
    vocabulary, number = Vocabulary.of(words)
    held: dict[int, dict[bytes, list[int]]] = defaultdict(dict)
    for item in range(len(texts)):
        own = number[words.offsets[item] : words.offsets[item + 1]]
        n = min(window, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            items = held[n].setdefault(own[i : i + n].tobytes(), [])
            if not items or items[-1] != item:
                items.append(item)
    each = [(np.frombuffer(b"".join(x), np.int64).reshape(-1, n), list(x.values())) for n, x in sorted(held.items())]
    return vocabulary, [Windows(w, vocabulary.hashes[w], items) for w, items in each]


def _shingle_counts(docs: DataFrame, keys: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """How often each shingle of a block occurs in all documents; as many numbers as the block has shingles."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = {size: Members(k) for size, k in keys.items()}
        total = {size: np.zeros(len(k), np.int64) for size, k in keys.items()}
        for batch in batches:
            for a, b in slices(batch.column(0)):
                words = words_of(batch.column(0).slice(a, b - a))
                for size, known in members.items():
                    at, index = known.find(shingle_hashes(words.hashes, size))
                    inside = at + size <= words.offsets[np.searchsorted(words.offsets, at, "right")]
                    total[size] += np.bincount(index[inside], minlength=len(known.keys))
        for size, n in total.items():
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"size": pa.array([size] * len(seen), pa.int32()), "place": seen, "n": n[seen]})

    rows = docs.select("text").mapInArrow(each, "size int, place long, n long").groupBy("size", "place").agg(F.sum("n").alias("n")).toArrow()
    out = {size: np.zeros(len(k), np.int64) for size, k in keys.items()}
    size, place, n = (rows.column(c).to_numpy() for c in ("size", "place", "n"))
    for s in out:
        out[s][place[size == s]] = n[size == s]
    return out


def _same_words(words: Words, vocabulary: Vocabulary, start: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Whether the words from each place on are those of the row of ``wanted`` beside it, byte by byte."""
    pairs, back = np.unique((start[:, None] + np.arange(wanted.shape[1])) * len(vocabulary.size) + wanted, return_inverse=True)
    place, number = np.divmod(pairs, max(len(vocabulary.size), 1))
    same = same_bytes(words.buf, words.start[place], words.size[place], vocabulary.buf, vocabulary.start[number], vocabulary.size[number])
    return same[back.reshape(wanted.shape)].all(axis=1)


def _found(docs: DataFrame, vocabulary: Vocabulary | None, groups: list[Windows], rarest: list[tuple[np.ndarray, np.ndarray]], ids: list[str | None]) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` and ``items`` for one block."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((vocabulary, groups, rarest, ids))
    kept = [c for c in docs.columns if c != "text"]

    def match(words: Words, vocabulary: Vocabulary, tables: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, lengths, hit_by = [], [], []
        offsets = words.offsets
        hashes: dict[int, np.ndarray] = {}
        for g, (group, members, first, window, offset) in enumerate(tables):
            if group.size not in hashes:
                hashes[group.size] = shingle_hashes(words.hashes, group.size)
            at, index = members.find(hashes[group.size])
            count = first[index + 1] - first[index]
            pick = np.arange(count.sum()) + np.repeat(first[index] - (np.cumsum(count) - count), count)
            start = np.repeat(at, count) - offset[pick]
            win = window[pick]
            own = np.searchsorted(offsets, np.repeat(at, count), "right")
            fits = (start >= offsets[own - 1]) & (start + group.length <= offsets[own])
            start, win = start[fits], win[fits]
            for k in range(group.length):
                same = words.hashes[start + k] == group.hashes[win, k]
                start, win = start[same], win[same]
            same = _same_words(words, vocabulary, start, group.words[win])
            start, win = start[same], win[same]
            starts.append(start)
            lengths.append(np.full(len(start), group.length))
            hit_by.append(np.c_[np.full(len(win), g), win])
        return np.concatenate(starts), np.concatenate(lengths), np.concatenate(hit_by)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, groups, rarest, ids = shared.value
        tables = []
        for group, (tokens, places) in zip(groups, rarest, strict=True):
            members = Members(np.unique(tokens))
            order = np.argsort(tokens, kind="stable")
            first = np.r_[np.searchsorted(tokens[order], members.keys), len(tokens)]
            tables.append((group, members, first, order, places[order]))
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            for a, b in slices(text):
                words = words_of(text.slice(a, b - a))
                n, offsets = b - a, words.offsets
                spans: list[list] = [[] for _ in range(n)]
                items: list[list] = [[] for _ in range(n)]
                if tables and len(words.start):
                    start, length, by = match(words, vocabulary, tables)
                    edge = np.zeros(len(words.start) + 1, np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + length, -1)
                    lo, hi = runs(np.cumsum(edge[:-1]) > 0, offsets)
                    owner = np.searchsorted(offsets, lo, "right") - 1
                    for row, x, y in zip(owner.tolist(), (lo - offsets[owner]).tolist(), (hi - offsets[owner]).tolist(), strict=True):
                        spans[row].append({"start": x, "stop": y})
                    pairs = np.unique(np.c_[np.searchsorted(offsets, start, "right") - 1, by], axis=0)
                    for row, g, win in pairs.tolist():
                        items[row] += groups[g].items[win]
                named = [sorted({ids[i] for i in x if ids[i] is not None}) if x else x for x in items]
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [own.column(own.schema.get_field_index(c)) for c in kept]
                    + [pa.array(np.diff(offsets)), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), pa.array(named, pa.list_(pa.string()))],
                    [*kept, "n_words", "spans", "items"],
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(each, f"{schema}, n_words long, spans {SPANS}, items array<string>")


def _block(docs: DataFrame, rows: list, window: int) -> DataFrame:
    vocabulary, groups = windows_of([r["text"] for r in rows], window)
    keys: dict[int, np.ndarray] = {}
    for group in groups:
        keys[group.size] = np.union1d(keys.get(group.size, np.zeros(0, np.uint64)), group.shingles())
    counts = _shingle_counts(docs, keys) if keys else {}
    rarest = []
    for group in groups:
        shingles = group.shingles()
        often = counts[group.size][np.searchsorted(keys[group.size], shingles)]
        place = often.argmin(axis=1)
        rarest.append((shingles[np.arange(len(shingles)), place], place))
    return _found(docs, vocabulary, groups, rarest, [r["id"] for r in rows])


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list]:
    """Rows of the benchmark, block by block, fetched partition by partition."""
    block, size = [], 0
    for row in benchmark.toLocalIterator():
        block.append(row)
        size += len(row["text"] or "")
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def _merged(spans: F.Column) -> F.Column:
    """Sorted spans with those that touch or overlap joined."""
    empty = F.expr(f"cast(array() as {SPANS})")

    def add(done: F.Column, x: F.Column) -> F.Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"))
        apart = (F.size(done) == 0) | (x["start"] > F.try_element_at(done, F.lit(-1))["stop"])
        return F.when(apart, F.concat(done, F.array(x))).otherwise(F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined)))

    return F.aggregate(F.array_sort(spans), empty, add)


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, n_words, spans, items)`` for every row of ``docs``.

    ``spans`` are the maximal runs of words inside any occurrence of a window
    of ``window`` consecutive item words, as word places from 0, the end
    exclusive.  An item of fewer words is one window; one without words has
    none.  ``items`` are the ids, as strings in order and each once, of the
    items of which a window occurs; items without an id mark words but are not
    listed.  A null text has no words.  Rows stay as they are, repeated ones
    and those without an id too; other columns are ignored.  An empty benchmark
    leaves every row without spans.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    query = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(item_text_col).cast("string").alias("text"))
    blocks = _blocks(query, block_bytes)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return _block(rows, first, window)
    keyed = rows.withColumn("key", F.sha2(F.col("text"), 256))
    parts = []
    while first:
        found = _block(keyed, first, window).where("size(spans) > 0").dropDuplicates(["doc_id", "key"])
        parts.append(stored(found.select("doc_id", "key", "spans", "items"), "contaminated"))
        first, second = second, next(blocks, None) if second else None
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    hits = hits.groupBy(F.col("doc_id").alias("id"), F.col("key").alias("of")).agg(
        _merged(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    plain = _found(keyed, None, [], [], []).select("doc_id", "key", "n_words")
    return plain.join(hits, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("of")), "left").select(
        "doc_id", "n_words", F.coalesce("spans", F.expr(f"cast(array() as {SPANS})")).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items")
    )


def n_hit(spans: F.Column) -> F.Column:
    """The number of words in spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows in which a window of the benchmark occurs.

    All columns pass through the scan, so nothing is shuffled; each block of
    the benchmark filters what the one before it left.
    """
    query = benchmark.select(F.lit("").alias("id"), F.col(item_text_col).cast("string").alias("text"))
    for block in _blocks(query, block_bytes):
        rows = docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("text"))
        docs = _block(rows, block, window).where("size(spans) = 0").select("row.*")
    return docs
