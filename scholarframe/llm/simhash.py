"""Near-duplicate groups by SimHash fingerprints and a Gray-order index.

Fingerprints that are alike in most bits are found in three steps.

1. *Routing.*  The 64 bits are cut into six blocks.  Two fingerprints that
   differ in at most four bits agree in at least two whole blocks, so a
   fingerprint is sent to one bucket for each pair of blocks (15 of them) and
   no link can be missed.  Only distinct fingerprints travel: exact copies are
   collapsed to their smallest id by a partial aggregation first.
2. *Index.*  In each bucket the fingerprints are sorted by Gray rank, which
   puts fingerprints with few differing bits side by side.  Consecutive ones
   share a node that holds the bits on which all of them agree; nodes share
   nodes above them in turn.  A pair of nodes whose agreed bits already differ
   in too many places is dropped with everything below it.
3. *Components.*  A bucket yields one link from each fingerprint to the
   smallest id of its local group, never the pairs; the links of all buckets
   then go through distributed connected components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarframe.operators.components import connected_components
from scholarframe.session import stored

#: Bit widths of the six routing blocks, lowest bits first.
BLOCKS = (11, 11, 11, 11, 10, 10)
FANOUT = 8
CHUNK = 1 << 18
#: Fingerprints of a bucket from which it is cut further, and rows of whole buckets that a task takes together.
BUCKET_ROWS, TOGETHER = 1 << 18, 1 << 17


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """The SimHash of a text's word shingles as a signed 64-bit number; zero without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        digests = xxhash.xxh64_digest(joined, seed)
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.r_[0, ends[:-1] + 1][: len(words) - width + 1].tolist()
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(joined[i:j], seed) for i, j in zip(starts, ends[width - 1 :].tolist(), strict=True)])
    each = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    total = np.zeros(64, np.int64)
    for i in range(0, len(each), 4096):
        total += np.unpackbits(each[i : i + 4096], axis=1).sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(total * 2 > len(each)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42, keep: list[str] = ()) -> DataFrame:
    """``(id, fp)`` and the columns ``keep`` for every row; null texts have no words and get fingerprint zero."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *keep)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1).cast(pa.binary())
            fps = [fingerprint(x.as_buffer().to_pybytes(), width, seed) if x.is_valid and len(x.as_buffer()) else 0 for x in text]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), *batch.columns[2:]], ["id", "fp", *keep])

    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema[2:])
    return rows.mapInArrow(each, f"id long, fp long{kept}")


def _gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of each bit pattern in the reflected Gray sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp ^ (fp >> np.uint64(shift))
    return fp


class GrayIndex:
    """Fingerprints of one or more buckets, sorted by Gray rank, under shared-pattern nodes."""

    def __init__(self, bucket: np.ndarray, fp: np.ndarray):
        self.order = np.lexsort((_gray_rank(fp), bucket))
        bucket, pattern = bucket[self.order], fp[self.order]
        self.bucket = bucket
        agreed = np.full(len(fp), ~np.uint64(0), np.uint64)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = [(pattern, agreed)]
        self.below: list[tuple[np.ndarray, np.ndarray]] = []
        while len(bucket) and (bucket[1:] == bucket[:-1]).any():
            new = np.r_[True, bucket[1:] != bucket[:-1]]
            first = np.flatnonzero(new)
            place = np.arange(len(bucket)) - first[np.cumsum(new) - 1]
            heads = np.flatnonzero(place % FANOUT == 0)
            ones = np.bitwise_and.reduceat(pattern & agreed, heads)
            zeros = np.bitwise_and.reduceat(~pattern & agreed, heads)
            self.below.append((heads, np.r_[heads[1:], len(bucket)]))
            pattern, agreed, bucket = ones, ones | zeros, bucket[heads]
            self.levels.append((pattern, agreed))

    def _alike(self, label: np.ndarray) -> list[np.ndarray]:
        """For every node of every level the label that all below it have, or -1."""
        out = [label]
        for heads, _ in self.below:
            low, high = np.minimum.reduceat(out[-1], heads), np.maximum.reduceat(out[-1], heads)
            out.append(np.where(low == high, low, -1))
        return out

    def labels(self, within: int) -> np.ndarray:
        """For each fingerprint, in Gray order, the first one of its group: those of its bucket that links of at most ``within`` bits reach.

        Neighbours in Gray order are linked first.  Nodes that hold one group
        only, the same one, need not meet any more, so a large group of near
        copies is not looked at pair by pair.
        """
        n, fp = len(self.order), self.levels[0][0]
        near = np.flatnonzero((np.bitwise_count(fp[1:] ^ fp[:-1]) <= within) & (self.bucket[1:] == self.bucket[:-1]))
        label = smallest_labels(n, iter([(near, near + 1)]))
        groups = self._alike(label)
        top = np.arange(len(self.levels[-1][0]))
        todo = [(len(self.levels) - 1, top[i : i + CHUNK], top[i : i + CHUNK]) for i in range(0, len(top), CHUNK)]
        grid, step = np.arange(FANOUT), CHUNK // (FANOUT * FANOUT)
        while todo:
            level, a, b = todo.pop()
            pattern, agreed = self.levels[level]
            apart = np.bitwise_count((pattern[a] ^ pattern[b]) & agreed[a] & agreed[b])
            open_ = (apart <= within) & ((groups[level][a] < 0) | (groups[level][a] != groups[level][b]))
            a, b = a[open_], b[open_]
            if level == 0:
                if len(a):
                    label = smallest_labels(n, iter([(np.arange(n), label), (a, b)]))
                    groups = self._alike(label)
                continue
            first, stop = self.below[level - 1]
            for i in range(0, len(a), step):
                x, y = a[i : i + step], b[i : i + step]
                left = (first[x][:, None] + grid)[:, :, None] + np.zeros((1, 1, FANOUT), np.int64)
                right = (first[y][:, None] + grid)[:, None, :] + np.zeros((1, FANOUT, 1), np.int64)
                real = (left < stop[x][:, None, None]) & (right < stop[y][:, None, None]) & (left <= right)
                todo.append((level - 1, left[real], right[real]))
        return label


def smallest_labels(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of ``n`` items the smallest item that the links reach."""
    label = np.arange(n)
    for a, b in links:
        while True:
            x, y = label[a], label[b]
            low, high = np.minimum(x, y), np.maximum(x, y)
            if not (low < high).any():
                break
            np.minimum.at(label, high, low)
            while True:
                further = label[label]
                if (further == label).all():
                    break
                label = further
    return label


def _routes(fp: F.Column) -> F.Column:
    """The bucket of each pair of blocks, as an array of longs."""
    at, blocks = 0, []
    for bits in BLOCKS:
        blocks.append(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << bits) - 1)))
        at += bits
    keys = [
        F.shiftleft(F.lit(k).cast("long"), 40).bitwiseOR(F.shiftleft(blocks[i].cast("long"), 11)).bitwiseOR(blocks[j].cast("long"))
        for k, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))
    ]
    return F.array(*keys)


def _finer(fp: F.Column) -> F.Column:
    """A key for each of five sets of every fifth bit; fingerprints of at most four differing bits agree in one of them."""
    masks = [sum(1 << b for b in range(k, 64, 5)) for k in range(5)]
    return F.array(*(F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for k, m in enumerate(masks)))


def _bucket_links(rows: pd.DataFrame, within: int) -> pd.DataFrame:
    """A link from each fingerprint to the smallest ``rep`` of its group, for whole buckets."""
    index = GrayIndex(rows["bucket"].to_numpy(), rows["fp"].to_numpy().view(np.uint64))
    label, rep = index.labels(within), rows["rep"].to_numpy()[index.order]
    least = rep.copy()
    np.minimum.at(least, label, rep)
    linked = least[label] != rep
    return pd.DataFrame({"src": rep[linked], "dst": least[label][linked]}).drop_duplicates()


def fingerprint_links(reps: DataFrame, within: int = 4, most: int = BUCKET_ROWS) -> DataFrame:
    """``(src, dst)`` links that span the groups of fingerprints within ``within`` bits.

    ``reps`` holds one row ``(fp, rep)`` for each distinct fingerprint.  At most
    four bits may differ, as the routing guarantees no more.  Buckets of more
    than ``most`` fingerprints are cut by a further set of bits.  A task takes
    whole buckets, about ``TOGETHER`` rows at a time.
    """
    if within > 4:
        raise ValueError("the routing blocks guarantee links of at most 4 differing bits")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        held = 0
        for batch in batches:
            if not len(batch):
                continue
            waiting.append(batch)
            held += len(batch)
            last = batch["bucket"].iloc[-1]
            if held >= TOGETHER and waiting[0]["bucket"].iloc[0] != last:
                rows = pd.concat(waiting, ignore_index=True)
                begun = rows["bucket"].to_numpy() == last  # the last bucket may go on
                yield _bucket_links(rows[~begun], within)
                waiting, held = [rows[begun]], int(begun.sum())
        if waiting:
            yield _bucket_links(pd.concat(waiting, ignore_index=True), within)

    routed = reps.where("rep is not null").select("rep", "fp", F.explode(_routes(F.col("fp"))).alias("bucket"))
    hot = stored(routed.groupBy("bucket").count().where(F.col("count") > most).select("bucket"), "hot-buckets")
    if not hot.isEmpty():
        finer = routed.join(hot, "bucket", "left_semi").select("rep", "fp", "bucket", F.explode(_finer(F.col("fp"))).alias("key"))
        # two buckets that fall together by their hash only meet in vain
        routed = routed.join(hot, "bucket", "left_anti").unionByName(finer.select("rep", "fp", F.xxhash64("bucket", "key").alias("bucket")))
    return routed.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(each, "src long, dst long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, within: int = 4, seed: int = 42) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    ``fingerprint`` is 16 lowercase hex digits.  ``component_id`` is the
    smallest id reachable over fingerprints that differ in at most ``within``
    bits.  Null and blank texts have fingerprint zero and link like any other.
    Rows with the same id are one document.  A row without an id gets the
    component of its fingerprint, null when no row with an id has it.  An empty
    table gives an empty result; other columns are ignored.
    """
    fps = stored(fingerprints(docs, id_col, text_col, width, seed), "fingerprints")
    reps = stored(fps.groupBy("fp").agg(F.min("id").alias("rep")), "representatives")
    own = fps.where("id is not null").groupBy("id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("id")
    repeated = fps.join(own, "id", "left_semi").join(reps, "fp").select(F.col("id").alias("src"), F.col("rep").alias("dst"))
    found = connected_components(fingerprint_links(reps, within).unionByName(repeated))
    named = reps.join(found, reps["rep"] == found["vertex"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp").select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, within: int = 4, seed: int = 42) -> DataFrame:
    """``docs`` with one row of each near-duplicate group of texts.

    The row with the smallest id stays, one without an id only if no other row
    has one; of rows with that id the one with the smallest digest of its text,
    then of its other columns.  Groups are made by texts alone, so rows with
    one id and unlike texts all stay, and equal rows are reduced to one.
    Columns of any name pass through.
    """
    own = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), own.alias("digest"), F.xxhash64(*docs.columns).alias("rest"))
    fps = stored(fingerprints(rows, "id", "text", width, seed, keep=["digest", "rest"]), "fingerprints")
    reps = stored(fps.select("fp", F.col("fp").alias("rep")).distinct(), "representatives")
    groups = connected_components(fingerprint_links(reps, within))
    # one key for a row, so that the join and the removal of equal rows take one shuffle
    key = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("-")), "digest", "rest")
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "digest", "rest", key.alias("key"))
    grouped = fps.join(groups, fps["fp"] == groups["vertex"], "left").groupBy(F.coalesce("component", "fp").alias("group")).agg(F.min(first).alias("kept"))
    kept = grouped.select("kept.key")
    return rows.select("row", key.alias("key")).join(kept, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
