"""Token ids in files of independent zstandard frames with a seek table.

A file holds the ids of consecutive documents as little-endian unsigned 32-bit
numbers, cut into frames at document ends.  Each frame decompresses by itself.
After the frames come two skippable frames, which plain zstandard readers
ignore: the documents' ids and token counts, and the seek table of the public
seekable format, with the compressed size, the size and the checksum (low 32
bits of XXH64) of every frame, found from the last nine bytes of the file.  A
reader fetches the table and the frames it needs, no others.

Tasks write under names of their own attempt; only files named in the returned
manifest count, so a task that is run again leaves no harm.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholarframe.llm.columns import slices
from scholarframe.llm.packing import with_end
from scholarframe.llm.pieces import encoder
from scholarframe.session import stored

# Numbers of the public seekable format.
SKIPPABLE, INDEX_MAGIC, TABLE_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: A frame ends with the first document that brings it to so many ids.
FRAME_IDS = 1 << 15
LEVEL = 3
#: Documents of a batch of a reader, and most ids that are broadcast to one.
ROWS, MOST_WANTED = 1000, 1 << 20


class TokenFileWriter:
    """Writes one file to a binary stream, document by document."""

    def __init__(self, out, frame_ids: int = FRAME_IDS):
        self.out, self.frame_ids = out, frame_ids
        self.press = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.entries: list[tuple[int, int, int]] = []
        self.doc_ids: list[np.ndarray] = []
        self.known: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.waiting: list[bytes] = []
        self.n_waiting = self.n_ids = self.written = 0

    def _frame(self) -> None:
        data = b"".join(self.waiting)
        packed = self.press.compress(data)
        self.out.write(packed)
        self.entries.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.written += len(packed)
        self.waiting, self.n_waiting = [], 0

    def add(self, doc_ids: np.ndarray, known: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> None:
        """Documents ``bounds[i]:bounds[i + 1]`` of ``ids``; ``known`` is false for a null id."""
        data, sizes = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), np.diff(bounds)
        self.doc_ids.append(doc_ids)
        self.known.append(known)
        self.sizes.append(sizes)
        self.n_ids += int(sizes.sum())
        first = 0
        while first < len(sizes):
            stop = int(np.searchsorted(bounds, bounds[first] + self.frame_ids - self.n_waiting))
            stop = min(max(stop, first + 1), len(sizes))
            self.waiting.append(bytes(data[4 * int(bounds[first]) : 4 * int(bounds[stop])]))
            self.n_waiting += int(bounds[stop] - bounds[first])
            if self.n_waiting >= self.frame_ids:
                self._frame()
            first = stop

    def id_range(self) -> tuple[int | None, int | None]:
        """The least and the greatest document id, None without any."""
        ids = np.concatenate([*(d[k] for d, k in zip(self.doc_ids, self.known, strict=True)), np.zeros(0, np.int64)])
        return (int(ids.min()), int(ids.max())) if len(ids) else (None, None)

    def close(self) -> tuple[int, int, int]:
        """Writes the index and the table; gives documents, ids and bytes."""
        if self.waiting:
            self._frame()
        doc_ids = np.concatenate([*self.doc_ids, np.zeros(0, np.int64)])
        index = b"".join((doc_ids.astype("<i8").tobytes(), np.concatenate([*self.known, np.zeros(0, bool)]).astype(np.uint8).tobytes(), np.concatenate([*self.sizes, np.zeros(0, np.int64)]).astype("<u4").tobytes()))
        index = struct.pack("<Q", len(doc_ids)) + zstandard.ZstdCompressor(level=LEVEL, write_checksum=True).compress(index)
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        self.entries.append((len(index) + 8, 0, 0))
        table = b"".join(struct.pack("<III", *e) for e in self.entries)
        footer = struct.pack("<IBI", len(self.entries), 0x80, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(table) + len(footer)) + table + footer)
        self.written += len(index) + len(table) + len(footer) + 16
        return len(doc_ids), self.n_ids, self.written


class TokenFile:
    """Random access to one file through ``read(at, size)``; decompresses only frames that are asked for."""

    def __init__(self, source, size: int):
        self.source = source
        n, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != FOOTER_MAGIC or not flags & 0x80:
            raise ValueError("not a seekable token file")
        self.table = np.frombuffer(self._read(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.places = np.r_[0, np.cumsum(self.table[:, 0])]
        raw = self._read(int(self.places[n - 1]) + 8, int(self.table[n - 1, 0]) - 8)
        docs = struct.unpack("<Q", raw[:8])[0]
        index = zstandard.ZstdDecompressor().decompress(raw[8:], max_output_size=13 * docs) if docs else b""
        self.doc_ids = np.frombuffer(index, "<i8", docs)
        self.known = np.frombuffer(index, np.uint8, docs, 8 * docs).astype(bool)
        self.sizes = np.frombuffer(index, "<u4", docs, 9 * docs).astype(np.int64)
        self.starts = np.r_[0, np.cumsum(self.sizes)]
        self.frame_starts = np.r_[0, np.cumsum(self.table[:, 1])] // 4
        self.last: tuple[int, np.ndarray] | None = None

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def frame(self, k: int) -> np.ndarray:
        """The ids of frame ``k``, checked against its checksum."""
        if self.last is None or self.last[0] != k:
            data = zstandard.ZstdDecompressor().decompress(self._read(int(self.places[k]), int(self.table[k, 0])), max_output_size=int(self.table[k, 1]))
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.table[k, 2]:
                raise ValueError(f"frame {k} does not match its checksum")
            self.last = k, np.frombuffer(data, "<u4")
        return self.last[1]

    def document(self, i: int) -> np.ndarray:
        """The ids of the ``i``-th document of the file."""
        k = int(np.searchsorted(self.frame_starts, self.starts[i], "right")) - 1
        first = int(self.starts[i] - self.frame_starts[k])
        return self.frame(k)[first : first + int(self.sizes[i])]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents in ascending order of id; gives ``(part, path, n_docs, n_ids, n_bytes, first_id, last_id, base)`` for each file.

    ``base`` is the number of ids in all files before, ``first_id`` and
    ``last_id`` bound the documents' ids, null if all are.  Null ids come first, a
    null text is empty, and rows with the same id stand side by side in the
    order of their texts' hashes.  ``folder`` is one that all executors share.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task = encoder(tokenizer), TaskContext.get()
        system, root = fs.FileSystem.from_uri(folder)
        writer = out = None
        path = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}.tokens.zst"
        for batch in batches:
            for a, b in slices(batch.column(1)):
                if writer is None:
                    system.create_dir(root, recursive=True)
                    out = system.open_output_stream(path, compression=None)
                    writer = TokenFileWriter(out)
                key = batch.column(0).slice(a, b - a)
                ids, bounds = with_end(*coder.encode(batch.column(1).slice(a, b - a)), end_id)
                writer.add(key.fill_null(0).to_numpy(), key.is_valid().to_numpy(zero_copy_only=False), ids, bounds)
        if writer is not None:
            n_docs, n_ids, n_bytes = writer.close()
            out.close()
            own = writer.id_range()
            yield pa.RecordBatch.from_pydict({
                "part": [task.partitionId()], "path": [path], "n_docs": [n_docs], "n_ids": [n_ids], "n_bytes": [n_bytes],
                "first_id": pa.array([own[0]], pa.int64()), "last_id": pa.array([own[1]], pa.int64()),
            })

    manifest = stored(rows.mapInArrow(each, "part long, path string, n_docs long, n_ids long, n_bytes long, first_id long, last_id long"), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _columns(file: TokenFile, rows: list[int], base: int, with_ids: bool) -> pa.RecordBatch:
    own, at = [file.document(k) for k in rows], np.array(rows, np.int64)
    out = {
        "doc_id": pa.array(file.doc_ids[at], mask=~file.known[at]),
        "start": pa.array(base + file.starts[at]),
        "n_tokens": pa.array(file.sizes[at]),
        "ids_crc32": pa.array([zlib.crc32(x) for x in own], pa.int64()),
    }
    if with_ids:
        out["ids"] = pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32()))
    return pa.RecordBatch.from_pydict(out)


def _read(manifest: DataFrame, folder: str, with_ids: bool, wanted: Broadcast | None = None) -> DataFrame:
    """The documents of each file, or those whose ids are ``wanted``, one file a task."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, base, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if wanted is not None and (first is None or np.searchsorted(wanted.value, first) == np.searchsorted(wanted.value, last, "right")):
                    continue
                with system.open_input_file(path) as source:
                    file = TokenFile(source, system.get_file_info(path).size)
                    rows = range(len(file.doc_ids)) if wanted is None else np.flatnonzero(file.known & np.isin(file.doc_ids, wanted.value)).tolist()
                    for i in range(0, len(rows), ROWS):
                        yield _columns(file, list(rows[i : i + ROWS]), base, with_ids)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    files = max(1, manifest.count())
    return manifest.repartitionByRange(files, "part").select("path", "base", "first_id", "last_id").mapInArrow(each, schema)


def read_token_files(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32[, ids])`` of every document, from the files of a manifest."""
    return _read(manifest, folder, with_ids)


def read_documents(manifest: DataFrame, folder: str, wanted: DataFrame, id_col: str = "doc_id", with_ids: bool = True, most_wanted: int = MOST_WANTED) -> DataFrame:
    """What :func:`read_token_files` gives for the documents whose ids are in ``wanted``; null ids ask for nothing.

    Up to ``most_wanted`` distinct ids are broadcast: files whose range of ids
    holds none of them are not opened, and of the others only the index and the
    frames with wanted documents are read.  More ids than that touch most
    frames anyway, so then all documents are read and joined with the ids.
    """
    ids = wanted.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    known = ids.limit(most_wanted + 1).toArrow()["doc_id"].to_numpy()
    if len(known) > most_wanted:
        return read_token_files(manifest, folder, with_ids).join(ids, "doc_id", "left_semi")
    return _read(manifest, folder, with_ids, manifest.sparkSession.sparkContext.broadcast(np.sort(known)))


def new_folder(shared: str) -> str:
    """A fresh folder for token files under a shared one."""
    return f"{shared.rstrip('/')}/tokens-{uuid.uuid4().hex}"
