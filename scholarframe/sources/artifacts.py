"""Files named by the SHA-256 of their bytes: shards written by tasks, payloads, and reads that check the digest first.

A file gets its name only when it is complete, by a rename, and the same bytes
always get the same name; so an attempt that is killed leaves nothing under a
name, and one that is repeated finds its files there.  What belongs to a
dataset is said by its manifest, which the driver writes when all tasks are
done.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from scholarframe.session import stored

#: The most decoded bytes of a shard.
SHARD_BYTES = 4 << 20
_BLOCK = 1 << 20
_ATTEMPTS = "_attempts"


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def name_of(digest: str) -> str:
    """The place of an artifact in its store."""
    return f"{digest[:2]}/{digest}"


class Attempt:
    """Files that one attempt of a task writes; they get their names together, when it is done."""

    def __init__(self, store: str):
        self.system, self.root = _opened(store)
        self.folder = f"{self.root}/{_ATTEMPTS}/{uuid.uuid4().hex}"
        self.waiting: list[str] = []
        self.system.create_dir(self.folder, recursive=True)

    def add(self, content: bytes) -> str:
        digest = hashlib.sha256(content).hexdigest()
        if digest not in self.waiting:
            with self.system.open_output_stream(f"{self.folder}/{digest}") as file:
                file.write(content)
            self.waiting.append(digest)
        return digest

    def name(self) -> None:
        for digest in self.waiting:
            place = f"{self.root}/{name_of(digest)}"
            self.system.create_dir(place.rpartition("/")[0], recursive=True)
            self.system.move(f"{self.folder}/{digest}", place)  # the same bytes, should it be there already
        self.system.delete_dir(self.folder)


# --- shards


@dataclass
class Descriptor:
    """What a reader needs of a shard, and checks it against."""

    kind: str
    part: int
    sequence: int
    sha256: str
    n_rows: int
    n_bytes: int
    n_stored: int
    first: str
    last: str


@dataclass
class Written(WriterCommitMessage):
    shards: list[Descriptor]


class ShardWriter(DataSourceWriter):
    """Rows ``(kind, key, line)`` of a partition, packed in their order into gzip files of lines."""

    def __init__(self, store: str, dataset: str, limit: int):
        self.store, self.dataset, self.limit = store, dataset, limit

    def write(self, iterator) -> Written:
        attempt, out = Attempt(self.store), []
        part = TaskContext.get().partitionId()
        kind, keys, lines, size = None, [], [], 0

        def close() -> None:
            if lines:
                content = gzip.compress(b"".join(lines), mtime=0)
                out.append(Descriptor(kind, part, len(out), attempt.add(content), len(lines), size, len(content), keys[0], keys[-1]))

        for row in iterator:
            line = row["line"].encode() + b"\n"
            if len(line) > self.limit:
                raise ValueError(f"record {row['key']} of {row['kind']} alone is larger than a shard of {self.limit} bytes")
            if lines and (row["kind"] != kind or size + len(line) > self.limit):
                close()
                keys, lines, size = [], [], 0
            kind = row["kind"]
            keys.append(row["key"])
            lines.append(line)
            size += len(line)
        close()
        attempt.name()
        return Written(out)

    def commit(self, messages) -> None:
        """The manifest: the descriptors of all shards in the order of their rows, under the name of the dataset."""
        shards = sorted((d for m in messages if m for d in m.shards), key=lambda d: (d.part, d.sequence))
        system, root = _opened(self.store)
        system.create_dir(f"{root}/manifests", recursive=True)
        place, counts = f"{root}/manifests/{self.dataset}.jsonl", {}
        with system.open_output_stream(f"{place}.next") as file:
            for d in shards:
                number = counts[d.kind] = counts.get(d.kind, -1) + 1
                file.write(json.dumps({"id": f"{d.kind}-{number:06d}", **asdict(d)}, sort_keys=True).encode() + b"\n")
        system.move(f"{place}.next", place)

    def abort(self, messages) -> None:
        """Nothing to undo: no manifest names what tasks wrote."""


class ShardSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "artifact_shards"

    def schema(self) -> str:
        return "kind string, key string, line string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ShardWriter(self.options["path"], self.options["dataset"], int(self.options.get("limit", SHARD_BYTES)))


_MANIFEST = "id string, kind string, part int, sequence int, sha256 string, n_rows long, n_bytes long, n_stored long, first string, last string"


def write_artifact_shards(df: DataFrame, store: str, dataset: str, kind: str, order: list[str], limit: int = SHARD_BYTES) -> DataFrame:
    """Writes the rows of ``df`` as JSON lines in shards of at most ``limit`` decoded bytes, and gives their descriptors.

    A shard holds rows of one kind in the order of ``order``; ranges of that
    order are written side by side.  A row that is larger than a shard fails
    the job, and nothing is cut.  ``first`` and ``last`` of a descriptor are
    the first order column's values.
    """
    spark = df.sparkSession
    spark.dataSource.register(ShardSink)
    rows = df.repartitionByRange(kind, *order).sortWithinPartitions(kind, *order)
    rows = rows.select(F.coalesce(F.col(kind).cast("string"), F.lit("")).alias("kind"), F.coalesce(F.col(order[0]).cast("string"), F.lit("")).alias("key"), F.to_json(F.struct(*df.columns)).alias("line"))
    rows.write.format("artifact_shards").mode("append").options(dataset=dataset, limit=limit).save(store)
    return shard_manifest(spark, store, dataset)


def shard_manifest(spark: SparkSession, store: str, dataset: str) -> DataFrame:
    """The descriptors of a dataset's shards."""
    return spark.read.schema(_MANIFEST).json(f"{store}/manifests/{dataset}.jsonl")


# --- payloads


def put_payloads(df: DataFrame, payload: str, store: str) -> DataFrame:
    """Writes each distinct payload once, and gives ``(sha256, size)`` of all of them; null payloads are left out.

    Payloads are put into one file each, so they fit into a task's memory.
    """
    rows = df.select(F.col(payload).cast("binary").alias("payload")).where(F.col("payload").isNotNull())
    once = rows.groupBy(F.sha2("payload", 256).alias("sha256")).agg(F.first("payload").alias("payload"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, sizes = Attempt(store), []
        for batch in batches:
            sizes += [(attempt.add(p), len(p)) for p in batch.column("payload").to_pylist()]
        attempt.name()
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in sizes], pa.string()), pa.array([n for _, n in sizes], pa.int64())], ["sha256", "size"])

    return stored(once.mapInArrow(put, "sha256 string, size long"), "payloads")


# --- reads under a digest


def _blocks(system: fs.FileSystem, path: str) -> Iterator[bytes]:
    with system.open_input_stream(path) as file:
        while block := file.read(_BLOCK):
            yield block


def problem_of(system: fs.FileSystem, path: str, sha256: str, n_stored: int | None = None) -> str | None:
    """Why a file is not the one that was named, None where it is; read block by block."""
    info = system.get_file_info(path)
    if info.type != fs.FileType.File:
        return "missing"
    if n_stored is not None and info.size != n_stored:
        return "size differs"
    digest = hashlib.sha256()
    for block in _blocks(system, path):
        digest.update(block)
    return None if digest.hexdigest() == sha256 else "digest differs"


def _lines(blocks: Iterator[bytes], zipped: bool, digest) -> Iterator[list[bytes]]:
    """Whole lines, some at a time, of a file whose stored bytes run through ``digest``."""
    unzip, rest = zlib.decompressobj(31) if zipped else None, b""
    for block in blocks:
        digest.update(block)
        while block:
            data = unzip.decompress(block, _BLOCK) if unzip else block
            block = unzip.unconsumed_tail if unzip else b""
            *whole, rest = (rest + data).split(b"\n")
            yield whole
    yield [rest]


def verified_lines(entries: DataFrame, store: str, zipped: bool = False) -> DataFrame:
    """``(path, place, line, problem)``: the lines of the files of ``entries``, and of a file that is not as named only the reason.

    ``entries`` has ``path`` (below ``store``), ``sha256``, and, null where
    they are not known, ``n_stored`` bytes and ``n_rows`` lines that are not
    blank.  A file is read twice, a block at a time: nothing of it is given
    before its digest was found right, and it is never in memory as a whole.
    Blank lines are skipped but count as places.
    """
    columns = [F.col("path").cast("string"), F.col("sha256").cast("string")]
    columns += [(F.col(c) if c in entries.columns else F.lit(None)).cast("long").alias(c) for c in ("n_stored", "n_rows")]
    schema = pa.schema([("path", pa.string()), ("place", pa.int64()), ("line", pa.string()), ("problem", pa.string())])

    def refused(path: str, why: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"path": path, "problem": why}], schema)

    def one(system: fs.FileSystem, root: str, path: str, sha256: str, n_stored: int | None, n_rows: int | None) -> Iterator[pa.RecordBatch]:
        place = f"{root}/{path}"
        if why := problem_of(system, place, sha256, n_stored):
            yield refused(path, why)
            return
        try:
            counted = sum(bool(line.strip()) for some in _lines(_blocks(system, place), zipped, hashlib.sha256()) for line in some) if n_rows is not None else None
        except zlib.error:
            yield refused(path, "not a compressed file")
            return
        if counted != n_rows:
            yield refused(path, "number of rows differs")
            return
        digest, at = hashlib.sha256(), 0
        for some in _lines(_blocks(system, place), zipped, digest):
            own = [(at + i, line) for i, line in enumerate(some) if line.strip()]
            at += len(some)
            if own:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(own)), pa.array([i for i, _ in own], pa.int64()), pa.array([line.decode("utf-8", "replace") for _, line in own]), pa.nulls(len(own), pa.string())], schema=schema
                )
        if digest.hexdigest() != sha256:
            raise OSError(f"{path} changed while it was read")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _opened(store)
        for batch in batches:
            for entry in batch.to_pylist():
                yield from one(system, root, entry["path"], entry["sha256"], entry["n_stored"], entry["n_rows"])

    return entries.select(*columns).mapInArrow(each, "path string, place long, line string, problem string")


def read_artifact_shards(spark: SparkSession, store: str, dataset: str, kinds: list[str] | None = None) -> DataFrame:
    """The lines of a dataset's shards, all or those of some kinds, each shard checked against its descriptor."""
    shards = shard_manifest(spark, store, dataset)
    shards = shards if kinds is None else shards.where(F.col("kind").isin(*kinds))
    n = max(1, spark.sparkContext.defaultParallelism * 2)
    entries = shards.select(F.concat(F.substring("sha256", 1, 2), F.lit("/"), "sha256").alias("path"), "sha256", "n_stored", "n_rows").repartition(n, "path")
    return verified_lines(entries, store, zipped=True)


def verified_payloads(refs: DataFrame, store: str) -> DataFrame:
    """``(sha256, size, verified)``: whether the file of each payload is the one that was named, null where there is none.

    Tasks go by the names, so no list of the files is made.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _opened(store)
        for batch in batches:
            found = [problem_of(system, f"{root}/{name_of(s)}", s, n) for s, n in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            good = [None if why == "missing" else why is None for why in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(good, pa.bool_())], ["sha256", "size", "verified"])

    return refs.select("sha256", "size").mapInArrow(each, "sha256 string, size long, verified boolean")


def verified_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, sha256, verified, length)``: files below a folder named by the SHA-256 of their content, and whether it matches."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    named = files.withColumn("sha256", F.regexp_extract("path", "([0-9a-f]{64})$", 1)).where(F.col("sha256") != "")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [problem_of(*_opened(p), s, n) is None for p, n, s in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(good, pa.bool_()), batch.column(1)], ["path", "sha256", "verified", "length"])

    return named.select("path", "length", "sha256").mapInArrow(each, "path string, sha256 string, verified boolean, length long")
