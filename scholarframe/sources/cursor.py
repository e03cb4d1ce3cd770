"""A provider's records as a Spark data source, for batches and for streams.

A provider lists its records by when they were last revised and by id, and the
pages it gave lie as JSON-lines files (``.json``, ``.jsonl``) in a folder, each in that order.  The
offset of a stream is the key ``(updated, id)`` of the last record taken, so
records of one instant may be parted by a page's end, a page that repeats
records already taken adds nothing, and a batch that failed is read again from
the key before it.
"""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

Key = tuple[str, str]
#: Before the first key.
START: Key = ("", "")
_TAIL = 1 << 16


class Page(InputPartition):
    """The records of one page after one key and up to another; without keys all of them."""

    def __init__(self, path: str, after: Key | None = None, upto: Key | None = None):
        self.path, self.after, self.upto = path, after, upto


def _key(record: dict) -> Key:
    return str(record.get("updated") or ""), str(record.get("id") or "")


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def _pages(folder: str) -> list[str]:
    system, root = _opened(folder)
    found = system.get_file_info(fs.FileSelector(root))
    return sorted(f.path for f in found if f.is_file and f.base_name.endswith((".json", ".jsonl")) and f.size)


def _bounds(folder: str, path: str) -> tuple[Key, Key] | None:
    """The first and the last key of a page, from its ends; None for a page without records."""
    system, _ = _opened(folder)
    with system.open_input_file(path) as page:
        size = page.size()

        def ends(take: int) -> tuple[bytes, bytes]:
            page.seek(0)
            head = page.read(min(take, size))
            page.seek(max(0, size - take))
            return head.lstrip(), page.read(take).rstrip()

        take = _TAIL
        head, tail = ends(take)
        while take < size and (b"\n" not in head or b"\n" not in tail):
            take *= 4
            head, tail = ends(take)
    if not tail:
        return None
    return _key(json.loads(head.split(b"\n", 1)[0])), _key(json.loads(tail.rsplit(b"\n", 1)[-1]))


def _records(folder: str, page: Page):
    system, _ = _opened(folder)
    before = START
    with system.open_input_stream(page.path) as lines:
        rest = b""
        while True:
            block = lines.read(1 << 20)
            *whole, rest = (rest + block).split(b"\n") if block else [rest, b""]
            for line in whole:
                if not line.strip():
                    continue
                record = json.loads(line)
                key = _key(record)
                if key < before:
                    raise ValueError(f"{page.path} is not in the order of its keys at {key}")
                before = key
                if (page.after is None or key > page.after) and (page.upto is None or key <= page.upto):
                    yield record.get("id"), record.get("updated"), json.dumps(record, sort_keys=True)
            if not block:
                return


class RecordSource(DataSource):
    """``spark.read.format("provider_records").load(folder)``, one partition for each page.

    Options for streams: ``cursor``, a file that holds the key up to which
    records were taken and committed, and from which a stream without
    checkpoint starts; ``overlap``, seconds before the cursor that are read
    again with each batch, for providers that list some records late.
    """

    @classmethod
    def name(cls) -> str:
        return "provider_records"

    def schema(self) -> str:
        return "id string, updated string, payload string"

    def reader(self, schema) -> DataSourceReader:
        return RecordReader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return RecordStream(self.options["path"], self.options.get("cursor"), float(self.options.get("overlap", "0")))


class RecordReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Page]:
        return [Page(p) for p in _pages(self.folder)]

    def read(self, partition: Page):
        return _records(self.folder, partition)


def committed(cursor: str) -> Key:
    """The key in a cursor file, the start where there is none."""
    system, path = _opened(cursor)
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return START
    with system.open_input_stream(path) as file:
        return _as_key(json.loads(file.read()))


def _as_key(offset: dict) -> Key:
    return offset["updated"], offset["id"]


def _as_offset(key: Key) -> dict:
    return {"updated": key[0], "id": key[1]}


class RecordStream(DataSourceStreamReader):
    def __init__(self, folder: str, cursor: str | None, overlap: float):
        self.folder, self.cursor, self.overlap = folder, cursor, overlap
        self.known: dict[str, tuple[Key, Key] | None] = {}

    def _ranges(self) -> dict[str, tuple[Key, Key]]:
        """The key ranges of all pages; the ends of a page are read once."""
        for path in _pages(self.folder):
            if path not in self.known:
                self.known[path] = _bounds(self.folder, path)
        return {p: r for p, r in self.known.items() if r}

    def initialOffset(self) -> dict:  # noqa: N802
        return _as_offset(committed(self.cursor) if self.cursor else START)

    def latestOffset(self) -> dict:  # noqa: N802
        last = max((r[1] for r in self._ranges().values()), default=START)
        return max(_as_offset(last), self.initialOffset(), key=_as_key)

    def partitions(self, start: dict, end: dict) -> list[Page]:
        after, upto = _as_key(start), _as_key(end)
        if after == upto:
            return []
        if self.overlap and after != START:
            at = datetime.fromisoformat(after[0]) - timedelta(seconds=self.overlap)
            zone = "Z" if after[0].endswith("Z") else ""
            after = (at.replace(tzinfo=None).isoformat() + zone if zone else at.isoformat(), "")
        return [Page(p, after, upto) for p, (first, last) in sorted(self._ranges().items()) if last > after and first <= upto]

    def read(self, partition: Page):
        return _records(self.folder, partition)

    def commit(self, end: dict) -> None:
        """Moves the cursor file on; Spark calls this when the batch that ends there was processed."""
        if self.cursor:
            system, path = _opened(self.cursor)
            with system.open_output_stream(f"{path}.next") as file:
                file.write(json.dumps(end).encode())
            system.move(f"{path}.next", path)
