import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import zstandard
from pyspark.sql import GroupedData

from scholarframe.llm import suffixdedup
from scholarframe.llm.sortedruns import SortedRuns
from scholarframe.llm.suffixdedup import repeated_passages
from scholarframe.llm.suffixes import BlockQueues


def brute(rows, size=50):
    first = {}
    for k, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - size + 1):
            s = b[i : i + size]
            if k is not None and (s not in first or k < first[s]):
                first[s] = k
    out = []
    for k, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            f = first.get(b[i : i + size])
            if f is not None and (k is None or f < k):
                gone[i : i + size] = True
        edge = np.flatnonzero(np.diff(np.r_[0, gone, 0]))
        spans = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
        out.append((k, len(b), spans, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in df.collect()), key=str)


def cases(seed=1, n=120):
    rng = np.random.default_rng(seed)
    text = lambda k: "".join("abcdé fg"[x] for x in rng.integers(0, 8, k))
    passages = [text(k) for k in (50, 51, 60, 90, 400, 49)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(int(rng.integers(0, 4))):
            parts += [text(int(rng.integers(0, 70))), passages[int(rng.integers(0, 6))][: int(rng.integers(30, 500))]]
        rows.append((int(rng.integers(0, 400)), "".join(parts)))
    rows += [(900 + i, "x" * 200) for i in range(5)] + [(950, "ab" * 100), (951, "ab" * 100 + "c"), (952, None), (953, ""), (954, "short")]
    rows += [(None, passages[4]), (None, passages[4]), (3, passages[3]), (3, passages[3]), (5000, text(20000)), (2, text(20000)[:60])]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_passages_match_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in (("SLICE_BYTES", 3000), ("SHARD_BYTES", 9000), ("ANCHORS_TOGETHER", 300), ("BLOCK", 500)):
            monkeypatch.setattr(suffixdedup, name, value)
    rows = cases()
    df = spark.createDataFrame([(*r, 4, "s") for r in rows], "doc_id long, text string, slice int, spans string").repartition(3)
    assert got(repeated_passages(df)) == brute(rows)


def test_many_copies(spark):
    rng = np.random.default_rng(4)
    text = "".join("abcdefgh "[x] for x in rng.integers(0, 9, 700))
    rows = [(i, text) for i in range(300)] + [(300 + i, text[i : i + 400]) for i in range(100)]
    assert got(repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "a" * 60)]])
def test_little(spark, rows):
    assert got(repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_common_phrase_with_differing_surroundings(spark, monkeypatch, tmp_path):
    """Segments of one anchor that outgrow a shard are dealt out, and every passage is still found."""
    monkeypatch.setattr(suffixdedup, "SHARD_BYTES", 1500)
    monkeypatch.setattr(suffixdedup, "SLICE_BYTES", 20000)
    rng = np.random.default_rng(7)
    text = lambda k: "".join("abcdefgh"[x] for x in rng.integers(0, 8, k))
    phrase, around = text(40), [(text(40), text(40)) for _ in range(200)]
    rows = []
    for i in range(900):
        left, right = around[int(rng.integers(0, 200))] if i % 3 == 0 else (text(40), text(40))
        rows.append((i, text(20) + left + phrase + right))
    apply, folder = GroupedData.applyInArrow, str(tmp_path)

    def measured(self, find, schema):
        def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = list(batches)
            n = sum(len(zstandard.ZstdDecompressor().decompress(x)) for b in own for x in b["segments"].to_pylist())
            with open(f"{folder}/{own[0]['shard'][0].as_py()}", "w") as f:
                f.write(str(n))
            yield from find(iter(own))

        return apply(self, sized if schema == "shard int, slice int, bits binary" else find, schema)

    monkeypatch.setattr(GroupedData, "applyInArrow", measured)
    want = brute(rows)
    assert got(repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))) == want
    assert sum(len(w[2]) for w in want) > 50
    held = [int(p.read_text()) for p in tmp_path.iterdir()]
    assert held and max(held) < 40_000


def test_unlike_windows_with_one_hash(monkeypatch):
    monkeypatch.setattr(suffixdedup, "span_hashes", lambda buf, a, b: np.zeros(len(a), np.uint64))
    pack = lambda *r: zstandard.ZstdCompressor().compress(struct.pack("<I", len(r)) + np.array([d for d, _ in r], "<i8").tobytes() + b"".join(w for _, w in r))
    found = suffixdedup._of_windows([pack((5, b"ab"), (3, b"a\0")), pack((4, b"ab"), (9, b"a\0"))], 2)
    assert [np.unpackbits(np.frombuffer(x, np.uint8), count=2).astype(bool).tolist() for x in found.seen(found.least)] == [[True, False], [False, True]]


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_runs_are_merged_from_disk(rows):
    rng = np.random.default_rng(rows)
    runs, strings, least = SortedRuns(3, rows), [], {}
    for _ in range(5):
        own = sorted({bytes(rng.integers(0, 4, 3).astype(np.uint8)) for _ in range(int(rng.integers(1, 60)))})
        numbers = rng.integers(0, 1000, len(own))
        for s, n in zip(own, numbers.tolist()):
            least[s] = min(n, least.get(s, n))
        table = np.frombuffer(b"".join(own), np.uint8).reshape(-1, 3)
        runs.add((table[i : i + rows], numbers[i : i + rows]) for i in range(0, len(own), rows))
        strings.append(own)
    assert [x.tolist() for x in runs.least()] == [[least[s] for s in own] for own in strings]


def test_shards_many_times_their_memory_bound(spark, monkeypatch, tmp_path):
    """One shard is sorted in many runs, with queues on disk, and gives what brute force gives."""
    for name, value in (("RUN_BYTES", 4000), ("QUEUE_BYTES", 3000), ("SLICE_BYTES", 4000)):
        monkeypatch.setattr(suffixdedup, name, value)
    add, folder = SortedRuns.add, str(tmp_path)

    def counted(what, call):
        def each(self, *args):
            with open(f"{folder}/{what}", "a") as f:
                f.write("x")
            return call(self, *args)

        return each

    monkeypatch.setattr(SortedRuns, "add", counted("runs", add))
    monkeypatch.setattr(BlockQueues, "spill", counted("spills", BlockQueues.spill))
    rows = cases(5, 200)
    blobs = []
    apply = GroupedData.applyInArrow

    def local(self, find, schema):
        # shards are sorted by this process as well, where the counters are
        if schema == "shard int, slice int, bits binary":
            for (_,), table in _by(self, "shard"):
                blobs.append(sum(b.num_rows for b in find(iter(table.to_batches()))))
        return apply(self, find, schema)

    def _by(grouped, key):
        frame = grouped._df.toArrow()
        for k in sorted(set(frame[key].to_pylist())):
            yield (k,), frame.filter(pc.equal(frame[key], k))

    monkeypatch.setattr(GroupedData, "applyInArrow", local)
    assert got(repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert blobs and (tmp_path / "runs").stat().st_size > 5 and (tmp_path / "spills").stat().st_size > 5


def test_every_hash_may_collide(spark, monkeypatch):
    """With one hash for all ranges the bytes alone decide."""
    found = suffixdedup._distinct(np.frombuffer(b"abcabcxyz", np.uint8), np.array([0, 3, 6]), np.array([3, 3, 3]))
    assert found[1].tolist() == [0, 0, 1]
    monkeypatch.setattr(suffixdedup, "span_hashes", lambda buf, a, b: np.zeros(len(a), np.uint64))
    found = suffixdedup._distinct(np.frombuffer(b"abcxyzabc", np.uint8), np.array([0, 3, 6]), np.array([3, 3, 3]))
    assert found[1].tolist() == [0, 1, 0] and found[0].tolist() == [0, 1]
    first = suffixdedup._firsts(np.frombuffer(b"abcxyzabcabc", np.uint8), np.array([0, 3, 6, 9]), np.full(4, 3), np.zeros(4, np.uint64))
    assert first.tolist() == [0, 1, 2]


def test_repeated_words_with_equal_polynomial_hashes(spark):
    x, y = ("".join(c[bin(i).count("1") % 2] for i in range(4096)) for c in ("ab", "ba"))
    rows = [(1, x), (2, y), (3, x), (4, x[:1024] + "c" + y[:1024]), (5, y[:1024])]
    assert got(repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
