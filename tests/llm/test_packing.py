import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from scholarframe.llm.packing import OpenBins, pack, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def rows_of(rng, n):
    words = ["alpha", "Beta,", "gamma-ray", "naïve", "42", "don't", "\n"]
    return [" ".join(words[x] for x in rng.integers(0, len(words), int(rng.integers(0, 400)))) for _ in range(n)]


def gapless(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_match_the_library(spark):
    library, texts = Tokenizer.from_file(PATH), rows_of(np.random.default_rng(1), 120)
    docs = [(i, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (None, "null id"), (502, "long words " * 9000), (503, "same"), (503, "same")]
    df = spark.createDataFrame([(*d, 7, "x") for d in docs], "doc_id long, text string, piece int, offset string").repartition(3)
    got = pack_documents(df, PATH, with_ids=True).collect()
    assert gapless(got, 2048) <= sum(r["length"] for r in got) / 2048 * 1.02 + 2
    want = []
    for k, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        for p, start in enumerate(range(0, len(ids), 2048)):
            own = np.array(ids[start : start + 2048], "<u4")
            want.append((k, p, start, len(own), zlib.crc32(own.tobytes()), own.tolist()))
    keep = lambda x: sorted(x, key=str)
    assert keep((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], r["ids"]) for r in got) == keep(want)


def test_many_tasks_waste_little(spark):
    rng = np.random.default_rng(4)
    sizes = np.minimum(2048, rng.lognormal(5.8, 1.1, 20000).astype(int) + 1)
    df = spark.createDataFrame([(i, 0, int(n)) for i, n in enumerate(sizes)], "doc_id long, piece int, length long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = pack(df).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) == len(sizes)
    assert gapless(rows, 2048) <= sizes.sum() / 2048 * 1.01 + 3


def test_the_fullest_bin_closes_first():
    bins = OpenBins(10, 2)
    assert [bins.put(n)[0] for n in (6, 7, 8)] == [0, 1, 2]  # the third closes bin 1, with 3 free
    assert bins.put(3) == (0, 6)
    assert bins.put(2) == (2, 8)
    assert bins.put(10) == (3, 0)


@pytest.mark.parametrize("docs", [[], [(None, None)]])
def test_empty(spark, docs):
    got = pack_documents(spark.createDataFrame(docs, "doc_id long, text string"), PATH).collect()
    assert [(r["piece"], r["length"], r["offset"]) for r in got] == [(0, 1, 0)] * len(docs)
