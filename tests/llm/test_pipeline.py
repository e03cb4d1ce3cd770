import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from scholarframe.llm import pii, quality
from scholarframe.llm.registry import tokenizer_file
from tests.llm.test_contamination import brute as contaminated
from tests.llm.test_simhash import brute as near_duplicates

SF = "/root/testdata/sf0.001"


def test_pipeline_matches_brute_force(spark):
    table = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    docs = [(r["doc_id"], r["text"]) for r in table("documents").collect()]
    scorer = quality.quality_scorer(table("documents"), table("labels"))
    good = [d for d, s in zip(docs, scorer.scores([(t or "").encode() for _, t in docs])) if s >= 0.5]
    assert 0 < len(good) < len(docs)
    kept = {k for k, _, least in near_duplicates(good) if k == least}
    unique = [d for d in good if d[0] in kept]
    assert 0 < len(unique) < len(good)
    items = [(str(r["item_id"]), r["text"]) for r in table("benchmark").collect()]
    hit = {r[0] for r in contaminated(unique, items) if r[2]}
    clean = [d for d in unique if d[0] not in hit]
    assert 0 < len(clean) < len(unique)
    frame = spark.createDataFrame(clean, "doc_id long, text string")
    redacted = [(r["doc_id"], r["text"]) for r in pii.redact(frame, pii.span_classifier(frame)).collect()]
    assert sum(a != b for a, b in zip(sorted(redacted), sorted(clean)))
    assert not any(c.base for _, t in redacted for c in pii.candidates(t))
    coder, want = Tokenizer.from_file(tokenizer_file()), Counter()
    for k, t in redacted:
        ids = np.array(coder.encode(t, add_special_tokens=False).ids + [0], "<u4")
        for p in range(-(-len(ids) // 2048)):
            own = ids[2048 * p : 2048 * p + 2048]
            want[k, p, 2048 * p, len(own), zlib.crc32(own.tobytes())] += 1
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got) == want
    full = Counter()
    for r in got:
        full[r["sequence_id"]] += r["length"]
    assert max(full.values()) <= 2048


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []


def test_stages_take_odd_rows(spark):
    """Null and empty texts, null and repeated ids, repeated rows and columns with names that operators use."""
    rows = [(1, None), (1, "twice the id"), (1, "another text"), (None, "no id"), (None, "no id"), (2, ""), (3, "word " * 60000), (3, "word " * 60000), (4, "me@example.org wrote")]
    names = ("__quality", "fp", "row", "spans", "bin", "shard", "key", "rest", "piece_of", "tie")
    frame = spark.createDataFrame([(*r, *names) for r in rows], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names)).repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, frame, SF)
        assert got.columns == frame.columns, name
        found = Counter(tuple(r) for r in got.collect())
        assert all(k[2:] == names for k in found), name
        if name in ("near_duplicates", "decontamination"):
            assert set(found) <= {(*r, *names) for r in rows}
        if name == "near_duplicates":
            assert sorted(k[1][:5] for k in found if k[1]) == ["anoth", "me@ex", "no id", "twice", "word "]
    packed = Counter(r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, frame, SF).collect())
    assert packed.keys() == {1, None, 2, 3, 4} and packed[None] == 2
