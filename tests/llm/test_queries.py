"""The registered queries on the smallest tables against brute-force versions."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from scholarframe.llm import registry
from tests.llm import test_packing, test_pii, test_pivots, test_simhash, test_suffixdedup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def rows(spark, name, *columns):
    return [tuple(r) for r in registry.QUERIES[name](spark, SF).select(*columns).collect()]


def test_op2(spark, docs):
    want = sorted((k, n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()) for k, n, spans, kept in test_suffixdedup.brute(docs))
    assert sorted(rows(spark, "op2_suffixdedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == want


def test_op3(spark):
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = test_pivots.brute(vectors)
    assert {k: tuple(x) for k, *x in rows(spark, "op3_pivots", "vec_id", "n_links", "component_id", "kept")} == want


def test_op5(spark, docs):
    coder, want = Tokenizer.from_file(registry.tokenizer_file()), Counter()
    for k, t in docs:
        ids = np.array(coder.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for p in range(-(-len(ids) // 2048)):
            own = ids[2048 * p : 2048 * p + 2048]
            want[k, p, 2048 * p, len(own), zlib.crc32(own.tobytes())] += 1
    got = registry.QUERIES["op5_packing"](spark, SF).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    assert test_packing.gapless(got, 2048) <= sum(k[3] * n for k, n in want.items()) / 2048 * 1.02 + 2


def test_op8(spark, docs):
    got = {r[0]: r[1:] for r in rows(spark, "op8_pii", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")}
    for k, text in docs:
        base = test_pii.brute(text or "")
        listed = [":".join(map(str, s)) for s in base]
        counts = [sum(s[0] == kind for s in base) for kind in ("email", "ip", "card", "phone")]
        assert got[k][:5] == (*counts, hashlib.sha256(",".join(listed).encode()).hexdigest())
        assert set(listed) <= set(got[k][5].split(",")) | {""}


def test_op9(spark, docs):
    assert Counter(rows(spark, "op9_simhash", "doc_id", "fingerprint", "component_id")) == test_simhash.brute(docs)


def test_op10(spark, docs):
    coder, at, want = Tokenizer.from_file(registry.tokenizer_file()), 0, []
    for k, t in sorted(docs):
        ids = np.array(coder.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((k, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(rows(spark, "op10_tokenfiles", "doc_id", "start", "n_tokens", "ids_crc32")) == want


@pytest.mark.parametrize("name", ["op1_quality", "op6_toxicity"])
def test_scores(spark, docs, name):
    folds, held = (3, 1) if name == "op1_quality" else (4, 2)
    got = rows(spark, name, "doc_id", "held_out", "score", "predicted")
    assert sorted(r[0] for r in got) == sorted(k for k, _ in docs)
    assert all(h == (zlib.crc32(str(k).encode()) % folds == held) and 0 <= s <= 1 and p == (s >= (0.5 if folds == 3 else 0.3)) for k, h, s, p in got)
