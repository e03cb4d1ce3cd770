import numpy as np
import pytest
import zstandard

from scholarframe.llm.learning import Sample, fit_logistic, labelled_sample, probability, split_of
from scholarframe.llm.quality import quality_scorer, score_quality, train
from scholarframe.llm.registry import op1_quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = op1_quality(spark, SF)
    assert got.count() == 1000
    found = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (found["predicted"] == found["quality"]).mean() > 0.95
    bad, good = found["score"][found["quality"] == 0].to_numpy(), found["score"][found["quality"] == 1].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.95


def test_folds_are_not_learnt_from(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int")
    sample = labelled_sample(docs, labels, "quality", 3, 100)
    assert len(sample.texts) == 6 and all(int(t.split()[1]) < 10 for t in sample.texts)
    assert sample.weights.tolist() == [pytest.approx(5 / 3)] * 6
    assert labelled_sample(docs.repartition(4), labels.repartition(3), "quality", 3, 100).texts == sample.texts


def test_logistic_fit():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(5000, 2))
    y = (rng.random(5000) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 0] - x[:, 1])))).astype(float)
    assert fit_logistic(x, y, np.ones(5000)) == pytest.approx([0.5, 2, -1], abs=0.15)
    assert probability(np.zeros((1, 2)), fit_logistic(np.zeros((0, 2)), np.zeros(0), np.zeros(0))).tolist() == [0.5]


def test_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scorer = quality_scorer(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [(1, None), (2, ""), (3, "word " * 60000), (None, "x"), (4, "same"), (4, "same")]
    df = spark.createDataFrame([(*r, "old") for r in rows], "doc_id long, text string, score string")
    got = score_quality(df, scorer).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert score_quality(df.limit(0), scorer).collect() == []
    assert train(Sample([], np.zeros(0), np.zeros(0))).scores([b"", b"text"]).tolist() == [0.5, 0.5]


def test_every_score_equals_a_plain_computation(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{x}.parquet") for x in ("documents", "labels"))
    scorer = quality_scorer(docs, labels.where(split_of("doc_id", 3) != 1))
    words = lambda data: zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)

    def size(text, data):
        known = words(data)
        known.precompute_compress(level=9)
        return len(zstandard.ZstdCompressor(dict_data=known).compress(text))

    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    for r in op1_quality(spark, "/root/testdata/sf0.001").collect():
        t = texts[r["doc_id"]]
        apart = (size(t, scorer.bad) - size(t, scorer.good)) / (len(t) + 16) if t else 0
        assert r["score"] == pytest.approx(probability(np.array([[10 * apart, apart * np.log1p(len(t))]]), scorer.beta)[0], abs=1e-9)


def test_one_text_of_a_repeated_id(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "c")] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    found = {tuple(sorted(labelled_sample(docs.repartition(k), labels, "quality", 5, 100).texts)) for k in (1, 3, 5)}
    assert len(found) == 1 and len(found.pop()) == 2
