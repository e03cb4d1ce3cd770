import math

import numpy as np
import pytest

from scholarframe.llm.learning import probability, split_of
from scholarframe.llm.registry import op6_toxicity
from scholarframe.llm.toxicity import Lexicon, _folded_sample, fold, learn, score_toxicity, toxicity_lexicon

SF = "/root/testdata/sf0.01"


def brute(lexicon, text):
    """Sum over words of the heaviest term, without an automaton."""
    folded, total = fold(text), 0.0
    words = "".join(c if c.isalnum() else " " for c in folded).split()
    for w in words:
        total += max([lexicon.weights.get(w, 0.0), *(v for t, v in lexicon.weights.items() if t.endswith("*") and len(w) > len(t) - 1 and w.startswith(t[:-1]))])
    return total


@pytest.mark.parametrize("raw", ["idiot", "1d1ot", "IDІОT", "ïdîòt", "i​d­iot", "ｉｄｉｏｔ", "id10t"])
def test_disguises_fold_alike(raw):
    assert fold(raw) == fold("idiot")


def test_matches_equal_a_plain_scan():
    rng = np.random.default_rng(1)
    lexicon = Lexicon({"bad": 1.0, "badd*": 2.5, "ba*": 0.5, "worse": 3.0, "wor*": 4.0})
    for _ in range(300):
        text = "".join("bad wors,e.\n"[x] for x in rng.integers(0, 12, 60))
        assert sum(w for _, _, w in lexicon.matches(fold(text))) == pytest.approx(brute(lexicon, text))


def test_exceptions_spare_a_phrase():
    lexicon = Lexicon({fold("clown"): 2.0}, {fold("clown fish")})
    assert lexicon.matches(fold("a Clown fish swims")) == []
    assert len(lexicon.matches(fold("clown fish, clown"))) == 1
    assert lexicon.matches(fold("clowning")) == []


def learnt(spark, texts, labels):
    rows = [(i, y, t) for i, (t, y) in enumerate(zip(texts, labels))]
    return learn(spark.createDataFrame(rows, "id long, label int, text string").repartition(3), {c: labels.count(c) for c in (0, 1)})


def test_harmless_phrases_are_learnt(spark):
    texts = [f"you clown number{i}" for i in range(30)] + [f"clown fish tank{i}" for i in range(10)] + [f"plain text{i}" for i in range(60)]
    lexicon = learnt(spark, texts, [1] * 30 + [0] * 70)
    assert fold("clown") in lexicon.weights and fold("clown fish") in lexicon.exceptions
    scores = lexicon.scores(["such a clown", "a clown fish", ""])
    assert scores[0] > 0.5 > 0.3 > scores[1] and scores[2] < 0.3


def test_held_out_accuracy(spark):
    got = op6_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["toxic"]).mean() > 0.93
    assert got["score"].between(0, 1).all()


def test_odd_rows(spark):
    lexicon = Lexicon({"bad": 2.0}, beta=np.array([-3.0, 2.0, 1.0, 1.0]))
    rows = [(1, None), (2, ""), (3, "bad"), (3, "bad"), (None, "BAD " * 50000)]
    df = spark.createDataFrame([(*r, "old") for r in rows], "doc_id long, text string, score string")
    got = {(r["doc_id"], r["text"] and r["text"][:3]): r["score"] for r in score_toxicity(df, lexicon).collect()}
    assert got[1, None] == got[2, ""] < 0.1 < 0.5 < got[3, "bad"]
    assert score_toxicity(df.limit(0), lexicon).collect() == []


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    lexicon = toxicity_lexicon(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert lexicon.weights == {} and math.isclose(lexicon.scores(["x"])[0], 0.5)


def test_every_score_equals_a_plain_computation(spark):
    """Scores of the query from its lexicon, but by going through all words and terms."""
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    lexicon = toxicity_lexicon(docs, labels.where(split_of("doc_id", 4) != 2))
    assert lexicon.weights
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in op6_toxicity(spark, SF).collect():
        text = texts[r["doc_id"]]
        total = brute(lexicon, text)
        if not any(p in fold(text) for p in lexicon.exceptions):
            x = np.array([[1, math.log1p(total), math.log1p(1000 * total / (len(text) + 200))]]) if total else np.zeros((1, 3))
            assert r["score"] == pytest.approx(probability(x, lexicon.beta)[0], abs=1e-9)


def test_near_copies_count_once(spark):
    real = [f"number{i} is such a clown and word{i} too" for i in range(12)]
    plain = [f"plain text{i} of day{i}" for i in range(60)]
    lexicon = learnt(spark, ["alike words in this copy zzgrim"] * 40 + real + plain, [1] * 52 + [0] * 60)
    assert fold("clown") in lexicon.weights and fold("zzgrim") not in lexicon.weights


def test_many_hits_and_exceptions():
    """A megabyte in which every hit lies beside an exception takes seconds."""
    import time

    lexicon = Lexicon({"bad": 2.0, "dog": 1.0}, {"bad dog", "dog bad dog"})
    start = time.perf_counter()
    assert lexicon.matches("bad dog " * 125_000) == []
    assert len(lexicon.matches("bad cat dog " * 80_000)) == 160_000
    assert lexicon.matches("dog bad") == [(0, 3, 1.0), (4, 7, 2.0)]
    assert time.perf_counter() - start < 10


def test_near_copies_of_other_labels_stay(spark):
    """A toxic variant of a harmless text is not taken for its copy."""
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, 0, words), (2, 1, words + " foulword"), (3, 1, words + " foulword")]
    kept = _folded_sample(spark.createDataFrame(rows, "id long, label int, text string")).collect()
    assert sorted(r["label"] for r in kept) == [0, 1]
