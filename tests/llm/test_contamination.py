import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholarframe.llm.contamination import contaminated_spans, n_hit, without_contaminated
from scholarframe.llm.registry import op4_decontamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = []
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        windows += [(item, w[i : i + n]) for i in range(len(w) - n + 1)] if n else []
    out = []
    for k, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, x in windows:
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == x:
                    hit |= set(range(i, i + len(x)))
                    found |= {item} - {None}
        out.append((k, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return sorted(out, key=str)


def cases():
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 60, n))
    items = [("b1", text(30)), ("b2", text(14)), ("b10", text(10)), ("b3", "Only FOUR words here"), ("b4", "one"), ("b5", ""), ("b6", None), (None, "no id for these four"), ("b7", text(9)), ("b1", text(12))]
    items.append(("b8", items[0][1]))
    docs = [(i, text(int(rng.integers(0, 80)))) for i in range(60)]
    for i, (_, t) in enumerate(items):
        w = (t or "").split()
        docs.append((100 + i, f"{text(5)} {t} {text(7)}"))
        docs.append((200 + i, f"{text(3)}, {' - '.join(w[2:14]).upper()}; {text(4)}"))
        docs.append((300 + i, " ".join(w[:9])))
    x, y = ("".join(c[bin(i).count("1") % 2] for i in range(1024)) for c in ("ab", "ba"))  # unlike words whose polynomial hashes agree
    items += [("b9", f"{x} b c d e f g h i j k"), ("b11", y)]
    docs += [(600, f"{y} b c d e f g h i j k"), (601, f"o {x} b c d e f g h i j"), (602, x), (603, y), (604, f"a {y} {x}")]
    docs += [(500, None), (501, ""), (502, "..."), (None, items[0][1]), (503, "only four\nwords   HERE only four words here"), (503, "only four words here"), (504, "Ünï 中文 only four words here" + " long" * 30000), (505, "one one")]
    return docs + docs[70:75], items


def digest(df):
    rows = df.select("doc_id", "n_words", n_hit(F.col("spans")).alias("n"), F.size("items").alias("m"), F.sha2(F.array_join("items", ","), 256).alias("h"))
    return sorted((tuple(r) for r in rows.collect()), key=str)


@pytest.mark.parametrize("block_bytes", [8 << 20, 150])
def test_spans_match_brute_force(spark, block_bytes):
    docs, items = cases()
    d = spark.createDataFrame([(*x, 1, "q") for x in docs], "doc_id long, text string, n_words int, spans string").repartition(3)
    b = spark.createDataFrame([(*x, 5) for x in items], "item_id string, text string, doc_id int")
    assert digest(contaminated_spans(d, b, block_bytes=block_bytes)) == brute(docs, items)


def test_empty_tables(spark):
    d, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id string, text string")
    assert contaminated_spans(d, b).collect() == []
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert digest(contaminated_spans(one, b)) == brute([(1, "a b")], [])
    assert contaminated_spans(d, spark.createDataFrame([("a", "x y")], "item_id string, text string")).collect() == []


def test_clean_rows_stay_whole(spark):
    docs, items = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("lang", F.lit("en"))
    b = spark.createDataFrame(items, "item_id string, text string")
    kept = sorted((tuple(r)[:2] for r in without_contaminated(d, b).collect()), key=str)
    clean = [x for x in docs if not brute([x], items)[0][2]]
    assert kept == sorted(clean, key=str)


def test_query_columns(spark):
    got = op4_decontamination(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
