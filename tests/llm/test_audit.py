"""The audit of filters against filters that are run one after the other."""

import re
from itertools import permutations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scholarframe.llm.audit import filter_audit, interactions, joint_failures

DOCS = "doc_id long, text string, lang string"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
        "D": bool(re.search("[#$%&*|]", text)),
    }


def played(rows, names):
    """Each order run step by step; ``rows`` are (part, failing names, good, toxic)."""
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        own = {}
        for order in permutations(names):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = sum(f in r[1] for r in mine)
                own["".join(order), step] = f, [len(left), len(gone), failing - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        total = {f: sum(v[1] for g, v in own.values() if g == f) for f in names}
        out |= {(part, *k): (*v, total[f]) for k, (f, v) in own.items()}
    return out


def brute(docs, labels):
    good, toxic = {k for k, q, _ in labels if q == 1} - {None}, {k for k, _, t in labels if t == 1} - {None}
    rows = []
    for k, t, lang, *_ in docs:
        own = {f for f, x in fails(t or "").items() if x}
        if k is not None and any(j is not None and j < k and (s or "") == (t or "") for j, s, *_ in docs):
            own.add("E")
        rows.append((lang or "", own, k in good, k in toxic))
    return played(rows, "ABCDE")


def got(df):
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in df.collect()}


def test_hard_cases(spark):
    long = " ".join(f"w{i}" for i in range(300))
    docs = [
        (1, long, "en"), (2, long, "de"), (2, long, "de"), (3, long, None), (None, long, "en"), (None, None, ""), (4, "", "en"), (5, None, "en"), (5, "", "en"),
        (6, "word " * 400, "en"), (7, "A" * 10 + long, "en"), (8, long + " 5%", "fr"), (9, "\x0b \t é" + long + "\x0c\r\n", "fr"), (10, "B C #" * 90, "fr"), (11, "  " * 300, "fr"),
        (12, "ab " * 300_000, "xx"), (13, "ab " * 300_000, "xx"), (0, "\n" * 1000, "xx"), (-3, long, "en"), (15, "İ" * 97 + "ABC", "yy"), (16, "İ" * 96 + "ABCD", "yy"), (4, "", "en"),
    ]
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, None), (5, 0, 1), (None, 1, 1), (6, None, 1), (13, 1, 1), (99, 1, 1), (-3, 1, 0)]
    d, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert got(filter_audit(d, lab)) == brute(docs, labels)
    clash = d.select("*", *(F.lit(7).alias(c) for c in ("A", "E", "part", "n", "id", "digest", "salt", "is_good", "quality", "toxic", "subset", "__text", "__words")))
    assert got(filter_audit(clash.repartition(7), lab.withColumn("text", F.lit("x")))) == brute(docs, labels)


def test_empty(spark):
    d, lab = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(d, lab).count() == 0
    one = spark.createDataFrame([(1, "x", "en")], DOCS)
    assert got(filter_audit(one, lab)) == brute([(1, "x", "en")], [])


def test_hot_group(spark):
    """Copies of one text, in two parts, many without an id."""
    docs = [(i if i % 3 else None, "copy", "en" if i % 2 else "de") for i in range(600)] + [(1000 + i, f"own {i}", "en") for i in range(50)]
    labels = [(i, i % 2, i % 5 == 0) for i in range(0, 700, 7)]
    labels = [(k, q, int(t)) for k, q, t in labels]
    assert got(filter_audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))) == brute(docs, labels)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.booleans(), st.booleans(), st.booleans(), st.integers(0, 3)), min_size=1, max_size=30))
def test_any_filters(spark, rows):
    names = ["p", "q", "r"]
    df = spark.createDataFrame(rows, "p boolean, q boolean, r boolean, good int").withColumn("all", F.lit("x"))
    found = interactions(joint_failures(df, names, ["all"], {"n": F.lit(1), "good": F.col("good")}), names, ["all"], ["n", "good"])
    want = played([("x", {f for f, x in zip(names, r, strict=False) if x}, r[3], 0) for r in rows], "pqr")
    assert {("x", r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], 0, r["shapley"]) for r in found.collect()} == want
