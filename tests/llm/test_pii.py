import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scholarframe.llm.pii import BASE_KINDS, candidates, estimate, find_spans, luhn, redact, span_classifier


def brute(text):
    """The base rules as plain patterns over the whole text."""
    num = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(num(m[0])) <= 19 and luhn(num(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(num(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], BASE_KINDS.index(x[0])))


def base(text):
    return sorted(((c.kind, c.start, c.end) for c in candidates(text) if c.base), key=lambda x: (x[1], BASE_KINDS.index(x[0])))


TEXTS = [
    "", "a@b.c@d.e.f @x.y a@b", "..%@x-.-.y", "1.2.3.4.5 256.1.1.1 0001.02.3.4 00000000255.1.1.1", "4111 1111 1111 1111 and 4111111111111111-", "4111111111111112",
    "+1 (017) 555-7713 +49 30 123456789012345678 +1", "١٢٣ é1.2.3.4", "x" * 300 + "@mail.example.com", "+41 79 4111 1111 1111 1111", "0" * 5000 + ".1.1.1 1.2.3." + "9" * 5000, "1.2.3.4.5.6.7.8.9 1.2.3.4. 5.6.7.8", "İ mail me@x.org token = \"abcdef123456\"",
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_rules(text):
    assert base(text) == brute(text)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab@..--+()  01245678%é\n"), max_size=60))
def test_base_rules_on_any_text(text):
    assert base(text) == brute(text)


def test_long_texts_take_linear_time():
    """A million digits, cue words, plus signs, signs at or spans of each base kind."""
    for unit in ("7", "token ", "+1 ", "a@", "a@b.c ", "1.2.3.4 ", "1.", "Dr Laura ", "token=" + "a1" * 10 + " ", "+4912345678901 ", "12345678901234567 "):
        text = unit * (1_000_000 // len(unit))
        start = time.perf_counter()
        candidates(text)
        assert time.perf_counter() - start < 20, unit


def planted(rng, n):
    """Texts with personal data that no fixed rule settles, and look-alikes without; each with its true added spans."""
    pick = lambda *x: x[int(rng.integers(0, len(x)))]
    hexes = lambda k: "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, k))
    number = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    out = []
    for _ in range(n):
        first, last = pick("Laura", "Peter", "Maria", "Kenji", "Olga"), pick("Smith", "Meier", "Tanaka", "Rossi")
        kind, before, what = pick(
            ("secret", pick("token = ", "api_key: ", "password="), hexes(24)), ("tel", pick("phone ", "call ", "tel: "), f"555-{number(4)}-{number(2)}"),
            ("name", pick("Dr ", "Mrs ", "Prof "), f"{first} {last}"), ("name", "said ", f"{first} {last}"),
            (None, pick("isbn ", "order ", "invoice "), number(13)), (None, "version ", f"{number(2)}.{number(1)}"), (None, "price ", number(6)), (None, "secret: ", "introduction"), (None, "The ", "Great Wall"),
        )
        head = pick("some words stand here ", "we know that ", "") + before
        out.append((f"{head}{what} and more follow", [(kind, len(head), len(head) + len(what))] if kind else []))
    return out


def test_added_spans_of_planted_texts(spark):
    rows = planted(np.random.default_rng(7), 3000)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: {(s["kind"], s["start"], s["end"]) for s in r["spans"] if not s["base"]} for r in find_spans(df, span_classifier(df)).collect()}
    right = sum(len(found[i] & set(true)) for i, (_, true) in enumerate(rows))
    precision, recall = right / max(1, sum(map(len, found.values()))), right / sum(len(true) for _, true in rows)
    print(f"added spans: precision {precision:.3f}, recall {recall:.3f}")
    assert precision > 0.9 and recall > 0.9


def test_luhn():
    assert luhn("4111111111111111") and not luhn("4111111111111112")


def test_reliable_labelers_are_found():
    rng = np.random.default_rng(1)
    truth = rng.random(20000) < 0.4
    right = np.array([0.95, 0.9, 0.8, 0.6, 0.55])
    votes = np.where(rng.random((20000, 5)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.2] = -1
    patterns, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p = estimate(["tel"] * len(patterns), patterns, counts)[back.ravel()]
    assert ((p > 0.5) == truth).mean() > 0.94
    majority = ((votes == 1).sum(1) > (votes == 0).sum(1)) == truth
    assert ((p > 0.5) == truth).mean() > majority.mean()


def test_spans_and_redaction(spark):
    texts = TEXTS + [None, "clean words only", "call 555-0134-99 now", 'token = "d6e8feb86659fd93a1b2c3d4" end', "Dr Laura Smith wrote", "long " * 50000 + "me@x.org"]
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts * 3)], "doc_id long, text string, spans string, start int").repartition(3)
    model = span_classifier(df)
    got = {r["doc_id"]: r for r in find_spans(df, model).collect()}
    assert len(got) == len(texts) * 3
    for i, t in enumerate(texts * 3):
        assert [(s["kind"], s["start"], s["end"]) for s in got[i]["spans"] if s["base"]] == brute(t or "")
    assert got[len(TEXTS) + 1]["spans"] == []
    assert [s["kind"] for s in got[len(TEXTS) + 3]["spans"]] == ["secret"]
    clean = {r["doc_id"]: r["text"] for r in redact(df, model).collect()}
    assert clean[len(TEXTS)] is None and clean[len(TEXTS) + 1] == "clean words only"
    assert "@" not in clean[len(TEXTS) + 5] and clean[len(TEXTS) + 5].endswith("[EMAIL]")
    assert "4111" not in clean[4]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert find_spans(df, span_classifier(df)).collect() == []


def test_copies_do_not_fill_the_sample(spark):
    """A string with more copies than the sample holds leaves room for the other candidates."""
    secrets = [f'token = "d6e8feb8665{i:04d}a1b2c3d4" end' for i in range(60)]
    for copied in ("mail me@x.org now", "host 10.1.2.3 up", "isbn 12345678901234567", "phone 12345678"):
        rows = [(i, t) for i, t in enumerate([copied] * 3000 + secrets)]
        model = span_classifier(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), sample=200)
        found = find_spans(spark.createDataFrame(rows[3000:], "doc_id long, text string"), model).collect()
        assert all([x["kind"] for x in r["spans"]] == ["secret"] for r in found), copied
