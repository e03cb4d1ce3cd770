"""Personal data by weak supervision: labelers vote, their reliabilities are estimated, a span classifier decides.

Candidates are strings that look like addresses, numbers, secrets or names.
Five labelers each vote for, against, or not at all: the shape of the string,
its check digits or ranges, gazetteers, cue words nearby, and the characters
around it.  How often each pattern of votes occurs is counted over the whole
corpus; expectation maximisation finds how reliable each labeler is for each
kind and how likely each pattern is personal data.  A logistic model of
votes and of the string itself, fitted to those probabilities on a bounded
sample of candidates, decides about candidates that no fixed rule settles.
Emails, IP addresses, cards and phone numbers that pass their fixed rule are
always kept.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarframe.llm.columns import slices
from scholarframe.llm.learning import fit_logistic, probability, smallest
from scholarframe.session import stored

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "tel", "secret", "name")
LABELERS = ("shape", "check", "gazetteer", "context", "edges")
#: Distinct candidates the classifier is fitted on, those with the smallest hash.
SAMPLE = 20_000
CUE_REACH = 32

# The rules of the base kinds.
EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# begun at a run's first digit and without going back, which finds the same addresses in linear time
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
LOWER = {c: c + 32 for c in range(65, 91)}

SECRET_TAIL = re.compile(r"\s{0,4}[=:]\s{0,4}[\"']?([A-Za-z0-9_+/.-]{12,}=*)")
TEL_TAIL = re.compile(r"[\s:.#]{1,6}(\(?[0-9][0-9 ().-]{5,18}[0-9])")
NAME_TAIL = re.compile(r"\.? ([A-Z][a-z'-]+(?: [A-Z][a-z'-]+)?)")
SURNAME = re.compile(r" [A-Z][a-z'-]+")

# Gazetteers and cue words.
CUES = {
    "email": "email e-mail mail contact write",
    "ip": "ip host server address login",
    "card": "card visa mastercard amex credit debit payment",
    "phone": "phone tel telephone mobile cell call fax whatsapp",
    "account": "account iban acct passport ssn licence",
    "tel": "phone tel telephone mobile cell call fax",
    "secret": "token secret password passwd apikey api_key access_key",
    "name": "mr mrs ms dr prof herr frau mme sra name",
}
AGAINST = "version isbn issn doi order invoice price total page vol section license licence"
GIVEN_NAMES = (
    "Adam Agnes Ahmed Aisha Alan Albert Alejandro Alex Alexander Alice Amanda Amelia Amy Ana Andrea Andrew Angela Anita Anna Anne Anthony Antonio Aria Arthur "
    "Barbara Beatriz Benjamin Bernd Beth Betty Brian Bruno Camille Carl Carla Carlos Carmen Carol Caroline Charles Charlotte Chloe Christian Christine Christopher Claire Claudia Clara "
    "Daniel David Deborah Diana Diego Dmitri Donald Dorothy Edward Elena Elias Elizabeth Ella Emily Emma Eric Erik Eva Fatima Fernando Francesca Francis Frank Gabriel George Giulia Grace Greta "
    "Hanna Hannah Hans Harry Heather Heinz Helen Helga Henri Henry Ian Ingrid Irene Isabel Isabella Ivan Jack Jacob James Jan Jane Janet Jason Javier Jean Jennifer Jessica Joan Johann John Jonas Jorge Jose Joseph Joshua Juan Judith Julia Julie Justin "
    "Karen Karin Karl Katherine Keith Kenji Kenneth Kevin Klaus Laura Lena Leo Li Liam Linda Lisa Louis Louise Lucas Lucia Luis Lukas Manuel Marco Margaret Maria Marie Mario Mark Markus Martha Martin Mary Matthew Maya Michael Miguel Mohammed Monica "
    "Nancy Natalie Nicolas Nina Noah Nora Olga Oliver Olivia Omar Oscar Otto Pablo Pamela Patricia Patrick Paul Paula Pedro Peter Petra Philip Pierre Priya Rachel Ralph Ravi Raymond Rebecca Richard Robert Roger Rosa Ruth "
    "Sabine Samuel Sandra Sara Sarah Sergei Sharon Silvia Simon Sofia Sophia Sophie Stefan Stephen Steven Susan Thomas Timothy Tobias Ursula Victor Vincent Walter Wei William Wolfgang Yuki Yusuf"
).split()
#: Generic top domains; every country has two letters.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz name pro aero coop museum jobs mobi travel tel cat asia post app dev io ai online site shop store tech blog cloud email agency science".split())
#: Country calling codes of one and of two digits, and the tens of those of three.
CALLING_CODES = tuple("1 7 20 27 28 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split())
#: Address ranges that name no host on the public network, as prefixes.
RESERVED = ("0.", "10.", "127.", "169.254.", "192.0.2.", "192.168.", "198.18.", "198.19.", "198.51.100.", "203.0.113.", *(f"172.{n}." for n in range(16, 32)), *(f"{n}." for n in range(224, 256)))


@dataclass(frozen=True)
class Gazetteers:
    """The lists that the gazetteer labeler looks strings up in; give longer ones where they are at hand."""

    given_names: frozenset[str] = frozenset(GIVEN_NAMES)
    top_domains: frozenset[str] = TOP_DOMAINS
    calling_codes: tuple[str, ...] = CALLING_CODES
    reserved: tuple[str, ...] = RESERVED


KNOWN = Gazetteers()


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their signs at."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        found = EMAIL_TAIL.match(text, at) if start < at else None
        if found:
            floor = found.end()
            yield start, floor
        at = text.find("@", max(floor, at + 1))


def digits_of(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


@dataclass(slots=True)
class Candidate:
    kind: str
    start: int
    end: int
    base: bool
    votes: tuple[int, ...] = ()


@cache
def _cue_automaton(lists: Gazetteers) -> ahocorasick.Automaton:
    found, meant = ahocorasick.Automaton(), {}
    for kind, words in CUES.items():
        for w in words.split():
            meant.setdefault(w, set()).add(kind)
    for w in AGAINST.split():
        meant.setdefault(w, set()).add("against")
    for w in lists.given_names:
        meant.setdefault(w.lower(), set()).add("given")
    for w, kinds in meant.items():
        found.add_word(w, (len(w), frozenset(kinds)))
    found.make_automaton()
    return found


def _cues(text: str, lists: Gazetteers) -> list[tuple[int, int, frozenset]]:
    """Cue words in the order of their ends."""
    low = text.lower()
    if len(low) != len(text):  # a letter that becomes two would move the places after it
        low = text.translate(LOWER)
    out = []
    for last, (size, kinds) in _cue_automaton(lists).iter(low):
        start, end = last - size + 1, last + 1
        if (start == 0 or not low[start - 1].isalnum()) and (end == len(low) or not low[end].isalnum()):
            out.append((start, end, kinds))
    return out


def _ip_holds(s: str) -> bool:
    parts = [p.lstrip("0") for p in s.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def candidates(text: str, lists: Gazetteers = KNOWN) -> list[Candidate]:
    """Everything the labelers vote on, with their votes; base spans are marked.  Linear in the text's length."""
    found: list[Candidate] = []
    if "@" in text:
        found += [Candidate("email", a, b, True) for a, b in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            found.append(Candidate("ip", m.start(), m.end(), _ip_holds(m[0])))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = digits_of(m[0])
                good = 14 <= len(digits) <= 19 and luhn(digits)
                if good or 12 <= len(digits) <= 30:
                    found.append(Candidate("card" if good else "account", m.start(), m.end(), good))
        if "+" in text:
            for m in PHONE.finditer(text):
                good = 10 <= len(digits_of(m[0])) <= 15
                found.append(Candidate("phone" if good else "tel", m.start(), m.end(), good))
    cues = _cues(text, lists)
    for start, end, kinds in cues:
        if "secret" in kinds and (m := SECRET_TAIL.match(text, end)):
            found.append(Candidate("secret", m.start(1), m.end(1), False))
        elif "tel" in kinds and (m := TEL_TAIL.match(text, end)):
            found.append(Candidate("tel", m.start(1), m.end(1), False))
        elif "name" in kinds and text[start].isupper() and (m := NAME_TAIL.match(text, end)):
            found.append(Candidate("name", m.start(1), m.end(1), False))
        elif "given" in kinds and text[start].isupper() and (m := SURNAME.match(text, end)):
            found.append(Candidate("name", start, m.end(), False))
    settled = _joined((c.start, c.end) for c in found if c.base)
    begins, ends = [a for a, _ in settled], [b for _, b, _ in cues]
    out, seen = [], set()
    for c in found:
        k = bisect_left(begins, c.end) - 1  # the last settled span that begins before the end
        if (c.kind, c.start, c.end) in seen or (not c.base and k >= 0 and settled[k][1] > c.start):
            continue
        seen.add((c.kind, c.start, c.end))
        near = cues[bisect_left(ends, c.start - CUE_REACH) : bisect_right(ends, c.start)]
        c.votes = _votes(text, c, near, lists)
        out.append(c)
    return out


def _joined(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, with those that overlap joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _votes(text: str, c: Candidate, near: list, lists: Gazetteers) -> tuple[int, ...]:
    """1 for, 0 against, -1 none, by each labeler; ``near`` are the cues that end shortly before."""
    s = text[c.start : c.end]
    digits = digits_of(s)
    shape = {"account": 14 <= len(digits) <= 19, "tel": 7 <= len(digits) <= 15, "name": " " in s, "secret": bool(DIGIT.search(s)) and not s.isdigit()}.get(c.kind, True) or c.base
    check = {"email": -1, "ip": int(c.base), "card": 1, "account": 0, "phone": 1, "tel": -1, "name": -1, "secret": int(len(set(s)) >= 8 and not s.isalpha())}[c.kind]
    if c.kind == "email":
        top = s.rpartition(".")[2].lower()
        listed = int(top in lists.top_domains or (len(top) == 2 and top.isalpha()))
    elif c.kind == "ip":
        listed = int(c.base and not ".".join(p.lstrip("0") or "0" for p in s.split(".")).startswith(lists.reserved))
    elif c.kind in ("card", "account"):
        listed = int(digits[:1] in "3456")
    elif c.kind in ("phone", "tel"):
        listed = int(digits.startswith(lists.calling_codes)) if s.startswith("+") else -1
    elif c.kind == "name":
        listed = int(s.split(" ")[0] in lists.given_names)
    else:
        listed = -1
    context = 1 if any(c.kind in k for _, _, k in near) else 0 if any("against" in k for _, _, k in near) else -1
    left, right = text[c.start - 1 : c.start], text[c.end : c.end + 1]
    return int(shape), check, listed, context, int(not (left.isalnum() or right.isalnum()))


def features(text: str, c: Candidate) -> list[float]:
    """What the classifier sees of a candidate."""
    s = text[c.start : c.end]
    n = len(s)
    own = [float(c.kind == k) for k in KINDS]
    votes = [float(v == 1) for v in c.votes] + [float(v == 0) for v in c.votes]
    return own + votes + [min(n, 64) / 64, len(digits_of(s)) / n, sum(x.isalpha() for x in s) / n, len(set(s)) / n]


N_FEATURES = len(KINDS) + 2 * len(LABELERS) + 4


def estimate(kinds: list[str], votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """The probability of being personal data for each pattern of votes, by expectation maximisation.

    ``votes`` has a row for each pattern, ``counts`` how often it occurs.  For
    each kind, each labeler's votes are independent given the truth; the first
    guess is the share of votes for.  Labelers start out better than chance, so
    that the two classes keep their meaning.
    """
    out = np.full(len(kinds), 0.5)
    for kind in set(kinds):
        at = np.array([i for i, k in enumerate(kinds) if k == kind])
        v, n = votes[at], counts[at].astype(float)
        cast = np.maximum((v >= 0).sum(axis=1), 1)
        p = 0.05 + 0.9 * (v == 1).sum(axis=1) / cast
        for _ in range(rounds):
            prior = (n @ p + 1) / (n.sum() + 2)
            logit = np.full(len(v), np.log(prior / (1 - prior)))
            for j in range(v.shape[1]):
                for value in (1, 0):
                    mine = v[:, j] == value
                    lean = 2.0 if value == 1 else 1.0
                    true = (n[mine] @ p[mine] + lean) / (n @ p + 4)
                    false = (n[mine] @ (1 - p[mine]) + 3 - lean) / (n @ (1 - p) + 4)
                    logit[mine] += np.log(true / false)
            new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            if np.abs(new - p).max() < 1e-7:
                break
            p = new
        out[at] = p
    return out


def _corpus_key(docs: DataFrame, text_col: str) -> bytes:
    """A key that the whole corpus gives, the same in any order, and that no one has who cannot read the corpus."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sums = docs.agg(*(F.coalesce(F.sum(F.xxhash64(F.lit(salt), text).cast("decimal(20,0)")), F.lit(0)) for salt in range(4))).first()
    return hashlib.sha256(",".join(map(str, sums)).encode()).digest()


def _candidate_rows(docs: DataFrame, text_col: str, lists: Gazetteers) -> DataFrame:
    """The candidates of all texts, their strings as digests under a key, as numbers alone could be found by trying all."""
    rows, key = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null"), _corpus_key(docs, text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0)):
                found = [(t, c) for t in batch.column(0).slice(a, b - a).to_pylist() for c in candidates(t, lists)]
                yield pa.RecordBatch.from_pydict({
                    "kind": pa.array([c.kind for _, c in found], pa.string()),
                    "votes": pa.array([",".join(map(str, c.votes)) for _, c in found], pa.string()),
                    "string": pa.array([hashlib.blake2b(t[c.start : c.end].encode(), key=key, digest_size=32).hexdigest() for t, c in found], pa.string()),
                    "seen": pa.array([features(t, c) for t, c in found], pa.list_(pa.float64())),
                })

    return rows.mapInArrow(each, "kind string, votes string, string string, seen array<double>")


def span_classifier(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, lists: Gazetteers = KNOWN) -> np.ndarray:
    """Coefficients of the span classifier, from the votes on all candidates of ``docs``.

    Vote patterns are counted over every document; there are at most a few
    thousand of them however many documents there are.  The sample is drawn
    from distinct candidates, which weigh by the logarithm of how often they
    occur, so copies of one neither fill it nor outweigh the others.  What is
    kept of a candidate between the two passes is a digest under a key, not the string.
    """
    own = ["kind", "string", "votes", "seen"]
    rows = stored(_candidate_rows(docs, text_col, lists).groupBy(*own).agg(F.count("*").alias("copies")), "candidates")
    patterns = rows.groupBy("kind", "votes").agg(F.sum("copies").alias("n"), F.count("*").alias("distinct")).orderBy("kind", "votes").collect()
    votes = np.array([list(map(int, r["votes"].split(","))) for r in patterns], int).reshape(-1, len(LABELERS))
    found = estimate([r["kind"] for r in patterns], votes, np.array([r["n"] for r in patterns]))
    likely = {(r["kind"], r["votes"]): p for r, p in zip(patterns, found, strict=True)}
    drawn = smallest(rows, own, F.xxhash64(*own), sample, sum(r["distinct"] for r in patterns)).select("kind", "votes", "seen", "copies").collect()
    x = np.array([r["seen"] for r in drawn], float).reshape(-1, N_FEATURES)
    weights = 1 + np.log(np.array([r["copies"] for r in drawn], float))
    return fit_logistic(x, np.array([likely[r["kind"], r["votes"]] for r in drawn], float), weights, penalty=0.5)


def find_spans(docs: DataFrame, classifier: np.ndarray, text_col: str = "text", into: str = "spans", least: float = 0.5, lists: Gazetteers = KNOWN) -> DataFrame:
    """``docs`` with the personal data of every whole text, an array of ``(kind, start, end, base, score)``.

    Spans count code points, the end exclusive, and are ordered by start, then
    by kind.  A span of a base kind that passes its rule is always there, with
    ``base`` true; others are there when the classifier gives ``least`` or
    more and they overlap no base span.  Null and empty texts have none.  A map
    over the rows; an existing column named ``into`` is replaced.
    """

    kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))

    def spans(text: str | None) -> list[dict]:
        own = candidates(text, lists) if text else []
        if not own:
            return []
        score = probability(np.array([features(text, c) for c in own]), classifier)
        kept = [(c, p) for c, p in zip(own, score.tolist(), strict=True) if c.base or p >= least]
        kept.sort(key=lambda x: (x[0].start, KINDS.index(x[0].kind), x[0].end))
        return [{"kind": c.kind, "start": c.start, "end": c.end, "base": c.base, "score": p} for c, p in kept]

    @F.arrow_udf("array<struct<kind:string,start:int,end:int,base:boolean,score:double>>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([spans(t) for t in texts.to_pylist()], kind_type)

    return docs.withColumn(into, found(F.col(text_col).cast("string")))


def redact(docs: DataFrame, classifier: np.ndarray, text_col: str = "text", least: float = 0.5, lists: Gazetteers = KNOWN) -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in brackets; null stays null."""

    def cleaned(text: str | None) -> str | None:
        own = candidates(text, lists) if text else []
        if not own:
            return text
        score = probability(np.array([features(text, c) for c in own]), classifier)
        out, at = [], 0
        for c in sorted((c for c, p in zip(own, score.tolist(), strict=True) if c.base or p >= least), key=lambda c: (c.start, -c.end)):
            if c.start >= at:
                out += [text[at : c.start], f"[{c.kind.upper()}]"]
            at = max(at, c.end)
        return "".join([*out, text[at:]])

    @F.arrow_udf("string")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([cleaned(t) for t in texts.to_pylist()], pa.string())

    return docs.withColumn(text_col, clean(F.col(text_col).cast("string")))
