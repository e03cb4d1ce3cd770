"""Toxicity by a weighted lexicon, matched after undoing common disguises.

Texts and lexicon are folded alike: case, accents, look-alike letters of other
scripts, digits and signs used as letters, and invisible characters.  The
lexicon is learnt: a folded word, or a stem with which words begin, enters with
the log odds of the texts that hold it.  A phrase of a lexicon word and its
neighbour that marks harmless texts becomes an exception.  One Aho-Corasick
pass finds all words and stems of a text; of those that begin at one place the heaviest counts, and
the weights found, alone and in proportion to the text's length, are
calibrated to a probability.
"""

from __future__ import annotations

import heapq
import math
import sys
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarframe.llm.learning import class_weights, fit_logistic, labelled_rows, probability
from scholarframe.session import stored

#: Bounds of the labelled sample.
PER_CLASS, MAX_CHARS = 4000, 30_000
#: A word needs so many toxic texts, and so large a share of the texts that hold it.
LEAST_TEXTS, LEAST_SHARE = 6, 0.5
#: The least log odds of a term: below it the evidence is too thin.
LEAST_WEIGHT = 1.5
#: Lengths of stems; a stem is written with this sign after it.
STEMS, STEM = range(4, 9), "*"

# Look-alikes of Latin letters in other scripts, and signs used as letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h",
    "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ℓ": "l", "ß": "ss", "ø": "o", "đ": "d", "ł": "l", "æ": "ae", "œ": "oe",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "|": "i", "l": "i"}
INVISIBLE = "­​‌‍‎‏⁠﻿"


def _folding() -> dict[int, str]:
    table: dict[int, str] = {}
    for code in (*range(0x41, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code).lower()) if not unicodedata.combining(c))
        table[code] = "".join(LOOK_ALIKES.get(c, c) for c in plain)
    table |= {ord(k): v for k, v in LOOK_ALIKES.items()} | {k: "" for k in range(0x300, 0x370)} | {ord(c): "" for c in INVISIBLE}
    table = {k: "".join(SIGNS.get(c, c) for c in v) for k, v in table.items()}
    return table | {ord(k): v for k, v in SIGNS.items()}


FOLDING = _folding()


def fold(text: str) -> str:
    """``text`` with disguises undone; the letter l and the digit 1 both become i."""
    return text.translate(FOLDING)


def words_of(folded: str) -> list[str]:
    """The runs of letters and digits of a folded text."""
    return [sys.intern(w) for w in "".join(c if c.isalnum() else " " for c in folded).split()]


def terms_of(words: set[str]) -> set[str]:
    """The words and the stems of longer words."""
    return words | {w[:n] + STEM for w in words for n in STEMS if len(w) > n}


@dataclass
class Lexicon:
    """Folded terms with weights, folded exception phrases, and the calibration."""

    weights: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    beta: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k in ("weights", "exceptions", "beta")}

    @cached_property
    def _automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        both: dict[str, list] = {}
        for term, weight in self.weights.items():
            both.setdefault(term.rstrip(STEM), []).append((term.endswith(STEM), weight))
        for phrase in self.exceptions:
            both.setdefault(phrase, []).append((False, None))
        for string, meanings in both.items():
            found.add_word(string, (len(string), meanings))
        if len(found):
            found.make_automaton()
        return found

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """``(start, end, weight)`` of the heaviest match at each beginning of a word that no exception phrase covers."""
        if not len(self._automaton):
            return []
        hits: dict[int, tuple[int, float]] = {}
        spared = []
        for last, (size, meanings) in self._automaton.iter(folded):
            start, end = last - size + 1, last + 1
            if start and folded[start - 1].isalnum():
                continue
            whole = end == len(folded) or not folded[end].isalnum()
            for stem, weight in meanings:
                if weight is None:
                    if whole:
                        spared.append((start, end))
                elif stem != whole and weight > hits.get(start, (0, 0.0))[1]:
                    hits[start] = end, weight
        spared.sort()
        found, k, reach = [], 0, -1  # how far phrases go that begin at a hit or before it
        for a, (b, w) in sorted(hits.items()):
            while k < len(spared) and spared[k][0] <= a:
                reach, k = max(reach, spared[k][1]), k + 1
            if b > reach:
                found.append((a, b, w))
        return found

    def features(self, texts: list[str]) -> np.ndarray:
        """Whether anything was found, the weight found, and the weight for each 1,000 characters."""
        out = np.zeros((len(texts), 3))
        for i, text in enumerate(texts):
            if total := sum(w for _, _, w in self.matches(fold(text))):
                out[i] = 1, math.log1p(total), math.log1p(1000 * total / (len(text) + 200))
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return probability(self.features(texts), self.beta)


def _phrase_key(words: list[str]) -> str:
    """The three smallest hashes of three-word phrases; near copies mostly agree in them."""
    phrases = {zlib.crc32(" ".join(words[k : k + 3]).encode()) for k in range(max(1, len(words) - 2))}
    return ",".join(map(str, heapq.nsmallest(3, phrases)))


def _folded_sample(sample: DataFrame) -> DataFrame:
    """``(id, label, half, text, words)``: the folded words of the sample, near copies of one label once, dealt into two halves."""

    @F.arrow_udf("struct<words:string,key:string>")
    def folded(texts: pa.Array) -> pa.Array:
        words = [words_of(fold(t)) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([" ".join(w) for w in words], pa.string()), pa.array([_phrase_key(w) for w in words], pa.string())], ["words", "key"])

    order = F.struct(F.xxhash64("id"), F.col("id"))
    rows = sample.withColumn("folded", folded("text")).select("id", "label", "text", "folded.words", "folded.key")
    once = rows.groupBy("key", "label").agg(F.min_by(F.struct("id", "text", "words"), order).alias("row")).select("label", "row.*")
    return once.withColumn("half", F.pmod(F.shiftright(F.xxhash64("id"), 17), F.lit(2)).cast("int"))


def _counts(rows: DataFrame, strings_of) -> DataFrame:
    """``(string, toxic0, toxic1, other0, other1)``: the texts of each class and half that hold a string.

    ``strings_of`` gives the set of strings of a text's words.  A task adds up
    its own texts, so what is shuffled are its distinct strings.
    """
    names = ["toxic0", "toxic1", "other0", "other1"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counter() for _ in names]
        for batch in batches:
            for label, half, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts[2 * (1 - label) + half].update(strings_of(words.split(" ") if words else []))
        strings = sorted(set().union(*counts))
        yield pa.RecordBatch.from_pydict({"string": pa.array(strings, pa.string())} | {n: pa.array([c[s] for s in strings], pa.int64()) for n, c in zip(names, counts, strict=True)})

    found = rows.select("label", "half", "words").mapInArrow(each, "string string, " + ", ".join(f"{n} long" for n in names))
    return found.groupBy("string").agg(*(F.sum(n).alias(n) for n in names))


def learn(sample: DataFrame, totals: dict[int, int], exceptions: set[str] = frozenset(), least_weight: float = LEAST_WEIGHT) -> Lexicon:
    """A lexicon from rows ``(id, label, text)``; ``totals`` tells how many ids each class has, sampled or not.

    ``exceptions`` are phrases to spare besides those learnt.  Texts are folded
    and their strings counted in tasks; to the driver come only terms that
    enough toxic texts hold, phrases that enough harmless ones do, and three
    numbers a text for the calibration, all bounded by the sample.  Near copies
    in the sample count once.  A term has to be marked toxic in either half of
    the sample, so that chance finds of one half fall away, with log odds of
    ``least_weight`` or more.  Without toxic texts the lexicon is empty and
    every text gets the same low score.
    """
    rows = stored(_folded_sample(sample), "toxicity-sample")
    kept = {0: 0, 1: 0} | dict(rows.groupBy("label").count().collect())
    each = class_weights(totals, kept)
    enough = F.col("toxic0") + F.col("toxic1") >= LEAST_TEXTS
    often = [r["string"] for r in _counts(rows.where("label = 1"), lambda w: terms_of(set(w))).where(enough & (F.col("toxic0") > 0) & (F.col("toxic1") > 0)).select("string").collect()]
    wanted = sample.sparkSession.sparkContext.broadcast(frozenset(often))
    weights = {}
    for r in _counts(rows, lambda w: terms_of(set(w)) & wanted.value).orderBy("string").collect():
        halves = [(r[f"toxic{h}"] * each[1], r[f"other{h}"] * each[0]) for h in (0, 1)]
        toxic, other = (sum(h[k] for h in halves) for k in (0, 1))
        if len(r["string"]) > 2 and all(a >= LEAST_SHARE * (a + b) for a, b in halves):
            # one harmless text more than were seen, as a sample may have missed it
            weight = math.log((toxic + each[1]) / (each[1] * (kept[1] + 2))) - math.log((other + each[0]) / (each[0] * (kept[0] + 2))) if each[0] else LEAST_WEIGHT
            if weight >= least_weight:
                weights[r["string"]] = weight
    known = frozenset(t for t in weights if not t.endswith(STEM))

    def phrases(words: list[str]) -> set[str]:
        return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if a in known or b in known}

    harmless = F.col("other0") + F.col("other1")
    spared = _counts(rows, phrases).where((harmless >= LEAST_TEXTS) & ((F.col("toxic0") + F.col("toxic1")) * each[1] < 0.2 * harmless * each[0]))
    lexicon = Lexicon(weights, {r["string"] for r in spared.select("string").collect()} | {" ".join(words_of(fold(x))) for x in exceptions})

    @F.arrow_udf("array<double>")
    def seen(texts: pa.Array) -> pa.Array:
        return pa.array(lexicon.features(texts.to_pylist()).tolist(), pa.list_(pa.float64()))

    found = rows.select("label", seen("text").alias("seen")).collect()
    found.sort(key=lambda r: (r["label"], r["seen"]))
    y = np.array([r["label"] for r in found], float)
    lexicon.beta = fit_logistic(np.array([r["seen"] for r in found], float).reshape(-1, 3), y, np.array([each[r["label"]] for r in found], float))
    return lexicon


def toxicity_lexicon(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS, exceptions: set[str] = frozenset(), id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """Learns from a bounded sample of ``labels.toxic``; see :func:`labelled_rows`."""
    return learn(*labelled_rows(docs, labels, "toxic", per_class, max_chars, id_col, text_col), exceptions)


def score_toxicity(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability that each whole text is toxic.

    A map over the rows: nothing is shuffled.  Null and empty texts get the
    score of a text in which nothing is found.  An existing column named
    ``into`` is replaced.
    """

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(lexicon.scores([t or "" for t in texts]))

    return docs.withColumn(into, score(F.col(text_col).cast("string")))
