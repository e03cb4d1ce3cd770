"""Text quality by compression against dictionaries of good and of bad text.

A text that shares its strings with good text compresses better with a
dictionary of good text.  Both dictionaries are built from one half of a
bounded labelled sample; the other half calibrates the difference in
compressed size, divided by the text's size, to a probability.  Nothing else
enters the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarframe.llm.learning import Sample, fit_logistic, labelled_sample, probability

#: Bounds of the labelled sample: texts of each class, and characters of a text.
PER_CLASS, MAX_CHARS = 1500, 30_000
DICTIONARY_BYTES = 1 << 20
LEVEL = 9


def _dictionary(texts: list[bytes]) -> bytes:
    """Whole texts end to end, short ones first as they bring more variety for their bytes, as far as there is room."""
    kept, room = [], DICTIONARY_BYTES
    for text in sorted(texts, key=lambda t: (len(t), t)):
        room -= len(text) + 1
        if room < 0:
            break
        kept.append(text)
    return b"\n".join(kept)


def _presser(data: bytes) -> zstandard.ZstdCompressor:
    if not data:
        return zstandard.ZstdCompressor(level=LEVEL)
    words = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=words)


@dataclass
class CompressionScorer:
    """The dictionaries of good and of bad text, and the calibration; small enough to travel with a task."""

    good: bytes
    bad: bytes
    beta: np.ndarray

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k in ("good", "bad", "beta")}

    @cached_property
    def _pressers(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        return _presser(self.good), _presser(self.bad)

    def features(self, texts: list[bytes]) -> np.ndarray:
        """The normalised difference of the two sizes, as it is and with more weight in long texts."""
        good, bad = self._pressers
        out = np.zeros((len(texts), 2))
        for i, text in enumerate(texts):
            if text:
                apart = (len(bad.compress(text)) - len(good.compress(text))) / (len(text) + 16)
                out[i] = 10 * apart, apart * np.log1p(len(text))
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return probability(self.features(texts), self.beta)


def train(sample: Sample) -> CompressionScorer:
    """A scorer from a sample; an empty sample gives one that answers 0.5."""
    texts = [t.encode() for t in sample.texts]
    half = np.arange(len(texts)) % 2 == 0
    good, bad = (_dictionary([t for t, h, y in zip(texts, half, sample.labels, strict=True) if h and t and y == c]) for c in (1, 0))
    scorer = CompressionScorer(good, bad, beta=np.zeros(3))
    held = [t for t, h in zip(texts, half, strict=True) if not h]
    scorer.beta = fit_logistic(scorer.features(held), sample.labels[~half], sample.weights[~half])
    return scorer


def quality_of(text: F.Column, scorer: CompressionScorer) -> F.Column:
    """The probability that each whole text is good; null and empty texts get the calibrated score of no evidence."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(scorer.scores([(t or "").encode() for t in texts]))

    return score(text.cast("string"))


def score_quality(docs: DataFrame, scorer: CompressionScorer, text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with :func:`quality_of` its texts.

    A map over the rows: nothing is shuffled.  An existing column named
    ``into`` is replaced.
    """
    return docs.withColumn(into, quality_of(F.col(text_col), scorer))


def quality_scorer(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS, id_col: str = "doc_id", text_col: str = "text") -> CompressionScorer:
    """Trains on a bounded sample of ``labels.quality``; see :func:`labelled_sample`."""
    return train(labelled_sample(docs, labels, "quality", per_class, max_chars, id_col, text_col))
