"""Bounded labelled samples and small calibrated models, shared by the scoring operators."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_of(id_col: str, folds: int) -> F.Column:
    """``crc32`` of the id as text, modulo ``folds``; the fold that a row belongs to."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)).cast("int")


def smallest(df: DataFrame, order: list[str | F.Column], hashed: F.Column, n: int, total: int) -> DataFrame:
    """The ``n`` rows of ``total`` that have the smallest 64-bit hash, in the given order.

    Rows whose hash is too large to be among them are left out first, so tasks
    hand on about twice ``n`` rows in all, however many tasks there are.
    """
    share = min(1.0, 2 * n / max(total, 1))
    if share < 1:
        df = df.where(hashed <= F.lit(int(-(2**63) + share * 2**64)))
    return df.orderBy(hashed, *order).limit(n)


@dataclass(frozen=True)
class Sample:
    """Texts with 0/1 labels, and the weight that makes each class count as in the whole table."""

    texts: list[str]
    labels: np.ndarray
    weights: np.ndarray


def labelled_rows(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, max_chars: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """``(id, label, text)`` of at most ``per_class`` labelled texts of each class, and how many ids each class has in all.

    The rows are those with the smallest hash of the id.  Only whole texts of
    at most ``max_chars`` characters are taken, so the sample holds no more
    than ``2 * per_class * max_chars`` characters.  Labels other than 0 and 1,
    and null ids, are ignored; an id labelled more than once, alike or not,
    counts once with its largest label.  Of several texts with one id the one
    with the smallest hash counts.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    totals = dict(known.groupBy("label").count().collect())
    picks = reduce(
        DataFrame.unionByName,
        [smallest(known.where(F.col("label") == c), ["id"], F.xxhash64("id"), per_class, totals.get(c, 0)) for c in (0, 1)],
    )
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    # at most 2 * per_class ids are broadcast, whatever the size of the tables
    found = rows.join(F.broadcast(picks), "id").groupBy("id").agg(F.max("label").alias("label"), F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"))
    return found, totals


def class_weights(totals: dict[int, int], taken: dict[int, int]) -> dict[int, float]:
    """What a row of the sample stands for, by class."""
    return {c: totals.get(c, 0) / max(1, taken.get(c, 0)) for c in (0, 1)}


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, max_chars: int, id_col: str = "doc_id", text_col: str = "text") -> Sample:
    """The rows of :func:`labelled_rows` on the driver, in the order of the ids' hashes."""
    rows, totals = labelled_rows(docs, labels, label_col, per_class, max_chars, id_col, text_col)
    found = rows.orderBy(F.xxhash64("id"), "id").select("label", "text").collect()
    y = np.array([r["label"] for r in found], int)
    each = class_weights(totals, {c: int((y == c).sum()) for c in (0, 1)})
    return Sample([r["text"] for r in found], y.astype(float), np.array([each[c] for c in y.tolist()], float))


def fit_logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, penalty: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Coefficients, the constant first, of a weighted logistic regression with a small ridge.

    Without rows the result gives 0.5 everywhere; with one class it stays finite.
    """
    if not len(y):
        return np.zeros(x.shape[1] + 1)
    design = np.c_[np.ones(len(x)), x]
    weights = weights * len(weights) / weights.sum()
    beta = np.zeros(design.shape[1])
    ridge = np.full(design.shape[1], penalty)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weights * (y - p)) - ridge * beta
        curve = (design * (weights * p * (1 - p))[:, None]).T @ design + np.diag(ridge)
        step = np.linalg.solve(curve, gradient)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return beta


def probability(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """The fitted probability of label 1 for each row of ``x``."""
    return 1 / (1 + np.exp(-np.clip(beta[0] + x @ beta[1:], -30, 30)))
