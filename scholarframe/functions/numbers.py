"""Small numeric expressions: rounding rules, bins and stable variation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int = 1) -> Column:
    """Halves towards positive infinity."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def bin_index(confidence: Column, bins: int) -> Column:
    """The equal-width bin of a confidence from 0 to 1."""
    return F.least(F.floor(confidence * bins).cast("int"), F.lit(bins - 1))


def text_hash(s: Column) -> Column:
    """The hash of a text by repeated multiplication with 31, modulo 2**32."""
    return F.aggregate(F.split(s, ""), F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + F.ascii(c), F.lit(1 << 32)))


def stable_variation(s: Column) -> Column:
    """A number from -1 to 1 that depends on the text only."""
    return text_hash(s) / F.lit(float((1 << 32) - 1)) * 2 - 1


def synthetic(value: Column, key: Column, blend: float, amplitude: float) -> Column:
    """A demonstration value: blended with 50, varied by the key, kept within 0 to 100."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), value * blend + 50 * (1 - blend) + amplitude * stable_variation(key)))
