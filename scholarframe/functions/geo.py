"""Rings, positions and display scales as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def ring_area(points: Column) -> Column:
    """Twice-signed shoelace area of a closed ring, an array of (x, y) arrays."""
    after = F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0)))
    pairs = F.arrays_zip(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))).alias("a"), after.alias("b"))
    term = F.transform(pairs, lambda p: p["a"][0] * p["b"][1] - p["b"][0] * p["a"][1])
    return F.aggregate(term, F.lit(0.0), lambda total, x: total + x) / 2


def ring_centre(points: Column) -> Column:
    """The mean of the ring's corners, the closing one left out."""
    corners = F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(1)))

    def mean(i: int) -> Column:
        return F.aggregate(F.transform(corners, lambda p: p[i]), F.lit(0.0), lambda total, x: total + x) / F.size(corners)

    return F.struct(mean(0).alias("x"), mean(1).alias("y"))


EDGE, EPSILON = 180.0, 1e-9


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def has_jump(ring: Column) -> Column:
    """Whether a ring steps over the antimeridian: two corners in a row lie more than 180 degrees apart."""
    return F.exists(F.transform(ring, lambda p, i: F.abs(p[0] - F.when(i > 0, ring[i - 1][0]).otherwise(p[0])) > EDGE), lambda far: far)


def unwrapped(ring: Column) -> Column:
    """The ring with longitudes that go on beyond 180 degrees instead of jumping."""

    def turns(p: Column, i: Column) -> Column:
        step = p[0] - F.when(i > 0, ring[i - 1][0]).otherwise(p[0])
        return F.when(step > EDGE, -F.ceil((step - EDGE) / 360)).when(step < -EDGE, F.ceil((-step - EDGE) / 360)).otherwise(F.lit(0)).cast("int")

    none = F.struct(F.array().cast("array<int>").alias("all"), F.lit(0).alias("now"))
    shifts = F.aggregate(F.transform(ring, turns), none, lambda s, t: F.struct(F.concat(s["all"], F.array(s["now"] + t)).alias("all"), (s["now"] + t).alias("now")))["all"]
    return F.zip_with(ring, shifts, lambda p, k: F.array(p[0] + 360.0 * k, p[1]))


def _clipped(corners: Column, edge: float, greater: bool) -> Column:
    """The part of an open ring on one side of a meridian."""

    def inside(p: Column) -> Column:
        return p[0] >= edge - EPSILON if greater else p[0] <= edge + EPSILON

    def crossing(a: Column, b: Column) -> Column:
        span = b[0] - a[0]
        share = F.when(F.abs(span) < EPSILON, 0.0).otherwise((edge - a[0]) / span)
        return F.array(F.lit(edge), a[1] + (b[1] - a[1]) * share)

    def corner(p: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(corners, i - 1)).otherwise(F.element_at(corners, -1))
        met = F.when(inside(before) != inside(p), F.array(crossing(before, p))).otherwise(F.array().cast("array<array<double>>"))
        return F.concat(met, F.when(inside(p), F.array(p)).otherwise(F.array().cast("array<array<double>>")))

    every = F.when(F.size(corners) > 0, F.flatten(F.transform(corners, corner))).otherwise(corners)
    return _let(every, lambda ps: F.filter(ps, lambda p, i: (i == 0) | (p != F.get(ps, i - 1))))


def _in_world(ring: Column) -> Column:
    """The part of a closed ring between the antimeridian's two sides, closed; null where nothing of it lies there."""
    corners = F.when(ring[0] == F.element_at(ring, -1), F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)
    kept = _let(_let(corners, lambda c: _clipped(c, -EDGE, True)), lambda c: _clipped(c, EDGE, False))
    closed = _let(kept, lambda c: F.when(F.size(c) >= 3, F.concat(c, F.array(c[0]))))
    return _let(closed, lambda c: F.when(F.abs(ring_area(c)) > EPSILON, c))


def _shifted(ring: Column, by: Column) -> Column:
    return F.transform(ring, lambda p: F.array(p[0] + by, p[1]))


def ring_middle(ring: Column) -> Column:
    """Half way between a ring's least and greatest longitude."""
    east = F.transform(ring, lambda p: p[0])
    return (F.array_min(east) + F.array_max(east)) / 2


def _turns_to(ring: Column, middle: Column) -> Column:
    """The degrees, whole turns, that bring a ring next to a longitude."""
    return F.floor((middle - ring_middle(ring)) / 360 + 0.5) * 360.0


def split_polygon(polygon: Column) -> Column:
    """Polygons without a step over the antimeridian that make up one, an array of polygons.

    A polygon is an array of closed rings of ``[longitude, latitude]``, the
    outer one first; holes go to the piece they lie in.  A polygon that does
    not step over is its only piece.  Null and empty ones have none.
    """

    def cut(rings: Column) -> Column:
        middle, east = ring_middle(rings[0]), F.transform(rings[0], lambda p: p[0])
        aligned = F.transform(rings, lambda r, i: F.when(i == 0, r).otherwise(_shifted(r, _turns_to(r, middle))))
        first, last = F.ceil((-EDGE - F.array_max(east)) / 360), F.floor((EDGE - F.array_min(east)) / 360)
        worlds = F.sequence(first.cast("int"), last.cast("int"))
        copies = F.transform(worlds, lambda k: F.transform(aligned, lambda r: _in_world(_shifted(r, 360.0 * k))))
        return F.transform(F.filter(copies, lambda c: c[0].isNotNull()), F.array_compact)

    pieces = _let(F.transform(polygon, unwrapped), cut)
    return F.when(F.size(polygon) > 0, F.when(F.exists(polygon, has_jump), pieces).otherwise(F.array(polygon)))


def gathered(polygons: Column) -> Column:
    """Polygons moved by whole turns next to the largest of them, for a view of them alone."""
    sizes = F.transform(polygons, lambda p, i: F.struct(-F.abs(ring_area(p[0])), i.alias("i")))
    anchor = polygons[F.array_min(sizes)["i"]]
    return _let(ring_middle(anchor[0]), lambda middle: F.transform(polygons, lambda p: _let(_turns_to(p[0], middle), lambda by: F.transform(p, lambda r: _shifted(r, by)))))


def timeline_position(year: Column, first: int, last: int) -> Column:
    """Where a year lies between two others, in percent."""
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), (year - first) / (last - first) * 100)) if last > first else F.lit(50.0)


def hue(value: Column) -> Column:
    """The display hue of a score from 0 to 100."""
    return 270 - 2.7 * F.least(F.lit(100.0), F.greatest(F.lit(0.0), value))
