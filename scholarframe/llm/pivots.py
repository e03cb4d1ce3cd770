"""Near-duplicate vectors through a pivot-permutation index.

Every vector is described by its nearest pivots, in order of nearness, and is
entered in the inverted list of each.  A list counts, from the inverted lists
of its own vectors, how many pivots any two of them share; pairs that share
enough are candidates, and their cosine is then computed from the vectors
themselves in double precision.  A pair meets in the list of every pivot it
shares and counts in one: that of the shared pivot nearest to both, by the sum
of its places in the two orders.

Equal vectors are collapsed first and counted by their number.  Lists that
hold too many vectors for a task are cut by the second nearest pivot a pair
shares, and what is still too long is cut into chunks that meet two by two.  A
list returns one row for each vector with links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarframe.llm.learning import smallest
from scholarframe.llm.simhash import smallest_labels
from scholarframe.operators.components import connected_components
from scholarframe.session import stored

#: Pivots are so many times the root of the number of vectors, so that lists and pivots grow alike; sampled rows to choose each from.
PIVOTS_OF_ROOT, LEAST_PIVOTS, DRAWN_FOR_EACH = 4.0, 64, 4
#: Pivots that describe a vector, and pivots a pair has to share.
NEAREST, SHARED = 10, 2
#: Pivots are less alike than this, so that no dense region takes them all.
APART = 0.6
#: Vectors of a list, or of a chunk, that a task takes together, and pairs it looks at together.
TOGETHER, PAIRS = 1024, 1 << 20


def choose_pivots(drawn: np.ndarray, most: int) -> np.ndarray:
    """Unit vectors from ``drawn``, each in turn kept if unlike those before it."""
    kept, n = np.empty((min(most, len(drawn)), drawn.shape[1] if drawn.ndim == 2 else 0)), 0
    for row in drawn:
        if n >= most:
            break
        if not n or (kept[:n] @ row).max() < APART:
            kept[n] = row
            n += 1
    return kept[:n]


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of numbers, short ones padded with zeros."""
    out = np.zeros((len(column), width))
    sizes = np.asarray(pc.list_value_length(column)).astype(np.int64)
    values = np.asarray(column.flatten(), np.float64)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def valid(vector: F.Column) -> F.Column:
    """Whether a vector can have a cosine: present, every number there and finite, and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _described(classes: DataFrame, pivots: np.ndarray, nearest: int, width: int) -> DataFrame:
    """``(rep, n, vector, near)``: the nearest pivots of each distinct vector, by number."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)

    @F.arrow_udf("array<int>")
    def near(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            like = _unit(_matrix(batch, width)) @ shared.value.T if len(batch) else np.zeros((0, nearest))
            best = np.argpartition(-like, nearest - 1, axis=1)[:, :nearest] if nearest < like.shape[1] else np.tile(np.arange(nearest), (len(like), 1))
            order = np.argsort(-np.take_along_axis(like, best, axis=1), axis=1, kind="stable")
            best = np.take_along_axis(best, order, axis=1).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(like) + 1, dtype=np.int32) * nearest), pa.array(best.ravel()))

    return classes.select("rep", "n", "vector", near("vector").alias("near"))


def _candidates(near: np.ndarray, shared: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows, the smaller first, that have ``shared`` pivots in common, counted from the inverted lists."""
    m, k = near.shape
    pivot = np.unique(near, return_inverse=True)[1].reshape(m, k)
    order = np.argsort(pivot.ravel(), kind="stable")
    member, end = order // k, np.searchsorted(pivot.ravel()[order], np.arange(pivot.max() + 1), "right")
    # where each entry stands in its list; the rows behind it there are the later ones
    after = np.empty(m * k, np.int64)
    after[order] = np.arange(1, m * k + 1)
    after, end = after.reshape(m, k), end[pivot]
    size = (end - after).sum(axis=1)
    a = 0
    while a < m:
        # the lists of the rows taken together hold about PAIRS entries, and their counts as many places
        b = min(m, a + max(1, min(int(np.searchsorted(np.cumsum(size[a:]), PAIRS)), PAIRS // m)))
        first, count = after[a:b].ravel(), (end[a:b] - after[a:b]).ravel()
        other = member[np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)]
        row = np.repeat(np.repeat(np.arange(b - a), k), count)
        times = np.bincount(row * m + other, minlength=1)
        x, y = np.divmod(np.flatnonzero(times >= shared), m)
        yield x + a, y
        a = b


def _meets_here(left: np.ndarray, right: np.ndarray, pivot: int, second: int) -> np.ndarray:
    """Whether pairs with these pivots count in the list of ``pivot``, or of ``pivot`` and ``second``."""
    k, rows = left.shape[1], np.arange(len(left))
    both = left[:, :, None] == right[:, None, :]
    # a shared pivot's rank: the sum of its places, ties by the pivot's number
    rank = np.where(both.any(axis=2), (np.arange(k) + both.argmax(axis=2)) * np.int64(1 << 40) + left, np.iinfo(np.int64).max)
    best = rank.argmin(axis=1)
    here = left[rows, best] == pivot
    if second >= 0:
        rank[rows, best] = np.iinfo(np.int64).max
        here &= left[rows, rank.argmin(axis=1)] == second
    return here


def _links_of_cell(cell: pa.Table, least: float, shared: int, width: int) -> pa.Table:
    """Links found in one list: for each vector with any, how many vectors and the smallest one it is joined to."""
    cell = cell.combine_chunks()
    order = np.argsort(cell["rep"].to_numpy(), kind="stable")
    cell = cell.take(pa.array(order))
    rep, n, side = (cell[c].to_numpy() for c in ("rep", "n", "side"))
    pivot, second, cross = cell["pivot"][0].as_py(), cell["second"][0].as_py(), cell["a"][0].as_py() != cell["b"][0].as_py()
    unit = _unit(_matrix(cell["vector"].chunk(0), width))
    near = np.asarray(cell["near"].chunk(0).flatten()).reshape(len(rep), -1)
    links, label = np.zeros(len(rep), np.int64), np.arange(len(rep))
    for i, j in _candidates(near, shared):
        if cross:
            apart = side[i] != side[j]
            i, j = i[apart], j[apart]
        for k in range(0, len(i), 1 << 14):
            x, y = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
            here = _meets_here(near[x], near[y], pivot, second)  # first, so that a pair is verified in one list only
            x, y = x[here], y[here]
            alike = np.einsum("ij,ij->i", unit[x], unit[y]) >= least
            x, y = x[alike], y[alike]
            links += np.bincount(x, n[y], len(rep)).astype(np.int64) + np.bincount(y, n[x], len(rep)).astype(np.int64)
            fresh = label[x] != label[y]
            if fresh.any():
                label = smallest_labels(len(rep), iter([(np.arange(len(rep)), label), (x[fresh], y[fresh])]))
    some = links > 0
    return pa.table({"rep": rep[some], "links": links[some], "root": rep[label[some]]})


def vector_groups(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", pivots_of_root: float = PIVOTS_OF_ROOT, nearest: int = NEAREST, shared: int = SHARED, together: int = TOGETHER) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors``.

    Vectors with a cosine of ``least`` or more are linked; none below it are.
    Pairs that do not share ``shared`` of their nearest pivots are not seen: at
    a cosine of exactly 0.9 that is fewer than 1 in 200 of random vectors, see
    the README.  There are ``pivots_of_root`` times the root of the number of
    distinct vectors of pivots, chosen from a sample of ``DRAWN_FOR_EACH``
    times as many rows; ``nearest`` of them describe a vector, and one more for
    each doubling beyond 1,024.  Every vector is indexed.

    Vectors that are null, zero, or hold null or non-finite numbers link with
    nothing; a shorter vector counts as padded with zeros.  Rows with the same
    id are one vector, the one with the smallest hash.  A row without an id
    takes no part: no links, no component, not kept.  Other columns are
    ignored, and an empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    own = rows.where(F.col("id").isNotNull() & valid(F.col("vector"))).groupBy("id").agg(F.min_by("vector", F.xxhash64("vector")).alias("vector"))
    # a digest stands for the vector from here on, so that no join shuffles vectors
    own = stored(own.withColumn("digest", F.sha2(F.array_join(F.col("vector").cast("array<string>"), ","), 256)), "vectors")
    classes = stored(own.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.any_value("vector").alias("vector")), "vector-classes")
    total, width = classes.agg(F.count("*"), F.max(F.size("vector"))).first()
    if total:
        most = max(LEAST_PIVOTS, int(pivots_of_root * total**0.5))
        drawn = smallest(classes, ["rep"], F.xxhash64("rep"), DRAWN_FOR_EACH * most, total).select("vector").toArrow()["vector"]
        pivots = choose_pivots(_unit(_matrix(drawn.combine_chunks() if isinstance(drawn, pa.ChunkedArray) else drawn, width)), most)
        k = nearest + max(0, (len(pivots) - 1).bit_length() - 10)
        found = stored(_found(classes, pivots, least, min(k, len(pivots)), min(shared, len(pivots)), width, together), "vector-links")
        counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
        groups = connected_components(found.where("rep <> root"), "rep", "root")
    else:
        counts = classes.select("rep", "n").withColumnRenamed("n", "links").limit(0)
        groups = classes.select(F.col("rep").alias("vertex"), F.col("rep").alias("component")).limit(0)
    named = classes.join(counts, "rep", "left").join(groups, classes["rep"] == groups["vertex"], "left")
    named = named.select("digest", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    each = own.select("id", "digest").join(named, "digest").select("id", "links", "component")
    out = rows.select(F.col("id").alias("vec_id")).join(each, F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _found(classes: DataFrame, pivots: np.ndarray, least: float, nearest: int, shared: int, width: int, together: int) -> DataFrame:
    described = stored(_described(classes, pivots, nearest, width), "described")
    sizes = described.select(F.explode("near").alias("pivot")).groupBy("pivot").count()
    long = sizes.where(F.col("count") > together).select("pivot").collect() if shared > 1 else []  # at most one row for each pivot
    is_long = F.array_contains(F.lit([r["pivot"] for r in long]).cast("array<int>"), F.col("pivot")) if long else F.lit(False)
    lists = described.withColumn("pivot", F.explode("near"))
    others = F.filter("near", lambda q: q != F.col("pivot"))
    entered = lists.withColumn("second", F.explode(F.when(is_long, others).otherwise(F.array(F.lit(-1)))))
    over = entered.groupBy("pivot", "second").agg(F.count("*").alias("size")).where(F.col("size") > together)
    over = over.select("pivot", "second", F.ceil(F.col("size") / together).cast("int").alias("chunks"))
    cut = entered.join(over, ["pivot", "second"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    cut = cut.withColumn("side", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cut = cut.select("pivot", "second", F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b"), "side", "rep", "n", "vector", "near")
    schema = "rep long, links long, root long"

    def each(cell: pa.Table) -> pa.Table:
        return _links_of_cell(cell, least, shared, width)

    return cut.groupBy("pivot", "second", "a", "b").applyInArrow(each, schema)
