"""Resolution of names and identifiers to entities, and how well it works."""

from __future__ import annotations

from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarframe.functions.numbers import bin_index
from scholarframe.functions.text import bigrams
from scholarframe.operators.components import connected_components
from scholarframe.session import ROWS_A_TASK, stored

#: Scores by how a match was made, and the bars of the fuzzy one.
EXACT, ALIAS, FUZZY_CEILING, FUZZY_BAR, FUZZY_MARGIN = 0.99, 0.96, 0.89, 0.75, 0.05
#: Sets of one bigram that a block holds, and the least number of bundles that bigrams with fewer are dealt into.
BLOCK_ROWS, BUNDLES = 1 << 15, 256
#: Rows a side and cells of the matrices that are multiplied.
PRODUCT_ROWS, PRODUCT_CELLS = 2048, 1 << 22
#: Parts of the way from 1 down to the bar at which sets are looked up before the bar itself, and pairs of sets so few that they are not.
BAR_STEPS, FEW_PAIRS = (0.2, 0.4, 0.6, 0.8), 1 << 26


def unique_name_match(mentions: DataFrame, names: DataFrame, term: str, entity: str) -> DataFrame:
    """``mentions`` with the entity whose name they are, and a status.

    A name of several entities is ambiguous and resolves to none.
    """
    known = names.groupBy(term).agg(F.count_distinct(entity).alias("n_entities"), F.min(entity).alias("__entity"))
    joined = mentions.join(known, term, "left")
    status = F.when(F.col("n_entities").isNull(), "unresolved").when(F.col("n_entities") == 1, "resolved").otherwise("ambiguous")
    return joined.select(*mentions.columns, F.when(F.col("n_entities") == 1, F.col("__entity")).alias(entity), status.alias("status"))


def narrowed(candidates: DataFrame, mention: str, agrees: Column) -> DataFrame:
    """Candidates that agree with the context; all of a mention's when none does."""
    w = Window.partitionBy(mention)
    marked = candidates.withColumn("__agrees", F.coalesce(agrees.cast("int"), F.lit(0)))
    return marked.withColumn("__any", F.max("__agrees").over(w)).where("__agrees = __any").drop("__agrees", "__any")


def narrowed_match(mentions: DataFrame, names: DataFrame, mention: str, term: str, context: str, entity: str) -> DataFrame:
    """``mention, entity``: the entities with a mention's term and context, or with its term where none agrees on the context.

    Only mentions without agreement meet all entities of their term.
    """
    agreed = mentions.join(names.select(term, context, entity), [term, context]).select(mention, entity).distinct()
    others = mentions.join(agreed.select(mention).distinct(), mention, "left_anti").join(names.select(term, entity), term).select(mention, entity).distinct()
    return agreed.unionByName(others)


def segment_match(mentions: DataFrame, text: str, names: DataFrame, term: str, entity: str, key) -> DataFrame:
    """Affiliation texts whose parts between commas, semicolons and lines name exactly one entity."""
    clear = names.groupBy(term).agg(F.count_distinct(entity).alias("n"), F.min(entity).alias(entity)).where("n = 1").drop("n")
    parts = mentions.select("*", F.explode(F.split(text, "[,;\\n]")).alias("__part")).withColumn(term, key(F.col("__part")))
    found = parts.join(clear, term).groupBy(*mentions.columns).agg(F.count_distinct(entity).alias("n"), F.min(entity).alias(entity))
    return found.where("n = 1").drop("n")


class _Sets:
    """Sets of ranks, a row for each that a block enters them under, in the order of those; ``at`` is where a row's begin."""

    def __init__(self, table: pa.Table, bar: float):
        lists = table.column("ranks").combine_chunks()
        self.under, self.key = table.column("rank").to_numpy(), table.column("key").to_numpy()
        self.sizes = lists.value_lengths().to_numpy().astype(np.int64)
        self.at, self.ranks = np.concatenate(([0], np.cumsum(self.sizes))), lists.flatten().to_numpy()
        self.need = np.ceil(bar / (2 - bar) * self.sizes - 1e-9).astype(np.int64)

    def span(self, rank: int) -> range:
        return range(int(np.searchsorted(self.under, rank, "left")), int(np.searchsorted(self.under, rank, "right")))

    def entries(self, span: range) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows of a span with the place and the rank of each of their entries."""
        row = np.repeat(np.arange(span.start, span.stop), self.sizes[span.start : span.stop])
        place = np.arange(self.at[span.start], self.at[span.stop])
        return row, place - self.at[row], self.ranks[place]

    def matrix(self, rows: np.ndarray, known: np.ndarray) -> np.ndarray:
        """A row of 0 and 1 for each set, over the known ranks."""
        sizes = self.sizes[rows]
        place = np.repeat(self.at[rows] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        code = np.minimum(np.searchsorted(known, self.ranks[place]), len(known) - 1)
        there = known[code] == self.ranks[place]
        m = np.zeros((len(rows), len(known) + 2), np.float32)  # two columns for what a pair needs
        m[np.repeat(np.arange(len(rows)), sizes)[there], code[there]] = 1
        return m


def _in_common(x: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
    """How many of the first ``n`` columns the rows ``p`` of ``x`` and ``q`` of ``y`` have in common."""
    if len(p) > len(x) * len(y) // 16:
        return (x[:, :n] @ y[:, :n].T)[p, q]
    size = max(1, PRODUCT_CELLS // max(1, n))
    return np.concatenate([np.zeros(0, np.float32), *(np.einsum("ij,ij->i", x[p[k : k + size], :n], y[q[k : k + size], :n]) for k in range(0, len(p), size))])


def _first_of_each(row: np.ndarray, name: np.ndarray, dice: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``keep`` most similar names of each row, the first of equals."""
    order = np.lexsort((name, -dice, row))
    row, name, dice = row[order], name[order], dice[order]
    good = np.arange(len(row)) - np.searchsorted(row, row) < keep
    return row[good], name[good], dice[good]


def _best_in_block(left: pa.Table, right: pa.Table, bar: float, keep: int) -> pa.Table:
    """The ``keep`` most similar sets of each set of bigrams, over the bigrams of one block.

    Both sides have a row for each entered bigram: ``key``, the bigram's
    ``rank``, and ``ranks``, all of the set in order; ``least`` orders the right
    side among equals.  Sets that share the bigram are told apart by a second
    one, and those that share both are compared as rows of 0 and 1 in products
    of matrices of bounded size.  A pair counts at the two rarest bigrams that
    both hold, or at the only one.
    """
    names = right.sort_by([("rank", "ascending"), ("least", "ascending"), ("key", "ascending")])
    a, b = _Sets(left.sort_by("rank"), bar), _Sets(names, bar)
    found: list[tuple] = []
    for rank in np.intersect1d(a.under, b.under):
        spans = a.span(rank), b.span(rank)
        sides = [x.entries(span) for x, span in zip((a, b), spans, strict=True)]
        known = np.intersect1d(sides[0][2], sides[1][2])
        # the second bigram is among as many of the first as the bar leaves to choose from
        seconds = []
        for x, (row, place, own) in zip((a, b), sides, strict=True):
            good = (own > rank) & (place <= x.sizes[row] - x.need[row] + 1)
            order = np.argsort(own[good], kind="stable")
            seconds.append((row[good][order], own[good][order]))
        meetings = [(r, *(row[np.searchsorted(own, r, "left") : np.searchsorted(own, r, "right")] for row, own in seconds)) for r in np.intersect1d(seconds[0][1], seconds[1][1])]
        alone = [np.array([i for i in span if x.need[i] <= 1], np.int64) for x, span in zip((a, b), spans, strict=True)]
        if all(map(len, alone)):
            meetings.append((None, *alone))
        step = max(64, min(PRODUCT_ROWS, PRODUCT_CELLS // (len(known) + 2)))
        hits: list[tuple] = []
        n_hits = 0
        for second, mine, others in meetings:
            rarer = len(known) if second is None else int(np.searchsorted(known, second))
            for j in range(0, len(others), step):
                theirs = others[j : j + step]
                y = b.matrix(theirs, known)
                y[:, -2], y[:, -1] = 1, 1e-3 - bar / 2 * b.sizes[theirs]
                for i in range(0, len(mine), step):
                    own = mine[i : i + step]
                    x = a.matrix(own, known)
                    x[:, -2], x[:, -1] = -bar / 2 * a.sizes[own], 1
                    # common bigrams less what the bar asks for
                    p, q = np.divmod(np.flatnonzero((x @ y.T).ravel() >= 0), len(theirs))
                    if not len(p):
                        continue
                    once = _in_common(x, y, p, q, rarer) == 1
                    p, q = p[once], q[once]
                    dice = 2 * _in_common(x, y, p, q, len(known)).astype(float) / (a.sizes[own[p]] + b.sizes[theirs[q]])
                    good = dice >= bar
                    hits.append(_first_of_each(own[p[good]], theirs[q[good]], dice[good], keep))
                    n_hits += len(hits[-1][0])
                    if n_hits > PRODUCT_CELLS:
                        hits = [_first_of_each(*map(np.concatenate, zip(*hits, strict=True)), keep)]
                        n_hits = 0
        if hits:
            found.append(_first_of_each(*map(np.concatenate, zip(*hits, strict=True)), keep))
    row, name, dice = map(np.concatenate, zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.table({"term": pa.array(a.key[row]), "name": pa.array(b.key[name]), "least": names.column("least").take(pa.array(name)), "n": names.column("n").take(pa.array(name)), "similarity": pa.array(dice)})


def fuzzy_match(mentions: DataFrame, names: DataFrame, mention: str, term: str, entity: str, bar: float = FUZZY_BAR, margin: float = FUZZY_MARGIN, keep: int = 3) -> DataFrame:
    """Up to ``keep`` entities for each mention by bigram similarity, and whether the best is clear.

    Only names with the same first character count.  The best is clear when it
    passes the bar, which is above 0, and leads the next by the margin.

    Texts with one first character and one set of bigrams are alike to all
    others, so each such set is compared once, however many mentions and
    entities have it; a set stands for its smallest entities.  Sets
    meet on rare bigrams: with all bigrams ordered by how often they occur, two
    that reach the bar share one, or two, among the first few of each, and the
    fewer the higher the bar.  So sets are looked up at high bars first, and
    those that find ``keep + 1`` entities there are not looked up at lower ones.
    Bigrams with many sets are cut into blocks of both sides, and a block hands
    on the best few of each set only.
    """
    kind = names.schema[entity].dataType.simpleString()
    members, sets = [], []
    for t, key in ((mentions, mention), (names, entity)):
        texts = t.where(F.col(term).isNotNull()).select(F.col(key).alias("who"), F.col(term).alias("text")).distinct()
        # a bigram goes with the first character, so sets of unlike ones have nothing in common; equal sets are equal once they are in order
        grams = F.transform(bigrams(F.col("text")), lambda g: F.concat(F.substring("text", 1, 1), g))
        keyed = stored(texts.select("who", F.array_sort(grams).alias("grams")).distinct(), "grams")
        sets.append(stored(keyed.groupBy("grams").agg(F.min("who").alias("least"), F.count("*").alias("n")).withColumn("key", F.monotonically_increasing_id()), "sets"))
        members.append((keyed, keyed.join(sets[-1].select("grams", "key"), "grams").select("who", "key")))
    # an entity of several names is the smallest of so many sets at most, so among this many sets are keep + 1 entities
    most = members[1][0].groupBy("who").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    within = keep * most + 1
    frequency = sets[0].select(F.explode("grams").alias("gram")).unionAll(sets[1].select(F.explode("grams").alias("gram"))).groupBy("gram").agg(F.count("*").alias("n"))
    ranks = frequency.select("gram", F.row_number().over(Window.orderBy("n", "gram")).alias("rank"))  # pairs of characters, far fewer than names
    ranked = []
    for t in sets:
        ordered = t.select("key", F.explode("grams").alias("gram")).join(ranks, "gram").groupBy("key").agg(F.array_sort(F.collect_list("rank")).alias("ranks"))
        ranked.append(stored(ordered if t is sets[0] else ordered.join(t.drop("grams"), "key"), "ranked"))
    waiting, n_names = ranked[0], ranked[1].count()
    n_waiting, alike = waiting.count(), []
    for own_bar in sorted({1 - (1 - bar) * share for share in BAR_STEPS} | {bar}, reverse=True):
        if own_bar > bar and n_waiting * n_names <= FEW_PAIRS:
            continue
        scored = _alike(waiting, ranked[1], own_bar, within, kind)
        if own_bar == bar:
            alike.append(scored)
            break
        scored = stored(scored, "scored")
        enough = scored.groupBy(F.col("term").alias("key")).agg(F.sum("n").alias("n")).where(F.col("n") >= within).select("key")
        alike.append(scored.join(enough, scored["term"] == enough["key"], "left_semi"))
        waiting = stored(waiting.join(enough, "key", "left_anti"), "waiting")
        n_waiting = waiting.count()
        if not n_waiting:
            break

    def first(rows: DataFrame, key: str, n: int, *order: Column | str) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)

    def entities(rows: DataFrame, key: str) -> DataFrame:
        best = rows.groupBy(key, "entity").agg(F.max("similarity").alias("similarity"))
        return first(best, key, keep + 1, F.col("similarity").desc(), "entity")

    best = first(reduce(DataFrame.unionByName, alike), "term", within, F.col("similarity").desc(), "least", "name").select("term", "name", "similarity")
    whose = first(members[1][1].select(F.col("key").alias("name"), F.col("who").alias("entity")), "name", keep + 1, "entity").drop("rank")
    of_sets = entities(best.join(whose, "name"), "term").drop("rank")
    whom = members[0][1].select(F.col("who").alias("mention"), F.col("key").alias("term"))
    top = entities(whom.join(of_sets, "term"), "mention")
    order = Window.partitionBy("mention").orderBy("rank")
    found = top.withColumn("next", F.lead("similarity").over(order)).where(F.col("rank") <= keep)
    clear = (F.col("rank") == 1) & (F.col("next").isNull() | (F.col("similarity") - F.col("next") >= margin))
    return found.select(F.col("mention").alias(mention), F.col("entity").alias(entity), "similarity", "rank", F.least(F.lit(FUZZY_CEILING), FUZZY_CEILING * F.col("similarity")).alias("confidence"), clear.alias("clear"))


def _alike(terms: DataFrame, names: DataFrame, bar: float, within: int, kind: str) -> DataFrame:
    """``term, name, least, n, similarity``: the best names of each term that reach the bar, of each block ``within`` at most."""
    # Dice of the bar or more needs bar * n / (2 - bar) common bigrams, whatever the size of the other set
    need = F.ceil(bar / (2 - bar) * F.size("ranks") - 1e-9).cast("int")
    head = F.explode(F.slice("ranks", F.lit(1), F.least(F.size("ranks"), F.size("ranks") - need + 1))).alias("rank")
    sides = [t.select("*", head) for t in (terms, names)]
    counts = [t.groupBy("rank").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias(f"parts_{x}"), F.count("*").alias(f"n_{x}")) for t, x in zip(sides, "ab", strict=True)]
    parts = stored(counts[0].join(counts[1], "rank"), "parts")  # a row for each bigram of both sides
    n_rows = parts.agg(F.sum(F.col("n_a") + F.col("n_b"))).first()[0] or 0
    bundles = max(BUNDLES, ceil(n_rows / BLOCK_ROWS))
    # blocks are small and dear, so their bytes do not tell how many tasks they need
    tasks = max(4 * terms.sparkSession.sparkContext.defaultParallelism, ceil(n_rows / ROWS_A_TASK))
    blocks = []
    for t, x in zip(sides, "ab", strict=True):
        own, other = (F.col(f"parts_{x}"), F.col("parts_b" if x == "a" else "parts_a"))
        mine = F.pmod(F.xxhash64("key"), own).cast("int").alias(f"block_{x}")
        each = F.explode(F.sequence(F.lit(0), other - 1)).alias("block_b" if x == "a" else "block_a")
        cold = (F.col("parts_a") == 1) & (F.col("parts_b") == 1)
        bundle = F.when(cold, F.pmod(F.xxhash64("rank"), F.lit(bundles))).otherwise(-F.col("rank").cast("long")).alias("bundle")
        blocks.append(t.join(parts.drop("n_a", "n_b"), "rank").select(*t.columns, bundle, mine, each))
    by = ["bundle", "block_a", "block_b"]

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        return _best_in_block(left, right, bar, within)

    dealt_blocks = [t.repartition(tasks, *by).groupBy(*by) for t in blocks]
    return dealt_blocks[0].cogroup(dealt_blocks[1]).applyInArrow(block, f"term long, name long, least {kind}, n long, similarity double")


def merged_occurrences(occurrences: DataFrame, identifiers: DataFrame) -> DataFrame:
    """``occurrence_id, component`` of occurrences joined by shared strong identifiers.

    ``identifiers`` is ``occurrence_id, scheme, value``.  Each identifier links
    its occurrences to the smallest of them, so a shared one costs as many
    links as it has occurrences.
    """
    root = identifiers.groupBy("scheme", "value").agg(F.min("occurrence_id").alias("root"))
    links = identifiers.join(root, ["scheme", "value"]).select(F.col("occurrence_id").alias("src"), F.col("root").alias("dst"))
    found = connected_components(links)
    return occurrences.select("occurrence_id").distinct().join(found, F.col("occurrence_id") == F.col("vertex"), "left").select("occurrence_id", F.coalesce("component", "occurrence_id").alias("component"))


def merge_review(members: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Components whose members disagree on the value of a scheme."""
    joined = members.join(identifiers, "occurrence_id")
    each = joined.groupBy("component", "scheme").agg(F.count_distinct("value").alias("n_values"))
    return each.groupBy("component").agg(F.max("n_values").alias("most_values"), (F.max("n_values") > 1).alias("needs_review"))


def resolution_summary(resolutions: DataFrame, *by: str) -> DataFrame:
    """Counts by each of several columns and in all, in one pass."""
    sets = [[c] for c in by] + [[]]
    rows = resolutions.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in by]).agg(F.count("*").alias("n"))
    return rows


def precision_recall(pairs: DataFrame, least: int = 30) -> DataFrame:
    """Precision, recall and accuracy of ``predicted`` against ``label``, null with too few cases."""
    hit = (F.col("predicted") == 1) & (F.col("label") == 1)
    found = pairs.agg(
        F.count("*").alias("n_cases"),
        F.count_if(F.col("predicted") == 1).alias("n_predicted"),
        F.count_if(F.col("label") == 1).alias("n_positive"),
        F.count_if(hit).alias("n_hit"),
        F.count_if(F.col("predicted") == F.col("label")).alias("n_right"),
    )

    def rate(a: str, b: str) -> Column:
        return F.when(F.col(b) >= least, F.col(a) / F.col(b))

    return found.withColumns({"precision": rate("n_hit", "n_predicted"), "recall": rate("n_hit", "n_positive"), "accuracy": rate("n_right", "n_cases")})


def calibration(pairs: DataFrame, bins: int = 5) -> DataFrame:
    """For each bin of confidence: cases, mean confidence, share right, and the gap between them."""
    found = pairs.withColumn("bin", bin_index(F.col("confidence"), bins)).groupBy("bin").agg(
        F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg(F.col("right").cast("double")).alias("share_right")
    )
    return found.withColumn("gap", F.abs(F.col("mean_confidence") - F.col("share_right")))


def calibration_error(pairs: DataFrame, bins: int = 5) -> DataFrame:
    """Expected calibration error and Brier score."""
    right = F.col("right").cast("double")
    each = pairs.withColumn("bin", bin_index(F.col("confidence"), bins)).groupBy("bin").agg(
        F.count("*").alias("n"), F.sum("confidence").alias("c"), F.sum(right).alias("r"), F.sum((F.col("confidence") - right) ** 2).alias("b")
    )
    return each.agg((F.sum(F.abs(F.col("c") - F.col("r"))) / F.sum("n")).alias("ece"), (F.sum("b") / F.sum("n")).alias("brier"))


def stratified_sample(df: DataFrame, id_col: str, stratum: str, version: str, per_stratum: int, cap: int) -> DataFrame:
    """A repeatable sample: by hash within each stratum, the strata taking turns up to a cap."""
    key = F.sha2(F.concat(F.lit(version), F.lit(":"), F.col(id_col).cast("string")), 256)
    ranked = df.withColumn("sample_key", key).withColumn("turn", F.row_number().over(Window.partitionBy(stratum).orderBy("sample_key", id_col)))
    return ranked.where(F.col("turn") <= per_stratum).orderBy("turn", stratum, "sample_key").limit(cap)


def identity_key(tiers: list[tuple[Column, float, str]]) -> Column:
    """The first identifier there is, in order of trust, as ``(key, confidence, method)``."""
    return F.coalesce(*[F.when(key.isNotNull(), F.struct(F.concat(F.lit(f"{method}:"), key).alias("key"), F.lit(confidence).alias("confidence"), F.lit(method).alias("method"))) for key, confidence, method in tiers])


def by_precedence(rows: DataFrame, key: str, value: str, *sources: tuple[str, DataFrame]) -> DataFrame:
    """``rows`` with the value of the first source that has the key, its name, and whether later ones disagree.

    Each source is (name, table of key and value) with distinct keys.
    """
    joined = rows
    for i, (_, table) in enumerate(sources):
        joined = joined.join(table.select(F.col(key), F.col(value).alias(f"__{i}")), key, "left")
    found = [F.col(f"__{i}") for i in range(len(sources))]
    method = F.coalesce(*[F.when(c.isNotNull(), F.lit(name)) for c, (name, _) in zip(found, sources, strict=True)])
    distinct = F.size(F.array_distinct(F.array_compact(F.array(*found))))
    return joined.select(*rows.columns, F.coalesce(*found).alias(value), method.alias("method"), (distinct > 1).alias("conflict"))
