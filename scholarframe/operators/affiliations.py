"""Affiliation texts and evidence against a registry of institutions, with an account of what speaks against a match.

Names are found through a positional index: each is entered at the rarest of
its words, with that word's place in the name, so a text meets only names whose
rarest word it holds, and common words such as *university* are nobody's key.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.arrow_udf(StringType())
def compared(texts: pa.Array) -> pa.Array:
    """Texts as they are compared: compatibility form, case folded, runs of white space as one space."""
    return pa.array([None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()) for t in texts.to_pylist()], pa.string())


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)\w+"), 0)


def _bounded(text: Column, name: Column) -> Column:
    """Whether a text holds a name as it is written, with no word character beside it."""
    quoted = F.concat(F.lit(r"(?U)(?<!\w)\Q"), name, F.lit(r"\E(?!\w)"))
    return F.contains(text, name) & F.regexp_like(text, quoted)


def placed_names(texts: DataFrame, text_id: list[str], text: str, names: DataFrame, name_id: str, name: str, longest: bool = True) -> DataFrame:
    """``(*text_id, name_id, start, stop, whole)``: where texts hold names, in places of words, the stop exclusive.

    Both are compared forms.  ``whole`` is true where the name is the whole
    text.  With ``longest`` a name that lies within a longer one at that place
    does not count.  Names without word characters are found nowhere.
    """
    units = texts.select(*text_id, F.col(text).alias("__text"), _words(F.col(text)).alias("__words")).where(F.size("__words") > 0)
    own = names.select(F.col(name_id).alias("__id"), F.col(name).alias("__name"), _words(F.col(name)).alias("__own")).where(F.size("__own") > 0).distinct()
    frequency = units.select(F.explode(F.array_distinct("__words")).alias("__word")).unionAll(own.select(F.explode(F.array_distinct("__own")).alias("__word"))).groupBy("__word").agg(F.count("*").alias("__n"))
    entered = own.select("*", F.posexplode("__own").alias("__at", "__word")).join(frequency, "__word")
    index = entered.groupBy("__id", "__name", "__own").agg(F.min_by(F.struct("__word", "__at"), F.struct("__n", "__word", "__at")).alias("__key")).select("__id", "__name", "__own", "__key.*")
    met = units.select("*", F.posexplode("__words").alias("__place", "__word")).join(index, "__word")
    start, size = F.col("__place") - F.col("__at"), F.size("__own")
    found = met.where((start >= 0) & (start + size <= F.size("__words"))).where((F.slice("__words", start + 1, size) == F.col("__own")) & _bounded(F.col("__text"), F.col("__name")))
    found = found.select(*text_id, F.col("__id").alias(name_id), start.alias("start"), (start + size).alias("stop"), (F.col("__text") == F.col("__name")).alias("whole")).distinct()
    if not longest:
        return found
    earlier = F.max("stop").over(Window.partitionBy(*text_id).orderBy("start").rangeBetween(Window.unboundedPreceding, -1))
    widest = F.max("stop").over(Window.partitionBy(*text_id, "start"))
    marked = found.withColumns({"__earlier": earlier, "__widest": widest})
    return marked.where((F.col("__widest") == F.col("stop")) & ~F.coalesce(F.col("__earlier") >= F.col("stop"), F.lit(False))).drop("__earlier", "__widest")


# Why a text is not matched, and the words of simple subunits.
NO_CANDIDATE = "ROR match has no unique chosen authority"
NO_CLAUSE = "chosen ROR lacks a unique whole institutional clause or conflicts with another institution"
SUBUNIT = "additional organization or unclassified subunit clause remains unresolved"
NO_PLACE = "paper-native geographic corroboration is missing"
NO_LOCATION = "affiliation address has no ROR location corroboration"
COUNTRY = "affiliation country is absent, ambiguous or not exactly supported"
OTHER_COUNTRY = "paper-native country contradicts the chosen ROR location"
CITY = "paper-native city is absent or inconsistent with ROR"
LEFTOVER = "additional unclassified address or institution clause remains unresolved"
POSTDATES = "chosen ROR organization postdates the paper-time affiliation"
SUCCESSION = "historical predecessor/successor identity is not established by this match"
SUBJECTS = "physics|theoretical physics|experimental physics|nuclear physics|particle physics|applied physics|astronomy|astrophysics|mathematics|applied mathematics|chemistry|biology|computer science|science|sciences|engineering"
SIMPLE_SUBUNIT = rf"^(?:department|dept\.?|faculty|school|division) (?:of )?(?:{SUBJECTS})(?: (?:and|&) (?:{SUBJECTS}))?$"
NAME_TYPES = ("ror_display", "label", "alias")


def affiliation_matches(texts: DataFrame, text_id: str, raw: str, year: str, registry: DataFrame, countries: DataFrame) -> DataFrame:
    """``(text_id, entity, country_code, city, state, reason)`` for every affiliation text.

    ``registry`` has ``entity``, ``names`` (an array of ``value`` and
    ``types``), ``locations`` (``country_code``, ``city``, ``subdivision``,
    ``subdivision_code``), ``established`` and ``relationships`` (an array of
    their types); ``countries`` has ``code``, ``code3`` and ``names``, one row
    for each country.

    A text is cut into clauses at commas, semicolons and lines.  One clause,
    and no other, must be a name of exactly one institution, acronyms left
    out; clauses before it may only be simple subunits; those after it must
    name one country, and unless they are nothing else one city, of the
    institution, and no letters may be left over.  The institution must be as
    old as the paper and have neither predecessor nor successor.  Texts of the
    same wording and year are decided once.
    """
    keyed = texts.select(F.col(text_id), F.coalesce(F.col(raw), F.lit("")).alias("raw"), F.col(year).alias("year"))
    keyed = keyed.withColumn("text_key", F.sha2(F.concat_ws(":", F.coalesce(F.col("year").cast("string"), F.lit("")), "raw"), 256))
    asked = keyed.select("text_key", "raw", "year").distinct()
    parts = asked.select("text_key", F.posexplode(F.split("raw", "[,;\\n]")).alias("at", "part")).withColumn("clause", compared("part")).where("clause <> ''").select("text_key", "at", "clause")
    labels = registry.select("entity", F.inline("names")).where(~F.array_contains("types", "acronym") & F.arrays_overlap("types", F.array(*map(F.lit, NAME_TYPES))))
    labels = labels.select("entity", compared("value").alias("label")).where("label <> ''").distinct()
    hits = parts.join(labels, parts["clause"] == labels["label"]).groupBy("text_key").agg(F.count_distinct("entity").alias("n_entities"), F.count_distinct("at").alias("n_clauses"), F.min("entity").alias("entity"), F.min("at").alias("home"))
    chosen = hits.where("n_entities = 1 and n_clauses = 1").select("text_key", "entity", "home")
    placed = parts.join(chosen, "text_key")
    before = placed.where("at < home").groupBy("text_key").agg(F.bool_and(F.col("clause").rlike(SIMPLE_SUBUNIT)).alias("simple"))
    tail = placed.where("at > home").select("text_key", "at", "clause", "entity")

    # countries: a clause that is a code, or holds a name
    terms = countries.select("code", F.explode("names").alias("term")).select("code", compared("term").alias("term"))
    codes = countries.select("code", F.explode(F.array("code", "code3")).alias("c")).select("code", compared("c").alias("term"))
    units = tail.select(F.col("clause").alias("unit")).distinct()
    by_name = placed_names(units, ["unit"], "unit", terms.withColumn("id", F.struct("code", "term")), "id", "term", longest=False).select("unit", "id.code", "whole")
    by_code = units.join(codes, units["unit"] == codes["term"]).select("unit", "code", F.lit(True).alias("whole"))
    named = by_name.unionByName(by_code).groupBy("unit", "code").agg(F.bool_or("whole").alias("whole"))
    seen = tail.join(named, tail["clause"] == named["unit"]).groupBy("text_key").agg(F.count_distinct("code").alias("n_countries"), F.min("code").alias("country"), F.bool_or("whole").alias("whole_country"))
    sizes = tail.groupBy("text_key").agg(F.count("*").alias("n_tail"), F.transform(F.array_sort(F.collect_list(F.struct("at", "clause"))), lambda c: c["clause"]).alias("address"))

    # cities of the institution in that country, and what is left of the address without them
    facts = registry.select(F.col("entity"), "established", "relationships", F.coalesce("locations", F.array().cast(registry.schema["locations"].dataType)).alias("locations"))
    state = chosen.join(sizes, "text_key", "left").join(before, "text_key", "left").join(seen, "text_key", "left").join(facts, "entity", "left")
    state = state.withColumn("there", F.filter("locations", lambda x: x["country_code"] == F.col("country")))
    places = state.select("text_key", F.array_join("address", " ").alias("address"), F.inline("there"))
    folded = places.select("text_key", "address", "city", compared("city").alias("term"), compared("subdivision").alias("__a"), compared("subdivision_code").alias("__b")).where("term <> ''")
    folded = folded.withColumn("within", F.filter(F.array("__a", "__b"), lambda x: x != ""))
    cities = folded.where(_bounded(F.col("address"), F.col("term"))).groupBy("text_key").agg(F.count_distinct("city").alias("n_cities"), F.min("city").alias("city"), F.collect_set("term").alias("city_terms"), F.array_distinct(F.flatten(F.collect_set("within"))).alias("within"))
    allowed = terms.unionAll(codes).groupBy("code").agg(F.collect_set("term").alias("country_terms"))
    state = state.join(cities, "text_key", "left").join(F.broadcast(allowed), F.col("country") == F.col("code"), "left")  # one row a country
    every = F.array_distinct(F.concat(*(F.coalesce(c, F.array().cast("array<string>")) for c in ("city_terms", "country_terms", "within"))))
    ordered = F.reverse(F.array_sort(F.transform(every, lambda t: F.struct(F.length(t).alias("n"), t.alias("t")))))
    # terms are taken out longest first; none goes over a line's end, so each clause is on its own
    rest = F.aggregate(ordered, F.array_join("address", "\n"), lambda text, t: F.regexp_replace(text, F.concat(F.lit(r"(?U)(?<!\w)\Q"), t["t"], F.lit(r"\E(?!\w)")), F.lit("")))
    state = state.withColumn("rest", rest)
    country_only = (F.col("n_tail") == 1) & F.coalesce("whole_country", F.lit(False))
    reason = (
        F.when(~F.coalesce("simple", F.lit(True)), SUBUNIT)
        .when(F.coalesce("n_tail", F.lit(0)) == 0, NO_PLACE)
        .when(F.size("locations") == 0, NO_LOCATION)
        .when(F.coalesce("n_countries", F.lit(0)) != 1, COUNTRY)
        .when(F.size("there") == 0, OTHER_COUNTRY)
        .when(~country_only & (F.coalesce("n_cities", F.lit(0)) != 1), CITY)
        .when(F.col("rest").rlike(r"\p{L}"), LEFTOVER)
        .when(F.col("established") > F.col("year"), POSTDATES)
        .when(F.arrays_overlap(F.coalesce("relationships", F.array().cast("array<string>")), F.array(F.lit("predecessor"), F.lit("successor"))), SUCCESSION)
    )
    judged = state.join(asked.select("text_key", "year"), "text_key").select("text_key", "entity", "country", "city", reason.alias("reason"))
    matched = F.col("reason").isNull()
    settled = matched | F.col("reason").isin(LEFTOVER, POSTDATES, SUCCESSION)  # only then is the place known
    judged = judged.select("text_key", F.when(matched, F.col("entity")).alias("entity"), F.when(settled | (F.col("reason") == CITY), F.col("country")).alias("country_code"), F.when(settled, F.col("city")).alias("city"), "reason")
    unplaced = hits.where("n_entities <> 1 or n_clauses <> 1").select("text_key", F.lit(None).cast(registry.schema["entity"].dataType).alias("entity"), F.lit(None).cast("string").alias("country_code"), F.lit(None).cast("string").alias("city"), F.when(F.col("n_entities") >= 1, NO_CLAUSE).alias("reason"))
    decided = judged.unionByName(unplaced)
    full = keyed.join(decided.withColumn("__seen", F.lit(True)), "text_key", "left").withColumn("reason", F.when(F.col("__seen").isNull(), NO_CANDIDATE).otherwise(F.col("reason")))
    state = F.when(F.col("reason").isNull(), "certified").otherwise("needs_review")
    return full.select(text_id, "entity", "country_code", "city", state.alias("state"), "reason")


# --- the order of evidence


def _lifecycle(year: Column, established: Column, relationships: Column) -> Column:
    """Why an institution as it is now cannot stand for one at the time of a paper."""
    changed = F.arrays_overlap(F.coalesce(relationships, F.array().cast("array<string>")), F.array(F.lit("predecessor"), F.lit("successor")))
    return F.when(year.isNull(), "institution-exact-paper-time-date-missing").when(established > year, "institution-authority-established-after-paper").when(changed, "institution-lifecycle-requires-dated-resolution")


def launch_resolution(slots: DataFrame, registry: DataFrame) -> DataFrame:
    """``slots`` with ``institution_id``, ``country_code``, ``method``, ``state`` and ``reason``: one attribution for each affiliation.

    A slot has ``raw`` and ``provider_id`` (either may be null), ``local`` and
    ``provider`` (arrays of registry ids that the paper and its provider
    name), ``grid`` (the id a crosswalk gives), ``provider_countries``,
    ``matched``, ``matched_country``, ``match_state`` and ``match_reason`` (of
    :func:`affiliation_matches`), and ``paper_year``.  ``registry`` has
    ``institution_id``, ``established``, ``relationships`` and ``countries``.

    Evidence counts in this order: the paper's own id, the provider's, the
    crosswalk's, the text's; what conflicts resolves to nothing, and so does an
    institution that is younger than the paper, has been succeeded, or whose
    country is not one.
    """
    none = F.array().cast("array<string>")
    local, provider = (F.array_distinct(F.coalesce(c, none)) for c in ("local", "provider"))
    rows = slots.withColumns({"__local": local, "__provider": provider})
    direct = F.col("__local")[0]
    first = F.coalesce(F.when(F.size("__local") > 0, direct), F.when(F.size("__provider") > 0, F.col("__provider")[0]))
    text = F.col("raw").isNotNull() & F.col("match_state").isNotNull()
    method = (
        F.when(F.size("__local") > 0, "paper").when(F.size("__provider") > 0, "provider").when(F.col("grid").isNotNull(), "crosswalk").when(text & F.col("matched").isNotNull(), "text")
    )
    target = F.coalesce(first, F.col("grid"), F.when(text, F.col("matched")))
    rows = rows.withColumns({"method": method, "__target": target})
    facts = registry.select(F.col("institution_id").alias("__id"), F.col("established").alias("__established"), F.col("relationships").alias("__relationships"), F.array_distinct(F.coalesce("countries", none)).alias("__countries"))
    rows = rows.join(facts, F.col("__target") == F.col("__id"), "left")
    lifecycle = _lifecycle(F.col("paper_year"), F.col("__established"), F.col("__relationships"))
    own = F.array_sort(F.array_distinct(F.coalesce("provider_countries", none)))
    kind = F.col("method")

    def outcome(state: str, reason: Column | str) -> Column:
        return F.struct(F.lit(state).alias("state"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))

    # The reasons.
    found = (
        F.when(F.col("raw").isNull() & F.col("provider_id").isNull() & (F.size("__local") == 0), outcome("insufficient_evidence", "empty-paper-time-affiliation-entry"))
        .when(F.size("__local") > 1, outcome("conflicted", "multiple-paper-native-ror-targets"))
        .when((F.size("__provider") > 1) | ((F.size("__local") > 0) & (F.size("__provider") > 0) & (direct != F.col("__provider")[0])), outcome("conflicted", "provider-and-paper-ror-assertions-conflict"))
        .when(kind.isNull() & text & F.col("paper_year").isNull(), outcome("insufficient_evidence", "raw-affiliation-exact-paper-date-missing"))
        .when(kind.isNull() & text, outcome("needs_review", F.coalesce("match_reason", F.lit(NO_CANDIDATE))))
        .when(kind.isNull() & F.col("provider_id").isNotNull(), outcome("insufficient_evidence", "paper-native-institution-link-has-no-ror-authority"))
        .when(kind.isNull(), outcome("insufficient_evidence", "paper-native-affiliation-has-no-resolved-authority"))
        .when((kind == "text") & F.col("paper_year").isNull(), outcome("insufficient_evidence", "raw-affiliation-exact-paper-date-missing"))
        .when((kind == "text") & (F.col("match_state") != "certified"), outcome("needs_review", F.col("match_reason")))
        .when((kind == "text") & F.col("__id").isNull(), outcome("insufficient_evidence", "matched-ror-authority-unavailable"))
        .when(F.col("__id").isNull(), outcome("insufficient_evidence", "exact-ror-authority-unavailable"))
        .when(lifecycle.isNotNull(), outcome("insufficient_evidence", lifecycle))
        .when((kind == "crosswalk") & (F.size(own) > 0) & (own != F.array_sort("__countries")), outcome("conflicted", "grid-authority-country-conflict"))
        .when((kind == "text") & ~((F.size("__countries") == 1) & F.coalesce(F.col("__countries")[0] == F.col("matched_country"), F.lit(False))), outcome("conflicted", "matched-ror-country-is-not-unambiguous"))
        .when(F.size("__countries") != 1, outcome("insufficient_evidence", "authority-country-missing-or-ambiguous"))
        .otherwise(F.struct(F.lit("certified").alias("state"), F.lit(None).cast("string").alias("reason")))
    )
    done = rows.withColumn("__found", found)
    good = F.col("__found.state") == "certified"
    return done.select(*slots.columns, F.when(good, F.col("__target")).alias("institution_id"), F.when(good, F.col("__countries")[0]).alias("country_code"), "method", "__found.state", "__found.reason")
