"""Name normalisation and similarity as column expressions.

Only the removal of accents needs more than built-in functions; it is a
translation over the letters that decompose, built from the Unicode database.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    source, target = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(code):
            source.append(chr(code))
            target.append(plain)
    return "".join(source), "".join(target)


ACCENTED, PLAIN = _accents()


def unaccented(s: Column) -> Column:
    """Letters without their accents, and combining marks removed."""
    return F.regexp_replace(F.translate(F.replace(s, F.lit("ß"), F.lit("ss")), ACCENTED, PLAIN), "[\\u0300-\\u036f]", "")


def search_term(s: Column) -> Column:
    """The search form: no accents, lower case, ``&`` as *and*, other characters as single spaces."""
    return F.trim(F.regexp_replace(F.replace(F.lower(unaccented(s)), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def unicode_term(s: Column) -> Column:
    """As :func:`search_term`, with letters and digits of every script kept."""
    return F.trim(F.regexp_replace(F.replace(F.lower(unaccented(s)), F.lit("&"), F.lit(" and ")), "[^\\p{L}\\p{N}]+", " "))


def name_key(s: Column) -> Column:
    """Lower case, with runs of anything but letters, digits and underscores as one space."""
    return F.trim(F.regexp_replace(F.lower(s), "[^\\p{L}\\p{N}_]+", " "))


def lookup_terms(normalised: Column) -> Column:
    """The whole term and its words of two characters or more, each once."""
    return F.array_distinct(F.concat(F.array(normalised), F.filter(F.split(normalised, " "), lambda t: F.length(t) >= 2)))


def slug(s: Column) -> Column:
    """Lower-case words joined by hyphens; *unresolved* when nothing is left."""
    found = F.regexp_replace(F.regexp_replace(F.lower(unaccented(s)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(found == "", "unresolved").otherwise(found)


#: Words that do not count in an acronym.
SMALL_WORDS = ("and", "at", "de", "der", "for", "in", "of", "the", "und")


def acronym(normalised: Column) -> Column:
    """The initials of the words that count."""
    words = F.filter(F.split(normalised, " "), lambda t: (t != "") & ~t.isin(*SMALL_WORDS))
    return F.array_join(F.transform(words, lambda t: F.substring(t, 1, 1)), "")


def token_dice(a: Column, b: Column) -> Column:
    """Dice similarity of the sets of words."""
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    return 2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))


def bigrams(s: Column) -> Column:
    """The distinct pairs of neighbouring characters, spaces left out; shorter strings give themselves."""
    t = F.replace(s, F.lit(" "), F.lit(""))
    return F.when(F.length(t) < 2, F.array(t)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))))


def bigram_dice(a: Column, b: Column) -> Column:
    """Dice similarity of the bigram sets."""
    x, y = bigrams(a), bigrams(b)
    return 2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))


def edit_similarity(a: Column, b: Column) -> Column:
    """One minus the edit distance in proportion to the longer string."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def search_score(query: Column, term: Column, ceiling: Column) -> Column:
    """How well a term answers a query, up to the term's ceiling; null when it does not.

    Equal terms reach the ceiling; initials at most 0.97; a prefix of three
    characters or more 0.91; otherwise edit and word similarity from 0.58 on.
    """
    mixed = 0.68 * edit_similarity(query, term) + 0.32 * token_dice(query, term)
    fuzzy = F.least(ceiling, 0.48 + 0.48 * mixed)
    best = (
        F.when(query == term, ceiling)
        .when(query == acronym(term), F.least(ceiling, F.lit(0.97)))
        .when((F.length(query) >= 3) & term.startswith(query), F.least(ceiling, F.lit(0.91)))
        .when((F.length(query) >= 4) & (mixed >= 0.58), fuzzy)
    )
    return F.when(best >= 0.62, best)
