"""External identifiers: schemes, their forms, and check digits, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def orcid_is_valid(s: Column) -> Column:
    """The form, and the ISO 7064 mod 11-2 check character."""
    digits = F.split(F.regexp_replace(s, "-", ""), "")
    total = F.aggregate(F.slice(digits, 1, 15), F.lit(0), lambda n, d: (n + F.coalesce(F.try_to_number(d, F.lit("9")).cast("int"), F.lit(0))) * 2)
    check = F.pmod(12 - F.pmod(total, F.lit(11)), F.lit(11))
    expected = F.when(check == 10, "X").otherwise(check.cast("string"))
    return F.coalesce(s.rlike("^\\d{4}-\\d{4}-\\d{4}-[\\dX]{4}$") & (F.substring(s, -1, 1) == expected), F.lit(False))


def from_url(s: Column, host: str, marker: str = "") -> Column:
    """The path of a URL on ``host``, the part after ``marker`` if one is asked for; other strings as they are."""
    is_url = s.rlike(f"(?i)^https?://{host.replace('.', '[.]')}[.]?(/|$)")
    path = F.regexp_replace(F.regexp_replace(s, "(?i)^https?://[^/]+/?", ""), "^/+|/+$|[?#].*$", "")
    if not marker:
        return F.when(is_url, path).otherwise(s)
    inner = F.regexp_extract(path, f"(?i)(?:^|/){marker}/([^/]+)$", 1)
    return F.when(is_url, inner).otherwise(s)


def _unprefixed(s: Column, prefix: str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(s, f"(?i)^{prefix}:\\s*", ""), "^/+|/+$", ""))


def normalised(scheme: Column, value: Column) -> Column:
    """The canonical form of an identifier of a known scheme; null when it is not one."""
    s = F.trim(value)
    doi = F.lower(F.trim(F.regexp_replace(s, "(?i)^(doi:\\s*|https?://(dx[.])?doi[.]org/)", "")))
    orcid = F.upper(_unprefixed(from_url(s, "orcid.org"), "orcid"))
    ror = F.lower(_unprefixed(from_url(s, "ror.org"), "ror"))
    arxiv = F.regexp_replace(from_url(from_url(s, "arxiv.org"), "export.arxiv.org"), "(?i)^(abs|pdf)/", "")
    arxiv = F.lower(F.regexp_replace(F.regexp_replace(_unprefixed(arxiv, "arxiv"), "(?i)[.]pdf$", ""), "(?i)v\\d+$", ""))
    inspire = _unprefixed(from_url(s, "inspirehep.net", "literature"), "inspire")
    return (
        F.when(scheme == "doi", F.when(doi.startswith("10.") & doi.contains("/"), doi))
        .when(scheme == "orcid", F.when(orcid_is_valid(orcid), orcid))
        .when(scheme == "ror", F.when(ror.rlike("^[0-9a-z]{9}$"), ror))
        .when(scheme == "arxiv", F.when(arxiv.rlike("^(\\d{4}[.]\\d{4,5}|[a-z.-]+/\\d{7})$"), arxiv))
        .when(scheme == "inspire", F.when(inspire.rlike("^\\d+$"), inspire))
    )


def health_class(status: Column) -> Column:
    """What an HTTP status says about a link."""
    return (
        F.when(status.between(200, 299), "reachable")
        .when(status.isin(302, 303, 307), "redirect")
        .when(status.isin(301, 308), "permanent-redirect")
        .when(status.isin(404, 410), "broken")
        .otherwise("unknown")
    )


def public_url(url: Column) -> Column:
    """Whether a URL is http or https on a public-looking host without user info."""
    host = F.lower(F.regexp_extract(url, "^[a-zA-Z]+://([^/:?#]+)", 1))
    private = host.rlike("^(localhost|127[.].*|10[.].*|192[.]168[.].*|172[.](1[6-9]|2[0-9]|3[01])[.].*|169[.]254[.].*|0[.].*)$")
    return F.coalesce(url.rlike("(?i)^https?://[^/@\\s]+([/?#]|$)") & host.contains(".") & ~private, F.lit(False))
