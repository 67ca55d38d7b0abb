"""String functions of labels, tags, URLs and ratings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"


def normal_label(label: Column) -> Column:
    """Lower case, underscores and hyphens as spaces, runs of white space as one, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(F.translate(label, "_-", "  ")), SPACE, " "))


def article(label: Column) -> Column:
    """a or an, by the first ASCII letter or digit."""
    first = F.lower(F.regexp_extract(label, "([0-9A-Za-z])", 1))
    return F.when(first.isin("a", "e", "i", "o", "u"), "an").otherwise("a")


def variants(label: Column) -> Column:
    """The label alone, with its article, and with the; sorted, each once."""
    return F.array_sort(F.array_distinct(F.array(label, F.concat_ws(" ", article(label), label), F.concat(F.lit("the "), label))))


def prompt(variant: Column, prefix: str = "a photo of ", suffix: str = ".") -> Column:
    return F.concat(F.lit(prefix), variant, F.lit(suffix))


def normal_tags(tags: Column) -> Column:
    """Trimmed, not empty, sorted, each once."""
    trimmed = F.transform(tags, lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", ""))
    return F.array_sort(F.array_distinct(F.filter(trimmed, lambda t: t != "")))


def rating(value: Column) -> Column:
    """1 to 5; empty, 0 and -1 are null; anything else is an error."""
    v = F.trim(value)
    n = v.try_cast("int")
    bad = F.raise_error(F.concat(F.lit("not a rating: "), value)).cast("int")
    return F.when(v.isNull() | (v == "") | n.isin(0, -1), F.lit(None).cast("int")).when(n.between(1, 5), n).otherwise(bad)


def display_name(path: Column) -> Column:
    """The last segment; a long id without one is shortened in the middle."""
    short = F.concat(F.lit("Photo "), F.left(path, F.lit(8)), F.lit("..."), F.right(path, F.lit(8)))
    return F.when(path.contains("/"), F.element_at(F.split(path, "/"), -1)).when(F.octet_length(path) > 20, short).otherwise(path)


def query_parameter(url: Column, name: str) -> Column:
    """The first value of a query parameter, as written; null if absent."""
    found = F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1)
    return F.when(F.regexp_like(url, F.lit(rf"[?&]{name}=")), found)


def percent_encode(value: Column) -> Column:
    """All but letters, digits and -_.~ as %XX."""
    return F.replace(F.replace(F.replace(F.url_encode(value), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def percent_decode(value: Column) -> Column:
    """%XX as bytes of UTF-8; a plus stays a plus; null if malformed."""
    return F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B")))


def matches_all_terms(name: Column, tags: Column, search: Column) -> Column:
    """Whether each comma-separated term, trimmed and in lower case, is in the name or in some tag."""
    terms = F.filter(F.transform(F.split(F.lower(search), ","), lambda t: F.trim(t)), lambda t: t != "")
    return F.forall(terms, lambda t: F.contains(F.lower(name), t) | F.exists(tags, lambda g: F.contains(F.lower(g), t)))


def month_key(at: Column) -> Column:
    return F.coalesce(F.date_format(at, "yyyy-MM"), F.lit("unknown"))


def timestamp_millis(value: Column) -> Column:
    """Of RFC 2822 and RFC 3339 times and of such with a space or without a zone; else null."""
    mail = F.regexp_replace(value, r"^[A-Za-z]{3},\s*", "")
    parsed = F.coalesce(F.try_to_timestamp(value), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")))
    return F.unix_millis(parsed)


def xmp_rating(xmp: Column) -> Column:
    """The first attribute, else element, named Rating in any namespace; null if absent or no number."""
    attribute = F.regexp_extract(xmp, r"""[\s:]Rating\s*=\s*["']\s*(-?\d+)""", 1)
    element = F.regexp_extract(xmp, r"<(?:\w+:)?Rating\s*>\s*(-?\d+)", 1)
    return F.nullif(F.when(attribute != "", attribute).otherwise(element), F.lit("")).try_cast("int")
