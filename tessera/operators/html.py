"""Reviews out of HTML text by regular expressions (a rule, not a DOM: an element ends at the next closing tag).

Null or empty HTML gives an empty array.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import collapse_spaces

MIN_CHARS, MAX_CHARS = 100, 3000
#: Class names that mark a review where the first rule finds none: fixed values.
FALLBACK_CLASSES = ("review-card__quote", "c-siteReview_quote", "review_body", "c-siteReview")


def strip_tags(html: Column) -> Column:
    """A space for every tag, so that texts on both sides of one stay apart."""
    return F.regexp_replace(html, "<[^>]*>", " ")


def elements(html: Column, tag: str) -> Column:
    """Inner texts of ``<tag ...>...</tag>``, tags stripped, white space collapsed."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), 1)
    return F.transform(found, lambda x: collapse_spaces(strip_tags(x)))


def reviews(html: Column, tag: str = "span", max_n: int = 10, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS) -> Column:
    """At most ``max_n`` distinct review texts in page order.

    Kept are texts of more than ``min_chars`` and less than ``max_chars`` characters without ``Expand`` or sign-in words. Where none is left,
    elements whose class names a review, by length alone.
    """
    inside = lambda x: (F.length(x) > min_chars) & (F.length(x) < max_chars)
    clean = lambda x: inside(x) & ~x.contains("Expand") & ~F.lower(x).rlike("metacritic|sign in")
    first = F.array_distinct(F.filter(elements(html, tag), clean))
    names = "|".join(FALLBACK_CLASSES)
    raw = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(rf'(?s)<div[^>]*class="[^"]*(?:{names})[^"]*"[^>]*>(.*?)</div>'), 1)
    second = F.array_distinct(F.filter(F.transform(raw, lambda x: F.trim(strip_tags(x))), inside))
    return F.slice(F.when(F.size(first) > 0, first).otherwise(second), 1, max_n)


def json_values(source: Column, field: str) -> Column:
    """All values of one string field in a page's JSON text, escapes decoded, without repeats."""
    raw = F.regexp_extract_all(F.coalesce(source, F.lit("")), F.lit(rf'"{field}"\s*:\s*"((?:[^"\\]++|\\.)*+)"'), 1)
    return F.array_distinct(F.transform(raw, _decoded))


def _decoded(raw: Column) -> Column:
    return F.from_json(F.concat(F.lit('["'), raw, F.lit('"]')), "array<string>")[0]


def quotes(source: Column, field: str = "quote", min_chars: int = 40, max_n: int = 10) -> Column:
    """At most ``max_n`` distinct values of a string field of more than ``min_chars`` characters, without a web address.

    The longest as written come first, ties in the order of their text; there is no upper bound on their length.
    """
    raw = F.array_distinct(F.regexp_extract_all(F.coalesce(source, F.lit("")), F.lit(rf'"{field}"\s*:\s*"((?:[^"\\]++|\\.)*+)"'), 1))
    longest = F.array_sort(F.transform(raw, lambda m: F.struct((-F.length(m)).alias("l"), m.alias("m"))))
    texts = F.transform(longest, lambda x: _decoded(x["m"]))
    return F.slice(F.array_distinct(F.filter(texts, lambda t: (F.length(t) > min_chars) & ~t.contains("http"))), 1, max_n)


def first_found(source: Column, *patterns: str) -> Column:
    """What the first pattern that matches with a non-empty first group has in it; null if none does."""
    found = [F.regexp_extract(F.coalesce(source, F.lit("")), p, 1) for p in patterns]
    return F.coalesce(*[F.when(f != "", f) for f in found])
