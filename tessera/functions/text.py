"""Text expressions. All stay inside the JVM; none needs a Python worker."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_PATTERN = r"[\p{L}\p{N}]+"
ASCII_ALNUM = "[a-z0-9]"


def present(value: Column | str) -> Column:
    """The text, or null where it is absent: null and ``''`` both count as absent."""
    c = F.col(value) if isinstance(value, str) else value
    return F.when(c != "", c)


def first_present(*values: Column | str) -> Column:
    """The first value that is not absent, else null."""
    return F.coalesce(*[present(v) for v in values])


def tokens(text: Column | str, stop_words: Iterable[str] = ()) -> Column:
    """Lower-cased runs of letters and digits holding at least one of a-z0-9, without ``stop_words``; repeats stay.

    Null or empty text gives an empty array.
    """
    c = F.col(text) if isinstance(text, str) else text
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN_PATTERN), 0)
    stops = sorted(set(stop_words))
    keep = (lambda x: x.rlike(ASCII_ALNUM) & ~x.isin(stops)) if stops else (lambda x: x.rlike(ASCII_ALNUM))
    return F.filter(words, keep)


def query_tokens(query: str, stop_words: Iterable[str] = ()) -> tuple[str, ...]:
    """The tokens of a short query, by the rules of :func:`tokens`, on the driver: they become literals of the plan."""
    stops = set(stop_words)
    found = re.findall(r"[^\W_]+", query.lower())
    return tuple(t for t in found if re.search(ASCII_ALNUM, t) and t not in stops)


def collapse_spaces(text: Column) -> Column:
    """Runs of white space made one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


@cache
def _decompositions() -> tuple[str, str, dict[str, str]]:
    """From the Unicode database: characters whose compatibility decomposition holds one ASCII character, those characters, and the
    text of all others that hold more or lie beyond the basic plane."""
    one, plain, more = [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        kept = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode() if not 0xD800 <= code < 0xE000 else ""
        if len(kept) == 1 and code < 0x10000:
            one.append(chr(code))
            plain.append(kept)
        elif kept:
            more[chr(code)] = kept
    return "".join(one), "".join(plain), more


def to_ascii(text: Column) -> Column:
    """The ASCII characters of the text's compatibility decomposition (accents dropped, ligatures spelled out, the rest deleted)."""
    one, plain, more = _decompositions()
    simple = F.translate(text, one, plain)
    table = F.from_json(F.lit(json.dumps(more)), "map<string,string>")  # one literal, folded before the query runs
    spelled = F.array_join(F.transform(F.split(simple, ""), lambda c: F.when(c.rlike(r"[^\x00-\x7F]"), F.coalesce(F.try_element_at(table, c), F.lit(""))).otherwise(c)), "")
    return F.when(simple.rlike(r"[^\x00-\x7F]"), spelled).otherwise(simple)


def slugify(text: Column) -> Column:
    """ASCII form, lower case, only a-z 0-9 white space and hyphen, white space trimmed at the ends and else made single hyphens.

    Null stays null; a title with nothing left gives ``''``.
    """
    kept = F.regexp_replace(F.lower(to_ascii(text)), r"[^a-z0-9\s-]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"^\s+|\s+$", ""), r"\s+", "-")


def year_of(date_text: Column) -> Column:
    """First four characters of a date text, ``''`` where absent."""
    return F.coalesce(F.substring(date_text, 1, 4), F.lit(""))


def safe_year(year_text: Column) -> Column:
    """An all-digits year as an integer, else null (never an error under ANSI)."""
    return F.when(year_text.rlike("^[0-9]+$"), year_text.try_cast("int"))


def snippet(text: Column, terms: Iterable[str], before: int = 60, after: int = 140, default: int = 200) -> Column:
    """A window of ``text`` around the first of ``terms``, in their order, that occurs in the lower-cased text.

    Without a hit the first ``default`` characters. The closing dots are always there. Absent text gives ``'...'``.
    """
    body = F.coalesce(text, F.lit(""))
    position = F.lit(0)
    for term in reversed(list(terms)):
        here = F.instr(F.lower(body), term)
        position = F.when(here > 0, here).otherwise(position)
    start = F.greatest(F.lit(1), position - F.lit(before))
    length = F.least(F.length(body), position - 1 + F.lit(after)) - (start - 1)
    window = F.concat(F.lit("..."), F.substring(body, start, length), F.lit("..."))
    return F.when(position > 0, window).otherwise(F.concat(F.substring(body, 1, default), F.lit("...")))
