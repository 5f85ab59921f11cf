"""Bounded samples of labelled rows, for fitting models on the driver, and cutting texts into sentences."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many documents of each label are used for fitting, whatever the size of the corpus.
ROWS_PER_LABEL = 150
#: At most so many characters of each of them.
CHARS_PER_ROW = 4000
#: At most so many clean snippets.
MAX_SNIPPETS = 20_000

_END = re.compile(r"(?:(?<![.!?…])[.!?…]++[\"”’»)\]]*+(?:\s*+(?::\)|:\(|[\U0001F300-\U0001FAFF]))?(?=\s)|\n)\s*|(?<=\S)\s*(?:\[(?:\.\.\.|…)\])")


#: Hashes let through are this many times as many as wanted, so that enough are left whatever the luck of the draw.
MARGIN = 1.5


def _below(h: Column, rows: int, total: int) -> Column:
    """Does a hash lie in the lowest part of its range, where about MARGIN * rows of ``total`` rows lie? All of few rows do."""
    share = 1.0 if total <= 4 * rows else MARGIN * rows / total
    return F.lit(True) if share >= 1 else h < F.lit(int(-(2**63) + share * 2**64))


def labelled_sample(docs: DataFrame, labels: list[str], label: str = "lang", text: str = "text", key: str = "doc_id", rows: int = ROWS_PER_LABEL) -> list[tuple[str, str]]:
    """(label, text) of at most ``rows`` rows of each label: those with the smallest hash of the key.

    Fewer than the bound are taken where fewer exist; the same rows are taken however the table is divided. The labels are
    counted first (one narrow column), so that one scan of the texts lets through little more than what is wanted. The texts are
    cut to a bounded length here only because they serve for fitting; nothing that is reported rests on a part of a text.
    """
    known = docs.where(F.col(label).isin(labels) & (F.length(text) > 0))
    counts = {r[0]: r[1] for r in docs.where(F.col(label).isin(labels)).groupBy(label).count().collect()}
    h = F.xxhash64(F.col(key))
    wanted = F.lit(False)
    for v, n in sorted(counts.items()):
        wanted = wanted | ((F.col(label) == v) & _below(h, rows, n))
    firsts = known.where(wanted).select(F.col(label).alias("l"), F.substring(text, 1, CHARS_PER_ROW).alias("t"), h.alias("h"))
    taken: dict[str, list[str]] = {}
    for r in firsts.orderBy("h", "t").limit(4 * rows * max(1, len(counts))).collect():
        if len(mine := taken.setdefault(r["l"], [])) < rows:
            mine.append(r["t"])
    return sorted((v, t) for v, texts in taken.items() for t in texts)


def hashed_texts(docs: DataFrame, key: str, text: str, rows: int, total: int, chars: int) -> list[str]:
    """The beginnings of at most ``rows`` texts of ``total``, those with the smallest hash of the key, whatever their labels."""
    h = F.xxhash64(F.col(key))
    kept = docs.where((F.length(text) > 0) & _below(h, rows, total)).select(h.alias("h"), F.substring(text, 1, chars).alias("t"))
    return [r["t"] for r in kept.orderBy("h", "t").limit(rows).collect()]


def snippets(samples: DataFrame, label: str = "lang", text: str = "text") -> list[tuple[str, str]]:
    """(label, text) of a small table of clean snippets; of more than MAX_SNIPPETS rows the first by label and text."""
    known = samples.where(F.col(label).isNotNull() & (F.length(text) > 0)).select(label, F.substring(text, 1, CHARS_PER_ROW).alias("t"))
    return [(r[0], r[1]) for r in known.orderBy(label, "t").limit(MAX_SNIPPETS).collect()]


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """[start, end) of the sentences of a text: to the closing marks before white space, to a line break, or to the end."""
    spans = []
    start = 0
    for m in _END.finditer(text):
        if text[start : m.end()].strip():
            spans.append((start, m.end()))
        start = m.end()
    if text[start:].strip():
        spans.append((start, len(text)))
    return spans


def sentences(text: str) -> list[str]:
    return [text[a:b].strip() for a, b in sentence_spans(text)]
