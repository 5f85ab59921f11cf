"""Building the index once and reading it many times.

Postings and weights are written range-partitioned and sorted by term, so a query's ``term IN (...)`` skips row groups, and no
query tokenises a text again.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tessera.functions.stem import stem_postings
from tessera.operators.index import term_frequencies
from tessera.operators.weights import tfidf_weights
from tessera.sources.store import POSTINGS, WEIGHTS, write_by_term


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    weights: DataFrame


def build_index(docs: DataFrame, path: str, text: str = "rich_text", stop_words: Iterable[str] = (), language: str | None = None) -> Index:
    """Write ``path/postings`` and ``path/weights`` from the documents, and open them; with a ``language``, of stems.

    Range partitioning reads its input twice (once for a sample), so the counts are written as they come first: texts are
    tokenised once.
    """
    read = docs.sparkSession.read
    term_frequencies(docs, text, stop_words=stop_words).write.mode("overwrite").parquet(f"{path}/counts")
    counts = read.schema(POSTINGS).parquet(f"{path}/counts")
    write_by_term(counts if language is None else stem_postings(counts, language), f"{path}/postings")
    write_by_term(tfidf_weights(read.schema(POSTINGS).parquet(f"{path}/postings")), f"{path}/weights")
    return open_index(docs, path)


def open_index(docs: DataFrame, path: str) -> Index:
    read = docs.sparkSession.read
    return Index(read.schema(POSTINGS).parquet(f"{path}/postings"), read.schema(WEIGHTS).parquet(f"{path}/weights"))
