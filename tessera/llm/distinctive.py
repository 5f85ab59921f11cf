"""How characteristic a term is of a record: divergence from randomness.

The information content of a term is that of its length-normalised frequency under a geometric model of the
collection; the gain is Laplace's law of succession. Terms are counted within a record in one pass over its text, so
only (term, partial counts) are shuffled for the collection's figures.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.lineage import cut
from tessera.skew import hot_keys, salted_lookup

WORD = re.compile("[a-z0-9]{3,}")
HELD_TERMS = 300_000
ROWS_PER_TASK = 1_000_000
OUT_ROWS = 50_000
_PARTIAL = pa.schema([("term", pa.string()), ("df", pa.int64()), ("cf", pa.int64())])
_TERMS = pa.schema([("doc_id", pa.int64()), ("n_terms", pa.int64()), ("term", pa.string()), ("tf", pa.int64())])


def terms(text: str | None) -> list[str]:
    """Longest runs of a-z and 0-9 in the lower-cased text with at least three characters."""
    return WORD.findall(text.lower()) if text else []


def partial_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, rows, occurrences, combined over the task; the row without a term has the records and their whole length."""
    df: Counter[str] = Counter()
    cf: Counter[str] = Counter()
    docs = length = 0

    def flush() -> pa.RecordBatch:
        keys = list(df)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([df[k] for k in keys], pa.int64()), pa.array([cf[k] for k in keys], pa.int64())], schema=_PARTIAL)

    for batch in batches:
        for text in batch.column(0).to_pylist():
            words = terms(text)
            if not words:
                continue
            docs += 1
            length += len(words)
            counts = Counter(words)
            df.update(counts.keys())
            cf.update(counts)
            if len(df) > HELD_TERMS:
                yield flush()
                df.clear()
                cf.clear()
    if df:
        yield flush()
    yield pa.RecordBatch.from_pylist([{"term": None, "df": docs, "cf": length}], schema=_PARTIAL)


def _record_terms(min_tf: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        sizes: list[int] = []
        words: list[str] = []
        tfs: list[int] = []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(words, pa.string()), pa.array(tfs, pa.int64())], schema=_TERMS)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = terms(text)
                for term, tf in Counter(found).items():
                    if tf >= min_tf:
                        ids.append(key)
                        sizes.append(len(found))
                        words.append(term)
                        tfs.append(tf)
                if len(ids) >= OUT_ROWS:
                    yield flush()
                    ids, sizes, words, tfs = [], [], [], []
        if ids:
            yield flush()

    return count


def score_expression(tf: Column, length: Column, mean_length: Column, cf: Column, n_docs: Column) -> Column:
    """Geometric information content times Laplace gain; frequencies in bits."""
    tfn = tf * F.log2(1.0 + mean_length / length)
    lam = cf / n_docs
    information = F.log2(1.0 + lam) + tfn * F.log2((1.0 + lam) / lam)
    return information / (tfn + 1.0)


def distinctive_terms(docs: DataFrame, doc_id: str = "doc_id", text: str = "rich_text", min_tf: int = 1, min_df: int = 1, max_df: int | None = None) -> DataFrame:
    """doc_id, term, tf, df, cf, score for every term of every record, or those within the limits on tf and df.

    Null and empty texts, and texts without a term, give no rows and do not count as records of the collection. A limit only
    leaves rows out; scores come from the whole collection. Rows with one doc_id twice are scored as two records. The join
    spreads terms found in more than a million records over several tasks.
    """
    body = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("body"))
    partial = body.select("body").mapInArrow(partial_statistics, "term string, df bigint, cf bigint")
    summed = partial.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    in_range = F.col("df") >= min_df
    if max_df is not None:
        in_range &= F.col("df") <= max_df
    statistics = cut(summed.where(F.col("term").isNull() | (in_range & (F.col("cf") >= min_tf))))
    whole = statistics.where(F.col("term").isNull()).head()  # one row: records with terms, and their whole length
    n_docs, length = (whole["df"], whole["cf"]) if whole else (0, 0)
    known = statistics.where(F.col("term").isNotNull())
    mine = body.mapInArrow(_record_terms(min_tf), "doc_id bigint, n_terms bigint, term string, tf bigint")
    joined = salted_lookup(mine, known, "term", hot_keys(known, "term", F.col("df"), ROWS_PER_TASK), F.col("doc_id"))
    score = score_expression(F.col("tf").cast("double"), F.col("n_terms").cast("double"), F.lit(length / max(n_docs, 1)), F.col("cf").cast("double"), F.lit(float(max(n_docs, 1))))
    return joined.select("doc_id", "term", "tf", "df", "cf", score.alias("score"))
