"""Normalised TF-IDF weights of postings, and of asked terms straight from the texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.lineage import cut
from tessera.operators.index import collection_size, document_frequency, max_term_frequency, term_frequencies
from tessera.skew import hot_keys, salted_lookup

#: idf of a term that is in every document, or of any term when there is one document: fixed value.
FLOOR_IDF = 0.0001
ROWS_PER_TASK = 1_000_000
#: Asked terms that every task of :func:`weights_of_terms` holds; of more, all weights are made and joined with them.
MAX_ASKED = 200_000
_COUNTED = pa.schema([("doc_id", pa.int64()), ("max_tf", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])


def idf_expression(n_docs: Column, df: Column) -> Column:
    """ln(N/n)/ln(N), or the floor if N is 1 or the term is everywhere (tested before dividing)."""
    n, d = n_docs.cast("double"), df.cast("double")
    return F.when((n > 1) & (d < n), F.ln(n / d) / F.ln(n)).otherwise(F.lit(FLOOR_IDF))


def inverse_document_frequency(postings: DataFrame) -> DataFrame:
    """term, df, idf. The collection size is a scalar subquery, so nothing is joined for it."""
    return document_frequency(postings).select("term", "df", idf_expression(collection_size(postings).scalar(), F.col("df")).alias("idf"))


def tfidf_weights(postings: DataFrame, digits: int = 5) -> DataFrame:
    """term, doc_id, w = round(tf / max tf of the document * idf, digits). Weights of 0 after rounding stay.

    A term found in most documents is spread over several tasks (:mod:`tessera.skew`); documents hold few rows each.
    """
    idf = inverse_document_frequency(postings)
    hot = hot_keys(idf, "term", F.col("df"), ROWS_PER_TASK)
    with_idf = salted_lookup(postings, idf.select("term", "idf"), "term", hot, F.col("doc_id"))
    joined = with_idf.join(max_term_frequency(postings), "doc_id")
    return joined.select("term", "doc_id", F.round(F.col("tf") / F.col("max_tf") * F.col("idf"), digits).alias("w"))


def _counted(asked: pa.Array, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document with tokens its max_tf, and number and tf of its asked terms; rows of one doc_id must follow each other."""

    def count(ids: pa.Array, number: np.ndarray, words: pa.Array) -> pa.RecordBatch:
        coded = words.flatten().dictionary_encode()
        size = max(1, len(coded.dictionary))
        rows = np.repeat(number, pc.list_value_length(words).to_numpy(zero_copy_only=False))
        pairs, tf = np.unique(rows * size + coded.indices.to_numpy(), return_counts=True)
        docs, starts = np.unique(pairs // size, return_index=True)
        found = pc.fill_null(pc.index_in(coded.dictionary, asked), -1).to_numpy()[pairs % size] if len(pairs) else np.zeros(0, np.int32)
        kept = np.concatenate([[0], np.cumsum(found >= 0)])[np.append(starts, len(pairs))].astype(np.int32)
        first = np.searchsorted(number, docs)
        columns = [ids.take(pa.array(first)), pa.array(np.maximum.reduceat(tf, starts) if len(starts) else tf, pa.int64())]
        columns += [pa.ListArray.from_arrays(pa.array(kept), pa.array(x[found >= 0].astype(np.int32))) for x in (found, tf)]
        return pa.RecordBatch.from_arrays(columns, schema=_COUNTED)

    open_rows: list[pa.RecordBatch] = []  # of the last document so far, which the next batch may go on with
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = pc.fill_null(batch.column(0), -1).to_numpy()
        nulls = batch.column(0).is_null().to_numpy(zero_copy_only=False)
        changes = np.flatnonzero((ids[1:] != ids[:-1]) | (nulls[1:] != nulls[:-1])) + 1
        if open_rows and batch.column(0)[0].as_py() != open_rows[0].column(0)[0].as_py():
            changes = np.concatenate([[0], changes])
        if not len(changes):
            open_rows.append(batch)
            continue
        ended = pa.Table.from_batches([*open_rows, batch.slice(0, changes[-1])]).combine_chunks()
        held = ended.num_rows - changes[-1]
        number = np.zeros(ended.num_rows, np.int64)
        number[[held + c for c in changes[:-1] if held + c > 0]] = 1
        yield count(ended.column(0).combine_chunks(), np.cumsum(number), ended.column(1).combine_chunks())
        open_rows = [batch.slice(changes[-1])]
    if open_rows:
        ended = pa.Table.from_batches(open_rows).combine_chunks()
        yield count(ended.column(0).combine_chunks(), np.zeros(ended.num_rows, np.int64), ended.column(1).combine_chunks())


def weights_of_terms(docs: DataFrame, terms: DataFrame, text: str = "rich_text", doc_id: str = "doc_id", digits: int = 5) -> DataFrame:
    """The rows of :func:`tfidf_weights` over all documents whose term is in ``terms`` (a column term), without an index.

    Only the texts are shuffled, by document; of the counts only those of asked terms leave a task. Rows without doc_id count
    for the document frequency alone.
    """
    asked = terms.select("term").where(F.col("term").isNotNull()).distinct()
    words = [r["term"] for r in asked.orderBy("term").limit(MAX_ASKED + 1).collect()]
    if len(words) > MAX_ASKED:
        return tfidf_weights(term_frequencies(docs, text, doc_id), digits).join(asked, "term", "left_semi")
    shared = docs.sparkSession.sparkContext.broadcast(words)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("body")).where(F.col("body").isNotNull())
    together = rows.repartition("doc_id").sortWithinPartitions("doc_id").select("doc_id", tokens("body").alias("words"))
    counted = cut(together.mapInArrow(lambda b: _counted(pa.array(shared.value, pa.string()), b), "doc_id bigint, max_tf bigint, terms array<int>, tfs array<int>"))
    names = docs.sparkSession.createDataFrame(list(enumerate(words)), "number int, term string")
    n_docs = counted.agg(F.greatest(F.lit(1), F.count("doc_id")).cast("bigint").alias("n_docs"))
    hits = counted.select("doc_id", "max_tf", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("doc_id", "max_tf", F.col("x.terms").alias("number"), F.col("x.tfs").alias("tf"))
    df = hits.groupBy("number").agg(F.count(F.lit(1)).alias("df"))
    idf = df.join(names, "number").select("number", "term", idf_expression(n_docs.scalar(), F.col("df")).alias("idf"))  # at most MAX_ASKED rows
    return hits.where(F.col("doc_id").isNotNull()).join(F.broadcast(idf), "number").select("term", "doc_id", F.round(F.col("tf") / F.col("max_tf") * F.col("idf"), digits).alias("w"))
