"""The inverted index as a long table ``postings(term, doc_id, tf)``.

Defined results: null or empty text gives no posting; repeated (doc_id, text) rows add up; an empty table gives an
empty table; other columns of the input are dropped first, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import query_tokens, tokens


def term_frequencies(docs: DataFrame, text: str = "rich_text", doc_id: str = "doc_id", stop_words: Iterable[str] = ()) -> DataFrame:
    """term, doc_id, tf. Counts are combined on the map side, before the one shuffle on (term, doc_id)."""
    exploded = docs.select(F.col(doc_id).alias("doc_id"), F.explode(tokens(F.col(text), stop_words)).alias("term"))
    return exploded.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def with_checked_ids(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The same rows; reading one whose id is null or negative is an error."""
    c = F.col(doc_id)
    return docs.withColumn(doc_id, F.when(c >= 0, c).otherwise(F.raise_error(F.concat(F.lit("not a document id: "), F.coalesce(c.cast("string"), F.lit("null")))).cast("bigint")))


def document_frequency(postings: DataFrame) -> DataFrame:
    """term, df."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def max_term_frequency(postings: DataFrame) -> DataFrame:
    """doc_id, max_tf."""
    return postings.groupBy("doc_id").agg(F.max("tf").alias("max_tf"))


def collection_size(postings: DataFrame) -> DataFrame:
    """One row n_docs: documents with at least one token, at least 1."""
    per_doc = postings.groupBy("doc_id").agg(F.lit(1).alias("one"))
    return per_doc.agg(F.greatest(F.lit(1), F.count(F.lit(1))).cast("bigint").alias("n_docs"))


def index_size(postings: DataFrame, target: int = 10_000) -> DataFrame:
    """One row: documents with tokens, vocabulary, and how far the vocabulary is short of ``target``."""
    docs = postings.agg(F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("term").alias("n_terms"))
    return docs.select("n_docs", "n_terms", F.greatest(F.lit(0), F.lit(target) - F.col("n_terms")).cast("bigint").alias("shortfall"))


def posting_lists(postings: DataFrame, block: int = 4096) -> DataFrame:
    """term, block and the postings ``doc:tf`` of that block of doc_ids, by doc_id, as one string, for all terms.

    A term's list is divided by doc_id, so that no row grows with the collection: concatenated in the order of their blocks
    the strings are the whole list.
    """
    keyed = postings.groupBy("term", F.floor(F.col("doc_id") / F.lit(block)).alias("block"))
    lists = keyed.agg(F.sort_array(F.collect_list(F.struct("doc_id", "tf"))).alias("p"))
    return lists.select("term", "block", F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["doc_id"].cast("string"), x["tf"].cast("string"))), ",").alias("postings"))


def top_terms(postings: DataFrame, k: int = 20) -> DataFrame:
    """The k terms of the highest collection frequency, ties by term."""
    return postings.groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df")).orderBy(F.desc("cf"), "term").limit(k)


def vocabulary(postings: DataFrame, k: int) -> DataFrame:
    """The first k terms in code-point order."""
    return postings.select("term").distinct().orderBy("term").limit(k)


def lookup_term(postings: DataFrame, docs: DataFrame, term: str, k: int = 10) -> DataFrame:
    """The k documents with the highest tf of one term (ties by doc_id) with title and year, ``?`` where unknown.

    Of several words the first token is looked up; a text without a token finds nothing. The token is a literal, so the filter
    reaches a Parquet scan of stored postings.
    """
    first = query_tokens(term)[:1]
    top = postings.where(F.col("term").isin(list(first))).orderBy(F.desc("tf"), "doc_id").limit(k)
    names = docs.select("doc_id", "title", "year")
    return top.join(names, "doc_id", "left").select("doc_id", "tf", F.coalesce("title", F.lit("?")).alias("title"), F.coalesce("year", F.lit("?")).alias("year"))


def lookup_terms(postings: DataFrame, docs: DataFrame, words: Iterable[str], k: int = 10) -> DataFrame:
    """term, place, doc_id, tf, title, year: what :func:`lookup_term` gives for each of several words, and n_docs of the term.

    The words are literals, so they bound the result; the best of a term are cut in each task before they are shuffled.
    """
    terms = list(dict.fromkeys(t for w in words for t in query_tokens(w)[:1]))
    asked = postings.where(F.col("term").isin(terms))
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("tf"), "doc_id"))
    top = asked.withColumn("place", place).where(F.col("place") <= k).join(F.broadcast(document_frequency(asked)), "term")
    named = top.join(docs.select("doc_id", "title", "year"), "doc_id", "left")
    return named.select("term", "place", "doc_id", "tf", F.col("df").alias("n_docs"), F.coalesce("title", F.lit("?")).alias("title"), F.coalesce("year", F.lit("?")).alias("year"))


def upsert_postings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Postings after documents are added again: tf of the new text where a pair is new, stale pairs stay."""
    n = new.select("term", "doc_id", F.col("tf").alias("new_tf"))
    return old.join(n, ["term", "doc_id"], "full_outer").select("term", "doc_id", F.coalesce("new_tf", "tf").alias("tf"))


def replace_postings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Postings after a rebuild of the documents in ``new``: nothing of their old text stays."""
    return old.join(new.select("doc_id").distinct(), "doc_id", "left_anti").select("term", "doc_id", "tf").unionByName(new.select("term", "doc_id", "tf"))
