"""Stored state: documents as one JSON collection (for exchange) or Parquet, the index tables, and progress state.

Missing files read as empty tables where that is the defined behaviour of the state; corrupt state starts empty.
"""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

METADATA = (
    "struct<director string, cast array<string>, genres array<string>, budget bigint, revenue bigint, vote_average double, vote_count bigint,"
    " original_language string, imdb_id string, tmdb_id bigint, source_url string, tagline string, runtime bigint, original_title string>"
)
DOCUMENT = f"struct<title string, year string, metadata {METADATA}, rich_text string, reviews_count bigint>"
POSTINGS = "term string, doc_id bigint, tf bigint"
WEIGHTS = "term string, doc_id bigint, w double"
VECTORS = "doc_id bigint, embedding array<float>"


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one if there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a JSON file ``{_meta, documents: {id: document}}``, one row each; a missing file gives none."""
    schema = f"documents map<string, {DOCUMENT}>"
    try:
        raw = spark.read.schema(schema).option("multiLine", "true").json(path)
    except AnalysisException:
        raw = spark.createDataFrame([], schema)
    return raw.select(F.explode("documents").alias("id", "doc")).select(F.col("id").cast("bigint").alias("doc_id"), "doc.*")


def write_documents(docs: DataFrame, path: str) -> None:
    """The documents as Parquet under ``path/documents``, and one row about them (version, total, time) under ``path/meta``."""
    docs.write.mode("overwrite").parquet(f"{path}/documents")
    stored = docs.sparkSession.read.schema(docs.schema).parquet(f"{path}/documents")
    about = stored.agg(F.lit("2.0").alias("version"), F.count(F.lit(1)).alias("total_docs"), F.current_timestamp().alias("last_updated"))
    about.write.mode("overwrite").parquet(f"{path}/meta")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/documents")


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, f"{path}/meta", "version string, total_docs bigint, last_updated timestamp")


def document_by_id(docs: DataFrame, doc_id: int) -> DataFrame:
    """The document with one id, or no row. The id is a literal that the scan sees."""
    return docs.where(F.col("doc_id") == doc_id).limit(1)


def write_by_term(table: DataFrame, path: str) -> None:
    """Postings or weights, range-partitioned and sorted by term, so row-group statistics serve term filters.

    Documents are part of the range, so a term that is in most documents lies in several partitions.
    """
    table.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.select("doc_id", F.col("embedding").cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, embedding; no table gives no rows."""
    return read_or_empty(spark, path, VECTORS)


def key_states(events: DataFrame, key: str, done: str) -> DataFrame:
    """key, done, failed from (key, status, at) events, null keys left out.

    A key once done stays done; it is failed while its last event is another one; a key may be both. Partial aggregation keeps
    one row a key and task, whatever the number of its events.
    """
    is_done = F.col("status") == done
    return events.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(is_done).alias("done"), F.max_by(~is_done, "at").alias("failed"))


def progress(events: DataFrame, key: str, done: str) -> DataFrame:
    """One row total, done, failed of :func:`key_states`."""
    return key_states(events, key, done).agg(F.count(F.lit(1)).alias("total"), F.count_if("done").alias("done"), F.count_if("failed").alias("failed"))


def write_states(states: DataFrame, path: str, key: str) -> None:
    """The states sorted by key, in ranges; a folder of their own, so that a run that breaks leaves the former ones."""
    states.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def read_states(spark: SparkSession, path: str, key: str, kind: str = "bigint") -> DataFrame:
    """Stored states; none where nothing is stored."""
    return read_or_empty(spark, path, f"{key} {kind}, done boolean, failed boolean")


def reset_states(spark: SparkSession, path: str, key: str, kind: str = "bigint") -> None:
    spark.createDataFrame([], f"{key} {kind}, done boolean, failed boolean").write.mode("overwrite").parquet(path)


class ProgressFile:
    """Small resumable state of one driver as one JSON text file: cursors, counters, short id lists, which are kept sorted.

    A corrupt file starts empty. A save replaces the file at once, so a crash leaves the former state. States of many keys
    belong into a table (:func:`write_states`).
    """

    def __init__(self, path: str) -> None:
        self.path = path
        try:
            with open(path, encoding="utf-8") as f:
                self.state = dict(json.load(f))
        except (OSError, ValueError, TypeError):
            self.state = {}

    def save(self, **values: object) -> None:
        ordered = {k: sorted(v) if isinstance(v, (set, list, tuple)) else v for k, v in values.items()}
        self.state |= ordered | {"last_updated": datetime.now(UTC).isoformat()}
        with open(f"{self.path}.new", "w", encoding="utf-8") as f:
            json.dump(self.state, f, sort_keys=True)
        os.replace(f"{self.path}.new", self.path)

    def reset(self) -> None:
        self.state = {}
        if os.path.exists(self.path):
            os.remove(self.path)
