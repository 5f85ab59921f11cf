"""Exact nearest vectors: for one query vector a scan with a literal, then a partial top-k per task; for many, blocks against blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vector import clamp01, cosine, literal

#: Vectors of a block, on average: what a task holds of queries, of candidates, and (squared) of their cosines.
BLOCK_ROWS = 1024
_NEAR = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])


def top_k(vectors: DataFrame, query: Sequence[float], k: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", digits: int = 4) -> DataFrame:
    """doc_id, score: the k highest cosines, clamped to [0, 1] and rounded; ties by id.

    Rows with a null or wrongly sized vector are dropped; negative cosines become 0 and stay. The query vector is a
    literal of the plan, so nothing is joined.
    """
    length = math.sqrt(sum(float(x) ** 2 for x in query)) or 1.0
    unit = literal([float(x) / length for x in query])
    cosines = vectors.select(F.col(id_col).alias("doc_id"), cosine(F.col(vector_col), unit).alias("c"))
    scored = cosines.select("doc_id", F.round(clamp01(F.col("c")), digits).alias("score"))
    return scored.where(F.col("score").isNotNull()).orderBy(F.desc("score"), "doc_id").limit(k)


def vector_of(vectors: DataFrame, key: int, id_col: str = "vec_id", vector_col: str = "embedding") -> list[float]:
    """The stored vector with one id (a point lookup of one row); empty if there is none."""
    row = vectors.where(F.col(id_col) == key).select(vector_col).head()
    return list(row[0]) if row and row[0] is not None else []


def _nearest(k: int, digits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The k best candidates of each query of a block within one block of candidates."""

    def matrices(block: list[dict]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        sizes: dict[int, list[dict]] = {}
        for r in block:
            sizes.setdefault(len(r["e"]), []).append(r)
        found = {}
        for n, rows in sizes.items():
            m = np.array([r["e"] for r in rows], float).reshape(len(rows), n)
            length = np.sqrt((m * m).sum(axis=1, keepdims=True))
            found[n] = np.array([r["id"] for r in rows], np.int64), m / np.where(length > 0, length, 1)
        return found

    for batch in batches:
        for queries, candidates in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            others = matrices(candidates)
            for n, (ids, m) in matrices(queries).items():
                if n == 0 or n not in others:
                    continue
                keys, c = others[n]
                scores = np.round(np.clip(m @ c.T, 0, 1), digits)
                for i, row in zip(ids, scores, strict=True):
                    best = np.lexsort((keys, -row))[:k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), i)), pa.array(keys[best]), pa.array(row[best])], schema=_NEAR)


def top_k_batch(vectors: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", digits: int = 4) -> DataFrame:
    """query_id, doc_id, score: for each row of ``queries`` what :func:`top_k` gives for its vector, over all rows of ``vectors``.

    Both sides are put into blocks of bounded size and each block of queries meets each block of vectors, of which at most ``k``
    rows a query are kept; nothing is collected and no vector is left out.
    """

    def blocks(side: DataFrame, name: str) -> DataFrame:
        held = side.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("e"))
        n = max(1, -(-held.count() // BLOCK_ROWS))
        return held.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("block")).agg(F.collect_list(F.struct("id", "e")).alias(name)).select(name)

    pairs = blocks(queries, "queries").crossJoin(blocks(vectors, "candidates"))
    near = pairs.mapInArrow(lambda batches: _nearest(k, digits, batches), "query_id bigint, doc_id bigint, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return near.withColumn("place", place).where(F.col("place") <= k).drop("place")
