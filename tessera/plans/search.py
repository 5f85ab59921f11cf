"""Hybrid search: soft Boolean and dense scores fused in one plan; snippets only for the rows that are returned."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.stem import stemmer
from tessera.functions.text import first_present, query_tokens, snippet
from tessera.operators import dense, pnorm
from tessera.operators.encode import Encoder, encode_query


@dataclass(frozen=True)
class Request:
    """One search; bounds are checked when it is made."""

    tokens: tuple[str, ...]
    vector: tuple[float, ...] = ()
    top_k: int = 10
    p: float = 2.0
    ebm_weight: float = 0.6
    vector_weight: float = 0.4
    vector_k: int = 50
    words: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not 1 <= self.top_k <= 50:
            raise ValueError("top_k must be between 1 and 50")
        if self.p < 1:
            raise ValueError("p must be at least 1")
        if not (0 <= self.ebm_weight <= 1 and 0 <= self.vector_weight <= 1):
            raise ValueError("weights must lie between 0 and 1")

    @classmethod
    def of(cls, query: str, stop_words: Iterable[str] = (), language: str | None = None, encoder: Callable[[], Encoder] | None = None, **more: object) -> Request:
        """From a query text of at least one character; one of stop words alone leaves the dense side only.

        With a ``language`` the tokens are stems, for an index of stems, and snippets look for the words as they were written. An
        ``encoder`` turns the text into the query vector.
        """
        if not query:
            raise ValueError("the query must not be empty")
        words = query_tokens(query, stop_words)
        if encoder is not None:
            more["vector"] = encode_query(query, encoder)
        if language is None:
            return cls(tokens=words, **more)
        return cls(tokens=tuple(stemmer(language)(w) for w in words), words=words, **more)


def fuse(ebm: DataFrame, vector: DataFrame, request: Request) -> DataFrame:
    """doc_id, score, ebm_score, vector_score; a side without the document counts 0."""
    e = ebm.select("doc_id", F.col("score").alias("ebm_score"))
    v = vector.select("doc_id", F.col("score").alias("vector_score"))
    both = e.join(v, "doc_id", "full_outer").na.fill(0.0, ["ebm_score", "vector_score"])
    total = F.col("ebm_score") * request.ebm_weight + F.col("vector_score") * request.vector_weight
    return both.select("doc_id", F.round(total, 4).alias("score"), F.round("ebm_score", 4).alias("ebm_score"), F.round("vector_score", 4).alias("vector_score"))


def hits(weights: DataFrame, vectors: DataFrame, docs: DataFrame, request: Request, id_col: str = "vec_id") -> DataFrame:
    """All fused hits whose document exists, unsorted and without texts."""
    ebm = pnorm.score(weights, request.tokens, request.p)
    vector: Sequence[float] = request.vector
    near = dense.top_k(vectors, vector, request.vector_k, id_col) if vector else ebm.where(F.lit(False))
    return fuse(ebm, near, request).join(docs.select("doc_id"), "doc_id", "left_semi")


def search(weights: DataFrame, vectors: DataFrame, docs: DataFrame, request: Request, id_col: str = "vec_id") -> DataFrame:
    """The top_k rows with title, year and snippet, by rounded score, ties by doc_id.

    The cut comes before the join that fetches texts, so at most top_k texts are read into snippets.
    """
    top = hits(weights, vectors, docs, request, id_col).orderBy(F.desc("score"), "doc_id").limit(request.top_k)
    shown = docs.select("doc_id", "title", "year", first_present("rich_text").alias("body"))
    rows = F.broadcast(top).join(shown, "doc_id")
    return rows.select(
        "doc_id",
        F.coalesce("title", F.lit("Unknown")).alias("title"),
        F.coalesce(F.col("year").cast("string"), F.lit("N/A")).alias("year"),
        "score",
        "ebm_score",
        "vector_score",
        snippet(F.col("body"), request.words or request.tokens).alias("snippet"),
    ).orderBy(F.desc("score"), "doc_id")


def total_results(weights: DataFrame, vectors: DataFrame, docs: DataFrame, request: Request) -> DataFrame:
    """One row total_results: the hits before the cut."""
    return hits(weights, vectors, docs, request).agg(F.count(F.lit(1)).alias("total_results"))
