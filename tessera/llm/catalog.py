"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import abuse, cooccur, distinctive, encoding, language, leaks, packing, rankfusion, residue, truncation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


KINDS = {"cast": "metadata.cast", "genre": "metadata.genres"}

_ITEMS = r"""
arr AS (SELECT doc_id, 'cast' AS kind, metadata."cast" AS a FROM documents UNION ALL SELECT doc_id, 'genre', metadata.genres FROM documents),
items AS (SELECT DISTINCT doc_id, kind, item FROM (SELECT doc_id, kind, trim(regexp_replace(lower(x), '\s+', ' ', 'g')) AS item FROM (SELECT doc_id, kind, unnest(a) AS x FROM arr)) WHERE item <> ''),
n1 AS (SELECT kind, item, count(*) AS n FROM items GROUP BY ALL),
prs AS (SELECT x.kind, x.item AS item_a, y.item AS item_b, count(*) AS n_ab FROM items x JOIN items y ON x.doc_id = y.doc_id AND x.kind = y.kind AND x.item < y.item GROUP BY ALL),
scored AS (SELECT p.kind, item_a, item_b, n_ab, a.n AS n_a, b.n AS n_b, (SELECT count(*) FROM documents) AS n_rows FROM prs p JOIN n1 a ON a.kind = p.kind AND a.item = item_a JOIN n1 b ON b.kind = p.kind AND b.item = item_b)
"""


@query("p1_found", f"WITH {_ITEMS} SELECT kind, item_a, item_b FROM scored WHERE n_ab >= 4 AND n_ab * n_rows >= CASE kind WHEN 'cast' THEN 6 ELSE 2 END * n_a * n_b")
def _(spark, d):
    pairs = cooccur.cooccurrence(table(spark, d, "documents"), "doc_id", KINDS, min_count=4)
    factor = F.when(F.col("kind") == "cast", F.lit(6)).otherwise(F.lit(2))
    return pairs.where(cooccur.exceeds(F.col("n_ab"), F.col("n_a"), F.col("n_b"), F.col("n_rows"), factor)).select("kind", "item_a", "item_b")


@query(
    "p1_pairs",
    f"""WITH {_ITEMS} SELECT kind, item_a, item_b, n_ab, round(n_ab::double * n_rows / (n_a::double * n_b), 6) AS lift,
  round((n_ab + 0.5::double) * (n_rows - n_a - n_b + n_ab + 0.5::double) / ((n_a - n_ab + 0.5::double) * (n_b - n_ab + 0.5::double)), 4) AS odds_ratio FROM scored""",
)
def _(spark, d):
    pairs = cooccur.cooccurrence(table(spark, d, "documents"), "doc_id", KINDS)
    return pairs.select("kind", "item_a", "item_b", "n_ab", F.round("lift", 6).alias("lift"), F.round("odds_ratio", 4).alias("odds_ratio"))


_TERMS = r"""
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(rich_text), '[a-z0-9]{3,}')) AS term FROM documents WHERE rich_text IS NOT NULL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
st AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term),
dl AS (SELECT doc_id, count(*)::double AS n FROM tok GROUP BY doc_id),
tot AS (SELECT count(*)::double AS n_docs, avg(n) AS mean FROM dl)
"""


@query("p2_found", f"WITH {_TERMS} SELECT doc_id, term FROM tf JOIN st USING (term) WHERE tf >= 4 AND df BETWEEN 2 AND 10")
def _(spark, d):
    return distinctive.distinctive_terms(table(spark, d, "documents"), min_tf=4, min_df=2, max_df=10).select("doc_id", "term")


@query(
    "p2_scores",
    f"""WITH {_TERMS}, s AS (SELECT doc_id, term, tf * log2(1 + mean / n) AS tfn, cf / n_docs AS lam FROM tf JOIN st USING (term) JOIN dl USING (doc_id), tot)
SELECT doc_id, term, round((log2(1 + lam) + tfn * log2((1 + lam) / lam)) / (tfn + 1), 6) AS score FROM s""",
)
def _(spark, d):
    return distinctive.distinctive_terms(table(spark, d, "documents")).select("doc_id", "term", F.round("score", 6).alias("score"))


@query(
    "p6_ranking",
    """WITH kept AS (SELECT request_id, doc_id, CASE WHEN isfinite(ebm_score) THEN ebm_score END AS a, CASE WHEN isfinite(vector_score) THEN vector_score END AS b, CASE WHEN isfinite(score) THEN score END AS c, served_at FROM search_result WHERE request_id IS NOT NULL AND doc_id IS NOT NULL),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, doc_id ORDER BY served_at DESC NULLS LAST, a DESC NULLS LAST, b DESC NULLS LAST, c DESC NULLS LAST) AS rn FROM kept) WHERE rn = 1),
ra AS (SELECT request_id, doc_id, rank() OVER (PARTITION BY request_id ORDER BY a DESC) AS r FROM once WHERE a IS NOT NULL),
rb AS (SELECT request_id, doc_id, rank() OVER (PARTITION BY request_id ORDER BY b DESC) AS r FROM once WHERE b IS NOT NULL),
rc AS (SELECT request_id, doc_id, rank() OVER (PARTITION BY request_id ORDER BY c DESC) AS r FROM once WHERE c IS NOT NULL),
f AS (SELECT o.request_id, o.doc_id, round(coalesce(1.0::double / (60 + ra.r), 0) + coalesce(1.0::double / (60 + rb.r), 0) + coalesce(1.0::double / (60 + rc.r), 0), 12) AS fused
  FROM once o LEFT JOIN ra USING (request_id, doc_id) LEFT JOIN rb USING (request_id, doc_id) LEFT JOIN rc USING (request_id, doc_id))
SELECT request_id, doc_id, round(fused, 9) AS fused, row_number() OVER (PARTITION BY request_id ORDER BY fused DESC, doc_id) AS position FROM f""",
)
def _(spark, d):
    ranked = rankfusion.fuse(table(spark, d, "search_result"), "request_id", "doc_id", ["ebm_score", "vector_score", "score"], latest="served_at")
    return ranked.select("request_id", "doc_id", F.round("fused", 9).alias("fused"), "position")


@query("p8_packing")
def _(spark, d):
    return packing.pack(table(spark, d, "documents"), table(spark, d, "container_spec"))


@query("p8_utilisation")
def _(spark, d):
    specs = table(spark, d, "container_spec")
    return packing.utilisation(packing.pack(table(spark, d, "documents"), specs), specs)


@query(
    "p9_found",
    r"""WITH w AS (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '[^a-z0-9 ]', '', 'g'), ' '), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, list_filter(string_split(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '[^a-z0-9 ]', '', 'g'), ' '), lambda x: x <> '') AS w FROM eval_item),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS i FROM w WHERE len(w) >= 10)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS i FROM iw WHERE len(w) >= 10))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
)
def _(spark, d):
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_item"), min_words=10).select("doc_id", "item_id")


@query("p9_cleaned")
def _(spark, d):
    cleaned = leaks.without_leaks(table(spark, d, "documents"), table(spark, d, "eval_item"), min_words=10)
    return cleaned.where(F.col("removed") > 0).select("doc_id", "removed", "text")


def readable(spark: SparkSession, d: str, found: DataFrame) -> DataFrame:
    """``found`` without the rows that are residue."""
    bad = residue.find_residue(table(spark, d, "documents")).select("doc_id").distinct()
    return found.join(bad, "doc_id", "left_anti")


@query("p4_found")
def _(spark, d):
    has_text = F.length(F.trim("text")) > 0  # rows without text hold nothing that could be cut off
    return readable(spark, d, truncation.find_truncated(table(spark, d, "documents"), cases=has_text).select("doc_id"))


@query("p4_rates")
def _(spark, d):
    found = QUERIES["p4_found"](spark, d)
    return truncation.rates(table(spark, d, "documents"), found)


@query("p5_found")
def _(spark, d):
    return residue.find_residue(table(spark, d, "documents")).select("doc_id").distinct()


@query("p5_reasons")
def _(spark, d):
    return residue.find_residue(table(spark, d, "documents")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("p10_found")
def _(spark, d):
    return encoding.repair(table(spark, d, "documents"), table(spark, d, "lang_sample")).select("doc_id").distinct()


@query("p10_restored")
def _(spark, d):
    return encoding.repair(table(spark, d, "documents"), table(spark, d, "lang_sample")).select("doc_id", "chain", "places", "lost", "restored")


@query("p3_found")
def _(spark, d):
    found = language.relabel(table(spark, d, "documents"), table(spark, d, "lang_sample"))
    return readable(spark, d, found.select("doc_id", "lang"))


@query("p3_stretches")
def _(spark, d):
    return language.identify(table(spark, d, "documents"), table(spark, d, "lang_sample"))


def tagged(spark: SparkSession, d: str) -> DataFrame:
    return abuse.tag(table(spark, d, "documents"), table(spark, d, "abuse_sample"), table(spark, d, "lang_sample"))


@query("p7_found")
def _(spark, d):
    return tagged(spark, d).where(F.col("score") >= abuse.THRESHOLD).select("doc_id").distinct()


@query("p7_scores")
def _(spark, d):
    return tagged(spark, d).select("doc_id", "score", "sentences", F.to_json("spans").alias("spans"))


@query("p7_rates")
def _(spark, d):
    return abuse.rates(table(spark, d, "documents"), tagged(spark, d))
