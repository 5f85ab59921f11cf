"""Worked numbers and edge cases of the core operators, on hand-written rows."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions.stem import stem
from tessera.functions.text import query_tokens, slugify, snippet, tokens
from tessera.functions.vector import l2_normalize, norm
from tessera.operators import dense, html, index, ingest, pnorm, weights
from tessera.plans.build import build_index
from tessera.plans.search import Request, search, total_results
from tessera.skew import hot_keys, salted_lookup
from tessera.sources import store

DOCS = "doc_id bigint, rich_text string, term string"


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], DOCS)


def as_dict(df):
    return {tuple(r[:-1]) if len(r) > 2 else r[0]: r[-1] for r in df.collect()}


def test_postings_with_nulls_repeats_and_clashing_columns(spark):
    p = index.term_frequencies(docs(spark, "A b, a!", None, "", "!!!", "тихий é çé1"))
    assert as_dict(p.select("term", "doc_id", "tf")) == {("a", 0): 2, ("b", 0): 1, ("çé1", 4): 1}
    assert index.collection_size(p).head()[0] == 2


def test_empty_table(spark):
    p = index.term_frequencies(spark.createDataFrame([], DOCS))
    assert p.count() == 0
    assert index.collection_size(p).head()[0] == 1
    assert weights.tfidf_weights(p).count() == 0


def test_idf_edges(spark):
    one = weights.inverse_document_frequency(index.term_frequencies(docs(spark, "solo")))
    assert as_dict(one.select("term", "idf")) == {"solo": 0.0001}
    two = weights.inverse_document_frequency(index.term_frequencies(docs(spark, "a b", "a")))
    got = as_dict(two.select("term", "idf"))
    assert got["a"] == 0.0001 and got["b"] == pytest.approx(1.0)


def test_worked_score(spark):
    w = spark.createDataFrame([("x", 1, 0.3)], "term string, doc_id bigint, w double")
    assert pnorm.score(w, ("x", "y"), 2.0).head()["score"] == pytest.approx(math.sqrt(0.09 / 2), abs=1e-6)
    assert pnorm.score(w, (), 2.0).count() == 0
    for op in ("OR", "AND"):
        assert pnorm.score(w, ("x", "x", "zzzz"), 1.0, op).head()["score"] == pytest.approx(0.2)
    with pytest.raises(ValueError, match="p must"):
        pnorm.score(w, ("x",), 0.5)


def test_or_grows_and_and_falls_with_p(spark):
    w = spark.createDataFrame([("x", 1, 0.3), ("y", 1, 0.8)], "term string, doc_id bigint, w double")
    ors = [pnorm.score(w, ("x", "y", "z"), p).head()["score"] for p in (1.0, 2.0, 5.0)]
    ands = [pnorm.score(w, ("x", "y", "z"), p, "AND").head()["score"] for p in (1.0, 2.0, 5.0)]
    assert ors == sorted(ors) and ands == sorted(ands, reverse=True)


def test_vectors(spark):
    v = spark.createDataFrame([(0, [3.0, 4.0]), (1, [-3.0, -4.0]), (2, None), (3, [0.0, 0.0])], "vec_id bigint, embedding array<float>")
    top = [tuple(r) for r in dense.top_k(v, [3.0, 4.0], 10).collect()]
    assert top == [(0, 1.0), (1, 0.0), (3, 0.0)]
    n = [r[0] for r in v.where("vec_id < 3").select(norm(l2_normalize(F.col("embedding")))).collect()]
    assert n[0] == pytest.approx(1.0) and n[2] is None


def test_snippet_windows(spark):
    t = spark.createDataFrame([("x" * 300 + "needle",), ("needle" + "y" * 300,), ("short",), (None,)], "t string")
    got = [r[0] for r in t.select(snippet(F.col("t"), ("absent", "needle"))).collect()]
    assert got == ["..." + "x" * 60 + "needle...", "...needle" + "y" * 134 + "...", "short...", "..."]


def test_slug(spark):
    t = spark.createDataFrame([("Wall-E: The Movie!  2",), ("Ångström Ñandú",), ("Тихий",), (None,)], "t string")
    assert [r[0] for r in t.select(slugify(F.col("t"))).collect()] == ["wall-e-the-movie-2", "angstrom-nandu", "", None]


def test_request_bounds():
    for bad in ({"top_k": 0}, {"top_k": 51}, {"p": 0.9}, {"ebm_weight": 1.1}):
        with pytest.raises(ValueError):
            Request(tokens=("a",), **bad)


def test_reviews_from_html(spark):
    good, other = "g" * 101, "o" * 2999
    page = f"<p>{'s' * 100}</p><p class='a'>{good}</p><p>{good}</p><p>{other}</p><p>{'l' * 3000}</p><p>Expand {good}</p><p>{good} Sign In</p>"
    spare = f'<div class="x c-siteReview_quote">{good[:50]}<b>{good[50:]}</b></div>'
    t = spark.createDataFrame([(page,), (spare,), (None,), ("",)], "h string")
    assert [r[0] for r in t.select(html.reviews(F.col("h"), "p")).collect()] == [[good, other], [good[:50] + " " + good[50:]], [], []]


def test_two_key_dedup(spark):
    rows = [(0, 7, "u7"), (1, 7, "u7"), (2, None, "u9"), (3, None, "u9"), (4, None, None), (5, None, None), (6, 8, None)]
    d = spark.createDataFrame(rows, "doc_id bigint, k bigint, u string")
    kept = ingest.dedup_first_wins(d, F.col("doc_id"), F.col("k"), F.col("u"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 4, 5, 6]


def test_dense_ids(spark):
    d = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("x"))
    got = ingest.dense_ids(d, ["x"]).collect()
    assert all(r["doc_id"] == r["x"] for r in got) and len(got) == 1000


def test_rich_text_skips_short_reviews_and_absent_parts(spark):
    d = spark.createDataFrame([("T", "", ["G", "H"], None, [f"c{i}" for i in range(12)], "O", ["r" * 29, "r" * 30])], "t string, g string, ge array<string>, d string, c array<string>, o string, r array<string>")
    got = d.select(ingest.rich_text(*[F.col(c) for c in d.columns])).head()[0]
    assert got == "T T G H " + " ".join(f"c{i}" for i in range(10)) + " O " + "r" * 30


def test_upsert_keeps_stale_and_replace_does_not(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 2, 1)], "term string, doc_id bigint, tf bigint")
    new = spark.createDataFrame([("a", 1, 5)], "term string, doc_id bigint, tf bigint")
    assert as_dict(index.upsert_postings(old, new)) == {("a", 1): 5, ("b", 1): 1, ("c", 2): 1}
    assert as_dict(index.replace_postings(old, new)) == {("a", 1): 5, ("c", 2): 1}


def test_salted_lookup_equals_join(spark):
    facts = spark.range(0, 5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("r"))
    dim = facts.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(dim, "k", F.col("n"), 100)
    assert [r[0] for r in hot.collect()] == [0]
    a = salted_lookup(facts, dim, "k", hot, F.col("r"))
    assert sorted(map(tuple, a.select("k", "r", "n").collect())) == sorted(map(tuple, facts.join(dim, "k").select("k", "r", "n").collect()))


def test_round_trips(spark, tmp_path):
    p = index.term_frequencies(docs(spark, "b a", "a"))
    store.write_by_term(p, f"{tmp_path}/p")
    assert as_dict(store.read_or_empty(spark, f"{tmp_path}/p", store.POSTINGS)) == as_dict(p.select("term", "doc_id", "tf"))
    assert store.read_or_empty(spark, f"{tmp_path}/none", store.WEIGHTS).count() == 0
    (tmp_path / "d.json").write_text('{"_meta": {"total": 1}, "documents": {"4": {"title": "T", "metadata": {"tmdb_id": 9}, "rich_text": "x"}}}')
    r = store.read_collection(spark, f"{tmp_path}/d.json").head()
    assert (r["doc_id"], r["title"], r["metadata"]["tmdb_id"]) == (4, "T", 9)
    assert store.read_collection(spark, f"{tmp_path}/no.json").count() == 0
    state = store.ProgressFile(f"{tmp_path}/s.json")
    state.save(page=3)
    assert store.ProgressFile(f"{tmp_path}/s.json").state["page"] == 3
    (tmp_path / "s.json").write_text("{broken")
    assert store.ProgressFile(f"{tmp_path}/s.json").state == {}


@pytest.mark.parametrize(
    ("word", "want"),
    [("running", "run"), ("ponies", "poni"), ("hopping", "hop"), ("hoping", "hope"), ("relational", "relat"), ("skies", "sky"), ("generously", "generous"), ("national", "nation"), ("cats", "cat"), ("by", "by"), ("happily", "happili"), ("consistency", "consist")],
)
def test_stems(word, want):
    assert stem(word) == want


def test_search_over_a_stored_index(spark, tmp_path):
    d = spark.createDataFrame([(i, f"T{i}" if i else None, None, "red fox " * (i + 1) + "hill" * (i % 2), 1) for i in range(6)], "doc_id bigint, title string, year string, rich_text string, score int")
    built = build_index(d, str(tmp_path))
    v = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(8)], "vec_id bigint, embedding array<float>")
    r = Request(tokens=("hill",), vector=(1.0, 0.0), top_k=3)
    rows = search(built.weights, v, d, r).collect()
    assert [x["doc_id"] for x in rows] == [0, 1, 2] or rows[0]["doc_id"] == 0
    assert rows[0]["title"] == "Unknown" and rows[0]["year"] == "N/A" and rows[0]["vector_score"] == 1.0
    assert total_results(built.weights, v, d, r).head()[0] == 6


def test_core_does_not_need_the_training_subpackage():
    import ast
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "tessera"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            names = [getattr(n, "module", None) or a.name for n in ast.walk(ast.parse(f.read_text())) if isinstance(n, (ast.Import, ast.ImportFrom)) for a in n.names]
            assert not any(n and "llm" in n.split(".") for n in names), f


def test_query_text_to_request(spark):
    assert Request.of("The Fox, the hill!", ("the",)).tokens == ("fox", "hill")
    assert Request.of("тихий").tokens == ()
    with pytest.raises(ValueError, match="empty"):
        Request.of("")
    t = "Don't stop: çé1 _x_ ½ 2nd"
    in_plan = spark.createDataFrame([(t,)], "t string").select(tokens(F.col("t"))).head()[0]
    assert list(query_tokens(t)) == in_plan


def test_lookup_takes_the_first_token(spark):
    p = index.term_frequencies(docs(spark, "fox fox", "fox", "hill"))
    names = spark.createDataFrame([(0, "T", None)], "doc_id bigint, title string, year string")
    assert [tuple(r) for r in index.lookup_term(p, names, "Fox hill").collect()] == [(0, 2, "T", "?"), (1, 1, "?", "?")]
    assert index.lookup_term(p, names, "!!").count() == 0


def test_ids_are_checked(spark):
    good = spark.range(3).withColumnRenamed("id", "doc_id")
    assert index.with_checked_ids(good).count() == 3
    with pytest.raises(Exception, match="not a document id: -1"):
        index.with_checked_ids(good.select((F.col("doc_id") - 1).alias("doc_id"))).collect()


def test_done_stays_done_and_may_fail_again(spark):
    e = spark.createDataFrame([(1, "done", 1), (1, "failed", 2), (2, "failed", 1), (2, "done", 2), (3, "failed", 1)], "k int, status string, at int")
    assert tuple(store.progress(e, "k", "done").head()) == (3, 2, 2)


def test_batch_equals_single_queries_with_a_hot_term(spark, monkeypatch):
    monkeypatch.setattr(pnorm, "PAIRS_PER_TASK", 10)
    w = spark.createDataFrame([("x", i, 0.1 * (i % 7)) for i in range(60)] + [("y", i, 0.5) for i in range(0, 60, 9)], "term string, doc_id bigint, w double")
    queries = spark.createDataFrame([(1, 2, 2.0), (2, 3, 1.0)], "query_id int, m bigint, p double")
    terms = spark.createDataFrame([(1, "x", 1), (1, "y", 1), (2, "x", 2), (2, "none", 1)], "query_id int, term string, c bigint")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in pnorm.score_batch(w, queries, terms).collect()}
    want = {(q, r["doc_id"]): r["score"] for q, t, p in ((1, ("x", "y"), 2.0), (2, ("x", "x", "none"), 1.0)) for r in pnorm.score(w, t, p).collect()}
    assert got == want


def test_nearest_vectors_of_many_queries_in_blocks(spark, monkeypatch):
    rows = [(i, [float((i * a) % 11 - 5) for a in (1, 3, 7)]) for i in range(61)] + [(61, [0.0, 0.0, 0.0]), (62, None), (63, [1.0]), (80, [1.0, 2.0, 0.5])]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    queries = v.where("vec_id % 20 = 0")
    want = {q: [tuple(r) for r in dense.top_k(v, dense.vector_of(v, q), k=7).collect()] for q in (0, 20, 40, 60, 80)}
    for rows_in_block in (1024, 7):
        monkeypatch.setattr(dense, "BLOCK_ROWS", rows_in_block)
        got = {}
        for r in dense.top_k_batch(v, queries, k=7).orderBy("query_id", F.desc("score"), "doc_id").collect():
            got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
        assert got == want
    assert dense.top_k_batch(v, queries.limit(0)).count() == 0
