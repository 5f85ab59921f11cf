"""Slugs, legacy texts, stored states, stems in two languages, stemmed search and encoders, on hand-written rows."""

import json
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import lineage
from tessera.functions.stem import stem, stemmer
from tessera.functions.text import slugify, to_ascii
from tessera.operators import encode, html, index, ingest
from tessera.plans.build import build_index
from tessera.plans.search import Request, search
from tessera.sources import store


def test_ascii_is_the_compatibility_decomposition(spark):
    texts = ["Kieślowski", "ő ű ā ß Æ", "ﬁn ½ № ™ ㎏", "ｆｕｌｌ", "𝒜𝟙", "é", "a b", "日本", "", None, "plain"]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(to_ascii(F.col("t"))).collect()]
    assert got == [None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in texts]


def test_slugs(spark):
    cases = {"\tKieślowski's  Łódź ": "kieslowskis-odz", "A - B": "a---b", "!!!": "", "Amélie (2001)\n": "amelie-2001", "Ⅳ½": "iv12"}
    got = {r["t"]: r["s"] for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", slugify(F.col("t")).alias("s")).collect()}
    assert got == cases


def test_legacy_texts(spark):
    meta = "struct<director string, cast array<string>, genres array<string>, tagline string>"
    rows = [("T", "", "Syn", None, "G", None, "", ["r1", ""], ("D", list("abcdefg"), ["x", "y"], "Tag")), ("T", "1", None, "D", "", "A", "C", None, None), (None, None, None, None, None, None, None, [], (None, None, [], ""))]
    d = spark.createDataFrame(rows, f"title string, year string, synopsis string, director string, genre string, awards string, cast string, reviews array<string>, metadata {meta}")
    c = [F.col(x) for x in d.columns]
    assert [r[0] for r in d.select(ingest.legacy_text(*c)).collect()] == ["T Syn G D x y a b c d e Tag r1", "T 1 D A C", ""]
    assert [r[0] for r in d.select(ingest.legacy_reading_text(c[0], c[2], c[3], c[4], c[7])).collect()] == ["T Syn G r1", "T D", ""]


def test_quotes_without_upper_bound_and_in_order(spark):
    long, mid = "x" * 5000, "quoted \"word\" " * 4
    page = json.dumps([{"quote": q} for q in ("short", mid, long, mid, "see http://a.example " + "y" * 60, None, "é" * 41)])
    got = spark.createDataFrame([(page,), (None,), ("",)], "p string").select(html.quotes(F.col("p")).alias("q")).collect()
    assert [r["q"] for r in got] == [[long, "é" * 41, mid], [], []]  # as written: six characters a letter


def test_first_found_and_adult_flag(spark):
    d = spark.createDataFrame([("a=1 b=2",), ("b=2",), ("a= b=3",), (None,)], "p string").select(html.first_found(F.col("p"), r"a=(\d*)", r"b=(\d*)").alias("v"))
    assert [r["v"] for r in d.collect()] == ["1", "2", "3", None]
    rows = spark.createDataFrame([(1, "s", 10, "1999", "en", True), (2, "s", 10, "1999", "en", None), (3, "s", 10, "1999", "en", False)], "tmdb_id int, strategy string, vote_count int, year string, original_language string, adult boolean")
    assert [r["tmdb_id"] for r in ingest.source_filters(rows, {"s": 5}, adult="adult").orderBy("tmdb_id").collect()] == [2, 3]


def test_states_are_sorted_kept_and_reset(spark, tmp_path):
    events = spark.createDataFrame([(3, "done", 1), (1, "failed", 2), (2, "done", 1), (2, "failed", 5), (None, "done", 1)], "id bigint, status string, at bigint")
    path = str(tmp_path / "states")
    assert store.read_states(spark, path, "id").count() == 0
    store.write_states(store.key_states(events, "id", "done"), path, "id")
    assert [tuple(r) for r in store.read_states(spark, path, "id").collect()] == [(1, False, True), (2, True, True), (3, True, False)]
    store.reset_states(spark, path, "id")
    assert store.read_states(spark, path, "id").count() == 0
    docs = spark.createDataFrame([(1, 0, ("tt1",)), (2, 0, ("tt2",)), (3, 4, ("tt3",)), (4, 0, ("",)), (5, 0, ("tt5",))], "doc_id bigint, reviews_count bigint, metadata struct<imdb_id string>")
    done = spark.createDataFrame([(2,), (None,)], "doc_id bigint")
    assert [r[0] for r in ingest.enrich_candidates(docs, done).orderBy("doc_id").collect()] == [1, 5]
    assert [r[0] for r in ingest.enrich_candidates(docs, done, 1).collect()] == [1]


def test_progress_file(tmp_path):
    path = tmp_path / "p.json"
    store.ProgressFile(str(path)).save(done={3, 1, 2}, page=4)
    again = store.ProgressFile(str(path))
    assert again.state["done"] == [1, 2, 3] and again.state["page"] == 4
    path.write_text("{broken")
    assert store.ProgressFile(str(path)).state == {}
    again.reset()
    assert not path.exists()


@pytest.mark.parametrize(
    ("word", "want"),
    [("canciones", "cancion"), ("nacional", "nacional"), ("chicos", "chic"), ("rápidamente", "rapid"), ("corriendo", "corr"), ("generosidad", "gener"), ("llegue", "lleg"), ("haciéndola", "hac"), ("películas", "pelicul"), ("habitaciones", "habit"), ("cheque", "chequ"), ("a", "a"), ("", "")],
)
def test_spanish_stems(word, want):
    assert stemmer("spanish")(word) == want


def test_search_over_stems_equals_brute_force(spark, tmp_path):
    texts = ["Letters from the harbour", "A letter, lettering and letters", "Winters and harbours", "Nothing here", None, ""]
    d = spark.createDataFrame([(i, t, f"T{i}", None) for i, t in enumerate(texts)], "doc_id bigint, rich_text string, title string, year string")
    built = build_index(d, str(tmp_path / "i"), stop_words=("the", "and", "from", "a"), language="english")
    counts = {}
    for i, t in enumerate(texts):
        for w in (t or "").lower().replace(",", "").split():
            if w not in ("the", "and", "from", "a"):
                counts[stem(w), i] = counts.get((stem(w), i), 0) + 1
    assert {(r["term"], r["doc_id"]): r["tf"] for r in built.postings.collect()} == counts
    request = Request.of("the letters", ("the",), language="english")
    assert request.tokens == ("letter",) and request.words == ("letters",)
    vectors = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    found = {r["doc_id"]: r["snippet"] for r in search(built.weights, vectors, d, request).collect()}
    assert set(found) == {0, 1} and found[0].startswith("...Letters")
    with pytest.raises(ValueError, match="language"):
        stemmer("latin")


def test_encoder(spark):
    d = spark.createDataFrame([(1, "The harbour in winter"), (2, None), (3, ""), (4, "x" * 5000), (None, "y")], "doc_id bigint, rich_text string")
    got = {r["doc_id"]: np.array(r["embedding"]) for r in encode.embed(d, limit=100).collect()}
    assert set(got) == {1, 4} and all(np.linalg.norm(v) == pytest.approx(1, abs=1e-5) for v in got.values())
    assert np.array(encode.encode_query("The harbour in winter")) == pytest.approx(got[1], abs=1e-6)
    assert encode.embed(d.limit(0)).count() == 0
    request = Request.of("harbour", encoder=encode.hashing_encoder)
    assert len(request.vector) == 64 and request.tokens == ("harbour",)


def test_terms_lookup_and_lists(spark):
    p = spark.createDataFrame([("a", 1, 2), ("a", 5000, 3), ("b", 1, 1)], "term string, doc_id bigint, tf bigint")
    d = spark.createDataFrame([(1, "One", None)], "doc_id bigint, title string, year string")
    assert sorted(tuple(r) for r in index.posting_lists(p).collect()) == [("a", 0, "1:2"), ("a", 1, "5000:3"), ("b", 0, "1:1")]
    got = sorted(tuple(r) for r in index.lookup_terms(p, d, ["a", "b", "zz", "a"], 1).collect())
    assert got == [("a", 1, 5000, 3, 2, "?", "?"), ("b", 1, 1, 1, 1, "One", "?")]
    assert index.lookup_terms(p, d, []).count() == 0


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

        def getConf(self):
            return type("C", (), {"get": lambda self, k: None})()

    class Session:
        sparkContext = Context()
        conf = type("R", (), {"get": lambda self, k, v=None: v})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        lineage.ensure_checkpoint_dir(Session())


def test_best_k_of_each_query(spark):
    from tessera.operators import pnorm

    w = spark.createDataFrame([("x", i, i / 10) for i in range(1, 8)] + [("y", 3, 0.9)], "term string, doc_id bigint, w double")
    queries = spark.createDataFrame([(1, 1.0, 2.0), (2, 2.0, 2.0)], "query_id bigint, m double, p double")
    terms = spark.createDataFrame([(1, "x", 1), (2, "x", 1), (2, "y", 1)], "query_id bigint, term string, c bigint")
    every = {(r["query_id"], r["doc_id"]): r["score"] for r in pnorm.score_batch(w, queries, terms).collect()}
    best = {(r["query_id"], r["doc_id"]) for r in pnorm.score_batch(w, queries, terms, k=3).collect()}
    assert best == {k for q in (1, 2) for k in sorted((k for k in every if k[0] == q), key=lambda k: (-every[k], k[1]))[:3]}
