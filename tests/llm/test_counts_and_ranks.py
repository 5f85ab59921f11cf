"""Co-occurrence, distinctive terms, rank fusion and packing: edge cases and brute force on small rows."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import cooccur, distinctive, packing, rankfusion

REC = "doc_id bigint, items array<string>, kind string, n bigint"


def test_pairs_with_nulls_repeats_spacing_and_clashing_columns(spark):
    rows = [(1, [" A  b", "a B", "c", None, ""], "x", 0), (2, ["C", "a b"], "x", 0), (3, None, "x", 0), (4, [], "x", 0), (5, ["solo"], "x", 0)]
    out = cooccur.cooccurrence(spark.createDataFrame(rows, REC), "doc_id", {"k": "items"}).collect()
    assert [(r["kind"], r["item_a"], r["item_b"], r["n_ab"], r["n_a"], r["n_b"], r["n_rows"]) for r in out] == [("k", "a b", "c", 2, 2, 2, 5)]
    assert out[0]["lift"] == pytest.approx(2 * 5 / 4)
    assert out[0]["odds_ratio"] == pytest.approx((2.5 * 3.5) / (0.5 * 0.5))


def test_no_records(spark):
    assert cooccur.cooccurrence(spark.createDataFrame([], REC), "doc_id", {"k": "items"}).count() == 0


def test_pairs_equal_brute_force_with_a_hot_item_and_small_runs(spark, monkeypatch):
    monkeypatch.setattr(cooccur, "ROWS_PER_TASK", 20)
    monkeypatch.setattr(cooccur, "RUN_CODES", 64)
    rng = random.Random(3)
    rows = [(i, rng.sample(["hot" if i % 3 else "warm", *[f"n{k}" for k in range(12)]], rng.randint(0, 6)), "", 0) for i in range(300)]
    rows = [(i, [*a, "hot"], k, n) for i, a, k, n in rows]
    want = Counter(p for _, a, _, _ in rows for p in itertools.combinations(sorted(set(a)), 2))
    for least in (1, 9):
        got = {(r["item_a"], r["item_b"]): r["n_ab"] for r in cooccur.cooccurrence(spark.createDataFrame(rows, REC), "doc_id", {"k": "items"}, min_count=least).collect()}
        assert got == {p: n for p, n in want.items() if n >= least}


@given(st.lists(st.integers(0, 40), max_size=60))
def test_equal_codes_are_counted(values):
    keys, n = cooccur.count_equal(np.sort(np.array(values, np.int64)))
    assert dict(zip(keys.tolist(), n.tolist(), strict=True)) == dict(Counter(values))


def test_long_records_are_paired_item_by_item(monkeypatch):
    monkeypatch.setattr(cooccur, "LONG_RECORD", 4)
    ids = np.arange(7, dtype=np.int64)
    codes = np.sort(np.concatenate(list(cooccur._pair_codes(ids, np.array([7])))))
    assert codes.tolist() == sorted((a << 32) | b for a, b in itertools.combinations(range(7), 2))


TEXTS = "doc_id bigint, rich_text string, term string, df bigint"


def test_scores_follow_the_formula(spark):
    rows = [(1, "alpha alpha beta xx", "", 0), (2, "Beta gamma beta1", "", 0), (3, None, "", 0), (4, "", "", 0), (5, "é!", "", 0)]
    got = {(r["doc_id"], r["term"]): r for r in distinctive.distinctive_terms(spark.createDataFrame(rows, TEXTS)).collect()}
    assert set(got) == {(1, "alpha"), (1, "beta"), (2, "beta"), (2, "gamma"), (2, "beta1")}
    tfn, lam = 2 * math.log2(1 + 3 / 3), 2 / 2
    assert got[1, "alpha"]["score"] == pytest.approx((math.log2(1 + lam) + tfn * math.log2((1 + lam) / lam)) / (tfn + 1))
    assert got[2, "gamma"]["score"] > got[2, "beta"]["score"]


def test_limits_only_leave_rows_out_and_flushes_change_nothing(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * k) % 7}zz" for k in range(40)), "", 0) for i in range(30)]
    docs = spark.createDataFrame(rows, TEXTS)
    full = {(r["doc_id"], r["term"]): (r["tf"], r["df"], round(r["score"], 9)) for r in distinctive.distinctive_terms(docs).collect()}
    monkeypatch.setattr(distinctive, "HELD_TERMS", 2)
    monkeypatch.setattr(distinctive, "OUT_ROWS", 3)
    monkeypatch.setattr(distinctive, "ROWS_PER_TASK", 5)
    part = {(r["doc_id"], r["term"]): (r["tf"], r["df"], round(r["score"], 9)) for r in distinctive.distinctive_terms(docs, min_tf=4, max_df=26).collect()}
    assert part == {k: v for k, v in full.items() if v[0] >= 4 and v[1] <= 26}
    assert distinctive.distinctive_terms(docs.limit(0)).count() == 0


RES = "request_id bigint, doc_id bigint, a double, b double, served_at bigint, position bigint"


def brute(rows, k=60):
    best = {}
    for g, i, a, b, at, _ in rows:
        if g is None or i is None:
            continue
        ok = tuple(x if x is not None and math.isfinite(x) else None for x in (a, b))
        key = (at is not None, at or 0, tuple(-math.inf if x is None else x for x in ok))
        if (g, i) not in best or key > best[g, i][0]:
            best[g, i] = (key, ok)
    out = {}
    for g in {g for g, _ in best}:
        items = {i: v[1] for (gg, i), v in best.items() if gg == g}
        fused = defaultdict(float)
        for s in (0, 1):
            for i, v in items.items():
                if v[s] is not None:
                    fused[i] += 1 / (k + 1 + sum(1 for w in items.values() if w[s] is not None and w[s] > v[s]))
        for p, i in enumerate(sorted(items, key=lambda i: (-round(fused[i], 12), i)), 1):
            out[g, i] = (round(fused[i], 9), p)
    return out


def test_fusion_equals_brute_force_with_a_hot_group_ties_and_odd_scores(spark):
    rng = random.Random(5)
    odd = [None, float("nan"), float("inf"), 0.0, -1.0, 137.0]
    value = lambda: rng.choice(odd) if rng.random() < 0.3 else float(rng.randint(0, 15))
    rows = [(0 if rng.random() < 0.5 else rng.randint(1, 9), rng.randint(0, 150), value(), value(), rng.choice([None, 1, 2]), 7) for _ in range(900)]
    rows += [(None, 1, 1.0, 1.0, 1, 7), (1, None, 1.0, 1.0, 1, 7), rows[0]]
    got = rankfusion.fuse(spark.createDataFrame(rows, RES), "request_id", "doc_id", ["a", "b"], latest="served_at")
    assert {(r["request_id"], r["doc_id"]): (round(r["fused"], 9), r["position"]) for r in got.collect()} == brute(rows)


def test_one_value_in_all_rows_shares_rank_one_across_partitions(spark):
    rows = spark.range(0, 3000).select(F.lit(1).cast("bigint").alias("g"), F.col("id").alias("i"), F.lit(2.5).alias("v"))
    got = rankfusion.positions(rows, ["g"], "v", ["i"]).collect()
    assert {r["rank"] for r in got} == {1}
    assert all(r["position"] == r["i"] + 1 for r in got)


def test_no_results(spark):
    assert rankfusion.fuse(spark.createDataFrame([], RES), "request_id", "doc_id", ["a", "b"]).count() == 0


def vocabulary():
    import os

    return os.path.exists(packing.DEFAULT_VOCABULARY)


@pytest.mark.skipif(not vocabulary(), reason="no tokenizer here")
def test_packing_is_whole_and_within_capacity(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["film", "review", "über", "naïve", "12"], k=rng.choice([0, 1, 5, 40, 90]))), "x") for i in range(400)] + [(400, None, "x"), (3, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, container string").repartition(5)
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    specs = spark.createDataFrame([(1, 16), (2, 64), (2, 64), (3, 0)], "spec_id bigint, capacity_tokens bigint")
    encode = packing.encoding(packing.DEFAULT_VOCABULARY).encode_ordinary
    out = packing.pack(docs, specs, windows=4, group=2).collect()
    for spec, capacity in ((1, 16), (2, 64)):
        fill, pieces = Counter(), defaultdict(list)
        for r in out:
            if r["spec_id"] == spec:
                if r["container"] is not None:
                    fill[r["container"]] += r["n_tokens"]
                pieces[r["doc_id"]].append((r["piece"], r["first_token"], r["n_tokens"]))
        assert max(fill.values()) <= capacity
        total = Counter()
        for i, t, _ in rows:
            total[i] += len(encode(t)) if t else 0
        assert {i: sum(p[2] for p in ps) for i, ps in pieces.items()} == dict(total)
        for i, t, _ in rows:
            if i != 3 and t and len(encode(t)) <= capacity:
                assert len(pieces[i]) == 1
        assert sum(fill.values()) / (len(fill) * capacity) > 0.9
    assert {r["spec_id"] for r in out} == {1, 2}
    assert all(r["container"] is None for r in out if r["doc_id"] == 400)
    assert packing.pack(docs.limit(0), specs).count() == 0
    used = packing.utilisation(packing.pack(docs, specs), specs).collect()
    assert {r["spec_id"] for r in used} == {1, 2} and all(r["used"] <= 1 for r in used)


@settings(max_examples=60)
@given(st.lists(st.integers(1, 10), max_size=80), st.integers(1, 6))
def test_windows_never_overflow(sizes, limit):
    w = packing.Windows(10, limit)
    fill = Counter()
    for s in sizes:
        fill[w.place(s)] += s
    assert all(v <= 10 for v in fill.values()) and sum(fill.values()) == sum(sizes) and len(w.open) <= limit
