"""Neighbourhoods, vectors and re-ranking against brute force, with one group holding a third of all rows."""

import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.operators import cf, cf_update, content, encode, graph, mmr, partners, slices, vectors


def ratings(seed, heavy, levels=4, users=40, items=60):
    rng = random.Random(seed)
    rows = {}
    for h in heavy:
        for i in rng.sample(range(items), 45):
            rows[(h, i)] = float(rng.randint(1, levels))
    while len(rows) < 3 * 45 * max(len(heavy), 1):
        rows[(rng.randint(10, users), rng.randint(0, items - 1))] = float(rng.randint(1, levels))
    return rows


def brute(cells, norms, k):
    by_group = defaultdict(dict)
    for (g, m), w in cells.items():
        by_group[g][m] = w
    dots = defaultdict(float)
    for members in by_group.values():
        for a, wa in members.items():
            for b, wb in members.items():
                if a != b:
                    dots[(a, b)] += wa * wb
    sims = defaultdict(list)
    for (a, b), dot in dots.items():
        sims[a].append((b, dot / math.sqrt(norms[a] * norms[b])))
    return {a: sorted(v, key=lambda x: (-round(x[1], 12), x[0]))[:k] for a, v in sims.items()}


@pytest.mark.parametrize(
    "heavy, levels, options",
    [
        ([], 4, {}),
        ([1], 4, {"first": 6}),
        ([1, 2, 3], 2, {"first": 6}),
        ([1, 2, 3], 1, {"first": 6, "block": 7}),
        ([1, 2], 3, {"block": 4}),
        (list(range(1, 11)), 3, {"first": 6, "block": 16}),
        (list(range(1, 11)), 3, {"first": 6, "block": 16, "slice_cells": 25}),
    ],
)
def test_similarity_is_exact_with_hot_groups(spark, heavy, levels, options):
    rows = ratings(3, heavy, levels)
    norms = defaultdict(float)
    for (_, m), w in rows.items():
        norms[m] += w * w
    cells = spark.createDataFrame([(g, m, w) for (g, m), w in rows.items()], "grp long, member long, weight double")
    norm_df = spark.createDataFrame(list(norms.items()), "member long, norm double")
    got = defaultdict(list)
    for r in cf.similarity(cells, norm_df, 5, **options).orderBy("member", "rank").collect():
        got[r.member].append((r.other, round(r.sim, 9)))
    want = {a: [(b, round(s, 9)) for b, s in v] for a, v in brute(rows, norms, 5).items()}
    assert dict(got) == want


def test_real_valued_hot_profiles(spark):
    rng = random.Random(5)
    rows = {k: w + rng.random() for k, w in ratings(4, [1, 2]).items()}
    norms = defaultdict(float)
    for (_, m), w in rows.items():
        norms[m] += w * w
    cells = spark.createDataFrame([(g, m, w) for (g, m), w in rows.items()], "grp long, member long, weight double")
    norm_df = spark.createDataFrame(list(norms.items()), "member long, norm double")
    out = cf.similarity(cells, norm_df, 4, first=5)
    got = defaultdict(list)
    for r in out.orderBy("member", "rank").collect():
        got[r.member].append(r.other)
    assert dict(got) == {a: [b for b, _ in v] for a, v in brute(rows, norms, 4).items()}


def partners_of(spark, rows, norms, k, **options):
    cells = spark.createDataFrame([(g, m, w) for (g, m), w in rows.items()], "grp long, member long, weight double")
    norm_df = spark.createDataFrame(list(norms.items()), "member long, norm double")
    got = defaultdict(list)
    for r in cf.similarity(cells, norm_df, k, **options).orderBy("member", "rank").collect():
        got[r.member].append((r.other, round(r.sim, 9)))
    return dict(got)


def test_a_group_of_everybody_costs_few_products(spark, monkeypatch):
    """One group holds all members: exact top k, and far fewer products than pairs of members."""
    rng = random.Random(8)
    n = 3_000
    rows = {(0, m): float(rng.randint(1, 60)) for m in range(n)}
    rows |= {(1 + rng.randrange(900), m): float(rng.randint(1, 60)) for m in range(n) for _ in range(2)}
    norms = defaultdict(float)
    for (_, m), w in rows.items():
        norms[m] += w * w
    made = []
    whole = partners.meetings

    def counted(*args):
        out = whole(*args)
        made.append(out.select(F.sum(F.size("of") * F.size("place"))).first()[0])
        return out

    monkeypatch.setattr(partners, "meetings", counted)
    got = partners_of(spark, rows, norms, 5, first=16)
    want = {a: [(b, round(s, 9)) for b, s in v] for a, v in brute(rows, norms, 5).items()}
    assert got == want
    assert sum(made) < n * n / 15


@pytest.mark.parametrize("first", [6, 256])
def test_equal_members_are_one_class(spark, first):
    """Hundreds of members with the same two groups, and some with only one of them: no square, exact ties."""
    rows = {}
    for m in range(300):
        rows[(1, m)] = rows[(2, m)] = 2.0
    for m in range(300, 340):
        rows[(1 + m % 2, m)] = 1.0 + m % 3
    for m in range(340, 380):
        rows[(1, m)], rows[(2, m)], rows[(3 + m % 5, m)] = 1.0, 2.0, float(m % 7 + 1)
    norms = defaultdict(float)
    for (_, m), w in rows.items():
        norms[m] += w * w
    want = {a: [(b, round(s, 9)) for b, s in v] for a, v in brute(rows, norms, 5).items()}
    assert partners_of(spark, rows, norms, 5, first=first) == want


def clustered_vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    which = np.where(rng.random(n) < 0.4, 0, rng.integers(0, 6, n))  # one hot cluster
    return centres[which] + 0.3 * rng.normal(size=(n, dim))


def test_topk_equals_brute_force_above_the_flat_limit(spark):
    v = clustered_vectors(1_200, 8, 1)
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "item_id long, vector array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    scores = unit @ unit.T
    np.fill_diagonal(scores, -np.inf)
    want = np.argsort(-np.round(scores, 12), axis=1, kind="stable")[:, :5]
    queries = df.withColumnRenamed("item_id", "query_id")
    for out in (
        vectors.exact_topk_cosine(queries, df, 5, skip_self=True),
        vectors.ivf_topk(queries, df, 5, skip_self=True, exact=True),
        vectors.ivf_topk(queries, df, 5, probes=1, skip_self=True, exact=True),
    ):
        got = defaultdict(list)
        for r in out.orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.item_id)
        assert all(got[i] == list(want[i]) for i in range(len(v)))


@pytest.mark.parametrize("n", [3, 60, 900])
def test_two_level_search_at_any_size(spark, n):
    """Every vector gets one cluster; the method is the same at all sizes and finds most neighbours."""
    v = clustered_vectors(n, 8, 4)
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "item_id long, vector array<double>")
    unit = vectors.unit_vectors(df, "item_id", "item_id")
    cells = vectors.fit_cells(unit, "item_id")
    placed = vectors.place(unit, cells, 1, "item_id").collect()
    assert sorted(r.item_id for r in placed) == list(range(n))
    assert len(cells.coarse) <= cells.width and {r.cluster // cells.width for r in placed} <= set(range(len(cells.coarse)))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    scores = u @ u.T
    np.fill_diagonal(scores, -np.inf)
    k = min(5, n - 1)
    want = {(i, int(j)) for i in range(n) for j in np.argsort(-np.round(scores[i], 12), kind="stable")[:k]}
    found = vectors.ivf_topk(df.withColumnRenamed("item_id", "query_id"), df, k, skip_self=True).collect()
    got = {(r.query_id, r.item_id) for r in found}
    assert len(got) == len(found) and len(got & want) >= 0.8 * len(want)


def test_blocks_do_not_change_the_result(spark):
    v = clustered_vectors(300, 8, 2)
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "item_id long, vector array<double>")
    c = vectors.unit_vectors(df, "item_id", "item_id").withColumn("cluster", F.lit(0))
    q = c.withColumnRenamed("item_id", "query_id")
    a = vectors.probe_topk(q, c, 3, True).orderBy("query_id", "rank").collect()
    b = vectors.probe_topk(q, c, 3, True, pack=16).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.item_id) for r in a] == [(r.query_id, r.item_id) for r in b]


def test_vectors_are_sent_once_per_tile(spark):
    n = 6_000
    v = np.random.default_rng(8).normal(size=(n, 8))
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "item_id long, vector array<double>").cache()
    c = vectors.unit_vectors(df, "item_id", "item_id").withColumn("cluster", F.lit(0))
    # 12 packs of 512 queries meet one tile of vectors, not 12 packs of them
    q, q_tiles = vectors._tiled(c, "item_id", "q", vectors.TILE, vectors.TILES)
    assert q_tiles.first()["q_tiles"] == 12 and q.count() == n
    assert vectors._tiled(c, "item_id", "c", vectors.TILE)[1].first()["c_tiles"] == 1
    # bounds that hold nothing back: a query is sent to every cell, not to every cluster
    cells = vectors.fit_cells(c, "item_id")
    members = vectors.place(c, cells, 1, "item_id")
    asked = c.select(F.col("item_id").alias("query_id"), "vector", F.lit(-2.0).alias("floor"))
    opened = vectors._open_cells(asked, members, cells)
    assert opened.groupBy("query_id", "cluster").count().where("count > 1").isEmpty()
    assert opened.count() <= n * len(cells.coarse)
    # what the tiles find is the truth
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    some = df.where("item_id < 50").withColumnRenamed("item_id", "query_id")
    for method in ("flat", "bounded"):
        rows = vectors.exact_topk_cosine(some, df, 4, True, method).orderBy("query_id", "rank").collect()
        scores = unit[:50] @ unit.T
        np.fill_diagonal(scores, -np.inf)
        want = np.argsort(-np.round(scores, 12), axis=1, kind="stable")[:, :4]
        assert [r.item_id for r in rows] == want.ravel().tolist()


def test_recall_tells_items_apart_by_taste(spark):
    users = spark.createDataFrame([(1, "a;b"), (1, "b"), (2, "b;a;b"), (None, "a"), (None, "b"), (3, ""), (4, None), (5, "z")], "user_id long, likes string")
    index = spark.createDataFrame([("a", 7), ("a", 8), ("b", 8), ("b", None)], "entry string, item_id long")
    found = content.entry_recall(users, index, "likes")
    got = [(r.user_id, r.item_id) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == {(u, i) for u in (1, 2, None) for i in (7, 8, None)}
    # no (user, item) pair goes through a grouping
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    grouped = [line for line in plan.splitlines() if "Aggregate [" in line]
    assert grouped and not [line for line in grouped if "user_id" in line and "item_id" in line]


def test_mmr_matches_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    n, sel, win, lam = 40, 20, 5, 0.7
    vecs, rel = rng.normal(size=(n, 6)), rng.random(n)
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    picked = [int(np.argmax(rel))]
    while len(picked) < sel:
        left = [i for i in range(n) if i not in picked]
        value = {i: lam * rel[i] - (1 - lam) * max(unit[i] @ unit[j] for j in picked[-win:]) for i in left}
        picked.append(max(value, key=value.get))
    rows = [(1, i, float(rel[i]), [float(x) for x in vecs[i]]) for i in range(n)]
    df = spark.createDataFrame(rows, "request_id long, item_id long, relevance double, vector array<double>")
    out = mmr.mmr_rerank(df, lam, win, sel).orderBy("position").collect()
    assert [r.item_id for r in out] == picked
    assert mmr.mmr_rerank(df.limit(0)).count() == 0


def test_propagation_matches_matrix_product(spark):
    pairs = [(0, 0), (0, 1), (1, 1), (2, 1), (2, 1)]
    df = spark.createDataFrame(pairs, "user_id long, item_id long")
    nodes = ["u0", "u1", "u2", "i0", "i1"]
    adj = np.zeros((5, 5))
    for u, i in pairs:
        adj[u, 3 + i] = adj[3 + i, u] = 1.0
    deg = adj.sum(axis=1)
    adj = adj / np.sqrt(np.outer(deg, deg))
    x = np.arange(10, dtype=float).reshape(5, 2)
    want = (x + adj @ x + adj @ adj @ x) / 3
    node_df = spark.createDataFrame([(n, *map(float, r)) for n, r in zip(nodes, x)], "node string, e0 double, e1 double")
    got = {r.node: (r.e0, r.e1) for r in graph.propagate(graph.adjacency(df), node_df, ["e0", "e1"]).collect()}
    for n, row in zip(nodes, want):
        assert got[n] == pytest.approx(tuple(row))


def test_dense_index_and_prefix_max(spark):
    df = spark.range(1_000).select((F.col("id") * 7 % 1_000).alias("v"))
    got = slices.dense_index(df, ["v"]).orderBy("v").collect()
    assert [(r.v, r.idx) for r in got] == [(i, i) for i in range(1_000)]
    rng = random.Random(1)
    vals = [rng.randint(0, 1_000) for _ in range(500)]
    rows = spark.createDataFrame(list(enumerate(vals)), "arrival long, ts long")
    out = slices.prefix_max(rows, "arrival", "ts", "m", slice_rows=16).orderBy("arrival").collect()
    assert [r.m for r in out] == [None] + [max(vals[:i]) for i in range(1, 500)]


def test_distinct_rows_are_dealt_by_their_number(spark):
    rows = spark.createDataFrame([(i % 40, i % 80) for i in range(200)] + [(None, 1)] * 3, "a long, b long")
    found = slices.distinct_rows(rows, 203, per_task=20)
    assert {tuple(r) for r in found.collect()} == {(i % 40, i % 80) for i in range(200)} | {(None, 1)} and found.count() == 81
    assert found.rdd.getNumPartitions() == 11


def test_scaler_merge(spark):
    a = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "x double, y double")
    b = spark.createDataFrame([(10.0, 5.0)], "x double, y double")
    st = encode.partial_fit(a, b, ["x", "y"])
    out = encode.scale(b, ["x", "y"], st).collect()[0]
    arr = np.array([1.0, 2.0, 10.0])
    assert out.x_scaled == pytest.approx((10 - arr.mean()) / arr.std())
    assert out.y_scaled == 0.0


def test_updated_neighbourhoods_equal_a_new_fit(spark):
    """New rows touch some members; the others keep what they have, and all of it equals a fit from scratch."""
    rng = random.Random(6)
    rows = {(g, m): float(rng.randint(1, 4)) for m in range(200) for g in rng.sample(range(60), 3)}
    grown = dict(rows)
    for m in rng.sample(range(200), 6):
        for g in rng.sample(range(60), 2):
            grown[(g, m)] = float(rng.randint(1, 4))
    grown |= {(3, 300): 2.0, (4, 300): 1.0}  # a new member
    dropped = next(k for k in rows if k[1] == 17)
    del grown[dropped]  # a rating that fell to nothing: similarities fall, others come up

    def side(of):
        norms = defaultdict(float)
        for (_, m), w in of.items():
            norms[m] += w * w
        cells = spark.createDataFrame([(g, m, w) for (g, m), w in of.items()], "grp long, member long, weight double")
        return cells, spark.createDataFrame(list(norms.items()), "member long, norm double")

    def listed(partners):
        return sorted((r["member"], r["rank"], r["other"], round(r["sim"], 9)) for r in partners.collect())

    old = cf_update.fit_side(*side(rows), 5)
    new, again = cf_update.update_side(old, *side(grown), 5)
    assert listed(new.partners) == listed(cf_update.fit_side(*side(grown), 5).partners)
    searched = {r["member"] for r in again.collect()}
    changed = {m for m in range(201) for of in [{k: w for k, w in rows.items() if k[1] == m} != {k: w for k, w in grown.items() if k[1] == m}] if of}
    assert changed <= searched and len(searched) < 110


@pytest.mark.parametrize("options", [{}, {"block": 4}, {"block": 4, "per_task": 50, "hot_cells": 3}])
def test_pairs_are_all_there_and_move_as_lists(spark, options):
    rows = ratings(5, [1, 2, 3])
    cells = spark.createDataFrame([(g, m, w) for (g, m), w in rows.items()], "grp long, member long, weight double")
    found = cf.group_pairs(cells, **options)
    want = defaultdict(float)
    for (g, a), wa in rows.items():
        for (h, b), wb in rows.items():
            if g == h and a < b:
                want[(a, b)] += wa * wb
    assert {(r.a, r.b): r.dot for r in found.collect()} == want
    # no exchange deals single pairs
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(a#" in plan and not re.search(r"hashpartitioning\(a#\d+L?, b#", plan)
