"""Propagation moves a vector once per block of receivers, and the edges as lists."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.operators import graph

DIMS = [f"e{i}" for i in range(20)]
NODES = "node long, " + ", ".join(f"{c} double" for c in DIMS)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _mean_of_layers(pairs, vectors, layers):
    """The old way in numpy: node -> mean of the layers it has."""
    pairs = {(None if u is None else 2 * u, None if i is None else 2 * i + 1) for u, i in pairs}
    degree = {}
    for pair in pairs:
        for n in pair:  # a null partner counts
            degree[n] = degree.get(n, 0) + 1
    pairs = [pair for pair in pairs if None not in pair]
    current, total = {}, {}
    for n, v in vectors:
        current[n] = current.get(n, 0.0) + np.array(v)
    total = dict(current)
    for _ in range(layers):
        after = {}
        for u, i in pairs:
            for src, dst in ((u, i), (i, u)):
                if src in current:
                    after[dst] = after.get(dst, 0.0) + current[src] / np.sqrt(degree[src] * degree[dst])
        current = after
        for n, v in current.items():
            total[n] = total.get(n, 0.0) + v
    return {n: v / (layers + 1) for n, v in total.items()}


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(12), rng.randrange(9)) for _ in range(90)] + [(0, i) for i in range(9)] * 2
    pairs += [(None, 1), (None, 1), (3, None), (3, None), (-4, 2), (None, None)]
    vectors = [(n, [rng.uniform(-1, 1) for _ in DIMS]) for n in (1, 3, 3, 7, 99, 4, None)]  # twice, without edges, a user's, null
    seen = spark.createDataFrame(pairs, "user_id long, item_id long")
    return pairs, vectors, seen, spark.createDataFrame([(n, *v) for n, v in vectors], NODES)


@pytest.mark.parametrize("layers", [0, 1, 2, 3])
def test_packed_edges_give_the_mean_of_the_layers(case, layers):
    pairs, vectors, seen, nodes = case
    out = graph.propagate(graph.adjacency(seen, packed=True), nodes, DIMS, layers).collect()
    want = _mean_of_layers(pairs, vectors, layers)
    assert len(out) == len(want)
    for r in out:
        assert [r[c] for c in DIMS] == pytest.approx(list(want[r.node]), abs=1e-12)


def test_lists_are_cut_and_lose_no_edge(case):
    pairs, vectors, seen, nodes = case
    edges = graph._both_ways(seen, graph.user_node(F.col("user_id")), graph.item_node(F.col("item_id"))).where("src is not null")
    whole, cut = graph.pack(edges), graph.pack(edges, per_list=3, share=1)
    assert cut.lists.count() > whole.lists.count()
    found = cut.lists.select("src", F.explode("near").alias("dst")).collect()
    assert len(found) == len(set(found))
    assert set(found) == {tuple(r) for r in edges.where("dst is not null").distinct().collect()}
    assert {tuple(r) for r in cut.degrees.collect()} == {tuple(r) for r in whole.degrees.collect()}
    got = {r.node: r.e19 for r in graph.propagate(cut, nodes, DIMS).collect()}
    want = _mean_of_layers(pairs, vectors, 2)
    assert got == pytest.approx({n: v[19] for n, v in want.items()}, abs=1e-12)


def test_weighted_edges_keep_repeats_and_null_values(spark):
    edges = spark.createDataFrame([("a", "b", 2.0), ("a", "b", 2.0), ("a", "c", None), (None, "c", 1.0), ("z", "a", 1.0)], "src string, dst string, weight double")
    nodes = spark.createDataFrame([("a", 1.0, None), ("d", 3.0, 4.0)], "node string, x double, y double")
    got = {r.node: (r.x, r.y) for r in graph.propagate(edges, nodes, ["x", "y"], 1).collect()}
    assert got == {"a": (0.5, None), "d": (1.5, 2.0), "b": (2.0, None), "c": (None, None)}


def test_both_forms_of_the_edges_agree(case):
    pairs, vectors, seen, nodes = case
    rows = graph.propagate(graph.adjacency(seen), nodes.withColumn("node", graph.node_name(F.col("node"))), DIMS)
    packed = graph.propagate(graph.adjacency(seen, packed=True), nodes, DIMS).withColumn("node", graph.node_name(F.col("node")))
    got = {r.node: r.e3 for r in packed.collect()}
    assert got == pytest.approx({r.node: r.e3 for r in rows.collect()}, abs=1e-12)


def test_large_ids_and_names(spark):
    seen = spark.createDataFrame([(1 << 40, 7), (5, 7)], "user_id long, item_id long")
    nodes = spark.createDataFrame([(15, 2.0)], "node long, x double")
    out = graph.propagate(graph.adjacency(seen, packed=True), nodes, ["x"], 1)
    got = {r.n: r.x for r in out.select(graph.node_name(F.col("node")).alias("n"), "x").collect()}
    assert got == pytest.approx({"i7": 1.0, f"u{1 << 40}": 1 / np.sqrt(2), "u5": 1 / np.sqrt(2)})
    names = spark.createDataFrame([(-8,), (-7,), (None,)], "n long").select(graph.node_name(F.col("n")).alias("n")).collect()
    assert [r.n for r in names] == ["u-4", "i-4", None]


def test_a_vector_does_not_move_per_edge(spark):
    edges = spark.createDataFrame([("a", "b", 1.0)], "src string, dst string, weight double")
    nodes = spark.createDataFrame([("a", 1.0)], "node string, x double")
    plan = _plan(graph.propagate(edges, nodes, ["x"], 1))
    sums, lists = plan.index("keys=[_cell"), plan.index("Generate explode(near")
    assert "Exchange" not in plan[sums:lists] and "Exchange" in plan[lists:]  # lists move and are opened where they are added up


def test_interactions_are_read_once(spark):
    seen = spark.range(40).select((F.col("id") % 5).alias("user_id"), (F.col("id") % 7).alias("item_id"))
    assert "Range" not in _plan(graph.adjacency(seen))  # the pairs are stored, not found anew for either degree and the edges
