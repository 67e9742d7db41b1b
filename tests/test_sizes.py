"""What is sent to every task is small by measure, and work is dealt so that no task has it all."""

import numpy as np
import pandas as pd
from pyspark.ml.classification import FMClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from clickloom.llm import divergence
from clickloom.operators import cf_update, content, crossed, encode, mmr


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("\n")


def test_exploded_stripes_are_not_broadcast(spark, monkeypatch):
    rows = [(f"word{i % 7} word{i % 3} other", "en", f"s{i % 4}") for i in range(60)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    small = divergence.divergences(docs, least_docs=2)
    want = sorted(map(tuple, small.collect()))

    def under_broadcast(lines):
        found = []
        for n, line in enumerate(lines):
            if "BroadcastExchange" in line:
                depth = line.index("BroadcastExchange")
                for below in lines[n + 1 :]:
                    if len(below) - len(below.lstrip(" :+-*")) <= depth:
                        break
                    found.append(below)
        return found

    assert not any("Generate explode" in x for x in under_broadcast(_plan(small)))
    monkeypatch.setattr(divergence, "_broadcast_if_small", lambda groups: groups.hint("merge"))
    large = divergence.divergences(docs, least_docs=2)
    assert not any("BroadcastExchange" in x for x in _plan(large))
    assert sorted(map(tuple, large.collect())) == want


def test_reranked_batches_equal_single_requests(spark):
    rng = np.random.default_rng(3)
    rows = []
    for request in [None, 0, 1, 2, 3, 4, 5]:
        for item in rng.choice(1000, 1 if request == 3 else 70, replace=False).tolist():
            vector = None if rng.random() < 0.1 else rng.normal(size=8).tolist()
            rows.append((request, item, float(np.round(rng.random(), 1)), vector))
    df = spark.createDataFrame(rows, "request_id long, item_id long, relevance double, vector array<double>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {(r["request_id"], r["position"]): (r["item_id"], r["mmr"]) for r in mmr.mmr_rerank(df.coalesce(1)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for request in {r[0] for r in rows}:
        pdf = pd.DataFrame([r[1:] for r in rows if r[0] == request], columns=["item_id", "relevance", "vector"])
        pdf["request_id"] = -1 if request is None else request
        for r in mmr.greedy_mmr(pdf).itertuples():
            want[request, r.position] = (r.item_id, r.mmr)
    assert got == want
    assert "mapInArrow" in " ".join(_plan(mmr.mmr_rerank(df))) or "MapInArrow" in " ".join(_plan(mmr.mmr_rerank(df)))


def test_unknown_relevance_has_no_value(spark):
    df = spark.createDataFrame([(1, 5, None, [1.0, 0.0]), (1, 6, None, None)], "request_id long, item_id long, relevance double, vector array<double>")
    assert [(r["item_id"], r["position"], r["mmr"]) for r in mmr.mmr_rerank(df).collect()] == [(5, 1, None), (6, 2, None)]


def test_crossed_models_equal_those_of_spark(spark):
    rng = np.random.default_rng(1)
    rows = []
    for j in range(200):
        at = sorted(rng.choice(30, 5, replace=False).tolist())
        vector = Vectors.sparse(30, at, rng.normal(size=5)) if j % 5 else Vectors.dense(rng.normal(size=30) * (rng.random(30) < 0.7))
        rows.append((vector, int(rng.random() < 0.4), int(rng.random() < 0.7)))
    df = spark.createDataFrame(rows, ["features", "a", "b"]).repartition(3)
    options = {"factorSize": 3, "maxIter": 4, "stepSize": 0.05, "regParam": 0.01, "seed": 42}
    found = crossed.fit_crossed(df, ["a", "b"], **options)
    for task in ("a", "b"):
        want = FMClassifier(**options).fit(df.select("features", F.col(task).cast("double").alias("label")))
        assert np.abs(want.factors.toArray() - found[task].factors.toArray()).max() < 1e-12
        assert np.abs(want.linear.toArray() - found[task].linear.toArray()).max() < 1e-12
        assert abs(want.intercept - found[task].intercept) < 1e-12


def test_users_of_one_taste_are_many_tasks(spark):
    users = spark.range(5000).select(F.when(F.col("id") > 0, F.col("id")).alias("user_id"), F.lit("A;B").alias("taste"))
    index = spark.createDataFrame([("A", 1), ("A", 2), ("B", 2), ("B", 3)], "entry string, item_id long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = content.entry_recall(users, index, "taste").withColumn("_p", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(rows) == 15000 and len({(r["user_id"], r["item_id"]) for r in rows}) == 15000
    assert len({r["_p"] for r in rows}) > 4


def test_union_of_channels_names_them_in_order(spark):
    one = spark.createDataFrame([(1, 1), (1, 1), (1, None), (None, 2)], "user_id long, item_id long")
    two = spark.createDataFrame([(1, 1), (None, 2), (2, 2)], "user_id long, item_id long")
    found = content.recall_union({"z": one, "a": two})
    got = {(r["user_id"], r["item_id"]): r["channels"] for r in found.collect()}
    assert got == {(1, 1): ["a", "z"], (1, None): ["z"], (None, 2): ["a", "z"], (2, 2): ["a"]}
    assert "ObjectHashAggregate" not in " ".join(_plan(found))


def test_touched_members_meet_untouched_ones_only(spark, monkeypatch):
    cells = [(g, m, 1.0 + (g * m) % 3) for g in range(12) for m in range(10) if (g + m) % 3]
    more = cells + [(20, m, 1.0) for m in range(8)]

    def tables(rows):
        df = spark.createDataFrame(rows, "grp long, member long, weight double")
        return df, df.groupBy("member").agg(F.sum(F.col("weight") * F.col("weight")).alias("norm"))

    met = []
    whole = cf_update.pair_sums

    def watched(some, others, *a, **k):
        met.append(({r["member"] for r in some.collect()}, {r["member"] for r in others.collect()}))
        return whole(some, others, *a, **k)

    monkeypatch.setattr(cf_update, "pair_sums", watched)
    old = cf_update.fit_side(*tables(cells), 3)
    new, _ = cf_update.update_side(old, *tables(more), 3)
    want = cf_update.fit_side(*tables(more), 3)
    as_rows = lambda side: {(r["member"], r["other"], r["rank"], round(r["sim"], 9)) for r in side.partners.collect()}
    assert as_rows(new) == as_rows(want)
    assert met == [(set(range(8)), {8, 9})]


def test_small_vocabularies_are_broadcast(spark):
    rows = spark.range(100).select(F.concat(F.lit("n"), F.col("id") % 7).alias("name"))
    vocab = encode.vocabulary(rows, "name")
    plan = " ".join(_plan(encode.encode(rows, "name", encode.small_or_whole(vocab), "idx")))
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert "BroadcastHashJoin" not in encode.small_or_whole(vocab, 0)._jdf.queryExecution().toString()
