"""Streams drained over several files give the batch results; tables expire and compact."""

import tempfile
import time

import pytest
from pyspark.sql import functions as F

from clickloom import schemas, session
from clickloom.operators import cumulative, decay, enrich, sequences, sliding, windows
from clickloom.sources import feature_store, tables
from clickloom.streaming import events, jobs, stateful
from tests.test_events import T0, behavior, event, random_events, same


@pytest.fixture(scope="module")
def files(spark):
    """Three files of item-level rows in arrival order."""
    path = tempfile.mkdtemp(prefix="clickloom-tests-")
    rows = enrich.enrich(behavior(spark, random_events(300, 11)))
    rows = rows.select(*[f.name for f in schemas.BEHAVIOR_DIM.fields]).cache()
    for part in range(3):
        rows.where(F.floor(F.col("arrival") / 100) == part).coalesce(1).write.mode("append").parquet(path)
    return path, rows


def streamed(spark, path):
    return tables.stream_behavior_dim(spark, path, maxFilesPerTrigger=1)


def test_user_features_over_batches(spark, files):
    path, rows = files
    out = jobs.run_to_features(stateful.user_feature_stream(streamed(spark, path)), "t", ["user_id"], ["update_ts"], 10**9)
    same(out, cumulative.user_features(rows).select(*out.columns))


def test_item_features_over_batches(spark, files):
    path, rows = files
    out = jobs.run_to_features(stateful.item_feature_stream(streamed(spark, path)), "i", ["item_id"], ["update_ts"], 10**9)
    same(out, cumulative.item_features(rows).select(*out.columns))


def test_sliding_and_decay_over_batches(spark, files):
    path, rows = files
    out = jobs.run_to_features(stateful.sliding_stat_stream(streamed(spark, path)), "s", ["key"], ["last_ts"], 10**9)
    same(out, sliding.latest_stat(rows, ["uid"]).withColumnRenamed("uid", "key").select(*out.columns))
    out = jobs.run_to_features(stateful.decay_stream(streamed(spark, path), "brand"), "d", ["uid", "entity"], ["last_ts"], 10**9)
    same(out, decay.decayed_cross_brand(rows).withColumnRenamed("brand", "entity").select(*out.columns))


@pytest.mark.parametrize("name", [*sequences.SEQUENCES, "query"])
def test_sequences_over_batches_and_compaction(spark, files, name):
    path, rows = files
    want = sequences.seq_query(rows) if name == "query" else sequences.sequence(rows, name)
    target = tempfile.mkdtemp(prefix="clickloom-tests-")
    jobs.start_sequences(
        streamed(spark, path), name, f"{target}/data", f"{target}/checkpoint", merge_every=1, availableNow=True
    ).awaitTermination()
    got = {r["key"]: r["members"] for r in jobs.read_sequences(spark, name, f"{target}/data").collect()}
    ttl = sequences.QUERY_TTL_MS if name == "query" else sequences.SEQUENCES[name][3]
    every = {r["key"]: r for r in want.collect()}
    now = max(r["last_ts"] for r in every.values())
    # merges let go of keys whose life ended; one that came back starts anew, all others are whole
    assert set(got) == {k for k, r in every.items() if r["last_ts"] + ttl >= now}
    for key, members in got.items():
        assert members == every[key]["members"][: len(members)]
        times = [m["ts"] for m in every[key]["members"]]
        assert len(members) == len(times) or any(a - b > ttl for a, b in zip(times, times[1:]))
    # what the two newest merges name, and the batches after the older one
    assert sorted(session.names_in(spark, f"{target}/data/manifests")) == ["1.json", "2.json"]
    assert [n for n in session.names_in(spark, f"{target}/data/batches") if n.startswith("batch_id")] == ["batch_id=2"]


def test_tumbling_windows_are_final(spark, files):
    path, rows = files
    out = jobs.run_to_table(events.tumbling_minute(streamed(spark, path)), "w")
    want = windows.home_funnel_window(rows)
    top = rows.where("bhv_page = 'home' OR (bhv_page = 'pdp' AND bhv_src = 'home')").agg(F.max("ts")).first()[0]
    same(out, want.where(F.col("window_end") <= top - 10_000))


def test_split_late(spark):
    ts = [T0, T0 + 120_000, T0 + 59_000, T0 + 69_000, T0 + 70_000, T0 + 1_000]
    rows = spark.createDataFrame(list(enumerate(ts)), "arrival long, ts long")
    for size in (1, 2, 1 << 20):
        on_time, late = events.split_late(rows, slice_rows=size)
        assert sorted(r.arrival for r in late.collect()) == [2, 5]
        assert on_time.count() == 4


def test_late_split_on_a_running_stream(spark):
    """Batch borders do not matter: the split equals the one over all rows at once."""
    path, target = (tempfile.mkdtemp(prefix="clickloom-tests-") for _ in range(2))
    ts = [T0, T0 + 120_000, T0 + 59_000, T0 + 69_000, T0 + 70_000, T0 + 1_000, T0 + 300_000, T0 + 170_000, T0 + 290_000]
    rows = spark.createDataFrame(list(enumerate(ts)), "arrival long, ts long")

    def run():
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
        jobs.start_late_split(stream, f"{target}/d", f"{target}/c", availableNow=True).awaitTermination()

    for part in range(3):  # one start per file, each from the checkpoint
        rows.where(F.floor(F.col("arrival") / 3) == part).coalesce(1).write.mode("append").parquet(path)
        run()
    for got, want in zip((jobs.read_split(spark, f"{target}/d", side) for side in (False, True)), events.split_late(rows)):
        same(got, want)


def test_a_failed_batch_is_repeated_after_a_restart(spark, files):
    path, rows = files
    target = tempfile.mkdtemp(prefix="clickloom-tests-")
    broken = []

    def write(batch, batch_id):
        batch = batch.select("uid", "ts", "arrival")
        feature_store.upsert_batch(batch, f"{target}/d", batch_id, ["uid"], ["arrival"], F.col("ts"), 10**9, merge_every=2)
        if batch_id == 1 and not broken:
            broken.append(batch_id)
            raise RuntimeError("lost after the write, before the commit")

    def run():
        jobs.start_batches(streamed(spark, path), write, f"{target}/c", availableNow=True).awaitTermination()

    with pytest.raises(Exception, match="lost after the write"):
        run()
    run()
    got = feature_store.read_features(spark, f"{target}/d", ["uid"]).select("uid", "arrival", "ts")
    same(got, feature_store.latest_per_key(rows.select("uid", "ts", "arrival"), ["uid"], ["arrival"]))


def test_a_rewritten_dimension_is_seen_by_the_next_batch(spark):
    path, target = (tempfile.mkdtemp(prefix="clickloom-tests-") for _ in range(2))

    def arrive(n):
        behavior(spark, [event("U1", T0 + n, "click", item="I0000001")]).coalesce(1).write.mode("append").parquet(path)

    def dims(brand):
        tables.write_dims(spark.createDataFrame([("I0000001", 9, brand, 1.5)], schemas.DIM_ITEM), f"{target}/dim")

    arrive(0)
    dims("old")
    stream = tables.stream_behavior(spark, path, "parquet", maxFilesPerTrigger=1)
    job = jobs.start_enriched(
        stream, lambda s: s.createDataFrame([], schemas.DIM_USER),
        lambda s: tables.read_dims(s, f"{target}/dim", schemas.DIM_ITEM), f"{target}/d", f"{target}/c",
        lambda r: r.select("ts", "item_brand"), processingTime="0 seconds",
    )
    try:
        job.processAllAvailable()
        dims("new")
        arrive(1)
        job.processAllAvailable()
    finally:
        job.stop()
    got = feature_store.current_rows(spark, f"{target}/d").collect()
    assert {r.ts - T0: r.item_brand for r in got} == {0: "old", 1: "new"}


def test_one_user_in_every_row(spark):
    path = tempfile.mkdtemp(prefix="clickloom-tests-")
    rows = enrich.enrich(behavior(spark, random_events(600, 5))).withColumn("uid", F.lit("U1"))
    rows = rows.select(*[f.name for f in schemas.BEHAVIOR_DIM.fields]).cache()
    for part in range(2):
        rows.where(F.floor(F.col("arrival") / 300) == part).coalesce(1).write.mode("append").parquet(path)
    out = jobs.run_to_features(stateful.user_feature_stream(streamed(spark, path)), "t", ["user_id"], ["update_ts"], 10**9)
    same(out, cumulative.user_features(rows).select(*out.columns))
    out = jobs.run_to_features(stateful.decay_stream(streamed(spark, path)), "d", ["uid", "entity"], ["last_ts"], 10**9)
    want = decay.decayed_cross_category(rows).withColumn("entity", F.col("category_id").cast("string"))
    same(out, want.select(*out.columns))


def test_feature_table(spark):
    path, target = (tempfile.mkdtemp(prefix="clickloom-tests-") for _ in range(2))
    for batch, rows in enumerate([[("a", 1, 10), ("b", 1, 10)], [("a", 2, 20), ("a", 3, 30)]]):
        df = spark.createDataFrame(rows, "k string, v long, ts long")
        for _ in range(2):  # a replayed batch replaces itself
            feature_store.upsert_batch(df, path, batch, ["k"], ["ts"], 1_000 * (batch + 1), 500)
    assert {r.k: r.v for r in feature_store.read_features(spark, path, ["k"]).collect()} == {"a": 3, "b": 1}
    assert [r.k for r in feature_store.read_features(spark, path, ["k"], as_of_ms=2_000).collect()] == ["a"]
    feature_store.compact(spark, path, f"{target}/t", ["k"])
    assert {r.k: r.v for r in feature_store.read_features(spark, f"{target}/t", ["k"]).collect()} == {"a": 3, "b": 1}


def upsert(spark, path, batch, rows, write_ms, ttl_ms=10**6, **how):
    df = spark.createDataFrame(rows, "k string, v long, ts long")
    feature_store.upsert_batch(df, path, batch, ["k"], ["ts"], write_ms, ttl_ms, **how)


def bucket_files(spark, path):
    """File names of every bucket the newest manifest names."""
    now = feature_store.manifest(spark, path)
    folders = {b: f"{path}/base/{n}/hash_bucket={b}" for b, (n, _, _) in now.base.items()}
    return {b: sorted(n for n in session.names_in(spark, f) if n.endswith(".parquet")) for b, f in folders.items()}


def test_a_merge_rewrites_touched_buckets_only(spark):
    path = tempfile.mkdtemp(prefix="clickloom-tests-")
    how = {"merge_every": 2, "buckets": 16}
    keys = [f"k{i}" for i in range(200)]
    want = {}
    for batch in range(8):
        some = keys if batch < 4 else keys[:2]
        upsert(spark, path, batch, [(k, batch, batch) for k in some], 1_000 + batch, **how)
        want |= {k: batch for k in some}
        if batch == 3:
            before = bucket_files(spark, path)
            assert len(before) == 16
    after = bucket_files(spark, path)
    rewritten = [b for b in after if after[b] != before[b]]
    touched = {r[0] for r in spark.createDataFrame([(k,) for k in keys[:2]], "k string").select(F.pmod(F.xxhash64("k"), F.lit(16))).collect()}
    assert {int(b) for b in rewritten} == touched and len(rewritten) <= 2
    got = feature_store.read_features(spark, path, ["k"]).collect()
    assert {r.k: r.v for r in got} == want
    # runs are gone once they are in the base; only what the two newest manifests name is left
    assert feature_store.manifest(spark, path).runs == []
    assert len(session.names_in(spark, f"{path}/manifests")) == 2


def test_an_expired_key_vanishes_with_a_merge(spark):
    path = tempfile.mkdtemp(prefix="clickloom-tests-")
    how = {"ttl_ms": 5, "merge_every": 2, "buckets": 1}
    for batch, (k, at) in enumerate([("old", 100), ("kept", 120), ("kept", 121), ("new", 122)]):
        upsert(spark, path, batch, [(k, batch, batch)], at, **how)
    assert {r.k for r in feature_store.current_rows(spark, path).collect()} == {"kept", "new"}
    # a bucket whose keys all ended goes without being read
    path = tempfile.mkdtemp(prefix="clickloom-tests-")
    how["buckets"] = 64
    for batch in range(4):
        upsert(spark, path, batch, [(f"k{i}", batch, batch) for i in range(100)], 100 + batch, **how)
    for batch in range(4, 8):
        upsert(spark, path, batch, [("late", batch, batch)], 1_000, **how)
    assert len(feature_store.manifest(spark, path).base) == 1
    assert [r.k for r in feature_store.read_features(spark, path, ["k"]).collect()] == ["late"]


def test_a_key_lives_on_when_an_older_row_would_have_ended(spark):
    """Only the newest row decides: a key renewed late stays, one whose newest row ended goes, older rows do not come back."""
    path = tempfile.mkdtemp(prefix="clickloom-tests-")
    for batch, rows in enumerate([[("a", 1, 1), ("b", 1, 1)], [("a", 2, 2)], [("c", 3, 3)], [("c", 4, 4)]]):
        upsert(spark, path, batch, rows, [100, 106, 107, 108][batch], ttl_ms=5, merge_every=2, buckets=2)
    assert {r.k: r.v for r in feature_store.read_features(spark, path, ["k"]).collect()} == {"a": 2, "c": 4}


def test_each_key_is_flushed_by_its_own_timer(spark):
    path, target = (tempfile.mkdtemp(prefix="clickloom-tests-") for _ in range(2))

    def arrive(uid, items, at):
        rows = enrich.enrich(behavior(spark, [event(uid, T0 + at + i, "click", item=f"I{n:07d}") for i, n in enumerate(items)]))
        rows.select(*[f.name for f in schemas.BEHAVIOR_DIM.fields]).coalesce(1).write.mode("append").parquet(path)

    def flushed(key, members):
        for _ in range(240):
            if any(session.finished(spark, f"{target}/d/batches/{n}") for n in session.names_in(spark, f"{target}/d/batches")):
                rows = {r["key"]: r for r in feature_store.read_features(spark, f"{target}/d", ["key"]).collect()}
                if key in rows and rows[key]["members"] == members:
                    return rows
            time.sleep(0.5)
        raise AssertionError(f"{key} was not flushed")

    arrive("U1", [1, 2, 1], 0)
    stream = spark.readStream.schema(schemas.BEHAVIOR_DIM).option("maxFilesPerTrigger", 1).parquet(path)
    job = jobs.start_flushed_sequences(stream, "click", f"{target}/d", f"{target}/c", flush_ms=200, processingTime="100 milliseconds")
    try:
        first = flushed("U1", ["I0000001", "I0000002"])
        assert set(first) == {"U1"}
        arrive("U2", [5], 50)
        second = flushed("U2", ["I0000005"])
        assert second["U1"] == first["U1"] and second["U2"]["flushed_at"] > first["U1"]["flushed_at"]
        arrive("U1", [3], 90)
        last = flushed("U1", ["I0000003", "I0000001", "I0000002"])
        assert last["U2"] == second["U2"]
    finally:
        job.stop()
    every = spark.read.schema(schemas.BEHAVIOR_DIM).parquet(path)
    want = {r["key"]: [m["member"] for m in r["members"]] for r in sequences.sequence(every, "click").collect()}
    assert {k: r["members"] for k, r in last.items()} == want


def test_distinct_users_as_sketches_of_fixed_size(spark):
    """Within 2 % of the exact counts over many batches; the state of a hot item does not grow with its users."""
    path, target = (tempfile.mkdtemp(prefix="clickloom-tests-") for _ in range(2))
    clicks = [event(f"U{u}", T0 + u, "click", item="I0000001") for u in range(8_000)]
    clicks += [event(f"U{u % 40}", T0 + 9_000 + u, "click", item="I0000002") for u in range(400)]
    rows = enrich.enrich(behavior(spark, clicks)).select(*[f.name for f in schemas.BEHAVIOR_DIM.fields]).cache()
    for part in range(5):  # overlapping parts: users come again
        rows.where(F.pmod("arrival", F.lit(5)).isin(part, (part + 1) % 5)).coalesce(1).write.mode("append").parquet(path)
    jobs.start_uv(streamed(spark, path), f"{target}/d", f"{target}/c", merge_every=2, buckets=2, availableNow=True).awaitTermination()
    exact = {r["item_id"]: r["uv"] for r in cumulative.item_uv(rows).collect()}
    found = {r["item_id"]: r["uv"] for r in jobs.read_uv(spark, f"{target}/d").collect()}
    assert found.keys() == exact.keys() and all(abs(found[i] - n) <= max(1, 0.02 * n) for i, n in exact.items())
    sizes = cumulative.uv_sketches(rows.where("item_id = 'I0000001'").limit(4_000)).unionByName(cumulative.uv_sketches(rows.where("item_id = 'I0000001'")))
    a, b = (r["n"] for r in sizes.select(F.length("sketch").alias("n")).collect())
    assert a == b


def test_parse_behavior(spark):
    good = '{"uid": "U1", "ts": 5, "unknown": 1, "bhv_ext": {"items": [{"item_id": "I1", "position": 0}]}}'
    text = spark.createDataFrame([(good,), ("",), (None,), ("{broken",)], "value string")
    rows = tables.parse_behavior(text).collect()
    assert [(r.uid, r._corrupt_record) for r in rows] == [("U1", None), (None, "{broken")]
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.parse_behavior(text, mode="FAILFAST").collect()


def test_keyed_json_and_jdbc_options(spark):
    df = spark.createDataFrame([("U1", 3), (None, 4)], "uid string, category_id int")
    assert [r.key for r in tables.keyed_json(df, "uid", "category_id").collect()] == ["U1_3", "_4"]
    opts = tables.jdbc_options("jdbc:x", "items", "item_id", 0, 100, 8, user="u")
    assert opts["partitionColumn"] == "item_id" and opts["numPartitions"] == "8" and opts["user"] == "u"


def test_late_event_of_a_user_is_kept_in_features(spark):
    rows = enrich.enrich(behavior(spark, [event("U1", T0 + 100, items=["I0000001"]), event("U1", T0, "click", item="I0000001")]))
    assert cumulative.user_last_active(rows).first().last_active_ts == T0
