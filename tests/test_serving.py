"""Bundles, rule scores, snapshots and lineage on small seeds."""

import re

import pytest
from pyspark.sql import functions as F

from clickloom.operators import bundle, candidates, diagnose, feedback, rule, snapshots

USER = "user_id string, total_pv long, total_click long, total_cart long, total_fav long, total_buy long, active_days long, user_age int, user_city string, user_level int, update_ts long"
ITEM = "item_id string, total_detail_click long, total_buy long, total_cart long, total_fav long, uv long, conversion_rate double, category_id int, item_brand string, item_price double"
SEQ = "key string, members array<struct<member: string, ts: long>>"


def empty(spark, schema):
    return spark.createDataFrame([], schema)


@pytest.fixture(scope="module")
def stores(spark):
    return {
        "user_feature": spark.createDataFrame([("U000001", 10, 5, 2, 1, 0, 3, 25, "上海", 2, 1_700_000_000_000)], USER),
        "user_stat": spark.createDataFrame([("U000001", 3.0, 7.5, 5.0, 12.0)], "uid string, click_5min double, click_1h double, pv_5min double, pv_1h double"),
        "item_feature": spark.createDataFrame([("I0000001", 50, 5, 8, 3, 40, 0.1, 7, "Nike", 299.0)], ITEM),
        "item_stat": spark.createDataFrame([("I0000001", 2.0, 15.0)], "item_id string, click_5min double, click_1h double"),
        "dim_item": spark.createDataFrame([("I0000999", 12, "Adidas", 599.0)], "item_id string, category_id int, brand string, price double"),
        "cross": spark.createDataFrame([("U000001", 7, 5.1234, 2.5, 1.0, 0.5)], "uid string, category_id int, pv_cnt double, click_cnt double, cart_cnt double, buy_cnt double"),
        "user_item_window": spark.createDataFrame([("U000001", 7, 13, 1, 0, 0)], "user_id string, category_id int, show_count long, click_count long, cart_count long, buy_count long"),
    }


def test_bundle(spark, stores):
    pairs = spark.createDataFrame([("U000001", "I0000001"), ("U000001", "I0000999"), ("U9", "I9")], "uid string, item_id string")
    got = {(r.uid, r.item_id): r for r in bundle.assemble_bundle(pairs, **stores).collect()}
    known = got[("U000001", "I0000001")]
    assert (known.u_total_pv, known.u_city, known.u_click_1h, known.i_uv, known.i_brand) == (10, "上海", 7.5, 40, "Nike")
    assert (known.x_pv_cnt, known.w_show_cnt, known.i_click_1h) == (5.1234, 13, 15.0)
    cold = got[("U000001", "I0000999")]
    assert (cold.i_category_id, cold.i_brand, cold.i_price, cold.i_total_buy, cold.x_pv_cnt) == (12, "Adidas", 599.0, 0, 0.0)
    ghost = got[("U9", "I9")]
    assert (ghost.u_total_pv, ghost.u_city, ghost.i_brand, ghost.i_price) == (0, "", "", 0.0)


def test_pairs_dealt_by_user_are_ranked_where_they_lie(spark, stores):
    rows = [(f"r{n}", "U000001", f"I000000{n}", n) for n in range(1, 4)]
    pairs = spark.createDataFrame(rows, "req_id string, uid string, item_id string, place int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = bundle.assemble_bundle(pairs, **stores, tasks=11).withColumn("in_seq", F.lit(0.0))
        request = ["uid", "req_id"]
        out = rule.recommend_rank(rule.minmax_normalise(rule.rule_score(out), by=request), by=request)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {r.item_id: (r.x_click_cnt, r.w_show_cnt, r.rank) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {"I0000001": (2.5, 13, 1), "I0000002": (0.0, 0, 1), "I0000003": (0.0, 0, 1)}
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert [d for d in dealt if d.startswith("uid#") and d.endswith(", 11")]
    assert not [d for d in dealt if "i_category_id" in d or "req_id" in d]


def test_tasks_of_a_pool_grow_with_the_requests(spark):
    asked = spark.range(1_000).select(F.lit(10).alias("top_k"))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert candidates.pool_tasks(asked.limit(1)) == candidates.pool_tasks(asked.limit(0)) == least
    assert candidates.pool_tasks(asked, per_task=100) == 500


def scored(spark, rows):
    df = spark.createDataFrame(rows, "req_id string, uid string, item_id string, place int, i_conversion_rate double, x_click_cnt double, x_buy_cnt double, in_seq double, i_click_1h double")
    return rule.recommend_rank(rule.minmax_normalise(rule.rule_score(df))).orderBy("rank").collect()


def test_rule_scores(spark):
    rows = [("r", "u", f"I{i}", i, 0.05 * i, 0.5, 0.0, float(i == 3), 5.0 * i) for i in range(1, 6)]
    out = scored(spark, rows)
    assert all(0.0 <= r.score <= 1.0 for r in out) and out[0].score == 1.0 and out[-1].score == 0.0
    assert [r.score for r in out] == sorted((r.score for r in out), reverse=True)
    for r in out:
        assert sum(r.feature_contributions.values()) == pytest.approx(1.0, abs=1e-3)


def test_all_equal_scores_are_one_half_and_keep_the_order(spark):
    out = scored(spark, [("r", "u", f"I{i}", i, 0.0, 0.0, 0.0, 0.0, 0.0) for i in range(3)])
    assert [(r.item_id, r.score) for r in out] == [("I0", 0.5), ("I1", 0.5), ("I2", 0.5)]
    assert set(out[0].feature_contributions.values()) == {0.0}


SNAP = (
    "req_id string, uid string, ts long, expires_at long, candidates array<string>, scores array<struct<item_id: string, "
    "score: double, feature_contributions: map<string,double>, item_brand: string, item_price: double, category_id: int>>"
)


def test_lineage_takes_the_newest_snapshot(spark):
    entry = [("I1", 0.9, {"conversion_rate": 1.0}, "b", 1.0, 1)]
    snaps = spark.createDataFrame(
        [
            ("req_older", "U1", 1_710_000_000_000, 2_000_000_000_000, ["I1"], entry),
            ("req_newer", "U1", 1_720_000_000_000, 2_000_000_000_000, ["I1", "I2"], entry),
            ("req_gone", "U1", 1_730_000_000_000, 1_730_000_000_001, ["I1"], entry),
        ],
        SNAP,
    )
    clicks = spark.createDataFrame([("U1", [("I7", 300), ("I8", 200)])], SEQ)
    pairs = spark.createDataFrame([("U1", "I1"), ("U1", "I5")], "uid string, item_id string")
    got = {r.item_id: r for r in snapshots.lineage_trace(pairs, snaps, clicks, 1_740_000_000_000).collect()}
    assert got["I1"].req_id == "req_newer" and got["I1"].seq_items == ["I7", "I8"]
    assert got["I5"].req_id is None and got["I5"].contributing_features == {}
    lookups = spark.createDataFrame([("req_newer", "I1"), ("req_newer", "I2"), ("nope", "I1")], "req_id string, item_id string")
    hits = {(r.req_id, r.item_id): r for r in snapshots.snapshot_lookup(lookups, snaps).collect()}
    assert hits[("req_newer", "I1")].score == 0.9
    assert hits[("req_newer", "I2")].feature_contributions == {} and hits[("nope", "I1")].uid is None


def test_events_change_features(spark, stores):
    users = spark.createDataFrame([("U1", 0, 8, 0, 0, 0, 0, 0, "", 0, 0)], USER)
    items = spark.createDataFrame([("I1", 10, 2, 0, 0, 0, 0.2, 1, "b", 1.0), ("I2", 10, 2, 0, 0, 0, 0.2, 1, "b", 1.0)], ITEM)
    events = spark.createDataFrame(
        [("U1", "I1", "click", 5), ("U1", "I2", "buy", 6), ("U1", "I1", "share", 7)], "uid string, item_id string, bhv_type string, ts long"
    )
    assert feedback.apply_to_users(users, events).first().total_click == 9
    got = {r.item_id: r for r in feedback.apply_to_items(items, events).collect()}
    assert (got["I1"].total_detail_click, got["I1"].conversion_rate) == (11, 0.2)
    assert (got["I2"].total_buy, got["I2"].conversion_rate) == (3, 0.3)
    seq = spark.createDataFrame([("U1", [("I9", 1)])], SEQ)
    assert [m.member for m in feedback.apply_to_clicks(seq, events).first().members] == ["I1", "I9"]


def test_freshness_and_sparsity(spark, stores):
    users = spark.createDataFrame([("U000001",), ("U2",)], "uid string")
    now = 1_700_000_000_000 + 599_000
    got = {r.uid: r.status for r in diagnose.feature_freshness(users, stores["user_feature"], now).collect()}
    assert got == {"U000001": "fresh", "U2": "unknown"}
    assert diagnose.feature_freshness(users, stores["user_feature"], now + 2_000).where("uid = 'U000001'").first().status == "stale"
    seq = spark.createDataFrame([("U000001", [("I1", 1)])], SEQ)
    cold = {r.uid: (r.cold, r.verdict) for r in diagnose.feature_sparsity(users, stores["user_feature"], seq).collect()}
    assert cold == {"U000001": (True, "normal"), "U2": (True, "cold_start")}
    colour = spark.createDataFrame([(10, 20), (400, 20), (10, 5), (10, 0), (2_000, 20)], "age long, n long").select(diagnose.health_colour("age", "n")).collect()
    assert [r[0] for r in colour] == ["green", "yellow", "yellow", "red", "red"]


def test_decode_text_features(spark):
    names = [*bundle.USER_COUNTS, "user_age", "user_level", "user_city"]
    schema = ", ".join(f"{n} string" for n in ["user_id", *names])
    raw = spark.createDataFrame([("U1", "10", "x", "3.0", "1", "0", "2", "30", "1", None)], schema)
    row = bundle.decode_user_feature(raw).first()
    assert (row.total_pv, row.total_click, row.total_cart, row.total_fav, row.user_city) == (10, 0, 0, 1, "")
