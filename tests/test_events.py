"""Hand-written events, and closed forms against a plain fold over the events."""

import math
import random

import pytest
from pyspark.sql import functions as F

from clickloom import schemas
from clickloom.functions import scalars as S
from clickloom.operators import cumulative, decay, enrich, sequences, sliding, windows

T0 = 1_704_067_200_000
FORCE = {"at_most": 10**6, "min_rows": 0}  # every key counts as hot


def event(uid, ts, kind="show", value=None, page="home", src="direct", items=None, item=None, req=None, query=None, arrival=0):
    ext = (items and [(i, n) for n, i in enumerate(items)], item, None, query)
    return (uid, f"log{arrival}", req, None, page, src, kind, value, ts, ext, arrival)


def behavior(spark, events):
    rows = [e[:-1] + (n,) for n, e in enumerate(events)]
    return spark.createDataFrame(rows, schemas.BEHAVIOR)


def random_events(n, seed):
    rng = random.Random(seed)
    ts, out = T0, []
    for _ in range(n):
        ts += rng.choice([1, 500, 20_000, 60_000 - ts % 60_000, 400_000])
        uid = "U1" if rng.random() < 0.4 else f"U{rng.randint(2, 5)}"
        item = f"I{rng.randint(1, 12):07d}"
        roll = rng.random()
        req = rng.choice([None, "a", "b", "c"])
        if roll < 0.4:
            shown = [f"I{rng.randint(1, 12):07d}" for _ in range(rng.randint(0, 3))]
            out.append(event(uid, ts, "show", page=rng.choice(["home", "search"]), items=shown, req=req, query="q"))
        else:
            value = rng.choice([None, "cart", "fav", "buy"])
            out.append(event(uid, ts, "click", value, "pdp" if value else "home", item=item, req=req))
    return out


@pytest.fixture(scope="module")
def dwd(spark):
    users = spark.createDataFrame([("U1", 0, "A", 2), ("U2", 30, "B", 3)], schemas.DIM_USER)
    items = spark.createDataFrame([(f"I{i:07d}", 9, f"brand{i % 3}", 1.5 * i) for i in range(1, 10)], schemas.DIM_ITEM)
    return enrich.enrich(behavior(spark, random_events(400, 7)), users, items).cache()


def same(a, b):
    cols = sorted(a.columns)

    def rows(df):
        return sorted(
            (tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect()), key=repr
        )

    assert rows(a) == rows(b)


def test_derive_category(spark):
    ids = ["I0000001", "I0000050", "I0000051", "I0000000", "I", None, "Ixx", "I99999999999", "I 7"]
    rows = spark.createDataFrame([(i,) for i in ids], "item_id string").select(S.derive_category("item_id")).collect()
    assert [r[0] for r in rows] == [1, 50, 1, 0, 0, 0, 0, 0, 0]


def test_safe_int(spark):
    rows = spark.createDataFrame([("3",), ("3.0",), ("x",), (None,), ("-4",)], "v string").select(S.safe_int("v", 7)).collect()
    assert [r[0] for r in rows] == [3, 7, 7, 7, -4]


def test_enrich_rules(spark):
    users = spark.createDataFrame([("U1", 25, "A", 2)], schemas.DIM_USER)
    items = spark.createDataFrame([("I0000001", 9, "Nike", 10.0)], schemas.DIM_ITEM)
    events = [
        event("U1", T0, items=["I0000001", "I0000002"]),
        event("U1", T0, page="search", items=["I0000001"], query="shoe"),
        event("U9", T0, items=[]),
        event("U1", T0, "click", item="I0000001"),
        event("U1", T0, "click", item=""),
        event("U1", T0, "click", item="I0000002"),
    ]
    rows = enrich.enrich(behavior(spark, events), users, items).orderBy("arrival", "pos").collect()
    got = [(r.arrival, r.item_id, r.category_id, r.item_brand, r.item_price, r.user_city) for r in rows]
    assert got == [
        (0, "I0000001", 1, "Nike", 10.0, "A"),
        (0, "I0000002", 2, "unknown", 0.0, "A"),
        (1, "I0000001", 1, None, 0.0, "A"),
        (2, None, 0, None, 0.0, "unknown"),
        (3, "I0000001", 1, "Nike", 10.0, "A"),
        (4, None, 0, None, 0.0, "A"),
        (5, "I0000002", 2, "unknown", 0.0, "A"),
    ]
    assert rows[2].bhv_ext.query == "shoe" and rows[2].bhv_ext["items"] is None
    degraded = enrich.enrich(behavior(spark, events)).orderBy("arrival", "pos").collect()
    assert [r.item_brand for r in degraded] == [None, None, None, None, "unknown", "unknown", "unknown"]


def test_funnel_keeps_all_zero_windows_and_counts_values_anywhere(spark):
    events = [
        event("U1", T0, "click", page="pdp", src="home", item="I0000001"),
        event("U1", T0 + 60_000, "click", "cart", page="home", item="I0000001"),
        event("U1", T0 + 120_000, "click", "buy", page="pdp", src="search", item="I0000001"),
    ]
    out = windows.home_funnel_window(enrich.enrich(behavior(spark, events))).orderBy("window_start").collect()
    assert [tuple(r)[2:] for r in out] == [
        (T0, T0 + 60_000, 0, 0, 0, 0, 0),
        (T0 + 60_000, T0 + 120_000, 0, 0, 1, 0, 0),
    ]


def test_consecutive_page_views(spark):
    events = [event("U1", T0 + i, req=r, items=["I0000001"]) for i, r in enumerate(["A", "A", "B", None, "B", "A"])]
    rows = enrich.enrich(behavior(spark, events))
    for options in ({}, FORCE):
        assert cumulative.user_total_pv(rows, **options).collect()[0].total_pv == 3
    assert cumulative.user_total_pv(rows, mode="distinct").collect()[0].total_pv == 2


def test_hot_keys_give_the_same_features(dwd):
    same(cumulative.user_features(dwd), cumulative.user_features(dwd, **FORCE))
    same(cumulative.user_feature_changes(dwd), cumulative.user_feature_changes(dwd, **FORCE))
    same(cumulative.item_feature_changes(dwd), cumulative.item_feature_changes(dwd, **FORCE))


@pytest.mark.parametrize("clock", ["shared", "per_counter"])
def test_decay_matches_the_fold(dwd, clock):
    want = {}
    rows = dwd.withColumn("kind", S.event_kind()).where("kind IS NOT NULL").orderBy("ts", "arrival", "pos").collect()
    rate = math.log(2) / (7 * 86_400_000)
    for r in rows:
        counts, clocks = want.setdefault((r.uid, r.category_id), ({}, {}))
        tick = "all" if clock == "shared" else r.kind
        gap = max(0, r.ts - clocks.get(tick, r.ts))
        counts[r.kind] = counts.get(r.kind, 0.0) * math.exp(-rate * gap) + 1
        clocks[tick] = r.ts
    for options in ({}, FORCE):
        got = decay.decayed_cross_category(dwd, clock=clock, **options).collect()
        assert len(got) == len(want)
        for r in got:
            counts = want[(r.uid, r.category_id)][0]
            for k in decay.CATEGORY_KINDS:
                assert r[f"{k}_cnt"] == pytest.approx(counts.get(k, 0.0), abs=1e-9)


def test_sliding_matches_the_fold(dwd):
    rows = dwd.withColumn("kind", S.event_kind()).where("kind IN ('pv', 'click')").orderBy("ts", "arrival", "pos").collect()
    buckets, want = {}, {}
    for r in rows:
        mine = buckets.setdefault(r.uid, {})
        b = mine.setdefault(r.ts // 60_000 * 60_000, {"pv": 0, "click": 0})
        b[r.kind] += 1
        want[(r.uid, r.ts, r.arrival, r.pos)] = tuple(
            sum(v[m] for s, v in mine.items() if s >= r.ts - span) for m in ("pv", "click") for span in (300_000, 3_600_000)
        )
    got = {tuple(r)[:4]: tuple(r)[4:] for r in sliding.user_sliding_stat(dwd).collect()}
    assert got == want
    last = {k[0]: v for k, v in sorted(want.items(), key=lambda kv: kv[0][1:])}
    latest = {r.uid: (r.pv_5min, r.pv_1h, r.click_5min, r.click_1h) for r in sliding.latest_stat(dwd, ["uid"]).collect()}
    assert latest == last


def test_a_hot_second_is_counted_in_blocks(spark):
    """All events of one item in one second, after an hour of others: tiny blocks give what one sort gives."""
    rng = random.Random(3)
    events = [event("U1", T0 + 3_600_000 + rng.randrange(1_000), rng.choice(["show", "click"]), items=["I0000001"], item="I0000001", req=rng.choice("ab"))
              for _ in range(300)]
    events += [event("U1", T0 + 60_000 * m, "click", item="I0000001") for m in range(0, 61, 3)]
    rows = enrich.enrich(behavior(spark, events)).cache()
    whole = sliding.sliding_stat(rows, ["item_id"], blocks=1)
    assert whole.agg(F.max("pv_5min") + F.max("click_5min")).first()[0] == 302
    for blocks in (7, 60):
        got = sliding.sliding_stat(rows, ["item_id"], blocks=blocks)
        same(got, whole)
        assert got.count() == 321
    same(cumulative.user_feature_changes(rows), cumulative.user_feature_changes(rows, **FORCE))


def test_no_window_of_sliding_counts_is_larger_than_a_block(spark, monkeypatch):
    events = [event("U1", T0 + m, "click", item="I0000001") for m in range(400)]
    kept = []
    monkeypatch.setattr(sliding, "materialise", lambda df: kept.append(df.cache()) or kept[-1])
    sliding.sliding_stat(enrich.enrich(behavior(spark, events)), ["item_id"], blocks=20).collect()
    sizes = [r["count"] for r in kept[0].groupBy("item_id", "minute", "block").count().collect()]
    assert sum(sizes) == 400 and max(sizes) <= 80  # a window is one (key, minute, block)


def test_sequences_are_bounded_and_newest_first(spark):
    events = [event("U1", T0 + i, "click", item=f"I{i % 60:07d}") for i in range(120)]
    seq = sequences.sequence(enrich.enrich(behavior(spark, events)), "click").collect()[0]
    assert [m.member for m in seq.members] == [f"I{i:07d}" for i in range(59, 9, -1)]
    expired = sequences.sequence(enrich.enrich(behavior(spark, events)), "click", as_of_ms=T0 + 8 * S.DAY_MS)
    assert expired.count() == 0


def test_query_is_pushed_once_per_shown_item(spark):
    rows = enrich.enrich(behavior(spark, [event("U1", T0, page="search", items=["I1", "I2", "I3"], query="shoe")]))
    assert sequences.seq_query(rows).select(F.size("members")).first()[0] == 3
    assert sequences.seq_query(rows, dedup="request").select(F.size("members")).first()[0] == 1
