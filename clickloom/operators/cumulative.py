"""Cumulative user and item features, as final tables and as changelogs.

Order within a key is (ts, arrival, pos). Final tables are grouped aggregates;
only the consecutive-request rule and the changelogs need ordered windows, and
those run on slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.scalars import event_kind, local_day, ratio
from clickloom.operators.slices import (
    HOT_KEYS,
    HOT_ROWS,
    count_changes,
    hot_keys,
    sliced_scan,
    with_slice,
)

ORDER = ["ts", "arrival", "pos"]
ITEM_KINDS = ("click", "buy", "cart", "fav")


def counted_request() -> Column:
    """Request id of a show, the only rows that count towards page views."""
    return F.when(F.col("bhv_type") == "show", F.col("req_id"))


def user_totals(dwd: DataFrame) -> DataFrame:
    kind = event_kind()
    return (
        dwd.where(F.col("uid").isNotNull())
        .groupBy("uid")
        .agg(*[F.count_if(kind == k).alias(f"total_{k}") for k in ("click", "cart", "fav", "buy")])
    )


def user_total_pv(
    dwd: DataFrame,
    mode: str = "consecutive",
    at_most: int = HOT_KEYS,
    min_rows: int = HOT_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Page views per user: shows whose request differs from the one counted before.

    ``mode='distinct'`` counts distinct request ids instead.
    """
    shows = dwd.where(F.col("uid").isNotNull() & counted_request().isNotNull())
    if mode == "distinct":
        return shows.groupBy("uid").agg(F.count_distinct("req_id").alias("total_pv"))
    # all rows of one event carry the same request
    events = shows.where(F.col("pos") == 0).select("uid", "ts", "arrival", "req_id")
    sliced = with_slice(events, ["uid"], at_most=at_most, min_rows=min_rows, hot=hot)
    return count_changes(sliced, ["uid"], ["ts", "arrival"], F.col("req_id"), "total_pv")


def user_active_days(dwd: DataFrame) -> DataFrame:
    return (
        dwd.where(F.col("uid").isNotNull())
        .groupBy("uid")
        .agg(F.count_distinct(local_day("ts")).alias("active_days"))
    )


def user_last_active(dwd: DataFrame) -> DataFrame:
    """Stamp of the event that arrived last."""
    return (
        dwd.where(F.col("uid").isNotNull())
        .groupBy("uid")
        .agg(F.max_by("ts", "arrival").alias("last_active_ts"))
    )


def latch_user_dim(dwd: DataFrame) -> DataFrame:
    """User dimension of the first event with a known age, else of the last event."""
    order = F.struct(*ORDER)
    row = F.struct("user_age", "user_city", "user_level")
    known = F.coalesce(F.col("user_age"), F.lit(0)) != 0
    return (
        dwd.where(F.col("uid").isNotNull())
        .groupBy("uid")
        .agg(F.coalesce(F.min_by(row, F.when(known, order)), F.max_by(row, order)).alias("_d"))
        .select(
            "uid",
            "_d.user_age",
            F.coalesce("_d.user_city", F.lit("unknown")).alias("user_city"),
            "_d.user_level",
        )
    )


def user_features(
    dwd: DataFrame,
    pv_mode: str = "consecutive",
    at_most: int = HOT_KEYS,
    min_rows: int = HOT_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """The user feature table: one grouped pass plus the page-view rule."""
    order = F.struct(*ORDER)
    row = F.struct("user_age", "user_city", "user_level")
    known = F.coalesce(F.col("user_age"), F.lit(0)) != 0
    kind = event_kind()
    base = (
        dwd.where(F.col("uid").isNotNull())
        .groupBy("uid")
        .agg(
            F.coalesce(F.min_by(row, F.when(known, order)), F.max_by(row, order)).alias("_d"),
            *[F.count_if(kind == k).alias(f"total_{k}") for k in ("click", "cart", "fav", "buy")],
            F.max_by("ts", "arrival").alias("last_active_ts"),
            F.count_distinct(local_day("ts")).alias("active_days"),
            F.max("ts").alias("update_ts"),
        )
    )
    pv = user_total_pv(dwd, pv_mode, at_most, min_rows, hot).withColumnRenamed("uid", "_uid")
    return base.join(pv, F.col("uid") == F.col("_uid"), "left").select(
        F.col("uid").alias("user_id"),
        "_d.user_age",
        F.coalesce("_d.user_city", F.lit("unknown")).alias("user_city"),
        "_d.user_level",
        F.coalesce("total_pv", F.lit(0)).alias("total_pv"),
        "total_click",
        "total_cart",
        "total_fav",
        "total_buy",
        "last_active_ts",
        "active_days",
        "update_ts",
    )


def _item_events(dwd: DataFrame) -> DataFrame:
    return dwd.withColumn("kind", event_kind()).where(
        F.col("item_id").isNotNull() & F.col("kind").isin(*ITEM_KINDS)
    )


def item_totals(dwd: DataFrame) -> DataFrame:
    return (
        _item_events(dwd)
        .groupBy("item_id")
        .agg(
            F.count_if(F.col("kind") == "click").alias("total_detail_click"),
            *[F.count_if(F.col("kind") == k).alias(f"total_{k}") for k in ("buy", "cart", "fav")],
        )
    )


def item_uv(dwd: DataFrame, rsd: float | None = None) -> DataFrame:
    """Distinct users over the counted item events; ``rsd`` asks for the sketch."""
    users = F.count_distinct("uid") if rsd is None else F.approx_count_distinct("uid", rsd)
    return _item_events(dwd).groupBy("item_id").agg(users.alias("uv"))


UV_LOG2 = 14  # registers of a sketch: a standard error below 1 %


def uv_sketches(dwd: DataFrame, log2: int = UV_LOG2) -> DataFrame:
    """(item_id, sketch): a HyperLogLog of the users per item, of one size however many they are."""
    return _item_events(dwd).where("uid is not null").groupBy("item_id").agg(F.hll_sketch_agg("uid", F.lit(log2)).alias("sketch"))


def merge_uv(sketches: DataFrame) -> DataFrame:
    """One sketch per item of any number of them, from parts of the events in any order; repeats change nothing."""
    return sketches.groupBy("item_id").agg(F.hll_union_agg("sketch").alias("sketch"))


def uv_of(sketches: DataFrame) -> DataFrame:
    return sketches.select("item_id", F.hll_sketch_estimate("sketch").alias("uv"))


def latch_item_dim(dwd: DataFrame) -> DataFrame:
    """Item dimension of the first event with a known brand, else of the last event."""
    order = F.struct(*ORDER)
    row = F.struct("category_id", "item_brand", "item_price")
    known = F.coalesce(F.col("item_brand"), F.lit("unknown")) != "unknown"
    return (
        _item_events(dwd)
        .groupBy("item_id")
        .agg(F.coalesce(F.min_by(row, F.when(known, order)), F.max_by(row, order)).alias("_d"))
        .select(
            "item_id",
            "_d.category_id",
            F.coalesce("_d.item_brand", F.lit("unknown")).alias("item_brand"),
            "_d.item_price",
        )
    )


def conversion_rate(buy="total_buy", click="total_detail_click") -> Column:
    return ratio(buy, click)


def item_features(dwd: DataFrame) -> DataFrame:
    order = F.struct(*ORDER)
    row = F.struct("category_id", "item_brand", "item_price")
    known = F.coalesce(F.col("item_brand"), F.lit("unknown")) != "unknown"
    return (
        _item_events(dwd)
        .groupBy("item_id")
        .agg(
            F.coalesce(F.min_by(row, F.when(known, order)), F.max_by(row, order)).alias("_d"),
            F.count_if(F.col("kind") == "click").alias("total_detail_click"),
            *[F.count_if(F.col("kind") == k).alias(f"total_{k}") for k in ("buy", "cart", "fav")],
            F.count_distinct("uid").alias("uv"),
            F.max("ts").alias("update_ts"),
        )
        .select(
            "item_id",
            "_d.category_id",
            F.coalesce("_d.item_brand", F.lit("unknown")).alias("item_brand"),
            "_d.item_price",
            "total_detail_click",
            "total_buy",
            "total_cart",
            "total_fav",
            "uv",
            conversion_rate().alias("conversion_rate"),
            "update_ts",
        )
    )


def user_feature_changes(
    dwd: DataFrame, at_most: int = HOT_KEYS, min_rows: int = HOT_ROWS, hot: DataFrame | None = None
) -> DataFrame:
    """The user feature row after every event."""
    keys = ["uid"]
    rows = dwd.where(F.col("uid").isNotNull()).select(
        "uid", *ORDER, "user_age", "user_city", "user_level",
        event_kind().alias("kind"), counted_request().alias("_req"), local_day("ts").alias("_day"),
    )
    dims = F.struct("user_age", "user_city", "user_level")
    known = F.coalesce(F.col("user_age"), F.lit(0)) != 0
    # rows come in ts order, so a day never returns and its changes count the days
    rows = sliced_scan(
        with_slice(rows, keys, at_most=at_most, min_rows=min_rows, hot=hot),
        keys,
        ORDER,
        sums={f"total_{k}": F.coalesce(F.col("kind") == k, F.lit(False)).cast("int") for k in ("click", "cart", "fav", "buy")},
        changes={"total_pv": F.col("_req"), "active_days": F.col("_day")},
        firsts={"_d": F.when(known, dims)},
    )
    d = F.coalesce(F.col("_d"), dims)
    return rows.select(
        F.col("uid").alias("user_id"),
        *ORDER,
        d["user_age"].alias("user_age"),
        F.coalesce(d["user_city"], F.lit("unknown")).alias("user_city"),
        d["user_level"].alias("user_level"),
        "total_pv", "active_days", "total_click", "total_cart", "total_fav", "total_buy",
        F.col("ts").alias("last_active_ts"),
    )


def item_feature_changes(
    dwd: DataFrame, at_most: int = HOT_KEYS, min_rows: int = HOT_ROWS, hot: DataFrame | None = None
) -> DataFrame:
    """The item feature row after every counted item event."""
    keys = ["item_id"]
    events = _item_events(dwd).select(
        "item_id", "uid", *ORDER, "kind", "category_id", "item_brand", "item_price"
    )
    firsts = (
        events.where(F.col("uid").isNotNull())
        .groupBy("item_id", "uid")
        .agg(F.min(F.struct(*ORDER)).alias("_o"))
        .select("item_id", "uid", *[F.col(f"_o.{c}").alias(c) for c in ORDER], F.lit(1).alias("_new"))
    )
    rows = events.join(firsts, ["item_id", "uid", *ORDER], "left")
    dims = F.struct("category_id", "item_brand", "item_price")
    known = F.coalesce(F.col("item_brand"), F.lit("unknown")) != "unknown"
    kind = F.col("kind")
    sums = {
        "total_detail_click": kind == "click",
        "total_buy": kind == "buy",
        "total_cart": kind == "cart",
        "total_fav": kind == "fav",
        "uv": F.coalesce("_new", F.lit(0)),
    }
    hot = hot_keys(events, keys, at_most, min_rows) if hot is None else hot
    rows = sliced_scan(
        with_slice(rows, keys, hot=hot),
        keys,
        ORDER,
        sums={n: c.cast("int") for n, c in sums.items()},
        firsts={"_d": F.when(known, dims)},
    )
    d = F.coalesce(F.col("_d"), dims)
    return rows.select(
        "item_id",
        *ORDER,
        d["category_id"].alias("category_id"),
        F.coalesce(d["item_brand"], F.lit("unknown")).alias("item_brand"),
        d["item_price"].alias("item_price"),
        *sums,
        conversion_rate().alias("conversion_rate"),
    )
