"""Fold new behaviour events into existing feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.operators.sequences import SEQUENCES, as_sequence, newest_members

USER_TOTALS = {"click": "total_click", "fav": "total_fav", "cart": "total_cart", "buy": "total_buy"}
ITEM_TOTALS = {"click": "total_detail_click", "fav": "total_fav", "cart": "total_cart", "buy": "total_buy"}


def _deltas(events: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    known = events.where(F.col("bhv_type").isin(*columns) & F.col(key).isNotNull())
    return known.groupBy(F.col(key).alias("_key")).agg(
        *[F.count_if(F.col("bhv_type") == kind).alias(f"_d_{c}") for kind, c in columns.items()]
    )


def _merge(table: DataFrame, key: str, deltas: DataFrame, columns: dict[str, str]) -> DataFrame:
    joined = table.join(deltas, F.col(key) == F.col("_key"), "full")
    changed = {c: F.coalesce(c, F.lit(0)) + F.coalesce(f"_d_{c}", F.lit(0)) for c in columns.values()}
    return joined.withColumns({key: F.coalesce(key, "_key"), **changed}).drop("_key")


def apply_to_users(user_feature: DataFrame, events: DataFrame) -> DataFrame:
    """Add click, fav, cart and buy events (uid, item_id, bhv_type) to the user totals."""
    out = _merge(user_feature, "user_id", _deltas(events, "uid", USER_TOTALS), USER_TOTALS)
    return out.select(*user_feature.columns)


def apply_to_items(item_feature: DataFrame, events: DataFrame) -> DataFrame:
    """Add the events to the item totals; only a buy refreshes the conversion rate."""
    out = _merge(item_feature, "item_id", _deltas(events, "item_id", ITEM_TOTALS), ITEM_TOTALS)
    fresh = F.round(F.coalesce(F.try_divide(F.col("total_buy").cast("double"), F.col("total_detail_click").cast("double")), F.lit(0.0)), 6)
    bought = F.coalesce(F.col("_d_total_buy"), F.lit(0)) > 0
    return out.withColumn("conversion_rate", F.when(bought, fresh).otherwise(F.col("conversion_rate"))).select(
        *item_feature.columns
    )


def apply_to_clicks(click_seq: DataFrame, events: DataFrame) -> DataFrame:
    """Merge click events (uid, item_id, ts) into the click sequences, newest 50 kept."""
    old = click_seq.select("key", F.explode("members").alias("_m")).select("key", "_m.member", "_m.ts")
    new = events.where((F.col("bhv_type") == "click") & F.col("item_id").isNotNull()).select(
        F.col("uid").alias("key"), F.col("item_id").alias("member"), "ts"
    )
    return as_sequence(newest_members(old.unionByName(new), SEQUENCES["click"][2]))
