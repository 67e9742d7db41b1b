"""Reports over ranking traces, raw events and interactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions.scalars import ratio
from clickloom.operators.slices import first_n
from clickloom.schemas import CALL_ROLES, HUMAN_ROLES

TOP_REASONS = 50


def stage_counts(trace: DataFrame) -> DataFrame:
    """Per request and stage: item count and the filter reasons with their multiplicity.

    Reasons come from a small fixed vocabulary, so the counted list stays short
    however many items one stage handled.
    """
    by_reason = trace.groupBy("req_id", "stage", "filter_reason").agg(F.count(F.lit(1)).alias("_n"))
    entry = F.when(F.col("filter_reason").isNotNull(), F.struct(F.col("filter_reason").alias("reason"), F.col("_n").alias("n")))
    return by_reason.groupBy("req_id", "stage").agg(
        F.sum("_n").alias("item_count"), F.array_sort(F.collect_list(entry)).alias("reasons")
    )


def filter_reason_stats(trace: DataFrame, start: Column | int, end: Column | int, top: int = TOP_REASONS) -> DataFrame:
    """Per user within [start, end]: the most frequent (stage, reason)."""
    counts = trace.where(F.col("ts").between(start, end)).groupBy("uid", "stage", "filter_reason").agg(
        F.count(F.lit(1)).alias("cnt")
    )
    order = [F.col("cnt").desc(), F.col("stage"), F.col("filter_reason").asc_nulls_last()]
    return first_n(counts, ["uid"], order, top).drop("rank")


def rec_quality(trace: DataFrame, by: str | None = "uid") -> DataFrame:
    """Click, engage and buy rates; over everything with ``by=None``."""
    grouped = trace.groupBy(by) if by else trace.groupBy()
    n = F.count(F.lit(1))
    return grouped.agg(
        *[
            F.try_divide(F.count_if(F.col(label) == 1).cast("double"), n.cast("double")).alias(name)
            for name, label in (("ctr", "click_label"), ("engage_rate", "engage_label"), ("buy_rate", "buy_label"))
        ],
        n.alias("total_impressions"),
    )


def event_distribution(behavior: DataFrame) -> DataFrame:
    """Count and share per page, type and value."""
    counts = behavior.groupBy("bhv_page", "bhv_type", F.coalesce("bhv_value", F.lit("-")).alias("bhv_value")).agg(
        F.count(F.lit(1)).alias("cnt")
    )
    total = counts.agg(F.sum("cnt")).scalar()
    return counts.withColumn("share", F.try_divide(F.col("cnt").cast("double"), total.cast("double")))


def funnel_rates(behavior: DataFrame) -> DataFrame:
    """Clicks per item shown on home and search, and buys per cart."""
    page, kind, value = F.col("bhv_page"), F.col("bhv_type"), F.col("bhv_value")
    shown = F.coalesce(F.size("bhv_ext.items"), F.lit(0)).cast("long")
    counts = behavior.agg(
        *[F.count_if((page == p) & (kind == "click")).alias(f"{p}_click") for p in ("home", "search")],
        *[
            F.coalesce(F.sum(F.when((page == p) & (kind == "show"), shown)), F.lit(0)).alias(f"{p}_items")
            for p in ("home", "search")
        ],
        F.count_if(value == "cart").alias("carts"),
        F.count_if(value == "buy").alias("buys"),
    )
    return counts.select(
        ratio("home_click", "home_items").alias("home_ctr"),
        ratio("search_click", "search_items").alias("search_ctr"),
        ratio("buys", "carts").alias("buy_cart_ratio"),
        "home_items",
        "search_items",
    )


def _top_share(counts: DataFrame, population: Column, fraction_of: int) -> DataFrame:
    """Share held by the top floor(population / fraction_of) keys, by count.

    Keys are folded to a histogram of their counts, at most about sqrt(2 * rows)
    rows, and the running key number is taken over that.
    """
    k = F.floor(population / fraction_of)
    hist = counts.groupBy("n").agg(F.count(F.lit(1)).alias("keys"))
    upto = Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("keys").over(upto), F.lit(0))
    taken = F.greatest(F.least(F.col("keys"), k - before), F.lit(0))
    return hist.withColumn("taken", taken).agg(
        F.coalesce(F.sum(F.col("taken") * F.col("n")), F.lit(0)).alias("top"),
        F.coalesce(F.sum(F.col("keys") * F.col("n")), F.lit(0)).alias("total"),
    )


def item_references(behavior: DataFrame) -> DataFrame:
    """Every item id an event names: shown items and the single item."""
    ext = F.col("bhv_ext")
    listed = F.coalesce(F.transform(ext["items"], lambda i: i["item_id"]), F.array().cast("array<string>"))
    single = F.filter(F.array(F.nullif(ext["item_id"], F.lit(""))), lambda v: v.isNotNull())
    return behavior.select(F.explode(F.concat(listed, single)).alias("item_id")).where(F.col("item_id").isNotNull())


def hotspot_share(behavior: DataFrame, n_users: Column, n_items: Column) -> DataFrame:
    """Event share of the top 10 % users and reference share of the top 20 % items.

    The population sizes are the configured ones, not the seen ones.
    """
    users = behavior.where(F.col("uid").isNotNull()).groupBy("uid").agg(F.count(F.lit(1)).alias("n"))
    items = item_references(behavior).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    parts = []
    for name, counts, size, part in (("user_top10", users, n_users, 10), ("item_top20", items, n_items, 5)):
        share = _top_share(counts, size, part)
        parts.append(share.select(F.lit(name).alias("measure"), "top", "total", ratio("top", "total").alias("share")))
    return parts[0].unionByName(parts[1])


def interaction_stats(interactions: DataFrame, key: str, as_of: Column, months: int = 3) -> DataFrame:
    """Click, cart, buy and forward counts per user or item over the last months."""
    since = F.add_months(as_of.cast("date"), -months).cast("timestamp_ntz")
    prefix = key.removesuffix("_id")
    recent = interactions.where((F.col("create_time") > since) & (F.col("create_time") <= as_of.cast("timestamp_ntz")))
    return recent.groupBy(key).agg(
        *[F.sum(c).alias(f"{prefix}_{c}_last3m") for c in ("click", "cart", "buy", "forward")]
    )


def session_counts(turns: DataFrame) -> DataFrame:
    """Human turns and tool calls per session."""
    return turns.groupBy("session_id").agg(
        F.count_if(F.col("role").isin(*HUMAN_ROLES)).alias("turn_count"),
        F.count_if(F.col("role").isin(*CALL_ROLES)).alias("tool_call_count"),
    )


ITEM_BLOCK = 1_024


def user_item_lists(interactions: DataFrame, block: int = ITEM_BLOCK) -> DataFrame:
    """Per user the items interacted with and how often.

    A list is split by item id block, so no array outgrows ``block`` entries
    however active the user is; the blocks of a user together are the whole list.
    """
    pairs = interactions.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("user_id", F.floor(F.col("item_id") / block).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("item_id", "n"))).alias("items"), F.sum("n").alias("n_interactions")
    )


def active_users(interactions: DataFrame) -> DataFrame:
    return interactions.select("user_id").distinct()
