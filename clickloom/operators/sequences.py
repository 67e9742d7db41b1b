"""Bounded, newest-first behaviour sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.scalars import DAY_MS, event_kind
from clickloom.operators.enrich import search_query_filter
from clickloom.operators.slices import first_n

# fixed values: kind -> (key, member, length, time to live)
SEQUENCES = {
    "pv": ("uid", "item_id", 50, 7 * DAY_MS),
    "click": ("uid", "item_id", 50, 7 * DAY_MS),
    "fav": ("uid", "item_id", 30, 7 * DAY_MS),
    "cart": ("uid", "item_id", 30, 7 * DAY_MS),
    "buy": ("uid", "item_id", 20, 30 * DAY_MS),
    "item_pv": ("item_id", "uid", 200, 2 * 3_600_000),
    "item_click": ("item_id", "uid", 100, 2 * 3_600_000),
}
QUERY_LENGTH = 20
QUERY_TTL_MS = 7 * DAY_MS
READ_RANKING = 20
READ_LINEAGE = 10


def sequence_events(dwd: DataFrame, name: str) -> DataFrame:
    """(key, member, ts) rows that feed sequence ``name``."""
    key, member, _, _ = SEQUENCES[name]
    kind = name.removeprefix("item_")
    rows = dwd.where(event_kind() == kind)
    # shows carry the item at the top level, all other events in the payload
    item = F.col("item_id") if kind == "pv" else F.col("bhv_ext.item_id")
    rows = rows.select(item.alias("item_id"), "uid", "ts")
    return rows.select(F.col(key).alias("key"), F.col(member).alias("member"), "ts").where(
        F.col("key").isNotNull() & F.col("member").isNotNull()
    )


def newest_members(events: DataFrame, n: int, keys: Sequence[str] = ("key",)) -> DataFrame:
    """Distinct members by their last ts, newest ``n`` per key, as ranked rows."""
    last = events.groupBy(*keys, "member").agg(F.max("ts").alias("ts"))
    return first_n(last, keys, [F.col("ts").desc(), F.col("member").desc()], n)


def as_sequence(ranked: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    """Ranked rows to one array per key, newest first; its length is bounded by the rank."""
    entries = F.array_sort(F.collect_list(F.struct("rank", "member", "ts")))
    return (
        ranked.groupBy(*keys)
        .agg(entries.alias("_e"), F.max("ts").alias("last_ts"))
        .withColumn("members", F.transform("_e", lambda e: F.struct(e["member"].alias("member"), e["ts"].alias("ts"))))
        .drop("_e")
    )


def sequence(dwd: DataFrame, name: str, as_of_ms: Column | int | None = None) -> DataFrame:
    """One row per key with ``members`` newest first; expired keys drop out with ``as_of_ms``."""
    _, _, n, ttl = SEQUENCES[name]
    out = as_sequence(newest_members(sequence_events(dwd, name), n))
    if as_of_ms is not None:
        out = out.where(F.col("last_ts") + ttl >= as_of_ms)
    return out


def seq_query(dwd: DataFrame, dedup: str = "none") -> DataFrame:
    """Newest 20 queries per user, repeats kept."""
    return as_sequence(newest_queries(query_events(dwd, dedup)))


def query_events(dwd: DataFrame, dedup: str = "none") -> DataFrame:
    """(key, member, ts, arrival, pos) rows of searches.

    A search show with N items pushes its query N times; ``dedup='request'``
    pushes it once per event.
    """
    rows = search_query_filter(dwd).where(F.col("uid").isNotNull())
    if dedup == "request":
        rows = rows.where(F.col("pos") == 0)
    return rows.select(F.col("uid").alias("key"), F.col("bhv_ext.query").alias("member"), "ts", "arrival", "pos")


def newest_queries(events: DataFrame, n: int = QUERY_LENGTH) -> DataFrame:
    """The newest ``n`` queries per key, repeats kept, as ranked rows."""
    return first_n(events, ["key"], [F.col(c).desc() for c in ("ts", "arrival", "pos")], n)


def seq_read(sequences: DataFrame, n: int | None = None, members: str = "members") -> DataFrame:
    """The newest ``n`` members, all of them without ``n``."""
    names = F.transform(members, lambda e: e["member"])
    return sequences.select("key", (F.slice(names, 1, n) if n else names).alias("items"))


def last_n_interactions(interactions: DataFrame, n: int = 20, retained: int = 50) -> DataFrame:
    """Per user the latest ``n`` of at most ``retained`` interactions, oldest first."""
    newest = [F.col(c).desc() for c in ("create_time", "order_key", "line", "item_id")]
    rows = first_n(interactions, ["user_id"], newest, min(n, retained))
    return (
        rows.groupBy("user_id")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("r"), "item_id"))).alias("_e"))
        .select("user_id", F.transform("_e", lambda e: e["item_id"]).alias("items"))
    )
