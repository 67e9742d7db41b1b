"""Registered queries that run as streams over the event table, drained once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.operators import decay, enrich
from clickloom.operators.sequences import SEQUENCES
from clickloom.plans import event_queries as E
from clickloom.plans.registry import query
from clickloom.sources import feature_store, tables, views
from clickloom.streaming import events, jobs, stateful

TTL = feature_store.TTL_MS
BYTES_PER_BATCH = 2 << 30


def stream_events(spark: SparkSession, d: str, clock: str = "fast") -> DataFrame:
    """The event table as a file stream, as behaviour events; a batch reads a bounded number of bytes."""
    schema = views.table(spark, d, "events").schema
    # a glob, as the stream source takes a single file only that way; a folder of that name works too
    path = f"{d.rstrip('/')}/{{events}}.parquet"
    raw = spark.readStream.schema(schema).option("maxBytesPerTrigger", BYTES_PER_BATCH).parquet(path)
    return views.behavior_from_events(raw, clock)


def stream_dwd(spark: SparkSession, d: str, clock: str = "fast") -> DataFrame:
    return events.enrich_stream(stream_events(spark, d, clock), views.dim_user(spark, d), views.dim_item(spark, d))


@query("dim_join_stream", f"SELECT {E.FLAT_SQL} FROM dwd")
def dim_join_stream(spark, d):
    return _enriched(spark, d)


def _enriched(spark, d, runs: int = 1):
    return jobs.run_to_enriched(
        stream_events(spark, d), lambda s: views.dim_user(s, d), lambda s: views.dim_item(s, d), E.flat, "dwd", runs
    )


@query("restarted_stream", f"SELECT {E.FLAT_SQL} FROM dwd")
def restarted_stream(spark, d):
    """The job started twice with one checkpoint: the second start repeats nothing."""
    return _enriched(spark, d, runs=2)


@query(
    "tumbling_1min",
    f"""WITH f AS ({E.FUNNEL_SQL}) SELECT * FROM f WHERE window_end <= (SELECT max(ts) - 10000 FROM dwd
    WHERE bhv_page = 'home' OR (bhv_page = 'pdp' AND bhv_src = 'home'))""",
)
def tumbling_1min(spark, d):
    return jobs.run_to_table(events.tumbling_minute(stream_dwd(spark, d)), "tumbling")


LATE_SQL = """WITH s AS (SELECT arrival, uid, ts_late AS ts,
  max(ts_late) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM behavior)
SELECT arrival, uid, ts FROM s WHERE coalesce(ts - ts % 60000 + 60000 <= seen - 10000, false)"""


@query("late_records", LATE_SQL)
def late_records(spark, d):
    return events.split_late(views.behavior(spark, d, "late"))[1].select("arrival", "uid", "ts")


@query("on_time_records", LATE_SQL.replace("WHERE coalesce", "WHERE NOT coalesce"))
def on_time_records(spark, d):
    return events.split_late(views.behavior(spark, d, "late"))[0].select("arrival", "uid", "ts")


@query("late_records_stream", LATE_SQL)
def late_records_stream(spark, d):
    return jobs.run_to_split(stream_events(spark, d, "late"), "late", True).select("arrival", "uid", "ts")


@query("on_time_records_stream", LATE_SQL.replace("WHERE coalesce", "WHERE NOT coalesce"))
def on_time_records_stream(spark, d):
    return jobs.run_to_split(stream_events(spark, d, "late"), "on-time", False).select("arrival", "uid", "ts")


@query("event_time_watermark", "SELECT uid, arrival, CAST(make_timestamp(ts * 1000) AS VARCHAR) AS event_time FROM behavior")
def event_time_watermark(spark, d):
    out = events.with_event_time(stream_events(spark, d)).select("uid", "arrival", "event_time")
    done = jobs.run_to_table(out, "watermark")
    # trailing zeros of the fraction are not printed by either side
    return done.select("uid", "arrival", F.col("event_time").cast("timestamp_ntz").cast("string").alias("event_time"))


@query("keyed_sink_stream", "SELECT uid AS key, count(*) AS n FROM dwd GROUP BY uid")
def keyed_sink_stream(spark, d):
    out = jobs.run_to_table(tables.keyed_json(stream_dwd(spark, d), "uid"), "keyed")
    return out.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("user_feature_stream", E.USER_FEATURES_SQL)
def user_feature_stream(spark, d):
    return jobs.run_to_features(
        stateful.user_feature_stream(stream_dwd(spark, d)), "user-features", ["user_id"], ["update_ts"], TTL["user_feature"]
    )


@query("item_feature_stream", f"SELECT * REPLACE (round(conversion_rate, 6) AS conversion_rate) FROM ({E.ITEM_FEATURES_SQL})")
def item_feature_stream(spark, d):
    out = jobs.run_to_features(
        stateful.item_feature_stream(stream_dwd(spark, d)), "item-features", ["item_id"], ["update_ts"], TTL["item_feature"]
    )
    return out.withColumn("conversion_rate", F.round("conversion_rate", 6))


@query("sliding_stat_stream", f"SELECT uid AS key, pv_5min, pv_1h, click_5min, click_1h, last_ts FROM ({E._latest_sql('uid')})")
def sliding_stat_stream(spark, d):
    rows = enrich.explode_shows(stream_events(spark, d))
    return jobs.run_to_features(stateful.sliding_stat_stream(rows), "sliding", ["key"], ["last_ts"], TTL["stat"])


@query(
    "decay_stream",
    f"SELECT uid, CAST(category_id AS VARCHAR) AS entity, * EXCLUDE (uid, category_id) FROM ({E._decay_sql('category_id', decay.CATEGORY_KINDS)})",
)
def decay_stream(spark, d):
    rows = enrich.explode_shows(stream_events(spark, d, "raw"))
    out = jobs.run_to_features(stateful.decay_stream(rows), "decay", ["uid", "entity"], ["last_ts"], TTL["cross"])
    return E._rounded(out)


@query(
    "sliding_item_stat_stream",
    f"SELECT item_id AS key, pv_5min, pv_1h, click_5min, click_1h, last_ts FROM ({E._latest_sql('item_id')})",
)
def sliding_item_stat_stream(spark, d):
    rows = enrich.explode_shows(stream_events(spark, d))
    return jobs.run_to_features(stateful.sliding_stat_stream(rows, "item_id"), "sliding-item", ["key"], ["last_ts"], TTL["stat"])


BRAND_SQL = E._decay_sql("coalesce(item_brand, 'unknown')", decay.BRAND_KINDS)


@query("decay_brand_stream", f"SELECT uid, brand AS entity, * EXCLUDE (uid, brand) FROM ({BRAND_SQL})")
def decay_brand_stream(spark, d):
    rows = stateful.decay_stream(stream_dwd(spark, d, "raw"), "brand")
    return E._rounded(jobs.run_to_features(rows, "decay-brand", ["uid", "entity"], ["last_ts"], TTL["cross"]))


def _sequence_stream(query_name: str, name: str, sql: str) -> None:
    @query(query_name, sql)
    def plan(spark, d):
        return E.text_members(jobs.run_to_sequences(enrich.explode_shows(stream_events(spark, d)), name))


_sequence_stream("sequence_stream", "click", E._seq_sql("click"))
for _name in SEQUENCES:
    if _name != "click":
        _sequence_stream(f"seq_{_name}_stream", _name, E._seq_sql(_name))
_sequence_stream("seq_query_stream", jobs.QUERY_SEQUENCE, E._seq_query_sql())
