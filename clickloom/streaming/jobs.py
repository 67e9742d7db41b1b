"""Running streams: sinks, checkpoints and the four event jobs.

Every job checkpoints under the shared folder and writes through idempotent
batches, so a restarted job repeats a batch without changing the result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clickloom.functions.scalars import MINUTE_MS
from clickloom.operators import cumulative
from clickloom.operators.enrich import enrich
from clickloom.operators.sequences import (
    QUERY_TTL_MS,
    SEQUENCES,
    as_sequence,
    newest_members,
    newest_queries,
    query_events,
    sequence_events,
)
from clickloom.session import discard, names_in, work_path
from clickloom.sources import feature_store
from clickloom.streaming import stateful
from clickloom.streaming.events import DISORDER_MS, flag_late

TRIGGER_SECONDS = 30
FLUSH = "500 milliseconds"


def start_files(df: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream to a parquet table."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": f"{TRIGGER_SECONDS} seconds"}))
        .start()
    )


def start_batches(
    df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update", **trigger
) -> StreamingQuery:
    return (
        df.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": f"{TRIGGER_SECONDS} seconds"}))
        .start()
    )


def start_features(
    df: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str],
    order: Sequence[str],
    ttl_ms: int,
    merge_every: int = feature_store.MERGE_EVERY,
    **trigger,
) -> StreamingQuery:
    """Upsert the rows a stateful stream emits into a feature table.

    A row expires ``ttl_ms`` after its own stamp, the first column of ``order``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        feature_store.upsert_batch(batch, path, batch_id, keys, order, F.col(order[0]), ttl_ms, merge_every)

    return start_batches(df, write, checkpoint, **trigger)


QUERY_SEQUENCE = "query"


def _newest(rows: DataFrame, name: str) -> DataFrame:
    """What a bounded sequence keeps of its rows, as ranked rows."""
    return newest_queries(rows) if name == QUERY_SEQUENCE else newest_members(rows, SEQUENCES[name][2])


def start_sequences(
    dwd: DataFrame, name: str, path: str, checkpoint: str, merge_every: int = feature_store.MERGE_EVERY, **trigger
) -> StreamingQuery:
    """Bounded sequence ``name`` on a stream: one of ``SEQUENCES``, or ``query`` with its repeats.

    A batch appends its own newest members per key. Newest-N is associative, so
    reading merges the batches and cuts again, and so does every merge of levels, which
    also lets go of keys whose newest member is older than the sequence's time to live.
    """
    ttl_ms = QUERY_TTL_MS if name == QUERY_SEQUENCE else SEQUENCES[name][3]

    def merge(rows: DataFrame) -> DataFrame:
        kept = _newest(rows.drop("batch_id"), name).drop("rank")
        return kept.select("*", F.lit(None).cast("long").alias("batch_id"))

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = query_events(batch) if name == QUERY_SEQUENCE else sequence_events(batch, name)
        feature_store.append_batch(_newest(rows, name).drop("rank"), path, batch_id)
        feature_store.merge_levels(batch.sparkSession, path, batch_id, ["key"], merge, merge_every, expiry=F.col("ts") + ttl_ms, ttl_ms=ttl_ms)

    return start_batches(dwd, write, checkpoint, mode="append", **(trigger or {"processingTime": FLUSH}))


def read_sequences(spark: SparkSession, name: str, path: str) -> DataFrame:
    """(key, members newest first) over all batches written so far."""
    return as_sequence(_newest(feature_store.current_rows(spark, path).drop("batch_id"), name))


def start_flushed_sequences(
    dwd: DataFrame, name: str, path: str, checkpoint: str, flush_ms: int = 500, merge_every: int = feature_store.MERGE_EVERY, **trigger
) -> StreamingQuery:
    """Bounded sequence ``name`` kept in keyed state and written per key, when the timer of the key fires.

    A flush carries the whole sequence, so the newest one per key is all that a reader needs; ``start_sequences``
    keeps no state and merges on reading instead.
    """
    _, _, n, ttl_ms = SEQUENCES[name]
    flushed = stateful.flushed_sequence_stream(sequence_events(dwd, name), n, flush_ms)
    return start_features(flushed, path, checkpoint, ["key"], ["last_ts", "flushed_at"], ttl_ms, merge_every, **(trigger or {"processingTime": FLUSH}))


def start_uv(
    dwd: DataFrame, path: str, checkpoint: str, merge_every: int = feature_store.MERGE_EVERY, buckets: int = feature_store.BUCKETS, **trigger
) -> StreamingQuery:
    """Distinct users per item on a stream, as sketches in a keyed table.

    A batch appends one sketch per item it saw, and merges of levels unite them: what is kept of an item is one
    sketch of fixed size per level, and a repeated batch changes nothing. Exact counts are those of ``item_feature_stream``.
    """

    def merge(rows: DataFrame) -> DataFrame:
        return cumulative.merge_uv(rows).select("*", F.lit(None).cast("long").alias("batch_id"))

    def write(batch: DataFrame, batch_id: int) -> None:
        feature_store.append_batch(cumulative.uv_sketches(batch), path, batch_id)
        feature_store.merge_levels(batch.sparkSession, path, batch_id, ["item_id"], merge, merge_every, buckets)

    return start_batches(dwd, write, checkpoint, mode="append", **trigger)


def read_uv(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, uv) over all batches written so far, within about 1 %."""
    return cumulative.uv_of(cumulative.merge_uv(feature_store.current_rows(spark, path).drop("batch_id")))


DimReader = Callable[[SparkSession], DataFrame]


def start_enriched(
    behavior: DataFrame,
    read_user: DimReader,
    read_item: DimReader,
    path: str,
    checkpoint: str,
    shape: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    **trigger,
) -> StreamingQuery:
    """Join a stream with dimensions that are read anew for every micro-batch, so they may be rewritten meanwhile."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        feature_store.append_batch(shape(enrich(batch, read_user(spark), read_item(spark))), path, batch_id)

    return start_batches(behavior, write, checkpoint, mode="append", **trigger)


def start_late_split(
    df: DataFrame,
    path: str,
    checkpoint: str,
    delay_ms: int = DISORDER_MS,
    window_ms: int = MINUTE_MS,
    slice_rows: int = 1 << 20,
    **trigger,
) -> StreamingQuery:
    """Keep both sides of a running stream: rows on time, and rows whose window had closed when they arrived.

    The newest ts of all batches up to n is the mark of batch n, one row in
    ``marks/n``; batch n + 1 starts from it. A replayed batch starts from the same mark.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        marks = f"{path}/marks"
        before = sorted(n for n in map(int, names_in(spark, marks)) if n < batch_id)
        seen = spark.read.parquet(f"{marks}/{before[-1]}").first()["seen"] if before else None
        batch.persist()
        flagged = flag_late(batch, delay_ms, window_ms, slice_rows, seen)
        flagged.withColumn("late", F.col("late").cast("int")).write.mode("overwrite").partitionBy("late").parquet(
            f"{path}/rows/batch_id={batch_id}"
        )
        mark = batch.agg(F.greatest(F.max("ts"), F.lit(seen).cast("long")).alias("seen"))
        mark.write.mode("overwrite").parquet(f"{marks}/{batch_id}")
        batch.unpersist()
        for n in before[:-1]:
            discard(spark, f"{marks}/{n}")

    return start_batches(df, write, checkpoint, mode="append", **trigger)


def read_split(spark: SparkSession, path: str, late: bool) -> DataFrame:
    """The rows on time, or the late ones, of all batches written so far."""
    rows = spark.read.parquet(f"{path}/rows")
    return rows.where(F.col("late") == int(late)).drop("late", "batch_id")


def run_to_table(df: DataFrame, name: str) -> DataFrame:
    """Drain an append stream into a table under the shared folder and read it."""
    path = work_path(df.sparkSession, name)
    start_files(df, f"{path}/data", f"{path}/checkpoint", availableNow=True).awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/data")


def run_to_features(df: DataFrame, name: str, keys: Sequence[str], order: Sequence[str], ttl_ms: int) -> DataFrame:
    """Drain an update stream into a feature table and read its current rows."""
    spark = df.sparkSession
    path = work_path(spark, name)
    start_features(df, f"{path}/data", f"{path}/checkpoint", keys, order, ttl_ms, availableNow=True).awaitTermination()
    return feature_store.read_features(spark, f"{path}/data", keys).drop("expires_at")


def run_to_sequences(dwd: DataFrame, name: str) -> DataFrame:
    spark = dwd.sparkSession
    path = work_path(spark, f"seq-{name}")
    start_sequences(dwd, name, f"{path}/data", f"{path}/checkpoint", availableNow=True).awaitTermination()
    return read_sequences(spark, name, f"{path}/data")


def run_to_enriched(
    behavior: DataFrame, read_user: DimReader, read_item: DimReader, shape: Callable[[DataFrame], DataFrame], name: str, runs: int = 1
) -> DataFrame:
    """Drain a stream through ``start_enriched``; further runs go on from the checkpoint."""
    spark = behavior.sparkSession
    path = work_path(spark, name)
    for _ in range(runs):
        start_enriched(behavior, read_user, read_item, f"{path}/data", f"{path}/checkpoint", shape, availableNow=True).awaitTermination()
    return feature_store.current_rows(spark, f"{path}/data").drop("batch_id")


def run_to_split(df: DataFrame, name: str, late: bool) -> DataFrame:
    path = work_path(df.sparkSession, name)
    start_late_split(df, f"{path}/data", f"{path}/checkpoint", availableNow=True).awaitTermination()
    return read_split(df.sparkSession, f"{path}/data", late)
