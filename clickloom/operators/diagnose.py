"""Freshness, job health, sparsity, and the combined diagnosis of a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.operators.bundle import USER_COUNTS
from clickloom.operators.snapshots import lineage_trace

FRESH_SECONDS = 600
SPARSE_FIELDS = 5
COLD_SEQUENCE = 5
RUNNING = "RUNNING"
FAILED = ("FAILED", "FAILING")


def freshness_status(update_ms: Column, as_of_ms: Column) -> Column:
    age = F.floor((as_of_ms - update_ms) / 1000)
    return F.when(update_ms.isNull(), "unknown").when(age < FRESH_SECONDS, "fresh").otherwise("stale")


def feature_freshness(users: DataFrame, user_feature: DataFrame, as_of_ms: Column | int) -> DataFrame:
    """Age of each user's features; both stamps are milliseconds."""
    now = F.lit(as_of_ms).cast("long") if isinstance(as_of_ms, int) else as_of_ms
    feats = user_feature.select(F.col("user_id").alias("_u"), "update_ts")
    return users.select("uid").join(feats, F.col("uid") == F.col("_u"), "left").select(
        "uid", "update_ts",
        F.floor((now - F.col("update_ts")) / 1000).cast("long").alias("age_seconds"),
        freshness_status(F.col("update_ts"), now).alias("status"),
    )


def health_colour(age_seconds: Column | str, candidates: Column | str) -> Column:
    """Worse of the two lights: feature age (5 and 30 minutes) and candidate count (10 and 1)."""
    age = F.col(age_seconds) if isinstance(age_seconds, str) else age_seconds
    n = F.col(candidates) if isinstance(candidates, str) else candidates
    by_age = F.when(age < 300, 0).when(age <= 1800, 1).otherwise(2)
    by_count = F.when(n > 10, 0).when(n >= 1, 1).otherwise(2)
    return F.element_at(F.array(F.lit("green"), F.lit("yellow"), F.lit("red")), F.greatest(by_age, by_count) + 1)


def job_health(job_status: DataFrame) -> DataFrame:
    """Total, running and failed jobs by the last state of each (name, state, ts)."""
    last = job_status.groupBy("name").agg(F.max_by("state", "ts").alias("state"))
    return last.agg(
        F.count(F.lit(1)).alias("total_jobs"),
        F.count_if(F.col("state") == RUNNING).alias("running"),
        F.count_if(F.col("state").isin(*FAILED)).alias("failed"),
    )


def feature_sparsity(users: DataFrame, user_feature: DataFrame, click_seq: DataFrame) -> DataFrame:
    """Non-empty fields, click sequence length, and the cold-start verdict."""
    fields = [*USER_COUNTS, "user_age", "user_city", "user_level", "update_ts"]
    feats = user_feature.select(F.col("user_id").alias("_u"), *fields)
    filled = F.size(
        F.filter(
            F.array(*[F.nullif(F.col(c).cast("string"), F.lit("0")) for c in fields]),
            lambda v: v.isNotNull() & (v != ""),
        )
    )
    seq = click_seq.select(F.col("key").alias("_k"), F.size("members").alias("_n"))
    out = (
        users.select("uid")
        .join(feats, F.col("uid") == F.col("_u"), "left")
        .join(seq, F.col("uid") == F.col("_k"), "left")
        .select("uid", filled.alias("n_fields"), F.coalesce("_n", F.lit(0)).alias("seq_length"))
    )
    sparse, empty = F.col("n_fields") < SPARSE_FIELDS, F.col("seq_length") == 0
    return out.withColumns(
        {
            "cold": F.col("seq_length") < COLD_SEQUENCE,
            "verdict": F.when(sparse & empty, "cold_start").when(sparse, "feature_lag").otherwise("normal"),
        }
    )


def diagnose_chain(
    lookups: DataFrame,
    snapshots: DataFrame,
    click_seq: DataFrame,
    user_feature: DataFrame,
    job_status: DataFrame,
    as_of_ms: int,
) -> DataFrame:
    """One report row per request id.

    The lineage part is about the first candidate, not the best-scored item.
    """
    snaps = snapshots.select(
        F.col("req_id").alias("_r"), "uid", F.col("ts").alias("snapshot_ts"),
        F.size("candidates").alias("n_candidates"), F.get("candidates", F.lit(0)).alias("top_item"),
    )
    base = lookups.select("req_id").join(snaps, F.col("req_id") == F.col("_r"), "left").drop("_r")
    pairs = base.where(F.col("top_item").isNotNull()).select("uid", F.col("top_item").alias("item_id")).distinct()
    lineage = lineage_trace(pairs, snapshots, click_seq, as_of_ms).select(
        F.col("uid").alias("_lu"), F.col("item_id").alias("_li"), F.col("req_id").alias("lineage_req_id"),
        F.size("seq_items").alias("lineage_clicks"),
    )
    fresh = feature_freshness(base.where(F.col("uid").isNotNull()).select("uid").distinct(), user_feature, as_of_ms)
    fresh = fresh.select(F.col("uid").alias("_fu"), "age_seconds", F.col("status").alias("freshness"))
    health = job_health(job_status).select(F.struct("total_jobs", "running", "failed"))
    report = (
        base.join(lineage, (F.col("uid") == F.col("_lu")) & (F.col("top_item") == F.col("_li")), "left")
        .join(fresh, F.col("uid") == F.col("_fu"), "left")
        .drop("_lu", "_li", "_fu")
    )
    return report.withColumn("_h", health.scalar()).select("*", "_h.*").drop("_h")
