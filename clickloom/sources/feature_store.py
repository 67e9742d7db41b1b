"""Keyed feature tables with overwrite semantics and a time to live, kept as a log of levels.

``batches/batch_id=n`` holds what batch n wrote; a replayed batch replaces its own folder. Every ``merge_every``
batches these become one sorted run under ``runs``, so readers meet few files. Every ``merge_every`` runs the
runs go into the base, which is cut into ``BUCKETS`` hash buckets of the key: only buckets with new rows are written again
(``base/n/hash_bucket=b``), all others stay the files they are. Keys whose life ended leave with the rewrite of their
bucket; a bucket in which every key ended is dropped without reading it, and one with keys that ended a whole life ago is
rewritten as if it had new rows.

A merge becomes visible by its manifest, one small file written last and renamed into ``manifests``: it names the
folder of every bucket and the runs above them. Readers take the newest manifest and the batches behind it. What the two
newest manifests do not name is removed by the next merge, so a reader that has just listed the table, and a replay of
the last batch, still find their files.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickloom.session import discard, names_in, read_note, write_note

# fixed values: time to live per feature family, in milliseconds
TTL_MS = {
    "user_item_window": 600_000,
    "stat": 7_200_000,
    "item_feature": 7 * 86_400_000,
    "user_feature": 30 * 86_400_000,
    "cross": 30 * 86_400_000,
}

NOTHING = -(2**62)  # before any batch
MERGE_EVERY = 10  # batches of a run, and runs that go into the base together
BUCKETS = 64


@dataclass
class Manifest:
    """The table after a merge: ``base`` maps a bucket to (folder number, first and last expiry)."""

    upto: int = NOTHING
    buckets: int = BUCKETS
    runs: list[str] = field(default_factory=list)
    base: dict[str, list[int | None]] = field(default_factory=dict)
    clock: int | None = None

    def folders(self) -> set[str]:
        return {f"runs/{r}" for r in self.runs} | {f"base/{n}/hash_bucket={b}" for b, (n, _, _) in self.base.items()}


def append_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batches/batch_id={batch_id}")


def manifests(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the merges that were finished, oldest first."""
    return sorted(int(n.split(".")[0]) for n in names_in(spark, f"{path}/manifests") if n.endswith(".json"))


def manifest(spark: SparkSession, path: str, before: int | None = None) -> Manifest:
    """The newest manifest, or the newest one of a merge before batch ``before``."""
    found = [n for n in manifests(spark, path) if before is None or n < before]
    return Manifest(**json.loads(read_note(spark, f"{path}/manifests/{found[-1]}.json"))) if found else Manifest()


def _batches(spark: SparkSession, path: str, after: int, upto: int | None = None) -> list[int]:
    numbers = (int(n.split("=")[1]) for n in names_in(spark, f"{path}/batches") if n.startswith("batch_id="))
    return sorted(n for n in numbers if n > after and (upto is None or n <= upto))


def _rows(spark: SparkSession, path: str, folders: Sequence[str], batches: Sequence[int]) -> DataFrame | None:
    """Rows of runs or buckets and of batches, with their ``batch_id``; None where there is neither."""
    parts = []
    if folders:
        parts.append(spark.read.parquet(*[f"{path}/{f}" for f in sorted(folders)]))
    if batches:
        new = spark.read.option("basePath", f"{path}/batches").parquet(*[f"{path}/batches/batch_id={n}" for n in batches])
        parts.append(new.withColumn("batch_id", F.col("batch_id").cast("long")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]) if parts else None


def current_rows(spark: SparkSession, path: str) -> DataFrame:
    """Everything a reader has to merge: base, runs and the batches after them."""
    now = manifest(spark, path)
    rows = _rows(spark, path, sorted(now.folders()), _batches(spark, path, now.upto))
    if rows is None:  # every key of an old table has ended, or nothing was written: the batch folder says which
        return spark.read.parquet(f"{path}/batches").withColumn("batch_id", F.col("batch_id").cast("long")).where(F.lit(False))
    return rows


def _in_bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def merge_levels(
    spark: SparkSession,
    path: str,
    batch_id: int,
    keys: Sequence[str],
    merge: Callable[[DataFrame], DataFrame],
    merge_every: int = MERGE_EVERY,
    buckets: int = BUCKETS,
    expiry: Column | None = None,
    ttl_ms: int = 0,
) -> None:
    """After batch ``batch_id``: fold full levels into the next one.

    ``merge`` keeps what readers still need of rows of the same keys, ``batch_id`` included, and may be applied again to
    what it kept. ``expiry`` is when a row's life ends; a key lives as long as one of its rows. The clock is the newest
    write time the table has seen, ``expiry`` less ``ttl_ms``.
    """
    if (batch_id + 1) % merge_every:
        return
    old = manifest(spark, path, batch_id)
    new = Manifest(batch_id, old.buckets if old.upto > NOTHING else buckets, list(old.runs), dict(old.base), old.clock)
    fresh = _batches(spark, path, old.upto, batch_id)
    if not fresh:
        return
    run = f"{fresh[0]}-{batch_id}"
    merge(_rows(spark, path, [], fresh)).write.mode("overwrite").parquet(f"{path}/runs/{run}")
    new.runs.append(run)
    if expiry is not None:
        newest = spark.read.parquet(f"{path}/runs/{run}").agg(F.max(expiry)).first()[0]
        if newest is not None:
            new.clock = max(newest - ttl_ms, new.clock if new.clock is not None else newest - ttl_ms)
    if len(new.runs) >= merge_every:
        _into_base(spark, path, new, keys, merge, expiry, ttl_ms)
    write_note(spark, f"{path}/manifests/{batch_id}.json", json.dumps(asdict(new)))
    _sweep(spark, path)


def _into_base(
    spark: SparkSession,
    path: str,
    new: Manifest,
    keys: Sequence[str],
    merge: Callable[[DataFrame], DataFrame],
    expiry: Column | None,
    ttl_ms: int,
) -> None:
    """Rewrites the buckets that the runs touch; ``new`` then names them and no run."""
    bucket = _in_bucket(keys, new.buckets).alias("_bucket")
    runs = _rows(spark, path, [f"runs/{r}" for r in new.runs], [])
    touched = {r[0] for r in runs.select(bucket).distinct().collect()}  # as many as there are buckets at most
    if new.clock is not None:
        ended = {b for b, (_, _, last) in new.base.items() if last is not None and last < new.clock and int(b) not in touched}
        new.base = {b: v for b, v in new.base.items() if b not in ended}
        touched |= {int(b) for b, (_, first, _) in new.base.items() if first is not None and first < new.clock - ttl_ms}
    before = [f"base/{n}/hash_bucket={b}" for b, (n, _, _) in new.base.items() if int(b) in touched]
    rows = runs.unionByName(_rows(spark, path, before, [])) if before else runs
    rows = merge(rows)
    if expiry is not None and new.clock is not None:
        life = F.max(expiry).over(Window.partitionBy(*keys))
        rows = rows.withColumn("_life", life).where(F.col("_life") >= new.clock).drop("_life")
    target = f"{path}/base/{new.upto}"
    rows = rows.withColumn("hash_bucket", _in_bucket(keys, new.buckets))
    rows.repartition("hash_bucket").sortWithinPartitions("hash_bucket", *keys).write.mode("overwrite").partitionBy("hash_bucket").parquet(target)
    new.base = {b: v for b, v in new.base.items() if int(b) not in touched}
    ends = (F.min(expiry), F.max(expiry)) if expiry is not None else (F.lit(None), F.lit(None))
    if any(n.startswith("hash_bucket=") for n in names_in(spark, target)):
        of_bucket = spark.read.parquet(target).groupBy("hash_bucket").agg(ends[0].alias("low"), ends[1].alias("high"))
        new.base |= {str(r["hash_bucket"]): [new.upto, r["low"], r["high"]] for r in of_bucket.collect()}
    new.runs = []


def _sweep(spark: SparkSession, path: str) -> None:
    """Removes what the two newest manifests do not name."""
    kept = manifests(spark, path)
    if len(kept) < 2:
        return
    two = [manifest(spark, path, n + 1) for n in kept[-2:]]
    named = two[0].folders() | two[1].folders()
    for run in names_in(spark, f"{path}/runs"):
        if f"runs/{run}" not in named:
            discard(spark, f"{path}/runs/{run}")
    for n in names_in(spark, f"{path}/base"):
        inside = [b for b in names_in(spark, f"{path}/base/{n}") if b.startswith("hash_bucket=")]
        for b in inside:
            if f"base/{n}/{b}" not in named:
                discard(spark, f"{path}/base/{n}/{b}")
        if not any(f"base/{n}/{b}" in named for b in inside):
            discard(spark, f"{path}/base/{n}")
    for n in _batches(spark, path, NOTHING, two[0].upto):
        discard(spark, f"{path}/batches/batch_id={n}")
    for n in kept[:-2]:
        discard(spark, f"{path}/manifests/{n}.json")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the largest ``order`` per key, as a grouped aggregate."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def upsert_batch(
    df: DataFrame,
    path: str,
    batch_id: int,
    keys: Sequence[str],
    order: Sequence[str],
    write_ms: Column | int,
    ttl_ms: int,
    merge_every: int = MERGE_EVERY,
    buckets: int = BUCKETS,
) -> None:
    """Append the newest row per key of a batch; the expiry is renewed for the whole key.

    ``write_ms`` is the write time, or a column that holds it.
    """
    written = F.lit(write_ms) if isinstance(write_ms, int) else write_ms
    append_batch(latest_per_key(df, keys, order).withColumn("expires_at", (written + ttl_ms).cast("long")), path, batch_id)
    newest = lambda rows: latest_per_key(rows, keys, ["batch_id"])
    merge_levels(df.sparkSession, path, batch_id, keys, newest, merge_every, buckets, F.col("expires_at"), ttl_ms)


def not_expired(df: DataFrame, as_of_ms: int) -> DataFrame:
    return df.where(F.col("expires_at") >= as_of_ms)


def read_features(spark: SparkSession, path: str, keys: Sequence[str], as_of_ms: int | None = None) -> DataFrame:
    """The current row of each key. Rows whose life ended are there until a merge, unless ``as_of_ms`` is given."""
    out = latest_per_key(current_rows(spark, path), keys, ["batch_id"]).drop("batch_id")
    return out if as_of_ms is None else not_expired(out, as_of_ms)


def compact(spark: SparkSession, path: str, target: str, keys: Sequence[str], as_of_ms: int | None = None) -> None:
    """Write the current rows as the only batch, number -1, of a new table."""
    append_batch(read_features(spark, path, keys, as_of_ms), target, -1)
