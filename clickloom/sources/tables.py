"""Readers and writers for events, dimensions and recommender tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom import schemas

CORRUPT = "_corrupt_record"


def parse_behavior(values: DataFrame, column: str = "value", mode: str = "PERMISSIVE") -> DataFrame:
    """JSON text to behaviour columns; unknown fields are ignored.

    ``FAILFAST`` fails on malformed text. The default keeps such rows with the
    text in ``_corrupt_record``.
    """
    fields = [f for f in schemas.BEHAVIOR.fields if f.name != "arrival"]
    schema = T.StructType([*fields, T.StructField(CORRUPT, T.StringType())]) if mode == "PERMISSIVE" else T.StructType(fields)
    options = {"mode": mode, "columnNameOfCorruptRecord": CORRUPT}
    parsed = values.where(F.col(column).isNotNull() & (F.trim(column) != ""))
    return parsed.select(F.from_json(F.col(column).cast("string"), schema, options).alias("_b")).select("_b.*")


def read_behavior(spark: SparkSession, path: str, fmt: str = "json", mode: str = "PERMISSIVE") -> DataFrame:
    if fmt == "json":
        return parse_behavior(spark.read.text(path), mode=mode)
    return spark.read.schema(schemas.BEHAVIOR).format(fmt).load(path)


def stream_behavior(spark: SparkSession, path: str, fmt: str = "json", mode: str = "PERMISSIVE", **options) -> DataFrame:
    reader = spark.readStream.options(**options)
    if fmt == "json":
        return parse_behavior(reader.text(path), mode=mode)
    return reader.schema(schemas.BEHAVIOR).format(fmt).load(path)


def stream_kafka(spark: SparkSession, servers: str, topic: str, starting: str = "latest", mode: str = "PERMISSIVE") -> DataFrame:
    """Behaviour from a Kafka topic; needs the Kafka connector on the class path."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
        .load()
    )
    return parse_behavior(raw, mode=mode)


def read_behavior_dim(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schemas.BEHAVIOR_DIM).format(fmt).load(path)


def stream_behavior_dim(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    return spark.readStream.options(**options).schema(schemas.BEHAVIOR_DIM).format(fmt).load(path)


def keyed_json(df: DataFrame, *key: str) -> DataFrame:
    """(key, value): the key columns joined by '_', the row as JSON; a null key is empty."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]
    return df.select(F.concat_ws("_", *parts).alias("key"), F.to_json(F.struct("*")).alias("value"))


def write_keyed_stream(df: DataFrame, key: tuple[str, ...], path: str, checkpoint: str, fmt: str = "parquet", **trigger):
    """Start an append stream of keyed JSON; delivery is at least once, as files commit per batch."""
    return (
        keyed_json(df, *key)
        .writeStream.format(fmt)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_dims(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def write_dims(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace the whole dimension."""
    df.write.mode("overwrite").format(fmt).save(path)


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path, header=True, schema=schema)


def read_csv_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """items.csv, users.csv and interactions.csv; null list columns become ''."""
    users = read_csv_table(spark, f"{folder}/users.csv", schemas.USERS_CSV)
    items = read_csv_table(spark, f"{folder}/items.csv", schemas.ITEMS_CSV)
    return {
        "users": users.fillna("", ["user_categories", "user_keywords"]),
        "items": items.fillna("", ["item_categories", "item_keywords"]),
        "interactions": read_csv_table(spark, f"{folder}/interactions.csv", schemas.INTERACTIONS_CSV),
    }


def jdbc_options(url: str, table: str, column: str, lower: int, upper: int, partitions: int, **extra: str) -> dict[str, str]:
    """Options of a partitioned read, so no single task pulls a whole table."""
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
        **extra,
    }


def read_jdbc_table(spark: SparkSession, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(**options)).load()


def read_time_range(df: DataFrame, start: Column | str, end: Column | str, column: str = "create_time") -> DataFrame:
    """Rows with start <= create_time <= end."""
    low = F.lit(start).cast("timestamp_ntz") if isinstance(start, str) else start
    high = F.lit(end).cast("timestamp_ntz") if isinstance(end, str) else end
    return df.where(F.col(column).between(low, high))


def items_with_stats(items: DataFrame, stats: DataFrame, how: str = "left") -> DataFrame:
    """Items with their last-3-month counts; the time-range load joins 'inner'."""
    return items.fillna("", ["item_keywords"]).join(stats, "item_id", how)


def store(df: DataFrame, path: str) -> DataFrame:
    """Write a table that several plans read and read it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
