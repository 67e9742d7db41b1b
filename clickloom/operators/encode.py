"""Vocabularies, scaling, and the assembled ranking features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.operators.slices import dense_index
from clickloom.session import materialise

BROADCAST_BYTES = 4_000_000  # a vocabulary of this size may be sent to every task


def vocabulary(values: DataFrame, column: str) -> DataFrame:
    """(token, idx): distinct values in sorted order, numbered from 0."""
    tokens = values.select(F.col(column).alias("token")).where(F.col("token").isNotNull()).distinct()
    return dense_index(tokens, ["token"])


def vocab_union(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new tokens sorted and numbered anew; indexes may shift."""
    return dense_index(old.select("token").union(new.select("token")).distinct(), ["token"])


def encode(df: DataFrame, column: str, vocab: DataFrame, out: str) -> DataFrame:
    """Index of the column's value; an unseen value gets 0."""
    v = vocab.select(F.col("token").alias("_t"), F.col("idx").alias("_i"))
    return df.join(v, F.col(column) == F.col("_t"), "left").withColumn(out, F.coalesce("_i", F.lit(0))).drop("_t", "_i")


def small_or_whole(vocab: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The vocabulary, stored, and marked for broadcast if it is small by measure, so that the rows it encodes stay where they are."""
    vocab = materialise(vocab)
    size = vocab.agg(F.sum(F.octet_length("token") + 64)).first()[0] or 0
    return F.broadcast(vocab) if size <= most_bytes else vocab


def scaler_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of (n, mean, m2) structs; m2 is the sum of squared deviations."""
    stats = []
    for c in columns:
        n = F.count(c)
        stats.append(
            F.struct(
                n.alias("n"),
                F.avg(c).cast("double").alias("mean"),
                (F.coalesce(F.var_pop(c), F.lit(0.0)) * n).alias("m2"),
            ).alias(c)
        )
    return df.agg(*stats)


def merge_scaler(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Statistics of both inputs together, from their one-row statistics."""
    both = a.select(*columns).unionByName(b.select(*columns))
    sums = []
    for c in columns:
        n, mean = F.col(f"{c}.n"), F.col(f"{c}.mean")
        joint = F.try_divide(F.sum(n * mean), F.sum(n))
        sums.append(F.struct(F.sum(n).alias("n"), joint.alias("mean"), F.collect_list(c).alias("parts")).alias(c))

    def spread(c: str) -> Column:
        """Deviations from the joint mean; squares of the means themselves would cancel."""
        joint = F.col(f"{c}.mean")

        def add(total: Column, part: Column) -> Column:
            gap = F.coalesce(part["mean"] - joint, F.lit(0.0))
            return total + part["m2"] + part["n"] * gap * gap

        return F.aggregate(F.col(f"{c}.parts"), F.lit(0.0), add)

    merged = [
        F.struct(F.col(f"{c}.n").alias("n"), F.col(f"{c}.mean").alias("mean"), spread(c).alias("m2")).alias(c) for c in columns
    ]
    return both.agg(*sums).select(*merged)


def sigma(stat: Column) -> Column:
    """Population deviation, 1 where it is 0."""
    s = F.sqrt(F.try_divide(stat["m2"], stat["n"].cast("double")))
    return F.when(F.coalesce(s, F.lit(0.0)) > 0, s).otherwise(F.lit(1.0))


def scale(df: DataFrame, columns: Sequence[str], stats: DataFrame, suffix: str = "_scaled") -> DataFrame:
    """(x - mean) / sigma with one-row statistics."""
    row = stats.select(F.struct(*columns)).scalar()
    out = df.withColumn("_st", row)
    return out.withColumns(
        {f"{c}{suffix}": (F.col(c).cast("double") - F.col(f"_st.{c}.mean")) / sigma(F.col(f"_st.{c}")) for c in columns}
    ).drop("_st")


def partial_fit(old: DataFrame, new: DataFrame, columns: Sequence[str], mode: str = "merge") -> DataFrame:
    """Update scaler statistics with new rows.

    ``merge`` adds the new rows once. ``mode='ref'`` feeds old and new rows to
    the fitted statistics again, so the old rows count twice.
    """
    before = scaler_stats(old, columns)
    fed = new if mode == "merge" else old.select(*columns).unionByName(new.select(*columns))
    return merge_scaler(before, scaler_stats(fed, columns), columns)


DISCRETE = {
    "user": ("gender", "user_categories", "user_keywords"),
    "item": ("name", "author", "item_city", "item_categories", "item_keywords"),
}
CONTINUOUS = ("age", "price", "hour", "is_weekend", "is_holiday")
STATS = tuple(f"{p}_{c}_last3m" for p in ("user", "item") for c in ("click", "cart", "buy", "forward"))

SCENE = ("hour", "is_weekend", "is_holiday")
SIDE_NUMBERS = {side: (number, *(c for c in STATS if c.startswith(f"{side}_"))) for side, number in (("user", "age"), ("item", "price"))}


def scene_columns(interactions: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """Hour, weekend and holiday flag from create_time; ``holidays`` is a table of days."""
    day = F.col("create_time").cast("date")
    out = interactions.withColumns(
        {
            "hour": F.hour("create_time"),
            "is_weekend": F.dayofweek(day).isin(1, 7).cast("int"),
            "_day": day,
        }
    )
    if holidays is None:
        return out.withColumn("is_holiday", F.lit(0)).drop("_day")
    days = holidays.select(F.col("day").cast("date").alias("_h")).distinct()
    return out.join(days, F.col("_day") == F.col("_h"), "left").withColumn("is_holiday", F.col("_h").isNotNull().cast("int")).drop("_day", "_h")


def scene_for(candidates: DataFrame, hour: int, is_weekend: bool, is_holiday: bool) -> DataFrame:
    """Attach the scene of a request to its candidate rows; hour 0 is a valid hour."""
    return candidates.withColumns(
        {"hour": F.lit(int(hour)), "is_weekend": F.lit(int(is_weekend)), "is_holiday": F.lit(int(is_holiday))}
    )


def training_frame(interactions: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Interactions with user and item columns, both left joins."""
    return interactions.join(users, "user_id", "left").join(items.drop("create_time"), "item_id", "left")


def feature_frame(pairs: DataFrame, users: DataFrame, items: DataFrame, user_stats: DataFrame, item_stats: DataFrame) -> DataFrame:
    """(user_id, item_id, scene …) with all raw ranking features, zeros for missing counts."""
    its = items.withColumnRenamed("city", "item_city").drop("create_time")
    out = (
        pairs.join(users.join(user_stats, "user_id", "left"), "user_id", "left")
        .join(its.join(item_stats, "item_id", "left"), "item_id", "left")
    )
    if "is_holiday" not in out.columns:
        out = out.withColumn("is_holiday", F.lit(0))
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in STATS})


def side_frame(side: str, rows: DataFrame, stats: DataFrame) -> DataFrame:
    """The columns of ``feature_frame`` that come from users or from items, one row per row of them."""
    if side == "item":
        rows = rows.withColumnRenamed("city", "item_city").drop("create_time")
    out = rows.join(stats, f"{side}_id", "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in STATS if c in SIDE_NUMBERS[side]})


def prepare_side(side: str, frame: DataFrame, vocabs: dict[str, DataFrame], stats: DataFrame) -> DataFrame:
    """``prepare_rank_features`` of one side's columns."""
    for c in DISCRETE[side]:
        frame = encode(frame, c, small_or_whole(vocabs[c]), f"{c}_idx")
    return scale(frame, SIDE_NUMBERS[side], stats)


def feature_vocabularies(users: DataFrame, items: DataFrame) -> dict[str, DataFrame]:
    """One vocabulary per discrete column; a list column is one token as a whole."""
    its = items.withColumnRenamed("city", "item_city")
    return {
        **{c: vocabulary(users, c) for c in DISCRETE["user"]},
        **{c: vocabulary(its, c) for c in DISCRETE["item"]},
    }


def prepare_rank_features(frame: DataFrame, vocabs: dict[str, DataFrame], stats: DataFrame) -> DataFrame:
    """Indexes ``{column}_idx`` and scaled numbers ``{column}_scaled``."""
    out = frame
    for c, vocab in vocabs.items():
        out = encode(out, c, small_or_whole(vocab), f"{c}_idx")
    return scale(out, [*CONTINUOUS, *STATS], stats)
