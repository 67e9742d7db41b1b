"""The rule-based recommendation over a table of requests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.operators import bundle, candidates, cumulative, decay, rule, sequences, sliding, windows


@dataclass
class FeatureTables:
    """What serving reads: one table per feature family."""

    user_feature: DataFrame
    user_stat: DataFrame
    item_feature: DataFrame
    item_stat: DataFrame
    dim_item: DataFrame
    cross: DataFrame
    user_item_window: DataFrame
    sequences: dict[str, DataFrame]


def build_feature_tables(dwd: DataFrame, dim_item: DataFrame, decay_dwd: DataFrame | None = None) -> FeatureTables:
    """All serving features from item-level rows; ``decay_dwd`` may carry another clock."""
    return FeatureTables(
        user_feature=cumulative.user_features(dwd),
        user_stat=sliding.latest_stat(dwd, ["uid"]),
        item_feature=cumulative.item_features(dwd),
        item_stat=sliding.latest_stat(dwd, ["item_id"]),
        dim_item=dim_item,
        cross=decay.decayed_cross_category(dwd if decay_dwd is None else decay_dwd),
        user_item_window=windows.latest_window_feature(windows.home_funnel_window(dwd)),
        sequences={n: sequences.sequence(dwd, n) for n in candidates.SOURCES},
    )


def with_bundle(pairs: DataFrame, t: FeatureTables, tasks: int | None = None) -> DataFrame:
    return bundle.assemble_bundle(
        pairs, t.user_feature, t.user_stat, t.item_feature, t.item_stat, t.dim_item, t.cross, t.user_item_window, tasks
    )


def score_pool(pool: DataFrame, t: FeatureTables, scorer: rule.Scorer = rule.rule_score, tasks: int | None = None) -> DataFrame:
    """Bundles, scores, normalised scores and ranks for (req_id, uid, item_id, place) rows.

    A request has one user, so what is dealt by user is ranked where it lies.
    """
    clicks = t.sequences["click"].select(
        F.col("key").alias("_k"),
        F.transform(F.slice("members", 1, sequences.READ_RANKING), lambda m: m["member"]).alias("click_seq"),
    )
    bundles = with_bundle(pool, t, tasks).join(clicks, F.col("uid") == F.col("_k"), "left")
    bundles = bundles.withColumn("in_seq", rule.in_click_seq()).drop("_k", "click_seq")
    request = ["uid", "req_id"]
    return rule.recommend_rank(rule.minmax_normalise(scorer(bundles), by=request), by=request)


def rule_recommend(requests: DataFrame, t: FeatureTables, scorer: rule.Scorer = rule.rule_score) -> DataFrame:
    """Every pool item of every request with score, contributions and rank.

    The served list is ``rank <= top_k``.
    """
    pool = candidates.candidate_pool(requests, t.sequences, t.dim_item)
    return score_pool(pool, t, scorer, candidates.pool_tasks(requests))
