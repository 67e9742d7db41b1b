"""The offline cascade: recall, rough rank, fine rank, diversity."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.operators import cf, cf_update, content, encode, factors, mmr, olap, rank, sequences, vectors
from clickloom.session import materialise, release, spread

FACTOR_TOP = 50


@dataclass
class Tables:
    users: DataFrame
    items: DataFrame
    interactions: DataFrame
    content_vectors: DataFrame


@dataclass
class Artefacts:
    """What is built once and read by every request."""

    channels: dict[str, DataFrame]
    vocabs: dict[str, DataFrame]
    stats: DataFrame
    rough: dict = field(default_factory=dict)
    fine: dict = field(default_factory=dict)
    # what new interactions are folded into: both neighbourhoods, (user, item) factors
    sides: dict[str, cf_update.Side] = field(default_factory=dict)
    factors: tuple[DataFrame, DataFrame] | None = None


def factor_recall(interactions: DataFrame, k: int = FACTOR_TOP, seed: int = 42) -> DataFrame:
    """(user_id, item_id, score): nearest item factors of every user."""
    return factor_channel(*factors.factor_vectors(interactions, seed=seed), k)


def factor_channel(users: DataFrame, items: DataFrame, k: int = FACTOR_TOP, method: str = "ivf") -> DataFrame:
    """(user_id, item_id, score): nearest of ``items`` (item_id, vector) for every vector of ``users`` (query_id, vector)."""
    found = vectors.vector_topk(users, items, k, method=method)
    return found.select(F.col("query_id").alias("user_id"), "item_id", "score")


def fit_sides(interactions: DataFrame, k: int = cf.NEIGHBOURS) -> dict[str, cf_update.Side]:
    """Both neighbourhoods, kept with what later interactions are compared with."""
    ratings = cf.stored_ratings(interactions)
    sides = {"item": cf_update.fit_side(*cf.item_inputs(ratings), k), "user": cf_update.fit_side(*cf.user_inputs(ratings), k)}
    release(ratings)
    return sides


def update_sides(sides: dict[str, cf_update.Side], interactions: DataFrame, k: int = cf.NEIGHBOURS) -> dict[str, cf_update.Side]:
    """The neighbourhoods of all ``interactions``; only members that changed are searched again."""
    ratings = cf.stored_ratings(interactions)
    inputs = {"item": cf.item_inputs(ratings), "user": cf.user_inputs(ratings)}
    found = {name: cf_update.update_side(side, *inputs[name], k)[0] for name, side in sides.items()}
    release(ratings)
    return found


def cf_channels(t: Tables, sides: dict[str, cf_update.Side] | None = None) -> dict[str, DataFrame]:
    if sides is None:
        return {"item_cf": cf.item_cf_recommend(t.interactions), "user_cf": cf.user_cf_recommend(t.interactions)}
    return {
        "item_cf": cf.item_cf_recommend(t.interactions, cf.as_item_sims(sides["item"].partners)),
        "user_cf": cf.user_cf_recommend(t.interactions, cf.as_user_sims(sides["user"].partners)),
    }


def cold_channels(t: Tables) -> dict[str, DataFrame]:
    last = sequences.last_n_interactions(t.interactions)
    return {
        "category": content.category_recall(t.users, t.items),
        "keyword": content.keyword_recall(t.users, t.items),
        "cluster": vectors.cluster_recall(last, t.content_vectors),
    }


def recall(t: Tables, with_factors: bool = True) -> dict[str, DataFrame]:
    channels = {**cf_channels(t), **cold_channels(t)}
    if with_factors:
        channels["factor"] = factor_recall(t.interactions)
    return channels


def last_stats(t: Tables) -> tuple[DataFrame, DataFrame]:
    as_of = t.interactions.agg(F.max("create_time")).scalar()
    return (
        olap.interaction_stats(t.interactions, "user_id", as_of),
        olap.interaction_stats(t.interactions, "item_id", as_of),
    )


def raw_features(t: Tables, pairs: DataFrame) -> DataFrame:
    return encode.feature_frame(pairs, t.users, t.items, *last_stats(t))


def fit_ranking(t: Tables, artefacts: Artefacts, stages: tuple[str, ...] = ("rough", "fine")) -> Artefacts:
    """Train the models of the stages on the interactions."""
    frame = raw_features(t, t.interactions.drop("create_time", "order_key", "line"))
    prepared = encode.prepare_rank_features(frame, artefacts.vocabs, artefacts.stats)
    data = spread(materialise(rank.assemble(prepared).select("features", *rank.TASKS)))
    return replace(artefacts, **{stage: rank.fit_tasks(data, stage) for stage in stages})


def fit(
    t: Tables,
    with_factors: bool = True,
    channels: dict[str, DataFrame] | None = None,
    stages: tuple[str, ...] = ("rough", "fine"),
) -> Artefacts:
    frame = raw_features(t, t.interactions.drop("create_time", "order_key", "line"))
    stats = materialise(encode.scaler_stats(frame, [*encode.CONTINUOUS, *encode.STATS]))
    sides, learned = {}, None
    if channels is None:
        sides = fit_sides(t.interactions)
        channels = {**cf_channels(t, sides), **cold_channels(t)}
        if with_factors:
            learned = tuple(materialise(v) for v in factors.factor_vectors(t.interactions))
            channels["factor"] = factor_channel(*learned)
    fitted = Artefacts(channels, encode.feature_vocabularies(t.users, t.items), stats, sides=sides, factors=learned)
    return fit_ranking(t, fitted, stages)


def hashed_sides(t: Tables, a: Artefacts) -> list[rank.Side]:
    """Users and items hashed once each, whatever the number of pairs they come in."""
    found = []
    for side, rows, counts in zip(("user", "item"), (t.users, t.items), last_stats(t)):
        unknown = rows.sparkSession.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])
        frames = [encode.prepare_side(side, encode.side_frame(side, r, counts), a.vocabs, a.stats) for r in (rows, unknown)]
        found.append(rank.hashed_side(*frames, side))
    return found


def rank_candidates(t: Tables, a: Artefacts, candidates: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rough, fine) for (request_id, user_id, item_id, hour, is_weekend, is_holiday)."""
    if "is_holiday" not in candidates.columns:
        candidates = candidates.withColumn("is_holiday", F.lit(0))
    sides, slots = hashed_sides(t, a), rank.scene_slots(candidates)
    scene = [f"{c}_scaled" for c in encode.SCENE]
    pairs = encode.scale(candidates.select("request_id", "user_id", "item_id", *encode.SCENE), encode.SCENE, a.stats)
    scored = rank.score_linear(pairs.drop(*encode.SCENE), *sides, slots, a.rough)
    rough = mmr.truncate_rough(scored.select("request_id", "user_id", "item_id", "user_row", "item_row", *scene, "score"))
    fine = rank.score_crossed(rough, *sides, slots, a.fine) if a.fine else None
    return rough.select("request_id", "user_id", "item_id", "score", "rank"), fine


def cascade_recommend(t: Tables, a: Artefacts, requests: DataFrame) -> DataFrame:
    """(request_id, item_id, position, mmr) for requests (request_id, user_id, hour, is_weekend, is_holiday)."""
    pool = content.recall_union(a.channels)
    candidates = requests.join(pool.select("user_id", "item_id"), "user_id")
    _, fine = rank_candidates(t, a, candidates)
    with_vectors = fine.join(t.content_vectors, "item_id", "left").select(
        "request_id", "item_id", F.col("score").alias("relevance"), "vector"
    )
    return mmr.mmr_rerank(with_vectors)


def append_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new rows together; nothing is replaced."""
    return old.unionByName(new, allowMissingColumns=True)


def refit(
    t: Tables,
    a: Artefacts,
    new_items: DataFrame | None = None,
    new_users: DataFrame | None = None,
    new_interactions: DataFrame | None = None,
) -> tuple[Tables, Artefacts]:
    """Append what is new and rebuild only what depends on it.

    New items or users: vocabularies and cold-start channels. New
    interactions: the neighbourhoods of members they touch, and the factors of
    touched users and new items, folded in; the sums of the scaler. Any of them: the models.
    """
    merged = Tables(
        append_rows(t.users, new_users) if new_users is not None else t.users,
        append_rows(t.items, new_items) if new_items is not None else t.items,
        append_rows(t.interactions, new_interactions) if new_interactions is not None else t.interactions,
        t.content_vectors,
    )
    channels, vocabs, stats, sides, learned = dict(a.channels), a.vocabs, a.stats, a.sides, a.factors
    if new_interactions is not None:
        sides = update_sides(a.sides, merged.interactions) if a.sides else fit_sides(merged.interactions)
        channels.update(cf_channels(merged, sides))
        if a.factors is not None:
            touched = [new_interactions.select(c).distinct() for c in ("user_id", "item_id")]
            learned = tuple(materialise(v) for v in factors.updated(*a.factors, cf.last_ratings(merged.interactions), *touched))
            channels["factor"] = factor_channel(*learned)
        elif "factor" in channels:
            channels["factor"] = factor_recall(merged.interactions)
        frame = raw_features(merged, new_interactions.drop("create_time", "order_key", "line"))
        fed = encode.scaler_stats(frame, [*encode.CONTINUOUS, *encode.STATS])
        stats = materialise(encode.merge_scaler(stats, fed, [*encode.CONTINUOUS, *encode.STATS]))
    if new_items is not None or new_users is not None:
        channels.update(cold_channels(merged))
        fresh = encode.feature_vocabularies(merged.users, merged.items)
        vocabs = {c: encode.vocab_union(v, fresh[c]) for c, v in vocabs.items()}
    if new_items is None and new_users is None and new_interactions is None:
        return merged, a
    return merged, fit_ranking(merged, Artefacts(channels, vocabs, stats, sides=sides, factors=learned))
