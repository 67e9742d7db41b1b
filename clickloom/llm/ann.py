"""Approximate nearest neighbours by learned partitions.

On a bounded sample the neighbour graph is cut into balanced parts; a small
softmax classifier on the coordinates learns the parts and then routes every row
of the table to its most probable part. A query is routed to several of its most
probable parts, and the rows found there are reranked by exact distance in double
precision. Parts are the index: their rows are stored under the shared folder.

A part of any size is searched in blocks: rows and queries of a part are dealt to
blocks of bounded size by a hash, every query block of a part meets every row block
once in a cogroup, and a task hands out at most ``k`` rows per query. Many equal
vectors land in one part and are cut the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.common import bounded_sample
from clickloom.session import materialise

SAMPLE_ROWS = 4_096  # fitting only; at most twice as many
PARTS = 16
PROBES = 12
GRAPH_NEIGHBOURS = 30
BALANCE = 1.2  # largest part of the sample over the mean
SWEEPS, STEPS, BATCH = 8, 800, 512
ROW_BLOCK, QUERY_BLOCK = 2_048, 1_024


@dataclass
class Router:
    """Softmax over parts of one hidden layer of rectified units."""

    centre: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    outer: np.ndarray
    outer_bias: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.centre) @ self.inner + self.inner_bias, 0)
        return h @ self.outer + self.outer_bias


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """(rows, k) nearest other rows of a bounded sample."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    squares = (x * x).sum(axis=1)
    for at in range(0, len(x), 1024):
        d = squares[None, :] - 2 * x[at : at + 1024] @ x.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        out[at : at + 1024] = np.argpartition(d, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Cut the graph into parts of nearly equal size with few edges between them.

    Starts from repeated halving along the main direction, then moves rows to the part that most of
    their neighbours are in while sizes stay within ``BALANCE``.
    """
    part = np.zeros(len(x), np.int64)
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        groups.sort(key=len)
        rows = groups.pop()
        if len(rows) < 2:
            groups.append(rows)
            break
        y = x[rows] - x[rows].mean(axis=0)
        way = rng.standard_normal(x.shape[1])
        for _ in range(12):
            way = y.T @ (y @ way)
            way /= np.linalg.norm(way) or 1.0
        order = np.argsort(y @ way, kind="stable")
        groups += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    for i, rows in enumerate(groups):
        part[rows] = i
    most = int(np.ceil(BALANCE * len(x) / len(groups)))
    sizes = np.bincount(part, minlength=len(groups))
    back = [[] for _ in range(len(x))]
    for i, row in enumerate(graph.tolist()):
        for j in row:
            back[j].append(i)
    near = [np.array(graph[i].tolist() + back[i]) for i in range(len(x))]
    for _ in range(SWEEPS):
        moved = 0
        for i in rng.permutation(len(x)).tolist():
            if not len(near[i]):
                continue
            votes = np.bincount(part[near[i]], minlength=len(groups))
            here = part[i]
            votes[sizes >= most] = 0
            best = int(votes.argmax())
            if best != here and votes[best] > np.count_nonzero(part[near[i]] == here):
                part[i] = best
                sizes[here] -= 1
                sizes[best] += 1
                moved += 1
        if not moved:
            break
    return part


def train_router(x: np.ndarray, part: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator) -> Router:
    """Learn for each row its own part and those of its neighbours, as one distribution."""
    goal = np.zeros((len(x), parts))
    np.add.at(goal, (np.arange(len(x)), part), 1.0 + graph.shape[1])
    for column in graph.T:
        np.add.at(goal, (np.arange(len(x)), part[column]), 1.0)
    goal /= goal.sum(axis=1, keepdims=True)
    width = 128
    centre = x.mean(axis=0)
    scale = float((x - centre).std()) or 1.0
    weights = [
        rng.standard_normal((x.shape[1], width)) / np.sqrt(x.shape[1]) / scale,
        np.zeros(width),
        rng.standard_normal((width, parts)) / np.sqrt(width),
        np.zeros(parts),
    ]
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, STEPS + 1):
        rows = rng.integers(0, len(x), min(BATCH, len(x)))
        xb = x[rows] - centre
        h = np.maximum(xb @ weights[0] + weights[1], 0)
        p = h @ weights[2] + weights[3]
        p = np.exp(p - p.max(axis=1, keepdims=True))
        p = (p / p.sum(axis=1, keepdims=True) - goal[rows]) / len(rows)
        on_h = (p @ weights[2].T) * (h > 0)
        grads = [xb.T @ on_h, on_h.sum(axis=0), h.T @ p, p.sum(axis=0)]
        rate = 0.01 * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for w, g, m, v in zip(weights, grads, mean, square):  # Adam
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return Router(centre, *weights)


def fit(vectors: DataFrame, parts: int = PARTS, sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> Router | None:
    """The router from at most 2 * ``sample_rows`` rows of (id, vector); None for an empty table."""
    total = vectors.count()
    sample = bounded_sample(vectors, F.col("id"), sample_rows, total)
    rows = sorted((r["id"], r["vector"]) for r in sample.toLocalIterator())
    if not rows:
        return None
    x = np.array([v for _, v in rows], np.float64)
    rng = np.random.default_rng(seed)
    parts = max(1, min(parts, len(x) // 8))
    graph = neighbour_graph(x, GRAPH_NEIGHBOURS)
    return train_router(x, balanced_parts(x, graph, parts, rng), graph, parts, rng)


def _route_batches(router: Router, probes: int):
    """(id, vector, part, place): the ``probes`` most probable parts, place 0 first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column("vector")
            x = np.array(vectors.to_pylist(), np.float64)
            odds = router.log_odds(x)
            order = np.argsort(-odds, axis=1, kind="stable")[:, :probes]
            take = np.repeat(np.arange(len(x)), order.shape[1])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(take)),
                    vectors.take(pa.array(take)),
                    pa.array(order.ravel().astype(np.int32)),
                    pa.array(np.tile(np.arange(order.shape[1], dtype=np.int32), len(x))),
                ],
                ["id", "vector", "part", "place"],
            )

    return run


ROUTED = "id long, vector array<double>, part int, place int"
FOUND = "query_id long, vec_id long, score double"


def _nearest_in_block(k: int):
    def work(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or queries.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": int, "vec_id": int})
        ids = rows["id"].to_numpy()
        order = np.argsort(ids, kind="stable")  # ties go to the smaller id
        ids, x = ids[order], np.array(rows["vector"].tolist())[order]
        out_q, out_v, out_s = [], [], []
        for q, v in zip(queries["id"].tolist(), queries["vector"].tolist()):
            gap = x - np.asarray(v)
            distance = np.sqrt((gap * gap).sum(axis=1))
            distance[ids == q] = np.inf
            best = np.argsort(distance, kind="stable")[:k]
            best = best[np.isfinite(distance[best])]
            out_q += [q] * len(best)
            out_v += ids[best].tolist()
            out_s += distance[best].tolist()
        return pd.DataFrame({"query_id": out_q, "vec_id": out_v, "score": out_s}).astype({"query_id": int, "vec_id": int})

    return work


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the rows that can take part: no null, zero, or non-finite vector, no null id, the usual length."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & sound & F.exists("vector", lambda v: v != 0))
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("vector") == (sizes[0]["n"] if sizes else 0))


def search(
    df: DataFrame,
    query_step: int = 100,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    parts: int = PARTS,
    probes: int = PROBES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for every row whose id is divisible by ``query_step``.

    Rows whose vector is null, zero or not finite throughout take no part, nor do rows of another length than
    the most frequent one. Rows that repeat an id count once. A query looks into more parts than ``probes`` where those
    hold fewer than ``k`` other rows, so small tables are answered in full. Further columns are ignored.
    """
    spark = df.sparkSession
    vectors = materialise(usable(df, id_col, vector_col).dropDuplicates(["id"]))
    router = fit(vectors, parts)
    if router is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = materialise(vectors.mapInArrow(_route_batches(router, 1), ROUTED).drop("place"))
    sizes = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}  # one row per part
    width = len(router.outer_bias)
    held = F.element_at(F.array(*[F.lit(sizes.get(p, 0)).cast("long") for p in range(width)]), F.col("part") + 1)

    queries = vectors.where(F.col("id") % query_step == 0).mapInArrow(_route_batches(router, width), ROUTED)
    before = Window.partitionBy("id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    queries = queries.withColumn("sofar", F.coalesce(F.sum(held).over(before), F.lit(0)))
    queries = materialise(queries.where((F.col("place") < probes) | (F.col("sofar") < k + 1)).where(held > 0))
    asked = {r["part"]: r["count"] for r in queries.groupBy("part").count().collect()}

    def blocks(counts: dict[int, int], block: int):
        return F.element_at(
            F.array(*[F.lit(-(-counts.get(p, 0) // block) or 1).cast("int") for p in range(width)]), F.col("part") + 1
        )

    def dealt(n):
        return F.pmod(F.xxhash64("id"), n).cast("int")

    def all_of(n):
        return F.explode(F.sequence(F.lit(0), n - 1))

    row_blocks, query_blocks = blocks(sizes, ROW_BLOCK), blocks(asked, QUERY_BLOCK)
    rows = index.where(F.col("part").isin(*asked)) if asked else index.limit(0)
    rows = rows.select("id", "vector", "part", dealt(row_blocks).alias("rb"), all_of(query_blocks).alias("qb"))
    queries = queries.select("id", "vector", "part", all_of(row_blocks).alias("rb"), dealt(query_blocks).alias("qb"))
    key = ["part", "rb", "qb"]
    found = rows.groupBy(*key).cogroup(queries.groupBy(*key)).applyInPandas(_nearest_in_block(k), FOUND)
    ranked = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
