"""Factorisation machines of several tasks, fitted together on packed rows.

The optimiser is the one of ``FMClassifier``: its initial weights, full batches, AdamW, and its test of convergence. Its own gradient
adds up a dense vector of all weights for every row and task; here a task of Spark adds up only the slots a row has, for
all tasks of the model at once. The sums of a round meet in ``PIECES`` pieces, so the driver takes one vector of weights a round.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import FMClassificationModel, FMClassifier
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.session import materialise, release

PIECES = 16
ROWS_AT_ONCE = "8"  # packed rows that one Arrow batch holds, each up to some megabytes
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BETA_1, BETA_2, EPSILON = 0.9, 0.999, 1e-8  # of AdamW
PACKED = "slot binary, x binary, row binary, label binary, n long"


def _pack(tasks: Sequence[str]):
    """Rows of a batch as one row: entries in the order of their slots, and the labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            slots, xs, rows = [], [], []
            vectors = batch.column("features")
            dense = vectors.field("type").to_numpy(zero_copy_only=False) == 1
            for kind in (False, True):
                at = np.flatnonzero(dense == kind)
                if not len(at):
                    continue
                some = vectors.take(pa.array(at))
                values = some.field("values")
                sizes = np.diff(values.offsets.to_numpy())
                x = values.flatten().to_numpy()
                starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
                slot = np.arange(len(x)) - starts if kind else some.field("indices").flatten().to_numpy()
                slots.append(slot.astype(np.int32))
                xs.append(x)
                rows.append(np.repeat(at, sizes).astype(np.int32))
            slot, x, row = (np.concatenate(c) for c in (slots, xs, rows))
            use = np.flatnonzero(x)
            order = use[np.argsort(slot[use], kind="stable")]
            label = np.stack([batch.column(t).to_numpy() for t in tasks], axis=1)
            cells = [zlib.compress(a.tobytes(), 1) for a in (slot[order], x[order], row[order], label.astype(np.float64))]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([c], pa.binary()) for c in cells], pa.array([n], pa.int64())],
                ["slot", "x", "row", "label", "n"],
            )

    return run


def _gradient(shared, tasks: int, size: int, dim: int):
    """Sums of the gradients of all rows of a partition, cut into pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, linear, start = shared.value  # (size, tasks * dim), (size, tasks), (tasks,)
        of_factors, of_linear, of_start = np.zeros_like(factors), np.zeros_like(linear), np.zeros(tasks)
        both = np.concatenate([factors, linear], axis=1)
        for batch in batches:
            for i in range(batch.num_rows):
                slot, x, row, label = (
                    np.frombuffer(zlib.decompress(batch.column(c)[i].as_buffer()), kind)
                    for c, kind in (("slot", np.int32), ("x", np.float64), ("row", np.int32), ("label", np.float64))
                )
                n = batch.column("n")[i].as_py()
                label = label.reshape(n, tasks)
                order = np.argsort(row, kind="stable")
                r, s, v = row[order], slot[order], x[order, None]
                first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.empty(0, int)
                sums, squares = np.zeros((n, both.shape[1])), np.zeros((n, tasks * dim))
                if len(r):
                    parts = both[s] * v
                    sums[r[first]] = np.add.reduceat(parts, first)
                    crossed = parts[:, : tasks * dim]
                    squares[r[first]] = np.add.reduceat(crossed * crossed, first)
                crossed = sums[:, : tasks * dim]
                raw = start + sums[:, tasks * dim :] + 0.5 * (crossed * crossed - squares).reshape(n, tasks, dim).sum(axis=2)
                with np.errstate(over="ignore"):
                    gap = 1.0 / (1.0 + np.exp(-raw)) - label
                of_start += gap.sum(axis=0)
                if not len(r):
                    continue
                begin = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
                own = slot[begin]
                pulled = np.concatenate([np.repeat(gap, dim, axis=1) * crossed, gap], axis=1)
                added = np.add.reduceat(pulled[row] * x[:, None], begin)
                weight = np.add.reduceat(gap[row] * (x * x)[:, None], begin)
                of_factors[own] += added[:, : tasks * dim] - factors[own] * np.repeat(weight, dim, axis=1)
                of_linear[own] += added[:, tasks * dim :]
        flat = np.concatenate([of_factors.ravel(), of_linear.ravel(), of_start])
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(PIECES), pa.int32()), pa.array([p.tobytes() for p in np.array_split(flat, PIECES)], pa.binary())], ["piece", "sums"]
        )

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, sums in zip(batch.column("piece").to_pylist(), batch.column("sums")):
            part = np.frombuffer(sums.as_buffer(), np.float64)
            held[piece] = held[piece] + part if piece in held else part
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["piece", "sums"])


def fit_crossed(assembled: DataFrame, tasks: Sequence[str], **options) -> dict[str, FMClassificationModel]:
    """One ``FMClassificationModel`` per task of ``assembled`` (features, tasks of 0 and 1); ``options`` are those of ``FMClassifier``."""
    spark = assembled.sparkSession
    sc = spark.sparkContext
    labels = [F.col(t).cast("double").alias(t) for t in tasks]
    rows = assembled.select("features", *labels)
    wrong = [F.coalesce(F.sum((F.col(t).isNull() | ~F.col(t).isin(0.0, 1.0)).cast("long")), F.lit(0)) for t in tasks]
    bad = rows.agg(sum(wrong, F.lit(0))).first()[0]
    if bad:
        raise ValueError(f"labels are 0 or 1; {bad} are not")
    one = rows.first()
    size = one["features"].size
    # no round: the model of the initial weights
    estimator = FMClassifier(**options)
    rounds, step, reg, tol = (estimator.getOrDefault(p) for p in ("maxIter", "stepSize", "regParam", "tol"))
    begin = FMClassifier(**{**options, "maxIter": 0}).fit(rows.limit(1).select("features", F.col(tasks[0]).alias("label")))
    dim, n_tasks = begin.factors.numCols, len(tasks)

    factors = np.tile(begin.factors.toArray(), (1, n_tasks))
    linear, start = np.tile(begin.linear.toArray()[:, None], (1, n_tasks)), np.full(n_tasks, float(begin.intercept))
    packed = materialise(rows.mapInArrow(_pack(tasks), PACKED))
    count = packed.agg(F.sum("n")).first()[0]
    # (weights, tasks), as the optimiser has them
    owner = np.concatenate([np.tile(np.repeat(np.arange(n_tasks), dim), size), np.tile(np.arange(n_tasks), size), np.arange(n_tasks)])
    flat = np.concatenate([factors.ravel(), linear.ravel(), start])
    mean, spread_, open_ = np.zeros_like(flat), np.zeros_like(flat), np.ones(n_tasks, bool)
    rows_before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, ROWS_AT_ONCE)
    try:
        for i in range(1, rounds + 1):
            shared = sc.broadcast((flat[: factors.size].reshape(size, -1), flat[factors.size : -n_tasks].reshape(size, -1), flat[-n_tasks:]))
            sums = packed.mapInArrow(_gradient(shared, n_tasks, size, dim), "piece int, sums binary")
            found = {r["piece"]: np.frombuffer(r["sums"], np.float64) for r in sums.repartition(PIECES, "piece").mapInArrow(_add, "piece int, sums binary").collect()}
            shared.destroy()
            g = np.concatenate([found[p] for p in range(PIECES)]) / count
            mean = BETA_1 * mean + (1.0 - BETA_1) * g
            spread_ = BETA_2 * spread_ + (1.0 - BETA_2) * (g * g)
            moved = step * (mean / (1.0 - BETA_1**i)) / (np.sqrt(spread_ / (1.0 - BETA_2**i)) + EPSILON)
            now = np.where(open_[owner], flat - moved - reg * flat, flat)
            if i > 1:
                gone, long = (np.sqrt(np.bincount(owner, v * v, n_tasks)) for v in (now - flat, now))
                open_ &= ~(gone < tol * np.maximum(long, 1.0))
            flat = now
            if not open_.any():
                break
    finally:
        spark.conf.set(ARROW_ROWS, rows_before)
    release(packed)
    models = {}
    for k, task in enumerate(tasks):
        mine = flat[owner == k]
        jvm = sc._jvm.org.apache.spark.ml
        made = jvm.classification.FMClassificationModel(
            begin.uid, float(mine[-1]),
            _py2java(sc, Vectors.dense(mine[size * dim : size * dim + size])),
            _py2java(sc, DenseMatrix(size, dim, mine[: size * dim].reshape(size, dim).ravel(order="F"))),
        )
        models[task] = FMClassificationModel(begin._java_obj.copyValues(made, jvm.param.ParamMap()))
    return models
