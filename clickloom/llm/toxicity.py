"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A document's features are the distinct n-grams (3 to 6 code points, lower case) of its
whole text that separate the classes of the training sample. Each present feature
counts its log-count ratio, and a logistic regression on those scaled features
gives the score. Everything runs on arrays of code points: a rolling hash per
order, one table look-up per position, and work on the few hits only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import bounded_sample, held_out, slices_of

ORDERS = (3, 4, 5, 6)
SLOTS_LOG2 = 22
SAMPLE_DOCS = 3_000  # per class, fitting only
LEAST_DOCS = 6  # documents a feature must be seen in
LEAST_Z = 6.0  # standard errors between the two shares of documents
LEAST_RATIO = 1.5  # log-count ratio, either way
RIDGE, ROUNDS, RATE = 1e-4, 150, 0.03
WORK_BYTES = 4 << 20
_STEP = np.uint32(0x01000193)
_SPREAD = np.uint32(0x9E3779B1)
_GAP = "\0" * (max(ORDERS) - 1)  # keeps n-grams of neighbours apart


@dataclass
class ToxicityModel:
    hit: np.ndarray  # uint8 per slot: 1 for a feature
    slots: np.ndarray  # sorted slots of the features
    weights: np.ndarray  # regression weight x log-count ratio
    bias: float


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in lower case behind each other, with gaps; and where each begins (one more entry)."""
    low = [t.lower() for t in texts]
    joined = np.frombuffer((_GAP.join(low) + _GAP).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + len(_GAP) for t in low])
    return joined, np.concatenate([[0], ends])


def _slots(points: np.ndarray) -> Iterator[np.ndarray]:
    """The slot of the n-gram at every place, order by order."""
    h = points.copy()
    for k in range(1, max(ORDERS)):
        if len(points) <= k:
            return
        h = h[:-1] * _STEP + points[k:]
        if k + 1 in ORDERS:
            yield ((h ^ np.uint32(k)) * _SPREAD) >> np.uint32(32 - SLOTS_LOG2)


def features(model_hit: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, slot) pairs whose slot is marked in ``model_hit``."""
    points, starts = _code_points(texts)
    found = []
    for slots in _slots(points):
        at = np.flatnonzero(model_hit[slots])
        rows = np.searchsorted(starts, at, side="right") - 1
        own = at < starts[rows + 1] - len(_GAP)  # n-grams that begin in a gap belong to nobody
        at, rows = at[own], rows[own]
        found.append(rows.astype(np.int64) << SLOTS_LOG2 | slots[at].astype(np.int64))
    pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    return pairs >> SLOTS_LOG2, pairs & ((1 << SLOTS_LOG2) - 1)


def _document_counts(texts: list[str]) -> np.ndarray:
    """In how many texts each slot occurs."""
    counts = np.zeros(1 << SLOTS_LOG2, np.int32)
    last = np.zeros(1 << SLOTS_LOG2, np.int64)
    for text in texts:
        points, _ = _code_points([text])
        slots = np.concatenate([*_slots(points), np.empty(0, np.uint32)])
        last[slots] = np.arange(len(slots))
        counts[slots[last[slots] == np.arange(len(slots))]] += 1
    return counts


def train(toxic: list[str], clean: list[str]) -> ToxicityModel:
    """Pick the separating n-grams, scale them by log-count ratios, fit the regression."""
    n1, n0 = len(toxic), len(clean)
    in1, in0 = _document_counts(toxic), _document_counts(clean)
    p1, p0 = (in1 + 1) / (n1 + 2), (in0 + 1) / (n0 + 2)
    both = (in1 + in0 + 1) / (n1 + n0 + 2)
    z = (p1 - p0) / np.sqrt(both * (1 - both) * (1 / max(n1, 1) + 1 / max(n0, 1)))
    able = np.empty(0, np.int64)
    if n1 and n0:
        able = np.flatnonzero((in1 + in0 >= LEAST_DOCS) & (np.abs(z) >= LEAST_Z) & (np.abs(np.log(p1 / p0)) >= LEAST_RATIO))
    ratio = np.log(p1[able] / p0[able])
    hit = np.zeros(1 << SLOTS_LOG2, np.uint8)
    hit[able] = 1
    rows, cols, labels = [], [], np.r_[np.ones(n1), np.zeros(n0)]
    texts = toxic + clean
    for at in range(0, len(texts), 256):
        r, slots = features(hit, texts[at : at + 256])
        rows.append(r + at)
        cols.append(np.searchsorted(able, slots))
    row = np.concatenate(rows) if rows else np.empty(0, np.int64)
    col = np.concatenate(cols) if cols else np.empty(0, np.int64)
    value = ratio[col]
    weight = np.zeros(len(able))
    # both classes weigh the same per step of Adam
    share = np.where(labels == 1, 0.5 / max(n1, 1), 0.5 / max(n0, 1))
    bias = 0.0
    if not len(able):  # nothing learned: the share of toxic texts, and never toxic
        return ToxicityModel(hit, able, weight, min(float(np.log((n1 + 1) / (n0 + 1))), -1.0))
    mean, square = np.zeros(len(able) + 1), np.zeros(len(able) + 1)
    for step in range(1, ROUNDS + 1):
        margin = bias + np.bincount(row, weight[col] * value, minlength=len(texts))
        wrong = (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - labels) * share
        slope = np.append(np.bincount(col, wrong[row] * value, minlength=len(able)) + RIDGE * weight, wrong.sum())
        mean += 0.1 * (slope - mean)
        square += 0.01 * (slope * slope - square)
        move = RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
        weight -= move[:-1]
        bias -= float(move[-1])
    return ToxicityModel(hit, able, weight * ratio, bias)


def score(model: ToxicityModel, texts: list[str]) -> np.ndarray:
    row, slots = features(model.hit, texts)
    margin = model.bias + np.bincount(row, model.weights[np.searchsorted(model.slots, slots)], minlength=len(texts))[: len(texts)]
    return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def fit(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> ToxicityModel:
    """Train on at most 2 * ``SAMPLE_DOCS`` labelled texts of each class; held-out documents take no part.

    Rows without a text or a 0/1 label are not learned from. Without both classes, or without
    an n-gram that tells them apart, every text has the same score, below 0.5.
    """
    marks = labels.select(F.col(id_col).alias("doc"), F.col(label_col).cast("int").alias("mark"))
    marks = marks.where(F.col("mark").isin(0, 1) & F.col("doc").isNotNull() & ~held_out(F.col("doc"))).dropDuplicates(["doc"])
    sizes = {r["mark"]: r["count"] for r in marks.groupBy("mark").count().collect()}
    texts = df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    found: dict[int, list[str]] = {0: [], 1: []}
    for mark, size in sorted(sizes.items()):
        chosen = bounded_sample(marks.where(F.col("mark") == mark), F.col("doc"), SAMPLE_DOCS, size)
        rows = texts.join(chosen, "doc").limit(2 * SAMPLE_DOCS).select("doc", "text")
        found[mark] = [r["text"] for r in sorted(rows.toLocalIterator())]
    return train(found[1], found[0])


def _score_batches(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices_of(batch, "text", WORK_BYTES):
                texts = [t or "" for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("doc"), pa.array(score(model, texts), pa.float64())], ["doc", "score"])

    return run


def rate(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for every row; a null text scores as an empty one. Further columns are ignored."""
    rows = df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(_score_batches(model), f"doc {dict(rows.dtypes)['doc']}, score double")
    return found.select(
        F.col("doc").alias(id_col),
        held_out(F.col("doc")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def _clean_batches(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices_of(batch, "text", WORK_BYTES):
                texts = [t or "" for t in piece.column("text").to_pylist()]
                yield piece.filter(pa.array(score(model, texts) < 0.5))

    return run


def keep_clean(df: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows that are not predicted toxic."""
    names = df.columns
    plain = df.select(*[F.col(f"`{c}`").alias("text" if c == text_col else f"c{i}") for i, c in enumerate(names)])
    return plain.mapInArrow(_clean_batches(model), plain.schema).toDF(*names)
