"""Language identification: a bidirectional gated recurrent network over UTF-8 bytes.

The network is trained in numpy by backpropagation through time on windows of a
bounded sample of labelled texts. It gives every byte position a probability per
language; a document's probability is the mean over its positions. Texts are
read in windows of ``WINDOW`` bytes that cover them whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import held_out, sample_number, slices_of, utf8_buffers
from clickloom.operators.slices import first_n
from clickloom.session import materialise

WINDOW = 64
HIDDEN = 8
SAMPLE_DOCS = 400  # per language, fitting only
SAMPLE_ALL = 25_600  # of all languages together, which share them where they are many
BROADCAST_ROWS = 100_000  # languages whose counts go to every task; more of them are joined by a shuffle
SLOPE = np.float32(0.25)
STEPS, BATCH_WINDOWS = 260, 160
LANES = 1024  # windows that advance together
WORK_BYTES = 8 << 20
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


@dataclass
class Direction:
    """One reading direction: input weights per byte (gates z, r, n), recurrent weights, output weights."""

    of_byte: np.ndarray  # (3H, 256)
    recur: np.ndarray  # (3H, H)
    out: np.ndarray  # (L, H)


@dataclass
class LanguageModel:
    langs: list[str]
    forward: Direction
    backward: Direction
    bias: np.ndarray  # (L, 1)

    def parts(self) -> list[np.ndarray]:
        return [p for d in (self.forward, self.backward) for p in (d.of_byte, d.recur, d.out)] + [self.bias]


def _squash(x: np.ndarray) -> np.ndarray:
    """The hard logistic function in place: a line of slope ``SLOPE``, cut to 0..1."""
    x *= SLOPE
    x += 0.5
    return np.clip(x, 0, 1, out=x)


def _bend(gate: np.ndarray) -> np.ndarray:
    """Derivative of ``_squash`` by its result."""
    return SLOPE * ((gate > 0) & (gate < 1))


def _states(d: Direction, letters: np.ndarray) -> np.ndarray:
    """Hidden states (T, H, B) of reading ``letters`` (T, B) from first to last."""
    steps, lanes = letters.shape
    h = np.zeros((HIDDEN, lanes), np.float32)
    out = np.empty((steps, HIDDEN, lanes), np.float32)
    two = 2 * HIDDEN
    a = np.empty((3 * HIDDEN, lanes), np.float32)
    m = np.empty_like(a)
    gates, n, pull = a[:two], a[two:], m[two:]
    for t in range(steps):
        np.take(d.of_byte, letters[t], axis=1, out=a, mode="clip")
        np.matmul(d.recur, h, out=m)
        gates += m[:two]
        _squash(gates)
        pull *= gates[HIDDEN:]
        n += pull
        np.tanh(n, out=n)
        h = np.subtract(h, n, out=out[t])
        h *= gates[:HIDDEN]
        h += n
    return out


def _logits(model: LanguageModel, letters: np.ndarray) -> np.ndarray:
    """(T, L, B) scores of every position."""
    letters = letters.astype(np.intp)
    ahead = _states(model.forward, letters)
    behind = _states(model.backward, letters[::-1])[::-1]
    scores = np.matmul(model.forward.out, ahead)
    scores += np.matmul(model.backward.out, behind)
    scores += model.bias
    return scores


def position_probabilities(model: LanguageModel, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(T, L, B) softmax over languages at every position of the windows, and which are the largest."""
    p = _logits(model, letters)
    p -= p.max(axis=1, keepdims=True)
    top = p == 0
    np.exp(p, out=p)
    p /= p.sum(axis=1, keepdims=True)
    return p, top


def label_positions(model: LanguageModel, text: str) -> list[tuple[int, int, str]]:
    """Runs (start byte, end byte, language) over a whole text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    if not len(raw):
        return []
    windows, _ = _windows(raw, np.array([0, len(raw)]))
    best = position_probabilities(model, np.ascontiguousarray(windows.T))[0].argmax(axis=1).T.ravel()[: len(raw)]
    cuts = np.flatnonzero(np.r_[True, best[1:] != best[:-1], True])
    return [(int(a), int(b), model.langs[best[a]]) for a, b in zip(cuts[:-1], cuts[1:])]


# ---- training


def _train_direction(d: Direction, letters: np.ndarray):
    """Forward pass that keeps what the way back needs."""
    steps, lanes = letters.shape
    two = 2 * HIDDEN
    h = np.zeros((HIDDEN, lanes), np.float32)
    kept = []
    states = np.empty((steps, HIDDEN, lanes), np.float32)
    for t in range(steps):
        a = d.of_byte[:, letters[t]]
        m = d.recur @ h
        gates = _squash(a[:two] + m[:two])
        n = np.tanh(a[two:] + gates[HIDDEN:] * m[two:])
        kept.append((h, gates, n, m[two:]))
        h = n + gates[:HIDDEN] * (h - n)
        states[t] = h
    return states, kept


def _backpropagate(d: Direction, letters: np.ndarray, kept: list, slope: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input and recurrent weights; ``slope``: (T, H, B) from the outputs."""
    steps, lanes = letters.shape
    two = 2 * HIDDEN
    on_gates = np.empty((steps, 3 * HIDDEN, lanes), np.float32)
    on_recur = np.zeros_like(d.recur)
    back = np.zeros((HIDDEN, lanes), np.float32)
    for t in range(steps - 1, -1, -1):
        h, gates, n, m = kept[t]
        z, r = gates[:HIDDEN], gates[HIDDEN:]
        back = back + slope[t]
        on_n = back * (1 - z) * (1 - n * n)
        g = on_gates[t]
        g[:HIDDEN] = back * (h - n) * _bend(z)
        g[HIDDEN:two] = on_n * m * _bend(r)
        g[two:] = on_n
        through = g.copy()
        through[two:] *= r
        on_recur += through @ h.T
        back = back * z + d.recur.T @ through
    flat = on_gates.transpose(1, 0, 2).reshape(3 * HIDDEN, -1)
    where = letters.ravel()
    on_byte = np.stack([np.bincount(where, weights=row, minlength=256) for row in flat]).astype(np.float32)
    return on_byte, on_recur


def train(texts: list[str], labels: list[str], seed: int = 7) -> LanguageModel:
    """Fit on windows drawn evenly over languages, then documents, then places."""
    langs = sorted(set(labels))
    rng = np.random.default_rng(seed)

    def weights(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) * 0.3).astype(np.float32)

    size = len(langs)
    ways = [Direction(weights(3 * HIDDEN, 256), weights(3 * HIDDEN, HIDDEN), weights(size, HIDDEN)) for _ in range(2)]
    model = LanguageModel(langs, ways[0], ways[1], np.zeros((size, 1), np.float32))
    by_lang: list[list[np.ndarray]] = [[] for _ in langs]
    for text, label in zip(texts, labels):
        if text:
            by_lang[langs.index(label)].append(np.frombuffer(text.encode(), np.uint8))
    usable = [i for i, docs in enumerate(by_lang) if docs]
    if not usable:
        return model
    parts = model.parts()
    mean, square = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, STEPS + 1):
        letters = np.zeros((BATCH_WINDOWS, WINDOW), np.uint8)
        real = np.zeros((BATCH_WINDOWS, WINDOW), np.float32)
        goal = np.zeros(BATCH_WINDOWS, np.int64)
        for row in range(BATCH_WINDOWS):
            goal[row] = usable[int(rng.integers(len(usable)))]
            docs = by_lang[goal[row]]
            doc = docs[int(rng.integers(len(docs)))]
            at = int(rng.integers(max(1, len(doc) - WINDOW + 1)))
            piece = doc[at : at + WINDOW]
            letters[row, : len(piece)], real[row, : len(piece)] = piece, 1
        seq = np.ascontiguousarray(letters.T)
        ahead, kept_ahead = _train_direction(model.forward, seq)
        behind, kept_behind = _train_direction(model.backward, seq[::-1])
        p = np.matmul(model.forward.out, ahead) + np.matmul(model.backward.out, behind[::-1]) + model.bias
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        p[:, goal, np.arange(BATCH_WINDOWS)] -= 1
        p *= real.T[:, None, :] / real.sum()
        flip = p[::-1]
        grads = []
        for d, seq_d, states, kept, slope in (
            (model.forward, seq, ahead, kept_ahead, p),
            (model.backward, seq[::-1], behind, kept_behind, flip),
        ):
            on_byte, on_recur = _backpropagate(d, seq_d, kept, np.matmul(d.out.T, slope))
            grads += [on_byte, on_recur, np.einsum("tlb,thb->lh", slope, states, optimize=True)]
        grads.append(p.sum(axis=(0, 2))[:, None])
        rate = 0.02 * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for weight, grad, m, v in zip(parts, grads, mean, square):  # Adam
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            weight -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return model


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel | None:
    """Train on at most 2 * ``SAMPLE_DOCS`` labelled texts of each language, fewer where there are more than 64 languages.

    All languages are learned. Held-out documents take no part. None if there is nothing to learn from.
    """
    rows = df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        F.col("lang").isNotNull() & ~held_out(F.col("doc"))
    )
    sizes = materialise(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    languages = sizes.count()
    if not languages:
        return None
    each = max(1, min(SAMPLE_DOCS, SAMPLE_ALL // languages))
    share = F.least(F.lit(1_000_000).cast("long"), F.floor(F.lit(1_000_000.0 * each) / F.col("n")) + 1)
    counts = F.broadcast(sizes) if languages <= BROADCAST_ROWS else sizes
    drawn = rows.where("text is not null").join(counts, "lang").where(sample_number(F.col("doc")) < share)
    sample = first_n(drawn.select("lang", "text", "doc"), ["lang"], [sample_number(F.col("doc")), F.col("doc"), F.col("text")], 2 * each)
    found = sorted((r["lang"], r["text"]) for r in sample.select("lang", "text").toLocalIterator())
    if not found:
        return None
    return train([t for _, t in found], [lang for lang, _ in found])


# ---- prediction


def _windows(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All rows' bytes in windows (W, WINDOW), and the row of each window; the rest of a last window is 0."""
    sizes = np.diff(off)
    counts = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), counts)
    first = np.cumsum(counts) - counts
    places = first[np.repeat(np.arange(len(sizes)), sizes)] * WINDOW + np.arange(len(raw)) - np.repeat(off[:-1], sizes)
    flat = np.zeros(int(counts.sum()) * WINDOW, np.uint8)
    flat[places] = raw
    return flat.reshape(-1, WINDOW), row


def document_probabilities(model: LanguageModel, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per row the mean probability of each language and the share of positions it wins (rows, L)."""
    raw, off = utf8_buffers(column)
    sizes = np.diff(off)
    windows, row = _windows(raw, off)
    mass = np.zeros((len(sizes), len(model.langs)))
    wins = np.zeros_like(mass)
    filled = np.minimum(WINDOW, sizes[row] - (np.arange(len(row)) - np.searchsorted(row, row)) * WINDOW)
    for at in range(0, len(row), LANES):
        letters = np.ascontiguousarray(windows[at : at + LANES].T)
        p, top = position_probabilities(model, letters)
        real = np.arange(WINDOW)[:, None] < filled[None, at : at + LANES]
        short = np.flatnonzero(filled[at : at + LANES] < WINDOW)
        p[:, :, short] *= real[:, None, short]
        top[:, :, short] &= real[:, None, short]
        np.add.at(mass, row[at : at + LANES], p.sum(axis=0).T)
        np.add.at(wins, row[at : at + LANES], top.sum(axis=0, dtype=np.uint8).T)
    scale = np.maximum(sizes, 1)[:, None]
    return mass / scale, wins / scale


def _predict_batches(model: LanguageModel | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices_of(batch, "text", WORK_BYTES):
                texts = piece.column("text")
                has_letter = [t is not None and LETTER.search(t) is not None for t in texts.to_pylist()]
                langs, scores, shares = [], [], []
                if model is None:
                    has_letter = [False] * len(has_letter)
                    mass = wins = np.zeros((len(has_letter), 1))
                else:
                    mass, wins = document_probabilities(model, texts)
                best = mass.argmax(axis=1)
                for i, known in enumerate(has_letter):
                    langs.append(model.langs[best[i]] if known else UNKNOWN)
                    scores.append(min(1.0, float(mass[i, best[i]])) if known else 0.0)
                    shares.append(min(1.0, float(wins[i, best[i]])) if known else 0.0)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.float64())],
                    ["doc", "lang_pred", "score", "agreement"],
                )

    return run


def identify(df: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score, agreement) for every row of ``df``.

    ``score`` is the document probability of ``lang_pred``, ``agreement`` the share of
    positions labelled so. A null text, or one without a letter, is ``und`` with score 0;
    so is every row if nothing could be learned. Further columns are ignored.
    """
    rows = df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc"]
    found = rows.mapInArrow(_predict_batches(model), f"doc {kind}, lang_pred string, score double, agreement double")
    return found.select(F.col("doc").alias(id_col), held_out(F.col("doc")).alias("held_out"), "lang_pred", "score", "agreement")


ACCEPT_SCORE = 0.4


def _accept_batches(model: LanguageModel | None, least: float):
    predict = _predict_batches(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices_of(batch, "text", WORK_BYTES):
                narrow = pa.RecordBatch.from_arrays([pa.nulls(piece.num_rows), piece.column("text")], ["doc", "text"])
                ok = [
                    lang != UNKNOWN and score >= least
                    for out in predict([narrow])
                    for lang, score in zip(out.column("lang_pred").to_pylist(), out.column("score").to_pylist())
                ]
                yield piece.filter(pa.array(ok, pa.bool_()))

    return run


def keep_identified(
    df: DataFrame, model: LanguageModel | None, text_col: str = "text", least: float = ACCEPT_SCORE
) -> DataFrame:
    """The rows whose language is recognised with a score of ``least`` or more; others go."""
    names = df.columns
    plain = df.select(*[F.col(f"`{c}`").alias("text" if c == text_col else f"c{i}") for i, c in enumerate(names)])
    kept = plain.mapInArrow(_accept_batches(model, least), plain.schema)
    return kept.toDF(*names)
