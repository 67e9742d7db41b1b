"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

The last token of the encoding of every prefix is unique: it is the vocabulary token
that ends there and is compatible with the last token of the prefix before it. A
suffix automaton of the vocabulary gives all tokens ending at a place; two tokens
are compatible if undoing the merges along their border meets no merge across it
that would have come first. Following the stored last tokens back from the end
gives exactly the ids of the merge procedure, in time linear in the text.

The tables are built on the driver from the vocabulary file (50 000 entries) and
broadcast. Pre-tokens repeat, so a worker remembers the recent ones.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed value: the pre-token pattern of the byte-level tokenizers
PRE_TOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
REMEMBERED = 500_000  # pre-tokens per generation and worker
LONGEST_REMEMBERED = 64
MOST_PAIRS = 500_000
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """Vocabulary letter of each byte: printable bytes stand for themselves, the others for 256, 257, …"""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_tables(path: str) -> dict:
    """Vocabulary, merges and automaton as plain arrays, from a tokenizers JSON file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letter = byte_letters()
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    tokens = {name: i for name, i in vocab.items() if all(c in letter for c in name)}
    size = max([*vocab.values(), *[a["id"] for a in spec["added_tokens"]]]) + 1
    content = [b""] * size
    for name, i in tokens.items():
        content[i] = bytes(letter[c] for c in name)
    left, right = np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    made = np.full(size, -1, np.int32)  # rank of the merge that makes a token; -1 for bytes
    pairs = np.empty((len(merges), 2), np.int64)
    for rank, merge in enumerate(merges):
        a, b = merge if isinstance(merge, list) else merge.split(" ")
        pairs[rank] = vocab[a], vocab[b]
        t = vocab[a + b]
        if made[t] < 0:
            left[t], right[t], made[t] = vocab[a], vocab[b], rank
    special = {a["content"]: a["id"] for a in spec["added_tokens"]}
    for name, i in special.items():
        content[i] = name.encode()
    return {"content": content, "left": left, "right": right, "made": made, "pairs": pairs, "special": special} | automaton(
        [(content[i], i) for i in sorted(tokens.values())]
    )


def automaton(tokens: list[tuple[bytes, int]]) -> dict:
    """Suffix automaton of all tokens: steps, suffix links, lengths, and the nearest token on each link path."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]

    def add(last: int, c: int) -> int:
        known = step[last].get(c)
        if known is not None and length[known] == length[last] + 1:
            return known
        if known is not None:
            return split(last, c, known)
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            link[new] = q if length[q] == length[p] + 1 else split(p, c, q)
        return new

    def split(p: int, c: int, q: int) -> int:
        copy = len(step)
        step.append(dict(step[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and step[p].get(c) == q:
            step[p][c] = copy
            p = link[p]
        return copy

    end_of = []
    for data, i in tokens:
        at = 0
        for c in data:
            at = add(at, c)
        end_of.append((data, i))
    token = np.full(len(step), -1, np.int32)
    for data, i in end_of:
        at = 0
        for c in data:
            at = step[at][c]
        token[at] = i
    links, lengths = np.array(link, np.int32), np.array(length, np.int32)
    # nearest state with a token on the link path, itself included (-1: none)
    ending = np.full(len(step), -1, np.int32)
    for state in np.argsort(lengths, kind="stable").tolist():
        if token[state] >= 0:
            ending[state] = state
        elif links[state] >= 0:
            ending[state] = ending[links[state]]
    edges = [(state << 8 | c, to) for state, out in enumerate(step) for c, to in out.items()]
    return {
        "edges": np.array(edges, np.int64),
        "link": links,
        "length": lengths,
        "token": token,
        "ending": ending,
    }


class Encoder:
    """The tables in the form a worker's loop wants, and its memory of pre-tokens."""

    def __init__(self, tables: dict):
        self.content: list[bytes] = tables["content"]
        self.left, self.right, self.made = (tables[k].tolist() for k in ("left", "right", "made"))
        self.rank = {a << 20 | b: r for r, (a, b) in reversed(list(enumerate(tables["pairs"].tolist())))}
        self.step = dict(tables["edges"].tolist())
        self.link, self.length, self.token, self.ending = (
            tables[k].tolist() for k in ("link", "length", "token", "ending")
        )
        self.special: dict[str, int] = tables["special"]
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in names) + ")") if names else None
        self.fits: dict[int, bool] = {}
        self.recent: dict[str, tuple[str, bytes]] = {}
        self.older: dict[str, tuple[str, bytes]] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave token a before token b as they are."""
        limit = NEVER
        while True:
            if self.rank.get(a << 20 | b, NEVER) < limit:
                return False
            of_a, of_b = self.made[a], self.made[b]
            if of_a < 0 and of_b < 0:
                return True
            # undo the later merge; of two equal ones the right, which came second
            if of_a > of_b:
                limit, a = of_a, self.right[a]
            else:
                limit, b = of_b + 1, self.left[b]

    def encode_bytes(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        step, link, length, token, ending = self.step, self.link, self.length, self.token, self.ending
        fits = self.fits
        if len(fits) > MOST_PAIRS:
            fits.clear()
        last = [-1] * (len(data) + 1)
        state, matched = 0, 0
        for end, c in enumerate(data, 1):
            to = step.get(state << 8 | c)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = step.get(state << 8 | c)
            if to is not None:
                state, matched = to, matched + 1
            # a token as long as its state needs the whole state matched
            at = ending[state]
            if at == state and length[state] > matched:
                at = ending[link[state]]
            while at > 0:
                t = token[at]
                before = last[end - length[at]]
                if before < 0:
                    if end == length[at]:
                        last[end] = t
                        break
                else:
                    pair = before << 20 | t
                    ok = fits.get(pair)
                    if ok is None:
                        ok = fits[pair] = self.compatible(before, t)
                    if ok:
                        last[end] = t
                        break
                at = ending[link[at]]
        ids, end = [], len(data)
        while end:
            t = last[end]
            ids.append(t)
            end -= len(self.content[t])
        return ids[::-1]

    def _learn(self, word: str) -> tuple[str, bytes]:
        known = self.recent.get(word) or self.older.get(word)
        if known is None:
            ids = self.encode_bytes(word.encode())
            known = ",".join(map(str, ids)), self.decode(ids)
        if len(word) <= LONGEST_REMEMBERED:
            if len(self.recent) >= REMEMBERED:
                self.older, self.recent = self.recent, {}
            self.recent[word] = known
        return known

    def decode(self, ids: list[int]) -> bytes:
        content = self.content
        return b"".join([content[i] for i in ids])

    def pieces(self, text: str) -> list[tuple[str, bytes]]:
        """(ids as text, decoded bytes) of the pre-tokens and special tokens of a whole text."""
        out = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append((str(self.special[part]), self.decode([self.special[part]])))
            elif part:
                words = PRE_TOKEN.findall(part)
                known = list(map(self.recent.get, words))
                if None in known:
                    known = [self._learn(word) if k is None else k for k, word in zip(known, words)]
                out += known
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _ in self.pieces(text) for i in ids.split(",")]


_ENCODERS: dict[str, Encoder] = {}  # one per worker, by vocabulary file


def _encode_batches(tables: Broadcast, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(path)
        if encoder is None:
            _ENCODERS.clear()
            encoder = _ENCODERS[path] = Encoder(tables.value)
        for batch in batches:
            sizes, id_sums, text_sums = [], [], []
            for text in batch.column("text"):
                pieces = encoder.pieces(text.as_py() or "")
                ids = ",".join([p[0] for p in pieces])
                sizes.append(ids.count(",") + 1 if ids else 0)
                id_sums.append(sha256(ids.encode()).hexdigest())
                decoded = b"".join([p[1] for p in pieces]).decode("utf-8", "replace")
                text_sums.append(sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(sizes, pa.int64()), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())],
                ["doc", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def encode_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) for every row; a null text counts as empty. Further columns are ignored."""
    tables = df.sparkSession.sparkContext.broadcast(load_tables(path))
    rows = df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc"]
    found = rows.mapInArrow(_encode_batches(tables, path), f"doc {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return found.withColumnRenamed("doc", id_col)


def _ids_batches(tables: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tables.value)
        for batch in batches:
            ids = [encoder.encode(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(ids, pa.list_(pa.int32()))], ["doc", "ids"])

    return run


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) for every row."""
    tables = df.sparkSession.sparkContext.broadcast(load_tables(path))
    rows = df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(_ids_batches(tables), f"doc {dict(rows.dtypes)['doc']}, ids array<int>")
    return found.withColumnRenamed("doc", id_col)


def _text_batches(tables: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tables.value)
        for batch in batches:
            texts = [encoder.decode(i.as_py() or []).decode("utf-8", "replace") for i in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(texts, pa.string())], ["doc", "text"])

    return run


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) for every row of token ids; null ids give an empty text."""
    tables = df.sparkSession.sparkContext.broadcast(load_tables(path))
    rows = df.select(F.col(id_col).alias("doc"), F.col(ids_col).cast("array<int>").alias("ids"))
    found = rows.mapInArrow(_text_batches(tables), f"doc {dict(rows.dtypes)['doc']}, text string")
    return found.select(F.col("doc").alias(id_col), "text")
