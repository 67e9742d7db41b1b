"""Operators 11 to 13 against plain Python, with nulls, ties, repeated rows, long groups and tiny limits."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from clickloom.llm import divergence, prefix_trie, repeats
from clickloom.llm.common import prepare

# ---- conversation prefix trie

TURNS = "conv_id long, turn long, role string, text string, path string, key string"


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built = tuple(own.get(base, [])[:h] + own[c][h:])
        ends[built].append(c)
        for d in range(len(built) + 1):
            members[built[:d]].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    totals = {}
    for k in sorted(members, key=len, reverse=True):
        leaves = sum(totals[x][0] for x in children[k]) or 1
        saved = (len(members[k]) - 1) * len(k[-1][1]) if k else 0
        totals[k] = leaves, saved + sum(totals[x][1] for x in children[k])
    return sorted(
        (
            min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), *totals[k],
            hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest(),
        )
        for k, m in members.items()
    )


def trie_rows(df, **how):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in prefix_trie.prefix_trie(df, **how).select(*cols).collect())


def talk(seed=1):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-5, 20), 100, *range(103, 140), 205, 10**15 + 7]:
        for t in range(rng.choice([0, 1, 2, 3, 7, 9])):
            rows.append((c, t, rng.choice(["user", "bot", None]), rng.choice(["a", "b", "ab", "é😀", "", None]), "p", "k"))
    rows += [(300, t, "user", "same", "p", "k") for t in range(8)] + [(c, t, "user", "same", "p", "k") for c in range(301, 360) for t in range(8)]
    rows += [(400, t, "user", str(t % 7), "p", "k") for t in range(150)]  # longer than a piece and a shard
    rows += [(None, 1, "user", "x", "p", "k"), (500, None, "user", "first", "p", "k"), (500, 3, "b", "x", "p", "k"), (500, 3, "a", "y", "p", "k")]
    rows += [(500, 3, "a", "y", "p", "k"), (500, 3, "a", "y" * 5000, "p", "k")]
    return rows


@pytest.mark.parametrize("how", [{}, {"shard_rows": 20, "queue_rows": 3, "piece_turns": 4}, {"shard_rows": 7, "queue_rows": 1, "piece_turns": 64}])
def test_trie_equals_plain_python(spark, how):
    rows = talk()
    df = prepare(spark).createDataFrame(rows, TURNS).repartition(5)
    assert trie_rows(df, **how) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert trie_rows(prepare(spark).createDataFrame([], TURNS)) == []
    lone = spark.createDataFrame([(7, 0, None, None, "p", "k")], TURNS)
    assert trie_rows(lone) == plain_trie([(7, 0, None, None)])


def test_queue_spills_and_adds_up():
    rng = random.Random(3)
    queue, want = prefix_trie.SpillingQueue(5), Counter()
    for _ in range(300):
        level, key = rng.randrange(6), bytes([rng.randrange(9)])
        queue.push(level, key, (1, level))
        want[(-level, key)] += 1
    assert queue.runs
    got = []
    while queue.first() is not None:
        got.append(queue.pop())
    assert [g[0] for g in got] == sorted(want)
    assert all(amounts == (want[at], -at[0] * want[at]) for at, amounts in got)


# ---- source divergence

DOCS = "doc_id long, text string, lang string, source string, term string, value long"


def plain_divergence(rows, least_docs=10, top=10):
    docs = [((r[1] or ""), (r[2] or ""), (r[3] or "")) for r in rows]
    groups = {(lang, src) for _, lang, src in docs}
    df, counts = Counter(), Counter()
    for text, lang, src in docs:
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
        df.update({(lang, t) for t in terms})
        counts.update((lang, src, t) for t in terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (la, t), n in df.items() if la == lang and n >= least_docs)
        sources = sorted(s for la, s in groups if la == lang)

        def shares(c):
            n = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        by = {s: {t: counts[(lang, s, t)] for t in kept} for s in sources}
        p = {s: shares(by[s]) for s in sources}
        q = shares({t: sum(by[s][t] for s in sources) for t in kept})
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(sorted(pairs))]
            terms = [(-((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])), t.encode(), t) for t in kept if by[s][t] and p[s][t] > q[t]]
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(sorted(terms)[:top])]
    return sorted(out)


def divergence_rows(df, **how):
    return sorted(tuple(r) for r in divergence.divergences(df, **how).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("how", [{}, {"block": 2, "salt_terms": 3, "most_cells": 5}])
def test_divergence_equals_plain_python(spark, how):
    rng = random.Random(5)
    rows = []
    for i in range(260):
        words = rng.choices(["The", "the", "größe", "ÉT", "x1y", "_a_", "new", "I", "😀", "rare%d" % i], k=rng.randrange(12))
        rows.append((i, " ".join(words), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "ü", "", None]), "t", 1))
    rows += [(900 + i, None, "xx", "only%d" % i, "t", 1) for i in range(3)] + [(999, "one", "yy", "alone", "t", 1)] + rows[:20]
    df = prepare(spark).createDataFrame(rows, DOCS).repartition(4)
    assert divergence_rows(df, **how) == plain_divergence(rows)


def test_divergence_of_nothing_and_of_huge_counts(spark):
    assert divergence_rows(prepare(spark).createDataFrame([], DOCS)) == []
    from pyspark.sql import functions as F

    big = spark.createDataFrame([(9_000_000_000_000, 70_000_000_000_001)], "c long, m long")
    assert big.select(divergence.share(F.col("c"), F.col("m"))).first()[0] == 1 + 10**9 * 9_000_000_000_002 // 70_000_000_000_001


def test_terms_of_long_texts():
    text = ("Straße\x00b C-d 漢字x " * 200_000).encode()
    assert Counter(t for ts in divergence.term_lists(text) for t in ts) == Counter({t.encode(): 200_000 for t in ("straße", "b", "c", "d", "漢字x")})
    assert [t for ts in divergence.term_lists(b"A" * 3_000_000 + b" b") for t in ts] == [b"a" * 3_000_000, b"b"]


# ---- substring deduplication

TEXTS = "doc_id long, text string, row long, bucket string, kind long"


def plain_repeats(rows, window=13):
    words = [re.findall("[^\x20\x09-\x0d]+", r[1] or "") for r in rows]
    least = {}
    for (doc, *_), ws in zip(rows, words):
        for i in range(len(ws) - window + 1):
            k = tuple(ws[i : i + window])
            if doc is not None:
                least[k] = min(least.get(k, doc), doc)
    out = []
    for (doc, *_), ws in zip(rows, words):
        gone = set()
        for i in range(len(ws) - window + 1):
            if doc is not None and least[tuple(ws[i : i + window])] < doc:
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((doc, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def some_texts():
    rng = random.Random(11)
    word = lambda: rng.choice("abcdefgh") * rng.randrange(1, 3)
    passage = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(120):
        ws = [word() for _ in range(rng.choice([0, 5, 12, 13, 14, 60]))]
        if i % 3 == 0:
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = passage[: rng.choice([12, 13, 20, 30])]
        rows.append((rng.randrange(10**12) - 10**11, rng.choice([" ", "\n", "\t "]).join(ws), i, "b", 1))
    whole = " ".join(passage)
    rows += [(5, whole, 1, "b", 1), (5, whole, 1, "b", 1), (5, whole + " tail", 1, "b", 1), (6, whole, 1, "b", 1), (6, whole.upper(), 1, "b", 1)]
    rows += [(None, whole, 1, "b", 1), (7, None, 1, "b", 1), (8, "", 1, "b", 1), (-(2**63), "x " + whole, 1, "b", 1), (2**63 - 1, "a " * 40 + "é😀 " * 20, 1, "b", 1)]
    rows += [(1000 + i, "copy " * 15 + whole, 1, "b", 1) for i in range(60)]  # a group of copies
    return rows


@pytest.mark.parametrize("how", [{}, {"bucket_bytes": 300}, {"bucket_bytes": 2_000, "per_window": 1, "window": 5}])
def test_repeats_equal_plain_python(spark, how):
    rows = some_texts()
    df = prepare(spark).createDataFrame(rows, TEXTS).repartition(6)
    got = repeats.remove_repeats(df, **how).collect()
    assert sorted(map(tuple, got), key=repr) == plain_repeats(rows, how.get("window", 13))


def test_repeats_of_nothing_and_kept_words(spark):
    empty = prepare(spark).createDataFrame([], TEXTS)
    assert repeats.remove_repeats(empty).collect() == []
    text = " ".join(f"v{i}" for i in range(13))
    df = spark.createDataFrame([(1, text, 1, "b", 1), (2, f"new {text}\nend", 1, "b", 1)], TEXTS)
    assert {r.doc_id: r.kept for r in repeats.remove_repeats(df, with_text=True).collect()} == {1: text, 2: "new end"}


def test_sketch_never_estimates_too_low(monkeypatch):
    """Windows estimated once do stand once: no repeated window is lost, however full the sketch."""
    rng = np.random.default_rng(2)
    for places in (np.array([], np.int64), np.array([0]), np.unique(rng.integers(0, 1 << 22, 5000)), np.arange(70_000) * 50, np.array([0, (1 << 22) - 1])):
        assert (repeats.unpack_places(repeats.pack_places(places)) == places).all()


def test_words_across_pieces(monkeypatch):
    text = ("alpha beta\tgamma " * 50 + "x" * 300 + " end").encode()
    whole = repeats.words_of(np.frombuffer(text, np.uint8))
    monkeypatch.setattr(repeats, "PIECE", 37)
    assert (repeats.words_of(np.frombuffer(text, np.uint8)) == whole).all()
    assert whole.shape[1] == len(text.split()) and len(np.unique(whole[0])) == 5
