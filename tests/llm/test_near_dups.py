"""Near-duplicates against brute force, the sketch's promise, components, and odd inputs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from clickloom.llm import near_dups
from clickloom.llm.common import prepare, table
from clickloom.llm.components import connected

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, n):
    words = WORDS.findall(lower_ascii(text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def brute_force(rows, n, percent):
    """(n_shingles, component) by id, comparing every pair that shares a shingle."""
    sets = {i: shingles(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    by_shingle = {}
    for i in ids:
        for s in sets[i]:
            by_shingle.setdefault(s, []).append(i)
    pairs = {(a, b) for group in by_shingle.values() for k, a in enumerate(group) for b in group[k + 1 :]}
    for a, b in pairs:
        common = len(sets[a] & sets[b])
        if 100 * common >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def as_dict(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def made_up_rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows, base = [], [rng.choice(words) for _ in range(80)]
    for i in range(400):  # one large group at every distance from its base
        text = list(base)
        for _ in range(rng.randrange(0, 9)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(150)]
    rows += [(2000 + i, rows[i * 7][1].upper()) for i in range(20)]
    rows += [(3000, None), (3001, ""), (3002, " \t\n"), (3003, "one two"), (3004, "ONE  two"), (3005, "one"), (3006, "two one")]
    return rows


@pytest.mark.parametrize("words", [4, 5])
def test_matches_brute_force(spark, words):
    prepare(spark)
    rows = made_up_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_dict(near_dups.near_duplicates(df, words=words)) == brute_force(rows, words, 80)


def test_small_blocks_give_the_same(spark, monkeypatch):
    """Band keys cut into many blocks are searched across blocks."""
    monkeypatch.setattr(near_dups, "BLOCK", 20)
    rows = made_up_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_dict(near_dups.near_duplicates(df, words=4)) == brute_force(rows, 4, 80)


def test_whole_table(spark):
    docs = table(prepare(spark), "/root/testdata/sf0.001", "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert as_dict(near_dups.near_duplicates(docs, words=4)) == brute_force(rows, 4, 80)


def test_odd_rows(spark):
    schema = "doc_id long, text string, doc long, near string, rep int"
    long_text = " ".join(f"x{i % 5000}" for i in range(60_000))
    rows = [(None, "a b c d e f", 1, "n", 2), (5, "a b c d e f", 1, "n", 2), (5, "a b c d e f", 1, "n", 2), (7, long_text, 0, "", 0)]
    rows += [(6, long_text + " end", 0, None, None)]
    found = near_dups.near_duplicates(spark.createDataFrame(rows, schema), words=4).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in found) == [
        ("5", "5", True),
        ("5", "5", True),
        ("6", "6", True),
        ("7", "6", False),
        ("None", "None", True),
    ]
    kept = near_dups.keep_one(spark.createDataFrame(rows, schema))
    assert kept.columns == ["doc_id", "text", "doc", "near", "rep"]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["5", "6", "None"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_dups.near_duplicates(df).collect() == []
    assert near_dups.keep_one(df).collect() == []


def test_sketch_lets_similar_sets_pass():
    rng = np.random.default_rng(1)
    limit = near_dups.most_differing_bits(0.8)
    for _ in range(300):
        common = rng.integers(0, 1 << 63, 160, dtype=np.uint64)
        a = np.concatenate([common, rng.integers(0, 1 << 63, 20, dtype=np.uint64)])
        b = np.concatenate([common, rng.integers(0, 1 << 63, 20, dtype=np.uint64)])
        x, y = (near_dups.odd_sketch(near_dups.minhash(np.unique(s))) for s in (a, b))
        assert int(np.bitwise_count(x ^ y).sum()) <= limit


def test_words_as_in_the_contract():
    texts = ["A b\x0bC", " lead", "trail ", "é É", "", None, "a b c"]
    hashes, first = near_dups.word_hashes(pa.array(texts, pa.string()))
    assert np.diff(first).tolist() == [len(WORDS.findall(t or "")) for t in texts]
    alone, _ = near_dups.word_hashes(pa.array(["a", "b", "c"]))
    assert hashes[:3].tolist() == alone.tolist()


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (None, 3), (5000, 4000)]
    rng.shuffle(edges)
    found = {r["node"]: r["label"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(50)} | {5000: 4000, 4000: 4000}
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []


def test_an_id_with_several_texts(spark):
    """Every text of an id is linked for itself, and only what is alike goes."""
    a = " ".join(f"w{i}" for i in range(40))
    b = " ".join(f"v{i}" for i in range(40))
    rows = [(1, a, "x"), (2, b, "x"), (2, a + " more", "x"), (3, b + " more", "y"), (2, a + " more", "z"), (4, "", "x"), (4, None, "x"), (None, a, "x")]
    df = prepare(spark).createDataFrame(rows, "doc_id long, text string, node string")
    found = near_dups.near_duplicates(df).collect()
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in found)
    assert got == sorted(
        [("1", 36, "1", True), ("2", 36, "2", True), ("2", 37, "1", False), ("2", 37, "1", False), ("3", 37, "2", False)]
        + [("4", 0, "4", True)] * 2 + [("None", 36, "None", True)]
    )
    kept = near_dups.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect()) == [("1", a), ("2", b), ("4", ""), ("None", a)]


def test_unlike_texts_of_an_id_all_stay(spark):
    texts = [" ".join(f"{c}{i}" for i in range(30)) for c in "abc"]
    df = prepare(spark).createDataFrame([(7, t) for t in texts + texts[:1]] + [(8, texts[2])], "doc_id long, text string")
    assert sorted(r["text"] for r in near_dups.keep_one(df).collect()) == sorted(texts)
