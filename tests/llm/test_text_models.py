"""Language identification and toxicity: held-out accuracy, the way back through time, odd inputs."""

import zlib

import numpy as np
import pyarrow as pa

from clickloom.llm import lang_id, toxicity
from clickloom.llm.common import prepare, table
from clickloom.llm.queries import op4_lang_id, op5_toxicity

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    found = op4_lang_id(spark, SF)
    assert found.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    truth = {r["doc_id"]: r["lang"] for r in table(spark, SF, "documents").collect()}
    rows = found.collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and truth[r["doc_id"]] is not None]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95


def test_gradients():
    """The way back agrees with finite differences."""
    rng = np.random.default_rng(0)
    size = lang_id.HIDDEN
    way = lang_id.Direction(
        rng.standard_normal((3 * size, 256)).astype(np.float32) * 0.3,
        rng.standard_normal((3 * size, size)).astype(np.float32) * 0.3,
        np.zeros((2, size), np.float32),
    )
    letters = rng.integers(0, 256, (6, 5)).astype(np.uint8)
    pull = rng.standard_normal((6, size, 5)).astype(np.float32)

    def loss():
        return float((lang_id._train_direction(way, letters)[0] * pull).sum())

    _, kept = lang_id._train_direction(way, letters)
    on_byte, on_recur = lang_id._backpropagate(way, letters, kept, pull)
    for weight, grad in ((way.recur, on_recur), (way.of_byte, on_byte)):
        for _ in range(12):
            i, j = int(rng.integers(weight.shape[0])), int(rng.integers(weight.shape[1]))
            if weight is way.of_byte:
                j = int(letters.ravel()[rng.integers(letters.size)])
            old = weight[i, j]
            weight[i, j] = old + 1e-2
            up = loss()
            weight[i, j] = old - 1e-2
            down = loss()
            weight[i, j] = old
            assert abs((up - down) / 2e-2 - grad[i, j]) < 2e-2 * max(1.0, abs(grad[i, j]))


def test_windows_cover_whole_texts():
    texts = ["", "a", "b" * 64, "c" * 65, None, "d" * 200]
    raw, off = lang_id.utf8_buffers(pa.array(texts, pa.string()))
    windows, row = lang_id._windows(raw, off)
    assert row.tolist() == [1, 2, 3, 3, 5, 5, 5, 5]
    assert (windows != 0).sum() == sum(len(t or "") for t in texts)


def small_model():
    texts = ["the quick brown fox " * 20, "der schnelle braune fuchs " * 20] * 5
    return lang_id.train(texts, ["en", "de"] * 5)


def test_language_of_odd_rows(spark):
    prepare(spark)
    model = small_model()
    rows = [(1, None, 1), (2, "", 1), (3, "123 !?", 1), (None, "the quick fox", 1), (5, "der fuchs " * 9_000, 1), (1, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    found = lang_id.identify(df, model).collect()
    assert sorted((str(r["doc_id"]), r["lang_pred"], r["held_out"]) for r in found) == sorted(
        (str(i), "und" if t is None or not any(c.isalpha() for c in t) else ("de" if "der" in t else "en"), i is None or zlib.crc32(str(i).encode()) % 5 == 0)
        for i, t, _ in rows
    )
    kept = lang_id.keep_identified(df, model)
    assert kept.columns == df.columns and kept.count() == 2
    assert lang_id.identify(df.limit(0), model).collect() == []
    assert {r["lang_pred"] for r in lang_id.identify(df, None).collect()} == {"und"}


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert lang_id.fit(df) is None
    assert lang_id.fit(df.limit(0)) is None


def test_positions_get_labels():
    model = small_model()
    text = "the quick brown fox " * 10 + "der schnelle braune fuchs " * 10
    runs = lang_id.label_positions(model, text)
    assert runs[0][0] == 0 and runs[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(runs, runs[1:]))
    first = sum(b - a for a, b, lang in runs if lang == "en" and b <= 200)
    assert first > 150


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    found = {r["doc_id"]: r for r in op5_toxicity(spark, sf).collect()}
    marks = {r["doc_id"]: r["toxic"] for r in table(spark, sf, "labels").collect()}
    held = [(found[i], mark) for i, mark in marks.items() if i in found and found[i]["held_out"]]
    toxic = [r["predicted"] for r, mark in held if mark == 1]
    clean = [r["predicted"] for r, mark in held if mark == 0]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.03
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in found.values())


def test_features_against_plain_python():
    hit = np.ones(1 << toxicity.SLOTS_LOG2, np.uint8)
    texts = ["Ab!", "", "ééàü", "abcabcabc"]
    row, slots = toxicity.features(hit, texts)
    for i, text in enumerate(texts):
        low = text.lower()
        padded = low + toxicity._GAP
        grams = {padded[k : k + n] for n in toxicity.ORDERS for k in range(len(low))}
        assert np.count_nonzero(row == i) == len(grams)


def test_texts_do_not_touch():
    """A text scores the same alone and beside others."""
    model = toxicity.train(["you idiot person"] * 20 + ["idiot"] * 20, ["a fine day"] * 30 + ["person"] * 30)
    together = toxicity.score(model, ["you id", "iot", "idiot", "", "a fine day"])
    alone = [toxicity.score(model, [t])[0] for t in ("you id", "iot", "idiot", "", "a fine day")]
    assert np.allclose(together, alone) and together[2] > 0.5 > together[4]


def test_toxicity_of_odd_rows(spark):
    model = toxicity.train(["you idiot"] * 20, ["a fine day"] * 20)
    rows = [(None, "idiot", 1), (1, None, 1), (1, None, 1), (2, "x" * 300_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out int")
    found = toxicity.rate(df, model).collect()
    assert len(found) == 4 and toxicity.keep_clean(df, model).columns == df.columns
    assert toxicity.rate(df.limit(0), model).collect() == []
    none = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["predicted"] for r in toxicity.rate(df, none).collect()} <= {0, 1}


def test_toxicity_of_a_model_that_learned_nothing(spark):
    df = spark.createDataFrame([(1, "you idiot"), (2, "a fine day"), (3, None), (4, "")], "doc_id long, text string")
    none = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    for model in (none, toxicity.train(["same"] * 9, ["same"] * 3), toxicity.train(["a"], [])):
        assert {r["predicted"] for r in toxicity.rate(df, model).collect()} == {0}
        assert toxicity.keep_clean(df, model).count() == 4
