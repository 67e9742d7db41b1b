"""Source divergence audit: how far the word use of each source is from the other sources of its language.

In-mapper stripes. A task folds whole documents into hash stripes, one per (language, term): the number of
documents with the term and a count per source. When its stripes hold ``STRIPE_CELLS`` cells it spills them as
rows; the rows of one key meet by a shuffle, sorted, and are merged one after the other. Merged
stripes that reach the document frequency are stored, and hand out divergences directly:

* ``term``: one value per source in the stripe against the whole language; Spark trims every task's rows to the
  first ten of a group before they move.
* ``pair``: sources of a language are numbered into blocks of ``BLOCK``. A stripe goes to the pairs of blocks it
  touches, split by a hash of its term; a task adds up a block of source pairs. Terms that none of two sources has
  add the same value each, which is added once, times their number.

All values are exact integers: products that may leave 64 bits are decimals.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.common import utf8_buffers
from clickloom.session import materialise, work_path

LEAST_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
STRIPE_CELLS = 1_000_000  # (term, source) cells a task holds before it spills
SPILL_ROWS = 8_192
MERGE_ROWS = 16_384  # rows merged in one step
BLOCK = 128  # sources of a block
SALT_TERMS = 8_192  # terms added up under one key
PIECE = 1 << 20  # bytes of a text handled at once
BROADCAST_BYTES = 4_000_000  # groups of this size may be sent to every task
CELLS = 1 << 21  # products held at once

_LETTERS = bytearray(b" " * 128 + bytes(range(128, 256)))
for _c in range(65, 91):
    _LETTERS[_c] = _LETTERS[_c + 32] = _c + 32
_LETTERS = bytes(_LETTERS)

_STRIPE_NAMES = ["lang", "term", "docs", "sources", "counts"]
STRIPES = "lang string, term string, docs long, sources array<string>, counts array<long>"


def term_lists(raw: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, piece by piece: runs of letters A-Z, a-z and of all characters beyond ASCII; A-Z count as a-z."""
    at = 0
    while at < len(raw):
        piece = raw[at : at + PIECE].translate(_LETTERS)
        end = len(piece)
        if at + end < len(raw):  # cut behind the last separator; one endless word is read whole
            end = piece.rfind(b" ") + 1
            if not end:
                piece = raw[at:].translate(_LETTERS)
                end = piece.find(b" ") + 1 or len(piece)
        yield piece[:end].split()
        at += end


def _stripe_rows(docs: dict[str, Counter], counts: dict[tuple[str, str], Counter]) -> Iterator[pa.RecordBatch]:
    """What a task holds as stripes; ``counts`` is emptied on the way."""
    for lang, of_lang in docs.items():
        table: dict[bytes, tuple[list, list]] = {}
        for key in [k for k in counts if k[0] == lang]:
            for term, n in counts.pop(key).items():
                stripe = table.get(term)
                if stripe is None:
                    table[term] = [key[1]], [n]
                else:
                    stripe[0].append(key[1])
                    stripe[1].append(n)
        terms = list(table)
        for at in range(0, len(terms), SPILL_ROWS):
            some = terms[at : at + SPILL_ROWS]
            cells = [table[t] for t in some]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(some), pa.string()),
                    pa.array(some, pa.binary()).cast(pa.string()),
                    pa.array([of_lang[t] for t in some], pa.int64()),
                    pa.array([c[0] for c in cells], pa.list_(pa.string())),
                    pa.array([c[1] for c in cells], pa.list_(pa.int64())),
                ],
                names=_STRIPE_NAMES,
            )


def _fold(most_cells: int):
    """Whole documents into stripes; ``most_cells`` bounds what is held besides the document at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: dict[str, Counter] = {}
        counts: dict[tuple[str, str], Counter] = {}
        cells = 0
        for batch in batches:
            raw, off = utf8_buffers(batch.column("text"))
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for i, key in enumerate(zip(langs, sources)):
                count, distinct = counts.setdefault(key, Counter()), set()
                cells -= len(count)
                for terms in term_lists(raw[off[i] : off[i + 1]].tobytes()):
                    count.update(terms)
                    distinct.update(terms)
                cells += len(count)
                docs.setdefault(key[0], Counter()).update(distinct)
                if cells >= most_cells:
                    yield from _stripe_rows(docs, counts)
                    docs, counts, cells = {}, {}, 0
        yield from _stripe_rows(docs, counts)

    return run


def _merged(rows: pa.Table, least_docs: int) -> pa.RecordBatch:
    """One row per key of rows sorted by key; all keys below ``least_docs`` documents go but the last, which may go on."""
    lang, term, docs, sources, counts = (rows.column(c).combine_chunks() for c in _STRIPE_NAMES)
    n = rows.num_rows
    first = np.ones(n, bool)
    if n > 1:
        same = pc.and_(pc.equal(lang.slice(1), lang.slice(0, n - 1)), pc.equal(term.slice(1), term.slice(0, n - 1)))
        first[1:] = ~same.to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(first)
    total = np.add.reduceat(docs.to_numpy(), starts)
    stay = total >= least_docs
    stay[-1] = True
    group = np.cumsum(first) - 1
    use = np.flatnonzero(stay[group])
    number = (np.cumsum(stay) - 1)[group[use]]
    sources, counts = sources.take(pa.array(use)), counts.take(pa.array(use))
    sizes = np.diff(sources.offsets.to_numpy())
    names = sources.flatten().dictionary_encode()
    code = np.repeat(number, sizes) * len(names.dictionary) + names.indices.to_numpy()
    cells, place = np.unique(code, return_inverse=True)
    sums = np.zeros(len(cells), np.int64)
    np.add.at(sums, place, counts.flatten().to_numpy())
    owner, name = np.divmod(cells, max(1, len(names.dictionary)))
    offsets = pa.array(np.searchsorted(owner, np.arange(int(stay.sum()) + 1)), pa.int32())
    keys = pa.array(starts[stay])
    return pa.RecordBatch.from_arrays(
        [
            lang.take(keys),
            term.take(keys),
            pa.array(total[stay], pa.int64()),
            pa.ListArray.from_arrays(offsets, names.dictionary.take(pa.array(name))),
            pa.ListArray.from_arrays(offsets, pa.array(sums)),
        ],
        names=_STRIPE_NAMES,
    )


def _merge(least_docs: int):
    """Stripes sorted by (language, term) into one per key; those in fewer than ``least_docs`` documents go.

    Only the stripe of the last key is held from one step to the next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= MERGE_ROWS:
                done = _merged(pa.Table.from_batches(held), least_docs)
                yield done.slice(0, done.num_rows - 1)
                held, rows = [done.slice(done.num_rows - 1)], 1
        if held:
            done = _merged(pa.Table.from_batches(held), least_docs)
            yield done if done.column("docs")[-1].as_py() >= least_docs else done.slice(0, done.num_rows - 1)

    return run


def stripes(df: DataFrame, least_docs: int = LEAST_DOCS, most_cells: int = STRIPE_CELLS) -> DataFrame:
    """(lang, term, docs, sources, counts) of ``df`` (lang, source, text, none null): one row per kept term."""
    return (
        df.mapInArrow(_fold(most_cells), STRIPES)
        .repartition("lang", "term")
        .sortWithinPartitions("lang", "term")
        .mapInArrow(_merge(least_docs), STRIPES)
    )


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / total), exact beyond 64 bits."""
    scaled = F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    return (F.lit(1) + F.call_function("div", scaled, total.cast("decimal(20,0)"))).cast("long")


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q))."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sum over terms (rows) of the gaps of all pairs of columns."""
    total = np.zeros((p.shape[1], q.shape[1]), np.int64)
    step = max(1, CELLS // max(1, total.size))
    for at in range(0, len(p), step):
        a, b = p[at : at + step, :, None], q[at : at + step, None, :]
        total += ((a - b) ** 2 // (a + b)).sum(axis=0)
    return total


PAIR_INPUT = ["lang", "lo", "hi", "salt", "kind", "term", "side", "place", "p", "names", "terms"]


def _add_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (lang, lo, hi, salt, kind, term): first the blocks of both sides, then stripes."""
    key, ends, term, total, seen = None, {}, None, None, 0
    rows: list[list[np.ndarray]] = []

    def add() -> None:
        nonlocal total, seen, rows
        if not rows:
            return
        low, high = (np.stack([r[s] for r in rows]) for s in (0, 1))
        total += _gaps(low, low if key[1] == key[2] else high)
        seen += len(rows)
        rows = []

    def ended() -> pa.RecordBatch:
        add()
        (names, rest, terms), (others, rest_hi, _) = ends[0], ends[1]
        alike = _gaps(rest[None], rest_hi[None])
        values = total - seen * alike + (terms * alike if key[3] == 0 else 0)
        a, b = np.repeat(np.arange(len(names)), len(others)), np.tile(np.arange(len(others)), len(names))
        same = key[1] == key[2]
        use = np.flatnonzero(a != b) if same else np.arange(len(a))
        name, item, value = pa.array(names).take(pa.array(a[use])), pa.array(others).take(pa.array(b[use])), values.ravel()[use]
        if not same:
            name, item, value = pa.concat_arrays([name, item]), pa.concat_arrays([item, name]), np.tile(value, 2)
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]] * len(value), pa.string()), name.cast(pa.string()), item.cast(pa.string()), pa.array(value, pa.int64())],
            ["lang", "source", "item", "part_value"],
        )

    for batch in batches:
        for r in batch.to_pylist():
            at = (r["lang"], r["lo"], r["hi"], r["salt"])
            if at != key:
                if key is not None:
                    yield ended()
                key, ends, term, total, seen = at, {}, None, None, 0
            if r["kind"] == 0:
                ends[r["side"]] = (r["names"], np.array(r["p"], np.int64), r["terms"])
                if len(ends) == 1:
                    ends.setdefault(1 - r["side"], ends[r["side"]])
                total = np.zeros((len(ends[0][0]), len(ends[1][0])), np.int64)
                continue
            if r["term"] != term:
                if len(rows) * (len(ends[0][0]) + len(ends[1][0])) >= CELLS:
                    add()
                rows.append([ends[0][1].copy(), ends[1][1].copy()])
                term = r["term"]
            rows[-1][r["side"]][r["place"]] = r["p"]
    if key is not None:
        yield ended()


def _broadcast_if_small(groups: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hinted by what the stored ``groups`` take, not by Spark's estimate."""
    size = groups.agg(F.sum(F.octet_length("lang") + F.octet_length("source") + 128)).first()[0] or 0
    return F.broadcast(groups) if size <= most_bytes else groups.hint("merge")


def divergences(
    df: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least_docs: int = LEAST_DOCS,
    top_terms: int = TOP_TERMS,
    most_cells: int = STRIPE_CELLS,
    block: int = BLOCK,
    salt_terms: int = SALT_TERMS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` per other source, part ``term`` for the telling terms.

    Null texts, languages and sources count as empty strings. A language keeps the V terms that at least
    ``least_docs`` of its documents hold; with count occurrences of a kept term and N of all of them, a group's share is
    p = 1 + floor(10^9 (count + 2) / (N + 2 V)), and two shares are (p - q)^2 / (p + q) apart, rounded down. A group without
    kept terms still has its pairs, with 0 where the language keeps none; a language of one source has no pair. Equal values
    rank by item in UTF-8 order. Repeated rows count as documents of their own. Further columns are ignored, whatever
    their names; an empty table gives no rows. One document's distinct terms are held in memory at a time.
    """
    spark = df.sparkSession
    blank = F.lit("")
    docs = df.select(
        F.coalesce(F.col(lang_col).cast("string"), blank).alias("lang"),
        F.coalesce(F.col(source_col).cast("string"), blank).alias("source"),
        F.coalesce(F.col(text_col).cast("string"), blank).alias("text"),
    )
    path = work_path(spark, "stripes")
    stripes(docs, least_docs, most_cells).write.parquet(path)
    kept = spark.read.parquet(path)

    cells = kept.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("c")).select(
        "lang", "term", F.col("c.sources").alias("source"), F.col("c.counts").alias("count")
    )
    # stored stripes are small for Spark, what comes out of them is not: no side of these joins is broadcast by that size
    sums = cells.groupBy("lang", "source").agg(F.sum("count").alias("n")).hint("merge")
    vocabulary = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms")).hint("merge")
    by_lang = Window.partitionBy("lang")
    groups = (
        docs.select("lang", "source")
        .distinct()
        .join(sums, ["lang", "source"], "left")
        .join(vocabulary, "lang", "left")
        .na.fill(0, ["n", "terms"])
        .withColumn("number", F.row_number().over(by_lang.orderBy("source")) - 1)
        .withColumn("lang_n", F.sum("n").over(by_lang))
        .withColumn("sources_n", F.count(F.lit(1)).over(by_lang))
    )
    groups = materialise(
        groups.select(
            "lang",
            "source",
            "terms",
            F.expr(f"number div {int(block)}").cast("int").alias("block"),
            F.expr(f"number % {int(block)}").cast("int").alias("place"),
            F.expr(f"(sources_n - 1) div {int(block)}").cast("int").alias("last_block"),
            F.greatest(F.col("n") + 2 * F.col("terms"), F.lit(1)).alias("mass"),
            F.greatest(F.col("lang_n") + 2 * F.col("terms"), F.lit(1)).alias("lang_mass"),
            F.expr(f"greatest((terms + {int(salt_terms) - 1}) div {int(salt_terms)}, 1L)").cast("int").alias("salts"),
        )
    )

    # terms of a group against its language
    totals = kept.select("lang", "term", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("whole"), "sources", "counts")
    known = totals.select("lang", "term", "whole", F.explode(F.arrays_zip("sources", "counts")).alias("c")).select(
        "lang", "term", "whole", F.col("c.sources").alias("source"), F.col("c.counts").alias("count")
    )
    rated = known.hint("merge").join(_broadcast_if_small(groups), ["lang", "source"]).withColumn("p", share(F.col("count"), F.col("mass")))
    telling = rated.withColumn("q", share(F.col("whole"), F.col("lang_mass"))).where("count > 0 and p > q")
    telling = telling.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    telling = telling.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)

    # pairs of sources, block by block
    vectors = groups.groupBy("lang", "block").agg(
        F.sort_array(F.collect_list(F.struct("place", "source", share(F.lit(0), F.col("mass")).alias("p")))).alias("of"),
        F.first("last_block").alias("last_block"),
        F.first("salts").alias("salts"),
        F.first("terms").alias("terms"),
    )
    vectors = materialise(vectors.select("*", F.col("of.p").alias("p"), F.col("of.source").alias("names")).drop("of"))
    other = F.explode(F.sequence(F.lit(0), F.col("last_block"))).alias("other")
    lo, hi = F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")
    side = F.when(F.col("block") <= F.col("other"), 0).otherwise(1).cast("int").alias("side")
    blocks = (
        vectors.select("*", other)
        .select("lang", lo, hi, side, "p", "names", "terms", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        .select(
            "lang",
            "lo",
            "hi",
            "salt",
            F.lit(0).alias("kind"),
            F.lit("").alias("term"),
            "side",
            F.lit(None).cast("array<int>").alias("place"),
            "p",
            "names",
            "terms",
        )
    )
    cut = rated.groupBy("lang", "term", "block", "last_block", "salts").agg(F.collect_list(F.struct("place", "p")).alias("of"))
    cut = cut.select("*", F.col("of.place").alias("place"), F.col("of.p").alias("p")).drop("of")
    moved = cut.select("*", other).select(
        "lang",
        lo,
        hi,
        F.pmod(F.xxhash64("term"), F.col("salts")).cast("int").alias("salt"),
        F.lit(1).alias("kind"),
        "term",
        side,
        "place",
        "p",
        F.lit(None).cast("array<string>").alias("names"),
        F.lit(None).cast("long").alias("terms"),
    )
    keys = ["lang", "lo", "hi", "salt"]
    parts = (
        blocks.unionByName(moved)
        .select(*PAIR_INPUT)
        .repartition(*keys)
        .sortWithinPartitions(*keys, "kind", "term", "side")
        .mapInArrow(_add_pairs, "lang string, source string, item string, part_value long")
    )
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("part_value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(telling)
