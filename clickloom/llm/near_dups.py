"""Near-duplicate documents: banded MinHash candidates, odd-sketch filter, exact check on full shingle sets.

One pass turns every text into its set of word shingles, 128 MinHash values, 32
band keys of four values and an odd sketch: a parity bitmap in which each
MinHash value flips one bit. Documents with the same set form a class whose
smallest id stands for it, so copies never meet each other. Class
representatives that share a band key meet in blocks; the population count of
the XOR of two sketches tells pairs that cannot reach the threshold, and the
rest are compared on their full sets inside the task. A task hands out only
the links that join something (a spanning forest), never all pairs.

A band key that holds many representatives is cut into blocks of ``BLOCK`` rows
by hash. First the blocks are searched one by one; then only those large band
keys that still span several components are searched across blocks, so a huge
group of alike documents costs no square. Two linked documents miss every
band with a chance of (1 - 0.8**4)**32 = 5e-8 at the threshold, and the sketch
lets pairs pass down to five standard deviations below it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from clickloom.llm.common import in_groups, slices_of, utf8_buffers
from clickloom.llm.components import connected
from clickloom.session import materialise, work_path

HASHES, BANDS, ROWS = 128, 32, 4
SKETCH_BITS = 512
BLOCK = 256
WORK_BYTES = 4 << 20  # text handled at once
MATRIX_BYTES = 64 << 20

U64 = np.uint64
_rng = np.random.default_rng(20_240_601)
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACES = _rng.integers(1, 1 << 63, 64, dtype=U64) * U64(2) + U64(1)
_SEEDS = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_STEPS = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 bits."""
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word and the first word of every row (one more entry than rows).

    Words are runs of bytes other than space and 09-0D; A-Z count as a-z.
    """
    raw, off = utf8_buffers(column)
    rows = len(off) - 1
    if not len(raw):
        return np.empty(0, U64), np.zeros(rows + 1, np.int64)
    low = _LOWER[raw]
    solid = ~_SPACE[low]
    first = np.zeros(len(raw) + 1, bool)
    first[off] = True
    before = np.empty_like(solid)
    before[0], before[1:] = False, solid[:-1]
    after = np.empty_like(solid)
    after[-1], after[:-1] = False, solid[1:]
    starts = np.flatnonzero(solid & (~before | first[:-1]))
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    powers = np.full(len(raw), _BASE)
    powers[0] = 1
    total = np.empty(len(raw) + 1, U64)
    total[0] = 0
    np.cumsum((low.astype(U64) + U64(1)) * np.cumprod(powers), out=total[1:])
    powers[1:] = _BASE_INVERSE
    back = np.cumprod(powers)[starts]
    words = mix((total[ends] - total[starts]) * back + (ends - starts).astype(U64) * _PLACES[0])
    return words, np.searchsorted(starts, off)


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its ``words``-word shingles.

    A shorter text is one shingle; a text without words has none.
    """
    hashes, first = word_hashes(column)
    counts = np.diff(first)
    shingles = np.zeros(len(hashes), U64)
    reach = max(0, len(hashes) - words + 1)
    for k in range(words):
        shingles[:reach] += hashes[k : k + reach] * _PLACES[k + 1]
    shingles = mix(shingles)
    out = []
    for start, n in zip(first[:-1].tolist(), counts.tolist()):
        if n >= words:
            out.append(np.unique(shingles[start : start + n - words + 1]))
        elif n:
            whole = (hashes[start : start + n] * _PLACES[words + 1 : words + 1 + n]).sum(dtype=U64, keepdims=True)
            out.append(mix(whole + U64(n)))
        else:
            out.append(np.empty(0, U64))
    return out


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The ``HASHES`` MinHash values of a non-empty set."""
    low = (shingles >> U64(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        seen = (low[None, at : at + 2048] ^ _SEEDS[:, None]) * _STEPS[:, None]
        np.minimum(best, seen.min(axis=1), out=best)
    return best


def odd_sketch(values: np.ndarray) -> np.ndarray:
    """Parity bitmap of the (place, value) pairs of MinHash samples, as bytes."""
    place = mix(values.astype(U64) + (np.arange(len(values), dtype=U64) << U64(32))) % U64(SKETCH_BITS)
    return np.packbits(np.bincount(place.astype(np.int64), minlength=SKETCH_BITS) & 1)


def most_differing_bits(share: float) -> int:
    """Bits in which two sketches may differ while a Jaccard similarity of ``share`` is still possible.

    Five standard deviations of the number of differing MinHash values, then five of
    the parity count those produce.
    """
    apart = HASHES * (1 - share) + 5 * np.sqrt(HASHES * share * (1 - share))
    odd = SKETCH_BITS / 2 * (1 - np.exp(-4 * min(apart, HASHES) / SKETCH_BITS))
    return int(np.ceil(odd + 5 * np.sqrt(SKETCH_BITS) / 4))


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a whole set."""
    a, b = mix(shingles + _PLACES[40]), mix(shingles ^ _PLACES[41])
    return int(a.sum(dtype=U64).view(np.int64)), int(np.bitwise_xor.reduce(b).view(np.int64)) if len(b) else 0


SKETCHES = "doc long, node long, t long, n long, h1 long, h2 long, bands array<long>, near binary"


def _sketch_batches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices_of(batch, "text", WORK_BYTES):
                sizes, one, two, bands, near = [], [], [], [], []
                for s in shingle_sets(piece.column("text"), words):
                    sizes.append(len(s))
                    d = _digest(s)
                    one.append(d[0])
                    two.append(d[1])
                    if not len(s):
                        bands.append(None)
                        near.append(None)
                        continue
                    values = minhash(s)
                    quads = values.reshape(BANDS, ROWS).astype(U64)
                    keys = mix((quads * _PLACES[50 : 50 + ROWS]).sum(axis=1, dtype=U64) + np.arange(BANDS, dtype=U64))
                    bands.append(keys.view(np.int64))
                    near.append(odd_sketch(values).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc"),
                        piece.column("node"),
                        piece.column("t"),
                        pa.array(sizes, pa.int64()),
                        pa.array(one, pa.int64()),
                        pa.array(two, pa.int64()),
                        pa.array(bands, pa.list_(pa.int64())),
                        pa.array(near, pa.binary()),
                    ],
                    ["doc", "node", "t", "n", "h1", "h2", "bands", "near"],
                )

    return run


def _promising(percent: int):
    """Rows of a block that have a partner whose sketch lets the threshold stand."""
    limit = most_differing_bits(percent / 100)

    def work(block: pa.Table) -> Iterator[pa.RecordBatch]:
        gid = block.column("gid").to_numpy()
        doc, comp = block.column("doc").to_numpy(), block.column("comp").to_numpy()
        side, n, band = (block.column(c).to_numpy() for c in ("side", "n", "band"))
        near = np.frombuffer(b"".join(block.column("near").to_pylist()), U64).reshape(len(gid), -1)
        marks = np.frombuffer(b"".join(block.column("marks").to_pylist()), np.uint32).reshape(len(gid), -1)
        keep = np.zeros(len(gid), bool)
        for gap in range(1, len(gid)):
            i = np.flatnonzero(gid[gap:] == gid[:-gap])
            if not len(i):
                break
            j = i + gap
            ok = (doc[i] != doc[j]) & (comp[i] != comp[j]) & (side[i] == -1)
            ok |= (comp[i] != comp[j]) & (side[i] != side[j])
            small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            ok &= 100 * small >= percent * large
            i, j = i[ok], j[ok]
            for at in range(0, len(i), 65_536):
                x, y = i[at : at + 65_536], j[at : at + 65_536]
                differ = np.bitwise_count(near[x] ^ near[y]).sum(axis=1)
                x, y = x[differ <= limit], y[differ <= limit]
                # the pair belongs to the first band it shares
                earlier = (marks[x] == marks[y]) & (np.arange(BANDS)[None, :] < band[x][:, None])
                fresh = ~earlier.any(axis=1)
                keep[x[fresh]] = True
                keep[y[fresh]] = True
        if keep.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(v[keep]) for v in (gid, side, doc, comp)], ["gid", "side", "doc", "comp"]
            )

    return in_groups(work, "gid")


def _set_batches(words: int):
    """(doc, shingles): the full set of every text whose digest is the expected one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices_of(batch, "text", WORK_BYTES):
                expected = zip(piece.column("h1").to_pylist(), piece.column("h2").to_pylist())
                docs, sets = [], []
                for s, node, digest in zip(shingle_sets(piece.column("text"), words), piece.column("node").to_pylist(), expected):
                    if _digest(s) == digest:  # else another row with this id
                        docs.append(node)
                        sets.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(sets, pa.binary())], ["doc", "shingles"])

    return run


def links_in(sets: list[np.ndarray], percent: int) -> Iterator[tuple[np.ndarray, int]]:
    """For each row but the first: the earlier rows it is linked with, exactly."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        yield np.array([0] if 100 * common >= percent * (sizes.sum() - common) else [], int), 1
        return
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, place, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts > 1
    number = np.cumsum(shared) - 1
    use = shared[place]
    column, row = number[place[use]], owner[use]
    common = np.zeros((len(sets), len(sets)), np.int64)
    width = max(1, MATRIX_BYTES // len(sets))
    for low in range(0, int(shared.sum()), width):
        part = (column >= low) & (column < low + width)
        bits = np.zeros((len(sets), min(width, int(shared.sum()) - low)), bool)
        bits[row[part], column[part] - low] = True
        packed = np.packbits(bits, axis=1)
        for i in range(1, len(sets)):
            common[i, :i] += np.bitwise_count(packed[:i] & packed[i]).sum(axis=1, dtype=np.int64)
    for i in range(1, len(sets)):
        both = common[i, :i]
        yield np.flatnonzero(100 * both >= percent * (sizes[:i] + sizes[i] - both)), i


def _confirm(percent: int):
    """Exact links of a block, as few as hold its rows together."""

    def work(block: pa.Table) -> Iterator[pa.RecordBatch]:
        gid = block.column("gid").to_numpy()
        docs, comps = block.column("doc").to_numpy(), block.column("comp").to_numpy()
        data = block.column("shingles")
        cuts = np.flatnonzero(np.r_[True, gid[1:] != gid[:-1], True])
        left, right = [], []
        for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            _, once = np.unique(docs[start:end], return_index=True)
            if len(once) < 2:
                continue
            at = start + once
            sets = [np.frombuffer(data[int(i)].as_py(), U64) for i in at]
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while root.setdefault(x, x) != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for linked, i in links_in(sets, percent):
                for j in linked.tolist():
                    x, y = find(int(comps[at[i]])), find(int(comps[at[j]]))
                    if x != y:
                        root[x] = y
                        left.append(int(docs[at[i]]))
                        right.append(int(docs[at[j]]))
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return in_groups(work, "gid", 1024)


def _fit(entries: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The rows of each ``gid`` that have a promising partner there; entries: gid, side, band, doc, comp."""
    marks = F.to_binary(F.array_join(F.transform("bands", lambda x: F.right(F.lpad(F.hex(x), 16, "0"), F.lit(8))), ""), F.lit("hex"))
    known = sketches.select("doc", "n", "near", marks.alias("marks"))
    shown = entries.join(known, "doc").select("gid", "side", "band", "doc", "comp", "n", "near", "marks")
    found = (
        shown.repartition("gid")
        .sortWithinPartitions("gid")
        .mapInArrow(_promising(percent), "gid long, side long, doc long, comp long")
    )
    return materialise(found)


def _links(fit: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Exact links (a, b) among the rows of each ``gid``."""
    return (
        fit.join(sets, "doc")
        .select("gid", "side", "comp", "doc", "shingles")
        .repartition("gid")
        .sortWithinPartitions("gid")
        .mapInArrow(_confirm(percent), "a long, b long")
    )


def _components(df: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(doc, n, h1, h2, component): one row per row of ``df`` with an id; h1 and h2 stand for its set.

    What is linked are sets, not ids: a node is one row per distinct set, known by a number of its own.
    """
    spark = df.sparkSession
    texts = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"))
    texts = texts.where("doc is not null")

    path = work_path(spark, "sketches")
    numbered = texts.withColumn("node", F.monotonically_increasing_id())
    numbered.mapInArrow(_sketch_batches(words), SKETCHES).write.parquet(path)
    sketches = spark.read.parquet(path)

    # copies: one row per set that several rows have
    first = F.min(F.struct("doc", "node"))
    copies = sketches.where("n > 0").groupBy("h1", "h2").agg(first.alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    copies = materialise(copies.select("h1", "h2", F.col("first.doc").alias("rep_doc"), F.col("first.node").alias("rep")))
    known = sketches.join(copies, ["h1", "h2"], "left")
    known = known.withColumns({"rep": F.coalesce("rep", "node"), "rep_doc": F.coalesce("rep_doc", "doc")})
    reps_path = work_path(spark, "representatives")
    known.where("n > 0 and rep = node").select(F.col("node").alias("doc"), F.col("doc").alias("id"), "t", "n", "h1", "h2", "bands", "near").write.parquet(reps_path)
    reps = spark.read.parquet(reps_path)

    # places where representatives meet
    keys = reps.select("doc", F.posexplode("bands").alias("band", "key"))
    shared = materialise(keys.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    members = keys.join(shared, "key").select(
        "key",
        "band",
        "doc",
        F.ceil(F.col("rows") / BLOCK).cast("long").alias("blocks"),
    )
    members = materialise(
        members.withColumn("block", F.pmod(F.xxhash64("doc", "key"), F.col("blocks")).cast("long"))
    )

    within = members.select(
        F.xxhash64("key", "block").alias("gid"), F.lit(-1).cast("long").alias("side"), "band", "doc", F.col("doc").alias("comp")
    )
    fit = _fit(within, reps, percent)
    # the texts move once: for these rows, and for those that may meet across blocks
    large = members.where("blocks > 1")
    wanted = materialise(fit.select("doc").unionByName(large.select("doc")).distinct())
    sets_path = work_path(spark, "sets")
    asked = wanted.join(reps, "doc").select(F.col("id").alias("doc"), "t", F.col("doc").alias("node"), "h1", "h2")
    texts.join(asked, ["doc", "t"]).mapInArrow(_set_batches(words), "doc long, shingles binary").write.parquet(sets_path)
    sets = spark.read.parquet(sets_path)
    links = materialise(_links(fit, sets, percent))
    labels = connected(links)

    # large band keys that still hold several components, across their blocks
    labelled = large.join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn(
        "comp", F.coalesce("label", "doc")
    )
    labelled = materialise(labelled.select("key", "band", "doc", "block", "blocks", "comp"))
    split = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    split = materialise(split.select("key"))
    if not split.isEmpty():
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
        across = labelled.join(split, "key").select("key", "band", "doc", "comp", "block", other).where("block <> other")
        across = across.select(
            F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("gid"),
            F.col("block").alias("side"),
            "band",
            "doc",
            "comp",
        )
        links = links.unionByName(_links(_fit(across, reps, percent), sets, percent))
        labels = connected(materialise(links))

    # the smallest id of each component of linked sets
    ids = labels.join(reps.select(F.col("doc").alias("node"), "id"), "node")
    least = ids.groupBy("label").agg(F.min("id").alias("component"))
    named = labels.join(least, "label").select(F.col("node").alias("rep"), "component")
    return known.join(named, "rep", "left").select("doc", "n", "h1", "h2", F.coalesce("component", "rep_doc").alias("component"))


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """(id, n_shingles, component_id, kept): one row per row of ``df``.

    Documents are linked when 100 * |A & B| >= ``percent`` * |A | B| over their sets of
    ``words``-word shingles; ``component_id`` is the smallest id reachable over links.
    Null, empty and blank texts have no shingles and are linked with nothing. A row
    with a null id keeps a null ``component_id`` and is kept. Rows that repeat an id are linked each by its own
    text and may lie in different components; with the same text they count as one document. Further columns of
    ``df`` are ignored, whatever their names.
    """
    found = _components(df, id_col, text_col, words, percent).select(
        F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")
    )
    found = found.withColumn("kept", F.col(id_col) == F.col("component_id"))
    none = F.lit(None).cast("long")
    nameless = df.where(F.col(id_col).isNull()).select(none.alias("doc"), none.alias("node"), none.alias("t"), F.col(text_col).alias("text"))
    return found.unionByName(
        nameless.mapInArrow(_sketch_batches(words), SKETCHES).select(
            F.col("doc").alias(id_col),
            F.col("n").alias("n_shingles"),
            none.alias("component_id"),
            F.lit(True).alias("kept"),
        )
    )


def _with_digest(words: int, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_digest(s) for s in shingle_sets(batch.column(text_col), words)]
            marks = [pa.array([d[i] for d in found], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *marks], [*batch.schema.names, "_h1", "_h2"])

    return run


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` without near-duplicates: the smallest id of each component stays, once.

    Of rows that repeat an id, those with the same set of shingles count as one; each other text is judged for itself. Rows
    with a null id stay, and so does one row without words per id.
    """
    found = _components(df, id_col, text_col, words, percent).select("doc", "h1", "h2", (F.col("doc") == F.col("component")).alias("kept"))
    of_id = found.groupBy("doc").agg(
        F.max("kept").alias("any"), ((F.min("h1") != F.max("h1")) | (F.min("h2") != F.max("h2"))).alias("mixed")
    )
    of_id = materialise(of_id.where("any"))
    whole = df.join(of_id.where("not mixed").select(F.col("doc").alias(id_col)), id_col, "left_semi").dropDuplicates([id_col])
    parts = df.where(F.col(id_col).isNull()).unionByName(whole)
    several = of_id.where("mixed").select("doc")
    if not several.isEmpty():  # ids with several texts are joined by their sets, too
        stay = found.join(several, "doc").where("kept").select(F.col("doc").alias(id_col), F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).distinct()
        rows = df.join(several.withColumnRenamed("doc", id_col), id_col, "left_semi")
        schema = StructType([*rows.schema.fields, StructField("_h1", LongType()), StructField("_h2", LongType())])
        marked = rows.mapInArrow(_with_digest(words, text_col), schema)
        key = [id_col, "_h1", "_h2"]
        parts = parts.unionByName(marked.join(stay, key, "left_semi").dropDuplicates(key).select(*df.columns))
    return parts.select(*df.columns)
