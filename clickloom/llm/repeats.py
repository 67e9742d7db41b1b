"""Substring deduplication: words in passages that a document with a smaller id already holds are removed.

A count-min sketch counts, for every window of ``WINDOW`` words, in how many documents it stands; its
estimates are never too low, so windows estimated once need no further look. Only windows estimated
repeated are grouped exactly, by 128 bits.

The sketch grows with the corpus and no task or driver ever holds it: its two rows are cut into segments of
``SEGMENT`` counters. Texts are laid out once in buckets of about ``BUCKET_BYTES``. Then

1. each bucket folds its windows into a sketch of its own and hands out the counters it touched, gap-coded,
   by segment; each segment adds up the buckets' counters and answers every bucket with the places that reached two;
2. each bucket hands out its windows of which both places did, once each with the smallest and largest id,
   by a range of window hashes; each range finds the smallest id of all buckets and answers where it is smaller;
3. each bucket removes what is covered and hashes the rest.

What moves is about one byte per window and sketch row, and 32 bytes per distinct window estimated repeated. Texts that
are copies of a smaller id's text are found beforehand by a digest and hand out nothing: they are covered whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import in_groups, utf8_buffers
from clickloom.llm.near_dups import mix
from clickloom.session import discard, materialise, work_path

WINDOW = 13
DEPTH = 2  # rows of the sketch
PER_WINDOW = 4  # counters per window and row
SEGMENT_BITS = 22
BUCKET_BYTES = 16 << 20
PIECE = 2 << 20  # bytes hashed at once

U64 = np.uint64
_rng = np.random.default_rng(20_240_713)
_BASES = [U64(int(x) * 8 + 5) for x in _rng.integers(1 << 58, 1 << 60, DEPTH)]
_INVERSES = [U64(pow(int(b), -1, 1 << 64)) for b in _BASES]
_STEPS = _rng.integers(0, 1 << 63, (DEPTH, 256), dtype=U64) * U64(2) + U64(1)
_CODES = _rng.integers(0, 1 << 63, (DEPTH, 256), dtype=U64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def words_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes (rows) of every word of a text, given as its bytes."""
    parts, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        if end < len(raw):  # not inside a word
            space = np.flatnonzero(_SPACE[raw[at:end]])
            if len(space):
                end = at + int(space[-1]) + 1
            else:
                behind = np.flatnonzero(_SPACE[raw[end:]])
                end = end + int(behind[0]) if len(behind) else len(raw)
        parts.append(_hash_words(raw[at:end]))
        at = end
    return np.concatenate(parts, axis=1) if parts else np.empty((DEPTH, 0), U64)


def _hash_words(raw: np.ndarray) -> np.ndarray:
    solid = ~_SPACE[raw]
    edge = np.diff(np.pad(solid.view(np.int8), 1))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out = np.empty((DEPTH, len(starts)), U64)
    if not len(starts):
        return out
    for row in range(DEPTH):
        powers = np.full(len(raw), _BASES[row])
        powers[0] = 1
        total = np.zeros(len(raw) + 1, U64)
        np.cumsum(_CODES[row][raw] * np.cumprod(powers), out=total[1:])
        powers[1:] = _INVERSES[row]
        back = np.cumprod(powers)[starts]
        out[row] = mix((total[ends] - total[starts]) * back + (ends - starts).astype(U64) * _STEPS[row, 255])
    return out


def windows_of(words: np.ndarray, window: int) -> np.ndarray:
    """The two hashes of every run of ``window`` words."""
    n = max(0, words.shape[1] - window + 1)
    total = np.zeros((DEPTH, n), U64)
    for k in range(window if n else 0):
        total += words[:, k : k + n] * _STEPS[:, k % 255, None] + U64(k // 255)
    return mix(total)


def pack_places(places: np.ndarray) -> bytes:
    """Rising whole numbers as gaps, in bytes or wider numbers, whose largest value says "go on"."""
    gaps = np.diff(places.astype(np.int64), prepend=0)
    kind = next((k for k in (np.uint8, np.uint16) if len(gaps) and gaps.mean() < np.iinfo(k).max / 2), np.uint32)
    most = int(np.iinfo(kind).max)
    more, rest = np.divmod(gaps, most)
    out = np.full(int((more + 1).sum()), most, kind)
    out[np.cumsum(more + 1) - 1] = rest
    return bytes([np.dtype(kind).itemsize]) + out.tobytes()


def unpack_places(data: bytes) -> np.ndarray:
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32}[data[0]]
    out = np.frombuffer(data, kind, offset=1)
    return np.cumsum(out, dtype=np.int64)[out < np.iinfo(kind).max]


def _raw_rows(column: pa.ChunkedArray) -> Iterator[np.ndarray]:
    for chunk in column.chunks:
        raw, off = utf8_buffers(chunk)
        for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
            yield raw[a:b]


def _in_pieces(texts: pa.Table, use: np.ndarray) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Rows to look at, about ``PIECE`` bytes of text at a time."""
    at, held, size = [], [], 0
    for i, raw in enumerate(_raw_rows(texts.column("text"))):
        if not use[i]:
            continue
        if at and size + len(raw) > PIECE:
            yield at, held
            at, held, size = [], [], 0
        at.append(i)
        held.append(raw)
        size += len(raw)
    if at:
        yield at, held


_GAP = np.array([32], np.uint8)


def _windows(rows: list[np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of several texts at once: words per text, window hashes, and the first word and the text of each window."""
    joined = np.concatenate([part for raw in rows for part in (raw, _GAP)])
    solid = ~_SPACE[joined]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    counts = np.add.reduceat(first, np.cumsum([0, *(len(r) + 1 for r in rows[:-1])]), dtype=np.int64)
    found = windows_of(words_of(joined), window)
    owner = np.repeat(np.arange(len(rows)), counts)
    start = np.flatnonzero(owner[: found.shape[1]] == owner[window - 1 :][: found.shape[1]])
    return counts, found[:, start], start, owner[start]


def _alone(texts: pa.Table, notes: pa.Table) -> np.ndarray:
    """Rows of the bucket that are not copies of a smaller id's text and have an id."""
    copies = set(notes.filter(pc.equal(notes.column("kind"), 0)).column("row").to_pylist())
    return np.array([r not in copies and d is not None for r, d in zip(texts.column("row").to_pylist(), texts.column("doc").to_pylist())], bool)


def _gathered(texts: pa.Table, notes: pa.Table, window: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a bucket and the place of their id among the bucket's rising ids."""
    use = _alone(texts, notes)
    ids = np.array([d or 0 for d in texts.column("doc").to_pylist()], np.int64)
    number = np.unique(ids, return_inverse=True)[1].astype(np.uint32)
    parts, owner = [np.empty((DEPTH, 0), U64)], [np.empty(0, np.uint32)]
    for at, rows in _in_pieces(texts, use):
        _, found, _, row = _windows(rows, window)
        parts.append(found)
        owner.append(number[at][row])
    return np.concatenate(parts, axis=1), np.concatenate(owner)


SKETCH = "seg long, bucket long, places binary, again binary"


def _sketch(window: int, width_bits: int):
    """The counters a bucket touched: ``places`` by at least one id, ``again`` by two or more."""
    shift, low = U64(64 - width_bits), (1 << SEGMENT_BITS) - 1

    def work(texts: pa.Table, notes: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if texts.num_rows:
            bucket = texts.column("bucket")[0].as_py()
            found, owner = _gathered(texts, notes, window)
            for row in range(DEPTH):
                place = (found[row] >> shift).astype(np.int64)
                order = np.argsort(place, kind="stable")
                place, who = place[order], owner[order]
                first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.empty(0, int)
                other = np.zeros(len(place), bool)
                other[1:] = (place[1:] == place[:-1]) & (who[1:] != who[:-1])
                several = np.logical_or.reduceat(other, first) if len(first) else other
                place = place[first]
                segment = place >> SEGMENT_BITS
                cuts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1], True]) if len(place) else [0]
                for a, b in zip(cuts[:-1], cuts[1:]):
                    inside = place[a:b] & low
                    rows.append(((row << 48) + int(segment[a]), bucket, pack_places(inside), pack_places(inside[several[a:b]])))
        return pa.table(list(map(list, zip(*rows))) or [[]] * 4, schema=_SKETCH)

    return work


_SKETCH = pa.schema([("seg", pa.int64()), ("bucket", pa.int64()), ("places", pa.binary()), ("again", pa.binary())])
_NOTE = pa.schema(
    [("bucket", pa.int64()), ("kind", pa.int64()), ("row", pa.int64()), ("part", pa.int64()), ("data", pa.binary())]
)
NOTES = "bucket long, kind long, row long, part long, data binary"


def _note_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _NOTE)], schema=_NOTE)


def _segments(block: pa.Table) -> Iterator[pa.RecordBatch]:
    """Adds up the buckets' counters of each segment and answers each bucket: its places that reached two."""
    seg = block.column("seg").to_numpy()
    cuts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1], True])
    bucket, places, again = (block.column(c) for c in ("bucket", "places", "again"))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        count = np.zeros(1 << SEGMENT_BITS, np.uint8)
        for i in range(a, b):
            for data in (places[i].as_py(), again[i].as_py()):
                at = unpack_places(data)
                count[at] = np.minimum(count[at] + 1, 2)
        rows = []
        for i in range(a, b):
            at = unpack_places(places[i].as_py())
            at = at[count[at] == 2]
            if len(at):
                rows.append((bucket[i].as_py(), 1, None, int(seg[a]), pack_places(at)))
        if rows:
            yield _note_rows(rows)


def _places(notes: pa.Table, row: int, width_bits: int) -> np.ndarray:
    """Which of the 2^bits counters of a sketch row reached two, as far as the bucket touches them, rising."""
    mine = notes.filter(pc.equal(notes.column("kind"), 1))
    parts = sorted((p & ((1 << 48) - 1), d) for p, d in zip(mine.column("part").to_pylist(), mine.column("data").to_pylist()) if p >> 48 == row)
    return np.concatenate([np.empty(0, np.int64), *((p << SEGMENT_BITS) + unpack_places(d) for p, d in parts)])


def _among(values: np.ndarray, rising: np.ndarray) -> np.ndarray:
    if not len(rising):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(rising, values), len(rising) - 1)
    return rising[at] == values


_CANDIDATES = pa.schema([("part", pa.int64()), ("bucket", pa.int64()), ("data", pa.binary())])
CANDIDATES = "part long, bucket long, data binary"


def _merged(keys: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One column per window: its two hashes, smallest and largest id, by rising hashes."""
    order = np.lexsort((keys[1], keys[0]))
    keys, least, most = keys[:, order], least[order], most[order]
    if not len(order):
        return keys, least, most
    first = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
    return keys[:, first], np.minimum.reduceat(least, first), np.maximum.reduceat(most, first)


def _candidates(window: int, width_bits: int, part_bits: int):
    """Windows of a bucket that the sketch estimates repeated, by range of their first hash."""
    shift = U64(64 - width_bits)

    def work(texts: pa.Table, notes: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if texts.num_rows:
            bucket = texts.column("bucket")[0].as_py()
            found, owner = _gathered(texts, notes, window)
            may = np.ones(found.shape[1], bool)
            for row in range(DEPTH):
                may &= _among((found[row] >> shift).astype(np.int64), _places(notes, row, width_bits))
            ids = np.unique(np.array([d or 0 for d in texts.column("doc").to_pylist()], np.int64))[owner[may]]
            keys, least, most = _merged(found[:, may], ids, ids)
            part = (keys[0] >> U64(64 - part_bits)).astype(np.int64) if part_bits else np.zeros(len(least), np.int64)
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else [0]
            for a, b in zip(cuts[:-1], cuts[1:]):
                data = np.stack([keys[0, a:b].view(np.int64), keys[1, a:b].view(np.int64), least[a:b], most[a:b]])
                rows.append((int(part[a]), bucket, data.tobytes()))
        return pa.table(list(map(list, zip(*rows))) or [[]] * 3, schema=_CANDIDATES)

    return work


def _firsts(block: pa.Table) -> Iterator[pa.RecordBatch]:
    """Smallest id of each window over all buckets; each bucket hears of those smaller than its largest."""
    part = block.column("part").to_numpy()
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        sent = [np.frombuffer(block.column("data")[i].as_py(), np.int64).reshape(4, -1) for i in range(a, b)]
        size = [s.shape[1] for s in sent]
        whole = np.concatenate(sent, axis=1)
        keys = whole[:2].view(U64)
        order = np.lexsort((keys[1], keys[0]))
        keys = keys[:, order]
        first = np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)]
        least = np.empty(len(order), np.int64)
        least[order] = np.minimum.reduceat(whole[2, order], np.flatnonzero(first))[np.cumsum(first) - 1]
        rows = []
        for i, end, n in zip(range(a, b), np.cumsum(size).tolist(), size):
            mine, low = whole[:, end - n : end], least[end - n : end]
            late = low < mine[3]
            if late.any():
                data = np.stack([mine[0, late], mine[1, late], low[late]]).tobytes()
                rows.append((block.column("bucket")[i].as_py(), 2, None, int(part[a]), data))
        if rows:
            yield _note_rows(rows)


_RESULT = pa.schema(
    [("doc", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())]
)
RESULT = "doc long, row long, n_words long, n_removed long, kept_sha256 string, kept string"


def _remove(window: int, with_text: bool):
    """The words of each text that no window of a smaller id covers."""

    def work(texts: pa.Table, notes: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _RESULT.empty_table()
        told = notes.filter(pc.equal(notes.column("kind"), 2))
        parts = [np.frombuffer(d, np.int64).reshape(3, -1) for d in told.column("data").to_pylist()]
        known = np.concatenate([np.empty((3, 0), np.int64), *parts], axis=1)
        keys = known[:2].view(U64)
        order = np.lexsort((keys[1], keys[0]))
        keys, least = keys[:, order], known[2, order]
        runs = int(np.unique(keys[0], return_counts=True)[1].max()) if len(least) else 0
        use, docs, row_ids = _alone(texts, notes), texts.column("doc").to_pylist(), texts.column("row").to_pylist()
        removed: dict[int, np.ndarray] = {}
        ids = np.array([d or 0 for d in docs], np.int64)
        for at, pieces in _in_pieces(texts, use & bool(len(least))):
            counts, found, start, row = _windows(pieces, window)
            hit = np.zeros(found.shape[1], bool)
            place, mine = np.searchsorted(keys[0], found[0]), ids[at][row]
            for k in range(runs):
                near = np.minimum(place + k, len(least) - 1)
                hit |= (keys[0][near] == found[0]) & (keys[1][near] == found[1]) & (least[near] < mine)
            if hit.any():
                ends = np.zeros(int(counts.sum()) + 1, np.int64)
                ends[start[hit]] += 1
                ends[start[hit] + window] -= 1
                gone = np.cumsum(ends[:-1]) > 0
                cuts = np.cumsum(counts) - counts
                removed.update((at[i], gone[cuts[i] : cuts[i] + counts[i]]) for i in np.unique(row[hit]).tolist())
        rows = []
        for i, raw in enumerate(_raw_rows(texts.column("text"))):
            words = raw.tobytes().split()
            n, gone = len(words), removed.get(i)
            if gone is None:
                lost = n if not use[i] and docs[i] is not None and n >= window else 0
                kept = b"" if lost else b" ".join(words)
            else:
                lost = int(gone.sum())
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
            rows.append((docs[i], row_ids[i], n, lost, hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), _RESULT)], schema=_RESULT)

    return work


def remove_repeats(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    per_window: int = PER_WINDOW,
    bucket_bytes: int = BUCKET_BYTES,
    with_text: bool = False,
) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256): one row per row of ``df``; ``with_text`` adds ``kept``, the words left.

    Words are runs of anything but space and 09-0D, unchanged. A word goes when a window of ``window`` words covers it
    whose words also stand in a row with a smaller id; what is removed elsewhere does not matter. Rows that repeat
    an id are judged each on its own and take nothing from each other. A null text has no words; a null id has no place in the
    order: nothing is taken from it or because of it. Further columns are ignored, whatever their names.
    An empty table gives no rows. A single text is held whole in one task.
    """
    spark = df.sparkSession
    size = df.agg(F.sum(F.octet_length(F.col(text_col))).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    total = int(size["bytes"] or 0)
    buckets = max(1, -(-total // bucket_bytes))
    part_bits = max(0, (buckets - 1).bit_length())
    # a word takes two bytes at least, six or so in prose: what is short here only adds windows to the exact pass
    width_bits = min(62, max(SEGMENT_BITS, (max(1, total // 6) * per_window - 1).bit_length()))

    texts = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    bucket = F.pmod(F.xxhash64("doc", F.octet_length("text")), F.lit(buckets)).alias("bucket")
    path, name = work_path(spark, "texts"), "texts_" + work_path(spark, "t").rsplit("-", 1)[1]
    texts = texts.select("doc", "text", bucket, F.monotonically_increasing_id().alias("row"))
    writer = texts.repartition(buckets, "bucket").write.bucketBy(buckets, "bucket").option("path", path)
    writer.option("compression", "zstd").saveAsTable(name)
    laid = spark.table(name)

    digest = F.sha2(F.col("text"), 256)
    whole = laid.where("doc is not null and text is not null").select("bucket", "row", "doc", digest.alias("digest"))
    first = whole.groupBy("digest").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    copies = whole.join(first, "digest").where("doc > least")
    copies = copies.select("bucket", F.lit(0).cast("long").alias("kind"), "row", F.lit(None).cast("long").alias("part"), F.lit(None).cast("binary").alias("data"))
    copies = materialise(copies)

    def by_bucket(notes: DataFrame, work, schema: str) -> DataFrame:
        return laid.groupBy("bucket").cogroup(notes.groupBy("bucket")).applyInArrow(work, schema)

    def by_key(rows: DataFrame, key: str, work) -> DataFrame:
        return materialise(rows.repartition(key).sortWithinPartitions(key).mapInArrow(in_groups(work, key, 64), NOTES))

    sketched = by_bucket(copies, _sketch(window, width_bits), SKETCH)
    repeated = by_key(sketched, "seg", _segments)
    asked = by_bucket(copies.unionByName(repeated), _candidates(window, width_bits, part_bits), CANDIDATES)
    firsts = by_key(asked, "part", _firsts)
    found = by_bucket(copies.unionByName(firsts), _remove(window, with_text), RESULT)
    kept = work_path(spark, "kept")
    found.write.parquet(kept)
    spark.sql(f"DROP TABLE {name}")
    discard(spark, path)
    columns = [F.col("doc").alias(id_col), "n_words", "n_removed", "kept_sha256"]
    return spark.read.parquet(kept).select(*columns, *(["kept"] if with_text else []))
