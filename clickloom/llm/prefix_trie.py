"""Prefix trie of conversations, with subtree totals by time-forward processing.

A node is a distinct sequence of first turns. It is known by a 128-bit hash: the XOR of one hash per (place, role,
text), so all nodes of a conversation come from a running XOR, also over a conversation that is cut into pieces.
Copies add up before the shuffle, however many conversations share a node.

Subtree totals. Nodes are dealt by range of their path (three bytes per turn, ``PATH_TURNS`` turns, then
smallest conversation and depth), which keeps subtrees together, and every task cuts its range into shards of at most
``SHARD_ROWS`` nodes. A shard is sorted by reverse level order; each node takes from a priority queue what its children
sent, and sends its own totals to its parent. The queue spills sorted runs when it holds ``QUEUE_ROWS`` messages.
Messages to a parent in another shard are added up per (shard, parent), the shard's root. Shard roots form a smaller
tree, which the same steps sum up in at most half as many shards, until one is enough. What the roots get
enters their parents' shards in a second pass.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import struct
import tempfile
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.session import materialise, work_path

BLOCK_OF = 100  # conversations that share the turns of their block's first one
MOST_SHARED = 6  # the shared turns are a CRC-32 modulo this
PATH_TURNS = 32
PIECE_TURNS = 4_096
SHARD_ROWS = 65_536
QUEUE_ROWS = 16_384
CHUNK_BYTES = 1 << 16
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


# ---- conversations to nodes


def _numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """(conv, idx, digest, chars): ``idx`` from 1 inside each conversation; texts are left behind.

    Rows are sorted by range, a long conversation in several tasks; what its earlier tasks hold is added afterwards.
    """
    digest = F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary")).alias("digest")
    # dealt by a head of the text, which agrees with the order by the whole text
    dealt = rows.repartitionByRange("conv", *order[:2], F.substring("text", 1, 32)).sortWithinPartitions("conv", *order)
    dealt = dealt.select("conv", digest, F.length("text").cast("long").alias("chars"), F.monotonically_increasing_id().alias("place"))
    dealt = materialise(dealt.withColumn("part", F.shiftright("place", 33)))
    parts = dealt.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("low"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("skip", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    idx = (F.col("skip") + F.col("place") - F.col("low") + 1).alias("idx")
    return dealt.join(parts, ["conv", "part"]).select("conv", idx, "digest", "chars")


def rebuilt_turns(df: DataFrame, conv: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    """((conv, pos, digest, chars), (conv, turns)): every conversation with its block's first turns in front.

    ``digest`` stands for role and text of the turn; texts go no further than this. ``turns`` holds every
    conversation, also one without turns.
    """
    blank = F.lit("")
    rows = df.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), blank).alias("role"),
        F.coalesce(F.col(text).cast("string"), blank).alias("text"),
    )
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    own = materialise(_numbered(rows, order))
    shared = (F.crc32(F.col("conv").cast("string").cast("binary")) % MOST_SHARED).alias("shared")
    sizes = own.groupBy("conv").agg(F.max("idx").alias("own_n")).select("conv", "own_n", shared)
    sizes = sizes.withColumn("base", F.col("conv") - F.col("conv") % BLOCK_OF)
    bases = sizes.where(F.col("conv") == F.col("base")).select("base", F.col("own_n").alias("base_n"))
    sizes = sizes.join(bases, "base", "left").withColumn("front", F.least("shared", F.coalesce("base_n", F.lit(0))))
    behind = F.greatest(F.col("own_n") - F.col("shared"), F.lit(0))
    sizes = materialise(sizes.select("conv", "base", "shared", "front", (F.col("front") + behind).alias("turns")))

    # at most 199 conversations of a block times five turns
    heads = own.where((F.col("conv") % BLOCK_OF == 0) & (F.col("idx") < MOST_SHARED)).withColumnRenamed("conv", "base")
    front = sizes.where("front > 0").join(heads, "base").where("idx <= front").select("conv", F.col("idx").alias("pos"), "digest", "chars")
    rest = own.join(sizes.select("conv", "shared", "front"), "conv").where("idx > shared")
    rest = rest.select("conv", (F.col("front") + F.col("idx") - F.col("shared")).alias("pos"), "digest", "chars")
    return front.unionByName(rest), sizes.select("conv", "turns")


def trie_nodes(turns: DataFrame, sizes: DataFrame, piece_turns: int = PIECE_TURNS) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends): every distinct sequence of first turns, and the node each conversation ends at."""
    hashed = turns.select(
        "conv",
        "pos",
        "chars",
        F.xxhash64(F.lit(1), "digest", "pos").alias("x"),
        F.xxhash64(F.lit(2), "pos", "digest").alias("y"),
        F.substring("digest", 1, 6).alias("step"),
        F.expr(f"(pos - 1) div {int(piece_turns)}").alias("piece"),
    )
    so_far = Window.partitionBy("conv", "piece").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = hashed.select("conv", "pos", "chars", "piece", "x", "y", F.bit_xor("x").over(so_far).alias("px"), F.bit_xor("y").over(so_far).alias("py"))
    whole = hashed.groupBy("conv", "piece").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    earlier = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    starts = whole.select(
        "conv", "piece", F.coalesce(F.bit_xor("x").over(earlier), none).alias("bx"), F.coalesce(F.bit_xor("y").over(earlier), none).alias("by")
    )
    heads = hashed.where(F.col("pos") <= PATH_TURNS).groupBy("conv")
    heads = heads.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "step"))), lambda s: s.getField("step")), "").alias("path"))
    info = sizes.join(heads, "conv", "left")
    rows = run.join(starts, ["conv", "piece"]).join(info, "conv")
    a, b = F.col("px").bitwiseXOR(F.col("bx")), F.col("py").bitwiseXOR(F.col("by"))
    steps = rows.select(
        "conv",
        F.col("pos").alias("depth"),
        _key(a, b).alias("key"),
        _key(a.bitwiseXOR(F.col("x")), b.bitwiseXOR(F.col("y"))).alias("parent"),
        F.expr("substring(path, 1, cast(least(pos, 1000L) as int) * 6)").alias("path"),
        "chars",
        (F.col("pos") == F.col("turns")).alias("last"),
    )
    roots = sizes.select(
        "conv",
        none.alias("depth"),
        _key(none, none).alias("key"),
        F.lit(None).cast("binary").alias("parent"),
        F.lit("").alias("path"),
        none.alias("chars"),
        (F.col("turns") == 0).alias("last"),
    )
    every = materialise(steps.unionByName(roots))
    nodes = every.groupBy("key", "depth").agg(
        F.min("conv").alias("conv"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum(F.col("last").cast("long")).alias("n_ends"),
        F.min("parent").alias("parent"),
        F.min("path").alias("path"),
        F.max("chars").alias("chars"),
    )
    return nodes, every.where("last").select("key", "conv")


def _key(a: Column, b: Column) -> Column:
    return F.to_binary(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")), F.lit("hex"))


# ---- time-forward processing


class SpillingQueue:
    """Messages (level, key, amounts), taken by falling level, then rising key; equal places add up.

    Holds ``most`` messages; more go to a sorted run in the folder that Spark gives its workers to spill in. A
    run has no name there and vanishes with the task.
    """

    def __init__(self, most: int = QUEUE_ROWS):
        self.most, self.held, self.heap, self.runs = most, {}, [], []

    def push(self, level: int, key: bytes, amounts: tuple[int, ...]) -> None:
        at = (-level, key)
        before = self.held.get(at)
        if before is None:
            heapq.heappush(self.heap, at)
            self.held[at] = amounts
            if len(self.held) > self.most:
                self._spill()
        else:
            self.held[at] = tuple(x + y for x, y in zip(before, amounts))

    def _spill(self) -> None:
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
        run = tempfile.TemporaryFile(dir=folder)
        for at in sorted(self.held):
            amounts = self.held[at]
            run.write(struct.pack(f"<qii{len(amounts)}q", at[0], len(at[1]), len(amounts), *amounts) + at[1])
        run.seek(0)
        self.held, self.heap = {}, []
        self._next(run)

    def _next(self, run) -> None:
        head = run.read(16)
        if not head:
            run.close()
            return
        level, size, n = struct.unpack("<qii", head)
        amounts = struct.unpack(f"<{n}q", run.read(8 * n))
        heapq.heappush(self.runs, ((level, run.read(size)), id(run), amounts, run))

    def first(self) -> tuple[int, bytes] | None:
        """The next place, as (-level, key)."""
        ends = [q[0] if q is self.heap else q[0][0] for q in (self.heap, self.runs) if q]
        return min(ends) if ends else None

    def pop(self) -> tuple[tuple[int, bytes], tuple[int, ...]]:
        at, total = self.first(), None
        if self.heap and self.heap[0] == at:
            heapq.heappop(self.heap)
            total = self.held.pop(at)
        while self.runs and self.runs[0][0] == at:
            _, _, amounts, run = heapq.heappop(self.runs)
            total = amounts if total is None else tuple(x + y for x, y in zip(total, amounts))
            self._next(run)
        return at, total


_FIELDS = [
    ("key", pa.binary()), ("parent", pa.binary()), ("level", pa.int64()), ("up", pa.int64()), ("path", pa.string()), ("conv", pa.int64()),
    ("own_leaves", pa.int64()), ("own_saved", pa.int64()), ("shard", pa.int64()),
]
_TOTALS = [("leaves", pa.int64()), ("saved", pa.int64()), ("children", pa.int64())]
_SUMMED = pa.schema([("kind", pa.int32()), *_FIELDS, *_TOTALS, ("out", pa.binary()), ("out_level", pa.int64())])
_BRIEF = pa.schema([("key", pa.binary()), *_TOTALS])
_NAMES = {pa.binary(): "binary", pa.int64(): "long", pa.string(): "string", pa.int32(): "int"}
PLACED = ", ".join(f"{n} {_NAMES[t]}" for n, t in _FIELDS)
SUMMED = ", ".join(f"{f.name} {_NAMES[f.type]}" for f in _SUMMED)
BRIEF = ", ".join(f"{f.name} {_NAMES[f.type]}" for f in _BRIEF)


def _cut(shard_rows: int):
    """Numbers shards of at most ``shard_rows`` rows along the order of a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            shard = [(p << 40) + (seen + i) // shard_rows for i, p in enumerate(batch.column("shard").to_pylist())]
            seen += batch.num_rows
            columns = [batch.column(n) for n, _ in _FIELDS[:-1]] + [pa.array(shard, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [n for n, _ in _FIELDS])

    return run


def _summed(rows: Iterator[dict], queue: SpillingQueue) -> Iterator[tuple[dict | None, tuple]]:
    """Time-forward: rows of one shard by falling level, then rising key, with (leaves, saved, children) inside it.

    Where the row is None, the totals follow (level, key) of a parent that is not among the rows.
    """

    def elsewhere(until: tuple[int, bytes] | None) -> Iterator[tuple[None, tuple]]:
        while (head := queue.first()) is not None and (until is None or head < until):
            place, amounts = queue.pop()
            yield None, (-place[0], place[1], *amounts)

    for r in rows:
        at = (-r["level"], r["key"])
        yield from elsewhere(at)
        total = (r["own_leaves"], r["own_saved"], 0)
        if queue.first() == at:
            total = tuple(x + y for x, y in zip(total, queue.pop()[1]))
        if r["parent"] is not None:
            queue.push(r["up"], r["parent"], (total[0], total[1], 1))
        yield r, total
    yield from elsewhere(None)


def _in_batches(rows: Iterator[dict], schema: pa.Schema, size: int = 8_192) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[dict]]:
    rows = (r for batch in batches for r in batch.to_pylist())
    for _, of_shard in groupby(rows, key=lambda r: r["shard"]):
        yield of_shard


def _first_pass(queue_rows: int):
    """Kind 0: a node, its totals inside the shard, and the parent elsewhere that these flow to. Kind 1: what a shard sends there."""

    def rows_of(shard: Iterator[dict]) -> Iterator[dict]:
        done, sent, number = [], [], None
        for r, total in _summed(shard, SpillingQueue(queue_rows)):
            if r is None:
                sent.append(total)
            else:
                done.append((r, total))
                number = r["shard"]
        out = {key: (key, level) for level, key, *_ in sent}
        flows: dict[bytes, tuple] = {}
        for r, (leaves, saved, children) in reversed(done):  # from the top down: a node flows where its parent does
            parent = r["parent"]
            flow = (None, None) if parent is None else out.get(parent) or flows[parent]
            flows[r["key"]] = flow
            yield {**r, "kind": 0, "leaves": leaves, "saved": saved, "children": children, "out": flow[0], "out_level": flow[1]}
        for level, key, leaves, saved, children in sent:
            yield {"kind": 1, "shard": number, "leaves": leaves, "saved": saved, "children": children, "out": key, "out_level": level}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            yield from _in_batches(rows_of(shard), _SUMMED)

    return run


def _last_pass(queue_rows: int):
    """Totals of every node, when all that comes from elsewhere is in its own amounts; holds the queue only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            found = _summed(shard, SpillingQueue(queue_rows))
            rows = ({"key": r["key"], "leaves": t[0], "saved": t[1], "children": t[2]} for r, t in found if r is not None)
            yield from _in_batches(rows, _BRIEF)

    return run


def _by_level(df: DataFrame) -> DataFrame:
    return df.sortWithinPartitions("shard", F.desc("level"), "key")


def subtree_totals(nodes: DataFrame, shards: int, shard_rows: int = SHARD_ROWS, queue_rows: int = QUEUE_ROWS) -> DataFrame:
    """(key, leaves, saved, children): sums over each node's subtree, and the number of its children.

    ``nodes``: key, parent (null: a root), level, up (the parent's level, below its own), path and conv (where to
    deal it), own_leaves, own_saved. With one shard, one task takes all of them, in order and through the queue only.
    """
    spark = nodes.sparkSession
    names = [n for n, _ in _FIELDS[:-1]]
    if shards <= 1:
        whole = nodes.select(*names, F.lit(0).cast("long").alias("shard")).coalesce(1)
        return _by_level(whole).mapInArrow(_last_pass(queue_rows), BRIEF)
    order = ["path", "conv", "level", "key"]
    dealt = nodes.select(*names).repartitionByRange(shards, *order).sortWithinPartitions(*order)
    cut = dealt.withColumn("shard", F.spark_partition_id().cast("long")).mapInArrow(_cut(shard_rows), PLACED)
    path = work_path(spark, "shards")
    _by_level(cut).mapInArrow(_first_pass(queue_rows), SUMMED).write.parquet(path)
    local = spark.read.schema(SUMMED).parquet(path)
    inside, sent = local.where("kind = 0"), local.where("kind = 1").select("shard", "out", "out_level", "leaves", "saved", "children")
    roots = sent.count()
    if not roots:
        return inside.select("key", "leaves", "saved", "children")

    # the tree of shard roots: one per shard and parent elsewhere, below what that parent's shard sends on
    parents = inside.select(F.col("key").alias("out"), F.col("shard").alias("at"), F.col("out").alias("on"), F.col("out_level").alias("on_level"), "path", "conv")

    def name(key: str, shard: str) -> Column:
        return F.concat(F.col(key), F.to_binary(F.lpad(F.hex(shard), 16, "0"), F.lit("hex")))

    tree = materialise(
        sent.join(parents, "out").select(
            name("out", "shard").alias("key"),
            name("on", "at").alias("parent"),
            (F.col("out_level") + 1).alias("level"),
            (F.col("on_level") + 1).alias("up"),
            "path",
            "conv",
            F.col("leaves").alias("own_leaves"),
            F.col("saved").alias("own_saved"),
            "out",
            "children",
        )
    )
    fewer = max(1, min(shards // 2, -(-roots // shard_rows)))
    higher = subtree_totals(tree, fewer, shard_rows, queue_rows).select("key", "leaves", "saved")
    gained = higher.join(tree.select("key", "out", "children"), "key").groupBy("out")
    gained = materialise(gained.agg(F.sum("leaves").alias("g1"), F.sum("saved").alias("g2"), F.sum("children").alias("g3")).withColumnRenamed("out", "key"))
    none = F.lit(0).cast("long")
    again = inside.join(gained, "key", "left").withColumns(
        {"own_leaves": F.col("own_leaves") + F.coalesce("g1", none), "own_saved": F.col("own_saved") + F.coalesce("g2", none)}
    )
    summed = _by_level(again.select(*names, "shard").repartition("shard")).mapInArrow(_last_pass(queue_rows), BRIEF)
    return summed.join(gained, "key", "left").select("key", "leaves", "saved", (F.col("children") + F.coalesce("g3", none)).alias("children"))


# ---- members that end at a node


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, conv): their ids as text, in pieces of one key."""
    done: list[dict] = []
    key, first, ids, size = None, None, [], 0
    for batch in batches:
        for at, conv in zip(batch.column("key").to_pylist(), batch.column("conv").to_pylist()):
            if at != key or size >= CHUNK_BYTES:
                if ids:
                    done.append({"key": key, "first": first, "ids": ",".join(ids)})
                key, first, ids, size = at, conv, [], 0
                if len(done) >= 1_024:
                    yield pa.RecordBatch.from_pylist(done, schema=_CHUNK)
                    done = []
            ids.append(str(conv))
            size += len(ids[-1]) + 1
    if ids:
        done.append({"key": key, "first": first, "ids": ",".join(ids)})
    if done:
        yield pa.RecordBatch.from_pylist(done, schema=_CHUNK)


_CHUNK = pa.schema([("key", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
_SHA = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = ((k, i) for b in batches for k, i in zip(b.column("key").to_pylist(), b.column("ids").to_pylist()))

    def digests() -> Iterator[dict]:
        for key, pieces in groupby(rows, key=lambda r: r[0]):
            sha = hashlib.sha256()
            for n, (_, ids) in enumerate(pieces):
                sha.update(b"," * (n > 0) + ids.encode())
            yield {"key": key, "ends_sha256": sha.hexdigest()}

    yield from _in_batches(digests(), _SHA)


def end_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): SHA-256 of the rising ids that end at a node; one task hashes pieces, never rows."""
    pieces = ends.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInArrow(_chunks, "key binary, first long, ids string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_digests, "key binary, ends_sha256 string")


def prefix_trie(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    shard_rows: int = SHARD_ROWS,
    queue_rows: int = QUEUE_ROWS,
    piece_turns: int = PIECE_TURNS,
) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations are ordered by turn, null first; turns that are equal go by role, then text. Null roles and texts are
    empty. Rows without a conversation id belong to none and are left out; repeated rows are turns of their own. A
    conversation is rebuilt from the first turns of its block and its own later ones; one without turns is a member of the
    root. An empty table has no root and gives no rows. Further columns are ignored, whatever their names.
    """
    spark = df.sparkSession
    nodes, ends = trie_nodes(*rebuilt_turns(df, conv_col, turn_col, role_col, text_col), piece_turns)
    path = work_path(spark, "nodes")
    nodes.write.parquet(path)
    nodes = spark.read.parquet(path)
    weighed = nodes.select(
        "key",
        "parent",
        F.col("depth").alias("level"),
        F.when(F.col("depth") > 0, F.col("depth") - 1).alias("up"),
        "path",
        "conv",
        (F.col("n_ends") == F.col("n_convs")).cast("long").alias("own_leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("own_saved"),
    )
    totals = subtree_totals(weighed, -(-nodes.count() // shard_rows), shard_rows, queue_rows)
    above = nodes.select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv_id"))
    joined = nodes.join(totals, "key").join(end_digests(ends), "key", "left").join(above, "parent", "left")
    return joined.select(
        F.col("conv").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        "parent_conv_id",
        "n_convs",
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )
