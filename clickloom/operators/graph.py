"""Normalised neighbourhood averaging on the user-item graph."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.operators.slices import HOT_KEYS, distinct_rows
from clickloom.session import materialise

SLICE = 16  # dimensions that one task adds up
BLOCKS = 3  # blocks of receiving nodes, at least
BLOCK_NODES = 5_000_000  # nodes of a block, about
LIST = 100_000  # neighbours of a node that move as one row, about
SHARE = 64  # one neighbour in so many tells which nodes are large
EDGES_PER_TASK = 1_000_000  # edges that one task gathers into lists
INT_IDS = 1 << 30  # numbers of nodes fit in four bytes when ids are below


@dataclass
class Packed:
    """Directed edges as lists (src, block, near): the neighbours of a node by block of the receivers.

    ``near`` holds numbers of nodes, or (dst, weight). Without weights an edge weighs
    1 / sqrt(degree(src) * degree(dst)), and ``degrees`` is (src, degree).
    """

    lists: DataFrame
    blocks: int
    degrees: DataFrame | None = None


def user_node(user: Column) -> Column:
    """The number of a user's node; even."""
    return user.cast("long") * 2


def item_node(item: Column) -> Column:
    """The number of an item's node; odd."""
    return item.cast("long") * 2 + 1


def node_name(node: Column) -> Column:
    """'u<user>' or 'i<item>' of a node's number."""
    return F.concat(F.when(F.pmod(node, F.lit(2)) == 0, "u").otherwise("i"), F.shiftright(node, 1))


def _both_ways(pairs: DataFrame, u: Column, i: Column, *more: str) -> DataFrame:
    both = F.array(F.struct(u.alias("src"), i.alias("dst")), F.struct(i.alias("src"), u.alias("dst")))
    return pairs.select(F.explode(both).alias("_e"), *more).select("_e.src", "_e.dst", *more)


def adjacency(interactions: DataFrame, rows: int | None = None, packed: bool = False) -> DataFrame | Packed:
    """Directed edges (src, dst, weight) of the bipartite graph, both ways.

    Repeated pairs count once; weight = 1 / sqrt(degree(src) * degree(dst)). A null partner is no edge,
    but counts as one in the degree. Nodes are 'u<user>' and 'i<item>'.
    ``rows`` tells how many interactions there are at most, if known.

    ``packed`` gives the same edges for ``propagate``, as lists without weights; nodes are
    ``user_node`` and ``item_node`` of whole numbers.
    """
    pairs = interactions.select("user_id", "item_id")
    if packed:
        pairs = materialise(pairs)
        top = pairs.agg(F.max(F.greatest(F.abs("user_id"), F.abs("item_id")))).first()[0]
        edges = _both_ways(pairs, user_node(F.col("user_id")), item_node(F.col("item_id"))).where("src is not null")
        return pack(edges.withColumn("dst", F.col("dst").cast("int")) if top is None or top < INT_IDS else edges)
    # stored: degrees and edges both come from them
    pairs = materialise(pairs.distinct() if rows is None else distinct_rows(pairs, rows))
    users = pairs.groupBy("user_id").agg(F.count(F.lit(1)).alias("du"))
    items = pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("di"))
    weight = 1.0 / F.sqrt(F.col("du").cast("double") * F.col("di"))
    edges = pairs.join(users, "user_id").join(items, "item_id").withColumn("weight", weight)
    return _both_ways(edges, F.concat(F.lit("u"), "user_id"), F.concat(F.lit("i"), "item_id"), "weight")


def pack(edges: DataFrame, per_list: int = LIST, share: int = SHARE) -> Packed:
    """The lists of (src, dst, weight), or of the symmetric (src, dst) with repeated ones counted once, stored.

    A null dst is in no list of the latter, but counts as one in the degree.

    The lists of the largest nodes are cut, so that no task and no row holds all of one. How large a node
    is and how many there are is estimated: this decides how lists are cut, never what they hold.
    """
    weighted = "weight" in edges.columns
    total, nodes = edges.agg(F.count(F.lit(1)), F.approx_count_distinct("dst")).first()
    blocks = max(BLOCKS, -(-nodes // BLOCK_NODES))
    few = edges.where(F.pmod(F.xxhash64("dst", F.lit("share")), F.lit(share)) == 0).groupBy("src").agg(F.count(F.lit(1)).alias("_n"))
    pieces = F.ceil(F.col("_n") * share / per_list)
    large = few.where(pieces > 1).orderBy(F.col("_n").desc()).limit(HOT_KEYS).select("src", pieces.alias("_pieces"))
    dealt = edges.join(F.broadcast(large), "src", "left").select(
        "src",
        F.coalesce(F.pmod(F.xxhash64("dst", F.lit("piece")), F.col("_pieces")), F.lit(0)).cast("int").alias("_piece"),
        (F.struct("dst", "weight") if weighted else F.col("dst")).alias("_to"),
    )
    # dealt first: lists that grow before they move save nothing
    dealt = dealt.repartition(max(1, -(-total // EDGES_PER_TASK)), "src", "_piece")
    block = F.pmod(F.xxhash64("_to.dst" if weighted else "_to"), F.lit(blocks)).cast("int")
    groups = dealt.groupBy("src", "_piece", block.alias("block"))
    if weighted:
        return Packed(materialise(groups.agg(F.collect_list("_to").alias("near")).drop("_piece")), blocks)
    null = F.max(F.col("_to").isNull()).alias("null")
    lists = materialise(groups.agg(F.collect_set("_to").alias("near"), null).drop("_piece"))
    degree = F.sum(F.size("near")) + F.max("null").cast("int")
    return Packed(lists.drop("null"), blocks, materialise(lists.groupBy("src").agg(degree.alias("degree"))))


def propagate(edges: DataFrame | Packed, nodes: DataFrame, dims: Sequence[str], layers: int = 2) -> DataFrame:
    """Mean of the layers 0..K with E(l+1) = A E(l).

    ``nodes`` is (node, one double column per dimension), ``edges`` (src, dst, weight) or ``Packed``.
    A vector moves as slices of a few dimensions. A slice is sent once to each block of receivers with
    the list of its neighbours there, and a task adds up one slice in one block: a vector moves once
    per block and an edge once per slice, instead of a vector per edge.

    Weights that come from degrees are not sent. Layers are kept as U(l) = E(l) * sqrt(degree):
    U(l+1) of a node is then the plain sum of U(l) / degree over its neighbours.
    """
    packed = edges if isinstance(edges, Packed) else pack(materialise(edges))
    degrees = packed.degrees
    cut = [list(dims[i : i + SLICE]) for i in range(0, len(dims), SLICE)]
    cols = [f"_v{i}" for i in range(min(SLICE, len(dims)))]
    nothing = F.lit(None).cast("double")
    structs = [
        F.struct(F.lit(s).alias("_s"), *[(F.col(part[i]) if i < len(part) else nothing).alias(c) for i, c in enumerate(cols)])
        for s, part in enumerate(cut)
    ]
    current = nodes.select("node", *dims)
    if degrees is not None:
        root = F.sqrt(F.coalesce("degree", F.lit(1)))
        current = current.join(degrees, F.col("node") == F.col("src"), "left").select("node", *[(F.col(c) * root).alias(c) for c in dims])
    current = total = current.select("node", F.inline(F.array(*structs)))
    for layer in range(layers):
        out = current
        if degrees is not None:
            by_degree = [(F.col(c) / F.col("degree")).alias(c) for c in cols]
            out = out.join(degrees, F.col("node") == F.col("src")).select("node", "_s", *by_degree)
        cell = F.col("block") * len(cut) + F.col("_s")
        sent = packed.lists.join(out, F.col("src") == F.col("node")).select(cell.alias("_cell"), "near", *cols)
        rows = sent.repartitionById(packed.blocks * len(cut), "_cell").select("_cell", F.explode("near").alias("_to"), *cols)
        if degrees is None:
            rows = rows.select("_cell", F.col("_to.dst").alias("_to"), *[(F.col(c) * F.col("_to.weight")).alias(c) for c in cols])
        sums = rows.groupBy("_cell", "_to").agg(*[F.sum(c).alias(c) for c in cols])
        to = F.col("_to") if degrees is None else F.col("_to").cast("long")
        current = sums.select(to.alias("node"), (F.col("_cell") % len(cut)).alias("_s"), *cols)
        if layer + 1 < layers:  # the next layer and the mean read it
            current = materialise(current)
        total = total.unionByName(current)
    scale = F.lit(1.0 / (layers + 1))
    means = [F.sum(F.when(F.col("_s") == s, F.col(cols[i]))).alias(c) for s, part in enumerate(cut) for i, c in enumerate(part)]
    mean = total.repartition("node").groupBy("node").agg(*means)  # whole rows are put together after they moved
    if degrees is not None:
        mean = mean.join(degrees, F.col("node") == F.col("src"), "left")
        scale = scale / F.sqrt(F.coalesce("degree", F.lit(1)))
    return mean.select("node", *[(F.col(c) * scale).alias(c) for c in dims])


def spread(vectors: DataFrame, node: str, dim: int, prefix: str = "e") -> tuple[DataFrame, list[str]]:
    """A vector column as one column per dimension."""
    dims = [f"{prefix}{i}" for i in range(dim)]
    cols = [F.col("vector")[i].cast("double").alias(c) for i, c in enumerate(dims)]
    return vectors.select(F.col(node).alias("node"), *cols), dims
