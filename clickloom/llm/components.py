"""Connected components of an edge table, in Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.session import materialise


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node reachable, for every node that has an edge.

    Each round every node takes the smallest node among itself and its neighbours, then
    what that node took, and so on down to a node that took itself; a chain halves per
    step. The edges are drawn anew between the nodes taken, and those that became
    loops or repeats go. A node taken stands for two at least, so nodes halve per
    round. Minima combine before the shuffle and the
    lookups are plain joins, which Spark splits when one node is hot. Null ends and
    loops add nothing.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    live = materialise(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    labels = None
    while True:
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        taken = materialise(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
        while True:
            onward = taken.select(F.col("u").alias("m"), F.col("m").alias("further"))
            further = materialise(taken.join(onward, "m").select("u", "m", "further"))
            taken = further.select("u", F.col("further").alias("m"))
            if further.where("m <> further").isEmpty():
                break
        if labels is None:
            labels = taken.select(F.col("u").alias("node"), F.col("m").alias("label"))
        else:
            step = taken.select(F.col("u").alias("label"), "m")
            labels = labels.join(step, "label", "left").select("node", F.coalesce("m", "label").alias("label"))
        labels = materialise(labels)
        ends = live.join(taken, "u").select(F.col("m").alias("u"), "v").join(taken.select(F.col("u").alias("v"), "m"), "v")
        ends = ends.select("u", F.col("m").alias("v")).where("u <> v")
        live = materialise(ends.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        if live.isEmpty():
            return labels
