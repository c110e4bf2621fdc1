"""Connected components over an edge table; every round is a written table.

Each node keeps a parent, a node of its component that isn't larger. In a round the node, and its parent too, take the
smallest grandparent among the node's neighbours, and each node skips to its own grandparent. Hooking the parent joins
whole trees at once, so the number of rounds grows with the logarithm of the number of nodes, also along a path (tested
with paths of 2,000 nodes), where plain label propagation takes as many rounds as the path is long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import drop_written, written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of the edges (a, b); label is the smallest node reachable.

    Self-edges and repeated edges do no harm; edges with a null end and empty tables add nothing.
    """
    return _rounds(edges)[0]


def _rounds(edges: DataFrame) -> tuple[DataFrame, int]:
    sound = edges.filter("a is not null and b is not null")
    both = sound.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e"))
    both = written(both.select("e.node", "e.other").distinct(), "edges")
    parents = both.groupBy("node").agg(F.least("node", F.min("other")).alias("up"))
    labels, n = written(_with_grandparent(parents), "labels"), 0
    while True:
        n += 1
        near = both.join(labels.select(F.col("node").alias("other"), F.col("top").alias("theirs")), "other").groupBy("node").agg(F.min("theirs").alias("theirs"))
        seen = labels.join(near, "node")
        hooked = seen.groupBy(F.col("up").alias("node")).agg(F.min("theirs").alias("hook"))
        moved = seen.join(hooked, "node", "left").select("node", F.least("up", "top", "theirs", "hook").alias("up"), F.col("top").alias("before"))
        after = written(_with_grandparent(moved), "labels")
        drop_written(labels)
        labels = after
        if after.filter("before <> top or up <> top").isEmpty():
            drop_written(both)
            return after.select("node", F.col("top").alias("label")), n


def _with_grandparent(parents: DataFrame) -> DataFrame:
    above = parents.select(F.col("node").alias("up"), F.col("up").alias("top"))
    return parents.join(above, "up")


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels after further edges: the components of the old components, carried back to the nodes."""
    a, b = (labels.withColumnsRenamed({"node": x, "label": f"_{x}"}) for x in "ab")
    lifted = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    above = components(lifted)
    old = labels.join(above.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    new = above.join(labels, "node", "left_anti")
    return written(old.unionByName(new), "labels")
