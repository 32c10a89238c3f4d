"""Connected components of a table of links, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.durable import Scratch

#: A table of up to so many rows (about 4 MB in each task's memory) is sent to all tasks; a larger one is joined by shuffle.
SMALL = 1 << 16


def sized(df: DataFrame) -> DataFrame:
    """``df``, a written table, marked to be sent to all tasks if it is small."""
    return F.broadcast(df) if df.count() <= SMALL else df


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b) other than the roots; root is the smallest node reachable.

    In each step a node takes the smallest root among its neighbours' and then that root's own root, so distances double.
    The smallest neighbour comes from an aggregation, so a node with many links needs no task of its own. Nulls, loops and
    repeated links are ignored. Steps end when nothing changes.
    """
    with Scratch() as here:
        pairs = links.where("a is not null and b is not null and a <> b").select("a", "b")
        edges = here.written(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
        low = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        labels = here.written(low.select("node", F.least("node", "low").alias("root")), "labels")
        while True:
            known = sized(labels)
            near = edges.join(known.select(F.col("node").alias("b"), F.col("root").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
            better = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("new"))
            up = better.join(known.select(F.col("node").alias("new"), F.col("root").alias("higher")), "new")
            after = here.written(up.select("node", F.least("new", "higher").alias("new"), "root"), "labels")
            done = after.where("new <> root").isEmpty()
            here.drop(labels)
            if done:
                return scratch.written(after.where("node <> new").select("node", F.col("new").alias("root")), "components")
            labels = here.written(after.select("node", F.col("new").alias("root")), "labels")
