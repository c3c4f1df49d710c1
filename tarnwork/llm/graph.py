"""Connected components of a distributed edge list, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.llm import common


def components(edges: DataFrame, loops: bool = False) -> DataFrame:
    """(node, comp) for each node of ``edges`` (a, b: long); comp is the smallest node of its component.
    With ``loops`` a node whose only edge is to itself is listed as well.

    Each round every node goes to its smallest neighbour or itself, chains of such moves are shortened,
    and edges are drawn between what is left; at least half of the nodes that still have edges go in a
    round. Nothing is gathered on the driver, and each round is cut off by a written table.
    """
    mapping = None
    edges = common.materialise((edges if loops else edges.filter("a <> b")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("up"))
        once = common.materialise(up, "up")
        up = once
        for _ in range(2):  # shorten chains: node -> up -> up of it
            top = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            up = up.join(top, "up").select("node", F.col("top").alias("up"))
        up = common.materialise(up, "up")
        common.release(once)
        old = mapping
        if mapping is None:
            mapping = up.select("node", F.col("up").alias("comp"))
        else:
            mapping = mapping.join(up.select(F.col("node").alias("comp"), "up"), "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"))
        mapping = common.materialise(mapping, "mapping")
        a, b = up.select(F.col("node").alias("a"), F.col("up").alias("x")), up.select(F.col("node").alias("b"), F.col("up").alias("y"))
        left = common.materialise(edges.join(a, "a").join(b, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct(), "edges")
        common.release(edges, up, *([old] if old else []))
        edges = left
        if edges.isEmpty():
            common.release(edges)
            return mapping
