"""Connected components of a table of edges, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()


def _roots(edges: DataFrame) -> DataFrame:
    """(node, root): each node points to its smallest neighbour, if that is smaller, and is followed to where no pointer leads on."""
    ways = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "hooked")
    while True:
        onward = ways.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = materialize(ways.join(onward, "root").select("node", F.col("root").alias("old"), F.col("next").alias("root")), "jumped")
        ways = jumped.select("node", "root")
        if not jumped.where("root <> old").limit(1).count():
            return ways


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b); comp is the smallest node that its edges reach.

    Each round merges nodes into roots and keeps the edges between different roots, until none is left. A root that
    takes in no other has a smaller neighbour in the next round, so the roots with edges halve in two rounds at least;
    pointers are followed by doubling. Tables go to the shared folder; only whether rows are left comes to the driver.
    """
    between = materialize(_both_ways(edges), "edges")
    labels = None
    while True:
        roots = _roots(between)
        if labels is None:
            labels = roots.withColumnRenamed("root", "comp")
        else:
            onward = roots.select(F.col("node").alias("comp"), "root")
            labels = materialize(labels.join(onward, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), "labels")
        one, two = (roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
        left = between.join(one, "a").join(two, "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
        between = materialize(left.where("a <> b").distinct(), "edges")
        if not between.limit(1).count():
            return labels
