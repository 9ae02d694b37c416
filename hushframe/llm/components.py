"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.storage import written


def _smallest(directed: DataFrame) -> DataFrame:
    """Each (node, near) edge with the smallest neighbour of the node; hot nodes are summed up before they move."""
    least = directed.groupBy("node").agg(F.min("near").alias("least"))
    return directed.join(least, "node")


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of each node of the (a, b) edges; the component is its smallest node. Edges may repeat.

    Alternating stars: each round hangs the larger neighbours of a node, then the smaller ones, on the smallest of
    them. A round is written to the shared folder, which cuts the lineage; a few rounds are enough for any chain
    (their number grows with the logarithm of its length), and only two sums per round reach the driver.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("near")).distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("near").alias("node"), F.col("node").alias("near")))
        large = _smallest(both).filter(F.col("near") > F.col("node"))
        large = large.select(F.col("near").alias("node"), F.least("node", "least").alias("near")).distinct()
        small = _smallest(large)
        hung = small.filter("near <> least").select(F.col("near").alias("node"), F.col("least").alias("near"))
        now = written(small.select("node", F.col("least").alias("near")).unionByName(hung).distinct(), "stars")
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("node", "near").cast("decimal(20,0)")).alias("s")).first()
        if before == (state["n"], state["s"]):
            break
        before = state["n"], state["s"]
    tops = now.select(F.col("near").alias("node"), F.col("near").alias("component")).distinct()
    return now.select("node", F.col("near").alias("component")).unionByName(tops)
