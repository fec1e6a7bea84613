"""Connected components by alternating large-star and small-star steps, all in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firegrid.storage import Scratch, stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _large(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the least of its neighbourhood."""
    near = _both(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return near.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small(edges: DataFrame) -> DataFrame:
    """Every node hands itself and its smaller neighbours to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) of every node of edges (a, b): component is the least node that can be reached.

    Loops and repeated edges do no harm; no edges, no rows. A round is a few joins on node ids, whatever the sizes of
    components, and there are about log(nodes) rounds.
    """
    held = Scratch(edges.sparkSession)
    edges = held.stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.shiftright(F.xxhash64("b", "a"), 20))).first()
    before = mark(edges)
    if before[0]:
        for _ in range(most_rounds):
            edges = held.stored(_small(_large(edges)), "edges")
            if (now := mark(edges)) == before:
                break
            before = now
        else:
            raise RuntimeError("components did not settle")
    nodes = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    out = stored(nodes.unionByName(nodes.select(F.col("component").alias("id"), "component").distinct()), "components")
    held.clear()
    return out
