"""Connected components of a graph of 64-bit nodes by alternating large and small stars.

Each half round is a map-side combined minimum by node and an equi-join that AQE may split, so a
node with very many neighbours costs no task more than its share. Rounds are written to the shared
folder; the driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._common import stored


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Hangs the neighbours of each node on the least node known to it: the larger ones from both
    directions, or the smaller ones (and the node itself) from edges that point down."""
    if both_ways:
        edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = edges.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("u"), F.least("a", "low").alias("m"))
    met = edges.join(least, F.col("a") == F.col("u")).select("a", "b", "m")
    if both_ways:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge; component is the least node reachable.

    edges: columns a, b (bigint), any direction, repeats and loops allowed; rows with a null are
    left out. An empty table gives an empty result."""
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        edges = stored(_star(_star(edges, True), False), "edges")
        now = edges.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38,0)))")).first()
        if now == seen or now[0] == 0:
            break
        seen = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
