"""Connected components of an undirected graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators.lookup import lookup_join
from assayer.session import cut_lineage


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 100) -> DataFrame:
    """``node``, ``component`` for each node of ``edges``; the component is its smallest node.

    Alternating large-star and small-star rounds: in each, the neighbours of a node are linked to its smallest neighbour, which needs one
    aggregate and one join by node and brings any graph to stars in about log2(n) rounds, long chains included. A node may hold a third of all
    edges: its minimum is combined before the shuffle and comes back to its edges by ``lookup_join``. Only the edges' number and
    checksum come to the driver. Loops give a component of one; edges with a null end are left out.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    nodes = ends.select(F.col("a").alias("node")).unionByName(ends.select(F.col("b").alias("node"))).distinct()
    current = cut_lineage(ends.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    now = _signature(current)
    for _ in range(most_rounds):
        large = cut_lineage(_star(current, now[0], both_ways=True))
        # A large star never has more edges than it had before.
        small = cut_lineage(_star(large, now[0], both_ways=False))
        last, now, current = now, _signature(small), small
        if now == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return nodes.join(current.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _signature(edges: DataFrame) -> tuple[int, int | None]:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _star(edges: DataFrame, total: int, both_ways: bool) -> DataFrame:
    """Edges (a > b) after one star step; ``total`` is about their number.

    Large: every neighbour larger than a node is linked to the smallest of the node and its neighbours. Small: a node and its smaller neighbours
    are linked to the smallest of them.
    """
    around = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if both_ways:
        around = around.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    met = lookup_join(around, least, ["u"], "n", total * (1 + both_ways))
    if both_ways:
        linked = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        linked = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return linked.where("a > b").distinct()
