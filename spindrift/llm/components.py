"""Connected components of an edge table, without a driver-side graph.

Alternating star contraction: the large star links each neighbour above a node to the least node around it, the small
star does so with the neighbours below; stars of a component grow together in a logarithmic number of rounds. A round
is two grouped minima (combined on the map side) joined back to the edges, so a node with very many edges is split by
the engine's skew handling. Each round's edges are a written table. Rounds end when the edges are stars, which one count
by node tells: edges that are stars take no round, and none is spent on finding that nothing changes.

Defined cases: edges in either direction, repeated ones and chains of any length count once; an edge of a node to itself
or with a null end adds no node; no edges give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import Scratch


def stars(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """node, component (its smallest node), for every node of an edge between different nodes except the smallest of each
    component, as a written table: edges that connect the same nodes, which further edges can be added to."""
    scratch = Scratch(edges.sparkSession)
    a, b = F.col(left), F.col(right)
    now = scratch.keep("edges0", edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    rounds = 0
    while not _are_stars(now):
        rounds += 1
        both = now.selectExpr("inline(array(struct(u AS u, v AS v), struct(v AS u, u AS v)))")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        above = now.select(F.col("v").alias("u"), F.col("u").alias("v"))
        # A row for each edge, so repeated ones can wait for the small star to drop them.
        large = scratch.keep(f"large{rounds}", above.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = scratch.keep(f"edges{rounds}", small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """node, component (its smallest node), for every node of an edge between different nodes."""
    found = stars(edges, left, right)
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether each upper end has one edge and is no lower end; edges (u, v), u > v, are distinct."""
    ends = edges.selectExpr("inline(array(struct(u AS node, 1 AS above, 0 AS below), struct(v AS node, 0 AS above, 1 AS below)))")
    ends = ends.groupBy("node").agg(F.sum("above").alias("above"), F.max("below").alias("below"))
    return not ends.where("above > 1 OR above = 1 AND below = 1").limit(1).count()
