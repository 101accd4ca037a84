"""Connected components by alternating star contraction.

Each round rewires every edge to the smallest neighbour of one of its ends, so the number of edges
never grows and the number of rounds is logarithmic in practice.  A round is two aggregations and
two equi-joins; the minima are written out before each join, so that a hub's neighbours arrive
through a plain shuffle that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.storage import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges (u, v) with u > v; returns edges with u > v.

    large: every neighbour above u is linked to the smallest of u and its neighbours; edges may repeat.
    small: u and every neighbour below it are linked to the smallest of these neighbours; edges are distinct.
    """
    if large:
        sides = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = edges.select("u", "v")
    least = materialize(sides.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "cc_least")
    joined = sides.join(least, "u")
    if large:
        # One edge for each that came in, so repeated ones may wait for the other operation to be removed.
        return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reachable.

    Self loops and null ends are ignored, repeated edges are harmless.  Nodes without an edge are not
    returned: they are their own component.  Raises if ``max_rounds`` is not enough, rather than
    return labels that are not final.
    """
    a, b = F.col(src), F.col(dst)
    now = materialize(
        edges.where((a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "cc_edges"
    )
    seen = _signature(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        now = materialize(_star(materialize(_star(now, large=True), "cc_large"), large=False), "cc_small")
        after = _signature(now)
        if after == seen:
            break
        seen = after
    else:
        raise RuntimeError(f"components not final after {max_rounds} rounds")
    star = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = star.select(F.col("component").alias("node"), "component").distinct()
    return star.unionByName(roots)
