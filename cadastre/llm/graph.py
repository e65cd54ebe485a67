"""Connected components of any number of links, as rounds of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastre.session import materialise


def _to_roots(up: DataFrame) -> DataFrame:
    """``(node, up)`` with every ``up`` the root of its tree, by pointer jumping; an up that is no node is a root."""
    while True:
        over = up.select(F.col("node").alias("up"), F.col("up").alias("next"))
        jumped = materialise(up.join(over, "up", "left").select("node", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), "roots")
        up = jumped.select("node", "up")
        if jumped.where("moved").limit(1).count() == 0:
            return up


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows ``(node, component)``: the smallest node reachable, for every node that has a link.

    Each round hangs every node on its smallest neighbour if that is smaller than itself,
    follows these pointers to the roots, and contracts the links to links between roots,
    of which far fewer are left. Sums fold by node on the map side before they shuffle, so a
    node with very many links is no hot key there, and each step is written to the shared
    folder. Null ends and loops are no links; no link gives an empty table.
    """
    edges = materialise(
        links.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct(),
        "links",
    )
    known = None
    while edges.limit(1).count():
        # nodes without a smaller neighbour are the roots of this round
        up = _to_roots(materialise(edges.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("up")), "up"))
        if known is None:
            known = up
        else:
            over = up.select(F.col("node").alias("up"), F.col("up").alias("root"))
            known = known.join(over, "up", "left").select("node", F.coalesce("root", "up").alias("up")).union(
                up.join(known.select("node"), "node", "left_anti")
            )
        known = materialise(known, "known")
        high, low = up.select(F.col("node").alias("high"), F.col("up").alias("x")), up.select(F.col("node").alias("low"), F.col("up").alias("y"))
        ends = edges.join(high, "high").join(low, "low", "left").select("x", F.coalesce("y", "low").alias("y")).where("x <> y")
        edges = materialise(ends.select(F.greatest("x", "y").alias("high"), F.least("x", "y").alias("low")).distinct(), "links")
    if known is None:
        return edges.select(F.col("high").alias("node"), F.col("low").alias("component"))
    roots = known.select(F.col("up").alias("node")).distinct()
    return known.select("node", F.col("up").alias("component")).union(roots.select("node", F.col("node").alias("component")))
