"""Connected components by alternating large-star and small-star (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitwarden.operators.scale import attach, materialise, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (src > dst).

    The smallest neighbour is an aggregate with partial sums on the map side; handing it
    back to the neighbours salts nodes with very many neighbours.
    """
    if large:
        sides = edges.select("src", "dst").union(edges.select("dst", "src"))
    else:
        sides = edges
    pairs = sides.toDF("node", "other")
    smallest = pairs.groupBy("node").agg(
        F.least("node", F.min("other")).alias("low"), F.count("*").alias("degree")
    )
    spread = attach(pairs, smallest, "node", "degree", keep_size=False)
    if large:
        linked = spread.filter(F.col("other") > F.col("node")).select(
            F.col("other").alias("src"), F.col("low").alias("dst")
        )
    else:
        linked = spread.select(F.col("other").alias("src"), F.col("low").alias("dst")).union(
            smallest.select("node", "low")
        )
    return linked.filter("src > dst").distinct()


def _settled(edges: DataFrame) -> bool:
    """True when the edges are stars: every source has one edge and no target is a source."""
    ends = edges.select("src", F.lit(1).alias("up"), F.lit(0).alias("root")).union(
        edges.select("dst", F.lit(0), F.lit(1))
    )
    # Parts of a node's edges are summed before the shuffle, so a hub costs one row per task.
    nodes = ends.groupBy("src").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
    return nodes.filter("up > 1 OR (up > 0 AND root > 0)").isEmpty()


def edge_stars(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Reduce edges (``src``, ``dst``) to one edge per node to its component's least node."""
    current = materialise(
        edges.filter("src <> dst")
        .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        .distinct(),
        "edges",
    )
    for _ in range(max_rounds):
        if _settled(current):
            return current
        widened = materialise(_star(current, large=True), "large-star")
        following = materialise(_star(widened, large=False), "small-star")
        release(current, widened)
        current = following
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def duplicate_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``component`` = least ``row_no`` reachable, for every vertex (column ``row_no``)."""
    labels = edge_stars(edges).select(
        F.col("src").alias("row_no"), F.col("dst").alias("component")
    )
    return vertices.join(labels, "row_no", "left").withColumn(
        "component", F.coalesce("component", "row_no")
    )
