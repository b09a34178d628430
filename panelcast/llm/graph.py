"""Connected components of an edge table, for the operators that link rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: any orderable key); root
    is the smallest node of the component.

    Each round hangs every node below its smallest neighbour, follows the
    pointers to their roots and contracts the graph to the roots, so at least
    half of the nodes that still have edges disappear. Tables are cut to the
    shared folder; only row counts reach the driver. Sums and minima are partial
    sums first, and what a hub has in a join AQE splits."""
    edges = cut(edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct())
    total: DataFrame | None = None
    while edges.count() > 0:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = cut(both.groupBy("a").agg(F.min("b").alias("m"))
                 .select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
        while True:
            above = up.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            nxt = cut(up.join(above, "root").select("node", F.col("higher").alias("root"),
                                                    (F.col("higher") != F.col("root")).alias("moved")))
            up = nxt.select("node", "root")
            if nxt.filter("moved").limit(1).count() == 0:
                break
        if total is None:
            total = up
        else:
            over = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
            total = cut(total.join(over, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
        left = up.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = cut(edges.join(left, "a").join(right, "b").filter(F.col("ra") != F.col("rb"))
                    .select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    return total if total is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
