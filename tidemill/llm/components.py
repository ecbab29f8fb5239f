"""Connected components of a link table, by alternating stars.

Each round every vertex links its neighbours to the least of them, first those above it, then those below; chains
fold in a number of rounds that grows with the logarithm of their length. Rounds are tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import saved


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """edges (a, b) -> edges from each vertex's neighbours (all of them, or those not above it) to the least of the vertex and these."""
    if larger:
        near = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    both = near.join(low, "a")
    if larger:
        out = both.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = both.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(a, b) -> vertex, root: the least vertex that links reach. Only vertices with links have rows; none gives none."""
    edges = saved(links.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    sign = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    before = sign(edges)
    for _ in range(most):
        if not before["n"]:
            break
        edges = saved(_star(_star(edges, True), False), "links")
        after = sign(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("vertex"), "root").distinct())
