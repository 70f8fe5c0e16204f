"""Connected components of links, as alternating star contractions of the edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.common import by_merge, written

#: Up to this number of edges a join is left to Spark, which may broadcast a side; with more its sides are merged.
FEW_EDGES = 100_000


def _mark(edges: DataFrame) -> tuple:
    """A digest of the edge set that no order changes."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame, side) -> DataFrame:
    """Every node's larger neighbours are hung on the least node of its neighbourhood."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.join(side(least), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame, side) -> DataFrame:
    """Every node and its smaller neighbours are hung on the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(side(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of a link; the root is the least node of its component.

    Links are pairs in either order; repeated links, links to itself and links
    with a null are of no effect. Each round stores its edges in the shared
    folder; the rounds grow with the logarithm of a component's size, and no
    node's neighbours are gathered in one row.
    """
    known = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = known.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    edges = written(edges, "edges")
    mark = _mark(edges)
    while mark[0]:
        side = by_merge if mark[0] > FEW_EDGES else lambda x: x
        edges = written(_small_star(_large_star(edges, side), side), "edges")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
