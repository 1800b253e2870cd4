"""Connected components of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipway.llm.common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Every vertex links its larger neighbours to the least vertex it knows."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")), "least")
    return both.filter("b > a").join(least, "a").select(F.col("least").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every vertex links itself and its smaller neighbours to the least of these."""
    down = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    least = cut(down.groupBy("a").agg(F.min("b").alias("least")), "least")
    moved = down.join(least, "a").filter("b != least").select(F.col("least").alias("a"), "b")
    return moved.union(least.select(F.col("least").alias("a"), F.col("a").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) for every vertex of ``edges`` (a, b); the root is the least vertex reachable.

    Links may repeat, run either way and lead to themselves; a vertex with a link to itself
    only is its own root. Each round is written to the shared folder, the number of rounds
    grows with the logarithm of the longest path. Minima are taken by partial aggregation and
    written, so a vertex with very many links is joined as a skewed key and never gathered.
    """
    links = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    stars = links.filter("a != b")
    state = None
    while state != (state := _state(stars)) and state[0]:
        stars = cut(_small_star(cut(_large_star(stars), "large")), "small")
    vertices = links.select(F.explode(F.array("a", "b")).alias("vertex")).distinct()
    roots = stars.select(F.col("b").alias("vertex"), F.col("a").alias("root"))
    return vertices.join(roots, "vertex", "left").select("vertex", F.coalesce("root", "vertex").alias("root"))
