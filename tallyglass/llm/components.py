"""Connected components of a link table: alternate large and small stars, one written table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.scale import staged


def _state(edges: DataFrame) -> tuple:
    """Tells whether a round changed anything: a count and an order-free sum over all links."""
    mark = F.xxhash64("a", "b")
    low, high = F.pmod(mark, F.lit(1 << 31)), F.shiftright(mark, 31)
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(low), F.sum(high)).first())


def stars(edges: DataFrame) -> DataFrame:
    """From links ``a, b`` (long, a <> b) to ``a, b`` with one row per node but the roots: ``b`` is the smallest node
    that ``a`` reaches.

    Each round points every larger neighbour of a node at the smallest one (large star), then every smaller one (small
    star).  Minima combine map-side and meet the links in a join, so a node with very many links is never gathered.
    """
    edges = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(edges)
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        below = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        turned = staged(below.union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        if (now := _state(turned)) == state:
            return turned
        edges, state = turned, now
