"""Connected components of links between 64-bit ids, on executors only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import cut


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> (id long, component long): the least id reachable, for every id in a link.

    Alternating large-star and small-star rounds, each one shuffle by id, until a round changes nothing; their number grows
    with the logarithm of the size of the largest component.  A hub is no hot task: a round needs only the least neighbour of
    each id, which is aggregated before the shuffle, and the join that spreads it is one that Spark can split.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while True:
        # Large star: every larger neighbour is linked to the least of the neighbourhood.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.col("u")).alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        # Small star: every smaller neighbour, and the id itself, is linked to the least.
        large = large.distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").filter("a <> b").distinct()
        small = cut(small)
        old, edges = edges, small
        if not _differ(old, small):
            break
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def _differ(x: DataFrame, y: DataFrame) -> bool:
    figure = lambda d: d.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).collect()[0]
    return figure(x) != figure(y)
