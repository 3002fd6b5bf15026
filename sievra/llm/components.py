"""Connected components of links between vertices of any ordered type, without ever holding a component in one place.

Rounds of large-star and small-star steps: every vertex links its larger (then its smaller) neighbours to the
smallest vertex that it sees. Each round is written to the shared folder. Rounds grow with the logarithm of the
longest chain. A vertex with very many neighbours is summed up before the shuffle and met in PARTS parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Parts in which the links of a vertex meet its smallest neighbour.
PARTS = 8


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(vertex, root) for every vertex in a link with another: root is the smallest vertex that links lead to.

    links has columns a and b. Links of a vertex with itself, links with a null end and repeated links change nothing.
    """
    edges = stage(_ordered(links.select("a", "b")), "links")
    mark = _mark(edges)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m"))
        large = _ordered(_meet(both, "a", least).filter("b > a").select(F.col("m").alias("a"), "b"))
        # large has a < b: each b's smaller neighbours, and b itself, go to the smallest of them
        low = large.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("v"), "m")
        small = _meet(large, "b", low).select(F.col("m").alias("a"), F.col("a").alias("b"))
        small = small.unionByName(low.select(F.col("m").alias("a"), F.col("v").alias("b")))
        edges = stage(_ordered(small), "links")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components not stable after {most_rounds} rounds")
    return edges.select(F.col("b").alias("vertex"), F.col("a").alias("root")).unionByName(
        edges.select(F.col("a").alias("vertex"), F.col("a").alias("root")).distinct()
    )


def _meet(links: DataFrame, end: str, least: DataFrame) -> DataFrame:
    """Links with m, the smallest neighbour of the vertex at an end; least has v and m."""
    other = "b" if end == "a" else "a"
    salted = links.withColumn("_part", F.pmod(F.xxhash64(other), F.lit(PARTS)))
    every = least.withColumn("_part2", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    return salted.join(every, (F.col(end) == F.col("v")) & (F.col("_part") == F.col("_part2")))


def _ordered(links: DataFrame) -> DataFrame:
    return links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Tells sets of edges apart: their number and the sum of their hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
