"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import settle


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
    return tuple(row)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id of each node's connected component.

    nodes: (id); edges: (a, b) in any order, with ids of any type that has an order. Every round hangs the larger
    neighbours of each node on its smallest neighbour (large star), then its smaller ones (small
    star), until no edge changes; edges then lead from each node straight to its label. Rounds grow
    with the logarithm of a component's size; a star is met with its centre's smallest neighbour by
    a join, so no neighbourhood is gathered. Null ids join nothing; an empty table of edges leaves every node alone.
    """
    a, b = F.col("a"), F.col("b")
    now = settle(edges.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter(b > a).select(b.alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(small, "a").filter(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        after = settle(hung.unionByName(small.withColumnRenamed("m", "b")).distinct())
        last, mark = mark, _mark(after)
        now = after
        if mark == last:
            break
    return nodes.join(now.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "id"), "id", "left").select("id", F.coalesce("label", "id").alias("label"))
