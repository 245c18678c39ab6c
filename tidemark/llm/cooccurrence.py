"""Items that appear together: pair counts, lift and pointwise mutual information."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import settle

#: Items of a basket that one task pairs at once; larger baskets are paired block against block.
BLOCK = 256


def _numbered(marginals: DataFrame) -> DataFrame:
    """marginals with `item`: a long that is unique per group, so that pairs shuffle as two longs.

    The number is a 64-bit hash whose low 8 bits count the items that share the rest: exact as long
    as fewer than 256 items of a group share 56 bits.
    """
    high = F.shiftleft(F.shiftright(F.xxhash64("name"), 8), 8)
    at = Window.partitionBy("grp", "high").orderBy("name")
    return marginals.withColumn("high", high).withColumn("item", F.col("high").bitwiseOR((F.row_number().over(at) - 1).cast("long"))).drop("high")


def _pairs(baskets: DataFrame) -> DataFrame:
    """(grp, item_a, item_b) for each two items of each basket, from rows (grp, basket, item).

    Small baskets are gathered. The items of a large one are dealt into blocks, each item goes once
    to every pair of blocks that its own is in, and only a pair of blocks is ever in one place.
    """
    sizes = baskets.groupBy("grp", "basket").agg(F.count("*").alias("m"))
    few = baskets.join(sizes.filter(F.col("m") <= BLOCK).select("grp", "basket"), ["grp", "basket"], "left_semi")
    small = few.groupBy("grp", "basket").agg(F.sort_array(F.collect_list("item")).alias("items"))
    heads = small.select("grp", "items", F.posexplode("items").alias("at", "item_a"))
    small_pairs = heads.select("grp", "item_a", F.explode(F.expr("slice(items, at + 2, size(items))")).alias("item_b"))
    many = baskets.join(sizes.filter(F.col("m") > BLOCK), ["grp", "basket"]).withColumn("k", F.ceil(F.col("m") / BLOCK))
    dealt = many.withColumn("own", F.pmod(F.xxhash64("item"), "k")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    dealt = dealt.select("grp", "basket", "item", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    cells = dealt.groupBy("grp", "basket", "lo", "hi").agg(
        F.sort_array(F.collect_list(F.when(F.col("own") == F.col("lo"), F.col("item")))).alias("left"),
        F.sort_array(F.collect_list(F.when(F.col("own") == F.col("hi"), F.col("item")))).alias("right"),
    )
    x = cells.select("grp", "lo", "hi", "right", F.explode("left").alias("x"))
    y = x.select("grp", "lo", "hi", "x", F.explode("right").alias("y")).filter("lo <> hi or x < y")
    return small_pairs.unionByName(y.select("grp", F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b")))


def cooccurrence(df: DataFrame, group: str, basket: str, items: str, min_count: int = 6, min_lift: float = 4.0) -> DataFrame:
    """(group, item_a, item_b, n_ab, n_a, n_b, n, lift, pmi) of the pairs of items that share baskets.

    df has one row per delivery of a basket, with an array of items. A basket is taken once whatever
    the number of its rows, an item once per basket; n counts a group's baskets with an item.
    Pairs with n_ab >= min_count and n_ab * n >= min_lift * n_a * n_b are kept, item_a < item_b.
    Items with fewer than min_count baskets, or with min_lift * n_item > n, can be in no such pair
    and are left out before pairs are made, which loses nothing. Null items, and rows whose group or
    basket is null, take no part; null and empty arrays add no basket; an empty table gives no rows.
    """
    rows = df.select(F.col(group).alias("grp"), F.col(basket).alias("basket"), F.explode(F.array_distinct(items)).alias("name"))
    rows = settle(rows.filter("grp is not null and basket is not null and name is not null").distinct())
    totals = rows.select("grp", "basket").distinct().groupBy("grp").agg(F.count("*").alias("n"))
    marginals = rows.groupBy("grp", "name").agg(F.count("*").alias("c")).filter(F.col("c") >= min_count)
    marginals = marginals.join(totals, "grp").filter(F.lit(min_lift) * F.col("c") <= F.col("n"))
    known = settle(_numbered(marginals))
    coded = settle(rows.join(known.select("grp", "name", "item"), ["grp", "name"]).select("grp", "basket", "item"))
    counts = _pairs(coded).groupBy("grp", "item_a", "item_b").agg(F.count("*").alias("n_ab")).filter(F.col("n_ab") >= min_count)
    a = known.select("grp", F.col("item").alias("item_a"), F.col("name").alias("name_a"), F.col("c").alias("n_a"), "n")
    b = known.select("grp", F.col("item").alias("item_b"), F.col("name").alias("name_b"), F.col("c").alias("n_b"))
    full = counts.join(a, ["grp", "item_a"]).join(b, ["grp", "item_b"]).filter(F.col("n_ab") * F.col("n") >= F.lit(min_lift) * F.col("n_a") * F.col("n_b"))
    swap = F.col("name_a") > F.col("name_b")
    lift = F.col("n_ab").cast("double") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))
    return full.select(
        F.col("grp").alias(group),
        F.least("name_a", "name_b").alias("item_a"),
        F.greatest("name_a", "name_b").alias("item_b"),
        "n_ab",
        F.when(swap, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"),
        F.when(swap, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b"),
        "n",
        lift.alias("lift"),
        F.log2(lift).alias("pmi"),
    )
