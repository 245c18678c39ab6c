"""One ranking from several scores by robust rank aggregation."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ordering import log_code
from tidemark.session import settle

#: Parts that items with the same scores are numbered in.
SHARDS = 64


def distributed_ranks(values: DataFrame) -> DataFrame:
    """(scope, metric, value, rank, n) per distinct value of rows (scope, metric, value), best (largest) first.

    rank is the mean rank of the rows with that value, n the rows of scope and metric. Equal values
    are counted before anything is sorted; the rest is sorted inside buckets of nearly equal values,
    and the buckets' offsets come from their counts, so no scope is ever sorted in one task.
    """
    counts = values.filter("value is not null and not isnan(value)").groupBy("scope", "metric", "value").agg(F.count("*").alias("c"))
    counts = counts.withColumn("bucket", log_code(F.col("value")))
    key = ["scope", "metric"]
    totals = counts.groupBy(*key, "bucket").agg(F.sum("c").alias("m"))
    above = Window.partitionBy(*key).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*key, "bucket", F.coalesce(F.sum("m").over(above), F.lit(0)).alias("offset"), F.sum("m").over(Window.partitionBy(*key)).alias("n"))
    inside = Window.partitionBy(*key, "bucket").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("c").over(inside)).join(totals, [*key, "bucket"])
    return ranked.select(*key, "value", (F.col("offset") + F.col("upto") - (F.col("c") - 1) / 2).alias("rank"), "n")


def at_least(k: int, n: int, x: Column) -> Column:
    """Chance that k or more of n uniform ranks are at most x: the beta law of the k-th smallest."""
    return sum((F.lit(float(comb(n, j))) * F.pow(x, F.lit(float(j))) * F.pow(1 - x, F.lit(float(n - j))) for j in range(k, n + 1)), F.lit(0.0))


def significance(ranks: Column, most: int) -> Column:
    """Corrected minimum over the order statistics of an array of normalised ranks in (0, 1]; null if empty.

    ranks holds the item's known scores only: an item with m of them is judged by the laws for m.
    """
    def of(m: int) -> Column:
        ordered = F.sort_array(ranks)
        tails = [at_least(k, m, F.get(ordered, F.lit(k - 1))) for k in range(1, m + 1)]
        return (F.least(*tails) if m > 1 else tails[0]) * m

    chosen = F.lit(None).cast("double")
    for m in range(most, 0, -1):
        chosen = F.when(F.size(ranks) == m, of(m)).otherwise(chosen)
    return chosen


def aggregate_ranks(df: DataFrame, key: str, scores: list[str], scopes: dict[str, Column]) -> DataFrame:
    """(scope, key, n_scores, rho, mean_rank, position): one order per scope, position 1 first.

    scopes maps a name to a column; each of its values is a ranking of its own, named 'name:value'.
    Larger scores rank first. rho is the smallest corrected beta probability over the item's sorted
    normalised ranks: small only if several scores agree that the item is near the top, whatever
    their scales. Ties in rho go by mean rank, then a hash of the key, then key. Null and NaN scores do not count; items
    without any score come last with rho null. Repeated keys are taken once (largest row); items
    whose scope is null are left out of that scope. Scores' names may clash with nothing: they are
    taken by position.
    """
    picked = df.select(F.col(key).alias("item"), *(F.expr(f"`{s}`").cast("double").alias(f"s{i}") for i, s in enumerate(scores)), *(c.cast("string").alias(f"scope{i}") for i, c in enumerate(scopes.values())))
    rest = [c for c in picked.columns if c != "item"]
    one = picked.groupBy("item").agg(F.max(F.struct(*rest)).alias("r")).select("item", "r.*")
    names = list(scopes)
    named = F.explode(F.array(*(F.when(F.col(f"scope{i}").isNotNull(), F.concat(F.lit(f"{n}:"), F.col(f"scope{i}"))) for i, n in enumerate(names))))
    base = one.select("item", named.alias("scope"), *(f"s{i}" for i in range(len(scores)))).filter("scope is not null")
    long = F.inline(F.array(*(F.struct(F.lit(i).alias("metric"), F.col(f"s{i}").alias("value")) for i in range(len(scores)))))
    rows = settle(base.select("scope", "item", long))
    ranks = distributed_ranks(rows)
    known = rows.join(ranks, ["scope", "metric", "value"], "left").withColumn("r", F.col("rank") / F.col("n"))
    items = known.groupBy("scope", "item").agg(F.collect_list("r").alias("ranks"))
    judged = items.select("scope", "item", F.size("ranks").alias("n_scores"), significance(F.col("ranks"), len(scores)).alias("p"), F.expr("try_divide(aggregate(ranks, 0D, (a, x) -> a + x), size(ranks))").alias("mean_rank"))
    # the order: p (not yet cut at 1), then mean rank; buckets of both, then exact inside each
    judged = judged.withColumn("bucket", F.struct(F.coalesce(log_code(F.col("p")), F.lit(1 << 20)).alias("p"), F.coalesce(F.floor(F.col("mean_rank") * 4096), F.lit(1 << 20)).alias("m")))
    judged = settle(judged.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(SHARDS))))
    # equal items are counted per shard first: a third of all rows with the same scores is numbered in many tasks
    cells = judged.groupBy("scope", "bucket", "p", "mean_rank", "shard").agg(F.count("*").alias("c"))
    sizes = cells.groupBy("scope", "bucket").agg(F.sum("c").alias("b"))
    # p falls into at most 65,535 codes and the mean rank into 4,097: the buckets' offsets need no more rows than that
    before = Window.partitionBy("scope").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("scope", "bucket", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("scope", "bucket").orderBy(F.asc_nulls_last("p"), F.asc_nulls_last("mean_rank"), "shard").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("earlier", F.coalesce(F.sum("c").over(within), F.lit(0))).join(sizes, ["scope", "bucket"])
    cells = cells.select(F.col("scope").alias("s"), F.col("p").alias("q"), F.col("mean_rank").alias("r"), F.col("shard").alias("d"), (F.col("earlier") + F.col("before")).alias("offset"))
    inside = Window.partitionBy("scope", "p", "mean_rank", "shard").orderBy("item")
    same = (F.col("scope") == F.col("s")) & F.col("p").eqNullSafe(F.col("q")) & F.col("mean_rank").eqNullSafe(F.col("r")) & (F.col("shard") == F.col("d"))
    placed = judged.withColumn("at", F.row_number().over(inside)).join(cells, same)
    return placed.select("scope", F.col("item").alias(key), "n_scores", F.least(F.col("p"), F.lit(1.0)).alias("rho"), "mean_rank", (F.col("at") + F.col("offset")).alias("position"))
