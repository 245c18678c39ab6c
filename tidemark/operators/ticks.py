"""Ticks of commits: fixed lengths of time since a repository's first commit, never running backwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000


def ticks(commits: DataFrame, micros: Column, size: int = DAY, block: int = 65_536) -> DataFrame:
    """(repo_id, commit_id, idx, raw, monotone) of commits (repo_id, commit_id, idx, time).

    raw counts ticks from the floor of the first commit's time; monotone is the highest raw tick so
    far, in order of idx: a late commit moves forward, none is dropped. The running maximum is taken
    inside blocks of idx, and the blocks' own maxima are carried over by one row per block, so the
    history of one huge repository is spread over many tasks. Commits without a time have no tick.
    """
    rows = commits.select("repo_id", "commit_id", "idx", micros.alias("us")).filter("us is not null")
    floored = lambda c: F.floor(c.cast("double") / size)
    first = rows.groupBy("repo_id").agg(F.min_by("us", F.struct("idx", "commit_id")).alias("t0"))
    raw = rows.join(first, "repo_id").select("repo_id", "commit_id", "idx", floored(F.col("us") - floored(F.col("t0")) * size).cast("long").alias("raw"), F.floor(F.col("idx") / block).alias("block"))
    tops = raw.groupBy("repo_id", "block").agg(F.max("raw").alias("top"))
    earlier = Window.partitionBy("repo_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select("repo_id", "block", F.max("top").over(earlier).alias("carried"))
    inside = Window.partitionBy("repo_id", "block").orderBy("idx", "commit_id").rowsBetween(Window.unboundedPreceding, 0)
    return raw.join(carried, ["repo_id", "block"]).select("repo_id", "commit_id", "idx", "raw", F.greatest(F.max("raw").over(inside), F.col("carried")).alias("monotone"))
