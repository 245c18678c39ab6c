"""Problem 4: readings of tick_metrics that cannot be right."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.spikes import SpikeOptions, implausible, tail_report
from tidemark.session import settle
from tidemark.sources import table

METRICS = ("lines_added", "net_churn", "files_changed")


def _ticks(spark: SparkSession, folder: str) -> DataFrame:
    """One row per repository and tick: of repeated deliveries the one reported first."""
    raw = table(spark, folder, "tick_metrics").filter("repo_id is not null and tick is not null")
    picked = F.min_by(F.struct("lines_added", "net_churn", "files_changed", "lines_removed"), F.struct("reported_at", "lines_added", "net_churn", "files_changed"))
    return raw.groupBy("repo_id", "tick").agg(picked.alias("r")).select("repo_id", "tick", "r.*")


def _readings(ticks: DataFrame) -> DataFrame:
    """(source, tick, metric, value, signed, impossible): a row per reading."""
    negative = {
        "lines_added": F.col("lines_added") < 0,
        "net_churn": F.col("net_churn") + F.col("lines_removed") < 0,
        "files_changed": (F.col("files_changed") < 0) | ((F.col("files_changed") == 0) & (F.col("lines_added") > 0)),
    }
    each = F.array(
        *(F.struct(F.lit(m).alias("metric"), F.col(m).cast("long").alias("value"), F.lit(m == "net_churn").alias("signed"), F.coalesce(negative[m], F.lit(False)).alias("impossible")) for m in METRICS)
    )
    return ticks.select(F.col("repo_id").alias("source"), "tick", F.inline(each))


def judged(spark: SparkSession, folder: str, options: SpikeOptions = SpikeOptions()) -> DataFrame:
    """(repo_id, tick, metric, value, reason): every implausible reading with why.

    impossible: a negative count, no changed file though lines were added, net churn below what the
    removed lines allow, or readings of a tick that contradict each other. Of a contradiction between
    added lines, removed lines and net churn the wrong one is the one out of line with its
    neighbours: added lines if they are negative, stuck or a spike, otherwise net churn.
    """
    ticks = settle(_ticks(spark, folder))
    found = implausible(_readings(ticks), options)
    off = ticks.filter(F.col("net_churn") != F.col("lines_added") - F.col("lines_removed")).select(F.col("repo_id").alias("source"), "tick", F.lit(True).alias("off"))
    added = found.filter("metric = 'lines_added' and (impossible or stuck or spike)").select("source", "tick", F.lit(True).alias("added_wrong"))
    wrong_net = off.join(added, ["source", "tick"], "left_anti").select("source", "tick", F.lit("net_churn").alias("metric"), "off")
    reason = F.when(F.col("impossible") | F.col("off"), "impossible").when(F.col("stuck"), "stuck").when(F.col("spike"), "spike")
    return (
        found.join(wrong_net, ["source", "tick", "metric"], "left")
        .select(F.col("source").alias("repo_id"), "tick", "metric", "value", reason.alias("reason"))
        .filter("reason is not null and value is not null")
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """(repo_id, tick, metric) of the implausible readings."""
    return judged(spark, folder).select("repo_id", "tick", "metric")


def p4_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Per repository and metric, how many readings are implausible for which reason."""
    return judged(spark, folder).groupBy("repo_id", "metric", "reason").agg(F.count("*").alias("readings"))


def p4_tails(spark: SparkSession, folder: str) -> DataFrame:
    """Per metric, how many readings exceed the fitted cutoffs of several risks, beside how many sound ones should."""
    return tail_report(_readings(_ticks(spark, folder)), [1e-2, 1e-3, 1e-5])


QUERIES = {"p4_found": p4_found, "p4_rates": p4_rates, "p4_tails": p4_tails}
SQL: dict[str, str] = {}
