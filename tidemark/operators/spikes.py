"""Implausible readings of a measured series: tail cutoffs by extreme values, stuck runs, plausibility.

A reading is judged against its own source. Series are cut into blocks of time with an overlap, so
that one source with a third of all rows is spread over many tasks; everything else is a combinable
aggregate per source.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import settle


@dataclass(frozen=True)
class SpikeOptions:
    """reach: ticks on either side that count as neighbours. season: ticks of a period.

    block: ticks of a block of work. risk: chance of a sound reading beyond the cutoff.
    tail: share of a source's residuals that the tail is fitted to. least: readings of all sources
    that weigh as much as a source's own in its fit. rounds: fits at most, each without what the one
    before cut off. run: readings of a stuck run. few: neighbours that a judgement takes.
    """

    reach: int = 14
    season: int = 7
    block: int = 2048
    risk: float = 1e-5
    tail: float = 0.1
    least: int = 60
    rounds: int = 20
    run: int = 6
    few: int = 4


#: Steps of a histogram of scores: two scores in one differ by 2 % at most.
STEP = 1.02


def stuck_runs(readings: DataFrame, options: SpikeOptions = SpikeOptions()) -> DataFrame:
    """readings (source, metric, tick, value, ..) with `stuck`: part of `run` or more recorded ticks of one non-zero value.

    Further columns are kept. A null reading ends a run. Runs are numbered per block and carried over block ends by a summary
    of one row per block, so a run of any length is found whole.
    """
    key = ["source", "metric"]
    block = F.floor(F.col("tick") / options.block).alias("block")
    rows = readings.select("*", block)
    rest = [c for c in readings.columns if c not in key]
    inside = Window.partitionBy(*key, "block").orderBy("tick")
    ends = rows.groupBy(*key, "block").agg(F.max_by(F.struct("value"), "tick").alias("last"))
    before = ends.select(*key, "block", F.lag("last").over(Window.partitionBy(*key).orderBy("block")).alias("carried"))
    joined = rows.join(before, [*key, "block"], "left")
    previous = F.coalesce(F.lag(F.struct("value")).over(inside), F.col("carried"))
    marked = joined.withColumn("opens", F.when(F.col("value").isNull() | previous.isNull() | ~previous["value"].eqNullSafe(F.col("value")), 1).otherwise(0))
    marked = marked.withColumn("at", F.sum("opens").over(inside))
    opened = marked.groupBy(*key, "block").agg(F.sum("opens").alias("n"))
    earlier = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = opened.select(*key, "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    numbered = marked.join(offsets, [*key, "block"], "left").withColumn("run", F.col("at") + F.col("offset"))
    long_runs = numbered.filter("value is not null and value <> 0").groupBy(*key, "run").count().filter(F.col("count") >= options.run)
    return numbered.join(long_runs.select(*key, "run", F.lit(True).alias("hit")), [*key, "run"], "left").select(*key, *rest, F.coalesce("hit", F.lit(False)).alias("stuck"))


def residuals(readings: DataFrame, options: SpikeOptions = SpikeOptions()) -> DataFrame:
    """readings (source, metric, tick, value, signed, sound, ..) with `score`: distance from the neighbours in units of their range.

    The season's factor per source is the median magnitude at that phase over the median magnitude.
    The range is what the sound neighbours within `reach` ticks show without their one highest and
    one lowest value. Null for readings that are not sound and where fewer than `few` neighbours are known.
    """
    key = ["source", "metric"]
    sized = readings.withColumn("phase", F.pmod(F.col("tick"), F.lit(options.season))).withColumn("sound", F.col("sound") & F.col("value").isNotNull())
    usual = sized.filter("sound")
    at = usual.groupBy(*key, "phase").agg(F.percentile_approx(F.abs("value"), 0.5).alias("mid"))
    whole = usual.groupBy(*key).agg(F.percentile_approx(F.abs("value"), 0.5).alias("all_mid"))
    factor = F.least(F.greatest(F.try_divide(F.col("mid").cast("double"), F.col("all_mid").cast("double")), F.lit(0.25)), F.lit(4.0))
    factors = at.join(whole, key).select(*key, "phase", F.coalesce(F.when(F.col("mid") > 0, factor), F.lit(1.0)).alias("factor"))
    even = sized.join(factors, [*key, "phase"], "left").withColumn("x", F.col("value") / F.coalesce("factor", F.lit(1.0)))
    b, r = options.block, options.reach
    spread = even.withColumn("home", F.floor(F.col("tick") / b)).withColumn(
        "block", F.explode(F.array_distinct(F.array(F.floor((F.col("tick") - r) / b), F.col("home"), F.floor((F.col("tick") + r) / b))))
    )
    window = Window.partitionBy(*key, "block").orderBy("tick")
    good = F.when(F.col("sound"), F.col("x"))
    near = F.sort_array(F.concat(F.collect_list(good).over(window.rangeBetween(-r, -1)), F.collect_list(good).over(window.rangeBetween(1, r))))
    judged = spread.withColumn("near", near).filter("block = home").withColumn("n", F.size("near"))
    low, high, mid = F.expr("near[1]"), F.expr("near[n - 2]"), F.expr("(near[(n - 1) div 2] + near[n div 2]) / 2")
    # the range of a series near zero is at least one unit, that of a positive series at least its level
    width = F.greatest(F.when(F.col("signed"), high - low).otherwise(high), F.lit(1.0))
    away = F.when(F.col("signed"), F.abs(F.col("x") - mid) / width).otherwise(F.greatest(F.col("x") / width, F.lit(0.0)))
    return judged.select(*readings.columns, F.when(F.col("sound") & (F.col("n") >= options.few), away).alias("score"))


def fit_tail(steps: np.ndarray, n: np.ndarray, s: np.ndarray, ss: np.ndarray, options: SpikeOptions) -> tuple[float, float, float]:
    """(mean, shape, cutoff) of the excesses over 1 of scores in units of their threshold.

    The scores come as a histogram: steps with their number, sum and sum of squares. Above the
    threshold the excesses follow a generalised Pareto law, fitted by moments; a fit leaves out what
    lies beyond the cutoff of the one before, until the cutoff stays, so that wrong readings do not
    count. The first cutoff comes from quantiles, with a shape of 0.2 at most. No tail is taken for
    lighter than an exponential one.
    """
    share = options.risk / options.tail
    over = steps >= 0
    if not n[over].sum():
        return 1.0, 1e-3, float("inf")
    upto = np.cumsum(n[over]) / n[over].sum()
    half, three = (max(STEP ** (float(steps[over][np.searchsorted(upto, q)]) + 1) - 1, d) for q, d in ((0.5, 1e-3), (0.75, 2e-3)))
    shape = min(max(np.log2(max((three - half) / half, 1e-3)), 1e-3), 0.2)
    cutoff = 1 + half / (2**shape - 1) * (share**-shape - 1)
    mean = half
    for _ in range(options.rounds):
        kept = over & (STEP ** steps.astype("float64") <= cutoff)
        m, y = n[kept].sum(), (s - n)[kept].sum()
        if not m or y <= 0:
            break
        mean = y / m
        spread = max((ss - 2 * s + n)[kept].sum() / m - mean * mean, 1e-9)
        shape = max(0.5 * (1 - mean * mean / spread), 1e-3)
        last, cutoff = cutoff, 1 + mean * (1 - shape) / shape * (share**-shape - 1)
        if abs(cutoff - last) < 1e-6:
            break
    return float(mean), float(shape), float(cutoff)


def tails(scored: DataFrame, options: SpikeOptions = SpikeOptions()) -> DataFrame:
    """(source, metric, readings, threshold, share, shape, scale, cutoff): the law of each source's tail, and the score a sound reading exceeds with chance `risk`.

    Peaks over threshold: above the (1 - tail) quantile of the source the excesses follow a
    generalised Pareto law. Its shape is that of all sources of the metric, in units of their
    thresholds (`fit_tail`); its scale and the share beyond the threshold are the source's own, drawn
    to those of all sources with the weight of `least` readings.

    Everything is read off one histogram per source, which is added up before the shuffle, so a
    source with a third of all readings is gathered nowhere; a metric's histogram has a row per
    step of 2 %, however many sources there are.
    """
    key = ["source", "metric"]
    step = F.floor(F.log(F.least(F.greatest("score", F.lit(1e-3)), F.lit(1e9))) / F.log(F.lit(STEP))).cast("int")
    hist = scored.filter("score is not null").groupBy(*key, step.alias("b")).agg(F.count("*").alias("n"), F.sum("score").alias("s"), F.sum(F.col("score") * F.col("score")).alias("ss"))
    hist = settle(hist)

    def edge(rows: DataFrame, by: list[str]) -> DataFrame:
        """The step above which a share of `tail` of the readings lies."""
        upto = F.sum("n").over(Window.partitionBy(*by).orderBy("b")) / F.sum("n").over(Window.partitionBy(*by))
        return rows.withColumn("upto", upto).groupBy(*by).agg(F.sum("n").alias("readings"), (F.min(F.when(F.col("upto") >= 1 - options.tail, F.col("b"))) + 1).alias("edge"))

    every = edge(hist.groupBy("metric", "b").agg(F.sum("n").alias("n")), ["metric"]).select("metric", F.col("edge").alias("all_edge"))
    own = edge(hist, key).join(F.broadcast(every), "metric")
    own = own.select(*key, "readings", F.when(F.col("readings") >= options.least, F.col("edge")).otherwise(F.col("all_edge")).alias("edge"))
    unit = F.pow(F.lit(STEP), F.col("edge"))
    even = hist.join(own, key).select(*key, "readings", "edge", (F.col("b") - F.col("edge")).alias("step"), "n", (F.col("s") / unit).alias("s"), (F.col("ss") / unit / unit).alias("ss"))
    even = settle(even)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("step")
        return pd.DataFrame([(rows["metric"].iloc[0], *fit_tail(*(rows[c].to_numpy() for c in ("step", "n", "s", "ss")), options))], columns=["metric", "mean", "shape", "all_cutoff"])

    pooled = even.groupBy("metric", "step").agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss")))
    laws = pooled.groupBy("metric").applyInPandas(fit, "metric string, mean double, shape double, all_cutoff double")
    each = even.join(F.broadcast(laws), "metric")
    kept = (F.col("step") >= 0) & (F.pow(F.lit(STEP), F.col("step")) <= F.col("all_cutoff"))
    sums = [F.sum(F.when(F.col("step") >= 0, F.col("n"))).alias("beyond"), F.sum(F.when(kept, F.col("n"))).alias("m"), F.sum(F.when(kept, F.col("s") - F.col("n"))).alias("y")]
    each = each.groupBy(*key, "readings", "edge", "mean", "shape").agg(*sums).fillna(0, ["beyond", "m", "y"])
    k = options.least
    scale = unit * (F.col("y") + k * F.col("mean")) / (F.col("m") + k) * (1 - F.col("shape"))
    share = (F.col("beyond") + k * options.tail) / (F.col("readings") + k)
    each = each.select(*key, "readings", unit.alias("threshold"), share.alias("share"), "shape", scale.alias("scale"))
    return each.withColumn("cutoff", F.col("threshold") + F.col("scale") / F.col("shape") * (F.pow(options.risk / F.col("share"), -F.col("shape")) - 1))


def _scored(readings: DataFrame, options: SpikeOptions) -> DataFrame:
    flagged = stuck_runs(readings, options).select("source", "metric", "tick", "value", "signed", "impossible", "stuck")
    return settle(residuals(flagged.withColumn("sound", ~F.col("stuck") & ~F.col("impossible")), options).drop("sound"))


def implausible(readings: DataFrame, options: SpikeOptions = SpikeOptions()) -> DataFrame:
    """(source, metric, tick, value, signed, impossible, stuck, score, cutoff, spike) of readings (source, metric, tick, value, signed, impossible).

    Impossible and stuck readings do not count as anyone's neighbours. Nulls are never cases; an
    empty input gives no rows; one reading per source, metric and tick is expected.
    """
    scored = _scored(readings, options)
    law = tails(scored, options).select("source", "metric", "cutoff")
    return scored.join(law, ["source", "metric"], "left").withColumn("spike", F.coalesce(F.col("score") > F.col("cutoff"), F.lit(False)))


def tail_report(readings: DataFrame, risks: list[float], options: SpikeOptions = SpikeOptions()) -> DataFrame:
    """(metric, risk, readings, expected, observed): how many readings exceed the cutoffs of each risk, and how many sound ones should.

    At risks that many sound readings exceed the two agree if the fitted laws hold; at the risk that
    cases are cut off at, what is observed beyond the expected are the spikes.
    """
    scored = _scored(readings, options)
    law = tails(scored, options).drop("readings")
    each = scored.filter("score is not null").join(law, ["source", "metric"]).withColumn("risk", F.explode(F.array(*map(F.lit, risks))))
    beyond = F.col("score") > F.col("threshold") + F.col("scale") / F.col("shape") * (F.pow(F.col("risk") / F.col("share"), -F.col("shape")) - 1)
    out = each.groupBy("metric", "risk").agg(F.count("*").alias("readings"), F.count_if(beyond).alias("observed"))
    return out.select("metric", "risk", "readings", (F.col("risk") * F.col("readings")).alias("expected"), "observed")
