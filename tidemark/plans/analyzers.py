"""Analyses by id: selection by glob, and the contract for one's own."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame


class Analyzer(Protocol):
    """An analysis is a pure function of tables; Catalyst aggregates in part and in full, so there is nothing to merge by hand."""

    id: str

    def run(self, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Named results, lazily."""


@dataclass(frozen=True)
class Options:
    """Defaults of the analyses."""

    tick_hours: int = 24
    anomaly_threshold: float = 2.0
    anomaly_window: int = 20
    band_ticks: int = 30
    sample_ticks: int = 30
    largest_change_set: int = 1000
    high_coupling: int = 10
    active_days: int = 90
    bus_factor_share: float = 0.5
    comment_least: int = 20
    letters_share: float = 0.6
    typo_edits: int = 4
    import_bytes: int = 1 << 20
    skip_prefixes: tuple[str, ...] = field(default=("vendor/", "vendors/"))

    def __post_init__(self) -> None:
        if self.anomaly_threshold < 0.1 or self.anomaly_window < 2:
            raise ValueError("the anomaly threshold is at least 0.1 and its window at least 2")


def kebab(name: str) -> str:
    """An id from a name in camel case."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "-", name).lower().replace("_", "-")


def select(patterns: Iterable[str], ids: Iterable[str]) -> list[str]:
    """Ids that match the patterns, in the patterns' order, each once; an unknown plain id is an error."""
    known, out = list(ids), []
    for p in patterns:
        hits = [i for i in known if fnmatch.fnmatchcase(i, p)] if re.search(r"[*?\[]", p) else [p]
        for h in hits:
            if h not in known:
                raise ValueError(f"unknown analysis: {h}")
            if h not in out:
                out.append(h)
    return out


def trailing_z(series: DataFrame, keys: list[str], order: str, value: str, window: int = 20) -> DataFrame:
    """series with `z`: see the anomaly plans; for series of one's own."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-window, -1)
    mean, sd, x = F.avg(value).over(w), F.stddev_pop(value).over(w), F.col(value)
    flat = F.when(F.abs(x - mean) < 1e-9, 0.0).when(x > mean, 100.0).otherwise(-100.0)
    return series.withColumn("z", F.when(mean.isNull(), 0.0).when(sd < 1e-9, flat).otherwise((x - mean) / sd))


EXTRACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def extractor(source: str) -> Callable[[Callable[[DataFrame], DataFrame]], Callable[[DataFrame], DataFrame]]:
    """Registers a function that turns a result into (dimension, tick, value) rows for anomaly detection."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        EXTRACTORS[source] = f
        return f

    return add
