"""Ticks of a stream of commits: late commits move forward to the current tick, none is dropped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def monotone_ticks(stream: DataFrame, key: str, order: str, seconds: str, size: int = 86_400) -> DataFrame:
    """(key, order, tick) of rows (key, order, seconds): the tick never falls within a key, in order of arrival.

    The state per key is the first tick and the highest so far. A watermark would drop what is late;
    the reference semantics keep it.
    """
    kind = stream.schema[key].dataType.simpleString()

    def advance(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, top = state.get if state.exists else (None, 0)
        for batch in batches:
            batch = batch.sort_values(order)
            ticks = []
            for s in batch[seconds]:
                raw = int(s // size)
                first = raw if first is None else first
                top = max(top, raw - first)
                ticks.append(top)
            yield pd.DataFrame({key: batch[key], order: batch[order], "tick": ticks})
        state.update((first if first is not None else 0, top))

    return stream.select(key, order, seconds).groupBy(key).applyInPandasWithState(advance, f"{key} {kind}, {order} long, tick long", "first long, top long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, time: str, by: str, late: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """(start, by, n): rows per tumbling window, with a watermark for windows that may close."""
    timed = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", size).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def to_ndjson(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """One JSON line per row, appended as batches complete; restarts go on from the checkpoint."""
    return stream.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
