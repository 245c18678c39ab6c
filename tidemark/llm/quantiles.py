"""Percentiles of very large columns by dyadic Count-sketches.

Values get order-preserving 16-bit codes. A sketch holds one signed Count-sketch for each binary
resolution of the codes: level l counts the first l bits. A level of up to WIDTH prefixes has a cell
for each (so it cannot err), a finer one DEPTH rows of WIDTH cells. Sketches are built from the rows
where they lie, one per group and task, and only sketches are shuffled; they are merged by adding
cells, and rows are deleted by adding them with weight -1. A percentile descends the levels from the
coarsest. While a sketch stands for at most SPARSE codes it is kept as those codes and their weights,
of which its cells are sums, as that is shorter.

Error: a percentile's value is within 0.28 % of a value whose rank differs from the asked one by
about `rank_error` of the rows at most: twice the standard error of the levels on the way, 0 for
sparse sketches. It is an estimate, not a bound; `rank_misses` measures the true one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.functions.ordering import BITS, STEPS, ZERO, log_code

DEPTH, WIDTH, SPARSE = 5, 1024, 512
#: Rows of cells of each level, and where they begin.
ROWS = [1 if 1 << lv <= WIDTH else DEPTH for lv in range(1, BITS + 1)]
SIZES = [min(1 << lv, WIDTH) for lv in range(1, BITS + 1)]
AT = np.r_[0, np.cumsum(np.array(ROWS) * np.array(SIZES))]
CELLS = int(AT[-1])
#: Codes and cells that a task keeps before it passes its sketches on (32 MB).
FLUSH = 4_000_000
#: Sketches of one group that one task adds up at most; more are added up in two steps.
FAN_IN = 512
_ODD = np.array([0x9E3779B97F4A7C15 + 2 * k * 0x632BE59BD9B4E019 & (2**64 - 1) | 1 for k in range(sum(ROWS))], "uint64")


def _hash(prefix: np.ndarray, row: int, size: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Cell and sign of each prefix in a row of cells; prefixes that all have room are only permuted."""
    h = (prefix.astype("uint64") + np.uint64(1)) * _ODD[row]
    cell = h % np.uint64(size)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return (cell if whole else h % np.uint64(size)).astype("int64"), np.where((h >> np.uint64(40)) & np.uint64(1), 1, -1)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code its cell and sign in every row of every level: one look-up instead of hashing."""
    codes = np.arange(1 << BITS)
    cell, sign = np.empty((sum(ROWS), 1 << BITS), "int32"), np.empty((sum(ROWS), 1 << BITS), "int8")
    row = 0
    for lv in range(1, BITS + 1):
        for r in range(ROWS[lv - 1]):
            c, s = _hash(codes >> (BITS - lv), row, SIZES[lv - 1], ROWS[lv - 1] == 1)
            cell[row], sign[row] = AT[lv - 1] + r * SIZES[lv - 1] + c, s
            row += 1
    return cell, sign


_CACHE: list = []


def tables() -> tuple[np.ndarray, np.ndarray]:
    """The look-up tables, made once per process."""
    if not _CACHE:
        _CACHE.extend(_tables())
    return _CACHE[0], _CACHE[1]


class Sketch:
    """A sketch under construction: codes with weights, or the cells of all levels."""

    def __init__(self) -> None:
        self.codes, self.weights, self.cells = np.empty(0, "int64"), np.empty(0, "int64"), None

    def size(self) -> int:
        return len(self.codes) if self.cells is None else CELLS

    def add(self, codes: np.ndarray, weights: np.ndarray) -> None:
        """Count codes (each once) with their weights."""
        if self.cells is None:
            both, at = np.unique(np.r_[self.codes, codes], return_inverse=True)
            sums = np.bincount(at, weights=np.r_[self.weights, weights], minlength=len(both)).astype("int64")
            self.codes, self.weights = both[sums != 0], sums[sums != 0]
            if len(self.codes) <= SPARSE:
                return
            codes, weights, self.cells = self.codes, self.weights, np.zeros(CELLS, "int64")
            self.codes = self.weights = np.empty(0, "int64")
        cell, sign = tables()
        self.cells += np.bincount(cell[:, codes].ravel(), weights=(sign[:, codes] * weights).ravel(), minlength=CELLS).astype("int64")

    def merge(self, packed: bytes) -> None:
        """Add another sketch, as packed by `pack`."""
        kind, n, data = packed[0], int.from_bytes(packed[1:5], "little"), packed[5:]
        if kind == 0:
            self.add(np.frombuffer(data, "<u2", n).astype("int64"), np.frombuffer(data, "<i8", n, 2 * n))
            return
        if self.cells is None:
            codes, weights = self.codes, self.weights
            self.cells, self.codes, self.weights = np.zeros(CELLS, "int64"), np.empty(0, "int64"), np.empty(0, "int64")
            if len(codes):
                self.add(codes, weights)
        self.cells[np.frombuffer(data, "<u2", n)] += np.frombuffer(data, "<i8", n, 2 * n)

    def pack(self) -> bytes:
        """Kind, number, then cells or codes that are not 0 and their weights."""
        at = self.codes if self.cells is None else np.flatnonzero(self.cells)
        weights = self.weights if self.cells is None else self.cells[at]
        return bytes([self.cells is not None]) + len(at).to_bytes(4, "little") + at.astype("<u2").tobytes() + weights.astype("<i8").tobytes()

    def total(self) -> int:
        if self.cells is None:
            return int(self.weights.sum())
        cell, sign = tables()
        both = [0, 1 << (BITS - 1)]
        return int((self.cells[cell[0, both]] * sign[0, both]).sum())

    def rank_error(self) -> float:
        """Twice the standard error of a rank, as a share of the rows.

        An estimate in a row has variance F2 / WIDTH, of which F2 is read off the row itself; the
        median of DEPTH rows and the sum over the levels give the deviation.
        """
        if self.cells is None:
            return 0.0
        fine = self.cells[int(AT[BITS - sum(r > 1 for r in ROWS)]) :].reshape(-1, DEPTH, WIDTH).astype("float64")
        f2 = np.median((fine**2).sum(axis=2), axis=1)
        return float(2 * np.sqrt((f2 / WIDTH).sum() * np.pi / (2 * DEPTH)) / max(self.total(), 1))

    def codes_at(self, probs: list[float]) -> list[int]:
        """Codes at the asked ranks, by descending the levels."""
        n = self.total()
        ranks = [min(n, max(1.0, np.ceil(p * n))) for p in probs]
        if self.cells is None:
            at = np.searchsorted(np.cumsum(self.weights), ranks, side="left")
            return self.codes[np.minimum(at, len(self.codes) - 1)].tolist()
        cell, sign = tables()
        out = []
        for rest in ranks:
            at, here, row = 0, float(n), 0
            for lv in range(1, BITS + 1):
                shift, rows = BITS - lv, slice(row, row + ROWS[lv - 1])
                row += ROWS[lv - 1]
                left, right = (max(0.0, float(np.median(self.cells[cell[rows, c << shift]] * sign[rows, c << shift]))) for c in (2 * at, 2 * at + 1))
                # the parent's count is known better than the children's: split it in their proportion
                left = here * left / (left + right) if left + right > 0 else here / 2
                if rest <= left:
                    at, here = 2 * at, left
                else:
                    at, here, rest = 2 * at + 1, here - left, rest - left
            out.append(at)
        return out


def decode(code: np.ndarray) -> np.ndarray:
    """Middle value of each code."""
    step = np.abs(np.asarray(code, "float64") - ZERO)
    size = np.where(step == 0, 0.0, np.exp2((step - 0.5) / STEPS - 128))
    return np.sign(np.asarray(code, "float64") - ZERO) * size


def _count(codes: np.ndarray, group: np.ndarray, groups: int, sign: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(group, codes, weights) of the codes of each group."""
    both, n = np.unique(group << BITS | codes, return_counts=True)
    ends = np.searchsorted(both, np.arange(1, groups + 1) << BITS)
    begin = 0
    for g, end in enumerate(ends.tolist()):
        if end > begin:
            yield g, both[begin:end] & (1 << BITS) - 1, n[begin:end] * sign
        begin = end


def encode(df: DataFrame, keys: list[str], columns: list[str], sign: int = 1, scopes: list[str] | None = None) -> DataFrame:
    """(keys, metric, sketch): the rows of each task as one sketch per group and column.

    sign -1 deletes the rows from a sketch they are merged with. Null and NaN values are no part of
    a column; null keys form a group of their own. With scopes, keys are (scope, grp) and each row
    counts in one group per named column, in one pass; grp is the column's value as text.
    """
    sets = [(s, [s]) for s in scopes] if scopes else [(None, keys)]
    used = list(dict.fromkeys(k for _, ks in sets for k in ks))
    named = {f"code_{i}": c for i, c in enumerate(columns)}
    text = [F.col(k).cast("string").alias(k) if scopes else F.col(k) for k in used]
    rows = df.select(*text, *(log_code(F.col(c).cast("double")).alias(n) for n, c in named.items()))
    head = df.select(F.lit("").alias("scope"), F.lit(None).cast("string").alias("grp")).schema if scopes else df.select(*keys).schema
    schema = df.sparkSession.createDataFrame([], head).select("*", F.lit("").alias("metric"), F.lit(b"").alias("sketch")).schema
    arrow, fields = to_arrow_schema(schema), [f.name for f in head.fields]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Sketch] = {}
        size = 0

        def passed() -> pa.RecordBatch:
            columns_ = [[k[i] for k in held] for i in range(len(fields) + 1)] + [[s.pack() for s in held.values()]]
            return pa.RecordBatch.from_arrays([pa.array(c, arrow.field(i).type) for i, c in enumerate(columns_)], schema=arrow)

        for batch in batches:
            for scope, names in sets:
                group, firsts = np.zeros(batch.num_rows, "int64"), np.zeros(1, "int64")
                for name in names:
                    ids = batch.column(name).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype("int64") + 1
                    _, firsts, group = np.unique(group * (ids.max(initial=0) + 1) + ids, return_index=True, return_inverse=True)
                tops = [tuple(batch.column(n)[i].as_py() for n in names) for i in firsts.tolist()] if batch.num_rows else []
                for code, metric in named.items():
                    column = batch.column(code)
                    there = column.is_valid().to_numpy(zero_copy_only=False)
                    codes = column.drop_null().to_numpy(zero_copy_only=False).astype("int64")
                    for g, c, w in _count(codes, group[there], len(tops), sign):
                        key = ((scope, *tops[g]) if scope else tops[g]) + (metric,)
                        sketch = held.get(key)
                        if sketch is None:
                            sketch = held[key] = Sketch()
                        size -= sketch.size()
                        sketch.add(c, w)
                        size += sketch.size()
            if size > FLUSH:
                yield passed()
                held, size = {}, 0
        if held:
            yield passed()

    return rows.mapInArrow(build, schema)


def _added(parts: DataFrame, keys: list[str], extra: list[str]) -> DataFrame:
    """Sketches of equal keys and extra columns added up, one at a time, by whichever task has the group."""
    by = [*keys, "metric", *extra]
    marked = parts.select(*keys, "metric", *extra, "sketch", F.to_json(F.struct(*by), {"ignoreNullFields": "false"}).alias("group_"))
    schema = parts.select(*keys, "metric", *extra, "sketch").schema
    arrow = to_arrow_schema(schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sketch, head = None, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*head, pa.array([sketch.pack()], pa.binary())], schema=arrow)

        for batch in batches:
            ready = []
            for i, (group, packed) in enumerate(zip(batch.column("group_").to_pylist(), batch.column("sketch").to_pylist())):
                if group != last:
                    if sketch is not None:
                        ready.append(done())
                    last, sketch, head = group, Sketch(), [batch.column(c).slice(i, 1) for c in by]
                sketch.merge(packed)
            if ready:
                yield pa.Table.from_batches(ready, arrow).combine_chunks().to_batches()[0]
        if sketch is not None:
            yield done()

    return marked.repartition("group_").sortWithinPartitions("group_").mapInArrow(add, schema)


def add_up(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, sketch): one sketch per group of rows (keys, metric, sketch), as the sum of theirs.

    A sketch has at most CELLS cells however many rows it stands for. A group in very many parts is
    added up in two steps, so that no task has more than FAN_IN of them.
    """
    spark = parts.sparkSession
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    tasks = int(str(parts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // split
    if tasks > FAN_IN:
        salted = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(-(-tasks // FAN_IN))))
        parts = _added(salted, keys, ["salt"]).drop("salt")
    return _added(parts, keys, [])


def sketches(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, metric, sketch): one sketch per group and column."""
    return add_up(encode(df, keys, columns), keys)


def merge(sketched: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of finer groups, days or files combined per keys, by adding cells; no rows are read again."""
    return add_up(sketched.select(*keys, "metric", "sketch"), keys)


def percentiles(sketched: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """(keys, metric, n, rank_error, one column per prob: p50, p95 ..) of sketches.

    Values are the nearest-rank percentiles. A group whose rows were all deleted has no row.
    """
    names = [f"p{100 * p:g}".replace(".", "_") for p in probs]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, kept = [], []
            for i, packed in enumerate(batch.column("sketch").to_pylist()):
                sketch = Sketch()
                sketch.merge(packed)
                n = sketch.total()
                if n > 0:
                    kept.append(i)
                    found.append((n, sketch.rank_error(), *decode(np.array(sketch.codes_at(probs))).tolist()))
            head = batch.take(pa.array(kept, pa.int64()))
            columns = [pa.array([f[k] for f in found], pa.int64() if k == 0 else pa.float64()) for k in range(len(names) + 2)]
            yield pa.RecordBatch.from_arrays([*(head.column(c) for c in (*keys, "metric")), *columns], schema=arrow)

    doubles = [F.lit(0.0).alias(x) for x in ("rank_error", *names)]
    schema = sketched.select(*keys, "metric", F.lit(0).cast("long").alias("n"), *doubles).schema
    arrow = to_arrow_schema(schema)
    return sketched.mapInArrow(ask, schema)


def rank_misses(df: DataFrame, asked: DataFrame, keys: list[str], columns: list[str], probs: list[float]) -> DataFrame:
    """(keys, metric, n, miss, rank_error, within): how far the ranks of percentiles are from those asked for, counted exactly over the rows.

    A value stands for all values within half a code of it. `within` says that the largest miss of
    a group's percentiles, as a share of its rows, is at most rank_error.
    """
    each = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns))
    long = df.select(*keys, F.inline(each)).filter("value is not null and not isnan(value)")
    names = [f"p{100 * p:g}".replace(".", "_") for p in probs]
    told = asked.select(*(F.col(k).alias(f"of_{k}") for k in keys), F.col("metric").alias("of_metric"), F.col("n").alias("told"), "rank_error", *names)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    rows = long.join(told, same & (F.col("metric") == F.col("of_metric")))
    near = 2 ** (1 / STEPS) - 1
    counts = []
    for c in names:
        low, high = F.col(c) - F.abs(c) * near, F.col(c) + F.abs(c) * near
        counts += [F.count_if(F.col("value") < low).alias(f"under_{c}"), F.count_if(F.col("value") <= high).alias(f"upto_{c}")]
    summed = rows.groupBy(*keys, "metric").agg(F.count("*").alias("n"), F.first("told").alias("told"), F.first("rank_error").alias("rank_error"), *counts)
    misses = [F.greatest(F.lit(0.0), F.col(f"under_{c}") + 1 - F.ceil(F.lit(p) * F.col("n")), F.ceil(F.lit(p) * F.col("n")) - F.col(f"upto_{c}")) / F.col("n") for c, p in zip(names, probs)]
    miss = F.greatest(*misses) if len(misses) > 1 else misses[0]
    return summed.select(*keys, "metric", "n", miss.alias("miss"), "rank_error", ((F.col("n") == F.col("told")) & (miss <= F.col("rank_error"))).alias("within"))
