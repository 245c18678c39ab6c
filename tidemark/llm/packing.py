"""Filling containers of a fixed number of tokens with whole documents.

Pattern packing: sizes are counted per bin, patterns of bins that fill a container are repeated as
often as non-negative least squares on the histogram, weighted by size, says, and what remains is
packed best fit, into the room that patterns leave first. Patterns are all of up to three bins, those of one bin many times, and those that
greedy filling makes of the histogram itself.
The plan is made from the histogram, which has at most `capacity` entries however many documents
there are; documents find their slot by their number among the documents of their size.
"""

from __future__ import annotations

import base64
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import settle

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits a text into the pieces that byte-level BPE works on; the fixed pattern of the vocabulary.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counts(df: DataFrame, key: str, text: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, n_tokens): length of each whole text in tokens; 0 for null and empty texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(vocabulary, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        encoding = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch[text]]
            yield pd.DataFrame({key: batch[key], "n_tokens": np.array(sizes, "int64")})

    return df.select(key, text).mapInPandas(count, df.select(key, F.lit(0).cast("long").alias("n_tokens")).schema)


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method; warns if it does not get there in three rounds a column."""
    n = a.shape[1]
    rounds = 3 * n + 10
    x, passive = np.zeros(n), np.zeros(n, bool)
    gram, right = None, a.T @ b
    for _ in range(rounds):
        slope = right - a.T @ (a @ x)
        slope[passive] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= 1e-8 * max(1.0, float(np.abs(b).max(initial=0))):
            break
        passive[best] = True
        while True:
            held = np.flatnonzero(passive)
            part = a[:, held]
            gram = part.T @ part
            z = np.linalg.lstsq(gram + 1e-9 * np.eye(len(held)), right[held], rcond=None)[0]
            if (z > 1e-10).all():
                x[:] = 0
                x[held] = z
                break
            low = z <= 1e-10
            step = float(np.min(x[held][low] / np.maximum(x[held][low] - z[low], 1e-12)))
            x[held] += step * (z - x[held])
            passive[held[low & (x[held] <= 1e-9)]] = False
            x[~passive] = 0
            if not passive.any():
                break
    else:
        warnings.warn("least squares of container patterns ended before they converged", stacklevel=2)
    return x


def greedy_patterns(have: np.ndarray, room: int) -> list[tuple[int, ...]]:
    """The patterns of filling container after container with the largest bins that fit; each is repeated while it can, so they are few."""
    left, found = have[: room + 1].astype("int64").copy(), []
    while left[1:].any():
        space, pattern = room, []
        for b in np.flatnonzero(left[1:])[::-1] + 1:
            t = int(min(left[b], space // b))
            if t:
                pattern.append((int(b), t))
                space -= int(b) * t
        again = min(int(left[b]) // t for b, t in pattern)
        for b, t in pattern:
            left[b] -= again * t
        found.append(tuple(b for b, t in pattern for _ in range(t)))
    return found


#: Share of all tokens, in the smallest items, that is kept back from patterns.
FILLERS = 0.1


@dataclass
class Plan:
    """Slots sorted by size and number: documents lo.. of `size` go to container first + (number - lo) // per."""

    size: np.ndarray
    lo: np.ndarray
    first: np.ndarray
    per: np.ndarray
    containers: int
    by_pattern: int


def plan_packing(counts: dict[int, int], capacity: int, bins: int = 128) -> Plan:
    """A slot for each of counts[size] items of each size 1..capacity.

    A bin is capacity / bins tokens; an item's bin is its size rounded up.
    A pattern's slots of a bin are given to that bin's items from the largest size downwards.
    """
    left = {s: c for s, c in counts.items() if c and 0 < s <= capacity}
    start = dict.fromkeys(left, 0)
    slots: list[tuple[int, int, int, int]] = []
    made = 0
    width = max(1, -(-capacity // bins))
    room = capacity // width
    by_bin: dict[int, list[int]] = {}
    # the smallest items are kept back for the room that rounding to bins leaves
    back, least = FILLERS * sum(s * c for s, c in left.items()), 0
    for s in sorted(left):
        back -= s * left[s]
        if back < 0:
            break
        least = s
    for s in sorted((s for s in left if s > least), reverse=True):
        by_bin.setdefault(-(-s // width), []).append(s)
    turns: dict[int, int] = {}
    have = np.zeros(room + 2)
    for b, sizes in by_bin.items():
        have[min(b, room + 1)] = sum(left[s] for s in sizes)
    full = [(room,)] + [(room - j, j) for j in range(1, room // 2 + 1)]
    full += [(room - j - k, j, k) for k in range(1, room // 3 + 1) for j in range(k, (room - k) // 2 + 1)]
    full += [tuple(x for x in (room - m * j, *[j] * m) if x) for j in range(1, room // 3 + 1) for m in range(3, room // j + 1)]
    full = list(dict.fromkeys([*greedy_patterns(have, room), *(p for p in full if all(have[b] > 0 for b in p))]))
    if full:
        a = np.zeros((room + 2, len(full)))
        for i, p in enumerate(full):
            for b in p:
                a[b, i] += 1
        # a missing large item is as bad as the small ones of its size
        weight = np.arange(room + 2) / room
        repeats = np.floor(nonnegative_least_squares(a * weight[:, None], have * weight) + 1e-6).astype("int64")

        def take(b: int, n: int, first: int) -> None:
            while n:
                s = by_bin[b][0]
                t = min(n, left[s])
                if t:
                    slots.append((s, start[s], first, 1))
                    turns[first] = turns.get(first, 0) + s
                    turns[first + t] = turns.get(first + t, 0) - s
                    start[s] += t
                    left[s] -= t
                    n, first = n - t, first + t
                if not left[s]:
                    by_bin[b].pop(0)

        stock = have.astype("int64")
        for i in np.argsort(-repeats, kind="stable"):
            p = full[i]
            n = int(min([repeats[i], *(stock[b] // p.count(b) for b in set(p))]))
            if n > 0:
                for b in p:
                    take(b, n, made)
                    stock[b] -= n
                made += n
    by_pattern = made
    # best fit, largest first, on runs of containers with the same free room
    spare: dict[int, list[tuple[int, int]]] = {}
    # runs of pattern containers that are equally full
    full_to, places = 0, sorted(turns)
    for at, after in zip(places, [*places[1:], made]):
        full_to += turns[at]
        if after > at and full_to < capacity:
            spare.setdefault(capacity - full_to, []).append((at, after - at))
    for s in sorted((s for s in left if left[s]), reverse=True):
        c = left[s]
        while c:
            fits = [f for f in spare if f >= s]
            f = min(fits) if fits else capacity
            if fits:
                first, m = spare[f].pop()
                if not spare[f]:
                    del spare[f]
            else:
                first, m = made, -(-c // (capacity // s))
                made += m
            per = min(f // s, -(-c // m))
            used = min(m, c // per) if c >= per else 0
            if used == 0:
                per, used = c, 1
            slots.append((s, start[s], first, per))
            start[s] += used * per
            c -= used * per
            if m > used:
                spare.setdefault(f, []).append((first + used, m - used))
            if f - per * s > 0:
                spare.setdefault(f - per * s, []).append((first, used))
    slots.sort()
    table = np.array(slots, "int64").reshape(-1, 4)
    return Plan(table[:, 0], table[:, 1], table[:, 2], table[:, 3], made, by_pattern)


def numbered_by_size(df: DataFrame, key: str, shards: int = 64) -> DataFrame:
    """df (key, piece, size) with `number`: 0, 1, ... among the rows of a size.

    A size that holds a third of all rows is numbered in shards by the key's hash; the shards'
    offsets come from counts, of which there are at most sizes x shards.
    """
    rows = df.withColumn("shard", F.pmod(F.xxhash64(key, "piece"), F.lit(shards)))
    counts = rows.groupBy("size", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("size").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("size", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("size", "shard").orderBy(F.col(key), F.col("piece"))
    ranked = rows.withColumn("at", F.row_number().over(inside) - 1)
    return ranked.join(offsets, ["size", "shard"]).withColumn("number", F.col("at") + F.col("offset")).drop("shard", "at", "offset")


def pack(sizes: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, piece, n_tokens, container_id, container_free, by_pattern) for items (key, size), key unique.

    Items are whole (piece 0) unless larger than the capacity: those fill containers of their own
    with pieces of full capacity, and the last piece is packed like an item. Items of size 0 or null
    take no room and stand in container 0. Every item is in the result; equal sizes are told apart by
    key. container_free is the unused room; by_pattern says whether a pattern fills the container, or what was left over. An empty table gives no rows.
    """
    asked = F.coalesce(F.col(size), F.lit(0)).cast("long")
    pieces = F.greatest(F.lit(1).cast("long"), F.ceil(asked / capacity))
    rows = sizes.select(F.col(key), asked.alias("whole"), pieces.alias("pieces"))
    rows = rows.select(key, "whole", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"))
    rows = settle(rows.select(key, "piece", F.least(F.lit(capacity).cast("long"), F.col("whole") - F.col("piece") * capacity).alias("size")))
    # at most `capacity` + 1 rows come to the driver, whatever the number of documents
    counts = {r["size"]: r["n"] for r in rows.groupBy("size").agg(F.count("*").alias("n")).collect()}
    plan = plan_packing(counts, capacity)
    n = max(1, len(plan.size))
    keys = plan.size * (1 << 40) + plan.lo

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            s, number = batch["size"].to_numpy("int64"), batch["number"].to_numpy("int64")
            at = np.clip(np.searchsorted(keys, s * (1 << 40) + number, side="right") - 1, 0, n - 1)
            where = plan.first[at] + (number - plan.lo[at]) // plan.per[at] if len(plan.size) else np.zeros(len(s), "int64")
            yield pd.DataFrame({key: batch[key], "piece": batch["piece"], "n_tokens": s, "container_id": np.where(s > 0, where, 0)})

    numbered = numbered_by_size(rows, key)
    out = numbered.select(key, "piece", F.col("size").alias("n_tokens"), F.lit(0).cast("long").alias("container_id")).schema
    placed = settle(numbered.mapInPandas(place, out))
    filled = placed.groupBy("container_id").agg((F.lit(capacity) - F.sum("n_tokens")).alias("container_free"))
    return placed.join(filled, "container_id").select(key, "piece", "n_tokens", "container_id", "container_free", (F.col("container_id") < plan.by_pattern).alias("by_pattern"))
