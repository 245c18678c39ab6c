"""Line diffs, line statistics, corrected identifiers and line survival."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lines_of(text: str) -> list[str]:
    """The lines of a text, cut at line feeds only; a last line feed opens no further line."""
    found = text.split("\n")
    if found[-1] == "":
        found.pop()
    return found


def line_runs(before: str, after: str) -> list[tuple[str, int, int, int]]:
    """(op, lines, old start, new start) runs of equal, delete and insert; a delete comes before the insert that replaces it."""
    a, b = lines_of(before), lines_of(after)
    # what both begin and end with needs no comparison
    head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    tail = next((i for i, (x, y) in enumerate(zip(reversed(a[head:]), reversed(b[head:]))) if x != y), min(len(a), len(b)) - head)
    out = [("equal", head, 0, 0)] if head else []
    middle = difflib.SequenceMatcher(None, a[head : len(a) - tail], b[head : len(b) - tail], autojunk=False)
    for tag, i1, i2, j1, j2 in middle.get_opcodes():
        i1, i2, j1, j2 = i1 + head, i2 + head, j1 + head, j2 + head
        if tag == "equal":
            out.append(("equal", i2 - i1, i1, j1))
            continue
        if i2 > i1:
            out.append(("delete", i2 - i1, i1, j1))
        if j2 > j1:
            out.append(("insert", j2 - j1, i2, j1))
    if tail:
        out.append(("equal", tail, len(a) - tail, len(b) - tail))
    return out


def hunks(changes: DataFrame, key: str = "change_id", before: str = "before_text", after: str = "after_text") -> DataFrame:
    """(key, seq, op, n, old_start, new_start) of modified text pairs; equal texts, binary and one-sided changes give no rows."""
    usable = changes.filter(F.col(before).isNotNull() & F.col(after).isNotNull() & (F.col(before) != F.col(after)))
    usable = usable.filter((F.locate("\0", F.substring(before, 1, 8000)) == 0) & (F.locate("\0", F.substring(after, 1, 8000)) == 0))

    def diff(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, *r) for k, b, a in zip(batch[key], batch[before], batch[after]) for i, r in enumerate(line_runs(b, a))]
            yield pd.DataFrame(rows, columns=[key, "seq", "op", "n", "old_start", "new_start"])

    kind = changes.schema[key].dataType.simpleString()
    return usable.select(key, before, after).mapInPandas(diff, f"{key} {kind}, seq long, op string, n long, old_start long, new_start long")


def line_stats(runs: DataFrame, key: str = "change_id") -> DataFrame:
    """(key, added, removed, changed): a delete next to an insert changes the smaller number of lines, the rest is added or removed."""
    order = Window.partitionBy(key).orderBy("seq")
    with_next = runs.select(key, "op", "n", F.lead("op").over(order).alias("next_op"), F.lead("n").over(order).alias("next_n"), F.lag("op").over(order).alias("prev_op"), F.lag("n").over(order).alias("prev_n"))
    paired = F.when((F.col("op") == "delete") & (F.col("next_op") == "insert"), F.least("n", "next_n")).otherwise(F.lit(0))
    removed = F.when(F.col("op") == "delete", F.col("n") - paired).otherwise(0)
    kept = F.when((F.col("op") == "insert") & (F.col("prev_op") == "delete"), F.greatest(F.col("n") - F.col("prev_n"), F.lit(0))).when(F.col("op") == "insert", F.col("n")).otherwise(0)
    return with_next.groupBy(key).agg(F.sum(kept).alias("added"), F.sum(removed).alias("removed"), F.sum(paired).alias("changed"))


def touched_ranges(runs: DataFrame, ranges: DataFrame, key: str = "change_id", bucket: int = 64) -> DataFrame:
    """(key, name) of the ranges (key, name, start, stop) that an insert or delete meets, lines from 0, stop inclusive.

    An interval join by buckets of lines: both sides are cut into buckets, met on equality and
    checked exactly, so no pair of rows is compared that is not near.
    """
    edits = runs.filter("op <> 'equal'").select(key, F.when(F.col("op") == "delete", F.col("old_start")).otherwise(F.col("new_start")).alias("lo"), "n")
    edits = edits.withColumn("hi", F.col("lo") + F.col("n") - 1)
    cut = lambda lo, hi: F.explode(F.sequence(F.floor(lo / bucket), F.floor(hi / bucket)))
    left = edits.withColumn("b", cut(F.col("lo"), F.col("hi")))
    right = ranges.withColumn("b", cut(F.col("start"), F.col("stop")))
    return left.join(right, [key, "b"]).filter((F.col("lo") <= F.col("stop")) & (F.col("hi") >= F.col("start"))).select(key, "name").distinct()


def corrected_identifiers(changes: DataFrame, runs: DataFrame, key: str = "change_id", most: int = 4) -> DataFrame:
    """(key, wrong, correct, line): identifiers put right between a deleted line and the inserted line that replaces it.

    Blocks of equal size are paired line by line; lines within `most` edits that differ in exactly
    one identifier count.
    """
    order = Window.partitionBy(key).orderBy("seq")
    blocks = runs.withColumn("next_op", F.lead("op").over(order)).withColumn("next_n", F.lead("n").over(order)).withColumn("to", F.lead("new_start").over(order))
    blocks = blocks.filter("op = 'delete' and next_op = 'insert' and n = next_n").select(key, "old_start", "to", "n")
    lines = changes.select(key, F.split(F.regexp_replace("before_text", "\r", ""), "\n").alias("old"), F.split(F.regexp_replace("after_text", "\r", ""), "\n").alias("new"))
    each = blocks.join(lines, key).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    pairs = each.select(key, F.expr("try_element_at(old, cast(old_start + k + 1 as int))").alias("a"), F.expr("try_element_at(new, cast(to + k + 1 as int))").alias("b"), (F.col("to") + F.col("k")).alias("line"))
    pairs = pairs.filter(F.levenshtein("a", "b", most) > 0)
    words = lambda c: F.regexp_extract_all(F.col(c), F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))
    only = pairs.withColumn("x", F.array_except(words("a"), words("b"))).withColumn("y", F.array_except(words("b"), words("a")))
    return only.filter((F.size("x") == 1) & (F.size("y") == 1)).select(key, F.col("x")[0].alias("wrong"), F.col("y")[0].alias("correct"), "line")


def replay(segments: list[list[int]], edits: list[tuple[str, int]], tick: int, author: int) -> list[tuple[int, int, int, int, int]]:
    """Apply a change's runs to a file's [lines, tick, author] segments; returns (tick, author, written tick, written by, lines) of each gain and loss."""
    out, at, ledger = [], 0, []
    rest = [s[:] for s in segments]

    def take(n: int) -> list[list[int]]:
        nonlocal at
        got = []
        while n > 0 and at < len(rest):
            s = rest[at]
            k = min(n, s[0])
            got.append([k, s[1], s[2]])
            s[0] -= k
            n -= k
            if s[0] == 0:
                at += 1
        return got

    for op, n in edits:
        if op == "equal":
            out += take(n)
        elif op == "delete":
            ledger += [(tick, author, t, w, -k) for k, t, w in take(n)]
        else:
            out.append([n, tick, author])
            ledger.append((tick, author, tick, author, n))
    out += take(sum(s[0] for s in rest[at:]))
    merged: list[list[int]] = []
    for s in out:
        if merged and merged[-1][1:] == s[1:]:
            merged[-1][0] += s[0]
        else:
            merged.append(s)
    segments[:] = merged
    return ledger


#: Tick and author of lines written before the history begins.
UNSEEN = (-1, -1)


def line_ledger(edits: DataFrame) -> DataFrame:
    """(lineage, path, cur_tick, author_id, orig_tick, orig_author, delta, moved): who wrote and who removed which lines, and when.

    edits: (lineage, idx, tick, author_id, kind, runs array<struct<op, n>>) and, where files are renamed,
    from_path and to_path; one row per change. A lineage holds all paths that renames link, and each
    keeps its own lines. An insert starts anew, a delete removes every line left, a rename moves
    them: rows with `moved` take them from the one path and give them to the other. Lines that stood
    before a path's first change keep their places but are never counted, as nobody is known to
    have written them. A lineage is replayed in order by one task, with its segments as the only
    state; sums over the ledger need no further order.
    """
    for name in ("from_path", "to_path"):
        if name not in edits.columns:
            edits = edits.withColumn(name, F.lit(None).cast("string"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lineage, files = None, {}
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                if r.lineage != lineage:
                    lineage, files = r.lineage, {}
                tick, author = int(r.tick), int(r.author_id)
                path, old = r.to_path if r.to_path is not None else r.from_path, r.from_path
                if old is not None and old != path and old in files:
                    segments = files.setdefault(path, [])
                    segments[:] = files.pop(old)
                    for n, t, w in segments:
                        if (t, w) != UNSEEN:
                            rows += [(r.lineage, old, tick, author, t, w, -n, True), (r.lineage, path, tick, author, t, w, n, True)]
                segments = files.setdefault(path, [])
                runs = [(x["op"], int(x["n"])) for x in r.runs] if r.runs is not None else []
                left = []
                if r.kind == "insert":
                    # a file that is born again loses what it still had
                    left = replay(segments, [("delete", sum(s[0] for s in segments))], tick, author)
                elif r.kind == "delete":
                    runs = [("delete", sum(s[0] for s in segments))]
                elif not segments and (before := sum(n for op, n in runs if op != "insert")):
                    segments.append([before, *UNSEEN])
                rows += [(r.lineage, path, *x, False) for x in left + replay(segments, runs, tick, author) if x[2:4] != UNSEEN]
            yield pd.DataFrame(rows, columns=["lineage", "path", "cur_tick", "author_id", "orig_tick", "orig_author", "delta", "moved"])

    # a lineage is in one partition, its changes in order, and its segments go on from batch to batch
    ordered = edits.select("lineage", "idx", "tick", "author_id", "kind", "from_path", "to_path", "runs").repartition("lineage").sortWithinPartitions("lineage", "idx")
    return ordered.mapInPandas(run, "lineage string, path string, cur_tick long, author_id long, orig_tick long, orig_author long, delta long, moved boolean")
