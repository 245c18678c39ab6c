"""Plans declared once as SQL and run by Catalyst; the same declaration in another dialect is their check.

A declaration uses a few macros where dialects differ: EXPLODE(array) in a select list, MICROS(ts),
PCT(x, p) for the exact interpolated percentile, RE(x, pattern) for a search COUNTIF(c), TAIL(x, sep) for the part after the
last separator.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "repositories developers bus_factor commits tick_metrics file_quality function_metrics file_changes documents eval_items nicknames region nation customer supplier part orders lineitem events embeddings".split()
_SOURCE = re.compile(r"\b(FROM|JOIN)\s+(" + "|".join(TABLES) + r")\b")
_MACROS = {
    "spark": {"EXPLODE": "explode({0})", "MICROS": "unix_micros(cast({0} as timestamp))", "PCT": "percentile({0}, {1})", "COUNTIF": "count_if({0})", "string_split": "split({0}, {1})", "RANGE5": "sequence(0, 4)", "RE": "{0} rlike {1}", "TAIL": "substring_index({0}, {1}, -1)"},
    "other": {"EXPLODE": "unnest({0})", "MICROS": "epoch_us({0})", "PCT": "quantile_cont({0}, {1})", "COUNTIF": "cast(count_if({0}) as bigint)", "RANGE5": "[0, 1, 2, 3, 4]", "RE": "regexp_matches({0}, {1})", "TAIL": "split_part({0}, {1}, -1)"},
}


def _arguments(text: str, start: int) -> tuple[list[str], int]:
    """The arguments of a call whose '(' is at start, and the place behind its ')'."""
    depth, parts, last, quoted = 0, [], start + 1, False
    for at in range(start, len(text)):
        ch = text[at]
        if ch == "'":
            quoted = not quoted
        elif not quoted and ch == "(":
            depth += 1
        elif not quoted and ch == ")":
            depth -= 1
            if depth == 0:
                return [*parts, text[last:at].strip()], at + 1
        elif not quoted and ch == "," and depth == 1:
            parts.append(text[last:at].strip())
            last = at + 1
    raise ValueError("unbalanced call")


def expand(text: str, dialect: str) -> str:
    """The declaration with its macros written out for a dialect."""
    for name, form in _MACROS[dialect].items():
        while m := re.search(rf"\b{name}\(", text):
            found, end = _arguments(text, m.end() - 1)
            text = text[: m.start()] + form.format(*found) + text[end:]
    return text


def runner(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query over a folder's tables: each table is read where it is named, so pruning and filters reach its scan."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        if "RECURSIVE" in text:
            # chains end by themselves; neither their length nor their number is cut off
            spark.conf.set("spark.sql.cteRecursionLevelLimit", "-1")
            spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
        return spark.sql(_SOURCE.sub(lambda m: f"{m[1]} parquet.`{folder}/{m[2]}.parquet`", expand(text, "spark")))

    return run


def register(plans: dict[str, str]) -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """(queries, their SQL) of declarations by name."""
    return {k: runner(v) for k, v in plans.items()}, {k: expand(v, "other") for k, v in plans.items()}
