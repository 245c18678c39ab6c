"""Folders of sources, people files and saved reports in, reports out."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value of the envelope format.
MAGIC = b"CFB1"


def scan_folder(spark: SparkSession, folder: str, extensions: Iterable[str]) -> DataFrame:
    """(path, content, length) of a folder's files with the given extensions, without .git."""
    pattern = r"\.(" + "|".join(e.lstrip(".") for e in extensions) + ")$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.filter(F.col("path").rlike(pattern) & ~F.col("path").contains("/.git/")).select("path", "content", "length")


def people_file(spark: SparkSession, path: str) -> DataFrame:
    """(person, alias) of a text file of lines 'canonical|alias|alias'; ids follow the lines."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parts = lines.select(F.split(F.lower("value"), r"\|").alias("a"))
    return parts.select(F.trim(F.col("a")[0]).alias("person"), F.explode("a").alias("alias")).select("person", F.trim("alias").alias("alias"))


def write_envelopes(reports: Iterable[dict], target: Path) -> None:
    """Reports as envelopes one after another: magic, length as unsigned 32-bit little-endian, JSON."""
    with target.open("wb") as out:
        for report in reports:
            body = json.dumps(report, separators=(",", ":")).encode()
            out.write(MAGIC + struct.pack("<I", len(body)) + body)


def read_report(path: Path) -> list[dict]:
    """Reports of a file in envelopes, as one JSON model or as lines of JSON."""
    raw = path.read_bytes()
    if raw.startswith(MAGIC):
        out, at = [], 0
        while at < len(raw):
            if raw[at : at + 4] != MAGIC:
                raise ValueError(f"no envelope at {at}")
            (n,) = struct.unpack_from("<I", raw, at + 4)
            out.append(json.loads(raw[at + 8 : at + 8 + n]))
            at += 8 + n
        return out
    text = raw.decode()
    try:
        return [json.loads(text)]
    except json.JSONDecodeError:
        return [json.loads(line) for line in text.splitlines() if line.strip()]


def to_yaml(value: object, indent: int = 0) -> str:
    """Plain YAML of nested dicts, lists and scalars."""
    pad = "  " * indent
    if isinstance(value, dict):
        if not value:
            return "{}"
        return "".join(f"\n{pad}{k}:{_after(v, indent)}" for k, v in value.items())
    if isinstance(value, list):
        return "".join(f"\n{pad}-{_after(v, indent)}" for v in value) if value else "[]"
    return json.dumps(value)


def _after(value: object, indent: int) -> str:
    text = to_yaml(value, indent + 1)
    return text if text.startswith("\n") else f" {text}"


def unified_model(reports: dict[str, DataFrame], mode: str) -> DataFrame:
    """(version, id, mode, report): each analysis as lines of JSON that a converter can read again."""
    parts = [df.select(F.lit("tidemark.run.v1").alias("version"), F.lit(k).alias("id"), F.lit(mode).alias("mode"), F.to_json(F.struct("*")).alias("report")) for k, df in reports.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merged_series(commits: DataFrame, series: dict[str, DataFrame], key: str = "commit_id") -> DataFrame:
    """commits with one struct column per analysis, where any has something for the commit."""
    out = commits
    for name, df in series.items():
        rest = [c for c in df.columns if c != key]
        out = out.join(df.select(key, F.struct(*rest).alias(name)), key, "left")
    return out.filter(F.coalesce(*(F.col(n).isNotNull().cast("int") * F.when(F.col(n).isNotNull(), 1) for n in series)) == 1)
