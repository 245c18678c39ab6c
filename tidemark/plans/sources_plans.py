"""Queries that need code beside SQL: line diffs, typos, line survival, trees and tree queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import lines, trees
from tidemark.operators import ticks as tick_ops
from tidemark.operators.graph import components
from tidemark.plans.treequery import run
from tidemark.session import settle, shared_folder
from tidemark.sources import table
from tidemark.streaming import ticks as streams


def _changes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "file_changes")


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    python = _changes(spark, folder).filter("to_path like '%.py' and after_text is not null").select("change_id", "after_text")
    return trees.parse_nodes(python, "change_id", "after_text")


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    """Ticks of every commit (AG-01, WN-01, WN-02, STR-8), each commit once."""
    commits = table(spark, folder, "commits").groupBy("commit_id").agg(F.min_by(F.struct("repo_id", "idx", "committer_ts"), F.struct("received_ts", "idx")).alias("r"))
    return tick_ops.ticks(commits.select("commit_id", "r.*"), F.unix_micros(F.col("committer_ts").cast("timestamp")))


def _lines(text: str) -> Column:
    """Lines of a text column; none where it is null."""
    c = F.col(text)
    return F.coalesce(F.when(c == "", 0).otherwise(F.length(c) - F.length(F.replace(c, F.lit("\n"))) + F.when(c.endswith("\n"), 0).otherwise(1)), F.lit(0)).cast("long")


def hunks(spark: SparkSession, folder: str) -> DataFrame:
    """Line runs of every modified file (SRC-17, FLT-04, FLT-05)."""
    return lines.hunks(_changes(spark, folder))


def line_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Lines added, removed and changed per change; one-sided changes count whole (AG-03, WN-07, JN-04, JN-05)."""
    changes = _changes(spark, folder)
    alone = changes.filter("change_kind in ('insert', 'delete')").select("change_id", _lines("after_text").alias("added"), _lines("before_text").alias("removed"), F.lit(0).cast("long").alias("changed"))
    return lines.line_stats(hunks(spark, folder)).unionByName(alone)


def _typos(spark: SparkSession, folder: str) -> DataFrame:
    """(repo_id, path, commit_id, idx, wrong, correct, line): every corrected identifier."""
    changes = _changes(spark, folder)
    order = table(spark, folder, "commits").groupBy("commit_id").agg(F.min("idx").alias("idx"))
    where = changes.select("change_id", "repo_id", "commit_id", F.coalesce("to_path", "from_path").alias("path")).join(order, "commit_id", "left")
    return lines.corrected_identifiers(changes, lines.hunks(changes)).join(where, "change_id")


def typos(spark: SparkSession, folder: str) -> DataFrame:
    """Corrected identifiers, first occurrence in the order of commits, with how often each was corrected (AG-51, AG-52, WN-08, WN-11, JN-10, JN-11)."""
    return _typos(spark, folder).groupBy("wrong", "correct").agg(F.min_by("change_id", F.struct("idx", "change_id")).alias("first_change"), F.count("*").alias("frequency"))


def file_typos(spark: SparkSession, folder: str) -> DataFrame:
    """Corrected identifiers per file (AG-53, TK-07)."""
    return _typos(spark, folder).groupBy("repo_id", "path").agg(F.count("*").alias("typos"))


def typos_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    """Corrections, different ones, and the files and commits they are in, per repository (AG-53)."""
    counts = [F.count_distinct("wrong", "correct").alias("patterns"), F.count_distinct("path").alias("files"), F.count_distinct("commit_id").alias("commits")]
    return _typos(spark, folder).groupBy("repo_id").agg(F.count("*").alias("typos"), *counts)


def _edits(spark: SparkSession, folder: str) -> DataFrame:
    commits = table(spark, folder, "commits").groupBy("commit_id").agg(F.min("idx").alias("idx"), F.min("tick").alias("tick"), F.min("author_id").alias("author_id"))
    whole = F.when(F.col("change_kind") == "insert", F.array(F.struct(F.lit("insert").alias("op"), _lines("after_text").alias("n"))))
    runs = lines.hunks(_changes(spark, folder)).groupBy("change_id").agg(F.sort_array(F.collect_list(F.struct("seq", "op", "n"))).alias("r"))
    runs = runs.select("change_id", F.transform("r", lambda x: F.struct(x["op"].alias("op"), x["n"].alias("n"))).alias("runs"))
    joined = _changes(spark, folder).join(commits, "commit_id").join(runs, "change_id", "left")
    node = lambda path: F.concat_ws(":", "repo_id", path)
    moved = _changes(spark, folder).filter("from_path <> to_path").select(node("from_path").alias("a"), node("to_path").alias("b"))
    # the paths that renames link are replayed together, under the smallest of them
    ends = moved.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    linked = components(ends, moved).withColumnRenamed("id", "own")
    known = joined.withColumn("own", node(F.coalesce("to_path", "from_path"))).join(linked, "own", "left")
    return known.select(F.coalesce("label", "own").alias("lineage"), F.struct("idx", "change_id").alias("idx"), "tick", "author_id", F.col("change_kind").alias("kind"), "from_path", "to_path", F.coalesce(whole, "runs").alias("runs"))


def survival_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Replayed ledger of written and removed lines per file lineage (AG-24, AG-25, JN-13)."""
    return lines.line_ledger(_edits(spark, folder))


def survival_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Ledger by tick of change and tick of writing (AG-26)."""
    return survival_ledger(spark, folder).groupBy("cur_tick", "orig_tick").agg(F.sum("delta").alias("delta"))


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Tree nodes of the Python files (SRC-11), with roles and properties as text."""
    return _nodes(spark, folder).select("change_id", "node_id", "parent_id", "pre", "post", "type", "token", F.array_join("roles", ",").alias("roles"), F.to_json("props").alias("props"))


def function_measures(spark: SparkSession, folder: str) -> DataFrame:
    """Measures per function (ST-01, ST-02, ST-04, ST-05, ST-10 .. ST-12)."""
    return trees.function_measures(settle(_nodes(spark, folder)), "change_id")


def tree_types(spark: SparkSession, folder: str) -> DataFrame:
    """Node counts by type (ST-32)."""
    return _nodes(spark, folder).groupBy("type").agg(F.count("*").alias("nodes"))


def function_cohesion(spark: SparkSession, folder: str) -> DataFrame:
    """Cohesion per file from the variables of its functions (ST-14 .. ST-16)."""
    all_nodes = settle(_nodes(spark, folder))
    used = trees.inside(all_nodes, trees.functions_of(all_nodes, "change_id"), "change_id")
    pairs = used.filter(F.array_contains("roles", "Variable")).select("change_id", F.col("o_token").alias("fn"), F.col("token").alias("variable"))
    return trees.cohesion(pairs, "change_id")


def function_cognitive(spark: SparkSession, folder: str) -> DataFrame:
    """Cognitive complexity of every function (ST-03)."""
    python = _changes(spark, folder).filter("to_path like '%.py' and after_text is not null")
    return trees.function_cognitive(python, "change_id", "after_text")


def file_halstead(spark: SparkSession, folder: str) -> DataFrame:
    """Halstead measures per file (ST-12)."""
    return trees.file_halstead(settle(_nodes(spark, folder)), "change_id")


def cohesion_each(spark: SparkSession, folder: str) -> DataFrame:
    """Cohesion of every function with the others of its file (ST-16)."""
    all_nodes = settle(_nodes(spark, folder))
    fns = trees.functions_of(all_nodes, "change_id")
    used = trees.inside(all_nodes, fns, "change_id").filter(F.array_contains("roles", "Variable"))
    pairs = fns.select("change_id", F.col("token").alias("fn")).distinct().join(used.select("change_id", F.col("o_token").alias("fn"), F.col("token").alias("variable")).distinct(), ["change_id", "fn"], "left")
    return trees.cohesion_each(pairs, "change_id")


def file_shards(spark: SparkSession, folder: str, shards: int = 16) -> DataFrame:
    """Each changed path with its shard: the 32-bit FNV-1a hash of its bytes, modulo the number of shards (SC-16)."""
    byte = "cast(conv(hex(substr(encode(path, 'UTF-8'), i, 1)), 16, 10) as bigint)"
    fold = f"aggregate(sequence(1, octet_length(path)), 2166136261L, (h, i) -> ((h ^ {byte}) * 16777619L) % 4294967296L)"
    paths = _changes(spark, folder).select(F.coalesce("to_path", "from_path").alias("path")).filter("path <> ''").distinct()
    return paths.select("path", (F.expr(fold) % shards).alias("shard"))


def comment_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Comment blocks with their target and score (ST-18, ST-19, JN-12)."""
    return trees.comment_placement(settle(_nodes(spark, folder)), "change_id")


def function_documentation(spark: SparkSession, folder: str) -> DataFrame:
    """Functions with whether a well placed comment names them as its target (ST-20, ST-21)."""
    all_nodes = settle(_nodes(spark, folder))
    good = trees.comment_placement(all_nodes, "change_id").filter("score >= 1").select("change_id", F.col("target").alias("token"), F.lit(True).alias("documented")).distinct()
    fns = trees.functions_of(all_nodes, "change_id").select("change_id", "node_id", "token")
    joined = fns.join(good, ["change_id", "token"], "left").withColumn("documented", F.coalesce("documented", F.lit(False)))
    return joined.select("change_id", "node_id", F.col("token").alias("name"), "documented", F.when(F.col("documented"), "Well Documented").otherwise("Undocumented").alias("status"))


def shotness_touches(spark: SparkSession, folder: str) -> DataFrame:
    """Functions whose lines a change meets: deleted lines on the before side, inserted ones on the after side, all of a new file (JN-09, 2.12)."""
    python = _changes(spark, folder).filter("coalesce(to_path, from_path) like '%.py'")

    def functions(rows: DataFrame, text: str) -> DataFrame:
        fns = trees.functions_of(trees.parse_nodes(rows.filter(F.col(text).isNotNull()).select("change_id", text), "change_id", text), "change_id")
        return fns.select("change_id", F.concat_ws("_", "type", "token").alias("name"), (F.col("start_line") - 1).alias("start"), (F.col("end_line") - 1).alias("stop"))

    edited, born = python.filter("change_kind not in ('insert', 'delete')"), python.filter("change_kind = 'insert'")
    runs = settle(lines.hunks(edited))
    gone = lines.touched_ranges(runs.filter("op = 'delete'"), functions(edited, "before_text"))
    new = lines.touched_ranges(runs.filter("op = 'insert'"), functions(edited, "after_text"))
    return gone.unionByName(new).unionByName(functions(born, "after_text").select("change_id", "name")).distinct()


def _touched(spark: SparkSession, folder: str) -> DataFrame:
    """(repo_id, commit_id, path, name): the functions that each commit meets, once each."""
    changes = _changes(spark, folder).select("change_id", "repo_id", "commit_id", F.coalesce("to_path", "from_path").alias("path"))
    return shotness_touches(spark, folder).join(changes, "change_id").select("repo_id", "commit_id", "path", "name").distinct()


def _met_together(touched: DataFrame) -> DataFrame:
    """Pairs of functions that a commit meets both, and how many commits do."""
    a, b = (touched.select("repo_id", "commit_id", F.struct("path", "name").alias(k)) for k in ("f1", "f2"))
    return a.join(b, ["repo_id", "commit_id"]).filter("f1 < f2").groupBy("repo_id", "f1", "f2").agg(F.count("*").alias("co_changes"))


def function_hotness(spark: SparkSession, folder: str) -> DataFrame:
    """Commits that meet each function, how many functions it is coupled with, and its risk (AG-46, AG-47, AG-49)."""
    touched = settle(_touched(spark, folder))
    pairs = _met_together(touched)
    coupled = pairs.select("repo_id", F.explode(F.array("f1", "f2")).alias("f")).groupBy("repo_id", "f").agg(F.count("*").alias("coupled"))
    each = touched.groupBy("repo_id", F.struct("path", "name").alias("f")).agg(F.count("*").alias("changes")).join(coupled, ["repo_id", "f"], "left")
    score = F.round(F.col("changes") / F.max("changes").over(Window.partitionBy("repo_id")), 6)
    risk = F.when(F.col("changes") >= 20, "HIGH").when(F.col("changes") >= 10, "MEDIUM").otherwise("LOW")
    return each.select("repo_id", "f.path", "f.name", "changes", F.coalesce("coupled", F.lit(0)).alias("coupled"), score.alias("score"), risk.alias("risk"))


def function_coupling(spark: SparkSession, folder: str) -> DataFrame:
    """Functions that commits meet together (JN-08, AG-48)."""
    touched = settle(_touched(spark, folder))
    own = touched.groupBy("repo_id", F.struct("path", "name").alias("f")).agg(F.count("*").alias("n"))
    own1, own2 = (own.select("repo_id", F.col("f").alias(f"f{k}"), F.col("n").alias(f"n{k}")) for k in (1, 2))
    pairs = _met_together(touched).join(own1, ["repo_id", "f1"]).join(own2, ["repo_id", "f2"])
    strength = F.round(F.col("co_changes") / F.greatest("co_changes", "n1", "n2"), 6)
    return pairs.select("repo_id", F.col("f1.path").alias("path1"), F.col("f1.name").alias("name1"), F.col("f2.path").alias("path2"), F.col("f2.name").alias("name2"), "co_changes", strength.alias("strength"))


def function_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    """Functions met, how often, how many are hot, and their couplings, per repository (AG-50)."""
    hot = function_hotness(spark, folder).groupBy("repo_id").agg(F.count("*").alias("nodes"), F.sum("changes").alias("changes"), F.round(F.avg("changes"), 6).alias("avg_changes"), F.count_if(F.col("risk") != "LOW").alias("hot_nodes"))
    pairs = function_coupling(spark, folder).groupBy("repo_id").agg(F.count("*").alias("couplings"), F.round(F.avg("strength"), 6).alias("avg_strength"))
    return hot.join(pairs, "repo_id", "left").fillna(0, ["couplings", "avg_strength"])


def tree_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes added, removed and modified between the two sides of a change (2.14, JN-14, JN-16, SO-05)."""
    python = _changes(spark, folder).filter("to_path like '%.py' and before_text is not null and after_text is not null")
    before = settle(trees.parse_nodes(python.select("change_id", "before_text"), "change_id", "before_text"))
    after = settle(trees.parse_nodes(python.select("change_id", "after_text"), "change_id", "after_text"))
    return trees.tree_changes(before, after, "change_id").groupBy("change_id", "kind", "type").agg(F.count("*").alias("nodes"))


def tree_query(spark: SparkSession, folder: str) -> DataFrame:
    """Declared functions per file by the pipe language (UDF-01, PRJ-01 .. PRJ-05, FLT-14, FLT-15, ST-31)."""
    return run(settle(_nodes(spark, folder)), "change_id", 'rfilter(.type == "Function" && .roles has "Declaration") |> reduce(count)')


def _stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream of its files, be it one file or a folder of them."""
    whole = table(spark, folder, name)
    single = all(f.endswith(f"/{name}.parquet") for f in whole.inputFiles())
    reader = spark.readStream.schema(whole.schema)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if single else reader.parquet(f"{folder}/{name}.parquet")


def _drained(stream: DataFrame, mode: str) -> DataFrame:
    """All that a stream has now, through its checkpointed state, as a table."""
    spark = stream.sparkSession
    home = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    if mode == "append":
        streams.to_ndjson(stream, f"{home}/out", f"{home}/state").awaitTermination()
        return spark.read.schema(stream.schema).json(f"{home}/out")
    out = f"{home}/out"
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/state").trigger(availableNow=True)
    query.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return spark.read.parquet(out)


def stream_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """Ticks of the commits as they arrive, late ones moved forward (STR-7, STR-8, STR-9, STR-10)."""
    commits = _stream(spark, folder, "commits").filter("committer_ts is not null")
    timed = commits.select("repo_id", "idx", F.unix_seconds(F.col("committer_ts").cast("timestamp")).alias("seconds"))
    return _drained(streams.monotone_ticks(timed, "repo_id", "idx", "seconds"), "append")


def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Events per hour and type, kept up to date by a stream."""
    counts = streams.windowed_counts(_stream(spark, folder, "events"), "ts", "event_type")
    return _drained(counts.select(F.unix_seconds("start").alias("start_s"), "event_type", "n"), "complete")


QUERIES = {f.__name__: f for f in (ticks, hunks, line_stats, typos, file_typos, typos_aggregate, survival_ledger, survival_rollup, nodes, function_measures, tree_types, function_cohesion, function_cognitive, file_halstead, cohesion_each, file_shards, comment_quality, function_documentation, shotness_touches, function_hotness, function_coupling, function_aggregate, tree_diff, tree_query, stream_ticks, stream_windows)}
SQL: dict[str, str] = {
    "file_shards": "SELECT path, list_reduce(list_prepend(2166136261::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(path, '')]), lambda h, c: (xor(h, c) * 16777619) % 4294967296) % 16 AS shard FROM (SELECT DISTINCT coalesce(to_path, from_path) AS path FROM file_changes) WHERE path <> ''",
    "stream_windows": "SELECT cast(floor(epoch_us(ts) / 36e8) AS bigint) * 3600 AS start_s, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
