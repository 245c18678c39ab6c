"""Core operators on small tables with results that can be worked out by hand."""

import json
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from tidemark.functions.ordering import log_code
from tidemark.operators import identity, lines, trees
from tidemark.operators import ticks as ticks_op
from tidemark.operators.graph import components
from tidemark.operators.spikes import SpikeOptions, implausible, stuck_runs
from tidemark.plans import analyzers, registry, treequery
from tidemark.plans.declared import expand
from tidemark.sources import files, git
from tidemark.streaming import ticks

DATA = "/root/testdata/sf0.001"


def test_codes_keep_order(spark):
    values = [-5.0, -1e-3, 0.0, 1e-300, 1e-3, 1.0, 1.001, 2.0, 1e9, float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("c", log_code(F.col("v")))
    codes = [r.c for r in df.collect()]
    assert codes == sorted(codes) and codes[2] == 1 << 15
    odd = spark.createDataFrame([(None,), (float("nan"),)], "v double").withColumn("c", log_code(F.col("v")))
    assert [r.c for r in odd.collect()] == [None, None]


def _readings(spark, values, metric="m", signed=False, source=1):
    rows = [(source, t, metric, v, signed, v is not None and v < 0 and not signed) for t, v in enumerate(values)]
    return spark.createDataFrame(rows, "source long, tick long, metric string, value long, signed boolean, impossible boolean")


def test_spike_is_found_and_growth_is_not(spark):
    weekly = [20 + 10 * (t % 7) + t // 10 for t in range(300)]
    weekly[150] = 2500
    out = implausible(_readings(spark, weekly)).filter("spike").collect()
    assert [r.tick for r in out] == [150]
    level = [50 + t % 7 for t in range(100)] + [400 + t % 7 for t in range(100)]
    assert implausible(_readings(spark, level)).filter("spike").count() == 0


def test_impossible_nulls_and_empty(spark):
    values = [10, None, -3, 12, 11] * 20
    out = {(r.tick, r.impossible) for r in implausible(_readings(spark, values)).filter("impossible").collect()}
    assert out == {(t, True) for t in range(2, 100, 5)}
    assert implausible(_readings(spark, [1]).limit(0)).count() == 0


@pytest.mark.parametrize("block", [2048, 5])
def test_stuck_runs_cross_blocks(spark, block):
    values = [1, 2, 7, 7, 7, 7, 7, 7, 7, 3, 0, 0, 0, 0, 0, 0, 0, 4, 4, 4, None, 4, 4, 4]
    out = stuck_runs(_readings(spark, values), SpikeOptions(block=block)).filter("stuck")
    assert sorted(r.tick for r in out.collect()) == list(range(2, 9))


def test_line_stats(spark):
    runs = [("equal", 3), ("delete", 2), ("insert", 5), ("equal", 1), ("delete", 4)]
    df = spark.createDataFrame([(1, i, o, n, 0, 0) for i, (o, n) in enumerate(runs)], "change_id long, seq long, op string, n long, old_start long, new_start long")
    r = lines.line_stats(df).first()
    assert (r.changed, r.added, r.removed) == (2, 3, 4)


def test_hunks_and_typos(spark):
    before, after = "a\nint lenght = 3;\nb\n", "a\nint length = 3;\nb\n"
    df = spark.createDataFrame([(1, before, after), (2, None, "x"), (3, "same", "same"), (4, "a\0b", "a")], "change_id long, before_text string, after_text string")
    runs = lines.hunks(df)
    assert {r.change_id for r in runs.collect()} == {1}
    t = lines.corrected_identifiers(df, runs).collect()
    assert [(x.wrong, x.correct) for x in t] == [("lenght", "length")]


def test_replay_keeps_lines(spark):
    segments = []
    total = sum(x[4] for x in lines.replay(segments, [("insert", 10)], 1, 7))
    total += sum(x[4] for x in lines.replay(segments, [("equal", 4), ("delete", 3), ("insert", 2), ("equal", 3)], 5, 8))
    assert total == sum(s[0] for s in segments) == 9
    assert segments == [[4, 1, 7], [2, 5, 8], [3, 1, 7]]
    rows = [("f", 0, 1, 7, "insert", [("insert", 10)]), ("f", 1, 5, 8, "modify", [("equal", 4), ("delete", 3), ("equal", 3)]), ("f", 2, 9, 9, "delete", None)]
    df = spark.createDataFrame(rows, "lineage string, idx long, tick long, author_id long, kind string, runs array<struct<op:string,n:long>>")
    assert lines.line_ledger(df).agg(F.sum("delta")).first()[0] == 0


def test_touched_ranges(spark):
    runs = spark.createDataFrame([(1, 0, "insert", 2, 10, 200), (1, 1, "equal", 5, 0, 0)], "change_id long, seq long, op string, n long, old_start long, new_start long")
    ranges = spark.createDataFrame([(1, "f", 0, 199), (1, "g", 195, 300), (2, "h", 0, 999)], "change_id long, name string, start long, stop long")
    assert [r.name for r in lines.touched_ranges(runs, ranges).collect()] == ["g"]


SOURCE = '''import os
# about f
def f(a, b):
    if a and b:
        for x in a:
            if x:
                return x
    else:
        return f(b, a)

class K:
    def g(self):
        return self.v
'''


def test_trees(spark):
    df = spark.createDataFrame([(1, SOURCE), (2, "def broken("), (3, None)], "k long, t string")
    nodes = trees.parse_nodes(df, "k", "t").cache()
    m = {r.name: r for r in trees.function_measures(nodes, "k").collect()}
    assert m["f"].cyclomatic == 5 and m["f"].nesting_depth == 3 and m["f"].parameters == 2
    assert trees.cognitive(SOURCE)["f"] == 1 + 1 + 2 + 3 + 1 + 1
    assert {(r.target, r.score) for r in trees.comment_placement(nodes, "k").collect()} == {("f", 1.0)}
    assert trees.schema_compliance(nodes, "k", ["File"]).first().valid == 1
    changed = trees.parse_nodes(spark.createDataFrame([(1, SOURCE.replace("self.v", "self.w"))], "k long, t string"), "k", "t")
    kinds = {(r.kind, r.token) for r in trees.tree_changes(nodes.filter("k = 1"), changed, "k").filter("token <> ''").collect()}
    assert ("added", "w") in kinds and ("removed", "v") in kinds
    nodes.unpersist()


def test_saved_trees(spark):
    tree = {"type": "File", "children": [{"type": "Function", "props": {"name": "f"}, "roles": ["Function"], "children": [{"type": "Identifier", "token": "x"}]}, {"type": "Call", "children": [{"type": "Identifier", "token": "y"}]}]}
    df = spark.createDataFrame([(1, json.dumps(tree)), (2, "[]"), (3, "nothing"), (4, None)], "k long, t string")
    nodes = trees.tree_json_nodes(df, "k", "t").cache()
    assert [(r.type, r.pre, r.post) for r in nodes.orderBy("pre").collect()] == [("File", 0, 4), ("Function", 1, 1), ("Identifier", 2, 0), ("Call", 3, 3), ("Identifier", 4, 2)]
    assert sorted(r.type for r in trees.ancestors(nodes, "k", 4).collect()) == ["Call", "File"]
    assert {r.node_id: r.name for r in trees.names_of(nodes, "k").collect()} == {0: "f", 1: "f", 2: "x", 3: "y", 4: "y"}
    ids = [r.stable_id for r in trees.stable_ids(nodes, "k").collect()]
    assert len(set(ids)) == 5 and all(len(i) == 16 for i in ids)
    r = trees.mapping_coverage(nodes, ["File", "Call"]).first()
    assert (r.types, r.covered) == (4, 2)
    nodes.unpersist()


def test_halstead_and_cohesion(spark):
    h = trees.halstead(2, 3, 4, 6)
    assert round(h["volume"], 6) == 23.219281 and h["difficulty"] == 2 and round(h["bugs"], 8) == 0.00773976
    df = spark.createDataFrame([(1, "f1", "a"), (1, "f1", "b"), (1, "f2", "b"), (1, "f2", "c"), (2, "f", "a")], "k long, fn string, variable string")
    out = {r.k: round(r.lcom, 6) for r in trees.cohesion(df, "k").collect()}
    assert out == {1: 0.333333, 2: 0.0}


def test_tree_queries(spark):
    nodes = trees.parse_nodes(spark.createDataFrame([(1, SOURCE)], "k long, t string"), "k", "t")
    count = lambda q: [r.value for r in treequery.run(nodes, "k", q).collect()]
    assert sorted(count('rfilter(.type == "Function") |> map(.token)')) == ["f", "g"]
    assert count('rfilter(.roles has "Declaration") |> reduce(count)') == ["3"]
    assert count('map(.children) |> filter(.type == "Import" || .type == "Class") |> reduce(count)') == ["2"]
    assert sorted(count('rmap(.props.operator)')) == ["&&"]
    assert count('rfilter(.missing == "x") |> reduce(count)') == []
    assert count('rfilter(.id >= 10 && .id < 12) |> reduce(count)') == ["2"]
    assert str(treequery.parse('rfilter(.end_line > 7) |> rmap(.token)')) == "pipeline(rfilter(compare(>, field(end_line), literal(7))), rmap(field(token)))"
    for wrong in ("filter(", "map()", ".a |>", 'filter(.a == )', "reduce(sum)(", "§"):
        with pytest.raises(ValueError):
            treequery.parse(wrong)


def test_identity():
    ids = identity.loose_ids([("Ann", "a@x"), ("Bob", "b@x"), ("ann", "c@x"), ("Zed", "c@x"), ("", "b@x")])
    assert list(ids.values()) == [0, 1, 0, 0, 1]


def test_selection_and_options():
    assert analyzers.select(["history/*", "static/b"], ["history/a", "static/b", "history/c"]) == ["history/a", "history/c", "static/b"]
    with pytest.raises(ValueError):
        analyzers.select(["none"], ["a"])
    with pytest.raises(ValueError):
        analyzers.Options(anomaly_window=1)
    assert analyzers.kebab("SlowChurnByRepository") == "slow-churn-by-repository"


def test_trailing_z(spark):
    df = spark.createDataFrame(list(enumerate([10, 10, 10, 10, 100, 10, 10])), "t long, v long").withColumn("g", F.lit(1))
    z = [round(r.z, 6) for r in analyzers.trailing_z(df, ["g"], "t", "v", 3).orderBy("t").collect()]
    assert z[:2] == [0, 0] and z[4] == 100 and z[5] == -0.707107


def test_streamed_ticks_equal_batch(spark, tmp_path):
    rows = [(1, 0, 0), (1, 1, 108_000), (1, 2, 72_000), (2, 0, 500_000), (2, 1, 90_000)]
    spark.createDataFrame(rows, "repo long, idx long, s long").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("repo long, idx long, s long").json(str(tmp_path / "in"))
    q = ticks.to_ndjson(ticks.monotone_ticks(stream, "repo", "idx", "s"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    out = sorted((r.repo, r.idx, r.tick) for r in spark.read.json(str(tmp_path / "out")).collect())
    assert out == [(1, 0, 0), (1, 1, 1), (1, 2, 1), (2, 0, 0), (2, 1, 0)]


@pytest.mark.parametrize("block", [65_536, 2])
def test_ticks_never_run_backwards(spark, block):
    rows = [(1, i, i, h) for i, h in enumerate([5, 35, 25, 80, 10, 120])] + [(2, 9, 3, 7), (2, 10, 4, None)]
    df = spark.createDataFrame(rows, "repo_id long, commit_id long, idx long, hours long")
    out = ticks_op.ticks(df, F.col("hours") * 3_600_000_000, block=block).orderBy("repo_id", "idx").collect()
    assert [r.monotone for r in out] == [0, 1, 1, 3, 3, 5, 0]
    assert [r.raw for r in out] == [0, 1, 1, 3, 0, 5, 0]


def test_git_source(spark, tmp_path):
    def run(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=A", "-c", "user.email=a@x", *args], check=True, capture_output=True)

    run("init", "-q")
    (tmp_path / "a.txt").write_text("one\n")
    run("add", ".")
    run("commit", "-qm", "first")
    (tmp_path / "b.txt").write_text("two\n")
    (tmp_path / "a.txt").unlink()
    run("add", "-A")
    run("commit", "-qm", "second")
    git.register(spark)
    read = lambda t: spark.read.format("git_history").option("path", str(tmp_path)).option("table", t).option("chunk", "1").load()
    assert [(r.idx, r.message) for r in read("commits").orderBy("idx").collect()] == [(0, "first"), (1, "second")]
    assert sorted((r.idx, r.action) for r in read("changes").collect()) == [(0, "insert"), (1, "delete"), (1, "insert")]
    assert [r.path for r in read("files").collect()] == ["b.txt"]
    with pytest.raises(ValueError):
        git.check_local("https://host/x")
    assert git.parse_since("1970-01-02") == 86_400


def test_reports(spark, tmp_path):
    reports = [{"a": 1}, {"b": [1, "x"]}]
    files.write_envelopes(reports, tmp_path / "r.bin")
    assert files.read_report(tmp_path / "r.bin") == reports
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, reports)))
    assert files.read_report(tmp_path / "r.json") == reports
    assert files.to_yaml({"a": {"b": [1, "x"]}}).strip() == 'a:\n  b:\n    - 1\n    - "x"'
    (tmp_path / "people").write_text("Ann|a@x|Annie\n\nBob\n")
    assert files.people_file(spark, str(tmp_path / "people")).count() == 4
    (tmp_path / "src").mkdir()
    (tmp_path / "src/x.py").write_text("1")
    (tmp_path / "src/y.bin").write_text("1")
    assert files.scan_folder(spark, str(tmp_path / "src"), ["py"]).count() == 1


def test_dialects():
    assert expand("SELECT EXPLODE(f(a, b)) FROM t", "spark") == "SELECT explode(f(a, b)) FROM t"
    assert expand("PCT(x, 5e-1)", "other") == "quantile_cont(x, 5e-1)"


def test_plans_agree_with_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from pathlib import Path

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    for name in ("anomaly_ticks", "file_coupling", "quality_ticks", "import_list", "developers"):
        df = registry.QUERIES[name](spark, DATA)
        theirs = con.sql(registry.SQL[name])
        assert sorted(df.columns) == sorted(theirs.columns), name
        assert df.count() == len(theirs.fetchall()), name


def test_amounts_equal_what_texts_say(spark):
    duckdb = pytest.importorskip("duckdb")
    from pathlib import Path

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    for name in ("change_net_lines", "language_net_lines", "file_net_lines", "survival_current", "extension_languages", "language_filter"):
        df = registry.QUERIES[name](spark, DATA)
        theirs = con.sql(registry.SQL[name])
        assert sorted(map(tuple, df.select(*theirs.columns).collect())) == sorted(theirs.fetchall()), name


def test_measures_of_functions_and_files(spark):
    src = "def a(x):\n    y = x + 1\n    return y\n\n\ndef b(x):\n    if x and x > 1:\n        for i in x:\n            b(i)\n    return x\n\n\nclass K:\n    def a(self):\n        return 1\n"
    df = spark.createDataFrame([(1, src), (2, "def broken("), (3, None)], "k long, t string")
    got = sorted((r.name, r.line, r.cognitive) for r in trees.function_cognitive(df, "k", "t").collect())
    assert got == [("a", 1, 0), ("a", 14, 0), ("b", 6, 5)]
    nodes = trees.parse_nodes(df, "k", "t").cache()
    whole = trees.file_halstead(nodes, "k").collect()
    assert [r.k for r in whole] == [1] and whole[0].n1 <= whole[0].t1 and whole[0].n2 < whole[0].t2 and whole[0].volume > 0
    pairs = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (1, "b", "x"), (1, "c", None), (2, "d", "z"), (2, "d", "z")], "k long, fn string, variable string")
    each = {(r.k, r.fn): (r.variables, r.cohesion) for r in trees.cohesion_each(pairs, "k").collect()}
    assert each == {(1, "a"): (2, 0.5), (1, "b"): (1, 1.0), (1, "c"): (0, 1.0), (2, "d"): (1, 0.0)}


def test_change_filter(spark, tmp_path):
    repos = [(1, ["vendor/", ""], "", None), (2, None, r"^(?!gen/).*\.go$", None), (3, [], None, None)]
    spark.createDataFrame(repos, "repo_id long, skip_files array<string>, name_filter string, languages array<string>").write.parquet(f"{tmp_path}/repositories.parquet")
    rows = [(1, 1, "insert", None, "vendor/a.go", 5), (2, 1, "rename", "a.go", "b.go", 5), (3, 2, "modify", "gen/a.go", "gen/a.go", 5), (4, 2, "modify", "a.go", "a.go", None), (5, 2, "delete", "a.py", None, 5), (6, 3, "insert", None, "x", 5), (7, 3, "insert", None, "y", 1 << 21), (8, None, "insert", None, "z.c", 1)]
    spark.createDataFrame(rows, "change_id long, repo_id long, change_kind string, from_path string, to_path string, size_bytes long").write.parquet(f"{tmp_path}/file_changes.parquet")
    got = {tuple(r) for r in registry.QUERIES["change_filter"](spark, str(tmp_path)).collect()}
    assert got == {(2, "rename", "go"), (4, "modify", "go"), (6, "insert", "x"), (8, "insert", "c")}
    assert {tuple(r) for r in registry.QUERIES["skipped_changes"](spark, str(tmp_path)).collect()} == {(1, 2, 1), (2, 3, 0), (3, 2, 0), (None, 1, 0)}


def test_survival_conserves_lines(spark):
    sums = [F.sum("added"), F.sum("removed")]
    stats = registry.QUERIES["line_stats"](spark, DATA).agg(*sums).first()
    assert registry.QUERIES["file_churn"](spark, DATA).agg(*sums).first() == stats
    assert registry.QUERIES["developer_languages"](spark, DATA).agg(*sums).first() == stats
    assert registry.QUERIES["languages"](spark, DATA).agg(F.sum("total_lines"), F.sum("contribution") - F.sum("total_lines")).first() == stats
    dense = registry.QUERIES["survival_dense"](spark, DATA).cache()
    assert dense.filter("lines < 0").count() == 0
    last = dense.groupBy("repo_id").agg(F.max("sample").alias("sample"))
    standing = dense.join(last, ["repo_id", "sample"]).agg(F.sum("lines")).first()[0]
    assert standing == registry.QUERIES["survival_ledger"](spark, DATA).agg(F.sum("delta")).first()[0] == registry.QUERIES["survival_files"](spark, DATA).select(F.sum(F.round(F.col("lines") * 100 / F.col("pct")))).first()[0]


def test_ledger_follows_renames(spark):
    kind = "lineage string, idx long, tick long, author_id long, kind string, from_path string, to_path string, runs array<struct<op:string,n:long>>"
    rows = [("x", 0, 1, 7, "insert", None, "a", [("insert", 10)]), ("x", 1, 3, 8, "rename", "a", "b", [("equal", 6), ("delete", 4), ("insert", 1)]), ("x", 2, 4, 9, "insert", None, "a", [("insert", 5)]), ("x", 3, 5, 9, "delete", "b", None, None)]
    led = lines.line_ledger(spark.createDataFrame(rows, kind))
    assert {r.path: r.n for r in led.groupBy("path").agg(F.sum("delta").alias("n")).collect()} == {"a": 5, "b": 0}
    assert {tuple(r) for r in led.filter("not moved and delta < 0").select("author_id", "orig_author", "delta").collect()} == {(8, 7, -4), (9, 7, -6), (9, 8, -1)}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(7, 7), (None, 3)]
    nodes = sorted({x for e in edges for x in e if x is not None} | {999})
    got = {r.id: r.label for r in components(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            if a is not None:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want


def test_ledger_counts_changed_lines(spark, tmp_path):
    import datetime as dt

    at = lambda d: dt.datetime(2027, 11, 20) + dt.timedelta(days=d)
    commits = [(1, 1, 0, 0, 7, at(0), at(0)), (2, 1, 1, 40, 8, at(40), at(40)), (2, 1, 1, 40, 8, at(40), at(41)), (3, 1, 2, 130, 9, at(130), at(130))]
    spark.createDataFrame(commits, "commit_id long, repo_id long, idx long, tick long, author_id long, committer_ts timestamp, received_ts timestamp").write.parquet(f"{tmp_path}/commits.parquet")
    ten, less, b = ("".join(f"{x}{i}\n" for i in n) for x, n in (("a", range(10)), ("a", range(8)), ("b", range(4))))
    changes = [(1, 1, 1, "insert", None, "f", None, ten), (2, 1, 1, "insert", None, "g", None, b), (3, 1, 2, "modify", "f", "f", ten, less + "new\n"), (4, 1, 2, "modify", "h", "h", b, "x\n" + b), (5, 1, 3, "modify", "h", "h", "x\n" + b, "x\n")]
    spark.createDataFrame(changes, "change_id long, repo_id long, commit_id long, change_kind string, from_path string, to_path string, before_text string, after_text string").write.parquet(f"{tmp_path}/file_changes.parquet")
    run = lambda name, *cols: {tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).select(*cols).collect()}
    assert run("survival_dense", "sample", "band", "lines") == {(s, 0, 14 if s < 1 else 12) for s in range(5)} | {(s, 1, 2) for s in range(1, 5)}
    assert run("survival_global", "sample", "total", "rate") == {(0, 14, 0.875)} | {(s, 14, 0.875) for s in range(1, 5)}
    assert run("survival_files", "path", "top_owner", "lines", "pct") == {("f", 7, 8, 88.888889), ("g", 7, 4, 100.0), ("h", 8, 1, 100.0)}
    assert run("survival_developers", "author_id", "current_lines", "peak", "rate") == {(7, 12, 14, 0.857143), (8, 2, 2, 1.0)}
    assert run("survival_interaction", "orig_author", "modifier", "lines") == {(7, "self", 14), (7, "8", -2), (8, "self", 2)}
    assert run("survival_age", "age", "lines") == {("3-6", 14)}
    assert run("survival_by_year", "year", "lines") == {(2027, 12.0 + 2 * 12 / 30), (2028, 2 * 18 / 30)}
    assert run("file_churn", "path", "commits", "contributors", "added", "removed", "changed", "score") == {("f", 2, 2, 10, 1, 1, 2.12), ("g", 1, 1, 4, 0, 0, 1.04), ("h", 2, 2, 1, 4, 0, 2.05)}
    assert run("file_contributors", "path", "top_contributor", "added", "changed") == {("f", 7, 10, 0), ("g", 7, 4, 0), ("h", 8, 1, 0)}


def test_functions_change_together(spark, tmp_path):
    src = "def a():\n    return 1\n\n\ndef b():\n    return 2\n\n\ndef c():\n    return 3\n"
    both = src.replace("1", "one").replace("3", "three")
    changes = [(1, 1, 1, "insert", None, "m.py", None, src), (2, 1, 2, "modify", "m.py", "m.py", src, both), (3, 1, 2, "modify", "n.py", "n.py", "import os\nimport sys\n\n\n" + src, src.replace("return 2", "return 9")), (4, 1, 3, "modify", "m.py", "m.py", both, both.replace("one", "1"))]
    changes += [(5, 1, 4, "modify", "o.py", "o.py", "x = 1\n\n\n" + src, src.replace("def b():\n    return 2\n\n\n", "")), (6, 1, 5, "delete", "p.py", None, src, None)]
    spark.createDataFrame(changes, "change_id long, repo_id long, commit_id long, change_kind string, from_path string, to_path string, before_text string, after_text string").write.parquet(f"{tmp_path}/file_changes.parquet")
    hot = {(r.path, r.name): (r.changes, r.coupled, r.score, r.risk) for r in registry.QUERIES["function_hotness"](spark, str(tmp_path)).collect()}
    a, b, c = "Function_a", "Function_b", "Function_c"
    assert hot == {("m.py", a): (3, 3, 1.0, "LOW"), ("m.py", b): (1, 2, 0.333333, "LOW"), ("m.py", c): (2, 3, 0.666667, "LOW"), ("n.py", b): (1, 2, 0.333333, "LOW"), ("o.py", b): (1, 0, 0.333333, "LOW")}
    pairs = {(r.path1, r.name1, r.path2, r.name2): (r.co_changes, r.strength) for r in registry.QUERIES["function_coupling"](spark, str(tmp_path)).collect()}
    assert pairs == {("m.py", a, "m.py", b): (1, 0.333333), ("m.py", a, "m.py", c): (2, 0.666667), ("m.py", b, "m.py", c): (1, 0.5), ("m.py", a, "n.py", b): (1, 0.333333), ("m.py", c, "n.py", b): (1, 0.5)}
