"""Source trees as tables: a parser, metrics per function, comment placement and differences of trees.

A node has pre and post numbers, so descendants are a range: d.pre > a.pre and d.post < a.post.
"""

from __future__ import annotations

import ast
import io
import json
import tokenize
import warnings
from collections.abc import Iterator
from math import log2

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NODE = "node_id long, parent_id long, child_idx long, depth long, pre long, post long, type string, token string, roles array<string>, props map<string,string>, start_line long, end_line long"
_TYPES = {
    "Module": ("File", []), "FunctionDef": ("Function", ["Function", "Declaration"]), "AsyncFunctionDef": ("Function", ["Function", "Declaration"]), "ClassDef": ("Class", ["Declaration"]), "If": ("If", ["Condition"]), "IfExp": ("If", ["Condition"]),
    "For": ("Loop", ["Loop"]), "AsyncFor": ("Loop", ["Loop"]), "While": ("Loop", ["Loop"]), "comprehension": ("Loop", ["Loop"]), "Try": ("Try", ["Exception"]), "ExceptHandler": ("Catch", ["Catch"]), "Match": ("Switch", ["Switch"]), "match_case": ("Case", ["Case"]),
    "BoolOp": ("BinaryOp", ["Logical", "Operator"]), "BinOp": ("BinaryOp", ["Operator"]), "Compare": ("BinaryOp", ["Operator"]), "UnaryOp": ("UnaryOp", ["Operator"]), "AugAssign": ("Assignment", ["Assignment", "Operator"]), "Assign": ("Assignment", ["Assignment"]), "AnnAssign": ("Assignment", ["Assignment"]),
    "Return": ("Return", ["Return"]), "Call": ("Call", ["Call"]), "Name": ("Identifier", ["Name"]), "Attribute": ("Identifier", ["Name"]), "Constant": ("Literal", ["Literal"]), "arg": ("Parameter", ["Parameter", "Variable"]), "Import": ("Import", ["Import"]), "ImportFrom": ("Import", ["Import"]), "Lambda": ("Lambda", ["Lambda"]), "Break": ("Break", ["Break"]), "Continue": ("Continue", ["Continue"]),
}
_TOKEN = {"FunctionDef": "name", "AsyncFunctionDef": "name", "ClassDef": "name", "Name": "id", "Attribute": "attr", "arg": "arg"}
_OPS = {"And": "&&", "Or": "||", "Add": "+", "Sub": "-", "Mult": "*", "Div": "/", "Mod": "%", "Pow": "**", "FloorDiv": "//", "Eq": "==", "NotEq": "!=", "Lt": "<", "LtE": "<=", "Gt": ">", "GtE": ">=", "In": "in", "NotIn": "not in", "Is": "is", "IsNot": "is not", "Not": "!", "USub": "-", "UAdd": "+", "Invert": "~", "BitAnd": "&", "BitOr": "|", "BitXor": "^", "LShift": "<<", "RShift": ">>"}


def parse_python(text: str) -> list[tuple]:
    """Nodes of a Python source, comments included; [] if it does not parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    rows: list[list] = []
    counter = [0, 0]

    def visit(node: ast.AST, parent: int | None, idx: int, depth: int) -> None:
        name = type(node).__name__
        kind, roles = _TYPES.get(name, (name, []))
        token = str(getattr(node, _TOKEN[name])) if name in _TOKEN else repr(node.value) if name == "Constant" else ""
        props = {}
        op = getattr(node, "op", None) or (node.ops[0] if name == "Compare" else None)
        if op is not None:
            props["operator"] = _OPS.get(type(op).__name__, type(op).__name__)
        if name in ("FunctionDef", "AsyncFunctionDef", "ClassDef"):
            props["name"] = node.name
        if name == "Name":
            roles = [*roles, "Variable"]
            props["context"] = type(node.ctx).__name__
        if name in ("Import", "ImportFrom"):
            token = getattr(node, "module", None) or node.names[0].name
        me, pre = len(rows), counter[0]
        counter[0] += 1
        row = [me, parent, idx, depth, pre, 0, kind, token, roles, props, getattr(node, "lineno", 1), getattr(node, "end_lineno", None) or getattr(node, "lineno", 1)]
        rows.append(row)
        kids = [c for c in ast.iter_child_nodes(node) if not isinstance(c, (ast.expr_context, ast.operator, ast.boolop, ast.cmpop, ast.unaryop))]
        for i, child in enumerate(kids):
            visit(child, me, i, depth + 1)
        if parent is None:
            for k, (line, comment) in enumerate(_comments(text)):
                rows.append([len(rows), me, len(kids) + k, 1, counter[0], counter[1], "Comment", comment, ["Comment"], {}, line, line])
                counter[0] += 1
                counter[1] += 1
            row[11] = text.count("\n") + 1
        row[5] = counter[1]
        counter[1] += 1

    visit(tree, None, 0, 0)
    return [tuple(r) for r in rows]


def _comments(text: str) -> list[tuple[int, str]]:
    try:
        return [(t.start[0], t.string) for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type == tokenize.COMMENT]
    except (tokenize.TokenError, IndentationError, SyntaxError):
        return []


def parse_nodes(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, nodes ..) of Python texts; null texts and texts that do not parse have no nodes."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in NODE.split(", ")]
        for batch in batches:
            rows = [(k, *n) for k, t in zip(batch[key], batch[text]) for n in parse_python(t or "")]
            yield pd.DataFrame(rows, columns=[key, *names])

    return files.select(key, text).mapInPandas(parse, f"{key} {files.schema[key].dataType.simpleString()}, {NODE}")


def functions_of(nodes: DataFrame, key: str) -> DataFrame:
    """Nodes that are functions, by type or by role, once each."""
    return nodes.filter(F.col("type").isin("Function", "Method") | (F.array_contains("roles", "Function") & F.array_contains("roles", "Declaration")))


def inside(nodes: DataFrame, outer: DataFrame, key: str) -> DataFrame:
    """Pairs of an outer node (prefixed o_) and its descendants, met per file."""
    o = outer.select(key, *(F.col(c).alias(f"o_{c}") for c in ("node_id", "pre", "post", "token", "start_line", "end_line")))
    return nodes.join(o, key).filter("pre > o_pre and post < o_post")


def _symbols(below: DataFrame, key: str) -> DataFrame:
    """(key, o_node_id, op, operand): operators and operands of rows of `inside`, each for its innermost function."""
    innermost = Window.partitionBy(key, "node_id").orderBy(F.desc("o_pre"))
    own = below.withColumn("r", F.row_number().over(innermost)).filter("r = 1")
    return own.select(key, "o_node_id", F.when(F.array_contains("roles", "Operator"), F.col("props")["operator"]).when(F.col("type").isin("If", "Loop", "Return", "Assignment", "Call"), F.col("type")).alias("op"), F.when(F.col("type").isin("Identifier", "Literal", "Parameter"), F.col("token")).alias("operand"))


def _halstead_columns(rows: DataFrame) -> DataFrame:
    """rows (n1, n2, t1, t2: distinct and total operators and operands) with volume, difficulty, effort and bugs."""
    volume = F.when(F.col("n1") + F.col("n2") > 0, (F.col("t1") + F.col("t2")) * F.log2((F.col("n1") + F.col("n2")).cast("double"))).otherwise(0.0)
    difficulty = F.when(F.col("n2") > 0, F.col("n1") / 2 * F.col("t2") / F.col("n2")).otherwise(0.0)
    full = rows.withColumn("volume", volume).withColumn("difficulty", difficulty)
    return full.withColumn("effort", F.col("volume") * F.col("difficulty")).withColumn("bugs", F.col("volume") / 3000)


def file_halstead(nodes: DataFrame, key: str) -> DataFrame:
    """Halstead measures per file: totals over its functions, distinct symbols of all of them together."""
    symbols = _symbols(inside(nodes, functions_of(nodes, key), key), key)
    return _halstead_columns(symbols.groupBy(key).agg(F.count_distinct("op").alias("n1"), F.count_distinct("operand").alias("n2"), F.count("op").alias("t1"), F.count("operand").alias("t2")))


def function_measures(nodes: DataFrame, key: str) -> DataFrame:
    """Per function: cyclomatic complexity, nesting depth, lines, parameters, returns and Halstead measures.

    Decisions are conditions, loops, handlers, cases and logical operators, those of nested
    functions included. Operators and operands are counted for the innermost function.
    """
    fns = functions_of(nodes, key)
    below = inside(nodes, fns, key)
    decision = F.col("type").isin("If", "Loop", "Catch", "Case") | ((F.col("type") == "BinaryOp") & F.array_contains("roles", "Logical"))
    nest = F.col("type").isin("If", "Loop", "Switch", "Try", "Catch")
    counts = below.groupBy(key, "o_node_id").agg(F.count_if(decision).alias("d"), F.count_if(F.col("type") == "Parameter").alias("parameters"), F.count_if(F.col("type") == "Return").alias("returns"))
    levels = below.filter(nest).select(key, "o_node_id", "node_id", "pre", "post")
    outer = levels.select(key, "o_node_id", F.col("node_id").alias("m"), F.col("pre").alias("p2"), F.col("post").alias("q2"))
    nested = levels.join(outer, [key, "o_node_id"]).filter("p2 <= pre and q2 >= post").groupBy(key, "o_node_id", "node_id").agg(F.count("*").alias("lv"))
    deepest = nested.groupBy(key, "o_node_id").agg(F.max("lv").alias("nesting_depth"))
    symbols = _symbols(below, key)
    h = symbols.groupBy(key, "o_node_id").agg(F.count_distinct("op").alias("n1"), F.count_distinct("operand").alias("n2"), F.count("op").alias("t1"), F.count("operand").alias("t2"))
    base = fns.select(key, "node_id", F.coalesce(F.col("props")["name"], F.col("token")).alias("name"), (F.col("end_line") - F.col("start_line") + 1).alias("lines_of_code"))
    joined = base.join(counts.withColumnRenamed("o_node_id", "node_id"), [key, "node_id"], "left").join(deepest.withColumnRenamed("o_node_id", "node_id"), [key, "node_id"], "left").join(h.withColumnRenamed("o_node_id", "node_id"), [key, "node_id"], "left")
    full = _halstead_columns(joined.na.fill(0))
    return full.select(key, "node_id", "name", (F.col("d") + 1).alias("cyclomatic"), "nesting_depth", "lines_of_code", "parameters", "returns", "volume", "difficulty", "effort", "bugs")


def halstead(n1: int, n2: int, big1: int, big2: int) -> dict[str, float]:
    """Halstead measures of distinct and total operators (1) and operands (2)."""
    n, total = n1 + n2, big1 + big2
    volume = total * log2(n) if n else 0.0
    difficulty = n1 / 2 * big2 / n2 if n2 else 0.0
    return {"volume": volume, "difficulty": difficulty, "effort": volume * difficulty, "time": volume * difficulty / 18, "bugs": volume / 3000}


def cognitive(text: str) -> dict[str, int]:
    """Cognitive complexity per function of a Python source; of functions of one name the last counts."""
    return {name: value for name, _, value in cognitive_rows(text)}


def cognitive_rows(text: str) -> list[tuple[str, int, int]]:
    """(name, line, cognitive complexity) of the functions of a Python source: structures weigh one more per level of nesting."""
    out: list[tuple[str, int, int]] = []

    def walk(node: ast.AST, depth: int, name: str) -> int:
        total = 0
        for field, value in ast.iter_fields(node):
            for child in value if isinstance(value, list) else [value]:
                if not isinstance(child, ast.AST):
                    continue
                if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    out.append((child.name, child.lineno, walk(child, 0, child.name)))
                    total += walk(child, depth + 1, name)
                elif isinstance(child, ast.If) and isinstance(node, ast.If) and field == "orelse" and len(node.orelse) == 1:
                    total += 1 + walk_if(child, depth, name)
                elif isinstance(child, ast.If):
                    total += 1 + depth + walk_if(child, depth + 1, name)
                elif isinstance(child, (ast.For, ast.AsyncFor, ast.While, ast.Try, ast.ExceptHandler, ast.Match, ast.IfExp)):
                    total += 1 + depth + walk(child, depth + 1, name)
                elif isinstance(child, ast.BoolOp):
                    total += 1 + walk(child, depth, name)
                elif isinstance(child, ast.Lambda):
                    total += walk(child, depth + 1, name)
                else:
                    total += (isinstance(child, ast.Call) and isinstance(child.func, ast.Name) and child.func.id == name) + walk(child, depth, name)
        return total

    def walk_if(node: ast.If, depth: int, name: str) -> int:
        more = walk(node, depth, name)
        plain = node.orelse and not (len(node.orelse) == 1 and isinstance(node.orelse[0], ast.If))
        return more + (1 if plain else 0)

    walk(ast.parse(text), 0, "")
    return out


def function_cognitive(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, line, cognitive) of the functions of Python texts; null texts and texts that do not parse have none."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch[key], batch[text]):
                try:
                    rows += [(k, *r) for r in cognitive_rows(t or "")]
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    continue
            yield pd.DataFrame(rows, columns=[key, "name", "line", "cognitive"])

    return files.select(key, text).mapInPandas(measure, f"{key} {files.schema[key].dataType.simpleString()}, name string, line long, cognitive long")


def cohesion_each(pairs: DataFrame, key: str) -> DataFrame:
    """(key, fn, variables, cohesion) of (key, fn, variable), variable null for a function without any.

    The share of a function's variables that functions of other names use too; 1 without variables,
    0 in a file without other functions.
    """
    used = pairs.distinct()
    holders = used.filter("variable is not null").groupBy(key, "variable").agg(F.count("*").alias("holders"))
    functions = used.groupBy(key).agg(F.count_distinct("fn").alias("functions"))
    each = used.join(holders, [key, "variable"], "left").groupBy(key, "fn").agg(F.count("variable").alias("variables"), F.count_if(F.col("holders") > 1).alias("shared")).join(functions, key)
    share = F.when(F.col("variables") == 0, 1.0).when(F.col("functions") <= 1, 0.0).otherwise(F.col("shared") / F.col("variables"))
    return each.select(key, "fn", "variables", share.alias("cohesion"))


def cohesion(pairs: DataFrame, key: str) -> DataFrame:
    """(key, lcom, cohesion) of (key, fn, variable): 1 - uses / (functions x variables), 0 for one function or none."""
    d = pairs.distinct()
    g = d.groupBy(key).agg(F.count("variable").alias("u"), F.count_distinct("fn").alias("m"), F.count_distinct("variable").alias("a"))
    lcom = F.when((F.col("m") <= 1) | (F.col("a") == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("u") / (F.col("m") * F.col("a")))))
    return g.select(key, lcom.alias("lcom"), (1 - lcom).alias("cohesion"))


def comment_blocks(nodes: DataFrame, key: str) -> DataFrame:
    """(key, block, start_line, end_line, lines): comments on successive lines merged."""
    w = Window.partitionBy(key).orderBy("start_line", "node_id")
    opens = F.when(F.col("start_line") <= F.lag("end_line").over(w) + 1, 0).otherwise(1)
    marked = nodes.filter("type = 'Comment'").withColumn("opens", opens).withColumn("block", F.sum("opens").over(w))
    return marked.groupBy(key, "block").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.count("*").alias("lines"))


def comment_placement(nodes: DataFrame, key: str) -> DataFrame:
    """(key, block, target, score): the nearest function or class of each comment block and how well the block stands.

    A block above its target, at most 2 lines away (3 for several lines), scores 1; otherwise the
    penalty of the target's kind, or -0.2 without a target. What follows is preferred; what stands
    before or around counts as 1,000 lines further. The nearest is found by two running windows over
    blocks and targets in order, so nothing is paired that is not nearest.
    """
    blocks = comment_blocks(nodes, key)
    targets = nodes.filter(F.col("type").isin("Function", "Method", "Class"))
    rows = blocks.select(key, F.col("end_line").alias("at"), F.lit(0).alias("is_target"), F.struct("block", "start_line", "end_line", "lines").alias("b"), F.lit(None).cast("struct<line:bigint,pre:bigint,type:string,token:string>").alias("t"))
    rows = rows.unionByName(targets.select(key, F.col("start_line").alias("at"), F.lit(1).alias("is_target"), F.lit(None).cast(rows.schema["b"].dataType).alias("b"), F.struct(F.col("start_line").alias("line"), "pre", "type", "token").alias("t")))
    ahead = Window.partitionBy(key).orderBy("at", "is_target").rowsBetween(1, Window.unboundedFollowing)
    behind = Window.partitionBy(key).orderBy("at", "is_target").rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("next", F.first("t", ignorenulls=True).over(ahead)).withColumn("prev", F.last("t", ignorenulls=True).over(behind)).filter("is_target = 0")
    target = F.coalesce("next", "prev")
    gap = F.when(F.col("next").isNotNull(), F.col("next.line") - F.col("b.end_line"))
    good = gap <= F.when(F.col("b.lines") > 1, 3).otherwise(2)
    penalty = F.when(target.isNull(), -0.2).when(target["type"].isin("Function", "Method"), -0.5).otherwise(-0.3)
    return near.select(key, F.col("b.block").alias("block"), target["token"].alias("target"), F.when(good, 1.0).otherwise(penalty).alias("score"))


def tree_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, kind, type, token, depth): nodes added, removed or modified between two trees of a file.

    Children match greedily by (type, token) in order under the same path of types and tokens; of a
    matched pair a node is modified if its lines differ.
    """
    def pathed(n: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(key, "parent_id", "type", "token").orderBy("child_idx"))
        return n.select(key, "node_id", "parent_id", "type", "token", "depth", "start_line", "end_line", place.alias("nth"))

    a, b = pathed(before), pathed(after)
    cols = ["type", "token", "nth", "depth"]
    pa, pb = a.alias("x").join(a.alias("p"), (F.col(f"x.{key}") == F.col(f"p.{key}")) & (F.col("x.parent_id") == F.col("p.node_id")), "left"), b.alias("x").join(b.alias("p"), (F.col(f"x.{key}") == F.col(f"p.{key}")) & (F.col("x.parent_id") == F.col("p.node_id")), "left")

    def flat(d: DataFrame, s: str) -> DataFrame:
        return d.select(F.col(f"x.{key}").alias(key), *(F.col(f"x.{c}").alias(c) for c in cols), F.coalesce("p.type", F.lit("")).alias("pt"), F.coalesce("p.token", F.lit("")).alias("pk"), F.coalesce("p.nth", F.lit(0)).alias("pn"), F.struct("x.start_line", "x.end_line").alias(s))

    both = flat(pa, "l1").join(flat(pb, "l2"), [key, *cols, "pt", "pk", "pn"], "full_outer")
    kind = F.when(F.col("l1").isNull(), "added").when(F.col("l2").isNull(), "removed").when(F.col("l1") != F.col("l2"), "modified")
    return both.select(key, kind.alias("kind"), "type", "token", "depth").filter("kind is not null")


def schema_compliance(nodes: DataFrame, key: str, known_types: list[str]) -> DataFrame:
    """(key, nodes, valid, share) of nodes whose type is one of the known types and whose range is in order."""
    ok = F.col("type").isin(known_types) & (F.col("start_line") <= F.col("end_line"))
    return nodes.groupBy(key).agg(F.count("*").alias("nodes"), F.count_if(ok).alias("valid")).withColumn("share", F.col("valid") / F.col("nodes"))


def tree_json_nodes(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, nodes ..) of trees saved as JSON: objects with type, token, roles, props, pos and children.

    Texts that are no JSON object have no nodes.
    """

    def flatten(text: str) -> list[tuple]:
        try:
            root = json.loads(text)
        except ValueError:
            return []
        if not isinstance(root, dict):
            return []
        rows: list[list] = []
        pre = post = 0
        # an explicit stack: saved trees may be deeper than Python's own
        stack: list[tuple] = [(root, None, 0, 0, False)]
        while stack:
            node, parent, idx, depth, done = stack.pop()
            if done:
                rows[node][5] = post
                post += 1
                continue
            me = len(rows)
            pos = node.get("pos") or {}
            start = int(pos.get("start_line") or 0)
            rows.append([me, parent, idx, depth, pre, 0, node.get("type") or "", node.get("token") or "", list(node.get("roles") or []), {str(k): str(v) for k, v in (node.get("props") or {}).items()}, start, int(pos.get("end_line") or start)])
            pre += 1
            stack.append((me, None, 0, 0, True))
            stack += [(c, me, i, depth + 1, False) for i, c in reversed(list(enumerate(node.get("children") or []))) if isinstance(c, dict)]
        return [tuple(r) for r in rows]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in NODE.split(", ")]
        for batch in batches:
            rows = [(k, *n) for k, t in zip(batch[key], batch[text]) for n in flatten(t or "")]
            yield pd.DataFrame(rows, columns=[key, *names])

    return files.select(key, text).mapInPandas(read, f"{key} {files.schema[key].dataType.simpleString()}, {NODE}")


def ancestors(nodes: DataFrame, key: str, node_id: int) -> DataFrame:
    """Nodes that hold a node, in every file that has one of that id."""
    inner = nodes.filter(F.col("node_id") == node_id).select(key, F.col("pre").alias("p"), F.col("post").alias("q"))
    return nodes.join(inner, key).filter("pre < p and post > q").drop("p", "q")


def names_of(nodes: DataFrame, key: str) -> DataFrame:
    """(key, node_id, name): the property name, else the token, else that of the first child."""
    own = F.coalesce(F.col("props")["name"], F.nullif("token", F.lit("")))
    kids = nodes.filter("child_idx = 0 and parent_id is not null").select(key, F.col("parent_id").alias("node_id"), own.alias("below"))
    return nodes.join(kids, [key, "node_id"], "left").select(key, "node_id", F.coalesce(own, F.col("below"), F.lit("")).alias("name"))


def stable_ids(nodes: DataFrame, key: str) -> DataFrame:
    """(key, node_id, stable_id): 16 hex digits of a hash over type, token, roles, place and descendants.

    Descendants are met as ranges and combined in order, so no level waits for the one below.
    """
    own = F.sha1(F.concat_ws("|", "type", "token", F.array_join("roles", ","), F.col("start_line").cast("string"), F.col("end_line").cast("string"), F.col("child_idx").cast("string")))
    hashed = nodes.select(key, "node_id", "pre", "post", "depth", own.alias("h"))
    low = hashed.select(key, F.col("pre").alias("dp"), F.col("post").alias("dq"), F.col("depth").alias("dd"), F.col("h").alias("dh"))
    below = hashed.join(low, key).filter("dp >= pre and dq <= post").groupBy(key, "node_id").agg(F.sort_array(F.collect_list(F.struct("dp", (F.col("dd") - F.col("depth")).alias("rel"), "dh"))).alias("all"))
    return below.select(key, "node_id", F.substring(F.sha1(F.concat_ws(";", F.transform("all", lambda x: F.concat_ws(":", x["rel"].cast("string"), x["dh"])))), 1, 16).alias("stable_id"))


def mapping_coverage(nodes: DataFrame, mapped: list[str]) -> DataFrame:
    """(types, covered, share): how many of the node types that occur are among the mapped ones."""
    kinds = nodes.select("type").distinct()
    return kinds.agg(F.count("*").alias("types"), F.count_if(F.col("type").isin(mapped)).alias("covered")).withColumn("share", F.try_divide("covered", "types"))
