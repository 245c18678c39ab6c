"""A small pipe language over source trees, compiled to DataFrame plans.

    rfilter(.type == "Function" && .roles has "Declaration") |> map(.token) |> reduce(count)

Stages: filter, rfilter, map, rmap, reduce(count), or an expression, which is a map. Fields: .token
.type .id .roles .children .first .last, .props.name, and .children.field; anything else is a property. Operators: == != > >=
< <= && || ! has. A missing value is equal to nothing, so == is false and != true. Order compares as
numbers if both sides are numbers, else as text. A query starts at the root; one that starts with a
bare filter starts at the root's children, and so does a pipeline unless its first stage is map(.children)
or works on descendants.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\|>|==|!=|>=|<=|&&|\|\||[()!<>,])|(\.[A-Za-z_][\w.]*)|\"((?:\\.|[^\"\\])*)\"|(-?\d+(?:\.\d+)?)|([A-Za-z_]\w*))")


@dataclass
class Node:
    """A node of a parsed query: its kind, its value and its parts."""

    kind: str
    value: str = ""
    parts: list[Node] = field(default_factory=list)

    def __str__(self) -> str:
        inner = ", ".join(map(str, self.parts))
        return f"{self.kind}({', '.join(x for x in (self.value, inner) if x)})"


def parse(text: str) -> Node:
    """The query as a tree; ValueError says where it is wrong."""
    found, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected character at {at}: {text[at:at + 10]!r}")
        op, path, string, number, word = m.groups()
        found.append(("op", op) if op else ("field", path[1:]) if path else ("lit", re.sub(r"\\(.)", r"\1", string)) if string is not None else ("num", number) if number else ("word", word))
        at = m.end()
    pos = 0

    def peek() -> tuple[str, str]:
        return found[pos] if pos < len(found) else ("end", "")

    def take(kind: str | None = None, value: str | None = None) -> str:
        nonlocal pos
        k, v = peek()
        if (kind and k != kind) or (value is not None and v != value):
            raise ValueError(f"expected {value or kind}, found {v or 'the end'}")
        pos += 1
        return v

    def either() -> Node:
        left = both()
        while peek() == ("op", "||"):
            take()
            left = Node("or", "", [left, both()])
        return left

    def both() -> Node:
        left = unary()
        while peek() == ("op", "&&"):
            take()
            left = Node("and", "", [left, unary()])
        return left

    def unary() -> Node:
        if peek() == ("op", "!"):
            take()
            return Node("not", "", [unary()])
        left = value()
        k, v = peek()
        if (k, v) == ("word", "has"):
            take()
            return Node("has", "", [left, value()])
        if k == "op" and v in ("==", "!=", ">", ">=", "<", "<="):
            take()
            return Node("compare", v, [left, value()])
        return left

    def value() -> Node:
        k, v = peek()
        if (k, v) == ("op", "("):
            take()
            inner = either()
            take("op", ")")
            return inner
        if k == "field":
            return Node("field", take())
        if k in ("lit", "num"):
            return Node("literal", take())
        if k == "word" and v in ("true", "false"):
            return Node("literal", take())
        raise ValueError(f"expected a value, found {v or 'the end'}")

    def stage() -> Node:
        k, v = peek()
        if k == "word" and v in ("filter", "rfilter", "map", "rmap", "reduce"):
            take()
            take("op", "(")
            inner = Node("call", take("word", "count")) if v == "reduce" else either()
            take("op", ")")
            return Node(v, "", [inner])
        return Node("map", "", [either()])

    stages = [stage()]
    while peek() == ("op", "|>"):
        take()
        stages.append(stage())
    take("end")
    return Node("pipeline", "", stages)


def _scalar(name: str) -> Column:
    plain = {"token": "token", "type": "type", "id": "node_id"}
    if name in plain:
        return F.col(plain[name]).cast("string")
    if name == "roles":
        return F.array_join("roles", ",")
    return F.col("props")[name[6:] if name.startswith("props.") else name]


def _column(n: Node) -> Column:
    if n.kind == "literal":
        return F.lit(n.value)
    if n.kind == "field":
        return _scalar(n.value)
    if n.kind == "not":
        return ~_truth(n.parts[0])
    if n.kind in ("and", "or"):
        a, b = map(_truth, n.parts)
        return a & b if n.kind == "and" else a | b
    if n.kind == "has":
        values = F.col("roles") if n.parts[0].value == "roles" else F.array(_column(n.parts[0]))
        return F.coalesce(F.array_contains(values, _column(n.parts[1])), F.lit(False))
    a, b = (_column(p) for p in n.parts)
    if n.value == "==":
        return F.coalesce(a == b, F.lit(False))
    if n.value == "!=":
        return F.coalesce(a != b, F.lit(True))
    x, y = a.try_cast("double"), b.try_cast("double")
    compare = {">": lambda p, q: p > q, ">=": lambda p, q: p >= q, "<": lambda p, q: p < q, "<=": lambda p, q: p <= q}[n.value]
    return F.coalesce(F.when(x.isNotNull() & y.isNotNull(), compare(x, y)).otherwise(compare(a, b)), F.lit(False))


def _truth(n: Node) -> Column:
    c = _column(n)
    return c if n.kind in ("not", "and", "or", "has", "compare") else F.coalesce(c == "true", F.lit(False))


def run(nodes: DataFrame, key: str, query: str) -> DataFrame:
    """The query over every file of a node table: rows of nodes, or (key, value) once a stage maps to values.

    Children meet their parents on (key, parent_id); descendants meet theirs inside a file.
    """
    stages = parse(query).parts
    shape = nodes.columns
    root = nodes.filter("parent_id is null")

    def children(rows: DataFrame) -> DataFrame:
        ids = rows.select(key, F.col("node_id").alias("parent_id")).distinct()
        return nodes.join(ids, [key, "parent_id"], "left_semi").select(shape)

    def below(rows: DataFrame) -> DataFrame:
        tops = rows.select(key, F.col("pre").alias("top_pre"), F.col("post").alias("top_post"))
        return nodes.join(tops, key).filter("pre >= top_pre and post <= top_post").select(shape).dropDuplicates([key, "node_id"])

    def mapped(rows: DataFrame, expr: Node) -> DataFrame:
        if "value" in rows.columns:
            return rows
        if expr.kind == "field" and expr.value.split(".")[0] == "children":
            inner = children(rows)
            rest = expr.value.partition(".")[2]
            return mapped(inner, Node("field", rest)) if rest else inner
        if expr.kind == "field" and expr.value in ("first", "last"):
            edge = F.min("child_idx") if expr.value == "first" else F.max("child_idx")
            inner = children(rows)
            best = inner.groupBy(key, "parent_id").agg(edge.alias("child_idx"))
            return inner.join(best, [key, "parent_id", "child_idx"], "left_semi").select(shape)
        if expr.kind == "field" and expr.value == "roles":
            return rows.select(key, F.explode("roles").alias("value"))
        return rows.select(key, _column(expr).cast("string").alias("value")).filter("value is not null")

    first = stages[0]
    starts_below = first.kind == "filter" or (len(stages) > 1 and first.kind == "map" and not str(first.parts[0]).startswith("field(children"))
    rows = children(root) if starts_below else root
    for stage in stages:
        if stage.kind == "filter":
            rows = rows.filter(_truth(stage.parts[0]))
        elif stage.kind == "rfilter":
            rows = below(rows).filter(_truth(stage.parts[0]))
        elif stage.kind == "map":
            rows = mapped(rows, stage.parts[0])
        elif stage.kind == "rmap":
            rows = mapped(below(rows), stage.parts[0])
        else:
            rows = rows.groupBy(key).agg(F.count("*").cast("string").alias("value"))
    return rows
