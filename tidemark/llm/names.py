"""Variant spellings of names: exact radius joins inside the cells of a metric space.

Every spelling gives a few keys, strings that two spellings of one name share up to typing errors:
given name and surname in either order, both written together, initial and surname. Keys are joined
by true edit distance. The space of a scope's keys is cut into cells around pivots; a key that lies
near a border is copied, by the triangle inequality, into every cell that can hold a key within the
radius, so each join is exact inside one cell. Links are then weighed, and weak ones (an initial or
a nickname may stand for several people) count only if they have one possible target.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.graph import components
from tidemark.session import settle

RADIUS = 2
#: A pivot serves about this many keys times the root of their number: cells and copies both grow slowly.
PIVOT_STEP = 8
#: Keys of a cell from which pairs must also share a part, so that a large cell is not met with itself whole.
CELL_MOST = 1000
#: Scopes in which a word must be part of a name before it counts as a name of its own, not a slip of another.
ESTABLISHED = 3
#: Largest table of nicknames that is sent to every executor.
NICKNAMES_MOST = 100_000
LEGAL = frozenset("inc ltd llc gmbh ab bv sa ag co corp oy as plc srl kg nv pty limited incorporated corporation company sarl spa".split())
_LETTERS = str.maketrans({"ø": "o", "ł": "l", "ß": "ss", "æ": "ae", "đ": "d", "ð": "d", "ı": "i", "þ": "th", "œ": "oe"})


def fold(text: str) -> str:
    """Lower case without accents."""
    flat = unicodedata.normalize("NFKD", text.lower().translate(_LETTERS))
    return "".join(c for c in flat if not unicodedata.combining(c))


def _plain(token: str) -> str:
    return re.sub(r"[^\w]|_", "", token)


def readings(name: str) -> list[tuple[str, str, str]]:
    """(kind, given or initial, surname) a name can be read as; kinds: full, initial, handle, org. The middle initial is `middle`."""
    bare = re.sub(r"\([^)]*\)", " ", name).strip()
    if not bare:
        return []
    words = fold(bare).replace(",", " , ").split()
    legal = [w for w in words if w.replace(".", "") in LEGAL and len(w.replace(".", "")) > 1]
    if legal or (len(words) > 2 and words[0] == "the" and words[-1] == "team"):
        core = [_plain(w) for w in words if w not in legal and w not in ("the", "team", ",")]
        return [("org", core[0], "".join(core[1:]))] if core else []
    if "," in words:
        at = words.index(",")
        last, first = "".join(map(_plain, words[:at])), [_plain(w) for w in words[at + 1 :] if _plain(w)]
        if not first:
            return [("handle", "", last)]
        return [("initial" if len(first[0]) == 1 else "full", first[0], last)]
    tokens = bare.split()
    if len(tokens) == 1:
        split = re.split(r"[._]|(?<=[a-zß-ɏ])(?=[A-ZÀ-Þ])", bare)
        if len(split) == 1 and "-" in bare and bare.islower():
            head, _, tail = fold(bare).partition("-")
            return [("either", head, _plain(tail)), ("handle", "", _plain(fold(bare)))]
        tokens = split
    clean = [t for t in (_plain(fold(t)) for t in tokens) if t]
    if not clean:
        return []
    if len(clean) == 1:
        return [("handle", "", clean[0])]
    if len(clean[0]) == 1:
        return [("initial", clean[0], "".join(t for t in clean[1:] if len(t) > 1))]
    rest = [t for t in clean[1:] if len(t) > 1]
    if not rest:
        return [("initial", clean[1], clean[0])]
    return [("either" if len(clean) == 2 else "full", clean[0], "".join(rest))]


def middle(name: str) -> str:
    """The middle initial, or ''."""
    tokens = [_plain(fold(t)) for t in re.sub(r"\([^)]*\)", " ", name).replace(",", " , ").split()]
    if "" in tokens:
        tokens = [t for t in tokens[tokens.index("") + 1 :] if t]
        return tokens[1] if len(tokens) > 1 and len(tokens[1]) == 1 else ""
    return tokens[1] if len(tokens) == 3 and len(tokens[1]) == 1 else ""


def keys(name: str, formal: dict[str, list[str]]) -> list[tuple[str, str, str, bool]]:
    """(space, key, level, weak) of a name. formal gives the given names behind a nickname.

    Spaces: F words in alphabetical order, J written together, I initial and surname. Weak keys come
    from what a nickname may stand for.
    """
    out: set[tuple[str, str, str, bool]] = set()
    for kind, given, last in readings(name):
        if kind == "org":
            # a line of business is often cut short: Net., Softw.
            out |= {("J", given + last[:n], "handle", False) for n in (3, 4, 5, len(last))}
            continue
        if kind == "handle":
            out |= {("J", last, "handle", False), ("I", last, "handle", False)}
            continue
        if kind == "initial":
            out.add(("I", given + last, "initial", False))
            continue
        for g, s in ((given, last), (last, given)) if kind == "either" else ((given, last),):
            out |= {("F", " ".join(sorted((g, s))), "full", False), ("J", g + s, "full", False), ("I", g[0] + s, "full", False)}
            for other in formal.get(g, ()):
                out |= {("F", " ".join(sorted((other, s))), "full", True), ("J", other + s, "full", True), ("I", other[0] + s, "full", True)}
    return [k for k in out if len(k[1]) >= 3]


def near_keys(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(scope, space, a, b, d): pairs of keys a < b of rows (scope, space, key) within the radius.

    Exact: let p be the pivot nearest to a. A key b within the radius is at most d(a, p) + radius
    from p, and its own nearest pivot at least d(b, p) - 2 * radius; so copying b to all pivots
    within 2 * radius of its nearest meets a in a's cell.
    """
    key = ["scope", "space"]
    sizes = distinct.groupBy(*key).agg(F.greatest(F.lit(1), F.floor(F.sqrt(F.count("*")) / PIVOT_STEP)).alias("k"))
    order = F.row_number().over(Window.partitionBy(*key).orderBy("h", "key"))
    # candidates for pivots: the keys of smallest hash, picked without sorting a whole scope
    sampled = distinct.withColumn("h", F.xxhash64("key")).join(sizes, key)
    count = F.count("*").over(Window.partitionBy(*key))
    share = F.pmod("h", F.lit(1 << 30)) <= F.lit(float(1 << 30)) * F.least(F.lit(1.0), F.lit(3.0 * PIVOT_STEP * PIVOT_STEP) / F.greatest(F.col("k") * PIVOT_STEP * PIVOT_STEP, F.lit(1)) + F.when(F.col("k") <= 8, 1.0).otherwise(0.0))
    pivots = sampled.filter(share).withColumn("rank", order).filter(F.col("rank") <= F.col("k")).select(*key, F.col("key").alias("pivot"))
    measured = distinct.join(pivots, key).withColumn("far", F.levenshtein("key", "pivot"))
    home = F.min(F.struct("far", "pivot")).over(Window.partitionBy(*key, "key"))
    cells = measured.withColumn("home", home).filter(F.col("far") <= F.col("home.far") + 2 * radius)
    cells = cells.select(*key, "pivot", "key", "far", (F.col("home.pivot") == F.col("pivot")).alias("own"), F.length("key").alias("n"))
    cells = settle(cells)
    sizes_of = cells.groupBy(*key, "pivot").agg(F.count("*").alias("m"))
    big = sizes_of.filter(F.col("m") > CELL_MOST).select(*key, "pivot")
    x = lambda c: c.filter("own").select(*key, "pivot", F.col("key").alias("x"), F.col("far").alias("xf"), F.col("n").alias("xn"))
    y = lambda c: c.select(*key, "pivot", F.col("key").alias("y"), F.col("far").alias("yf"), F.col("n").alias("yn"))
    # lengths and the distances to the shared pivot bound the distance before it is computed
    close = (F.col("x") != F.col("y")) & (F.abs(F.col("xn") - F.col("yn")) <= radius) & (F.abs(F.col("xf") - F.col("yf")) <= radius)
    small = cells.join(big, [*key, "pivot"], "left_anti")
    met = x(small).join(y(small), [*key, "pivot"]).filter(close).select(*key, "x", "y")
    # in a large cell two keys must also share one of radius + 1 parts, as edits leave one whole
    large = cells.join(big, [*key, "pivot"], "left_semi")
    parts = radius + 1
    size = lambda n, i: f"({n} div {parts} + if({i} >= {parts} - {n} % {parts}, 1, 0))"
    start = lambda n, i: f"({i} * ({n} div {parts}) + greatest(0, {i} - ({parts} - {n} % {parts})))"
    every = f"sequence(0, {radius})"
    own = F.expr(f"transform({every}, i -> struct(xn as ln, i as no, substring(x, {start('xn', 'i')} + 1, {size('xn', 'i')}) as part))")
    shift = f"sequence(-{radius}, {radius})"
    offered = F.expr(
        f"array_distinct(flatten(flatten(transform(filter({shift}, e -> yn + e >= 1), e -> transform({every}, i -> transform("
        f"filter({shift}, s -> {start('(yn + e)', 'i')} + s >= 0 and {start('(yn + e)', 'i')} + s + {size('(yn + e)', 'i')} <= yn), "
        f"s -> struct(yn + e as ln, i as no, substring(y, {start('(yn + e)', 'i')} + s + 1, {size('(yn + e)', 'i')}) as part)))))))"
    )
    lx, ly = x(large).select("*", F.inline(own)), y(large).select("*", F.inline(offered))
    met = met.unionByName(lx.join(ly, [*key, "pivot", "ln", "no", "part"]).filter(close).select(*key, "x", "y").distinct())
    met = met.withColumn("d", F.levenshtein("x", "y", radius)).filter("d >= 0")
    return met.select(*key, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "d").distinct()


def link_names(records: DataFrame, nicknames: DataFrame, sure: DataFrame | None = None) -> DataFrame:
    """(id, scope, entity): records (id, scope, name, email) with the smallest id of the same entity in the scope.

    Strong links: equal or nearly equal keys of full names, of names written together, of initials
    with compatible middle initials; sure, if given, holds further links (a, b). Two given names that
    are both established elsewhere are no slips of each other. Weak links: an initial, a handle of
    initial and surname, or a nickname with the full names it fits; they count if they lead to one
    entity, or to one with an e-mail address in common. Null and blank names link to nothing; rows
    with null id or scope are left out; equal names in a scope are one entity; empty tables give no rows.
    """
    if nicknames.count() > NICKNAMES_MOST:
        raise ValueError("the table of nicknames is larger than what may be sent to every executor")
    formal: dict[str, list[str]] = {}
    for r in nicknames.dropna().distinct().collect():
        formal.setdefault(fold(r[0]), []).append(fold(r[1]))
    rows = settle(records.filter("id is not null and scope is not null").select("id", "scope", F.coalesce("name", F.lit("")).alias("name"), "email"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(s, n, middle(n), *k) for s, n in zip(batch["scope"], batch["name"]) for k in keys(n, formal)]
            yield pd.DataFrame(out, columns=["scope", "name", "middle", "space", "key", "level", "weak"])

    spellings = rows.select("scope", "name").distinct()
    schema = f"scope {rows.schema['scope'].dataType.simpleString()}, name string, middle string, space string, key string, level string, weak boolean"
    keyed = settle(spellings.mapInPandas(read, schema))
    # equal keys are at distance 0; near ones come from the cells
    distinct = settle(keyed.select("scope", "space", "key").distinct())
    near = near_keys(distinct)
    same = distinct.select("scope", "space", F.col("key").alias("a"), F.col("key").alias("b"), F.lit(0).alias("d"))
    pairs = same.unionByName(near).unionByName(near.select("scope", "space", F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    short = F.least(F.length("a"), F.length("b"))
    allowed = F.when(F.col("space") == "F", F.when(short >= 9, 2).otherwise(1)).when(short >= 9, F.when(F.col("space") == "I", 2).otherwise(1)).when(short >= 6, 1).otherwise(0)
    pairs = pairs.filter(F.col("d") <= allowed)
    pairs = pairs.filter((F.col("space") != "I") | (F.substring("a", 1, 1) == F.substring("b", 1, 1)))
    x = keyed.select("scope", "space", F.col("key").alias("a"), F.col("name").alias("nx"), F.col("middle").alias("mx"), F.col("level").alias("lx"), F.col("weak").alias("wx"))
    y = keyed.select("scope", "space", F.col("key").alias("b"), F.col("name").alias("ny"), F.col("middle").alias("my"), F.col("level").alias("ly"), F.col("weak").alias("wy"))
    met = pairs.join(x, ["scope", "space", "a"]).join(y, ["scope", "space", "b"]).filter("nx <> ny and not (wx and wy)")
    met = met.filter("lx <> 'full' or ly <> 'full' or space = 'F'")
    middles = (F.col("mx") == "") | (F.col("my") == "") | (F.col("mx") == F.col("my"))
    initials = (F.col("space") == "I") & ((F.col("lx") == "full") != (F.col("ly") == "full"))
    graded = met.filter(middles).withColumn("weak", F.col("wx") | F.col("wy") | initials)
    # which words differ, and are both of them established names?
    pa, pb = F.split("a", " "), F.split("b", " ")
    other = F.when(pa[0] == pb[0], F.struct(pa[1].alias("p"), pb[1].alias("q"))).when(pa[1] == pb[1], F.struct(pa[0].alias("p"), pb[0].alias("q")))
    graded = graded.withColumn("differ", F.when((F.col("space") == "F") & (F.col("d") > 0), other))
    words = keyed.filter("space = 'F' and not weak").select("scope", F.explode(F.split("key", " ")).alias("word")).distinct()
    known = words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= ESTABLISHED).select("word")
    graded = graded.join(known.select(F.col("word").alias("p1"), F.lit(True).alias("kp")), F.col("differ.p") == F.col("p1"), "left")
    graded = graded.join(known.select(F.col("word").alias("q1"), F.lit(True).alias("kq")), F.col("differ.q") == F.col("q1"), "left")
    graded = settle(graded.filter("kp is null or kq is null").select("scope", "nx", "ny", "weak", initials.alias("initial"), (F.col("wx") | (F.col("lx") != "full")).alias("vague_x")))
    # a name stands for its smallest record; equal spellings in a scope are one entity
    heads = settle(rows.filter(F.trim("name") != "").groupBy("scope", "name").agg(F.min("id").alias("head")))
    members = rows.join(heads, ["scope", "name"], "left").select("id", "scope", "email", F.coalesce("head", "id").alias("head"))
    hx, hy = heads.select("scope", F.col("name").alias("nx"), F.col("head").alias("a")), heads.select("scope", F.col("name").alias("ny"), F.col("head").alias("b"))
    linked = settle(graded.join(hx, ["scope", "nx"]).join(hy, ["scope", "ny"]).select("scope", "a", "b", "weak", "initial", "vague_x"))
    strong = linked.filter("not weak").select("a", "b")
    if sure is not None:
        ends = members.select(F.col("id"), "head")
        more = sure.join(ends.select(F.col("id").alias("a"), F.col("head").alias("ha")), "a").join(ends.select(F.col("id").alias("b"), F.col("head").alias("hb")), "b")
        strong = strong.unionByName(more.select(F.col("ha").alias("a"), F.col("hb").alias("b")))
    nodes = members.select(F.col("head").alias("id")).distinct()
    whole = settle(components(nodes, strong))
    # nicknames first: what they are joined to may be the one entity that an initial leads to
    for initial in (False, True):
        la, lb = whole.select(F.col("id").alias("a"), F.col("label").alias("ca")), whole.select(F.col("id").alias("b"), F.col("label").alias("cb"))
        loose = linked.filter("weak and vague_x").filter(F.col("initial") == initial).join(la, "a").join(lb, "b").filter("ca <> cb").select("ca", "cb").distinct()
        mail = members.filter("email is not null").join(whole.withColumnRenamed("id", "head"), "head").select("label", F.lower("email").alias("email"))
        ends = mail.distinct().withColumnRenamed("label", "ca"), mail.distinct().select("email", F.col("label").alias("cb"))
        # only for the linked, never all holders of one address with each other
        shared = loose.join(ends[0], "ca").join(ends[1], ["cb", "email"]).select("ca", "cb", F.lit(1).alias("mail")).distinct()
        graded_loose = loose.join(shared, ["ca", "cb"], "left")
        targets = graded_loose.groupBy("ca").agg(F.count("*").alias("n"), F.count("mail").alias("m"))
        sound = graded_loose.join(targets, "ca").filter("n = 1 or (m = 1 and mail = 1)").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        merged = components(whole.select(F.col("label").alias("id")).distinct(), sound).select(F.col("id").alias("label"), F.col("label").alias("entity"))
        whole = settle(whole.join(merged, "label").select("id", F.col("entity").alias("label")))
    return members.join(whole.select(F.col("id").alias("head"), F.col("label").alias("entity")), "head").select("id", "scope", "entity")


def pairs_of(linked: DataFrame) -> DataFrame:
    """(scope, id_a, id_b), id_a < id_b: all pairs of records of an entity."""
    groups = linked.select("scope", "entity", "id")
    a, b = groups.withColumnRenamed("id", "id_a"), groups.withColumnRenamed("id", "id_b")
    return a.join(b, ["scope", "entity"]).filter("id_a < id_b").select("scope", "id_a", "id_b")
