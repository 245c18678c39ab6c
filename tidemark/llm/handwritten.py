"""Files that nobody wrote by hand: generated, minified, third-party copies, data saved as code.

Merkle hashes go bottom-up over every state of every path, whatever else is known of it: a file is
hashed without comments and layout, a directory is the hash of its files and directories, level by
level from the deepest. A subtree, be it one file, that three or more repositories share was taken
over from outside; so was a directory of which half are such subtrees, with the files in it that were
edited since, and a file of which half the blocks stand in three repositories. Header, layout and
place are judged per file beside that.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import settle

#: Repositories that must hold a block, file or directory before it counts as taken over.
SHARED_BY = 3
#: Characters, without layout, under which a block says nothing about where it came from.
BLOCK_LEAST = 80
#: Share of a file's blocks (by length), or of a directory's entries, that must be taken over.
TAKEN_SHARE = 0.5
_PLACES = re.compile(r"(?:^|/)(?:vendor|vendors|third[_-]?party|3rd[_-]?party|node_modules|bower_components|external|externals|deps|Godeps|_workspace|site-packages|generated-sources|generated_src|__generated__)/", re.I)
_NAMES = re.compile(
    r"(?:[._-]min\.(?:js|css)|[._-]bundle\.js|\.generated\.\w+|\.gen\.\w+|\.g\.\w+|\.pb(?:\.\w+)*\.\w+|_pb2?(?:_grpc)?\.\w+|_pb2_grpc\.py|\.tab\.[ch]|\.yy\.[ch]|\.lex\.[ch]|_parsetab\.py|_lextab\.py|_string\.go|[._-]lock\.json|-lock\.json|npm-shrinkwrap\.json)$",
    re.I,
)
_COMMENT = re.compile(r"^\s*(?://+|#+(?!\s*(?:include|define|if|ifdef|ifndef|pragma)\b)|/\*+!?|\*+|\"{3}|'{3}|<!--|--)\s*(.*)$")
_GENERATED = re.compile(
    r"(?:code generated by\b.*\bdo not edit|@generated\b|auto[- ]?generated (?:file|code|from|by)\b|<auto-generated|(?:this|the) file (?:was|is|has been) (?:automatically |auto-?)?(?:generated|produced|created|written) by\b"
    r"|machine[- ](?:written|generated|made) by the\b|do not (?:edit|modify)\b\W{1,4}\s*(?:generated|written|produced) by\b|generated (?:code|file)\s*(?:--|—|:|,)"
    r"|(?:generated|compiled|created|built|produced) (?:automatically )?(?:by|from) \S+ (?:with|by|using|from) \S+)",
    re.I,
)
_THIRD = re.compile(r"(?:^\S+ v?\d+(?:\.\d+)+\S*, (?:imported|copied|taken|vendored) from upstream|^part of the \S+ project\b.*\blicen[cs]e|^(?:vendored|copied|imported|taken) from (?:https?:|upstream|the \S+ project))", re.I)
_AUTHORS = re.compile(r"^copyright (?:\(c\) )?\d{4}(?:-\d{4})? the \S+ authors\b", re.I)
_LICENSED = re.compile(r"^licensed under\b", re.I)
_STRIP = re.compile(r"//[^\n]*|/\*.*?\*/|#(?!\s*(?:include|define|if|ifdef|ifndef|endif|else|pragma))[^\n]*|\"\"\".*?\"\"\"|'''.*?'''", re.S)
_LITERALS = re.compile(r"0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?|\"[A-Za-z0-9+/=]{40,}\"|'[A-Za-z0-9+/=]{40,}'|(?:\\x[0-9a-fA-F]{2}){4,}")
_LETTERS = re.compile(r"[A-Za-z_]{2,}")


#: Lines at the top whose comments count as the file's own even behind code.
TOP = 14


def header_says(text: str) -> str | None:
    """'generated' or 'third-party' if the comments that open the file, however long, say so of the file itself."""
    licence = inside = False
    opening = True
    for i, line in enumerate(text.lstrip("\ufeff").split("\n")):
        if not opening and i >= TOP:
            break
        m = _COMMENT.match(line)
        bare = line.strip()
        if inside:
            inside = "*/" not in bare
        elif not m and bare:
            opening = False
        elif bare.startswith("/*"):
            inside = "*/" not in bare
        if not m:
            continue
        said = m[1].strip()
        if _GENERATED.match(said):
            return "generated"
        if _THIRD.search(said):
            return "third-party"
        if _AUTHORS.match(said):
            licence = True
        elif licence and _LICENSED.match(said):
            return "third-party"
    return None


def looks_minified(text: str) -> bool:
    """Long lines, hardly any white space and names of one or two letters."""
    body = _STRIP.sub("", text) if text.count("\n") > 20 else text
    lines = [x for x in body.split("\n") if x.strip()]
    if len(body) < 100 or not lines:
        return False
    longest = max(map(len, lines))
    mean = len(body) / len(lines)
    blank = sum(map(body.count, " \t\n")) / len(body)
    names = re.findall(r"[A-Za-z_$][\w$]*", re.sub(r"\"[^\"\n]*\"|'[^'\n]*'", "", body))
    short = sum(len(n) <= 2 for n in names) / max(1, len(names))
    return (mean > 120 and longest > 200 and blank < 0.12 and short > 0.35) or (longest > 100 and blank < 0.1 and short > 0.6) or (mean > 400 and blank < 0.1)


def looks_like_data(text: str, code: bool) -> bool:
    """Nearly all literals: tables of numbers, encoded bytes."""
    if len(text) < 400:
        return False
    body = _STRIP.sub("", text) if code else text
    solid = len(re.sub(r"\s", "", body))
    if solid < 300:
        return False
    found = _LITERALS.findall(body)
    literal = sum(map(len, found))
    share = literal / solid
    commas = body.count(",")
    return (share > 0.5 and len(found) >= 40) or (share + commas / solid > 0.72 and len(found) >= 40) or (share > 0.6)


def judge(path: str | None, text: str | None) -> tuple[str | None, str | None]:
    """(reason, rule): why a file with this path and text is not hand-written and by which rule, or None."""
    path = path or ""
    if _PLACES.search(path):
        return "generated" if "generated" in path.lower() else "third-party", "place"
    if text is None or len(text.strip()) < 20:
        return None, None
    if _NAMES.search(path):
        return "minified" if re.search(r"min\.|bundle", path) else "generated", "name"
    said = header_says(text)
    if said:
        return said, "header"
    code = not path.endswith(".json")
    if code and looks_minified(text):
        return "minified", "layout"
    return ("data", "layout") if looks_like_data(text, code) else (None, None)


def judge_side(path: str | None, text: str | None) -> str | None:
    """Why a file with this path and text is not hand-written, or None."""
    return judge(path, text)[0]


def _digest(solid: str) -> str:
    return hashlib.blake2b(solid.encode("utf-8", "replace"), digest_size=8).hexdigest()


def file_hash(text: str) -> str | None:
    """Hash of a file without comments, layout and line ends; None if too little is left to tell where it came from."""
    solid = re.sub(r"\s+", "", _STRIP.sub("", text))
    return _digest(solid) if len(solid) >= BLOCK_LEAST else None


def blocks(text: str) -> list[tuple[str, int]]:
    """(hash, length) of the blocks of a text: what blank lines part, without comments, layout and line ends."""
    out = []
    for part in re.split(r"\n[ \t]*\n", _STRIP.sub("", text.replace("\r\n", "\n"))):
        solid = re.sub(r"\s+", "", part)
        if len(solid) >= BLOCK_LEAST:
            out.append((_digest(solid), len(solid)))
    return out


def _sides(changes: DataFrame) -> DataFrame:
    """(change_id, repo_id, side, path, reason, rule, hash, blocks) per side with a text or path."""

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for cid, repo, fp, tp, before, after in zip(*(batch[c] for c in ("change_id", "repo_id", "from_path", "to_path", "before_text", "after_text"))):
                for side, path, text in (("before", fp, before), ("after", tp, after)):
                    if path is not None or text is not None:
                        rows.append((cid, repo, side, path, *judge(path, text), file_hash(text or ""), [{"hash": h, "size": n} for h, n in blocks(text or "")]))
            yield pd.DataFrame(rows, columns=["change_id", "repo_id", "side", "path", "reason", "rule", "hash", "blocks"])

    schema = f"change_id {changes.schema['change_id'].dataType.simpleString()}, repo_id {changes.schema['repo_id'].dataType.simpleString()}, side string, path string, reason string, rule string, hash string, blocks array<struct<hash: string, size: int>>"
    return changes.select("change_id", "repo_id", "from_path", "to_path", "before_text", "after_text").mapInPandas(judged, schema)


def _held(rows: DataFrame) -> DataFrame:
    """(hash): what SHARED_BY repositories hold. A repository that holds one a million times counts it once, before the shuffle."""
    return rows.filter("repo_id is not null and hash is not null").select("hash", "repo_id").distinct().groupBy("hash").agg(F.count("*").alias("n")).filter(F.col("n") >= SHARED_BY).select("hash")


def shared_subtrees(leaves: DataFrame) -> DataFrame:
    """(repo_id, path) of the files below a directory that was taken over.

    leaves: (repo_id, path, hash), one row per file; hash may be null. Hashes go up one level at a
    time, from the deepest directory there is: a directory's hash is that of the set of its entries'
    hashes, whatever they are called. Taken over is a directory of two or more files whose hash
    SHARED_BY repositories have, or of whose entries, two at least, a share of TAKEN_SHARE have such a hash.
    """
    depth = F.size(F.split("path", "/"))
    nodes = settle(leaves.select("repo_id", "path", "hash", F.lit(1).cast("long").alias("files"), depth.alias("depth")))
    parent = F.regexp_replace("path", "/[^/]*$", "")
    every, level = [nodes], nodes
    for d in range(nodes.agg(F.max("depth")).first()[0] or 0, 1, -1):
        # of the set of entries, not their list: it is added up before the shuffle, however many there are
        both = [F.hex(F.bit_xor(F.xxhash64(F.coalesce("hash", F.lit("")), F.lit(salt)))) for salt in (1, 2)]
        up = level.filter(F.col("depth") == d).groupBy("repo_id", parent.alias("dir")).agg(F.concat_ws(".", *both, F.count("*")).alias("hash"), F.sum("files").alias("files"))
        up = settle(up.select("repo_id", F.col("dir").alias("path"), "hash", "files", F.lit(d - 1).alias("depth")))
        every.append(up)
        level = level.filter(F.col("depth") < d).unionByName(up)
    whole = every[0]
    for other in every[1:]:
        whole = whole.unionByName(other)
    held = settle(_held(whole.filter("files >= 2").unionByName(nodes)))
    known = whole.join(held.withColumn("taken", F.lit(1)), "hash", "left")
    exact = known.filter("taken = 1 and files >= 2").select("repo_id", F.col("path").alias("dir"))
    entries = known.filter("depth > 1").groupBy("repo_id", parent.alias("dir")).agg(F.count("*").alias("n"), F.count("taken").alias("m"))
    mostly = entries.filter((F.col("m") >= 2) & (F.col("m") >= TAKEN_SHARE * F.col("n"))).select("repo_id", "dir")
    tops = exact.unionByName(mostly).distinct()
    # every ancestor of a file is an equality to meet, never a range
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return nodes.select("repo_id", "path", F.explode(above).alias("dir")).join(tops, ["repo_id", "dir"], "left_semi").select("repo_id", "path").distinct()


def evidence(changes: DataFrame) -> DataFrame:
    """(change_id, reason, rule): each rule by which a change's file is not hand-written, each once.

    Rules: file and directory (shared subtrees), blocks (shared parts), place, name, header, layout.
    """
    sides = settle(_sides(changes))
    plain = sides.filter("reason is not null").select("change_id", "reason", "rule")
    here = sides.filter("repo_id is not null")
    files = sides.join(_held(here), "hash", "left_semi").select("change_id", F.lit("file").alias("rule"))
    # the last state of each path stands in its directory
    last = here.filter("path is not null").groupBy("repo_id", "path").agg(F.max_by(F.struct("hash"), F.struct("change_id", "side")).alias("r")).select("repo_id", "path", "r.hash")
    below = here.filter("size(blocks) > 0").join(shared_subtrees(last), ["repo_id", "path"], "left_semi").select("change_id", F.lit("directory").alias("rule"))
    parts = sides.filter("size(blocks) > 0").select("change_id", "side", "repo_id", F.inline("blocks"))
    sized = parts.join(_held(parts).withColumn("taken", F.lit(1)), "hash", "left").groupBy("change_id", "side")
    sized = sized.agg(F.sum("size").alias("whole"), F.sum(F.when(F.col("taken") == 1, F.col("size"))).alias("part"))
    copies = sized.filter(F.col("part") >= TAKEN_SHARE * F.col("whole")).select("change_id", F.lit("blocks").alias("rule"))
    taken = files.unionByName(below).unionByName(copies).select("change_id", F.lit("third-party").alias("reason"), "rule")
    return plain.unionByName(taken).distinct()


def not_handwritten(changes: DataFrame) -> DataFrame:
    """(change_id, reason) of the changes whose file is not hand-written, each once.

    changes: (change_id, repo_id, from_path, to_path, before_text, after_text). Reasons in this order:
    generated, minified, third-party, data. Either side decides. Null paths and texts say nothing;
    empty and trivial texts are hand-written unless their place says otherwise; repeated rows and
    ids give one row; an empty table none.
    """
    order = F.when(F.col("reason") == "generated", 0).when(F.col("reason") == "minified", 1).when(F.col("reason") == "third-party", 2).otherwise(3)
    return evidence(changes).groupBy("change_id").agg(F.min_by("reason", order).alias("reason"))
