"""Evaluation texts in a training corpus: a prefix-filtered set join on rare word shingles.

A passage of WORDS words of which EDITS may be changed, added or missing keeps, by the pigeonhole
principle, at least KEPT of its WORDS - 2 shingles of three words. So of each window of an item only
the WORDS - 2 - KEPT + 1 rarest shingles need to be joined; pairs that pass are narrowed by position
and verified exactly against every window of the item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import settle

WORDS, EDITS, SHINGLE = 15, 3, 3
#: Words of its own that mark a passage as no frame; a word is an item's own if at most so many item texts have it, however many items there are.
RARE, OWN_TEXTS = 2, 3
KEPT = WORDS - SHINGLE + 1 - EDITS * SHINGLE
#: Distinct shingles of the items up to which they are sent to every executor (16 MB); beyond, both sides are shuffled.
SENT = 1_000_000
#: Numbers that document keys are hashed to, so that candidates can be told before the shuffle by a table of a fixed size.
MARKS = 1 << 20
_CUT = r"[^\p{L}\p{N}_]+"
#: A word divided at the end of a line, with the marks that may open the next one.
_DIVIDED = r"(\p{L})-[ \t]*\r?\n[ \t>*#/|]*(\p{L})"


def worded(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, words): lower-case words of each text; case, punctuation and layout are gone."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.col(text)), _DIVIDED, "$1$2"), _CUT, " "))
    return df.select(key, F.split(flat, " ").alias("words")).filter(F.col(key).isNotNull() & F.col("words").isNotNull())


def _shingled(rows: DataFrame, key: str) -> DataFrame:
    """(key, pos, h) for each shingle of rows (key, words)."""
    enough = rows.filter(F.size("words") >= SHINGLE)
    hashes = F.expr(f"transform(slice(words, 1, size(words) - {SHINGLE - 1}), (w, i) -> xxhash64({', '.join(f'words[i + {k}]' for k in range(SHINGLE))}))")
    return enough.select(key, F.posexplode(hashes).alias("pos", "h"))


def window_edits(item: list[str], words: list[str]) -> np.ndarray:
    """For each WORDS successive words of the item the fewest edits to any run of words, both ends equal.

    All windows advance together over the words; a window's column is closed under skipped item
    words by a running minimum. Windows that match nowhere have 10 * WORDS.
    """
    big = 10 * WORDS
    if len(item) < WORDS or not words:
        return np.full(max(0, len(item) - WORDS + 1), big)
    codes: dict[str, int] = {}
    windows = np.lib.stride_tricks.sliding_window_view(np.array([codes.setdefault(w, len(codes)) for w in item]), WORDS)
    steps = np.arange(WORDS)
    state = np.full(windows.shape, big)
    best = np.full(len(windows), big)
    for code in (codes.get(w, -1) for w in words):
        same = windows == code
        # the last word must be equal, not skipped
        best = np.minimum(best, np.where(same[:, -1], state[:, -2], big))
        base = np.full(windows.shape, big)
        base[:, 0] = np.where(same[:, 0], 0, big)  # and a window opens only on its first word
        base[:, 1:] = state[:, :-1] + ~same[:, 1:]
        base = np.minimum(base, state + 1)
        state = np.minimum(np.minimum.accumulate(base - steps, axis=1) + steps, big)
    return best


def _lone(texts: DataFrame, n: int, name: str) -> DataFrame:
    """(words, name): for each n successive words of a text, whether no other text has them."""
    runs = F.expr(f"transform(sequence(1, size(words) - {n - 1}), i -> xxhash64(slice(words, i, {n})))")
    each = texts.filter(F.size("words") >= n).select("words", F.posexplode(runs).alias("pos", "h"))
    spread = each.groupBy("h").agg(F.count_distinct("words").alias("texts"))
    placed = each.join(spread, "h").groupBy("words").agg(F.sort_array(F.collect_list(F.struct("pos", (F.col("texts") == 1).alias("lone")))).alias("p"))
    return placed.select("words", F.transform("p", lambda x: x["lone"]).alias(name))


def passage(item: list[str], words: list[str], rare: set[str], window_lone: list[bool], shingle_lone: list[bool]) -> int | None:
    """Edits of the best passage, or None if there is none.

    A passage has at most EDITS edits and is no frame that several items share, filled with other
    names: it is whole and no other item text has it, or it still holds RARE of its item's own words
    or KEPT shingles that no other item text has.
    """
    held = rare.intersection(words)
    own = np.array([w in held for w in item])
    edits = window_edits(item, words)
    if not len(edits):
        return None
    names = np.convolve(own, np.ones(WORDS, int), "valid")
    there = set(zip(*(words[k:] for k in range(SHINGLE))))
    held_lone = np.array([bool(one) and t in there for one, t in zip(shingle_lone, zip(*(item[k:] for k in range(SHINGLE))))])
    shingles = np.convolve(held_lone, np.ones(WORDS - SHINGLE + 1, int), "valid")
    whole = (edits == 0) & np.array(window_lone, bool)
    good = edits[(edits <= EDITS) & (whole | (names >= RARE) | (shingles >= KEPT))]
    return int(good.min()) if len(good) else None


def leaks(documents: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """(doc_key, item_key, edits): documents that hold a passage of WORDS words of an item with at most EDITS edits.

    Each pair once. Items under WORDS words, null keys, null and empty texts match nothing; repeated
    rows and equal texts under several keys give a pair for each key; empty tables give no rows.
    """
    docs = worded(documents, doc_key, doc_text)
    wanted = worded(items, item_key, item_text).distinct()
    shingles = settle(_shingled(wanted, item_key))
    hashes = shingles.select("h").distinct()
    known = hashes.count()
    near = F.broadcast(hashes) if known <= SENT else hashes
    # one pass over the corpus: only shingles that some item has go on
    hits = settle(_shingled(docs, doc_key).join(near, "h", "left_semi"))
    rarity = hits.groupBy("h").agg(F.count_distinct(doc_key).alias("df"))
    rated = shingles.join(rarity, "h", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    # a shingle is needed if it is among the rarest of any window that holds it
    starts = F.sequence(F.greatest(F.lit(0), F.col("pos") - (WORDS - SHINGLE)), F.col("pos"))
    windows = rated.withColumn("start", F.explode(starts))
    rank = F.row_number().over(Window.partitionBy(item_key, "start").orderBy("df", "h", "pos"))
    prefix = windows.withColumn("rank", rank).filter(F.col("rank") <= WORDS - SHINGLE + 1 - KEPT + 1).select(item_key, "h").distinct()
    candidates = hits.join(prefix, "h").select(doc_key, item_key).distinct()
    # position: the kept shingles of a passage lie within EDITS of one diagonal
    # candidates first: a shingle of many documents and many items never meets itself on both sides
    places = candidates.join(hits, doc_key).join(shingles.withColumnRenamed("pos", "at"), [item_key, "h"])
    band = F.floor((F.col("pos") - F.col("at")) / (2 * EDITS + 2))
    banded = places.select(doc_key, item_key, "pos", "at", F.explode(F.array(band, band + 1)).alias("band"))
    dense = banded.groupBy(doc_key, item_key, "band").agg(F.count_distinct("at").alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi")).filter(F.col("n") >= KEPT)
    spans = settle(dense.select(doc_key, item_key, "lo", "hi").distinct())
    # only documents that may have a candidate's key are cut into words again and shuffled; the join is exact
    mark = F.pmod(F.xxhash64(doc_key), F.lit(MARKS)).alias("mark")
    marks = F.broadcast(spans.select(mark).distinct())
    again = worded(documents.select(doc_key, doc_text).join(marks, mark == marks["mark"], "left_semi"), doc_key, doc_text)
    parts = spans.join(again, doc_key).select(
        doc_key, item_key, F.expr(f"slice(words, greatest(1, lo + 1 - {WORDS + EDITS}), hi - lo + {SHINGLE + 2 * (WORDS + EDITS)})").alias("part")
    )
    # equal texts under several keys are one text: what they hold is their own all the same
    texts = settle(wanted.select("words").distinct())
    used = texts.select("words", F.explode(F.array_distinct("words")).alias("word"))
    few = used.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") <= OWN_TEXTS).select("word")
    own = used.join(few, "word").groupBy("words").agg(F.collect_list("word").alias("own"))
    rated_texts = texts.join(_lone(texts, WORDS, "window_lone"), "words").join(_lone(texts, SHINGLE, "shingle_lone"), "words").join(own, "words", "left")
    pairs = parts.join(wanted.join(settle(rated_texts), "words").withColumnRenamed("words", "item_words"), item_key)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            edits = [passage(list(i), list(p), set(() if o is None else o), w, s) for i, p, o, w, s in zip(batch["item_words"], batch["part"], batch["own"], batch["window_lone"], batch["shingle_lone"])]
            out = pd.DataFrame({doc_key: batch[doc_key], item_key: batch[item_key], "edits": pd.array(edits, dtype="Int64")})
            yield out[out["edits"].notna()].astype({"edits": "int64"})

    schema = pairs.select(doc_key, item_key, F.lit(0).cast("long").alias("edits")).schema
    return pairs.mapInPandas(verify, schema).groupBy(doc_key, item_key).agg(F.min("edits").alias("edits"))
