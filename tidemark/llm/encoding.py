"""Text garbled by decoding with the wrong character encoding: finding it and restoring it.

Three passes over the corpus. (1) Sentences, with identifiers, paths and numbers replaced by a mark,
are counted by the different texts that hold them, so that copies say nothing.
(2) Sentences are joined with their near-twins: equal text once everything that is not ASCII is
stripped, and word lengths that fit a re-encoding. The characters between equal ASCII characters are
aligned, and each reading (written in one encoding, read in another, of all the text encodings that
the standard library has) that explains every aligned run of a pair is counted; pairs are then
credited to the reading that explains most pairs. (3) Only readings that pairs taught are undone on the
distinct sentences, and a result counts if the corpus' own pairs of characters make it far likelier
than what stands there. Whole texts are read; nothing is sampled.
"""

from __future__ import annotations

import encodings
import html
import pkgutil
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import settle

#: Encodings that are tried first where several explain the same pairs.
USUAL = ("utf_8", "cp1252", "latin_1", "cp1251", "cp1250", "iso8859_2", "koi8_r", "cp866", "cp437", "cp850", "mac_roman", "shift_jis", "euc_jp", "gbk", "big5", "euc_kr", "iso8859_15", "cp852", "mac_cyrillic", "iso8859_5")
#: Entries of the table of character pairs, a fixed size whatever the corpus.
PAIRS = 1 << 18
#: Twin sentences that a reading must explain, or different characters beyond ASCII in one of them; fewer if characters of several bytes fit.
TWINS, LETTERS, LETTERS_BYTES = 2, 5, 4
#: Texts of one key up to which each is tried with each; of more, those that have the same bytes in some encoding are.
TWIN_SLOTS = 8
#: Gain in mean log frequency of a pair, and in all, that undoing a single-byte reading must bring.
GAIN, GAIN_ALL = 1.2, 8.0
#: Gain in mean log frequency for readings of several bytes a character, which hardly succeed by chance.
GAIN_BYTES = 0.3
#: Characters of several bytes that are evidence by themselves, whatever the gain.
SURE_BYTES = 4
#: Log frequency of a pair below which rarer ones do not differ, so that verdicts do not depend on the corpus' size.
FLOOR = -11.0
MARK = "\x01"
# no name begins right behind a character beyond ASCII: the first letter may be half of a garbled one
_NAMES = re.compile(
    r"(?<![^\x00-\x7f])(?:[A-Za-z_][A-Za-z0-9_.\-]*(?:/[A-Za-z0-9_.\-]+)+|[A-Za-z]*[A-Za-z0-9]_[A-Za-z0-9_]+|[a-z]+[A-Z][A-Za-z0-9]*|[A-Z][a-z]+[A-Z][A-Za-z0-9]*)|[0-9][0-9:.,]*"
)
_SENTENCE = re.compile(r"(?<=[.!?。])\s+|(?<=。)|[\r\n]+")
_QUOTED = re.compile(r"`[^`\r\n]*`")
_FOREIGN = re.compile(r"[^\x00-\x7f]")
_RUN = re.compile(r"[^\x00-\x7f]+")
#: A run with the ASCII character behind it, which may be the second half of a character.
_STRIPPED = re.compile(r"[^\x00-\x7f]+(?:[^\s\x01\x00-\x1f])?")
_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
#: Texts that can have a character beyond ASCII, as itself or as a character reference.
_CAN_HOLD = r"[^\x00-\x7F]|" + _REFERENCE.pattern


def _character(m: re.Match) -> str:
    """What a reference stands for; those for ASCII and those that stand for nothing are left as written."""
    ch = html.unescape(m[0])
    if ch.isascii() or ch == m[0] or ch == "�" and m[0].lower() not in ("&#65533;", "&#xfffd;"):
        return m[0]
    return ch


def unescape(text: str) -> str:
    """text with the character references beyond ASCII put as characters."""
    return _REFERENCE.sub(_character, text) if "&" in text else text


def _pieces(text: str) -> list[tuple[int, int, str]]:
    """(start, end, sentence) of the sentences and lines that have characters beyond ASCII outside quoted code; references are put as characters."""
    out, at = [], 0
    for line in text.split("\n"):
        # a plain line costs no search
        if not line.isascii() or "&" in line:
            plain = _QUOTED.sub(lambda m: " " * len(m[0]), line) if "`" in line else line
            begin = 0
            for end, after in [*(m.span() for m in _SENTENCE.finditer(plain)), (len(plain), 0)]:
                said = unescape(plain[begin:end])
                if not said.isascii():
                    out.append((at + begin, at + end, said))
                begin = after
        at += len(line) + 1
    return out


def sentences(text: str) -> list[str]:
    """The sentences and lines of a text that have characters beyond ASCII, outside quoted code; references are put as characters."""
    return [s for _, _, s in _pieces(text)] if text else []


def normal(sentence: str) -> str:
    """The sentence with names, paths and numbers replaced by a mark."""
    return _NAMES.sub(MARK, sentence.strip())


@lru_cache(1)
def codecs() -> tuple[str, ...]:
    """The standard library's text encodings that keep ASCII, the usual ones first. Stateful ones are left out."""
    found = []
    for name in sorted({m.name for m in pkgutil.iter_modules(encodings.__path__)}):
        if name.startswith(("utf_7", "iso2022", "hz")) or name in ("aliases", "idna", "punycode", "undefined", "mbcs", "oem", "raw_unicode_escape", "unicode_escape", "charmap", "ascii"):
            continue
        try:
            if b"Az_0 .".decode(name) == "Az_0 ." and "Az_0 .".encode(name) == b"Az_0 .":
                found.append(name)
        except (LookupError, UnicodeError, TypeError):
            continue
    found.sort(key=lambda c: (USUAL.index(c) if c in USUAL else len(USUAL), c))
    every = bytes(range(128, 256))
    # of encodings that read single bytes alike the first one stands for all
    return tuple({every.decode(c, "replace") + str(wide(c) and c): c for c in reversed(found)}.values())[::-1]


def _encode(text: str, codec: str) -> bytes | None:
    """Bytes of text; undefined places of the Windows code pages stand for themselves, as readers leave them."""
    try:
        return text.encode(codec)
    except UnicodeError:
        if not codec.startswith("cp125"):
            return None
    out = bytearray()
    for ch in text:
        try:
            out += ch.encode(codec)
        except UnicodeError:
            if not 0x80 <= ord(ch) <= 0x9F:
                return None
            out.append(ord(ch))
    return bytes(out)


def undo(text: str, written: str, read: str) -> str | None:
    """text as it was before bytes in `written` were decoded as `read`; None if it cannot be."""
    raw = _encode(text, read)
    if raw is None:
        return None
    try:
        return raw.decode(written)
    except UnicodeError:
        return None


@lru_cache(None)
def wide(codec: str) -> bool:
    """Whether an encoding has characters of several bytes."""
    try:
        return len("é".encode(codec)) > 1 or len("あ".encode(codec)) > 1
    except UnicodeError:
        try:
            return len("あ".encode(codec)) > 1
        except UnicodeError:
            return False


def aligned(garbled: str, clean: str) -> list[tuple[str, str]] | None:
    """The runs beyond ASCII of two texts that stand between the same ASCII characters; the whole texts if those differ."""
    if _RUN.sub("", garbled) != _RUN.sub("", clean):
        return [(garbled, clean)]
    a, b = _RUN.split(garbled), _RUN.split(clean)
    return list(zip(_RUN.findall(garbled), _RUN.findall(clean))) if a == b else [(garbled, clean)]


@lru_cache(1 << 16)
def _turns(garbled: str, clean: str) -> frozenset[tuple[str, str]]:
    """The readings (written, read) that turn clean into garbled."""
    if garbled == clean or not len(clean) <= len(garbled) <= 4 * len(clean):
        return frozenset()
    raws: dict[bytes, list[str]] = {}
    for r in codecs():
        raw = _encode(garbled, r)
        if raw is not None:
            raws.setdefault(raw, []).append(r)
    found = []
    for w in codecs() if raws else ():
        try:
            readers = raws.get(clean.encode(w), ())
        except UnicodeError:
            continue
        found += [(w, r) for r in readers if r != w]
    return frozenset(found)


def explains(garbled: str, clean: str) -> frozenset[tuple[str, str]]:
    """The readings (written, read) that turn every aligned run of clean into that of garbled."""
    left: frozenset[tuple[str, str]] | None = None
    for g, c in dict.fromkeys(aligned(garbled, clean)):
        left = _turns(g, c) if left is None else left & _turns(g, c)
        if not left:
            break
    return left or frozenset()


def _bucket(a: str, b: str) -> int:
    return (ord(a) * 0x9E3779B1 ^ ord(b) * 0x85EBCA77) % 4294967291 % PAIRS


def pairs_of(text: str) -> list[str]:
    """The neighbouring characters of which one is beyond ASCII."""
    padded = f" {text} "
    return [padded[i : i + 2] for m in _RUN.finditer(padded) for i in range(m.start() - 1, m.end())]


def _keys(text: str) -> tuple[str, list[str]]:
    """Key of a text read as it stands, and the keys that garbled readings of it would have."""
    bare = _STRIPPED.sub("", text)
    words = [w for w in text.split(" ") if _FOREIGN.search(w)]
    own = ",".join(str(len(w)) for w in words)
    as_utf8 = ",".join(str(len(w.encode("utf-8", "replace"))) for w in words)
    double = ",".join(str(sum(1 + (ch > "\x7f") for ch in w)) for w in words)
    return f"{bare}|{own}", list({f"{bare}|{own}", f"{bare}|{as_utf8}", f"{bare}|{double}"})


def forms(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sentence, bits): the normal forms of each document's sentences beyond ASCII, once each, with one of 64 marks of the text; sentence null says that characters are lost."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, found, bits = [], [], []
            for i, t in enumerate(batch[text]):
                own: list = list(dict.fromkeys(map(normal, sentences(t))))
                if "\ufffd" in t and "\ufffd" in _QUOTED.sub(" ", t) or "&" in t and "\ufffd" in unescape(_QUOTED.sub(" ", t)):
                    own.append(None)
                at += [i] * len(own)
                found += own
                bits += [1 << _spot(t)] * len(own)
            out = batch[[key]].iloc[at].reset_index(drop=True)
            yield out.assign(sentence=pd.Series(found, dtype="object"), bits=np.array(bits, "uint64").astype("int64"))

    foreign = documents.select(key, text).filter(F.col(text).rlike(_CAN_HOLD))
    return foreign.mapInPandas(split, foreign.select(key, F.lit(None).cast("string").alias("sentence"), F.lit(0).cast("long").alias("bits")).schema)


def count_sentences(found: DataFrame) -> DataFrame:
    """(sentence, n) of `forms`: normal forms and how usual they are: the different texts that hold them, up to 64, and the logarithm of all.

    The marks of texts are combined before and after the shuffle, so a text that was copied a million
    times counts for little.
    """
    each = found.filter("sentence is not null").groupBy("sentence")
    return each.agg((F.bit_count(F.bit_or("bits")) + F.floor(F.log2(F.count("*")))).cast("long").alias("n"))


def _spot(text: str) -> int:
    """One of 64 places for a text, the same in every process."""
    return crc32(text.encode("utf-8", "replace")) & 63


@lru_cache(None)
def _changed(codec: str) -> frozenset[str]:
    """The ASCII characters that an encoding does not keep."""
    return frozenset(ch for ch in map(chr, range(128)) if ch.encode("ascii") != _strict(ch, codec))


def _strict(text: str, codec: str) -> bytes | None:
    try:
        return text.encode(codec)
    except UnicodeError:
        return None


def all_bytes(text: str) -> tuple[set[bytes], set[bytes]]:
    """What text is in the encodings as written, and as read by mistake: as a whole, and with ASCII kept between its runs.

    Where `explains` finds a reading, bytes that the clean text is written as are among those that the garbled one was read from.
    """
    written: set[bytes | None] = set()
    read: set[bytes | None] = set()
    used = frozenset(text)
    for codec in codecs():
        whole = _strict(text, codec)
        written.add(whole)
        read.add(_encode(text, codec) if whole is None else whole)
        if used & _changed(codec):
            for out, encode in ((written, _strict), (read, _encode)):
                runs = [encode(run, codec) for run in _RUN.findall(text)]
                if None not in runs:
                    bare = [x.encode("ascii") for x in _RUN.split(text)]
                    out.add(b"".join(x for pair in zip(bare, [*runs, b""]) for x in pair))
    return written - {None}, read - {None}


def twins(counted: DataFrame) -> DataFrame:
    """(sentence, clean, sure): sentences with those of the same key that are as usual or more and may explain them; sure if more usual.

    In keys of few texts each is tried with each. In others, which may hold any number, texts are
    joined by the bytes they are in the encodings, so every pair that a reading explains is met, and
    a text of bytes meets no more others than there are encodings.
    """

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(s, n, *_keys(s)) for s, n in zip(batch["sentence"], batch["n"])]
            yield pd.DataFrame(rows, columns=["sentence", "n", "own", "offered"])

    def spelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = [all_bytes(s) for s in batch["sentence"]]
            yield batch.assign(written=[list(w) for w, _ in both], read=[list(r) for _, r in both])

    keys = counted.mapInPandas(keyed, "sentence string, n long, own string, offered array<string>")
    keys = settle(keys.select("sentence", "n", F.xxhash64("own").alias("key"), F.transform("offered", lambda k: F.xxhash64(k)).alias("offered")))
    asks = keys.select("key", "sentence", "n")
    offers = keys.select(F.explode("offered").alias("key"), F.col("sentence").alias("clean"), F.col("n").alias("clean_n"))
    sizes = settle(offers.groupBy("key").agg(F.count("*").alias("texts")).filter("texts > 1"))
    few, many = sizes.filter(F.col("texts") <= TWIN_SLOTS).select("key"), sizes.filter(F.col("texts") > TWIN_SLOTS).select("key")
    near = asks.join(few, "key").join(offers, "key").drop("key")
    # a text is spelled once for all its keys
    every = asks.withColumn("asks", F.lit(True)).unionByName(offers.select("key", F.col("clean").alias("sentence"), F.col("clean_n").alias("n"), F.lit(False).alias("asks")))
    each = every.join(many, "key").groupBy("sentence", "n").agg(F.collect_list(F.struct("asks", "key")).alias("keys"))
    spelt = each.repartition(_tasks(counted)).mapInPandas(spelled, "sentence string, n long, keys array<struct<asks: boolean, key: long>>, written array<binary>, read array<binary>")
    spelt = settle(spelt.select("sentence", "n", F.explode("keys").alias("k"), "written", "read"))
    spelt = spelt.select("sentence", "n", "k.asks", F.col("k.key").alias("key"), F.explode(F.when(F.col("k.asks"), F.col("read")).otherwise(F.col("written"))).alias("raw"))
    spelt = spelt.select("sentence", "n", "asks", F.xxhash64("key", "raw").alias("h"))
    clean = spelt.filter("not asks").select("h", F.col("sentence").alias("clean"), F.col("n").alias("clean_n"))
    far = spelt.filter("asks").join(clean, "h").drop("h", "asks").distinct()
    met = near.unionByName(far).filter("sentence <> clean and clean_n >= n")
    return met.select("sentence", "clean", F.expr("clean_n > n").alias("sure"))


def learn_readings(counted: DataFrame) -> DataFrame:
    """(written, read, twins, letters): the readings by which twins differ, with how many pairs each is credited, and the most different characters in one.

    A pair that several readings explain is credited to the one that explains most pairs in all.
    Where twins are equally usual only readings of several bytes a character, whose direction is
    certain, count.
    """

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for g, c, sure in zip(batch["sentence"], batch["clean"], batch["sure"]):
                # one changed character is no pattern
                letters = len(set(_FOREIGN.findall(g)))
                if letters >= 2:
                    found = [(w, r) for w, r in explains(g, c) if sure or wide(w) and not wide(r)]
                    if found:
                        rows.append(([f"{w} {r}" for w, r in found], letters))
            yield pd.DataFrame(rows, columns=["found", "letters"])

    pairs = settle(twins(counted).repartition(_tasks(counted)).mapInPandas(explain, "found array<string>, letters long"))
    each = pairs.select(F.explode("found").alias("reading")).groupBy("reading").agg(F.count("*").alias("n"))
    # bounded: a row for each two encodings
    support = {r["reading"]: r["n"] for r in each.collect()}
    place = {c: i for i, c in enumerate(codecs())}

    def credit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            best = [min(f, key=lambda x: (-support[x], *(place[c] for c in x.split(" ")))) for f in batch["found"]]
            yield pd.DataFrame([(*k.split(" "), n) for k, n in zip(best, batch["letters"])], columns=["written", "read", "letters"])

    credited = pairs.mapInPandas(credit, "written string, read string, letters long").groupBy("written", "read")
    return credited.agg(F.count("*").alias("twins"), F.max("letters").alias("letters"))


def _count_pairs(counted: DataFrame) -> DataFrame:
    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter = Counter()
            for s, n in zip(batch["sentence"], batch["n"]):
                for p in pairs_of(s):
                    seen[p] += n
            yield pd.DataFrame({"bucket": [_bucket(*p) for p in seen], "n": np.fromiter(seen.values(), "int64", len(seen))}).astype({"bucket": "int32"})

    return counted.mapInPandas(pairs, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


class _Logs(dict):
    """Log frequency of a pair of characters, looked up once each."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table
        self.total = max(float(table.sum()), 1.0)

    def __missing__(self, pair: str) -> float:
        # the table's values are few, so this cache is bounded by the pairs that occur
        value = max(FLOOR, log((float(self.table[_bucket(*pair)]) + 0.3) / self.total))
        if len(self) < 4 * PAIRS:
            self[pair] = value
        return value


@lru_cache(None)
def as_bytes(read: str) -> dict[int, str] | None:
    """For a single-byte encoding, each character beyond ASCII to that of its byte's number; None for others."""
    if wide(read):
        return None
    every = (bytes([b]) for b in range(128, 256))
    found = {ord(b.decode(read, "replace")): chr(b[0]) for b in every}
    if read.startswith("cp125"):
        found = {b: chr(b) for b in range(128, 160)} | found
    return {k: v for k, v in found.items() if k != 0xFFFD}


class Reading:
    """One learned reading, ready to be undone on many texts."""

    def __init__(self, written: str, read: str) -> None:
        self.written, self.read, self.wide = written, read, wide(written)
        self.table = as_bytes(read)
        if self.table is not None and not self.wide:
            back = ((k, bytes([ord(v)]).decode(written, "replace")) for k, v in self.table.items())
            self.table = {k: v for k, v in back if v != "\ufffd"}
        self.known = frozenset(map(chr, self.table)) if self.table is not None else None
        # undoing UTF-8 takes at least one first byte with a further one behind it
        self.needs = None
        if self.table is not None and written == "utf_8":
            first, further = ("".join(re.escape(chr(k)) for k, v in self.table.items() if lo <= ord(v) <= hi) for lo, hi in ((0xC2, 0xF4), (0x80, 0xBF)))
            self.needs = re.compile(f"[{first}][{further}]").search

    def _whole(self, text: str) -> str | None:
        if self.table is None:
            return undo(text, self.written, self.read)
        there = text.translate(self.table)
        if not self.wide:
            return there
        try:
            return there.encode("latin-1").decode(self.written)
        except UnicodeError:
            return None

    def undone(self, text: str, foreign: frozenset[str]) -> list[str]:
        """text with the reading undone: as a whole, else in the runs or words where it can be."""
        known = self.known
        if self.needs and not self.needs(text):
            return []
        if known is None or foreign <= known:
            whole = self._whole(text)
            if whole is not None:
                return [whole]
            if known is None:
                return []
        elif len(foreign & known) < 2:
            return []
        can = lambda part: known.issuperset(_FOREIGN.findall(part)) and self._whole(part) or part
        tried = [" ".join(t if t.isascii() else can(t) for t in text.split(" "))]
        if self.wide:
            tried.append(_RUN.sub(lambda m: can(m[0]), text))
        return [t for t in tried if t != text]


class Judge:
    """Decides over sentences with the learned readings and the corpus' pairs of characters."""

    def __init__(self, table: np.ndarray, readings: dict[tuple[str, str], int]) -> None:
        self.logs = _Logs(table)
        self.order = [Reading(*k) for k in sorted(readings, key=lambda k: (-readings[k], k))]

    def score(self, text: str) -> tuple[float, int]:
        """Mean log frequency of the pairs with a character beyond ASCII, 0 being the best, and their number."""
        found = pairs_of(text)
        if not found:
            return -3.0, 0
        logs = self.logs
        return sum([logs[p] for p in found]) / len(found), len(found)

    def _better(self, now: str, start: tuple[float, int], steps: dict[str, bool]) -> tuple[float, str] | None:
        best = None
        for other, several in steps.items():
            if "\ufffd" in other:
                continue
            mean, n = self.score(other)
            gain = mean - start[0]
            if several:
                good = gain > GAIN_BYTES or (gain > -GAIN and start[1] - n >= 2 * SURE_BYTES)
            else:
                good = gain > GAIN and gain * min(n, start[1]) > GAIN_ALL
            if good and (best is None or gain > best[0]):
                best = gain, other
        return best

    def _steps(self, text: str, of: str = "") -> dict[str, bool]:
        """What text is with one reading undone, and whether that was one of several bytes a character."""
        foreign = frozenset(_FOREIGN.findall(text))
        out: dict[str, bool] = {}
        for reading in self.order:
            if not of or reading.written == of:
                for other in reading.undone(text, foreign):
                    out[other] = out.get(other, False) or reading.wide
        out.pop(text, None)
        return out

    def restore(self, sentence: str) -> str | None:
        """The sentence before it was garbled, or None where it is sound; undone readings may stack up until nothing gains."""
        now, found, seen = sentence, None, {sentence}
        while True:
            start, steps = self.score(now), self._steps(now)
            # text garbled twice looks no better after one step: look one step further
            for other in [o for o, several in steps.items() if several]:
                steps |= self._steps(other, "utf_8")
            best = self._better(now, start, steps)
            if best is None or best[1] in seen:
                return found
            now = found = best[1]
            seen.add(now)


def apply_fixes(text: str, fixes: dict[str, str]) -> str:
    """text with each sentence whose normal form is in fixes replaced, its own names and quoted code put back."""
    out, at = [], 0
    for a, b, plain in _pieces(text):
        bare = plain.strip()
        fixed = fixes.get(_NAMES.sub(MARK, bare))
        names = _NAMES.findall(bare)
        if fixed is None or fixed.count(MARK) != len(names):
            continue
        parts = fixed.split(MARK)
        done = "".join(p + (names[i] if i < len(names) else "") for i, p in enumerate(parts))
        quoted = _QUOTED.findall(text[a:b])
        if quoted:
            # blanks of the same number stand where code was quoted
            for q in quoted:
                done = done.replace(" " * len(q), q, 1)
        lead = len(plain) - len(plain.lstrip())
        tail = len(plain) - len(plain.rstrip())
        out += [text[at:a], plain[:lead], done, plain[len(plain) - tail :] if tail else ""]
        at = b
    return "".join([*out, text[at:]])


def _judged(found: DataFrame) -> DataFrame:
    """(sentence, fixed): the garbled ones of the distinct sentences of `forms`, each judged once."""
    counted = settle(count_sentences(found))
    # bounded: one row per reading, at most PAIRS rows of the table
    readings = {(r["written"], r["read"]): r["twins"] for r in learn_readings(counted).collect() if r["twins"] >= TWINS or r["letters"] >= (LETTERS_BYTES if wide(r["written"]) else LETTERS)}
    rows = _count_pairs(counted).toPandas()
    table = np.zeros(PAIRS, "float32")
    table[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    shared = found.sparkSession.sparkContext.broadcast((table, readings))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Judge(*shared.value)
        for batch in batches:
            out = pd.DataFrame({"sentence": batch["sentence"], "fixed": [own.restore(s) for s in batch["sentence"]]})
            yield out[out["fixed"].notna()]

    spread = counted.select("sentence").repartition(_tasks(found))
    return settle(spread.mapInPandas(judge, "sentence string, fixed string"))


def _tasks(df: DataFrame) -> int:
    """Tasks for work that costs far more than its bytes show."""
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _hashed(found: DataFrame, key: str) -> DataFrame:
    """(key, h): `forms` of known keys by the hash of the sentence; h null says that characters are lost."""
    return found.filter(F.col(key).isNotNull()).select(key, F.when(F.col("sentence").isNotNull(), F.xxhash64("sentence")).alias("h"))


def garbled_keys(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Keys of the documents that are garbled, wholly or in part, each once. See `garbled`."""
    found = settle(forms(documents, key, text))
    judged = _judged(found).select(F.xxhash64("sentence").alias("h"))
    marks = _hashed(found, key)
    hits = marks.filter("h is not null").join(judged, "h", "left_semi").select(key)
    return hits.unionByName(marks.filter("h is null").select(key)).distinct()


def garbled(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, restored, complete) of the documents that are garbled, wholly or in part.

    restored is the text with every reading undone that could be; complete is false where characters
    are lost (U+FFFD). Sequences in back quotes are taken for examples. Null and empty texts are
    sound; rows with a null key are left out; repeated rows give repeated results; an empty table
    gives none.
    """
    found = settle(forms(documents, key, text))
    judged = _judged(found)
    marks = _hashed(found, key).distinct()
    fixes = marks.join(judged.withColumn("h", F.xxhash64("sentence")), "h").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("sentence", "fixed"))).alias("fixes"))
    lost = marks.filter("h is null").select(key, F.lit(True).alias("lost"))
    hits = fixes.join(lost, key, "full_outer")
    rows = documents.select(key, text).join(hits, key)

    def restore(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [apply_fixes(t, dict(f) if f is not None else {}) for t, f in zip(batch[text], batch["fixes"])]
            yield pd.DataFrame({key: batch[key], "restored": done, "complete": batch["lost"].isna()})

    return rows.mapInPandas(restore, documents.select(F.col(key), F.lit("").alias("restored"), F.lit(True).alias("complete")).schema)
