"""Problem 9: statistics of a text, and whether it is prose, a list, a table or junk.

A text longer than ``chunk`` characters is cut into chunks that are counted apart. Every count is a count of
matches that need at most EDGE characters around them, so for two neighbouring pieces

    f(A B) = f(A) + f(B) + f(end of A, start of B) - f(end of A) - f(start of B)

holds, and the first and last EDGE characters of a piece are all the boundary state that merging needs. A line
cut by a chunk's end is carried as such a piece until its other part is merged in; only whole lines are judged.
The merge is associative; the chunks of one text are merged in a tree of groups of FAN, so that no task ever
holds more than FAN states of a text. Short texts need no shuffle at all.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD

EDGE, FAN, LEVELS = 64, 64, 3

# The commonest function words of the four languages.
COMMON = frozenset(
    """
    the of and in to a is at on for with by while because until as so that be or from this it are was not even if
    le la les de des du et un une à au aux en dans pour par sur que qui est avec sans ce cette plus même si
    der die das den dem des ein eine und in im zu mit von auf für ist bei nach vor nicht aber aus
    el los las del y un una al con por para que es en se sin su cada antes más hasta
    """.split()
)
ENDER = re.compile(r"[^\W_][)\]”\"’'»]?[.!?…:][)\]”\"’'»]?(?=\s|$)")


def _word_counts(t: str) -> tuple[int, int, int]:
    found = WORD.findall(t.lower())
    return len(found), sum(map(COMMON.__contains__, found)), sum(map(len, found))


NO_VOWEL = re.compile(r"(?i)\b[bcdfghjklmnpqrstvwxz]{3,40}\b")
BROKEN = re.compile(r"\(cid:\d{1,9}\)|[�□\u200b]")
HEX = re.compile(r"(?<!\S)[0-9a-f]{2}(?!\S)")
TIGHT_COMMA = re.compile(r",(?=\S)|,$")
GAP = re.compile(r"\S  ")
COUNTS = {
    "words": lambda t: _word_counts(t)[0],
    "common": lambda t: _word_counts(t)[1],
    "alnum": lambda t: _word_counts(t)[2],
    "solid": lambda t: len("".join(t.split())),
    "enders": lambda t: len(ENDER.findall(t)),
    "no_vowel": lambda t: len(NO_VOWEL.findall(t)),
    "broken": lambda t: len(BROKEN.findall(t)),
    "hex": lambda t: len(HEX.findall(t)),
    "bars": lambda t: t.count("|") + t.count("│"),
    "tabs": lambda t: t.count("\t"),
    "semis": lambda t: t.count(";"),
    "commas": lambda t: len(TIGHT_COMMA.findall(t)) if "," in t else 0,
    "gaps": lambda t: len(GAP.findall(t)) if "  " in t else 0,
    "any_commas": lambda t: t.count(","),
}
BULLET = re.compile(r"\s*(?:[-*+•◦▪‣–·]\s|\[[ xX]\]\s|\(?\d{1,3}[.)]\s|\d+(?:\.\d+)+\.?\s|\(?[a-z][.)]\s|--?[a-z][\w-]*)")
LEADER = re.compile(r"(?:\.{3,}|(?:\. ){3,}|…{2,}|_{3,})\s*\d+\s*$")
RULE = re.compile(r"\s*[|+│┼├┤─═=:\- ]*(?:-{2,}|─{2,}|={3,})[|+│┼├┤─═=:\- ]*$")
#: A first cell that looks like a mark of a list, far from what follows.
CELL = re.compile(r"\s*(?:[-–]|\d+(?:\.\d+)+)( {2,})\S")
SOLID_RUN = re.compile(r"\s*[A-Za-z0-9+/=_-]{40,}\s*$")
KINDS = ("prose", "list", "table", "junk", "open")


class Piece:
    """A stretch of text without line break: whole, or merged from parts of which only counts and edges are left."""

    __slots__ = ("head", "tail", "n", "seen", "text")

    def __init__(self, text: str):
        self.text, self.n, self.seen = text, len(text), {}
        self.head, self.tail = text[:EDGE], text[-EDGE:]

    def get(self, name: str) -> int:
        if name not in self.seen:
            if name in ("words", "common", "alnum"):
                self.seen["words"], self.seen["common"], self.seen["alnum"] = _word_counts(self.text)
            else:
                self.seen[name] = COUNTS[name](self.text)
        return self.seen[name]

    def closed(self) -> Piece:
        """Without its text, all counts made."""
        for name in COUNTS:
            self.get(name)
        self.text = None
        return self

    def join(self, other: Piece) -> Piece:
        if not other.n:
            return self
        if not self.n:
            return other
        a, b = self.closed(), other.closed()
        out = Piece("")
        out.text = None
        for name, f in COUNTS.items():
            out.seen[name] = a.seen[name] + b.seen[name] + f(a.tail + b.head) - f(a.tail) - f(b.head)
        out.n = a.n + b.n
        out.head = (a.head + b.head)[:EDGE] if a.n < EDGE else a.head
        out.tail = (a.tail + b.tail)[-EDGE:] if b.n < EDGE else b.tail
        return out


def line_kind(p: Piece) -> str:
    """What a whole line looks like by itself; 'open' if only its surroundings can tell."""
    get, head = p.get, p.head
    words, solid, alnum = get("words"), get("solid"), get("alnum")
    if alnum * 4 < solid and RULE.match(head) and (p.n <= EDGE or RULE.match(p.tail)):
        return "table"
    bars = get("bars")
    if bars >= 2 and alnum * 2 < solid - bars and solid > 3 * bars + 4:
        return "junk"  # symbols, of which bars are some
    if bars >= 2 or get("tabs") >= 1:
        return "table"
    broken = get("broken")
    if words and broken * 6 > words or broken >= 3 and broken * 8 > solid:
        return "junk"
    if LEADER.search(p.tail):
        return "list"
    if alnum * 2 < solid and solid >= 12:
        return "junk"
    if words >= 8 and alnum < words * 4 and get("hex") * 10 >= words * 7:
        return "junk"
    if solid >= 40 and words * 8 < alnum and (SOLID_RUN.match(head) if p.n <= EDGE else SOLID_RUN.match(head) and SOLID_RUN.match(p.tail)):
        return "junk"
    if words >= 3 and get("common") * 12 < words and get("no_vowel") * 2 > words:
        return "junk"
    gaps = get("gaps") - p.tail.endswith("  ")  # the blanks at the end are no gap
    cell = CELL.match(head)
    if cell and (gaps >= 2 or len(cell[1]) >= 4):
        return "table"
    if BULLET.match(head):
        return "list"
    if get("enders"):
        return "prose"
    if (get("semis") >= 2 and get("semis") * 6 > words) or (get("commas") >= 2 and get("commas") * 5 > words) or (gaps >= 1 and words < 12 * (gaps + 1)):
        return "table"
    if words >= 20 and get("common") * 20 < words and not get("any_commas"):
        return "junk"
    if head.startswith("  ") and p.n < 100:
        return "list"
    return "open"


class State:
    """Counts of the whole lines of a piece of text, and its first and last line, which may be parts.

    Line breaks are single line feeds: texts are brought to that before they are cut, so that no break is cut in two.
    """

    __slots__ = ("body", "first", "last", "whole")

    def __init__(self, text: str):
        lines = text.split("\n")
        self.first = Piece(lines[0])
        self.last = Piece(lines[-1]) if len(lines) > 1 else None
        self.body = {}
        for line in lines[1:-1]:
            self.add(Piece(line))
        self.whole = False

    def add(self, p: Piece) -> None:
        b = self.body
        b["breaks"] = b.get("breaks", 0) + 1
        b["chars"] = b.get("chars", 0) + p.n
        if not p.get("solid"):
            return
        kind = line_kind(p)
        for name in ("words", "common", "alnum", "solid", "enders"):
            b[name] = b.get(name, 0) + p.get(name)
        end = p.tail.rstrip()
        for name, k in ((f"{kind}_chars", p.get("solid")), (f"{kind}_lines", 1), (f"{kind}_words", p.get("words")), ("lines", 1), ("ended", bool(end) and end[-1] in ".!?…:;\"”’»)")):
            b[name] = b.get(name, 0) + k
        if kind == "open":
            b["open_common"] = b.get("open_common", 0) + p.get("common")

    def join(self, other: State) -> State:
        if self.last is None:
            self.first = self.first.join(other.first)
            self.last, self.body = other.last, {k: self.body.get(k, 0) + other.body.get(k, 0) for k in self.body.keys() | other.body.keys()}
            return self
        middle = self.last.join(other.first)
        if other.last is None:
            self.last = middle
            return self
        self.add(middle)
        self.last = other.last
        for k, v in other.body.items():
            self.body[k] = self.body.get(k, 0) + v
        return self

    def close(self) -> State:
        for p in (self.first, self.last):
            if p is not None:
                p.closed()
        return self

    def dump(self) -> bytes:
        """As plain values: the classes need not be known where it is read."""
        self.close()
        return pickle.dumps((self.body, *((p.n, p.head, p.tail, p.seen) if p is not None else None for p in (self.first, self.last))))

    @staticmethod
    def load(data: bytes) -> State:
        out = State("")
        out.body, *ends = pickle.loads(data)
        for name, e in zip(("first", "last"), ends, strict=True):
            p = None
            if e is not None:
                p = Piece("")
                p.text = None
                p.n, p.head, p.tail, p.seen = e
            setattr(out, name, p)
        return out

    def finish(self) -> dict[str, int]:
        if not self.whole:
            self.add(self.first)
            if self.last is not None:
                self.add(self.last)
            self.body["chars"] += self.body["breaks"] - 1
            self.whole = True
        return self.body


def statistics(text: str | None, chunk: int | None = None) -> tuple:
    """The statistics of one text; with ``chunk``, by way of merged chunks (the result is the same)."""
    text = (text or "").replace("\r\n", "\n").replace("\r", "\n")
    if not chunk or len(text) <= chunk:
        return derive(State(text).finish())
    parts = [State(text[i : i + chunk]).close() for i in range(0, len(text), chunk)]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p)
    return derive(out.finish())


def derive(b: dict[str, int]) -> tuple:
    """Ratios and the outcome of the rules."""
    g = lambda k: b.get(k, 0)
    words, solid, lines = g("words"), g("solid"), g("lines")
    # Lines without a sentence's end are wrapped prose where about every second line has one; else they are entries.
    open_lines, closed = g("open_lines"), g("prose_lines")
    prose_chars = g("prose_chars")
    # A wrapped sentence spans a few lines, so each line that ends one speaks for a line and a half without.
    wrapped = min(1.0, 1.5 * closed / open_lines) if open_lines else 0.0
    prose = prose_chars + wrapped * g("open_chars")
    rest = (1 - wrapped) * g("open_chars")
    salad = rest and g("open_words") >= 14 * open_lines and g("open_common") * 12 < g("open_words")
    share = {"list": g("list_chars"), "table": g("table_chars"), "junk": g("junk_chars")}
    share["junk" if salad else "list"] += rest
    total = prose + sum(share.values())
    kind = max(share, key=lambda k: (share[k], k))
    if not solid or sum(share.values()) <= 0.5 * total:
        kind = "prose"
    ratio = lambda x, y: round(x / y, 6) if y else 0.0
    return (
        g("chars"), words, ratio(g("alnum"), words), ratio(solid - g("alnum"), solid), lines, ratio(g("ended"), lines), ratio(g("common"), words),
        ratio(g("enders"), words), ratio(share["list"], total), ratio(share["table"], total), ratio(share["junk"], total), kind,
    )


FIELDS = (
    "n_chars long, n_words long, mean_word_length double, symbol_ratio double, n_lines long, ended_line_share double, common_word_share double, "
    "sentence_end_ratio double, list_share double, table_share double, junk_share double, kind string"
)
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def text_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", chunk: int = 16_384) -> DataFrame:
    """One row of statistics per row of ``docs``, with ``kind`` prose, list, table or junk.

    A null or blank text has zero counts and the kind prose. Rows are not merged, whatever their keys: the chunks of
    a text longer than ``chunk`` characters are found by its key and hash, and rows that repeat both are counted, so
    each comes out. Other columns are ignored.
    """
    k = docs.schema[key].dataType.simpleString()
    d = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    n = F.coalesce(F.length("_t"), F.lit(0))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = pd.DataFrame([statistics(t) for t in p["_t"]], columns=NAMES)
            out.insert(0, "_k", p["_k"].to_numpy())
            yield out

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame({"_k": p["_k"], "_h": p["_h"], "_i": p["_i"], "_m": 1, "_s": [State(t).dump() for t in p["_t"]]})

    def merge(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("_i")
        rows = int((p["_i"] == p["_i"].iloc[0]).mul(p["_m"]).sum())  # so many rows have this key and text
        p = p.drop_duplicates("_i")
        states = [State.load(s) for s in p["_s"]]
        out = states[0]
        for s in states[1:]:
            out = out.join(s)
        return pd.DataFrame({"_k": p["_k"].iloc[:1], "_h": p["_h"].iloc[:1], "_i": p["_i"].iloc[:1] // FAN, "_m": rows, "_s": [out.dump()]})

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = pd.DataFrame([derive(State.load(s).finish()) for s in p["_s"]], columns=NAMES)
            out.insert(0, "_k", p["_k"].to_numpy())
            yield out.loc[out.index.repeat(p["_m"].to_numpy())]

    short = d.filter(n <= chunk).mapInPandas(whole, f"_k {k}, {FIELDS}")
    long = d.filter(n > chunk).select("_k", F.xxhash64("_t").alias("_h"), F.regexp_replace("_t", "\r\n?", "\n").alias("_t"))
    pieces = long.select("_k", "_h", F.posexplode(F.expr(f"transform(sequence(0, cast((length(_t) - 1) div {chunk} as int)), i -> substring(_t, i * {chunk} + 1, {chunk}))")).alias("_i", "_t"))
    piece = f"_k {k}, _h long, _i int, _m long, _s binary"
    states = pieces.repartition("_k", "_h", "_i").mapInPandas(part, piece)
    for _ in range(LEVELS):
        states = states.groupBy("_k", "_h", F.expr(f"_i div {FAN}").alias("_g")).applyInPandas(merge, piece)
    return short.unionByName(states.mapInPandas(finish, f"_k {k}, {FIELDS}")).withColumnRenamed("_k", key)
