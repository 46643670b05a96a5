"""Problem 1: noise in text from scanned pages.

Words are counted over all rows. A word's skeleton folds glyphs that scanning confuses (c and e, f and t, rn and m,
digits and letters ...) into one; a rare word's candidates are the more frequent words of its skeleton, so plausible
glyph edits of any number are one equi-join, never a comparison of pairs. Skip-gram vectors with negative
sampling, learned on how often words stand beside each other in all rows, link it to one of them in context: at each occurrence a candidate is
judged by how much likelier it is than the rare word itself, as the counts say, and by how much nearer its vector lies
to the words around than chance, and only what is ahead in sum is followed. Where
words are too rare for vectors, the counts alone decide. Then running headers and page numbers are taken off, words split by the
layout are joined, and the lines are reflowed into paragraphs.

The pages of a long file are looked at in blocks, so a file of any length is many small groups; what repeats on its
pages (the words of headers, the offsets of page numbers) is counted over the whole file all the same.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import broadcast, latest

TOKEN = re.compile(r"[^\W_]+")
MARKS = "-­¬‐"
SPLIT = re.compile(rf"([^\W\d_]+)([{MARKS}])[ \t]*\n[ \t]*([^\W\d_]+)")
#: A word split at a line end and what follows, and a compound on one line; the second part may be another's first.
NEXT = re.compile(rf"(?<![^\W\d_])([^\W\d_]+)[{MARKS}][ \t]*\n[ \t]*(?=([^\W\d_]+))")
HYPHEN = re.compile(r"(?<=[^\W\d_])-([^\W\d_]+)")
LAST = re.compile(r"[^\W\d_]+\Z")
#: Where a word may be split: without this the slower patterns need no look.
LINE_END = re.compile(rf"[{MARKS}][ \t]*\n")
PAGES = 64  # pages of one block of a longer file

# Glyphs that scanning confuses. Single ones are folded first, then pairs.
FOLD = str.maketrans({"e": "c", "h": "ll", "b": "ll", "u": "ll", "f": "t", "i": "l", "1": "l", "|": "l", "0": "o", "5": "s", "9": "g", "q": "g", "8": "B", "ﬁ": "tl", "ﬂ": "tl", "2": "z", "6": "ll", "ı": "l"})
PAIRS = (("cl", "d"), ("rn", "m"), ("nn", "m"), ("vv", "w"), ("lj", "y"))


def skeleton(word: str) -> str:
    w = word.translate(FOLD)
    for a, b in PAIRS:
        w = w.replace(a, b)
    return w


def counted_words(text: str | None) -> list[str]:
    """Words as they stand, those that a line end splits joined; pure numbers aside."""
    return [w for w in all_words(text) if not w.isdigit()]


def all_words(text: str | None) -> list[str]:
    text = text or ""
    return TOKEN.findall(SPLIT.sub(r"\1\3", text) if LINE_END.search(text) else text)


def compounds_of(text: str) -> Iterator[tuple[str, str]]:
    """The parts of the compounds on one line; the second may be another's first."""
    for m in HYPHEN.finditer(text):
        at = m.start()
        a = LAST.search(text, max(0, at - 40), at)
        if at - a.start() == 40:  # a longer word
            a = LAST.search(text, 0, at)
        yield a[0], m[1]


class Ids(dict):
    """word -> its place in the sorted hashes of the vocabulary, in lower case; -1 if it is not there, -2 for a number. Remembered up to a bound."""

    LIMIT = 200_000

    def __init__(self, known: np.ndarray):
        self.known = known

    def __missing__(self, word: str) -> int:
        k = -2 if word.isdigit() else place(self.known, word.lower())
        if len(self) < self.LIMIT:
            self[word] = k
        return k


def hashed(word: str) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def place(known: np.ndarray, word: str) -> int:
    h = hashed(word)
    k = int(np.searchsorted(known, h))
    return k if k < len(known) and known[k] == h else -1


def vocabulary(counts: DataFrame, least: int = 5) -> np.ndarray:
    """The sorted hashes of the words, in lower case, that stand ``least`` times or more in all rows. counts: word, n."""

    def lower(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            p = p[[not w.isdigit() for w in p["word"]]]
            yield pd.DataFrame({"h": np.fromiter((hashed(w.lower()) for w in p["word"]), np.int64, len(p)), "n": p["n"].to_numpy()})

    known = counts.select("word", "n").mapInPandas(lower, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("h")
    return np.sort(known.toArrow()["h"].to_numpy())


def beside(docs: DataFrame, text: str, known, window: int = 2) -> DataFrame:
    """(x, y, n), x <= y: how often two words of the vocabulary stand within ``window`` words, over all rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def told() -> pd.DataFrame:
            return pd.DataFrame({"x": codes // size, "y": codes % size, "n": n})

        ids = Ids(*known())
        size = max(1, len(ids.known))
        codes, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for p in batches:
            rows: list[int] = []
            for t in p[text]:
                rows += map(ids.__getitem__, all_words(t))
                rows += [-1] * window
            flat = np.array(rows, np.int64)
            flat = flat[flat != -2]
            new = []
            for d in range(1, window + 1):
                a, b = flat[:-d], flat[d:]
                ok = (a >= 0) & (b >= 0)
                new.append(np.minimum(a, b)[ok] * size + np.maximum(a, b)[ok])
            new, k = np.unique(np.concatenate(new), return_counts=True)
            codes, at = np.unique(np.concatenate([codes, new]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n, k]), len(codes)).astype(np.int64)
            if len(codes) > 2_000_000:
                yield told()
                codes, n = codes[:0], n[:0]
        yield told()

    return docs.select(text).mapInPandas(count, "x long, y long, n long").groupBy("x", "y").agg(F.sum("n").alias("n"))


def shared(spark, arrays: dict[str, np.ndarray]):
    """A function that maps arrays into a worker's memory, from a file of each on every executor; so they may be of any size."""
    where, tag = tempfile.mkdtemp(prefix="skipgram-"), uuid.uuid4().hex
    atexit.register(shutil.rmtree, where, ignore_errors=True)
    for name, x in arrays.items():
        np.save(f"{where}/{tag}-{name}.npy", x)
        spark.sparkContext.addFile(f"{where}/{tag}-{name}.npy")
    names = list(arrays)

    def load() -> list[np.ndarray]:
        from pyspark import SparkFiles

        return [np.load(SparkFiles.get(f"{tag}-{name}.npy"), mmap_mode="r") for name in names]

    return load


class SkipGram:
    """Vectors of words, by skip-gram with negative sampling.

    What skip-gram learns depends on the rows only by how often two words stand beside each other, so it is learned on these
    counts, and they are of all rows. In turns, each word's vector and then each word's vector as a neighbour takes one Newton step
    towards the best for its counts and for drawn chance words; ``ridge`` keeps those of few counts small.
    """

    def __init__(self, known: np.ndarray, a: np.ndarray, b: np.ndarray, usual: np.ndarray):
        self.ids, self.a, self.b, self.usual = Ids(known), a, b, usual

    def fit(self, word: str, around: list[str]) -> float:
        """By how much a word fits the words around it better than it fits chance ones, in nats; 0 if nothing is known of either."""
        k = self.ids[word]
        at = [i for w in around if (i := self.ids[w]) >= 0]
        return float((self.b[at] - self.usual).sum(axis=0) @ self.a[k]) if k >= 0 and at else 0.0


class Turn:
    """One turn of the learning: ``step`` gives words their next vectors, from those of the other side."""

    def __init__(self, total: np.ndarray, other: np.ndarray, neighbours: bool, number: int, negative: int = 4, draws: int = 1024, ridge: float = 16.0):
        f = np.maximum(total, 1e-9) / total.sum()
        keep = np.minimum(1, np.sqrt(1e-3 / f) + 1e-3 / f)  # frequent words count less
        chance = f**0.75 / (f**0.75).sum()
        centre = keep * total
        self.other, self.ridge = other, ridge
        # A centre's counts are all kept at its own share; a neighbour's at the shares of the centres it stands beside.
        self.own, self.beside = (np.ones_like(keep), keep) if neighbours else (keep, np.ones_like(keep))
        self.against = negative * (chance * centre.sum() if neighbours else centre) / draws
        drawn = np.cumsum(centre if neighbours else chance)
        at = (np.arange(draws) + np.random.default_rng(number).random()) / draws
        self.noise = other[np.minimum(np.searchsorted(drawn / drawn[-1], at), len(drawn) - 1)]
        self.squares = np.einsum("mi,mj->mij", self.noise, self.noise).reshape(draws, -1)

    def step(self, words: np.ndarray, was: np.ndarray, many: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """was: their vectors; many: how many neighbours each has; at, n: all the neighbours and counts, word by word."""
        dims, start = was.shape[1], np.r_[0, np.cumsum(many)]
        near = self.other[at]
        n = (n * np.repeat(self.own[words], many) * self.beside[at]).astype(np.float32)
        s = _sigmoid(np.einsum("ij,ij->i", near, np.repeat(was, many, axis=0)))
        r = _sigmoid(was @ self.noise.T)
        c = self.against[words][:, None]
        g = -c * (r @ self.noise) - self.ridge * was
        h = (c * ((r * (1 - r)) @ self.squares)).reshape(-1, dims, dims) + self.ridge * np.eye(dims)
        slope, bend = n * (1 - s), (n * s * (1 - s))[:, None]
        for k in range(len(words)):
            own = slice(start[k], start[k + 1])
            g[k] += slope[own] @ near[own]
            h[k] += (near[own] * bend[own]).T @ near[own]
        move = np.linalg.solve(h, g[:, :, None])[:, :, 0]
        return (was + move / np.maximum(1, np.linalg.norm(move, axis=1))[:, None]).astype(np.float32)


def batches_of(many: np.ndarray, words: int = 1024, pairs: int = 200_000) -> Iterator[slice]:
    """Ranges of so many words that have so many neighbours together, or of one that has more."""
    k, end = 0, np.cumsum(many)
    while k < len(many):
        to = int(np.searchsorted(end, (end[k - 1] if k else 0) + pairs, "right"))
        to = max(k + 1, min(to, k + words))
        yield slice(k, to)
        k = to


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -15, 15)))


def learned(spark, known: np.ndarray, pairs: DataFrame, dims: int = 24, turns: int = 8, seed: int = 1) -> list[np.ndarray]:
    """[vectors, vectors as neighbours, the mean of these by frequency] from the counts of all pairs; each turn is a job."""
    size, r = len(known), np.random.default_rng(seed)
    sides = [((r.random((size, dims)) - 0.5).astype(np.float32)) for _ in range(2)]
    # Both orders of each pair; two of one word count for both.
    both = pairs.select("x", "y", F.when(F.col("x") == F.col("y"), 2 * F.col("n")).otherwise(F.col("n")).alias("n"))
    both = both.unionByName(pairs.filter("x <> y").select(F.col("y").alias("x"), F.col("x").alias("y"), "n"))
    words = both.groupBy("x").agg(F.sort_array(F.collect_list(F.struct("y", "n"))).alias("p"), F.sum("n").alias("total"))
    words = materialise(words.select("x", "p.y", "p.n", "total"), "beside")
    total = np.zeros(size)
    t = words.select("x", "total").toArrow()
    total[t["x"].to_numpy()] = t["total"].to_numpy()
    if not len(t):
        return [*(0 * x for x in sides), np.zeros(dims, np.float32)]
    totals, sent = shared(spark, {"total": total}), [shared(spark, {"vectors": x}) for x in sides]

    for k in range(2 * turns):

        def go(batches: Iterator[pa.RecordBatch], k=k, mine=sent[k % 2], other=sent[1 - k % 2]) -> Iterator[pa.RecordBatch]:
            turn, (was,) = Turn(*totals(), *other(), bool(k % 2), k), mine()
            for p in batches:
                ids, many, at, n = (c.to_numpy() for c in (p["x"], p["y"].value_lengths(), p["y"].flatten(), p["n"].flatten()))
                start = np.r_[0, np.cumsum(many)]
                for i in batches_of(many):
                    own = slice(start[i.start], start[i.stop])
                    v = turn.step(ids[i], was[ids[i]], many[i], at[own], n[own])
                    yield pa.RecordBatch.from_pydict({"x": [ids[i].tobytes()], "v": [v.tobytes()]})

        new = np.zeros_like(sides[k % 2])  # a word without neighbours says nothing
        for row in words.select("x", "y", "n").mapInArrow(go, "x binary, v binary").toArrow().to_pylist():
            new[np.frombuffer(row["x"], np.int64)] = np.frombuffer(row["v"], np.float32).reshape(-1, dims)
        sides[k % 2], sent[k % 2] = new, shared(spark, {"vectors": new})
    return [*sides, ((total / total.sum()) @ sides[1]).astype(np.float32)]


# --- page numbers and running headers ---------------------------------------------------------------------------

_DIGIT = r"[0-9lIiOoSsBZz|]"
NUMBER = re.compile(rf"(?:[-–—]\s*({_DIGIT}{{1,4}})\s*[-–—]|\[\s*({_DIGIT}{{1,4}})\s*\]|(?:p|P|page|Page|Seite|S|pag|pág|Página)\.?\s+({_DIGIT}{{1,4}})|({_DIGIT}{{1,4}})\s*/\s*{_DIGIT}{{1,4}}|(\d{_DIGIT}{{0,3}}|[lIO]\d{{1,3}}|[lIO\d]{{1,2}})|([ivxlcIVXLC1]{{1,7}}))")
_DIGITS = str.maketrans("lIi|OoSsBZz", "11110055822")
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def number_of(text: str) -> set[int] | None:
    """The numbers that a line's whole text may be as a page number; None if it is none."""
    m = NUMBER.fullmatch(text.strip())
    if not m:
        return None
    out = set()
    digits = next((g for g in m.groups()[:5] if g), None)
    if digits and (d := digits.translate(_DIGITS)).isdigit():
        out.add(int(d))
    r = text.strip().lower().replace("1", "l")
    for x in {r, r.replace("l", "i")}:
        if x and all(c in _ROMAN for c in x):
            v = [_ROMAN[c] for c in x]
            out.add(sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0], strict=True)))
    return out or None


def parted(line: str) -> tuple[set[int] | None, str]:
    """(page numbers, the rest) of a line that may hold both, two blanks or more apart."""
    s = line.strip()
    if (n := number_of(s)) is not None:
        return n, ""
    parts = re.split(r"\s{2,}|\t", s)
    if len(parts) >= 2:
        for k in (0, -1):
            if (n := number_of(parts[k])) is not None:
                return n, " ".join(parts[1:] if k == 0 else parts[:-1])
    return None, s


#: What stands alone on a line and belongs to the text.
CAPTION = re.compile(r"(?i)(?:fig(?:ure|ura|\.)?|tab(?:le|leau|elle|la|\.)?|abb(?:ildung|\.)?|chart|plate|note)\s*\W?\d")
#: A word with single digits for letters; digits side by side are a name's or a number's own.
MIXED = re.compile(r"(?=(?:[^\W\d_]*[0159]?){0,40}$)(?=.{4,})(?:[^\W\d_]+[0159])+[^\W\d_]*|[0159][^\W\d_]{3,}")


class Page:
    __slots__ = ("id", "page", "lines", "solid", "edges", "kinds", "drop", "width")

    def __init__(self, id_, page, text: str):
        self.id, self.page = id_, page
        self.lines = (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.solid = [i for i, x in enumerate(self.lines) if x.strip()]
        self.edges = list(dict.fromkeys(self.solid[:2] + self.solid[-2:])) if len(self.solid) > 2 else self.solid[:1]
        self.width = max([len(self.lines[i]) for i in self.solid], default=0)
        self.kinds: set[str] = set()
        self.drop: set[int] = set()


def header_words(text: str) -> set[str]:
    return {skeleton(w.lower()) for w in TOKEN.findall(text) if len(w) > 1}


def title_like(rest: str, width: int) -> bool:
    """No end of a sentence, and shorter than a wrapped line, or set as titles are."""
    words = TOKEN.findall(rest)
    if not 1 <= len(words) <= 9 or len(rest) > max(62, 0.85 * width) or re.search(r"[.!?…:;,][”\"’'»)]?$", rest) or rest.startswith(("#", "|")) or rest[-1:] in MARKS:
        return False
    titled = (words[-1][:1].isupper() or words[-1].isdigit()) and sum(w[:1].isupper() for w in words) >= 2
    return len(rest) < 0.85 * width or " | " in rest or titled


def edges(pages: list[Page]) -> tuple[list[tuple], list[tuple], Counter, Counter]:
    """(lines with a page number, lines that may be headers, offsets of numbers from pages, pages of each header word)."""
    numbers, heads = [], []
    for p in pages:
        outer = {p.solid[0], p.solid[-1]} if p.solid else set()
        for i in p.edges:
            n, rest = parted(p.lines[i])
            if n is not None and (rest == "" or title_like(rest, p.width)):
                numbers.append((p, i, n, rest, i in outer))
            if rest and title_like(rest, p.width):
                heads.append((p, i, rest, n is not None, i in outer))
    offsets = Counter(v - p.page for p, _, n, _, _ in numbers if p.page is not None for v in n)
    # A header's words come back on other pages of the file; what scanning did to them the skeleton forgives.
    seen = Counter(w for ws in [{(id(p), w) for p, _, r, _, _ in heads for w in header_words(r)}] for _, w in ws)
    return numbers, heads, offsets, seen


def mark_furniture(pages: list[Page], votes: tuple[Counter, Counter] | None = None) -> None:
    """Marks page numbers and running headers or footers at the edges of pages of one file.

    ``votes`` are the offsets and header words of the whole file; without, ``pages`` are the whole file.
    """
    numbers, heads, offsets, seen = edges(pages)
    if votes is not None:
        offsets, seen = votes
    usual = max(offsets.items(), key=lambda x: (x[1], -x[0])) if offsets else (0, 0)
    for p, i, n, rest, outer in numbers:
        fits = p.page is not None and any(v - p.page == usual[0] for v in n)
        if fits and usual[1] >= 2 or p.page is None and (outer or rest) or usual[1] < 2 and outer:
            p.kinds.add("page_number")
            p.drop.add(i)
    for p, i, rest, numbered, outer in heads:
        if i in p.drop and not numbered:
            continue
        ws = header_words(rest)
        back = sum(seen[w] > 1 for w in ws)
        again = len(ws) >= 2 and back >= 0.6 * len(ws) and back >= 2
        # Alone, a line is a header if it stands with the page's number, or short between whole sentences.
        body = [j for j in p.solid if j not in p.drop and j != i]
        top = bool(body) and i < body[0]
        bottom = bool(body) and i > body[-1]
        set_apart = len(body) >= 2 and len(rest) < 0.75 * p.width and not CAPTION.match(rest) and (
            top and p.lines[body[0]].lstrip(" \"“«„‘'¿¡")[:1].isupper() or bottom and bool(re.search(r"[.!?…:][”\"’'»)]?$", p.lines[body[-1]].rstrip()))
        )
        if numbered and (len(ws) >= 2 or again) or again and (top or bottom) or set_apart and len(ws) >= 2:
            p.kinds.add("header")
            p.drop.add(i)


LIGATURES = str.maketrans({"ﬁ": "fi", "ﬂ": "fl"})


class Repair:
    """Repairs the pages of a file: what the links and vectors say of words, then furniture, splits and lines.

    links: word -> (right word, lead): by how many nats the counts put the right word ahead of what a link needs.
    ``trust`` is what a nat of the vectors counts, ``most`` bounds what they may add or take away.
    """

    def __init__(self, links: dict[str, list[tuple[str, float]]], vectors: SkipGram, compounds: set[str], trust: float, most: float):
        self.links, self.vectors, self.compounds, self.trust, self.most = links, vectors, compounds, trust, most

    def word(self, w: str, around: list[str]) -> str | None:
        """What a misrecognised word should be, if counts and the words around it agree."""
        best, score = None, 0.0
        own = self.vectors.fit(w.lower(), around)
        for v, lead in self.links.get(w, ()):
            near = self.vectors.fit(v.lower(), around) - own
            s = lead + max(-self.most, min(self.most, self.trust * near))
            if s > score:
                best, score = v, s
        return best

    def odd(self, w: str) -> bool:
        """A word with single digits for letters."""
        return bool(MIXED.fullmatch(w) and w[-2:].strip("0159") and sum(c.isdigit() for c in w) <= 2 and (w[0].isalpha() or w[1:].islower()))

    def words(self, text: str, words_around: int = 2) -> tuple[str, bool]:
        self.corrected: list[tuple[str, str]] = []
        different = set(TOKEN.findall(text))
        odd = {w for w in different if not w.isalpha() and w not in self.links and self.odd(w)}
        joined = {w for w in different if ("ﬁ" in w or "ﬂ" in w) and w not in self.links}
        linked = self.links.keys() & different
        if not linked and not joined:
            return text, bool(odd)
        found = list(TOKEN.finditer(text))
        low, out, at, hit = [x[0].lower() for x in found], [], 0, bool(odd or joined)
        for k, m in enumerate(found):
            w = m[0]
            if w in linked:
                v = self.word(w, low[max(0, k - words_around) : k] + low[k + 1 : k + 1 + words_around])
            elif w in joined:
                v = w.translate(LIGATURES)
            else:
                continue
            if v is not None:
                out += [text[at : m.start()], v]
                self.corrected.append((w, v))
                at, hit = m.end(), True
        return "".join(out) + text[at:], hit

    def joined(self, m: re.Match) -> str:
        a, mark, b = m[1], m[2], m[3]
        if mark == "-" and f"{a}-{b}".lower() in self.compounds:
            return f"{a}-{b}"
        return a + b

    def page(self, p: Page) -> str:
        lines = [x for i, x in enumerate(p.lines) if i not in p.drop]
        text = "\n".join(x.rstrip() for x in lines).strip("\n")
        if LINE_END.search(text):
            for m in SPLIT.finditer(text):
                if self.joined(m) == m[1] + m[3]:
                    p.kinds.add("hyphenation")
            while (new := SPLIT.sub(self.joined, text)) != text:
                text = new
        text, hit = self.words(text)
        if hit:
            p.kinds.add("characters")
        return reflow(text)


def reflow(text: str) -> str:
    """Paragraphs on one line each. A blank line ends one; so does a short line that ends a sentence."""
    lines = text.split("\n")
    width = max(map(len, lines), default=0)
    out, cur = [], []
    for line in lines:
        s = line.strip()
        if not s:
            if cur:
                out.append(" ".join(cur))
                cur = []
            continue
        cur.append(s)
        if len(line) < 0.7 * width and re.search(r"[.!?…][”\"’'»)]?$", s):
            out.append(" ".join(cur))
            cur = []
    if cur:
        out.append(" ".join(cur))
    return "\n\n".join(out)


def tallies(docs: DataFrame, text: str, scanned: str) -> DataFrame:
    """(a, b, n, m) over all rows, in one pass, added up in each task first.

    Of a word (b is null): how often it stands in all rows, and in those not scanned. Of the parts a and b, in lower case,
    of a compound: how often a line end splits it, and how often it stands whole.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def told() -> pd.DataFrame:
            rows = [(w, None, words[0][w] + words[1][w], words[0][w]) for w in words[0] | words[1] if not w.isdigit()]
            rows += [(*k, split[k], whole[k]) for k in split | whole]
            return pd.DataFrame(rows, columns=["a", "b", "n", "m"])

        words, split, whole = (Counter(), Counter()), Counter(), Counter()
        for p in batches:
            for t, k in zip(p[text], p[scanned], strict=True):
                words[bool(k)].update(all_words(t))
                if t and "-" in t:
                    whole.update(compounds_of(t.lower()))
                if t and LINE_END.search(t):
                    split.update(NEXT.findall(t.lower()))
            if len(words[0]) + len(words[1]) + len(whole) > 500_000:
                yield told()
                words, split, whole = (Counter(), Counter()), Counter(), Counter()
        yield told()

    return docs.select(text, scanned).mapInPandas(count, "a string, b string, n long, m long").groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def compounds(both: DataFrame, counts: DataFrame) -> DataFrame:
    """(a, b): the parts of the compounds a-b that line ends split and that stand whole more often than ab does.

    both: a, b, split, whole; counts: word, n. What line ends split speaks for neither. Only what is split
    somewhere is kept, so the result is small.
    """
    both = materialise(both.filter("split > 0").withColumn("w", F.concat("a", "b")), "compounds")
    joined = both.groupBy("w").agg(F.sum("split").alias("joined"))
    words = counts.groupBy(F.lower("word").alias("w")).agg(F.sum("n").alias("n")).join(joined, "w").select("w", (F.col("n") - F.col("joined")).alias("n"))
    return both.filter("whole > 0").join(words, "w", "left").filter(F.col("whole") > F.coalesce("n", F.lit(0))).select("a", "b")


def glyph_links(counts: DataFrame, sound_share: float = 0.0, ratio: int = 25, digit_ratio: int = 4, best: int = 3, least: int = 5, sound_ratio: int = 1, slack: float = 0.0) -> DataFrame:
    """(word, right, lead): a rare word and up to ``best`` frequent ones of its skeleton.

    A link needs the right word to be ``ratio`` times as frequent; ``lead`` is by how many nats it is more so, and may be
    below zero by ``slack``. A word that stands in scans only and has a right word that stands in other rows too needs
    ``sound_ratio``, so that rare names are targets as well, from ``least`` occurrences on; a word with digits needs ``digit_ratio``.
    ``sound_share`` is the share of all words that stands in rows not scanned. A word of which these have a fifth
    of their share or more is a word in its own right.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield p.assign(skeleton=[skeleton(w) for w in p["word"]])

    c = materialise(counts.filter(F.length("word").between(3, 40)).mapInPandas(fold, "word string, n long, sound long, skeleton string"), "words")
    w = Window.partitionBy("skeleton").orderBy(F.col("n").desc(), "word")
    top = c.filter((F.col("n") >= least) & ~F.col("word").rlike(r"[0-9ﬁﬂ]")).withColumn("_r", F.row_number().over(w)).withColumn("_m", F.max("n").over(w)).filter((F.col("_r") <= best) & (F.col("n") * ratio >= F.col("_m")))
    top = top.select("skeleton", F.col("word").alias("right"), F.col("n").alias("m"), F.col("sound").alias("right_sound"))
    odd = F.col("word").rlike(r"[0-9ﬁﬂ]")
    scans_only = (F.col("sound") == 0) & (F.col("right_sound") > 0)
    own = F.lit(False) if not sound_share else F.col("sound") >= F.greatest(F.lit(2.0), F.col("n") * (sound_share / 5))
    lead = F.log(F.col("m") / F.col("n")) - F.log(F.when(odd, digit_ratio).when(scans_only, sound_ratio).otherwise(ratio).cast("double"))
    return c.filter(~own).join(top, "skeleton").filter(F.col("word") != F.col("right")).select("word", "right", lead.alias("lead")).filter(F.col("lead") >= -slack - 1e-9)


def repaired(docs: DataFrame, sample: int | None = None, link_limit: int = 500_000, ratio: int = 25, slack: float = 1.5, trust: float = 0.5, most: float = 4.0, pages: int = PAGES) -> DataFrame:
    """(id, kinds, text) for each row of a scanned PDF file.

    docs: the columns of dual_documents that are read below. A row is of a scanned file if it has ``ocr_language``,
    ``ocr_triggered_by`` or ``ocr_confidence`` and is of type pdf; the confidence's value decides nothing. Repeated
    ids count once. Null and blank contents come out as empty text without kinds. A null page number is taken from
    the chunk's index. Words and compounds are counted and vectors learned over all rows; who gives ``sample`` has the
    vectors learned on so many rows only. ``pages`` is the number of pages above which a file is looked at in blocks of so many.
    """
    spark = docs.sparkSession
    d = latest(docs.select("id", "indexed_at", "collection", "file_path", "page_number", "chunk_index", "document_type", "ocr_language", "ocr_triggered_by", "ocr_confidence", "content"), "id", "indexed_at")
    scanned = (F.col("document_type") == "pdf") & (F.col("ocr_language").isNotNull() | F.col("ocr_triggered_by").isNotNull() | F.col("ocr_confidence").isNotNull())
    tally = materialise(tallies(docs.select("content", F.coalesce(scanned, F.lit(False)).alias("scanned")), "content", "scanned"), "tallies")
    counts = tally.filter("b is null").select(F.col("a").alias("word"), "n", F.col("m").alias("sound"))
    total = counts.agg(F.sum("n").alias("n"), F.sum("sound").alias("s")).first()
    known = vocabulary(counts)
    pairs = materialise(beside(d if sample is None else d.orderBy(F.xxhash64("id"), "id").limit(sample), "content", shared(spark, {"known": known})), "pairs")
    arrays = shared(spark, dict(zip(("known", "a", "b", "usual"), [known, *learned(spark, known, pairs)], strict=True)))

    def vectors() -> SkipGram:
        return SkipGram(*arrays())

    links = materialise(glyph_links(counts, (total["s"] or 0) / max(1, total["n"] or 0), ratio, slack=slack), "links")
    parts = tally.filter("b is not null").select("a", "b", F.col("n").alias("split"), F.col("m").alias("whole"))
    whole = broadcast(spark, {f"{r['a']}-{r['b']}" for r in compounds(parts, counts).toLocalIterator()})

    page = F.coalesce("page_number", F.col("chunk_index") + 1)
    file = F.xxhash64(F.coalesce("collection", F.lit("\0")), F.coalesce("file_path", F.lit("\0")))
    s = d.filter(scanned).select("id", file.alias("_f"), page.alias("page"), "content")
    long = materialise(s.groupBy("_f").count().filter(F.col("count") > pages).select("_f", F.ceil(F.col("count") / pages).alias("_n")), "long")
    s = s.join(long, "_f", "left")
    block = F.when(F.col("_n").isNull(), 0).otherwise(F.coalesce(F.floor(F.col("page") / pages), F.pmod(F.xxhash64("id"), F.col("_n"))))
    files = s.groupBy("_f", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("page", "id", "content"))).alias("pages"))

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for f, n, text in zip(p["_f"], p["page"], p["content"], strict=True):
                _, _, offsets, seen = edges([Page(None, None if pd.isna(n) else int(n), text)])
                yield pd.DataFrame([(f, None, o) for o in offsets] + [(f, w, None) for w in seen], columns=["_f", "word", "at"]).astype({"at": "Int64"})

    # What repeats in a long file, counted over all of its pages.
    votes = s.filter("_n is not null").select("_f", "page", "content").mapInPandas(vote, "_f long, word string, at long")
    votes = votes.groupBy("_f", "word", "at").agg(F.count("*").cast("int").alias("n")).filter("n > 1").groupBy("_f").agg(F.collect_list(F.struct("word", "at", "n")).alias("votes"))
    files = files.join(votes, "_f", "left") if long.take(1) else files.withColumn("votes", F.lit(None).cast("array<struct<word:string,at:long,n:int>>"))
    out = "id string, kinds array<string>, text string"

    def fix(pages, votes, repair: Repair) -> list[tuple]:
        ps = [Page(x["id"], x["page"], x["content"]) for x in pages]
        told = None if votes is None else (Counter({x["at"]: x["n"] for x in votes if x["word"] is None}), Counter({x["word"]: x["n"] for x in votes if x["word"] is not None}))
        mark_furniture(ps, told)
        done = [(p, repair.page(p)) for p in ps]
        return [(p.id, sorted(p.kinds), t) for p, t in done]

    if links.count() <= link_limit:
        known: dict[str, list[tuple[str, float]]] = {}
        for r in links.toLocalIterator():
            known.setdefault(r["word"], []).append((r["right"], r["lead"]))
        sent = broadcast(spark, known)

        def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            repair = Repair(sent(), vectors(), whole(), trust, most)
            for p in batches:
                yield pd.DataFrame([r for pages, v in zip(p["pages"], p["votes"], strict=True) for r in fix(pages, v, repair)], columns=["id", "kinds", "text"])

        return files.select("pages", "votes").mapInPandas(apply, out)

    # Too many links for every executor: each block's rare words are joined with theirs.
    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for f, b, pages in zip(p["_f"], p["block"], p["pages"], strict=True):
                ws = list({w for x in pages for w in TOKEN.findall(SPLIT.sub(lambda m: m[1] + m[3], x["content"] or ""))})
                yield pd.DataFrame({"_f": f, "block": b, "word": ws})

    own = files.select("_f", "block", "pages").mapInPandas(words, "_f long, block long, word string").join(links, "word").groupBy("_f", "block").agg(F.collect_list(F.struct("word", "right", "lead")).alias("links"))

    def apply_own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, hyphened = vectors(), whole()
        for p in batches:
            rows = []
            for pages, votes, ls in zip(p["pages"], p["votes"], p["links"], strict=True):
                known = {}
                for x in ls if ls is not None else ():
                    known.setdefault(x["word"], []).append((x["right"], x["lead"]))
                rows += fix(pages, votes, Repair(known, model, hyphened, trust, most))
            yield pd.DataFrame(rows, columns=["id", "kinds", "text"])

    return files.join(own, ["_f", "block"], "left").select("pages", "votes", "links").mapInPandas(apply_own, out)
