"""Problem 5: text that was decoded with the wrong character encoding.

A multinomial classifier over hashed byte bigrams tells which chain of encodings a stretch of text went through,
"none" being one of the classes. It is trained here: a bounded sample of rows that look sound is garbled by
every chain. A row's words with characters outside ASCII are scored; the chain that explains the suspicious ones
best is inverted on each of them, and a word counts as restored only where the inverse decodes strictly and the
result is likelier as sound text than what stood there. A sequence that stands alone between quotation marks is
quoted, not garbled. Replacement characters (U+FFFD) cannot be inverted; they mark a row as affected all the same.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import WORD, bounded_sample, broadcast

BUCKETS = 1 << 14
SOUND = "none"
TOKEN = re.compile(r"[^ \n\r\t\f\v]+")
OTHER = re.compile(r"[^\x00-\x7f]")
#: A sequence alone in quotation marks: quoted, not garbled.
QUOTED = re.compile(r"([“\"'‘`«‹„(\[]\s?)([^\x00-\x7f]{1,8})(\s?[”\"'’`»›“)\]])")


#: A Greek or Cyrillic letter beside a Latin one.
MIXED = re.compile(r"[A-Za-z][\u0370-\u04ff]|[\u0370-\u04ff][A-Za-z]")


def _chains() -> dict[str, list[tuple[str, str]]]:
    """name -> steps (encoded as, decoded as)."""
    out = {}
    for read in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8-r", "cp1254", "iso8859-15", "iso8859-2", "cp1253"):
        out[f"utf-8>{read}"] = [("utf-8", read)]
    for read in ("cp1252", "latin-1", "mac_roman"):
        out[f"utf-8>{read} twice"] = [("utf-8", read), ("utf-8", read)]
    for wrote, reads in (("cp1252", ("cp850", "cp437", "mac_roman", "cp1251", "cp1253", "cp1250", "koi8-r")), ("mac_roman", ("cp1252", "latin-1", "cp437")), ("cp850", ("cp1252", "latin-1", "mac_roman")), ("cp437", ("cp1252", "latin-1"))):
        for read in reads:
            out[f"{wrote}>{read}"] = [(wrote, read)]
    return out


CHAINS = _chains()
#: Encodings whose undefined bytes are commonly read as the control character of that number.
LOOSE = ("cp1252", "cp1250", "cp1251", "cp1253", "cp1254")


def encode(text: str, codec: str) -> bytes:
    """Strict, but for the loose encodings' undefined bytes."""
    if codec not in LOOSE:
        return text.encode(codec)
    try:
        return text.encode(codec)
    except UnicodeEncodeError:
        return b"".join(bytes([ord(c)]) if "\x80" <= c <= "\x9f" or codec == "cp1252" and c <= "\xff" else c.encode(codec) for c in text)


def decode(data: bytes, codec: str) -> str:
    if codec not in LOOSE:
        return data.decode(codec)
    try:
        return data.decode(codec)
    except UnicodeDecodeError:
        return "".join(_one(b, codec) for b in data)


def _one(b: int, codec: str) -> str:
    try:
        return bytes([b]).decode(codec)
    except UnicodeDecodeError:
        return chr(b)


def garble(text: str, chain: str) -> str:
    """What becomes of a text by a chain; characters that the first encoding lacks are left out."""
    for wrote, read in CHAINS[chain]:
        text = decode(text.encode(wrote, "ignore"), read)
    return text


def invert(text: str, chain: str) -> str | None:
    """The text before the chain, or None where that is not strictly possible."""
    try:
        for wrote, read in reversed(CHAINS[chain]):
            text = encode(text, read).decode(wrote)
        return text
    except UnicodeError:
        return None


def bigrams(text: str) -> np.ndarray:
    """Buckets of the byte bigrams that touch a byte outside ASCII; the text's ends count as spaces."""
    b = np.frombuffer((" " + text + " ").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    keep = (b[:-1] >= 128) | (b[1:] >= 128)
    x = (b[:-1] << np.uint32(8) | b[1:])[keep]
    return (x * np.uint32(2654435761) >> np.uint32(18)).astype(np.int64)


class Classifier:
    """Multinomial naive Bayes over bigram buckets; row 0 is the class of sound text.

    ``common`` marks the buckets that sound text fills at least ``rare`` times: a word made of these alone is sound,
    however well a chain would explain it.
    """

    def __init__(self, sound: list[str], smooth: float = 0.1, rare: int = 4):
        self.names = [SOUND, *CHAINS]
        counts = np.zeros((len(self.names), BUCKETS), np.float32)
        words = Counter(w for t in sound for w in TOKEN.findall(t) if OTHER.search(w))
        for w, n in words.items():
            for c, name in enumerate(self.names):
                g = w if c == 0 else garble(w, name)
                if c == 0 or g != w:
                    np.add.at(counts[c], bigrams(g), n)
        self.common = counts[0] >= rare
        counts += smooth
        self.log = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)

    def scores(self, text: str) -> np.ndarray:
        return self.log[:, bigrams(text)].sum(axis=1)


def foreign_words(text: str) -> list[str]:
    """The words, in lower case, that have letters outside ASCII."""
    return [k for k in WORD.findall(text.lower()) if len(k) > 2 and not k.isascii()]


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


class Lexicon:
    """In how many rows each word with letters outside ASCII stands."""

    def __init__(self, words: np.ndarray, rows: np.ndarray):
        order = np.argsort(words)
        self.words, self.rows = words[order], rows[order]

    def count(self, word: str) -> int:
        h = word_hash(word)
        at = int(np.searchsorted(self.words, h))
        return int(self.rows[at]) if at < len(self.words) and self.words[at] == h else 0


class Repairer:
    """Judges rows; remembers the scores of words, of which most repeat.

    Without a lexicon a row that only its restored words can prove is left open: these words are what it waits for.
    """

    LIMIT = 200_000

    def __init__(self, model: Classifier, margin: float = 4.0, least: float = 14.0, lexicon: Lexicon | None = None):
        self.model, self.margin, self.least, self.lexicon = model, margin, least, lexicon
        self.seen: dict[str, np.ndarray | None] = {}

    def suspicion(self, word: str) -> np.ndarray | None:
        """By how much each chain explains a word better than no chain; None for a word that seems sound."""
        if word in self.seen:
            return self.seen[word]
        out = None
        if not self.model.common[bigrams(word)].all():
            s = self.model.scores(word)
            gain = s[1:] - s[0]
            out = gain if gain.max() > self.margin else None
        if len(self.seen) < self.LIMIT:
            self.seen[word] = out
        return out

    def chain_of(self, text: str) -> tuple[str, list[str]]:
        """The chain that explains the row's suspicious words best, and those words."""
        plain = QUOTED.sub(" ", text)
        odd, total = [], None
        for w in TOKEN.findall(plain):
            if OTHER.search(w) and "�" not in w and (g := self.suspicion(w)) is not None:
                odd.append(w)
                total = g if total is None else total + g
        if total is None or total.max() < self.least and not any(self.multibyte(w) for w in odd):
            return SOUND, odd
        names = self.model.names[1:]
        order = np.argsort(-total)
        # Of the chains that explain the words, likeliest first, the first that can be inverted on most of them.
        for c in order.tolist():
            if total[c] > self.margin and sum(self.restores(w, names[c]) is not None for w in odd) * 2 > len(odd):
                return names[c], odd
        return names[int(order[0])], odd

    def multibyte(self, word: str) -> bool:
        """A chain through UTF-8 has an inverse here, which hardly any sound sequence has."""
        return any(self.restores(word, c) is not None for c in CHAINS if c.startswith("utf-8"))

    @staticmethod
    def evidence(word: str, back: str) -> list[tuple[str, str]]:
        """(restored, as it stood): a chain between single-byte encodings inverts on anything, so a word that it restores counts if it stands in no fewer rows than what it is restored from."""
        was = foreign_words(word)
        return [(k, was[0] if was else "") for k in foreign_words(back)]

    def restores(self, word: str, chain: str) -> str | None:
        back = invert(word, chain)
        if back is None or back == word or not back:
            return None
        if not OTHER.search(back):
            return back if self.suspicion(word) is not None else None
        was, now = self.model.scores(word)[0] / max(1, len(bigrams(word))), self.model.scores(back)[0] / max(1, len(bigrams(back)))
        return back if now > was + 0.5 else None

    def judge(self, text: str | None) -> tuple[bool, str, bool, str | None]:
        """(affected, chain, fully restored, text after repair)."""
        *out, waits = self.judged(text)
        if waits is not None and not any(0 < self.lexicon.count(k) >= (self.lexicon.count(w) if w else 0) for k, w in waits):
            return self.unproven(text)
        return tuple(out)

    @staticmethod
    def unproven(text: str) -> tuple[bool, str, bool, str]:
        lost = "�" in QUOTED.sub(" ", text)
        return lost, "lossy" if lost else SOUND, False, text

    def judged(self, text: str | None) -> tuple[bool, str, bool, str | None, list[tuple[str, str]] | None]:
        """As ``judge``, and the words (restored, as they stood) of which one must be known for it to hold; None if none need be."""
        if not text or text.isascii():
            return False, SOUND, False, text, None
        lost = "�" in QUOTED.sub(" ", text)
        chain, odd = self.chain_of(text)
        if chain == SOUND:
            return *self.unproven(text), None
        fixed = {}
        for w in set(odd):
            back = self.restores(w, chain)
            if back is None:  # some parts of a row may have taken another way
                gain = self.suspicion(w)
                back = next((b for c in np.argsort(-gain).tolist() if gain[c] > self.margin and (b := self.restores(w, self.model.names[1 + c])) is not None), None)
            if back is not None:
                fixed[w] = back
        waits = None
        if fixed and not any(self.multibyte(w) for w in fixed) and not any(MIXED.search(w) for w in fixed):
            waits = list(dict.fromkeys(x for w, b in fixed.items() for x in self.evidence(w, b)))
            if not waits:
                return *self.unproven(text), None
        if not fixed:
            sure = any(float(self.suspicion(w).max()) > 4 * self.margin and self.multibyte(w) for w in odd)
            return lost or sure, chain if sure else "lossy" if lost else SOUND, False, text, None
        if len(fixed) == len(set(odd)) and not QUOTED.search(text):
            # All suspicious words took one chain: so did the words that look sound by chance, if all of them can be inverted.
            rest = {w: invert(w, chain) for w in set(TOKEN.findall(text)) if OTHER.search(w) and w not in fixed}
            if rest and all(rest.values()) and all(fixed[w] == invert(w, chain) for w in fixed):
                fixed |= rest
        out = TOKEN.sub(lambda m: fixed.get(m[0], m[0]), text)
        return True, chain, not lost and set(odd) <= set(fixed), out, waits


def lexicon(docs: DataFrame, text: str) -> DataFrame:
    """(word, rows): in how many rows each word with letters outside ASCII stands, over all rows; words by their hashes."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()
        for p in batches:
            for t in p["_t"]:
                c.update(set(foreign_words(t)))
            if len(c) > 300_000:
                yield pd.DataFrame({"word": [word_hash(w) for w in c], "rows": list(c.values())})
                c = Counter()
        yield pd.DataFrame({"word": [word_hash(w) for w in c], "rows": list(c.values())})

    some = docs.select(F.col(text).alias("_t")).filter(F.col("_t").rlike(r"[^\x00-\x7f]"))
    return some.mapInPandas(count, "word long, rows long").groupBy("word").agg(F.sum("rows").alias("rows"))


def sound_sample(docs: DataFrame, text: str, key: str, rows: int) -> list[str]:
    """At most ``rows`` texts with characters outside ASCII, in the order of the keys' hashes, without those that a chain through UTF-8 or a rare character makes doubtful."""
    texts = [r[text] for r in bounded_sample(docs.filter(F.col(text).rlike(r"[^\x00-\x7f]")), key, [text], rows)]
    multi = [c for c in CHAINS if c.startswith("utf-8") and "twice" not in c and "koi8" not in c and "cp437" not in c and "cp850" not in c]
    known: dict[str, bool] = {}

    def doubtful(word: str) -> bool:
        if word not in known:
            # Two or three characters that read as one letter of the Latin script or one mark.
            known[word] = any((b := invert(m[0], c)) and len(b) < len(m[0]) and all(ch < "ɐ" or " " <= ch <= "₿" for ch in b) for c in multi for m in re.finditer(r"[^\x00-\x7f]{2,}", word))
        return known[word]

    kept = [t for t in texts if "�" not in t and not any(doubtful(w) for w in TOKEN.findall(t) if OTHER.search(w))]
    seen = Counter(ch for t in kept for ch in set(t) if ch > "\x7f")
    usual = {ch for ch, n in seen.items() if n >= max(2, 0.004 * len(kept)) and (ch < "ɐ" or " " <= ch <= "₿" or "ﬀ" <= ch <= "ﬆ")}
    return [t for t in kept if all(ch <= "\x7f" or ch in usual for ch in t)]


def repaired(docs: DataFrame, key: str = "id", text: str = "content", sample: int = 4_000, margin: float = 4.0, words: int = 4_000_000) -> DataFrame:
    """(key, affected, chain, restored, text) for every row.

    ``restored`` tells that every affected word could be inverted; ``text`` is the row's text with the words that
    could. Null, empty and pure ASCII texts are unaffected. ``sample`` bounds the rows that train the classifier;
    every row is judged, and the lexicon is of all rows. Up to ``words`` words (16 bytes each) it is sent to the
    executors; a larger one is joined with the words that open rows wait for. Repeated keys give repeated rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    spark, d = docs.sparkSession, docs.select(F.col(key).alias(key), F.col(text).alias("_t"))
    load = broadcast(spark, Classifier(sound_sample(docs, text, key, sample)))
    known = materialise(lexicon(docs, text), "lexicon")
    columns = ["affected", "chain", "restored", "text"]
    out = f"{key} {kind}, affected boolean, chain string, restored boolean, text string"

    if known.count() <= words:
        rows = known.toPandas()
        load_words = broadcast(spark, Lexicon(rows["word"].to_numpy(np.int64), rows["rows"].to_numpy(np.int64)))

        def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            r = Repairer(load(), margin, lexicon=load_words())
            for p in batches:
                made = pd.DataFrame([r.judge(t) for t in p["_t"]], columns=columns)
                made.insert(0, key, p[key].to_numpy())
                yield made

        return d.mapInPandas(judge, out)

    def judge_open(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = Repairer(load(), margin)
        for p in batches:
            rows = []
            for t in p["_t"]:
                *made, waits = r.judged(t)
                hashed = None if waits is None else [(word_hash(k), word_hash(w) if w else None) for k, w in waits]
                rows.append((*made, hashed, *((None, None) if waits is None else (t, r.unproven(t)[0]))))
            made = pd.DataFrame(rows, columns=[*columns, "waits", "was", "lost"])
            made.insert(0, key, p[key].to_numpy())
            yield made

    made = materialise(d.mapInPandas(judge_open, out + ", waits array<struct<k:long,w:long>>, was string, lost boolean"), "judged")
    waiting = made.filter("waits is not null").withColumn("_row", F.xxhash64(key, "was"))
    asked = waiting.select("_row", F.explode("waits").alias("x")).select("_row", "x.k", "x.w").distinct()
    asked = asked.join(known.select(F.col("word").alias("k"), F.col("rows").alias("nk")), "k").join(known.select(F.col("word").alias("w"), F.col("rows").alias("nw")), "w", "left")
    proven = asked.filter(F.col("nk") >= F.coalesce("nw", F.lit(0))).select("_row").distinct().withColumn("_proven", F.lit(True))
    lost = F.col("lost")
    settled = waiting.join(proven, "_row", "left").select(
        key, (F.coalesce("_proven", F.lit(False)) | lost).alias("affected"), F.when(F.col("_proven"), F.col("chain")).when(lost, "lossy").otherwise(SOUND).alias("chain"),
        (F.coalesce("_proven", F.lit(False)) & F.col("restored")).alias("restored"), F.when(F.col("_proven"), F.col("text")).otherwise(F.col("was")).alias("text"),
    )
    return made.filter("waits is null").select(key, *columns).unionByName(settled)
