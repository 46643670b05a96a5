"""Problem 8: evaluation texts inside corpus documents.

Size-partitioned MinHash containment search. The query sets are the passages of the items: every ``n``
consecutive words of an item, as its set of ``sub``-word shingles. The indexed sets are windows of the
documents, laid so that every run of ``n`` words lies wholly inside one. A window is put into a size partition
by its number of shingles; the partition's upper bound turns "contains all of the passage" into the smallest
Jaccard similarity a match can have, and from that follows how many single-hash bands are needed for the
wanted recall. Windows that meet a passage in some band are verified: a run of ``n`` words counts when its
words are equal to the item's.

The index of the items is a table like any other. Only its bitmaps, one for each band and one for whole passages, of a size
that is bounded, are sent to the executors; what passes them in the one scan of the documents is joined with the
passages and compared word by word. No document text is shuffled but the words of such candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import WORD, WordHash, broadcast, grams, hashed_words, permutations

#: Upper bounds of the size partitions, in multiples of the passage's number of shingles.
SIZES = (1.0, 1.5, 2.0, 2.5)


class Bitmaps:
    """Which values of each band, and which whole passages (the last map), the items have. A value's highest bits are its place."""

    def __init__(self, n: int, sub: int, miss: float, seed: int, bits: int, passage_bits: int):
        self.n, self.sub = n, sub
        q = n - sub + 1
        self.bounds = [max(q, int(q * s)) for s in SIZES]
        self.bounds[-1] = max(self.bounds[-1], 2 * n - 1 - sub + 1)
        self.bands = [1 if u <= q else math.ceil(math.log(miss) / math.log(1 - q / u)) for u in self.bounds]
        self.a, self.c = permutations(max(self.bands), seed)
        self.bits = [bits] * len(self.a) + [passage_bits]
        self.maps = [np.zeros(1 << max(0, b - 6), np.uint64) for b in self.bits]

    def places(self, k: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word of the map, bit in it) of each value."""
        at = values >> np.uint64(64 - self.bits[k])
        return (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))

    def has(self, k: int, values: np.ndarray) -> np.ndarray:
        word, bit = self.places(k, values)
        return (self.maps[k][word] & bit) != 0

    def of_items(self, texts: list[str], cache: WordHash) -> pd.DataFrame:
        """(map, word, bits) of some items."""
        values: list[list[np.ndarray]] = [[] for _ in self.bits]
        for t in texts:
            w = hashed_words(t, cache)
            g, s = grams(w, self.n), grams(w, self.sub)
            if len(g):
                view = np.lib.stride_tricks.sliding_window_view(s, self.n - self.sub + 1)
                with np.errstate(over="ignore"):
                    for j in range(len(self.a)):
                        values[j].append((view * self.a[j] + self.c[j]).min(axis=1))
                values[-1].append(g)
        out = []
        for k, v in enumerate(values):
            if v:
                word, bit = self.places(k, np.concatenate(v))
                order = np.argsort(word, kind="stable")
                u, start = np.unique(word[order], return_index=True)
                out.append(pd.DataFrame({"map": k, "word": u, "bits": np.bitwise_or.reduceat(bit[order], start).view(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"map": [], "word": [], "bits": []}).astype("int64")

    def search(self, docs: pd.DataFrame, cache: WordHash) -> list[tuple[int, int, str]]:
        """(doc, hash, words) of the runs of n words that may be a passage."""
        n, sub, out = self.n, self.sub, []
        texts = [WORD.findall(t.lower()) if t else [] for t in docs["text"]]
        lens = np.array([len(t) for t in texts], np.int64)
        keep = np.flatnonzero(lens >= n)
        if not len(keep):
            return out
        # Every document starts at a multiple of n and ends with at least n empty places.
        room = ((lens[keep] + n - 1) // n + 1) * n
        start = np.concatenate([[0], np.cumsum(room)])
        total = int(start[-1])
        flat, real = np.zeros(total, np.uint64), np.zeros(total, bool)
        for at, k in zip(start[:-1].tolist(), keep.tolist(), strict=True):
            m = int(lens[k])
            flat[at : at + m] = np.fromiter(map(cache.__getitem__, texts[k]), np.uint64, m)
            real[at : at + m] = True
        ends = np.repeat(start[:-1] + lens[keep], room)
        place = np.arange(total)
        s = np.zeros(total, np.uint64)
        s[: total - sub + 1] = grams(flat, sub)
        ok = place + sub <= ends
        blocks = total // n
        count = ok.reshape(blocks, n)
        size = count.sum(axis=1)
        head = n - sub  # a window goes on for so many shingles in the next block
        size[:-1] += count[1:, :head].sum(axis=1)
        inside = (place[::n] + n) <= ends[::n]
        hit = np.zeros(blocks, bool)
        part = np.searchsorted(self.bounds, size)
        top = np.uint64(2**64 - 1)
        for j in range(len(self.a)):
            live = inside & ~hit & (np.array(self.bands)[np.minimum(part, len(self.bands) - 1)] > j)
            if not live.any():
                break
            with np.errstate(over="ignore"):
                v = np.where(ok, s * self.a[j] + self.c[j], top).reshape(blocks, n)
            m = v.min(axis=1)
            m[:-1] = np.minimum(m[:-1], v[1:, :head].min(axis=1)) if head else m[:-1]
            maybe = np.flatnonzero(live)
            hit[maybe[self.has(j, m[maybe])]] = True
        if not hit.any():
            return out
        g = np.zeros(total, np.uint64)
        g[: total - n + 1] = grams(flat, n)
        check = np.flatnonzero(np.repeat(hit, n) & (place + n <= ends))
        found = check[self.has(len(self.a), g[check])]
        owner = np.searchsorted(start, found, side="right") - 1
        ids = docs["doc_id"].tolist()
        for p, o in zip(found.tolist(), owner.tolist(), strict=True):
            k, off = int(keep[o]), p - int(start[o])
            out.append((ids[k], int(g[p].view(np.int64)), " ".join(texts[k][off : off + n])))
        return list(dict.fromkeys(out))


#: Bits of the largest map of a band and of passages: 1 and 16 MB. More items make them let more through, which the join sorts out.
BAND_BITS, PASSAGE_BITS = 23, 27


def leaked_items(docs: DataFrame, items: DataFrame, n: int = 12, sub: int = 5, miss: float = 1e-6, band_bits: int = BAND_BITS, passage_bits: int = PASSAGE_BITS, seed: int = 8) -> DataFrame:
    """(doc_id, item_id) of documents and items that share ``n`` consecutive words; distinct.

    docs: doc_id, text. items: item_id, text; further columns are ignored. A null or empty text, and a text of
    fewer than n words, shares nothing. ``miss`` is the chance that the MinHash stage overlooks one passage.
    Repeated documents are each reported. The documents are scanned once, however many items there are: their bitmaps grow
    with them up to ``band_bits`` and ``passage_bits``, and are added up on the executors.
    """
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text").filter(F.col("text").isNotNull())
    spark, kind, item_kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHash()
        for p in batches:
            rows = []
            for item, text in zip(p["item_id"], p["text"], strict=True):
                found = WORD.findall(text.lower())
                g = grams(np.fromiter(map(cache.__getitem__, found), np.uint64, len(found)), n)
                rows += [(item, h, " ".join(found[k : k + n])) for k, h in enumerate(g.view(np.int64).tolist())]
            yield pd.DataFrame(rows, columns=["item_id", "gram", "words"])

    passages = materialise(items.mapInPandas(split, f"item_id {item_kind}, gram long, words string").distinct(), "passages")
    size = max(16, passages.count().bit_length())
    maps = Bitmaps(n, sub, miss, seed, min(band_bits, size + 7), min(passage_bits, size + 12))

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHash()
        for p in batches:
            yield maps.of_items(p["text"].tolist(), cache)

    empty = maps.maps
    maps.maps = []  # the maps are built from the marks; the workers that make these need only the parameters
    marks = items.mapInPandas(mark, "map long, word long, bits long").groupBy("map", "word").agg(F.bit_or("bits").alias("bits"))
    rows = marks.toPandas()  # at most as many words as the maps have
    for k, m in enumerate(empty):
        mine = rows[rows["map"] == k]
        m[mine["word"].to_numpy(np.int64)] = mine["bits"].to_numpy(np.int64).view(np.uint64)
    maps.maps = empty
    load = broadcast(spark, maps)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, index = WordHash(), load()
        for pdf in batches:
            yield pd.DataFrame(index.search(pdf, cache), columns=["doc_id", "gram", "words"])

    runs = docs.filter(F.col("text").isNotNull()).mapInPandas(search, f"doc_id {kind}, gram long, words string")
    return runs.join(passages, ["gram", "words"]).select("doc_id", "item_id").distinct()
