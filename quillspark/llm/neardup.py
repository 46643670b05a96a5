"""Problem 3: groups of records that share most of their content.

Texts are sets of word shingles; texts with the same set are one node from the start, so copies cost nothing.
A node's MinHash samples serve twice: folded by rows into band keys they propose pairs, and folded into an odd
sketch (a parity bitmap) they judge them: the XOR of two sketches has as many set bits as the samples differ,
so its population count estimates a high similarity closely, and a pair that passes with a margin is checked
exactly on the shingles.

Nothing collects a bucket: band rows are sorted by key and streamed. A bucket of more than ``hot`` nodes is not
paired where it is met but cut into blocks, and every two blocks are compared by their sketches in a task of
their own, which emits only what passes; no pair is dropped for skew.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import ROLL, WordHash, grams, hashed_words, latest, permutations

SKETCH_BITS = 512
#: Band rows of one task, about.
BAND_ROWS = 1_000_000
#: Sketches of one block of a large bucket.
BLOCK = 8_192


def node_of(shingles: np.ndarray) -> int:
    """A hash of the set, whatever its order."""
    with np.errstate(over="ignore"):
        x = shingles ^ (shingles >> np.uint64(31))
        h = np.sum(x * ROLL, dtype=np.uint64) + np.uint64(len(x)) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(30)
    return int(h.view(np.int64))


def shingles_of(text: str | None, n: int, least: int, cache: WordHash) -> np.ndarray | None:
    w = hashed_words(text, cache)
    return np.unique(grams(w, n)) if len(w) >= max(n, least) else None


def signature(shingles: np.ndarray, a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The MinHash samples; a very long text is taken in slices."""
    out = np.full(len(a), np.uint64(2**64 - 1))
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 4096):
            out = np.minimum(out, (shingles[i : i + 4096, None] * a + c).min(axis=0))
    return out


def odd_sketches(sigs: np.ndarray) -> np.ndarray:
    """The sketch of each line of samples, as SKETCH_BITS / 64 numbers."""
    with np.errstate(over="ignore"):
        x = (sigs + np.arange(sigs.shape[1], dtype=np.uint64) * ROLL) * np.uint64(0xD6E8FEB86659FD93)
        bits = (x >> np.uint64(40)).astype(np.int64) % SKETCH_BITS
    at = (bits + np.arange(len(sigs))[:, None] * SKETCH_BITS).ravel()
    parity = (np.bincount(at, minlength=len(sigs) * SKETCH_BITS) & 1).astype(np.uint8).reshape(-1, SKETCH_BITS)
    return np.packbits(parity, axis=1).view(np.int64)


def band_keys(sigs: np.ndarray, rows: int) -> np.ndarray:
    """The keys of all bands of each line of samples."""
    m = sigs.reshape(len(sigs), -1, rows)
    with np.errstate(over="ignore"):
        h = np.arange(m.shape[1], dtype=np.uint64) * np.uint64(0xA24BAED4963EE407) + np.zeros((len(sigs), 1), np.uint64)
        for k in range(rows):
            h = (h ^ m[:, :, k]) * ROLL
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


def lists(flat: np.ndarray, sizes: np.ndarray | list[int]) -> pa.ListArray:
    """Arrow lists of the given sizes, one after the other."""
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(np.ascontiguousarray(flat).ravel(), pa.int64()))


def most_bits(similarity: float, samples: int) -> int:
    """Bits in which the sketches of texts of this similarity differ, as expected."""
    return math.ceil(SKETCH_BITS / 2 * (1 - math.exp(-4 * samples * (1 - similarity) / SKETCH_BITS)))


class Pairs:
    """The pairs of nodes above the threshold, and which rows each node stands for."""

    def __init__(self, pairs: DataFrame, members: DataFrame):
        self.pairs, self.members = pairs, members


def similar_nodes(docs: DataFrame, key: str, text: str, *, n: int = 5, threshold: float = 0.8, least: int = 0, rows: int = 4, bands: int = 40, hot: int = 1000, block: int = BLOCK, margin: float = 0.2, verify_broadcast: int = 1_000_000, seed: int = 3) -> Pairs:
    """pairs(a, b): nodes of similarity >= threshold; members(node, key). One row per key is expected.

    A text is left out if it has fewer than ``least`` words, or fewer than ``n``; so are null and empty texts.
    ``margin`` is how far the sketch's estimate may lie below the threshold before the exact check is spared.
    A pair of similarity s is proposed with probability 1 - (1 - s**rows)**bands.
    """
    kind = docs.schema[key].dataType.simpleString()
    d = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    a, c = permutations(rows * bands, seed)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seen, names = WordHash(), set(), ["_k", "node", "bands", "sketch"]
        none = pa.list_(pa.int64())
        for b in batches:
            first, copies, sigs = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                s = shingles_of(t, n, least, cache)
                if s is None:
                    continue
                node = node_of(s)
                if node in seen:  # a copy in this task: its bands are there already
                    copies.append((i, node))
                    continue
                if len(seen) < 1_000_000:
                    seen.add(node)
                first.append((i, node))
                sigs.append(signature(s, a, c))
            if first:
                x = np.stack(sigs)
                bands_, sketch = band_keys(x, rows), odd_sketches(x)
                at, nodes = (pa.array(v, pa.int64()) for v in zip(*first, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), nodes, lists(bands_, [bands_.shape[1]] * len(x)), lists(sketch, [sketch.shape[1]] * len(x))], names)
            if copies:
                at, nodes = (pa.array(v, pa.int64()) for v in zip(*copies, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), nodes, pa.nulls(len(at), none), pa.nulls(len(at), none)], names)

    feats = materialise(d.mapInArrow(features, f"_k {kind}, node long, bands array<long>, sketch array<long>"), "features")
    keyed = feats.filter("bands is not null").select(F.explode("bands").alias("band"), "node")
    parts = max(2, int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-feats.count() * bands // BAND_ROWS))
    keyed = keyed.repartition(parts, "band").sortWithinPartitions("band", "node")

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pairs of small buckets; of a large one its members, each with the number of its block."""
        band, held, count = None, [], 0
        made: set[tuple[int, int]] = set()

        def rows_of() -> list[tuple]:
            if 1 < count <= hot:
                new = [(x, y) for i, x in enumerate(held) for y in held[i + 1 :] if (x, y) not in made]
                if len(made) < 500_000:
                    made.update(new)
                return [(x, y, None) for x, y in new]
            return []

        for p in batches:
            out = []
            for k, v in zip(p["band"].tolist(), p["node"].tolist(), strict=True):
                if k != band:
                    out += rows_of()
                    band, held, count = k, [v], 1
                elif v != held[-1]:
                    held.append(v)
                    count += 1
                    if count == hot + 1:
                        out += [(x, i // block, k) for i, x in enumerate(held)]
                        held = held[-1:]
                    elif count > hot:
                        out.append((v, (count - 1) // block, k))
                        held = [v]
            yield pd.DataFrame(out, columns=["a", "b", "band"]).astype({"band": "Int64"})
        last = rows_of()
        if last:
            yield pd.DataFrame(last, columns=["a", "b", "band"]).astype({"band": "Int64"})

    met = materialise(keyed.mapInPandas(pair, "a long, b long, band long"), "met")
    sketches = feats.filter("sketch is not null").select("node", "sketch").dropDuplicates(["node"])
    limit = most_bits(max(0.0, threshold - margin), rows * bands)
    left = sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sa"))
    right = sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))
    differ = sum((F.expr(f"bit_count(sa[{i}] ^ sb[{i}])") for i in range(1, SKETCH_BITS // 64)), F.expr("bit_count(sa[0] ^ sb[0])"))
    near = met.filter("band is null").select("a", "b").distinct().join(left, "a").join(right, "b").filter(differ <= limit).select("a", "b")

    members = met.filter("band is not null").select(F.col("a").alias("node"), F.col("b").alias("block"), "band")
    blocks = members.groupBy("band").agg((F.max("block") + 1).alias("blocks"))
    spread = (
        members.join(blocks, "band").join(sketches, "node")
        .select("band", "node", "block", "sketch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
        .select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "block", "sketch")
    )

    def compare(p: pd.DataFrame) -> pd.DataFrame:
        i, j = int(p["i"].iloc[0]), int(p["j"].iloc[0])
        x, y = p[p["block"] == i], p[p["block"] == j]
        sx, sy = (np.stack(z["sketch"].to_numpy()).view(np.uint64) if len(z) else np.empty((0, SKETCH_BITS // 64), np.uint64) for z in (x, y))
        nx, ny, out = x["node"].to_numpy(), y["node"].to_numpy(), []
        for r in range(len(nx)):
            ok = np.bitwise_count(sy ^ sx[r]).sum(axis=1) <= limit
            if i == j:
                ok[: r + 1] = False
            out += [(min(nx[r], v), max(nx[r], v)) for v in ny[ok] if v != nx[r]]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    hot_near = spread.groupBy("band", "i", "j").applyInPandas(compare, "a long, b long").distinct()
    near = materialise(near.unionByName(hot_near).distinct(), "near")

    # Exact check. The shingles of the nodes that are in some pair are made again, each from one of its texts.
    nodes = near.select(F.col("a").alias("node")).union(near.select(F.col("b").alias("node"))).distinct()
    texts = materialise(feats.select("node", F.xxhash64("_k").alias("_h")).join(nodes, "node", "left_semi").groupBy("node").agg(F.min("_h").alias("_h")).select("_h").distinct(), "texts")
    chosen = d.withColumn("_h", F.xxhash64("_k")).join(F.broadcast(texts) if texts.count() <= verify_broadcast else texts, "_h", "left_semi")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seen = WordHash(), set()
        for b in batches:
            nodes, sets = [], []
            for t in b.column(0).to_pylist():
                s = shingles_of(t, n, least, cache)
                if s is None:
                    continue
                node = node_of(s)
                if node in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(node)
                nodes.append(node)
                sets.append(s)
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), lists(np.concatenate(sets).view(np.int64), [len(x) for x in sets])], ["node", "set"])

    sets = chosen.select("_t").mapInArrow(shingled, "node long, set array<long>").dropDuplicates(["node"])
    both = near.join(sets.select(F.col("node").alias("a"), F.col("set").alias("xa")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("xb")), "b")
    same = F.size(F.array_intersect("xa", "xb"))
    exact = both.filter(same >= threshold * (F.size("xa") + F.size("xb") - same)).select("a", "b")
    return Pairs(exact, feats.select("node", F.col("_k").alias(key)))


def similar_pairs(found: Pairs, key: str, hold: int = 1_000) -> DataFrame:
    """(<key>_a, <key>_b), a < b: every two rows above the threshold, copies included; distinct, as keys are.

    The rows of a node that stands for more than ``hold`` are dealt over so many tasks, each of which has all of them on one side.
    """
    m = found.members
    x, y = m.select(F.col("node").alias("a"), F.col(key).alias("ka")), m.select(F.col("node").alias("b"), F.col(key).alias("kb"))
    across = found.pairs.join(x, "a").join(y, "b").select("ka", "kb")
    copies = m.join(m.groupBy("node").agg(F.ceil(F.count("*") / hold).cast("int").alias("_ways"), F.count("*").alias("_n")).filter("_n > 1"), "node")
    dealt = copies.select("node", F.pmod(F.xxhash64(key), F.col("_ways")).cast("int").alias("_s"), F.col(key).alias("ka"))
    every = copies.select("node", F.explode(F.sequence(F.lit(0), F.col("_ways") - 1)).alias("_s"), F.col(key).alias("kb"))
    within = dealt.join(every, ["node", "_s"]).filter("ka < kb").select("ka", "kb")
    return across.unionByName(within).select(F.least("ka", "kb").alias(f"{key}_a"), F.greatest("ka", "kb").alias(f"{key}_b"))


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): the least node each node is linked to, by alternating large-star and small-star steps.

    The edges are written to shared storage after each round; the number of rounds grows with the logarithm of
    the longest chain. Nodes without link do not appear.
    """
    edges = materialise(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        gone = new.exceptAll(edges).isEmpty() and edges.exceptAll(new).isEmpty()
        edges = new
        if gone:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def groups(found: Pairs, key: str) -> DataFrame:
    """One row per row that is similar to another: key, group_id (its group's least key), n_links (to other texts), n_rows."""
    pairs = materialise(found.pairs, "pairs")
    comp = components(pairs)
    links = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    rows = found.members.join(comp, "node", "left").join(links, "node", "left").select(key, F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    heads = rows.groupBy("root").agg(F.min(key).alias("group_id"), F.count("*").alias("n_rows")).filter("n_rows > 1")
    return rows.join(heads, "root").select(key, "group_id", "n_links", "n_rows")


def rows_once(docs: DataFrame) -> DataFrame:
    """The latest row of each id."""
    return latest(docs.select("id", "content", "indexed_at"), "id", "indexed_at").drop("indexed_at")
