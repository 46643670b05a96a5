"""Problem 2: the k most similar vectors of every vector.

Shifted space-filling curves. Each curve turns the unit vectors by a rotation of its own, keeps ``dims``
coordinates, shifts them and puts them in the order of their Hilbert index. Spark range-partitions the rows by
(curve, index); each partition is read in blocks, and every block is compared with itself and the next, so that
a vector meets the 1 to 2 blocks on either side of it. Blocks are multiplied in single precision, and what comes near
the k-th place is computed again in double precision. The lists of all curves are merged per vector. A last
round orders the vectors by the least hash in their own neighbour lists, so that members of one neighbourhood
whom the curves kept apart meet, and merges again.

Work and memory grow in proportion to the rows: a block's size is fixed, equal indices are split by the row's
hash, and no list is longer than k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from ..session import materialise


PART_ROWS = 50_000


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """The Hilbert index of each row of ``x`` (unsigned integers below 2**bits), by Skilling's transform."""
    x, one = x.astype(np.uint64).T.copy(), np.uint64(1)
    top = q = one << np.uint64(bits - 1)
    while q > one:
        low = q - one
        for i in range(len(x)):
            set_ = (x[i] & q) != 0
            t = np.where(set_, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, t)
            x[i] ^= t
        q >>= one
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), top
    while q > one:
        t = np.where((x[-1] & q) != 0, t ^ (q - one), t)
        q >>= one
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for row in x:
            key = (key << one) | ((row >> np.uint64(b)) & one)
    return key.view(np.int64)


class Curves:
    """Rotations and shifts. Coordinates of unit vectors in d dimensions spread about 1 / sqrt(d)."""

    def __init__(self, n: int, size: int, dims: int, bits: int, seed: int):
        r = np.random.default_rng(seed)
        self.bits, self.scale = bits, size**0.5
        dims = min(dims, size)
        self.turn = [np.linalg.qr(r.normal(size=(size, size)))[0][:, :dims].astype(np.float32) for _ in range(n)]
        self.shift = r.uniform(0, 1, (n, dims)).astype(np.float32)

    def keys(self, x: np.ndarray, c: int) -> np.ndarray:
        y = (x @ self.turn[c] * self.scale + 3 + self.shift[c]) / 7 * (1 << self.bits)
        return hilbert(np.clip(y, 0, (1 << self.bits) - 1), self.bits)


#: So many places beyond the k-th are computed again in double precision.
SPARE = 6


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; the largest number first, for very small or large ones."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest_of(own: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray], sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each line of ``sims`` (the products of own and other, in single precision) the k best rows of other, in double precision."""
    (x, rows), (y, others) = own, other
    sims[rows[:, None] == others] = -np.inf
    near, at = best(sims, np.arange(len(others)), k + SPARE)
    s = np.where(np.isfinite(near), np.einsum("id,ijd->ij", x, y[at]), -np.inf)
    if s.shape[1] == k + SPARE:
        order = np.sort(near, axis=1)
        with np.errstate(invalid="ignore"):
            close = np.flatnonzero(order[:, SPARE] - order[:, 0] < 1e-6)  # single precision cannot tell what belongs here
        if len(close):
            whole = np.where(np.isfinite(sims[close]), x[close] @ y.T, -np.inf)
            s[close], at[close] = best(whole, np.arange(len(others)), k + SPARE)
    s, place = best(s, np.arange(s.shape[1]), k)
    return s, others[np.take_along_axis(at, place, 1)]


def best(sims: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest of each line of ``sims`` with their rows."""
    if sims.shape[1] > k:
        at = np.argpartition(sims, sims.shape[1] - k, axis=1)[:, -k:]
        return np.take_along_axis(sims, at, 1), rows[at]
    return sims, np.broadcast_to(rows, sims.shape)


def merged(owner: np.ndarray, rows: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per owner (sorted ascending on return) its k best distinct neighbours; ties by the neighbour's hash."""
    keep = np.isfinite(sims)
    owner, rows, sims = owner[keep], rows[keep], sims[keep]
    o = np.lexsort((rows, owner))
    owner, rows, sims = owner[o], rows[o], sims[o]
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (rows[1:] != rows[:-1])
    owner, rows, sims = owner[first], rows[first], sims[first]
    o = np.lexsort((rows, -sims, owner))
    owner, rows, sims = owner[o], rows[o], sims[o]
    start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.empty(0, np.int64)
    rank = np.arange(len(owner)) - np.repeat(start, np.diff(np.r_[start, len(owner)]))
    keep = rank < k
    return owner[keep], rows[keep], sims[keep]


def windows(batches: Iterator[pd.DataFrame], k: int, block: int, number: type) -> Iterator[pd.DataFrame]:
    """Compares sorted rows (curve, row, vec, id) block by block; lists of (row, neighbours, similarities)."""

    def vectors(p: pd.DataFrame) -> np.ndarray:
        return unit(np.frombuffer(b"".join(p["vec"]), number).reshape(len(p), -1))

    def ended(prev: dict) -> pd.DataFrame:
        s, r = np.concatenate(prev["s"], axis=1), np.concatenate(prev["r"], axis=1)
        s, at = best(s, np.arange(s.shape[1]), k)
        r = np.take_along_axis(r, at, 1)
        out = {"row": prev["rows"], "near": [x.tobytes() for x in np.ascontiguousarray(r)], "sims": [x.tobytes() for x in np.ascontiguousarray(s)]}
        first = prev["curve"] == 0
        return pd.DataFrame(out | {"vec": prev["vec"] if first else None, "id": prev["id"] if first else None})

    def blocks() -> Iterator[pd.DataFrame]:
        rest = None
        for p in batches:
            p = p if rest is None else pd.concat([rest, p], ignore_index=True)
            rest = None
            for _, part in p.groupby("curve", sort=True):
                whole = len(part) // block * block
                for i in range(0, whole, block):
                    yield part.iloc[i : i + block]
                if rest is not None:
                    yield rest  # the end of another curve
                rest = part.iloc[whole:] if whole < len(part) else None
        if rest is not None:
            yield rest

    prev = None
    for p in blocks():
        x, rows, curve = vectors(p), p["row"].to_numpy(), int(p["curve"].iloc[0])
        low, me = x.astype(np.float32), (x, rows)
        s, r = nearest_of(me, me, low @ low.T, k)
        now = {"me": me, "low": low, "rows": rows, "curve": curve, "s": [s], "r": [r], "vec": p["vec"].to_numpy(), "id": p["id"].to_numpy()}
        if prev is not None:
            if prev["curve"] == curve:
                cross = prev["low"] @ low.T
                s, r = nearest_of(prev["me"], me, cross, k)
                prev["s"].append(s), prev["r"].append(r)
                s, r = nearest_of(me, prev["me"], cross.T, k)
                now["s"].append(s), now["r"].append(r)
            yield ended(prev)
        prev = now
    if prev is not None:
        yield ended(prev)


def nearest(df: DataFrame, key: str, vector: str, size: int = 64, k: int = 10, curves: int = 4, dims: int = 12, bits: int = 5, block: int = 1536, seed: int = 2) -> DataFrame:
    """(key, neighbour, similarity): for each usable vector the k others most similar by cosine.

    A vector is usable if it has ``size`` numbers, none null or NaN or infinite, not all zero. ``key`` is expected to be
    unique; fewer than k others give fewer rows. Equal vectors are neighbours of similarity 1; ties at the last
    place go to the smaller hash of the key. ``dims * bits`` must be below 64.
    """
    assert dims * bits < 64
    spark = df.sparkSession
    ok = (F.size(vector) == size) & F.expr(f"exists({vector}, x -> x <> 0)") & F.expr(f"forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    d = df.filter(F.col(vector).isNotNull() & ok).select(F.col(key).cast("string").alias("id"), F.xxhash64(key).alias("row"), F.col(vector).cast("array<double>").alias("v"))
    number = np.float32 if isinstance(df.schema[vector].dataType.elementType, FloatType) else np.float64  # as the vectors come
    plan = Curves(curves, size, dims, bits, seed)
    # Partitions of about PART_ROWS rows, whatever the session's default: what one task reads does not grow.
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-d.count() * curves // PART_ROWS))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if not len(p):
                continue
            x = np.stack(p["v"].to_numpy())
            vec = [r.tobytes() for r in x.astype(number)]
            x = unit(x).astype(np.float32)
            for c in range(curves):
                yield pd.DataFrame({"curve": c, "key": plan.keys(x, c), "row": p["row"], "vec": vec, "id": p["id"] if c == 0 else None})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return windows(batches, k, block, number)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for p in batches:
            p = p if rest is None else pd.concat([rest, p], ignore_index=True)
            last = p["row"].to_numpy() == p["row"].iloc[-1]
            rest, p = p[last], p[~last]
            if len(p):
                yield merge_rows(p)
        if rest is not None:
            yield merge_rows(rest)

    def merge_rows(p: pd.DataFrame) -> pd.DataFrame:
        near, sims = np.frombuffer(b"".join(p["near"]), np.int64), np.frombuffer(b"".join(p["sims"]), np.float64)
        owner = np.repeat(p["row"].to_numpy(), [len(x) // 8 for x in p["near"]])
        owner, near, sims = merged(owner, near, sims, k)
        first = p[p["id"].notna()].drop_duplicates("row")
        rows = first["row"].to_numpy()
        a, b = np.searchsorted(owner, rows, "left"), np.searchsorted(owner, rows, "right")
        label = [min([r, *near[i:j].tolist()]) for r, i, j in zip(rows.tolist(), a, b, strict=True)]
        return pd.DataFrame({"row": rows, "id": first["id"].to_numpy(), "vec": first["vec"].to_numpy(), "label": label, "near": [near[i:j].tobytes() for i, j in zip(a, b, strict=True)], "sims": [sims[i:j].tobytes() for i, j in zip(a, b, strict=True)]})

    lists = "row long, near binary, sims binary, vec binary, id string"
    met = d.mapInPandas(keyed, "curve int, key long, row long, vec binary, id string")
    met = met.repartitionByRange(parts, "curve", "key", "row").sortWithinPartitions("curve", "key", "row").mapInPandas(compare, lists)
    graph = "row long, id string, vec binary, label long, near binary, sims binary"
    first = materialise(met.repartition(parts, "row").sortWithinPartitions("row").mapInPandas(merge, graph), "lists")

    again = first.select(F.lit(1).alias("curve"), F.col("label").alias("key"), "row", "vec", F.lit(None).cast("string").alias("id"))
    again = again.repartitionByRange(parts, "key", "row").sortWithinPartitions("key", "row").mapInPandas(compare, lists)
    both = again.unionByName(first.select("row", "near", "sims", F.lit(None).cast("binary").alias("vec"), "id"))
    last = both.repartition(parts, "row").sortWithinPartitions("row").mapInPandas(merge, graph)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            n = [len(x) // 8 for x in p["near"]]
            yield pd.DataFrame({"id": np.repeat(p["id"].to_numpy(), n), "near": np.frombuffer(b"".join(p["near"]), np.int64), "similarity": np.frombuffer(b"".join(p["sims"]), np.float64)})

    pairs = last.select("id", "near", "sims").mapInPandas(spread, "id string, near long, similarity double")
    names = first.select(F.col("row").alias("near"), F.col("id").alias("neighbour_id"))
    return pairs.join(names, "near").select("id", "neighbour_id", "similarity")
