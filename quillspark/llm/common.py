"""Words, hashes and latest rows: what several operators share."""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

#: A word is a maximal run of Unicode letters and digits, lower-cased.
WORD = re.compile(r"[^\W_]+")
#: An odd multiplier for rolling hashes modulo 2**64.
ROLL = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class WordHash(dict):
    """word -> 64-bit hash, remembered up to a bound on its entries."""

    LIMIT = 500_000

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < self.LIMIT:
            self[word] = h
        return h


def hashed_words(text: str | None, cache: WordHash) -> np.ndarray:
    found = words(text)
    return np.fromiter(map(cache.__getitem__, found), np.uint64, len(found))


def grams(w: np.ndarray, n: int) -> np.ndarray:
    """Rolling hashes of every n consecutive word hashes; empty if there are fewer."""
    if len(w) < n:
        return w[:0]
    with np.errstate(over="ignore"):
        out = np.zeros(len(w) - n + 1, np.uint64)
        for k in range(n):
            out = out * ROLL + w[k : len(w) - n + 1 + k]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Parameters of n hash functions h -> h * a + c modulo 2**64, a odd."""
    r = np.random.default_rng(seed)
    a = r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, r.integers(0, 2**63, n, dtype=np.uint64)


#: So many repeated keys are broadcast at most; beyond, the keys are joined by shuffle.
FEW_KEYS = 200_000


def latest(df: DataFrame, key: str, at: str) -> DataFrame:
    """One row per key: the one with the latest ``at`` (of equal ones any; a null ``at`` is the earliest). Rows without key stay as they are.

    Only two narrow columns are shuffled to find the keys that repeat, and then only those keys' rows; the other
    rows pass where they are, by a join against the repeated keys, which are counted before they are broadcast.
    """
    seen = materialise(df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col(key).alias("_key")), "repeated")
    few = F.broadcast(seen) if seen.count() <= FEW_KEYS else seen
    same = df[key] == few["_key"]
    w = Window.partitionBy(key).orderBy(F.col(at).desc_nulls_last())
    again = df.join(few, same, "left_semi").withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    return df.join(few, same, "left_anti").unionByName(again)


def broadcast(spark, value):
    """A function that gives ``value`` in a worker. The value's class travels with it, so no import is needed there."""
    import pyspark.cloudpickle as cloudpickle

    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def load():
        import pickle

        return pickle.loads(sent.value)

    return load


def bounded_sample(df: DataFrame, key: str, columns: list[str], rows: int) -> list:
    """At most ``rows`` rows, those of the least hashes of ``key``, for training.

    The rows are counted first and only a share of about that many is kept by hash, so what is sent to the driver
    does not grow with the number of tasks.
    """
    n = df.count()
    h = F.xxhash64(key)
    share = min(1.0, (1.2 * rows + 100) / max(1, n))
    some = df.select(h.alias("_h"), *columns).filter(F.col("_h") < int(-(2**63) + share * (2**64 - 1))) if share < 1 else df.select(h.alias("_h"), *columns)
    return some.orderBy("_h", *columns).limit(rows).collect()
