"""Approximate top-k by an index of cells, so that a query reads a few cells and not all vectors.

Centres are learned on a bounded sample by k-means on the unit sphere. Every vector is put into the cell of its nearest
centre and written there; a query reads the cells of its nearest centres and ranks their vectors exactly.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vector_search


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def centres_of(x: np.ndarray, cells: int, rounds: int = 12, seed: int = 4) -> np.ndarray:
    """k-means on the sphere; an empty cell takes a vector that is far from its centre."""
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        sims = x @ c.T
        own = sims.argmax(axis=1)
        new = np.zeros_like(c)
        np.add.at(new, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=len(c)) == 0)
        if len(empty):
            new[empty] = x[np.argsort(sims.max(axis=1))[: len(empty)]]
        c = unit(new)
    return c


class CellIndex:
    """Vectors on files by cell. ``probe`` cells are read for a query: a twelfth of them, eight at least, unless told."""

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at
        about = json.loads(spark.read.text(f"{at}/about").first()["value"])
        self.key, self.vector, self.size = about["key"], about["vector"], about["size"]
        self.schema = T.StructType.fromJson(about["schema"])
        rows = spark.read.parquet(f"{at}/centres").orderBy("cell").collect()  # as many as there are cells
        self.centres = np.array([r["centre"] for r in rows], np.float64).reshape(len(rows), max(1, self.size))

    @staticmethod
    def build(points: DataFrame, key: str, vector: str, at: str, cells: int | None = None, sample: int = 20_000) -> CellIndex:
        """Every usable vector (not null, of the commonest size, not all zero) is indexed, with all its columns.

        ``sample`` bounds the vectors on which the centres are learned; ``cells`` is about the square root of the rows, 4,096 at most.
        """
        spark = points.sparkSession
        sized = points.filter(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").first()
        size = sized["n"] if sized else 0
        ok = points.filter((F.size(vector) == size) & F.expr(f"exists({vector}, x -> x <> 0) and forall({vector}, x -> x is not null and not isnan(x))"))
        n = ok.count()
        cells = cells or max(1, min(4096, int(n**0.5)))
        share = min(1.0, (1.2 * sample + 100) / max(1, n))
        some = ok.filter(F.xxhash64(key) < int(-(2**63) + share * (2**64 - 1))) if share < 1 else ok
        x = np.array([r[0] for r in some.select(F.col(vector).cast("array<double>")).limit(sample).collect()], np.float64).reshape(-1, max(1, size))
        centres = centres_of(unit(x), cells) if len(x) else np.empty((0, max(1, size)))
        sent = spark.sparkContext.broadcast(centres)  # cells times size numbers

        @F.pandas_udf("int")
        def cell(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            c = sent.value
            for v in parts:
                m = unit(np.stack(v.to_numpy()).astype(np.float64)) if len(v) else np.empty((0, c.shape[1]))
                yield pd.Series((m @ c.T).argmax(axis=1).astype("int32") if len(m) else np.empty(0, "int32"))

        ok.withColumn("_cell", cell(F.col(vector).cast("array<double>"))).repartition("_cell", F.pmod(F.xxhash64(key), F.lit(8))).write.partitionBy("_cell").parquet(f"{at}/vectors")
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{at}/centres")
        about = json.dumps({"key": key, "vector": vector, "size": size, "schema": points.schema.jsonValue()})
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.text(f"{at}/about")
        return CellIndex(spark, at)

    def search(self, query: list[float], limit: int = 10, probe: int | None = None) -> DataFrame:
        """The ``limit`` best rows of the cells nearest to the query, ties by key; only these cells' files are read."""
        if self.size and len(query) != self.size:
            raise ValueError(f"the index has vectors of {self.size} numbers")
        probe = probe or max(8, -(-len(self.centres) // 12))
        near = [] if not len(self.centres) else np.argsort(-(self.centres @ np.asarray(query, np.float64)), kind="stable")[:probe].tolist()
        if not near:
            return self.spark.createDataFrame([], T.StructType([f for f in self.schema.fields if f.name != self.vector]).add("score", "double"))
        rows = self.spark.read.schema(T.StructType(self.schema.fields + [T.StructField("_cell", T.IntegerType())])).parquet(f"{self.at}/vectors").filter(F.col("_cell").isin(near)).drop("_cell")
        return vector_search.search(rows, query, self.key, limit, vector=self.vector)
