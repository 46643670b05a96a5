"""Filtered top-k similarity search over one or many corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors

METRICS = {"cosine": (vectors.cosine, False), "dot": (vectors.dot, False), "euclid": (vectors.euclid, True)}


def scored(points: DataFrame, query: list[float], metric: str = "cosine", vector: str = "embedding", threshold: float | None = None, where: Column | None = None) -> DataFrame:
    """``points`` with a ``score``; rows without usable vector are left out, filters stand before the arithmetic."""
    f, ascending = METRICS[metric]
    df = points.filter(F.col(vector).isNotNull() & (F.size(vector) == len(query)))
    df = (df.filter(where) if where is not None else df).withColumn("score", f(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))).filter("score is not null")
    if threshold is not None:
        df = df.filter(F.col("score") <= threshold if ascending else F.col("score") >= threshold)
    return df


def search(points: DataFrame, query: list[float], key: str, limit: int = 10, offset: int = 0, metric: str = "cosine", vector: str = "embedding", threshold: float | None = None, where: Column | None = None) -> DataFrame:
    """The k best rows, ties by key. Ends in a TakeOrderedAndProject: each task keeps limit + offset rows."""
    df = scored(points, query, metric, vector, threshold, where).drop(vector)
    order = F.col("score").asc() if METRICS[metric][1] else F.col("score").desc()
    return df.orderBy(order, key).offset(offset).limit(limit) if offset else df.orderBy(order, key).limit(limit)


def search_corpora(points: DataFrame, query: list[float], key: str, corpus: str, corpora: list, limit: int = 10, offset: int = 0, **options) -> DataFrame:
    """A score-ordered page over several corpora, a rank within its corpus on each row.

    Each corpus contributes limit + offset rows at most (a WindowGroupLimit before the shuffle), which is all that a
    merge by score can use. A corpus that has no rows adds none; none at all is an error of the caller's catalog.
    """
    where = F.col(corpus).isin(*corpora)
    if options.get("where") is not None:
        where = where & options["where"]
    vector = options.get("vector", "embedding")
    df = scored(points, query, options.get("metric", "cosine"), vector, options.get("threshold"), where).drop(vector)
    order = F.col("score").asc() if METRICS[options.get("metric", "cosine")][1] else F.col("score").desc()
    w = Window.partitionBy(corpus).orderBy(order, key)
    df = df.withColumn("corpus_rank", F.row_number().over(w)).filter(F.col("corpus_rank") <= limit + offset)
    df = df.orderBy(order, F.array_position(F.array(*map(F.lit, corpora)), F.col(corpus)), "corpus_rank", key)
    return (df.offset(offset) if offset else df).limit(limit)


def page_size(n_corpora: int, limit: int, offset: int) -> int:
    """Rows asked of each corpus: twice the page for several, as stores with approximate answers need."""
    return (limit + offset) * 2 if n_corpora > 1 else limit + offset


def require_corpora(known: list[str], wanted: list[str]) -> list[str]:
    """The corpora to search: missing ones are passed over unless all are missing."""
    found = [c for c in wanted if c in known]
    if not found:
        raise LookupError(f"no such corpus: {', '.join(wanted)}")
    return list(dict.fromkeys(found))


def default_vector(named: dict) -> str:
    """The alphabetically first of the named vectors."""
    if not named:
        raise LookupError("the collection has no vectors")
    return min(named)


def validity(points: DataFrame, key: str, vector: str = "embedding", size: int = 64) -> DataFrame:
    """(key, fault, norm) of each row; a null fault is a usable vector."""
    return points.select(key, vectors.fault(F.col(vector), size).alias("fault"), F.round(vectors.norm(F.col(vector)), 6).alias("norm"))


def similar_pairs_exact(points: DataFrame, key: str, threshold: float, vector: str = "embedding", blocks: int | None = None) -> DataFrame:
    """(a, b, score) of all pairs above a cosine threshold, in blocks: for small corpora and for tests of indexes.

    The rows are dealt into blocks by hash, of about 4,000 rows unless told, and each two blocks meet in one task, so
    that a task holds no more on larger tables; the work is quadratic.
    """
    blocks = blocks or max(16, -(-points.count() // 4_000))
    v = points.filter(F.col(vector).isNotNull() & (vectors.norm(F.col(vector)) > 0)).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(key), F.lit(blocks)).alias("b"))
    spread = v.select("k", "v", "b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o")).select("k", "v", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    kind = points.schema[key].dataType.simpleString()

    def meet(p):
        import numpy as np
        import pandas as pd

        i, j = p["i"].iloc[0], p["j"].iloc[0]
        x, y = p[p["b"] == i], p[p["b"] == j]
        if not len(x) or not len(y):
            return pd.DataFrame({"a": x["k"].iloc[:0], "b": x["k"].iloc[:0], "score": np.empty(0)})
        u, w = (np.stack(z["v"].to_numpy()) for z in (x, y))
        s = (u / np.linalg.norm(u, axis=1)[:, None]) @ (w / np.linalg.norm(w, axis=1)[:, None]).T
        r, c = np.nonzero(s >= threshold)
        a, b, sc = x["k"].to_numpy()[r], y["k"].to_numpy()[c], s[r, c]
        keep = a < b if i == j else a != b
        lo, hi = np.where(a < b, a, b), np.where(a < b, b, a)
        return pd.DataFrame({"a": lo[keep], "b": hi[keep], "score": sc[keep]})

    return spread.groupBy("i", "j").applyInPandas(meet, f"a {kind}, b {kind}, score double")


def summary(hits: DataFrame) -> DataFrame:
    """Number, mean, highest and lowest score."""
    return hits.agg(F.count("*").alias("n_results"), F.round(F.avg("score"), 6).alias("avg_score"), F.round(F.max("score"), 6).alias("max_score"), F.round(F.min("score"), 6).alias("min_score"))
