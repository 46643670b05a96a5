"""Embedders behind one interface: an iterator UDF that loads its model once in each worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hash_model(size: int) -> Callable[[list[str]], np.ndarray]:
    """A deterministic model without weights: signed hashed words, to unit length. For tests and dry runs."""
    import re

    import xxhash

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"[^\W_]+", (t or "").lower()):
                h = xxhash.xxh64_intdigest(w)
                out[i, h % size] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1)

    return encode


MODELS: dict[str, Callable[[int], Callable[[list[str]], np.ndarray]]] = {"hash": hash_model}


def embedder(model: str = "hash", size: int = 64, prefix: str = "", clip: int | None = None, batch: int = 256) -> Callable[[Column], Column]:
    """A function from a text column to a vector column. ``prefix`` is the model's prompt; ``clip`` bounds the characters."""
    make = MODELS[model]

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make(size)
        for s in series:
            texts = [prefix + (t or "")[: None if clip is None else max(0, clip - len(prefix))] for t in s]
            order = sorted(range(len(texts)), key=lambda i: len(texts[i]))  # like lengths together
            out: list = [None] * len(texts)
            for k in range(0, len(order), batch):
                at = order[k : k + batch]
                for i, v in zip(at, encode([texts[i] for i in at]), strict=True):
                    out[i] = v
            yield pd.Series(out)

    return lambda c: embed(c)


# Embedding models in public use, by key: name, numbers of a vector, library, longest input in tokens (None: as the library has it), parameters in billions, what it is recommended for.
REGISTRY = [
    ("jina-code", "jinaai/jina-embeddings-v2-base-code", 768, "fastembed", None, None, "code"),
    ("jina-code-st", "jinaai/jina-embeddings-v2-base-code", 768, "sentence-transformers", 2048, 0.137, "code"),
    ("jina-code-0.5b", "jinaai/jina-code-embeddings-0.5b", 896, "sentence-transformers", 8192, 0.5, "code"),
    ("jina-code-1.5b", "jinaai/jina-code-embeddings-1.5b", 1536, "sentence-transformers", 8192, 1.5, "code"),
    ("codesage-large", "codesage/codesage-large", 1024, "sentence-transformers", 8192, 0.4, "code"),
    ("nomic-code", "nomic-ai/nomic-embed-code", 3584, "sentence-transformers", 8192, 7.0, "code"),
    ("qwen3-embed", "Qwen/Qwen3-Embedding-0.6B", 1024, "sentence-transformers", 8192, 0.6, "pdf"),
    ("gemma-embed", "google/embeddinggemma-300m", 768, "sentence-transformers", 2048, 0.3, "pdf"),
    ("stella", "dunzhang/stella_en_1.5B_v5", 1024, "sentence-transformers", None, 1.5, None),
    ("jina-v3", "jinaai/jina-embeddings-v3", 1024, "fastembed", None, None, "multilingual"),
    ("jina-base-en", "jinaai/jina-embeddings-v2-base-en", 768, "fastembed", None, None, None),
    ("bge-large", "BAAI/bge-large-en-v1.5", 1024, "fastembed", None, None, None),
    ("bge", "BAAI/bge-large-en-v1.5", 1024, "fastembed", None, None, None),
    ("bge-base", "BAAI/bge-base-en-v1.5", 768, "fastembed", None, None, None),
    ("bge-small", "BAAI/bge-small-en-v1.5", 384, "fastembed", None, None, None),
    ("arctic-m", "snowflake/snowflake-arctic-embed-m", 768, "fastembed", None, None, "docs"),
    ("mxbai-large", "mixedbread-ai/mxbai-embed-large-v1", 1024, "fastembed", None, None, "docs"),
    ("minilm", "sentence-transformers/all-MiniLM-L6-v2", 384, "sentence-transformers", None, 0.022, None),
    ("gte-base", "thenlper/gte-base", 768, "sentence-transformers", None, 0.110, None),
    ("e5-base", "intfloat/e5-base-v2", 768, "sentence-transformers", None, 0.110, None),
]
DEPRECATED = ("stella",)
LONGEST = 8192  # tokens, where a model says nothing


def catalogue(spark: SparkSession) -> DataFrame:
    """(key, name, dimensions, backend, max_seq_length, params_billions, default_for, deprecated, hard_limit_chars, batch_size) of the registry.

    ``hard_limit_chars`` is what no chunk for the model may exceed: two characters a token. The larger the model, the smaller the batch.
    """
    rows = [(k, n, d, b, m, p, [f] if f else [], k in DEPRECATED) for k, n, d, b, m, p, f in REGISTRY]
    df = spark.createDataFrame(rows, "key string, name string, dimensions int, backend string, max_seq_length int, params_billions double, default_for array<string>, deprecated boolean")
    size = F.col("params_billions")
    batch = F.when(size >= 5, 8).when(size >= 1, 16).when(size >= 0.3, 32).otherwise(128)
    return df.withColumn("hard_limit_chars", F.coalesce("max_seq_length", F.lit(LONGEST)) * 2).withColumn("batch_size", batch)
