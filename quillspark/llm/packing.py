"""Problem 7: documents into containers of fixed capacity.

Mixture-controlled packing. Every source is a queue in the order of its keys' hashes. Deficit round-robin gives
each source, in every window, as many tokens as its target share; what a queue could not place exactly is
carried to the next window. After any number of rounds a queue of share s has given s tokens a round, to within one
document, so a document that has c tokens of its queue before it falls into round c / s; and the tokens of all queues
up to a round, a sum of one term for each queue, tell the window. So the window of a document follows from
the running total of its queue alone: the totals of all parts of all queues are summed first, and each part then
goes on where the parts before it end, so deficits carry across windows and partitions without one task ever reading
a whole queue. A queue that ends early leaves its share to the others from then on.

Within a window, documents (and the pieces of documents longer than a container) are packed best fit, longest
first. Tokens are those of a public tokenizer, whose file is a parameter.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import broadcast

#: A byte-level BPE vocabulary in rank format, and the pre-tokenization pattern of its family.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


#: About so many rows of all queues lie in one range of hashes at most.
PART_ROWS = 1_000_000


def load_tokenizer(data: str | bytes):
    """The tokenizer of a file, or of what it contains."""
    import tiktoken

    data = data if isinstance(data, bytes) else Path(data).read_bytes()
    lines = (line.split() for line in data.splitlines() if line)
    ranks = {base64.b64decode(a): int(b) for a, b in lines}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Text goes to the tokenizer in stretches of about this size, cut before white space, where no token crosses.
STRETCH = 100_000


def count_tokens(encoding, text: str | None) -> int:
    """Tokens of a text. A very long one is counted in stretches; a cut is made where a word begins after a space."""
    if not text:
        return 0
    n, at = 0, 0
    while len(text) - at > STRETCH:
        cut = at + STRETCH
        while cut < len(text) and not (text[cut] == " " and text[cut - 1].isalpha() and text[cut + 1 : cut + 2].isalpha()):
            cut += 1
        n += len(encoding.encode_ordinary(text[at:cut]))
        at = cut
    return n + len(encoding.encode_ordinary(text[at:]))


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, longest first, each into the fullest container that still takes it."""
    order = np.argsort(-sizes, kind="stable")
    out = np.empty(len(sizes), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # containers by the space left
    spaces: list[int] = []  # the spaces of which there are containers, sorted
    n = 0
    for i in order.tolist():
        s = int(sizes[i])
        k = bisect_right(spaces, s - 1)
        if k < len(spaces):
            left = spaces[k]
            box = room[left].pop()
            if not room[left]:
                spaces.pop(k)
        else:
            left, box = capacity, n
            n += 1
        out[i] = box
        left -= s
        if not room[left]:
            spaces.insert(bisect_right(spaces, left), left)
        room[left].append(box)
    return out


class Rounds:
    """Which share of all tokens stands before a round, where every queue gives tokens by its target share.

    totals: tokens of each queue of ``targets``; ``rest``: tokens of all other queues, which come last.
    """

    def __init__(self, totals: dict[str, int], targets: dict[str, float], rest: int):
        self.ends = {q: n / targets[q] for q, n in totals.items() if n > 0}
        order = sorted(self.ends.items(), key=lambda x: x[1])
        at, placed, rate = [0.0], [0.0], sum(targets[q] for q in self.ends)
        for q, end in order:
            placed.append(placed[-1] + (end - at[-1]) * rate)
            at.append(end)
            rate -= targets[q]
        self.last = at[-1]
        self.at, self.placed = np.array([*at, self.last + 1]), np.array([*placed, placed[-1] + rest])

    def tokens_before(self, rounds: np.ndarray) -> np.ndarray:
        return np.interp(rounds, self.at, self.placed)


#: A tokenizer file is sent to the workers; a larger one is an error.
TOKENIZER_BYTES = 64 << 20


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", capacity: int = 2048, containers: int = 256, targets: dict[str, float] | None = None, tokenizer: str = TOKENIZER, parts: int = 64) -> DataFrame:
    """(key, piece, start_token, n_tokens, source, window, container), one row per document or piece of a longer one.

    ``containers`` is the size of a window in containers; a container's number is unique in the whole result. Null
    and empty texts have no tokens and take no place, so they do not appear. A null source is a source of its own,
    and so is an empty one. Without ``targets`` each source's share is its share of all tokens. ``targets`` maps
    sources to shares above zero; all other sources come after these, mixed by their own shares. Any number of sources
    will do: only those of ``targets`` are summed up on the driver. ``parts`` splits every queue, at least; larger tables
    are split finer. Repeated keys are packed each. ``tokenizer`` is a file of the driver's machine.
    """
    kind = docs.schema[key].dataType.simpleString()
    spark, vocabulary = docs.sparkSession, Path(tokenizer).read_bytes()
    if len(vocabulary) > TOKENIZER_BYTES:
        raise ValueError(f"the tokenizer file has more than {TOKENIZER_BYTES} bytes")
    load = broadcast(spark, vocabulary)
    d = docs.select(F.col(key).alias(key), F.col(source).cast("string").alias("source"), F.col(text).alias("_t"))

    def sized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = load_tokenizer(load())
        for p in batches:
            yield pd.DataFrame({key: p[key], "source": p["source"], "tokens": [count_tokens(encoding, t) for t in p["_t"]]})

    sizes = d.filter(F.length("_t") > 0).mapInPandas(sized, f"{key} {kind}, source string, tokens long")
    sizes = materialise(sizes.withColumn("_h", F.xxhash64(key, "source")), "sizes")
    parts = max(parts, -(-sizes.count() // PART_ROWS))
    queue = F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))
    if targets is not None:
        targets = {f"={s}" if s is not None else "null": float(x) for s, x in targets.items() if x > 0}
        queue = F.when(queue.isin(*targets), queue).otherwise("rest")
    # Parts are ranges of the hash, so that a queue's order is that of its parts.
    part = F.least(F.floor((F.col("_h").cast("double") + 2.0**63) / 2.0**64 * parts), F.lit(parts - 1)).cast("int")
    items = sizes.withColumn("_q", queue).withColumn("_p", part)
    totals = items.groupBy("_q", "_p").agg(F.sum("tokens").alias("n"))
    totals = materialise(totals, "totals")
    before = totals.withColumn("_before", F.sum("n").over(Window.partitionBy("_q").orderBy("_p")) - F.col("n")).select("_q", "_p", "_before")
    queues = totals.groupBy("_q").agg(F.sum("n").alias("_n"))
    whole = totals.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    window = capacity * containers
    run = Window.partitionBy("_q", "_p").orderBy("_h", key)
    few = totals.count() <= 100_000
    placed = items.join(F.broadcast(before) if few else before, ["_q", "_p"]).withColumn("_sum", F.col("_before") + F.sum("tokens").over(run) - F.col("tokens"))
    if targets is None:
        placed = placed.join(F.broadcast(queues) if few else queues, "_q").withColumn("_tokens", F.col("_sum") / F.col("_n") * F.lit(float(whole)))
    else:
        sums = {r["_q"]: r["_n"] for r in queues.collect()}  # the queues of ``targets`` and one more
        rest = sums.pop("rest", 0)
        rounds = Rounds(sums, targets, rest)

        @F.pandas_udf("double")
        def tokens_before(x: pd.Series) -> pd.Series:
            return pd.Series(rounds.tokens_before(x.to_numpy()))

        share = F.coalesce(F.create_map(*[F.lit(x) for q in sums for x in (q, targets[q])])[F.col("_q")], F.lit(1.0)) if sums else F.lit(1.0)
        at = F.when(F.col("_q") == "rest", F.lit(rounds.last) + F.col("_sum") / F.lit(float(max(1, rest)))).otherwise(F.col("_sum") / share)
        placed = placed.withColumn("_tokens", tokens_before(at))
    last = max(0, -(-whole // window) - 1)
    placed = placed.withColumn("window", F.least(F.floor(F.col("_tokens") / window).cast("long"), F.lit(last).cast("long")))

    def fill(p: pd.DataFrame) -> pd.DataFrame:
        tokens = p["tokens"].to_numpy()
        n = np.maximum(1, -(-tokens // capacity))
        owner = np.repeat(np.arange(len(p)), n)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        size = np.minimum(capacity, tokens[owner] - piece * capacity)
        order = np.lexsort((piece, p["_h"].to_numpy()[owner]))
        owner, piece, size = owner[order], piece[order], size[order]
        w = int(p["window"].iloc[0])
        # Windows hold whole documents, so they differ a little in size; numbers leave room for that.
        box = best_fit(size, capacity) + (w << 32)
        return pd.DataFrame({key: p[key].to_numpy()[owner], "piece": piece.astype("int32"), "start_token": piece * capacity, "n_tokens": size, "source": p["source"].to_numpy()[owner], "window": w, "container": box})

    cols = f"{key} {kind}, piece int, start_token long, n_tokens long, source string, window long, container long"
    return placed.select(key, "source", "tokens", "_h", "window").groupBy("window").applyInPandas(fill, cols)


def mixture(packed: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """(window, source, n_tokens, share, target): what each source has of each window, beside its target share (null if it has none)."""
    w = Window.partitionBy("window")
    whole = sum(x for x in (targets or {}).values() if x > 0)
    target = F.create_map(*[F.lit(v) for s, x in targets.items() if x > 0 for v in (s, x / whole)])[F.col("source")] if whole else F.lit(None).cast("double")
    rows = packed.groupBy("window", "source").agg(F.sum("n_tokens").alias("n_tokens"))
    return rows.select("window", "source", "n_tokens", F.round(F.col("n_tokens") / F.sum("n_tokens").over(w), 6).alias("share"), F.round(target, 6).alias("target"))
