import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import packing as pk

pytestmark = pytest.mark.skipif(not pk.Path(pk.TOKENIZER).exists(), reason="no tokenizer file")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=200))
def test_best_fit_never_overfills(sizes):
    s = np.array(sizes, np.int64)
    box = pk.best_fit(s, 50)
    used = np.bincount(box, weights=s) if len(s) else np.empty(0)
    assert (used <= 50).all()
    assert len(used) <= max(1, 2 * -(-int(s.sum()) // 50)) + 1


def test_everything_is_packed_once_and_mixed(spark):
    r = random.Random(0)
    rows = [(i, " ".join(f"word{r.randrange(999)}" for _ in range(r.randrange(1, 300))), "big" if i % 3 else f"s{i % 2}", 0) for i in range(900)]
    rows += [(1000, None, "big", 0), (1001, "", "big", 0), (1002, "tail " * 9000, None, 0), (1003, "same", "s0", 0), (1003, "same", "s0", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, window int")  # a clashing column
    p = pk.pack(df, containers=16, parts=4).toPandas()
    e = pk.load_tokenizer(pk.TOKENIZER)
    assert p.groupby("container").n_tokens.sum().max() <= 2048
    assert p.groupby("container").window.nunique().max() == 1
    got = p.groupby("doc_id").n_tokens.sum()
    for i, t, *_ in rows:
        if t and i != 1003:
            assert got[i] == len(e.encode_ordinary(t))
    assert set(p.doc_id) == {i for i, t, *_ in rows if t} and (p.doc_id == 1003).sum() == 2
    whole = p[p.piece == 0].set_index("doc_id")
    split = p[p.doc_id.isin(p[p.piece > 0].doc_id)]
    assert (split.groupby("doc_id").n_tokens.sum() > 2048).all() and len(whole)
    share = p.pivot_table(index="window", columns="source", values="n_tokens", aggfunc="sum").fillna(0)
    share = share.div(share.sum(axis=1), axis=0)["big"]
    all_big = p[p.source == "big"].n_tokens.sum() / p.n_tokens.sum()
    assert (share.iloc[:-1] - all_big).abs().max() < 0.2
    assert p.n_tokens.sum() / (p.container.nunique() * 2048) > 0.9


def test_target_shares_and_empty_table(spark):
    rows = [(i, "alpha beta gamma " * 30, "a" if i % 2 else "b") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    p = pk.pack(df, containers=4, parts=3, targets={"a": 3, "b": 1}).toPandas()
    assert len(p) == 600
    first = p[p.window == 0]
    assert abs((first.source == "a").mean() - 0.75) < 0.1
    assert pk.pack(df.limit(0)).count() == 0


def test_shares_hold_in_every_window_until_a_source_ends(spark):
    r = random.Random(1)
    rows = [(i, "alpha beta " * r.randrange(5, 60), {0: "a", 1: "b", 2: "c", 3: None, 4: ""}[i % 5]) for i in range(6000)]
    targets = {"a": 5, "b": 3, None: 1, "lacking": 4, "zero": 0}
    p = pk.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), containers=2, parts=5, targets=targets)
    assert p.count() == 6000
    m = pk.mixture(p, {"a": 5, "b": 3}).toPandas()
    assert set(m[m.source.isin(["a"])].target) == {0.625} and m[m.source.isna()].target.isna().all()
    got = p.toPandas()
    name = got.source.map(lambda s: "null" if s is None else s)
    t = got.assign(s=name).pivot_table(index="window", columns="s", values="n_tokens", aggfunc="sum").fillna(0)
    # By brute force: round after round, each queue gives its share while it lasts; then c and the empty source.
    left, want = {"a": t["a"].sum(), "b": t["b"].sum(), "null": t["null"].sum()}, {"a": 5, "b": 3, "null": 1}
    for w in range(len(t) - 1):
        room = 2 * 2048.0
        give = dict.fromkeys(left, 0.0)
        while room > 1e-6 and any(x > 1e-6 for x in left.values()):
            live = [s for s in left if left[s] > 1e-6]
            step = min(min(left[s] / want[s] for s in live), room / sum(want[s] for s in live))
            for s in live:
                left[s] -= step * want[s]
                give[s] += step * want[s]
                room -= step * want[s]
        assert all(abs(t[s][w] - give[s]) < 200 for s in give), w
    assert (t[["c", ""]].sum(axis=1) > 0).idxmax() >= len(t) * 0.55


def test_any_number_of_sources(spark):
    rows = [(i, "alpha beta gamma " * 5, f"s{i}") for i in range(3000)]
    p = pk.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), containers=2, parts=2)
    assert p.select("doc_id").distinct().count() == 3000
    q = pk.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), containers=2, parts=2, targets={f"s{i}": 1 for i in range(1000)}).toPandas()
    assert len(q) == 3000 and q[q.source.isin([f"s{i}" for i in range(1000)])].window.max() <= q[q.source == "s2000"].window.max()


def test_a_long_text_counts_as_whole():
    e = pk.load_tokenizer(pk.TOKENIZER)
    t = "The index keeps rows, and the crawl reads 12 pages. " * 6000
    assert pk.count_tokens(e, t) == len(e.encode_ordinary(t))
