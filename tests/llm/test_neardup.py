import itertools
import random

import numpy as np

from quillspark.llm import neardup as nd
from quillspark.llm.common import WordHash


def shingles(text, n=3):
    w = text.split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def corpus(seed=0, groups=12, size=4):
    r = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"g{g}w{r.randrange(1000)}" for _ in range(80)]
        for k in range(size):
            w = base[:]
            for _ in range(k * 2):
                w[r.randrange(80)] = f"e{r.randrange(10**6)}"
            out.append((f"{g:02d}-{k}", " ".join(w)))
    return out


def exact(rows, t=0.5):
    s = {k: shingles(x) for k, x in rows if x and len(x.split()) >= 20}
    return sorted((a, b) for a, b in itertools.combinations(sorted(s), 2) if len(s[a] & s[b]) >= t * len(s[a] | s[b]))


def find(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "id string, content string, node int, a int")  # clashing columns
    return nd.similar_nodes(df, "id", "content", n=3, threshold=0.5, least=20, **kw)


def pairs(found):
    return sorted(map(tuple, nd.similar_pairs(found, "id").collect()))


def test_pairs_equal_brute_force(spark):
    rows = [*corpus(), ("n", None), ("e", ""), ("s", "too short"), *[(f"copy{i}", corpus()[0][1]) for i in range(5)]]
    assert pairs(find(spark, rows)) == exact(rows)


def test_hot_buckets_lose_nothing(spark):
    """With buckets of three at most, everything goes through the compared blocks; the pairs are the same."""
    rows = corpus(3, 3, 9)
    got = pairs(find(spark, rows, hot=3, block=4))
    assert got == pairs(find(spark, rows)) and set(exact(rows, 0.58)) <= set(got)


def test_many_copies_are_dealt_over_tasks(spark):
    rows = [*corpus(2, 2, 3), *[(f"copy{i:02d}", corpus(2, 2, 3)[0][1]) for i in range(30)]]
    found = find(spark, rows)
    assert sorted(map(tuple, nd.similar_pairs(found, "id", hold=4).collect())) == exact(rows)


def test_exact_check_without_broadcast(spark):
    rows = corpus(5, 4, 3)
    assert pairs(find(spark, rows, verify_broadcast=0)) == exact(rows)


def test_groups_are_components(spark):
    rows = [*corpus(1, 3, 3), ("00-x", corpus(1, 3, 3)[0][1])]
    out = {r["id"]: r for r in nd.groups(find(spark, rows), "id").collect()}
    assert {r["group_id"] for r in out.values()} == {"00-0", "01-0", "02-0"}
    assert out["00-x"]["group_id"] == "00-0" and out["00-0"]["n_rows"] == 4


def test_a_long_chain_is_one_component(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r["root"] for r in nd.components(chain).collect()} == {0}


def test_empty_table(spark):
    found = nd.similar_nodes(spark.createDataFrame([], "id string, content string"), "id", "content")
    assert pairs(found) == [] and nd.groups(found, "id").count() == 0


def test_sketches_estimate_high_similarities():
    a, c = nd.permutations(160, 3)
    cache, r = WordHash(), np.random.default_rng(0)
    base = [f"w{i}" for i in range(400)]
    for share in (0.95, 0.8, 0.5):
        x, y = base[:], base[:]
        for i in r.choice(400, int(400 * (1 - share) / 2), replace=False):
            y[i] = f"z{i}"
        sx, sy = (nd.shingles_of(" ".join(v), 1, 0, cache) for v in (x, y))
        true = len(set(sx) & set(sy)) / len(set(sx) | set(sy))
        bits = sum(bin((p ^ q) & (2**64 - 1)).count("1") for p, q in zip(*nd.odd_sketches(np.stack([nd.signature(sx, a, c), nd.signature(sy, a, c)])).tolist(), strict=True))
        guess = 1 + nd.SKETCH_BITS / (4 * 160) * np.log(1 - 2 * bits / nd.SKETCH_BITS)
        assert abs(guess - true) < 0.15
