import numpy as np

from quillspark.llm import neighbours as nb


def exact(x, k=10):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return [set(np.argsort(-r)[:k].tolist()) for r in s]


def test_recall_against_brute_force(spark):
    r = np.random.default_rng(0)
    centres = r.normal(size=(150, 64))
    x = (centres[r.integers(0, 150, 3000)] + 0.15 * r.normal(size=(3000, 64))) * r.uniform(0.1, 5, (3000, 1))
    df = spark.createDataFrame([(f"{i}", v.tolist(), "c") for i, v in enumerate(x)], "id string, embedding array<float>, vec string")  # a clashing column
    out: dict[int, set] = {}
    for a, b, _ in nb.nearest(df, "id", "embedding", block=128).collect():
        out.setdefault(int(a), set()).add(int(b))
    true = exact(x)
    assert all(len(v) == 10 and i not in v for i, v in out.items()) and len(out) == 3000
    assert np.mean([len(out[i] & true[i]) / 10 for i in out]) > 0.9


def test_similarities_are_double(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=64)
    x = (base + 1e-4 * r.normal(size=(60, 64))).astype(np.float32).astype(float)  # so near that single precision cannot tell them apart
    for kind in ("float", "double"):
        df = spark.createDataFrame([(f"{i:02d}", v.tolist()) for i, v in enumerate(x)], f"id string, embedding array<{kind}>")
        got: dict[int, set] = {}
        for a, b, s in nb.nearest(df, "id", "embedding").collect():
            got.setdefault(int(a), set()).add(int(b))
            u, v = x[int(a)], x[int(b)]
            assert abs(s - u @ v / np.linalg.norm(u) / np.linalg.norm(v)) < 1e-14
        assert np.mean([len(got[i] & t) / 10 for i, t in enumerate(exact(x))]) > 0.95


def test_unusable_vectors_and_ties(spark):
    one = [1.0] * 64
    rows = [("a", one), ("b", [2.0] * 64), ("c", [0.5] * 64), ("zero", [0.0] * 64), ("short", [1.0] * 3), ("none", None), ("nan", [float("nan")] + one[1:]), ("hole", [None] + one[1:])]
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    out = sorted((a, b, round(s, 6)) for a, b, s in nb.nearest(df, "id", "embedding").collect())
    assert out == [(a, b, 1.0) for a in "abc" for b in "abc" if a != b]
    assert nb.nearest(df.limit(0), "id", "embedding").count() == 0
    assert nb.nearest(df.filter("id = 'a'"), "id", "embedding").count() == 0


def test_a_third_of_all_rows_equal(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(900, 64))
    x[:300] = x[0]
    df = spark.createDataFrame([(f"{i}", v.tolist()) for i, v in enumerate(x)], "id string, embedding array<float>")
    out = nb.nearest(df, "id", "embedding", block=64).groupBy("id").count().collect()
    assert len(out) == 900 and {n for _, n in out} == {10}


def test_hilbert_neighbours_touch():
    """Along the curve of a full grid each step changes one coordinate by one."""
    g = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    order = g[np.argsort(nb.hilbert(g, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()
