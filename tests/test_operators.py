import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import paths
from quillspark.functions import text as tx
from quillspark.functions import vectors
from quillspark.operators import chunkers, dml, fulltext, integrity, listings, sync, vector_search


def score(text):
    """The quality score, stated again in plain Python."""
    if not text or not text.strip():
        return 0.0
    words = re.findall("[a-zA-Z]+", text.lower())
    stop = sum(w in tx.QUALITY_STOP_WORDS for w in words) / len(words) if words else 0
    mean = sum(map(len, words)) / len(words) if words else 0
    ok = sum(32 <= ord(c) <= 126 or c in "\n\r\t" for c in text) / len(text)
    length = 0.0 if not words else 0.2 if mean > 15 or mean < 2 else 0.6 if mean > 10 else 1.0
    return round(min(1, max(0, 0.35 * max(0, 1 - 10 * text.count("�") / len(text)) + 0.3 * min(1, stop / 0.15) + 0.2 * min(1, ok / 0.7) + 0.15 * length)), 3)


TEXTS = ["", "   ", "\u00a0\u00a0", "\x1c", None, "The index of the corpus is in it.", "���", "a� the", "12345 !!", "abcdefghijklmnopqrst", "é" * 50, "x y z", "😀 and the", "word " * 500, "electroencephalograph internationalization"]


def test_quality_functions(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = {r["i"]: r for r in df.select("i", tx.score_text(F.col("t")).alias("s"), tx.needs_ocr(F.col("t")).alias("o"), tx.is_blank(F.col("t")).alias("b")).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i]["s"] == pytest.approx(score(t), abs=0.0011), t
        assert got[i]["b"] == (not t or not t.strip())
    assert [got[i]["o"] for i in (0, 2, 5, 6)] == [True, True, False, True]


def test_strings(spark):
    one = lambda e: spark.range(1).select(e.alias("x")).first()["x"]
    assert one(tx.slugify(F.lit("  Hello, World_of  Ünits! "))) == "hello-world-of-nits" and one(tx.slugify(F.lit("!!!"))) == "untitled" and len(one(tx.slugify(F.lit("ab " * 40)))) <= 50
    assert one(tx.snippet(F.lit("a" * 300))) == "a" * 200 + "..." and one(tx.snippet(F.lit("short"))) == "short"
    assert one(tx.snippet(F.lit("x" * 180 + " " + "y" * 100))) == "x" * 180 + "..." and one(tx.snippet(F.lit("x " + "y" * 300))) == ("x " + "y" * 300)[:200] + "..."
    assert [one(tx.format_size(F.lit(n))) for n in (0, 1023, 1024, 1536, 2304, 1048576)] == ["0.0 B", "1023.0 B", "1.0 KB", "1.5 KB", "2.2 KB", "1.0 MB"]
    assert [one(tx.format_duration(F.lit(n))) for n in (45, 180, 185, 3600, 3725)] == ["45s", "3m", "3m 5s", "1h", "1h 2m"]
    assert one(tx.sanitize(F.lit("a\x00b\tc\n"))) == "a b\tc\n"
    assert one(tx.title(F.lit("x\n# One\n## Two"), F.lit("stem"))) == "One" and one(tx.headings(F.lit("# One\nx\n## Two"))) == "One | Two" and one(tx.title(F.lit("none"), F.lit("stem"))) == "stem"


def test_paths(spark):
    one = lambda e: spark.range(1).select(e.alias("x")).first()["x"]
    lit = F.lit
    assert one(paths.under(lit("/a/b"), lit("/a/b/"))) and one(paths.under(lit("/a/b/c"), lit("/a/b"))) and not one(paths.under(lit("/a/bc"), lit("/a/b")))
    assert one(paths.detach(lit("/a/b/c"), lit("/a"))) == "b/c" and one(paths.detach(lit("/x/c"), lit("/a"))) == "/x/c" and one(paths.attach(lit("b/c"), lit("/n/"))) == "/n/b/c" and one(paths.attach(lit("/b"), lit("/n"))) == "/b"
    assert one(paths.remap(lit("/a/b/c"), [("/a/b", "/x"), ("/a", "/y")])) == "/x/c" and one(paths.remap(lit("/a/d"), [("/a/b", "/x"), ("/a", "/y")])) == "/y/d" and one(paths.remap(lit("/ab"), [("/a", "/y")])) == "/ab"
    for url, want in (("https://user:pass@host/a/b.git", "https://host/a/b.git"), ("http://host:8080/x", "http://host:8080/x"), ("git@host:u/p.git", "git@host:u/p.git")):
        assert one(paths.strip_credentials(lit(url))) == want
    for url, want in (("https://h/u/my-project.git", "my-project"), ("git@h:u/p.git", "p"), ("git@h:p.git", "p"), (None, "root"), ("plain", "root")):
        assert one(paths.project_of(lit(url).cast("string"), lit("/x/root/"))) == want
    assert one(paths.version_id(lit("n"), lit("b"), lit("0123456789"))) == "n#b@0123456" and one(paths.version_id(lit("n"), lit("b"), lit(None).cast("string"))) == "n#b@unknown"
    assert one(paths.language_of(lit("/a/X.PY"))) == "python" and one(paths.language_of(lit("/a/noext"))) is None and one(paths.language_of(lit("/a.b/.hidden"))) is None
    assert one(paths.row_id(lit(None).cast("string"), lit("a"))) != one(paths.row_id(lit(""), lit("a")))
    assert one(paths.quick_hash(lit(1700000000000), lit(42))) == __import__("xxhash").xxh64_hexdigest("1700000000000:42")
    assert one(paths.text_hash(lit("a\r\nb"))) == one(paths.text_hash(lit("a\nb"))) and one(paths.file_hash(lit(b"x"))) == __import__("xxhash").xxh64_hexdigest(b"x")


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 2.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0]), (7, [float("nan"), 1.0]), (8, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, embedding array<float>")
    hits = vector_search.search(df.filter("id < 7 or id = 8"), [1.0, 0.0], "id", limit=4).collect()
    assert [r["id"] for r in hits] == [1, 8, 2, 3] and hits[2]["score"] == pytest.approx(1 / math.sqrt(2))
    assert [r["id"] for r in vector_search.search(df.filter("id < 4"), [1.0, 0.0], "id", metric="euclid", threshold=1.5).collect()] == [1, 2]
    assert {r["id"]: r["fault"] for r in vector_search.validity(df, "id", size=2).collect()} == {1: None, 2: "flat", 3: None, 4: "zero", 5: "missing", 6: "size", 7: "nan", 8: None}
    plan = vector_search.search(df, [1.0, 0.0], "id")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert vector_search.page_size(1, 10, 5) == 15 and vector_search.page_size(3, 10, 5) == 30
    assert vector_search.require_corpora(["a", "b"], ["b", "x", "b"]) == ["b"]
    with pytest.raises(LookupError):
        vector_search.require_corpora(["a"], ["x"])
    assert vector_search.default_vector({"b": 1, "a": 2}) == "a"
    q = spark.createDataFrame([([0.5, -3.0, 9.0],)], "v array<double>").select(vectors.quantized(F.col("v"), 3.0).alias("x")).first()["x"]
    assert list(q) == [21, -127, 127]


DOCS = [(1, "the vector store keeps the index", "a.md", "en"), (2, "index of vectors, and the store", "index.md", "en"), (3, "nothing here", "vector.md", "fr"), (4, None, None, "fr"), (5, "the vecter store", "b.md", "en")]


def test_full_text(spark):
    df = spark.createDataFrame(DOCS, "id int, content string, filename string, lang string")
    s = fulltext.index_settings("markdown")
    find = lambda q, **k: [r["id"] for r in fulltext.search(df, "id", q, s, **k).collect()]
    assert find("vector store") == [1, 2, 5] or find("vector store") == [1, 5, 2]
    assert find('"vector store"') == [1] and find("vec") == [1, 2, 5, 3] and find("the") == find("") == [1, 2, 3, 4, 5]
    assert find("vector", where=F.col("lang") == "fr") == [3] and find("vector", limit=1) == [1]
    assert find("indxe") == [] and find("stoer") == []  # two letters swapped are two edits
    words = spark.range(1).select(fulltext.highlight(F.lit("Index the index, indexed"), ["index"]).alias("x")).first()["x"]
    assert words == "<em>Index</em> the <em>index</em>, indexed"
    rr = fulltext.round_robin(df, "lang", ["fr", "en", "fr"], [F.col("id")], 4)
    assert [r["id"] for r in rr.collect()] == [3, 1, 4, 2]
    with pytest.raises(KeyError):
        fulltext.index_settings("nope")
    s["stop_words"].append("x")
    assert "x" not in fulltext.index_settings("markdown")["stop_words"]


def test_change_detection(spark):
    mk = lambda rows: spark.createDataFrame(rows, "file_path string, quick_hash string, file_hash string")
    old, new = mk([("/a/1", "q1", "h1"), ("/a/2", "q2", "h2"), ("/a/3", "q3", "h3"), ("/ab/4", "q4", "h4")]), mk([("/a/1", "q1", "h1"), ("/a/2", "qx", "hx"), ("/a/9", "q9", "h3"), ("/a/8", None, "h1"), ("/a/7", "q7", None)])
    names = lambda df: sorted(r["file_path"] for r in df.collect())
    assert names(sync.unchanged(new, old)) == ["/a/1"] and names(sync.changed(new, old)) == ["/a/2", "/a/7", "/a/8", "/a/9"]
    assert {(r["old_path"], r["new_path"]) for r in sync.renames(new, old).collect()} == {("/a/3", "/a/9")}
    assert {(r["new_path"], r["old_path"]) for r in sync.duplicates_elsewhere(new, old).collect()} == {("/a/8", "/a/1")}
    assert names(sync.stale(old, new, ["/a"])) == ["/a/3"] and names(sync.orphans(old, new)) == ["/a/3", "/ab/4"]
    assert {r["file_path"]: r["status"] for r in sync.classified(new, old).collect()}["/a/2"] == "modified"
    assert names(dml.prune(old, new, ["/a"])) == ["/a/1", "/a/2", "/ab/4"]
    moved = dml.rename(old.withColumn("filename", F.lit("x")), spark.createDataFrame([("/a/3", "/b/n.md")], "old_path string, new_path string"))
    assert ("/b/n.md", "n.md") in {(r["file_path"], r["filename"]) for r in moved.collect()} and moved.count() == 4


def test_phases(spark):
    rows = [(1, 6.0), (2, None), (3, 4.0), (4, 1.0), (5, 6.0)]
    df = spark.createDataFrame(rows, "k int, at double")
    got = [(r["phase"], r["segment"]) for r in sync.phases(df, F.lit(5.0), F.lit(3.0), "at", "k").orderBy("k").collect()]
    assert got == [("arrived", 0), ("arrived", 0), ("covered", 1), ("backlog", 2), ("arrived", 3)]


def test_completeness(spark):
    rows = [("dup", 0, 2), ("dup", 1, 2), ("dup", 0, 2), ("dup", 1, 2), ("tail", 0, 3), ("tail", 1, 3), ("conflict", 0, 3), ("conflict", 1, 2), ("ok", 0, 1), ("more", 0, 1), ("more", 4, 1), ("none", None, 2), ("null", 0, None)]
    df = spark.createDataFrame(rows, "f string, chunk_index int, chunk_count int")
    got = {r["f"]: r for r in integrity.file_completeness(df, ["f"]).collect()}
    assert got["dup"]["duplicate_chunks"] == 2 and got["dup"]["is_complete"] and got["tail"]["missing_indices"] == [2] and got["conflict"]["expected_chunks"] == 3 and not got["conflict"]["is_complete"]
    assert got["ok"]["is_complete"] and got["more"]["unexpected_indices"] == [4] and "none" not in got and not got["null"]["is_complete"]


def test_listings(spark):
    df = spark.createDataFrame([("/a/b/1",), ("/a/b/2",), ("/a/bc/3",)], "file_path string")
    assert listings.common_root(df).first()["root"] == "/a" and listings.common_root(df.filter("file_path < '/a/bc'")).first()["root"] == "/a/b" and listings.common_root(df.limit(0)).first()["root"] is None
    arrays = spark.createDataFrame([("c", ["x", "y"]), ("c", ["x"])], "collection string, file_path array<string>")
    assert tuple(listings.distinct_items(arrays, ["collection"]).first()) == ("c", 3, 2)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab. \n;,{}", max_size=1500), st.integers(20, 200))
def test_no_text_is_lost(text, size):
    assert "".join(s for s in chunkers.cut_line(text.replace("\n", ""), size)) == text.replace("\n", "")
    lines = [x for c in chunkers.line_chunks(text, size, 0) for x in c.split("\n")]
    assert "".join(lines).replace("\n", "") == "".join(text.split("\n")) or not text.strip()
    windows = chunkers.hard_windows(text, size)
    assert all(len(w) <= size for *_, w in windows) and all(text[a:b] == w for a, b, w in windows)
    covered = set()
    for a, b, _ in windows:
        covered |= set(range(a, b))
    assert covered == set(range(len(text)))


def test_sentence_windows():
    text = "".join(f"Sentence number {i} stands here. " for i in range(200))
    got = chunkers.sentence_windows(text, 100)
    assert all(c.endswith(".") for *_, c in got[:-1]) and got[0][0] == 0 and all(b[0] < a[1] for a, b in zip(got, got[1:], strict=False))


MARKDOWN = "---\ntitle: x\n---\nintro\n\n# One\n\n" + "word " * 60 + "\n\n## Small\n\ntext\n\n```\n# no heading\n```\n\n# Two\n\n" + ("para " * 100 + "\n\n") * 8 + "## End\n\nshort\n"


def test_markdown():
    got = chunkers.markdown_chunks(MARKDOWN)
    assert got[0][0] == "One" and got[0][1].startswith("intro") and any("# no heading" in c for _, c in got)
    assert all(c.startswith("# Two") for p, c in got if p == "Two" and "word" not in c and "no heading" not in c) and got[-1][1].rstrip().endswith("short")
    assert all(len(c) <= 600 for _, c in chunkers.markdown_chunks(MARKDOWN, most=600)) and chunkers.markdown_chunks("") == []
    for w in ("intro", "short", "# One", "## Small", "## End"):
        assert any(w in c for _, c in got)


def test_definitions():
    code = "import os\n\n@dec\ndef f(x):\n    def g():\n        pass\n    return x\n\nclass A:\n    def m(self):\n        pass\n\nX = 1\n"
    got = {(q, k, a, b) for _, q, k, a, b, _ in chunkers.definitions("a.py", code)}
    assert got == {("f", "function", 3, 7), ("f.g", "function", 5, 6), ("A", "class", 9, 11), ("A.m", "method", 10, 11), ("module", "module", 1, 14)}
    js = "const a = 1;\nfunction f() {\n  return 1;\n}\nclass B {\n}\n"
    assert {(n, k, a, b) for n, _, k, a, b, _ in chunkers.definitions("a.js", js)} >= {("f", "function", 2, 4), ("B", "class", 5, 6)}
    assert [k for _, _, k, *_ in chunkers.definitions("a.py", "def f(:\n")] == ["module"]


def test_batches(spark):
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate([5, 1, 4, 2, 3])], "g int, i int, t int")
    got: dict = {}
    for r in chunkers.batches(df, "g", "i", "t", 6, 2).collect():
        got.setdefault(r["batch"], set()).add(r["i"])
    assert [got[b] for b in sorted(got)] == [{1, 3}, {4}, {2}, {0}] or [got[b] for b in sorted(got)] == [{1, 3}, {4, 2}, {0}]


def test_pages(spark):
    df = spark.createDataFrame([(1, "a\fb\f \fc"), (2, "x\n------\ny"), (3, "one"), (4, None)], "id int, t string")
    assert sorted(map(tuple, chunkers.pages(df, "id", "t").collect())) == [(1, 1, "a"), (1, 2, "b"), (1, 4, "c"), (2, 1, "x"), (2, 2, "y"), (3, 1, "one")]
    b = spark.createDataFrame([(1, "hello world", [(1, 0, 5), (2, 6, 5)]), (2, "p\fq", None)], "id int, t string, b array<struct<page_number:int,start_char:int,page_text_length:int>>")
    assert sorted(map(tuple, chunkers.pages(b, "id", "t", "b").collect())) == [(1, 1, "hello"), (1, 2, "world"), (2, 1, "p"), (2, 2, "q")]


def test_changes(spark):
    rows = spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.9)], "id int, v string, s double")
    new = spark.createDataFrame([(2, "B", 0.8), (3, "C", 0.1), (1, "A", 0.6)], "id int, v string, s double")
    assert sorted(map(tuple, dml.better_only(rows, new, ["id"], "s").collect())) == [(1, "A", 0.6), (2, "b", 0.9), (3, "C", 0.1)]
    assert sorted(r["v"] for r in dml.upsert(rows, new, ["id"]).collect()) == ["A", "B", "C"]
    random.seed(0)
    rep = spark.createDataFrame([(1, 5, "old"), (1, 7, "new"), (2, None, "x")], "id int, at int, v string")
    assert {r["id"]: r["v"] for r in dml.exclusive(rep, "id", "at").collect()}[1] == "new"


def test_records_and_extraction(spark):
    from quillspark.operators import extraction, records

    one = lambda e: spark.range(1).select(e.alias("x")).first()["x"]
    lit = F.lit
    states = [(None, "a"), ("x", "a"), ("0", "a"), ("2", "a"), ("1", ""), ("1", "a")]
    assert [one(records.schema_state(lit(v).cast("string"), lit(a))) for v, a in states] == ["legacy", "invalid", "older", "newer", "no_app_version", "ok"]
    assert [one(records.count_field(lit(v))) for v in ("12", "-1", "true", "1.5")] == [12, None, None, None]
    assert [one(records.item_unit(lit(k))) for k in ("code", "pdf", "?")] == ["repositories", "documents", "unknown"]
    assert one(extraction.merged_text(lit("a"), lit(" "))) == "a" and one(extraction.merged_text(lit(""), lit("o"))) == "o" and one(extraction.merged_text(lit("a"), lit("o"))) == "a" + extraction.SEPARATOR + "o"
    b = spark.createDataFrame([("abc", [(1, 0, 3)], "xy", [(1, 0, 2)])], "e string, own array<struct<page_number:int,start_char:int,page_text_length:int>>, o string, theirs array<struct<page_number:int,start_char:int,page_text_length:int>>")
    got = b.select(extraction.merged_boundaries(F.col("e"), F.col("own"), F.col("o"), F.col("theirs")).alias("b"), extraction.merged_text(F.col("e"), F.col("o")).alias("t")).first()
    assert got["t"][got["b"][1]["start_char"] :] == "xy"
    assert one(extraction.action(lit("short"), lit(1))) == "ocr" and one(extraction.action(lit("the text of this page is in it. " * 10), lit(9))) == "plain" and one(extraction.action(lit("the text of this page is in it. " * 40), lit(2))) == "keep"
    assert one(extraction.recovered(lit("ab"), lit("abcde"))) == "dropout_recovered" and one(extraction.recovered(lit("ab"), lit("abcd"))) == "extraction_floor"
    assert [one(extraction.confidence(lit(v))) for v in ("81.5", "-1", "x")] == [81.5, None, None]
    docs = spark.createDataFrame([(1, "---\ntitle: T\ntags: a, b\ndate: 2024-01-02\nextra: 5\n---\nbody"), (2, "no head"), (3, "---\n: [bad\n---\n"), (4, None), (5, "---\ntags: [x, 1]\n---\n")], "id int, t string")
    fm = {r["id"]: r for r in extraction.frontmatter(docs, "id", "t").collect()}
    assert (fm[1]["title"], fm[1]["tags"], fm[1]["created_at"], fm[1]["custom"]) == ("T", ["a", "b"], "2024-01-02", '{"extra": 5}') and fm[5]["tags"] == ["x", "1"]
    assert not any(fm[i]["has_frontmatter"] for i in (2, 3, 4))
    models = spark.createDataFrame([("a", "fastembed", 384, None), ("b", "sentence-transformers", 1024, 1.5), ("c", "sentence-transformers", 768, 0.1)], "model string, backend string, dimensions int, params_billions double")
    assert {r["model"]: (r["chunk_size"], r["chunk_overlap"]) for r in records.chunk_sizing(models).collect()} == {"a": (460, 69), "b": (768, 115), "c": (512, 69)}
    tiers = records.model_tiers(models.withColumn("deprecated", lit(False)).withColumn("default_for", F.array().cast("array<string>")))
    assert {r["model"]: (r["risk"], r["support"]) for r in tiers.collect()} == {"a": ("low", "stable"), "b": ("high", "gpu-opt-in"), "c": ("low", "opt-in")}
    stored, named = spark.createDataFrame([("m1", "x", None), ("m2", None, None)], "model string, alias string, canonical string"), spark.createDataFrame([("x",), ("y",)], "vector string")
    assert {tuple(r) for r in records.match_models(stored, named).collect()} == {("m1", "x"), ("m2", None), (None, "y")}
    runs = lambda *r: spark.createDataFrame(list(r), "run string, model string, throughput double")
    assert {r["run"]: (r["status"], r["speed_up"]) for r in records.compared_runs(runs(("a", "m", 10.0), ("b", "m", 10.0)), runs(("a", "m", 15.0), ("b", "n", 15.0)), ["model"]).collect()} == {"a": ("compared", 1.5), "b": ("different", None)}
    view = records.stamped(spark.createDataFrame([(1, None), (2, "9")], "id int, app_version string"), "1.0")
    assert {r["id"]: (r["schema_version"], r["app_version"]) for r in view.collect()} == {1: (1, "1.0"), 2: (1, "9")}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n;}", max_size=1200), st.integers(40, 200))
def test_resplit(text, most):
    parts = chunkers.resplit(text, most)
    assert all(len(p) <= most for p in parts)
    back, whole = int(most * 0.15), parts[0]
    for p in parts[1:]:
        whole += p[min(back, len(whole)) :]
    assert whole == text


def test_notes(tmp_path):
    from datetime import datetime

    from quillspark.sources.memory import write_note

    a, b = (write_note(str(tmp_path), "My Agent", "A: title!", "body", datetime(2025, 3, 4), tags=["x"]) for _ in range(2))
    assert a.name == "20250304_my-agent_a-title.md" and b.name == "20250304_my-agent_a-title-2.md" and a.read_text().endswith("---\n\nbody\n")


def test_global_numbers(spark):
    from quillspark.operators import ordering

    r = random.Random(3)
    rows = [(i, r.choice([None, 1, 2, 3])) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, v int")
    got = {x["k"]: x["place"] for x in ordering.numbered(df, [F.col("v").desc_nulls_last(), F.col("k")]).collect()}
    want = sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
    assert got == {k: i + 1 for i, (k, _) in enumerate(want)}
    assert ordering.numbered(df.limit(0), [F.col("k")]).count() == 0


def test_written_tables_can_be_cleaned(spark):
    from quillspark import session

    df = session.materialise(spark.range(5).toDF("k"), "x")
    path = df.inputFiles()[0]
    assert df.count() == 5 and session.clean(spark) >= 1
    assert not spark._jvm.java.io.File(path.removeprefix("file:")).exists()


def test_phases_over_many_ranges_equal_one_order(spark):
    import random

    r = random.Random(2)
    times = [None if r.random() < 0.3 else r.uniform(0, 10) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(times)), "k int, at double")
    got = [(x["phase"], x["segment"]) for x in sync.phases(df, F.lit(7.0), F.lit(3.0), "at", "k").orderBy("k").collect()]
    name = lambda t: None if t is None else "arrived" if t > 7 else "covered" if t >= 3 else "backlog"
    run = next(name(t) for t in times if t is not None)
    want, n = [], 0
    for t in times:
        p = name(t) or run
        n += p != run
        run = p
        want.append((p, n))
    assert got == want
    assert [tuple(x)[2:] for x in sync.phases(df.filter("k < 5").withColumn("at", F.lit(None).cast("double")), F.lit(7.0), F.lit(3.0), "at", "k").collect()] == [("arrived", 0)] * 5


def test_cell_index_recall_and_odd_vectors(spark, tmp_path):
    import numpy as np

    from quillspark.operators import vector_index

    r = np.random.default_rng(0)
    centres = r.normal(size=(40, 16))
    x = centres[r.integers(0, 40, 3000)] + 0.4 * r.normal(size=(3000, 16))
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)] + [(9001, None, "c"), (9002, [0.0] * 16, "c"), (9003, [1.0], "c"), (9004, [None] * 16, "c")]
    df = spark.createDataFrame(rows, "id int, v array<double>, cell string")  # a clashing column
    index = vector_index.CellIndex.build(df, "id", "v", f"file://{tmp_path}/i")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = n = 0
    for q in range(0, 3000, 250):
        got = {row["id"] for row in index.search(x[q].tolist(), 10).collect()}
        hit += len(got & set(np.argsort(-(u @ u[q]))[:10].tolist()))
        n += 10
    assert hit / n >= 0.9 and spark.read.parquet(f"file://{tmp_path}/i/vectors").count() == 3000
    empty = vector_index.CellIndex.build(df.limit(0), "id", "v", f"file://{tmp_path}/e")
    assert empty.size == 0 and empty.search([1.0] * 16).count() == 0


def test_search_by_index_equals_search_by_scan(spark, tmp_path):
    texts = ["alpha beta gamma", "gamma the alpha and beta", "alpha", None, "", "beta x x x x alpha x beta alpha", "the alpha the beta", "alphabet betas"]
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "id int, content string, title string")
    s = fulltext.index_settings("markdown") | {"searchable": ["content", "title"]}
    index = fulltext.Index.build(df, "id", ["content", "title"], s["stop_words"], f"file://{tmp_path}/i")
    for q in ("alpha beta", '"alpha beta"', '"the alpha" beta', "beta", "alpah", '"the"', "gamma alpha beta", "nothing"):
        for where in (None, F.col("id") != 0):
            a, b = ([tuple(r) for r in fulltext.search(df, "id", q, s, where, index=i).collect()] for i in (None, index))
            assert a == b, q
    r = {x["id"]: x["proximity"] for x in fulltext.search(df, "id", "alpha beta", s, index=index).collect()}
    assert r[0] == 1 and r[1] == 2 and r[5] == 1
    assert fulltext.estimated_total(df, "id", "beta", s, index=index).first()["estimated_total"] == 5
    with pytest.raises(ValueError):
        fulltext.filterable(s, ["filename", "colour"])


JS = """// A tool for { braces }.
import x from 'y';

export class Store extends Base {
  #a = 1;
  constructor(b) { super(); this.b = b; }

  async read(key, { deep = true } = {}) {
    if (key) { return `{${key}}`; }
    return null;
  }
}

function alone(a) {
  const inner = (q) => { return q; };
  return inner(a) + "}";
}

export const arrow = async (v) => {
  return v;
};
let plain = 3;
"""
GO = """package a

type S struct {
\tA int
}

func (s *S) Close() error {
\treturn nil // }
}

func Free(n int) string { return "{" }
"""
PY = "import os\n\n\n# about f\n@deco\ndef f(x):\n    return x\n\n\nclass A:\n    def m(self):\n        return 1\n\n    def n(self):\n        return 2\n"


def test_definitions_of_brace_languages():
    got = [(q, k, a, b) for _, q, k, a, b, _ in chunkers.definitions("a.js", JS)]
    assert ("Store", "class", 4, 12) in got and ("Store.constructor", "method", 6, 6) in got and ("Store.read", "method", 8, 11) in got
    assert ("alone", "function", 14, 17) in got and ("arrow", "function", 19, 21) in got and got[-1][1] == "module"
    assert [(q, k, a, b) for _, q, k, a, b, _ in chunkers.definitions("a.go", GO)] [:3] == [("S", "class", 3, 5), ("S.Close", "method", 7, 9), ("Free", "function", 11, 11)]
    java = "class C {\n  int f(int a) {\n    for (;;) { g(); }\n  }\n  abstract void h();\n}\n"
    assert [(q, k, a, b) for _, q, k, a, b, _ in chunkers.definitions("C.java", java)] [:2] == [("C", "class", 1, 6), ("C.f", "method", 2, 4)]
    assert chunkers.definitions("x.js", "function broken() {")[0][2] == "module" and chunkers.definitions("x.txt", "words")[0][2] == "module"
    import time

    began = time.time()
    chunkers.definitions("x.js", "function f\n" * 20_000)
    assert time.time() - began < 5


def test_code_chunks_keep_definitions_whole():
    body = "".join(f"def f{i}(x):\n    y = x + {i}\n    return y\n\n\n" for i in range(60))
    for path, code in (("a.py", body), ("b.py", "class A:\n" + "".join("    " + x + "\n" if x else "\n" for x in body.split("\n"))), ("a.js", JS * 9), ("a.go", GO * 12), ("c.py", "def f(:\n" * 400), ("x.txt", "line\n" * 900), ("d.py", "x = 1\n")):
        cs = chunkers.code_chunks(path, code, tokens=60, overlap=0)
        kept = [x for c in cs for x in c.split("\n") if x.strip()]
        assert kept == [x for x in code.split("\n") if x.strip()] and all(len(c) <= 60 * chunkers.CODE * (1 if path in ("a.py", "b.py") else 1.3) + 1 for c in cs), path
    for c in chunkers.code_chunks("a.py", body, tokens=60):
        assert c.lstrip("\n").startswith("def ") and c.rstrip("\n").endswith("return y")
    assert chunkers.code_chunks("a.py", PY, tokens=400) == [PY]
    assert chunkers.code_chunks("a.py", "") == [] and len(chunkers.code_chunks("a.py", body, by_lines=True)) > 1


def test_naive_markdown_chunks():
    text = "\n\n".join(f"Paragraph {i} " + "of words " * 30 for i in range(40))
    got = chunkers.naive_markdown_chunks(text, 200, 20)
    assert got[0][0] == 0 and got[-1][1] == len(text) and all(b - 66 == c or b - c <= 66 for (_, b, _), (c, _, _) in zip(got, got[1:]))
    assert all(text[:e].endswith("\n\n") for _, e, _ in got[:-1]) and chunkers.naive_markdown_chunks("") == []


def test_back_fill_and_parity_by_corpus(spark):
    a = spark.createDataFrame([("c", "x", 1), ("c", "x", 2), ("c", "y", 3), ("d", "z", 4), (None, "n", 5)], "corpus string, path string, id int")
    b = spark.createDataFrame([("c", "x", 1), ("c", "y", 3), ("e", "w", 9)], "corpus string, path string, id int")
    assert sorted(r["id"] for r in sync.filled(a, b, ["corpus", "path"]).collect()) == [1, 2, 3, 4, 5, 9]
    states = {r["corpus"]: r["state"] for r in sync.parity_by_corpus(a, b, "corpus", "path").collect()}
    assert states["c"] == "out of parity" and states["d"] == "right missing" and states["e"] == "left missing"


def test_random_order_repeats(spark):
    from quillspark.operators import ordering

    df = spark.range(50)
    one, two = ([r["id"] for r in df.repartition(n).orderBy(*ordering.shuffled(df, "id", 7)).collect()] for n in (2, 5))
    assert one == two and one != sorted(one)
