import pytest

from quillspark.plans.corpus import Corpus
from quillspark.sources.store import Store

TEXT = "The {0} keeps the index of the corpus. " * 30


def found(spark, **files):
    return spark.createDataFrame([(f"/r/{k}.md", v, f"q{hash(v)}") for k, v in files.items()], "file_path string, text string, quick_hash string")


def test_a_corpus_through_its_life(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    c = Corpus(store, "notes")
    c.create("markdown", size=32)
    with pytest.raises(FileExistsError):
        c.create("markdown")
    with pytest.raises(ValueError):
        Corpus(store, "x").create("nope")
    with pytest.raises(LookupError):
        Corpus(store, "x").info()
    a, b, same = TEXT.format("store"), TEXT.format("crawl"), TEXT.format("store")
    assert c.sync(found(spark, a=a, b=b, copy=same, blank="  "), ["/r"]) == {"renamed": 0, "pruned": 0, "indexed": 4, "found": 4}
    assert c.verify().filter("not is_complete").count() == 0 and c.parity().filter("status <> 'synced'").count() == 0
    ids = {r["point_id"] for r in c.chunks.collect()}
    assert c.sync(found(spark, a=a, b=b, copy=same, blank="  "), ["/r"])["indexed"] == 0 and {r["point_id"] for r in c.chunks.collect()} == ids
    # b moves, a changes, the copy goes
    assert c.sync(found(spark, a=TEXT.format("manifest"), moved=b, blank="  "), ["/r"]) == {"renamed": 1, "pruned": 1, "indexed": 1, "found": 3}
    assert sorted(r["file_path"] for r in c.items().collect()) == ["/r/a.md", "/r/moved.md"]
    assert sorted(r["file_path"] for r in c.manifests.collect()) == ["/r/a.md", "/r/blank.md", "/r/moved.md"] and len({r["point_id"] for r in c.chunks.collect()}) == c.chunks.count()
    assert c.semantic("the manifest keeps the index", limit=1).first()["file_path"] == "/r/a.md"
    assert {r["file_path"] for r in c.text("crawl").collect()} == {"/r/moved.md"} and c.text("crawl", where="filename = a.md").count() == 0
    assert c.inject("memory/1", "a remembered fact about the parity check") == 1 and c.inject("memory/2", "a remembered fact about the parity check") == 1
    assert c.chunks.filter("file_path like 'memory/%'").count() == 1
    assert c.info()["last_sync"] is not None
    c.update(description="d")
    assert c.info()["description"] == "d"
    c.drop()
    assert Corpus.all(store).count() == 0 and not store.exists("notes.chunks")


def test_source_pipelines_follow_commits(spark, tmp_path):
    from quillspark.operators import fulltext
    from quillspark.plans import pipelines

    store = Store(spark, f"file://{tmp_path}/s")
    cols = "git_project_identifier string, file_path string, git_project_name string, git_branch string, git_commit_hash string, code string"
    files = lambda c, code: spark.createDataFrame([("p#main", "/p/a.py", "p", "main", c, code), ("q#main", "/q/b.go", "q", "main", "c0", "package b\n\nfunc F() int {\n\treturn 1\n}\n"), ("p#main", "/p/n.py", "p", "main", c, None)], cols)
    projects = lambda c: spark.createDataFrame([("p#main", c), ("q#main", "c0"), ("r#main", "c9")], "git_project_identifier string, git_commit_hash string")
    acts = lambda df: {r["git_project_identifier"]: r["action"] for r in df.collect()}
    old, new = "def f():\n    return 1\n", "def f():\n    return 2\n\n\nclass A:\n    def m(self):\n        return f()\n"
    for build, table in ((pipelines.source_collection, "code"), (pipelines.code_fulltext, "docs")):
        assert acts(build(store, table, projects("c1"), files("c1", old), buckets=4)) == {"p#main": "index", "q#main": "index", "r#main": "index"}
        assert acts(build(store, table, projects("c1"), files("c1", new), buckets=4)) == {"p#main": "skip", "q#main": "skip", "r#main": "index"}
        assert not store.read(table).filter("content like '%return 2%'").count()
        assert acts(build(store, table, projects("c2"), files("c2", new), buckets=4))["p#main"] == "update"
        got = store.read(table)
        assert got.filter("content like '%return 2%'").count() and not got.filter("content like '%def f():\n    return 1%'").count() and got.filter("git_project_identifier = 'q#main'").count()
    names = {r["qualified_name"] for r in store.read("docs").collect()}
    assert {"f", "A", "A.m", "F"} <= names
    settings, added = pipelines.ensure_settings(fulltext.index_settings("code"), "code-fulltext")
    assert "git_branch" in added and pipelines.ensure_settings(settings, "code-fulltext")[1] == []


def test_page_documents_of_new_files(spark):
    from quillspark.plans import pipelines

    pdfs = spark.createDataFrame([("a", "h1", "one\ftwo\f \ffour", 55.0), ("b", "h2", "x", None), ("c", "h3", None, None), ("d", "h4", "", None)], "file_path string, file_hash string, text string, ocr_confidence double")
    got = sorted(tuple(r) for r in pipelines.page_documents(pdfs, spark.createDataFrame([("b", "h2"), ("a", "old")], "file_path string, file_hash string")).collect())
    assert got == [("a", "h1", 1, 4, "one", 55.0), ("a", "h1", 2, 4, "two", 55.0), ("a", "h1", 4, 4, "four", 55.0)]
