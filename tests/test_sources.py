import subprocess

import pytest
from pyspark.sql import functions as F

from quillspark.functions import embed
from quillspark.operators import chunkers
from quillspark.sources import discovery, exchange
from quillspark.sources.store import Store
from quillspark.streaming import ingest


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def rows(spark, n=5):
    return spark.createDataFrame([(i, f"/r/{i}.md", [float(i)], None) for i in range(n)], "id int, file_path string, v array<float>, extra string")


def test_versions(spark, store):
    assert not store.exists("t") and store.tables() == []
    first = store.write("t", rows(spark))
    seen = store.read("t")
    store.write("t", store.read("t").filter("id > 2"))  # derived from itself
    assert store.read("t").count() == 2 and seen.count() == 5 and store.tables() == ["t"]
    store.restore("t", first)
    assert store.read("t").count() == 5 and store.vacuum("t") == 1
    store.drop("t")
    with pytest.raises(LookupError):
        store.read("t")


def test_export_import(spark, store, tmp_path):
    df = exchange.selected(rows(spark), F.col("id") < 4, "/r")
    exchange.export_jsonl(df, f"{tmp_path}/x", "corpus", single_file=True)
    header, back = exchange.import_jsonl(spark, f"{tmp_path}/x")
    assert header["name"] == "corpus" and back.schema == df.schema
    back = exchange.placed(back, "/new", [("0.md", "zero.md")])
    assert sorted(r["file_path"] for r in back.collect()) == ["/new/1.md", "/new/2.md", "/new/3.md", "/new/zero.md"]
    (tmp_path / "y/header").mkdir(parents=True)
    (tmp_path / "y/header/a.txt").write_text('{"no": 1}\n')
    with pytest.raises(ValueError):
        exchange.import_jsonl(spark, f"{tmp_path}/y")
    exchange.export_binary(df, f"{tmp_path}/b")
    exchange.import_binary(spark, f"{tmp_path}/b", store, "imported")
    with pytest.raises(FileExistsError):
        exchange.import_binary(spark, f"{tmp_path}/b", store, "imported")
    dump = tmp_path / "dump.jsonl"
    dump.write_text('{"_type": "index_metadata", "name": "i"}\n{"_type": "document", "id": "a"}\n\n')
    from pyspark.sql import types as T

    meta, docs = exchange.import_index_lines(spark, str(dump), T.StructType().add("id", "string"))
    assert meta["name"] == "i" and docs.count() == 1


def test_backup(spark, store, tmp_path):
    store.write("t", rows(spark))
    exchange.backup(store, ["t"], f"{tmp_path}/backup")
    store.write("t", rows(spark, 1))
    assert exchange.restore(store, f"{tmp_path}/backup") == ["t"] and store.read("t").count() == 5
    rows(spark, 2).write.mode("overwrite").parquet(f"{tmp_path}/backup/t")
    with pytest.raises(ValueError):
        exchange.restore(store, f"{tmp_path}/backup")


def test_discovery(spark, tmp_path):
    for p, text in {"a/x.py": "x", "a/y.min.js": "x", "a/z.js": "var " * 3000, "a/ok.js": "let a", "_skip/q.py": "x", "node_modules/m.js": "x", "b/n.md": "x"}.items():
        f = tmp_path / p
        f.parent.mkdir(exist_ok=True)
        f.write_text(text)
    got = sorted(r["file_path"].split("/")[-1] for r in discovery.discover(spark, str(tmp_path), "code").collect())
    assert got == ["ok.js", "x.py"]
    (tmp_path / "list.txt").write_text("# comment\n\na/x.py\n/abs/y.py\n")
    assert sorted(r["file_path"] for r in discovery.path_list(spark, f"{tmp_path}/list.txt", "/base").collect()) == ["/abs/y.py", "/base/a/x.py"]
    kinds = spark.createDataFrame([(1, b"text\n"), (2, b""), (3, b"a\0b"), (4, bytes(range(1, 9)) * 9)], "i int, b binary").select("i", discovery.is_text("b").alias("t"))
    assert {r["i"]: r["t"] for r in kinds.collect()} == {1: True, 2: False, 3: False, 4: False}
    times = spark.createDataFrame([("b", 1), ("a", 1), ("c", None), ("d", 2)], "file_path string, mtime int")
    assert [r["file_path"] for r in discovery.ordered(times, "newest").collect()] == ["d", "a", "b", "c"] and [r["file_path"] for r in discovery.ordered(times, "oldest").collect()] == ["a", "b", "d", "c"]


def test_git(spark, tmp_path):
    repo = tmp_path / "proj"
    repo.mkdir()
    (repo / "a.py").write_text("x = 1\n")
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main"), git("add", "."), git("commit", "-qm", "x"), git("remote", "add", "origin", "https://u:p@host/team/tool.git")
    assert discovery.git_projects(str(tmp_path)) == [str(repo)] and discovery.git_files(str(repo), ["py"]) == [str(repo / "a.py")]
    r = discovery.git_metadata(spark, [str(repo)]).first()
    assert r["git_remote_url"] == "https://host/team/tool.git" and r["git_project_identifier"] == "tool#main" and r["git_version_identifier"].startswith("tool#main@")
    git("checkout", "-q", "--detach")
    assert discovery.git_branch(str(repo)).startswith("(detached-")


def test_logs(spark, tmp_path):
    discovery.log_append(spark.createDataFrame([("2025-01-01", "a"), ("2025-01-02", "b")], "timestamp string, command string"), f"{tmp_path}/log")
    discovery.log_append(spark.createDataFrame([("2025-01-03", "c")], "timestamp string, command string"), f"{tmp_path}/log")
    assert [r["command"] for r in discovery.log_tail(spark, f"{tmp_path}/log", 2).collect()] == ["c", "b"]


def test_pdf_without_library_reports_instead_of_failing(spark):
    df = spark.createDataFrame([("a.pdf", b"not a pdf")], "file_path string, content binary")
    assert discovery.pdf_text(df).first()["error"]


def test_stream_equals_batch(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("file_path", "text")
    docs.repartition(5).write.parquet(f"{tmp_path}/in")
    chunk = lambda df: chunkers.chunked(df, "file_path", "text", lambda s: [c for *_, c in chunkers.sentence_windows(s, 100)])
    for _ in range(2):  # the second run finds nothing new
        q = ingest.ingest(spark, f"{tmp_path}/in", docs.schema, chunk, f"{tmp_path}/chunks", f"{tmp_path}/manifests", f"{tmp_path}/ckpt", files_per_trigger=2)
        q.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/chunks").drop("batch")
    assert got.exceptAll(chunk(docs)).isEmpty() and chunk(docs).exceptAll(got).isEmpty()
    assert spark.read.parquet(f"{tmp_path}/manifests").agg(F.sum("chunk_count")).first()[0] == got.count()


def test_embedder(spark):
    df = spark.createDataFrame([("the index",), ("index the",), ("",), (None,), ("other words",)], "t string").select(embed.embedder(size=16)(F.col("t")).alias("v"))
    v = [r["v"] for r in df.collect()]
    assert v[0] == v[1] and v[2] == v[3] == [0.0] * 16 and len(v[4]) == 16 and v[4] != v[0]


def test_pointers_are_only_added_and_half_written_ones_are_passed_over(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.write("t", rows(spark))
    half = tmp_path / "store" / "t" / "_at" / f"{2:012d}"
    half.write_text('{"version": "v-x", "par')  # a writer died here
    assert store.read("t").count() == 5
    store.write("t", store.read("t").filter("id > 3"))
    assert store.read("t").count() == 1 and store.vacuum("t") == 1 and store.read("t").count() == 1


def test_a_change_writes_only_its_buckets(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    df = spark.range(200).selectExpr("cast(id as string) as k", "id")
    store.write_buckets("b", df, "k", 8)
    one = store.touched(spark.createDataFrame([("7",)], "k string"), "k", 8)
    files = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "store" / "b").rglob("*.parquet")}
    before = files()
    part = store.read("b", one)
    assert 0 < part.count() < 200
    store.write_buckets("b", part.filter("k <> '7'"), "k", 8, one)
    after = files()
    assert store.read("b").count() == 199 and all(after[f] == t for f, t in before.items()) and 0 < len(set(after) - set(before)) <= 2
    store.write_buckets("b", part.limit(0), "k", 8, list(range(8)))
    assert store.read("b").count() == 0 and store.read("b").columns == ["k", "id"]
    store.vacuum("b")
    assert store.read("b").count() == 0


def test_discovery_takes_text_under_version_control(spark, tmp_path):
    import subprocess

    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "b.py").write_bytes(b"a\0b")
    (tmp_path / "c.py").write_text("y = 2\n")
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.email=a@b", "-c", "user.name=n", *a], check=True, capture_output=True)
    git("init", "-q"), git("add", "a.py", "b.py"), git("commit", "-qm", "one")
    names = lambda df: sorted(r["file_path"].rsplit("/", 1)[-1] for r in df.collect())
    tracked = spark.createDataFrame([(p,) for p in discovery.git_files(str(tmp_path))], "file_path string")
    assert names(discovery.discover(spark, str(tmp_path), "code")) == ["a.py", "c.py"] and names(discovery.discover(spark, str(tmp_path), "code", tracked=tracked)) == ["a.py"]
    assert discovery.git_clean(str(tmp_path))
    (tmp_path / "a.py").write_text("x = 3\n")
    assert not discovery.git_clean(str(tmp_path))
    git("mv", "b.py", "d.py"), git("commit", "-qam", "two")
    changed = {(s, p.rsplit("/", 1)[-1], o and o.rsplit("/", 1)[-1]) for s, p, o in discovery.git_changed(str(tmp_path), "HEAD~1")}
    assert changed == {("M", "a.py", None), ("R", "d.py", "b.py")}
