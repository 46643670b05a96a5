"""A corpus: its tables in a store, and what is done with it from day to day.

``chunks`` has a row per chunk with its vector, ``manifests`` one per file, both in buckets by the hash of the path;
``collections`` has a row per corpus. A change reads and writes only the buckets of the files it touches. The chunks' new
version is written first and the manifests' last, so that a file counts as indexed only once its chunks are there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import embed, paths
from ..operators import chunkers, dml, filters, fulltext, integrity, listings, sync, vector_search
from ..session import materialise
from ..sources.store import Store

CHUNKS = "point_id string, collection string, file_path string, filename string, chunk_index int, chunk_count int, content string, file_hash string, embedding array<float>"
MANIFESTS = "collection string, file_path string, quick_hash string, file_hash string, chunk_count long"
BUCKETS = 64  # of a new corpus; about one for each few hundred MB is right
COLLECTIONS = "name string, kind string, model string, size int, buckets int, description string, created_at timestamp, last_sync timestamp"
CHUNKERS: dict[str, Callable[[str], list[str]]] = {
    "pdf": lambda s: [c for *_, c in chunkers.sentence_windows(s)],
    "markdown": lambda s: [c for _, c in chunkers.markdown_chunks(s)],
    "code": chunkers.line_chunks,
}


class Corpus:
    def __init__(self, store: Store, name: str):
        self.store, self.name, self.spark = store, name, store.spark

    # catalogue
    @staticmethod
    def all(store: Store) -> DataFrame:
        return store.read("collections") if store.exists("collections") else store.spark.createDataFrame([], COLLECTIONS)

    def create(self, kind: str, model: str = "hash", size: int = 64, description: str = "", buckets: int = BUCKETS) -> None:
        """Both tables, empty; an existing corpus is an error."""
        if kind not in CHUNKERS:
            raise ValueError(f"unknown kind {kind}; known are {', '.join(CHUNKERS)}")
        have = self.all(self.store)
        if have.filter(F.col("name") == self.name).take(1):
            raise FileExistsError(f"there is a corpus {self.name} already")
        row = self.spark.range(1).select(F.lit(self.name).alias("name"), F.lit(kind).alias("kind"), F.lit(model).alias("model"), F.lit(size).alias("size"), F.lit(buckets).alias("buckets"), F.lit(description).alias("description"), F.current_timestamp().alias("created_at"), F.lit(None).cast("timestamp").alias("last_sync"))
        self.store.write_buckets(f"{self.name}.chunks", self.spark.createDataFrame([], CHUNKS), "file_path", buckets)
        self.store.write_buckets(f"{self.name}.manifests", self.spark.createDataFrame([], MANIFESTS), "file_path", buckets)
        self.store.write("collections", have.unionByName(row).coalesce(1))

    def info(self) -> dict:
        rows = self.all(self.store).filter(F.col("name") == self.name).take(1)
        if not rows:
            raise LookupError(f"no corpus {self.name}")
        return rows[0].asDict()

    def update(self, **fields) -> None:
        """Sets description or last_sync; None removes a value."""
        self.info()
        df = self.all(self.store)
        for k, v in fields.items():
            df = df.withColumn(k, F.when(F.col("name") == self.name, v if isinstance(v, Column) else F.lit(v).cast(df.schema[k].dataType)).otherwise(F.col(k)))
        self.store.write("collections", df.coalesce(1))

    def drop(self) -> None:
        self.info()
        self.store.write("collections", self.all(self.store).filter(F.col("name") != self.name).coalesce(1))
        for t in ("chunks", "manifests"):
            self.store.drop(f"{self.name}.{t}")

    @property
    def chunks(self) -> DataFrame:
        return self.store.read(f"{self.name}.chunks")

    @property
    def manifests(self) -> DataFrame:
        return self.store.read(f"{self.name}.manifests")

    # ingest
    def indexed(self, files: DataFrame) -> DataFrame:
        """Chunk rows of files (file_path, text, file_hash). Files of one content are chunked and embedded once."""
        about = self.info()
        once = files.groupBy("file_hash").agg(F.any_value("text").alias("text"))
        cut = chunkers.chunked(once, "file_hash", "text", CHUNKERS[about["kind"]]).withColumnRenamed("chunk", "content").drop("token_count")
        cut = cut.withColumn("embedding", embed.embedder(about["model"], about["size"])(F.col("content")))
        rows = files.select("file_path", "file_hash").join(cut, "file_hash")
        return rows.select(
            paths.row_id(F.lit(self.name), F.col("file_path"), F.col("chunk_index")).alias("point_id"), F.lit(self.name).alias("collection"), "file_path",
            paths.filename(F.col("file_path")).alias("filename"), "chunk_index", "chunk_count", "content", "file_hash", "embedding",
        )

    def _change(self, about: dict, touched: list[int], change) -> None:
        """Rewrites the touched buckets: ``change`` gives their new chunks from the old, and (path, stamps) of their manifests from the old ones."""
        n, c, m = about["buckets"], f"{self.name}.chunks", f"{self.name}.manifests"
        chunks, stamps = change(self.store.read(c, touched), self.store.read(m, touched))
        self.store.write_buckets(c, chunks, "file_path", n, touched)
        made = self.store.read(c, touched).groupBy("file_path").agg(F.count("*").alias("chunk_count"))
        rows = stamps.join(made, "file_path", "left").select(F.lit(self.name).alias("collection"), "file_path", "quick_hash", "file_hash", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))
        self.store.write_buckets(m, rows, "file_path", n, touched)

    def sync(self, found: DataFrame, folders: list[str] = (), force: bool = False) -> dict[str, int]:
        """Brings the corpus to the state of ``found`` (file_path, text, quick_hash); counts of what was done.

        Unchanged files (path and stamp) are not read: only what is new or stamped anew is hashed. A new path with the
        content of a path that is gone is renamed, its chunks kept. Paths in ``folders`` that were not found are pruned.
        Blank files have no chunks but a manifest.
        """
        about, old_m = self.info(), self.manifests
        paths_found = found.select("file_path")
        todo = (found if force else sync.changed(found, old_m)).select("file_path", "text", "quick_hash").withColumn("file_hash", paths.content_hash(F.coalesce("text", F.lit(""))))
        todo = materialise(todo, "todo")
        moves = sync.renames(todo, old_m, present=paths_found).select("old_path", "new_path")
        gone = sync.stale(old_m, paths_found, list(folders)) if folders else old_m.select("file_path").limit(0)
        gone = gone.join(moves.select(F.col("old_path").alias("file_path")), "file_path", "left_anti")
        indexed = todo.select("file_path").join(moves.select(F.col("new_path").alias("file_path")), "file_path", "left_anti")
        none = F.lit(None).cast("string").alias("old_path")
        plan = moves.select(F.lit("renamed").alias("what"), F.col("new_path").alias("file_path"), "old_path").unionByName(gone.select(F.lit("pruned").alias("what"), "file_path", none)).unionByName(indexed.select(F.lit("indexed").alias("what"), "file_path", none))
        plan = materialise(plan, "plan")
        counts = {"renamed": 0, "pruned": 0, "indexed": 0} | {r["what"]: r["count"] for r in plan.groupBy("what").count().collect()} | {"found": paths_found.count()}
        moves = plan.filter("what = 'renamed'").select("old_path", F.col("file_path").alias("new_path"))
        gone = plan.filter("what = 'pruned'").select("file_path")
        work = todo.join(plan.filter("what = 'indexed'").select("file_path"), "file_path", "left_semi")
        touched = self.store.touched(plan.select("file_path").union(moves.select("old_path")), "file_path", about["buckets"])

        def change(chunks: DataFrame, manifests: DataFrame) -> tuple[DataFrame, DataFrame]:
            chunks = dml.rename(dml.delete(chunks, gone, ["file_path"]), moves)
            chunks = chunks.withColumn("point_id", paths.row_id(F.lit(self.name), F.col("file_path"), F.col("chunk_index")))
            chunks = dml.delete(chunks, work, ["file_path"]).unionByName(self.indexed(work))
            stamps = todo.select("file_path", "quick_hash", "file_hash")
            kept = dml.delete(dml.rename(dml.delete(manifests, gone, ["file_path"]), moves, name=None), stamps, ["file_path"])
            return chunks, kept.select("file_path", "quick_hash", "file_hash").unionByName(stamps)

        if touched:
            self._change(about, touched, change)
        self.update(last_sync=F.current_timestamp())
        return counts

    def inject(self, key: str, text: str) -> int:
        """One text under a key, in place of what had its content; the number of chunks. Reads and writes the buckets of these alone."""
        about = self.info()
        row = self.spark.createDataFrame([(key, text)], "file_path string, text string").withColumn("file_hash", paths.content_hash(F.col("text")))
        same = materialise(self.manifests.join(row.select("file_hash"), "file_hash", "left_semi").select("file_path").union(row.select("file_path")), "same")
        touched = self.store.touched(same, "file_path", about["buckets"])

        def change(chunks: DataFrame, manifests: DataFrame) -> tuple[DataFrame, DataFrame]:
            stamp = row.select("file_path", F.lit(None).cast("string").alias("quick_hash"), "file_hash")
            kept = dml.delete(manifests, same, ["file_path"]).select("file_path", "quick_hash", "file_hash")
            return dml.delete(chunks, same, ["file_path"]).unionByName(self.indexed(row)), kept.unionByName(stamp)

        self._change(about, touched, change)
        return self.store.read(f"{self.name}.chunks", self.store.touched(row, "file_path", about["buckets"])).filter(F.col("file_path") == key).count()

    # queries
    def semantic(self, query: str, limit: int = 10, offset: int = 0, where: str | None = None, threshold: float | None = None) -> DataFrame:
        about = self.info()
        vector = [float(x) for x in embed.MODELS[about["model"]](about["size"])([query])[0]]
        c = self.chunks
        return vector_search.search(c, vector, "point_id", limit, offset, threshold=threshold, where=filters.parse(c, where))

    def text(self, query: str, limit: int = 20, offset: int = 0, where: str | None = None) -> DataFrame:
        s = fulltext.index_settings(self.info()["kind"])
        c = self.chunks.drop("embedding")
        return fulltext.search(c, "point_id", query, s, filters.text_filter(c, where) if where else None, limit, offset)

    def items(self) -> DataFrame:
        return listings.items(self.chunks, ["file_path"], ["filename"], "chunk_index").orderBy("file_path")

    def verify(self) -> DataFrame:
        """Completeness of every file of the manifests, whether it has chunks or not."""
        have = integrity.file_completeness(self.chunks, ["file_path"])
        return self.manifests.select("file_path", "chunk_count").join(have, "file_path", "left").withColumn("is_complete", F.coalesce("is_complete", F.col("chunk_count") == 0))

    def parity(self) -> DataFrame:
        """Chunks against manifests, per file."""
        right = self.manifests.filter("chunk_count > 0").select("file_path", F.explode(F.sequence(F.lit(1).cast("long"), F.col("chunk_count"))).alias("_i"))
        return sync.parity(self.chunks, right, ["file_path"])
