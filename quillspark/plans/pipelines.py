"""From sources to searchable tables: code and pages into a vector table, and into documents for full-text search.

Each pipeline asks first what has changed, by commit or by (path, hash), and touches nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import embed, paths
from ..operators import chunkers, fulltext, sync
from ..session import materialise
from ..sources.store import Store

PROJECT = "git_project_identifier"


def files_of_chunks(chunks: DataFrame) -> DataFrame:
    """(project, file_path, git fields, code): files joined from their chunks, the latest row of each id."""
    once = chunks.groupBy("id").agg(F.max_by(F.struct(PROJECT, "file_path", "git_project_name", "git_branch", "git_commit_hash", "chunk_index", "content"), F.struct("indexed_at")).alias("r")).select("r.*")
    code = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", F.coalesce("content", F.lit("")).alias("content")))), lambda x: x["content"]), "")
    return once.groupBy(PROJECT, "file_path").agg(F.max("git_project_name").alias("git_project_name"), F.max("git_branch").alias("git_branch"), F.max("git_commit_hash").alias("git_commit_hash"), code.alias("code"))


def project_actions(projects: DataFrame, store: Store, table: str) -> DataFrame:
    """(project, action): index, update or skip, by the commit that the table has of the project."""
    have = store.read(table).select(PROJECT, "git_commit_hash") if store.exists(table) else projects.select(PROJECT, "git_commit_hash").limit(0)
    return materialise(sync.reindex_needed(projects, have), "actions")


def _replace_projects(store: Store, table: str, rows: DataFrame, work: DataFrame, buckets: int) -> None:
    """All rows of the worked projects are replaced; only the buckets of these projects are written. A project's rows lie in one bucket but many files."""
    if not store.exists(table):
        store.write_buckets(table, rows.limit(0), PROJECT, buckets)
    touched = store.touched(work, PROJECT, buckets)
    kept = store.read(table, touched).join(work.select(PROJECT), PROJECT, "left_anti").select(*rows.columns)
    store.write_buckets(table, kept.unionByName(rows), PROJECT, buckets, touched)


def source_collection(store: Store, table: str, projects: DataFrame, files: DataFrame, model: str = "hash", size: int = 64, buckets: int = 64) -> DataFrame:
    """Brings a table of code chunks with vectors to the projects' commits; (project, action) as it was found.

    projects: identifier and commit. files: as ``files_of_chunks``. A project of the same commit is not read. Files are
    cut by their definitions; equal chunks are embedded once.
    """
    actions = project_actions(projects, store, table)
    work = actions.filter("action <> 'skip'")
    mine = files.join(F.broadcast(work.select(PROJECT)) if work.count() <= 100_000 else work.select(PROJECT), PROJECT, "left_semi")
    cut = chunkers.chunked_code(mine.withColumn("_at", F.concat_ws("\x01", PROJECT, "file_path")), "_at", "code").withColumnRenamed("chunk", "content")
    once = cut.select("content").distinct().withColumn("embedding", embed.embedder(model, size)(F.col("content")))
    about = mine.select(F.concat_ws("\x01", PROJECT, "file_path").alias("_at"), PROJECT, "file_path", "git_project_name", "git_branch", "git_commit_hash")
    rows = about.join(cut, "_at").join(once, "content").withColumn("point_id", paths.row_id(F.col(PROJECT), F.col("file_path"), F.col("chunk_index")))
    _replace_projects(store, table, rows.select("point_id", PROJECT, "file_path", "git_project_name", "git_branch", "git_commit_hash", "chunk_index", "chunk_count", "content", "embedding"), work, buckets)
    return actions


def code_documents(files: DataFrame) -> DataFrame:
    """One document for each definition of each file, and one for the lines outside: what full-text search over code reads."""
    d = chunkers.extract_definitions(files.withColumn("_at", F.concat_ws("\x01", PROJECT, "file_path")).select("_at", "code"), "_at", "code")
    about = files.select(F.concat_ws("\x01", PROJECT, "file_path").alias("_at"), PROJECT, "file_path", "git_project_name", "git_branch", "git_commit_hash")
    rows = d.join(about, "_at").drop("_at")
    is_class = F.col("code_type") == "class"
    rows = rows.withColumn("function_name", F.when(F.col("code_type").isin("function", "method"), F.col("name"))).withColumn("class_name", F.when(is_class, F.col("name")))
    key = paths.document_id(F.col(PROJECT), F.col("file_path"), F.col("qualified_name"), F.col("start_line"))
    return rows.withColumn("id", key).withColumn("programming_language", paths.language_of(F.col("file_path"))).withColumn("filename", paths.filename(F.col("file_path"))).withColumn("file_extension", paths.extension(F.col("file_path")))


def code_fulltext(store: Store, table: str, projects: DataFrame, files: DataFrame, buckets: int = 64) -> DataFrame:
    """Brings a table of code documents to the projects' commits; (project, action)."""
    actions = project_actions(projects, store, table)
    work = actions.filter("action <> 'skip'")
    rows = code_documents(files.join(work.select(PROJECT), PROJECT, "left_semi"))
    _replace_projects(store, table, rows, work, buckets)
    return actions


def page_documents(pdfs: DataFrame, indexed: DataFrame) -> DataFrame:
    """(file_path, file_hash, page_number, page_count, content, mean_confidence) of the pages of the files whose (path, hash) is not indexed.

    pdfs: file_path, file_hash, text with page breaks, ocr_confidence (null without). Blank pages have no document.
    """
    new = pdfs.join(indexed.select("file_path", "file_hash").distinct(), ["file_path", "file_hash"], "left_anti")
    about = new.select("file_path", "file_hash", F.col("ocr_confidence").alias("mean_confidence"))
    pages = chunkers.pages(new, "file_path", "text")
    count = pages.groupBy("file_path").agg(F.max("page_number").alias("page_count"))
    return pages.join(count, "file_path").join(about, "file_path").select("file_path", "file_hash", "page_number", "page_count", "content", "mean_confidence")


def ensure_settings(settings: dict, kind: str) -> tuple[dict, list[str]]:
    """Settings that can filter by all that an index of this kind needs, and what had to be added."""
    need = fulltext.index_settings(kind)["filterable"]
    missing = [a for a in need if a not in settings["filterable"]]
    return settings | {"filterable": [*settings["filterable"], *missing]}, missing
