"""Source files from their chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import latest

FILE = ["git_project_identifier", "file_path"]


def files(chunks: DataFrame) -> DataFrame:
    """(git_project_identifier, file_path, extension, size, content): each file joined from its chunks.

    Repeated rows of an id count once (the latest). A file's chunks are put in order of ``chunk_index``; a null
    content counts as empty. The extension is that of the path, in lower case. A project, however large, is spread
    over its files; what meets in one task is one file.
    """
    c = latest(chunks.select("id", "indexed_at", "chunk_index", "content", "file_size", *FILE), "id", "indexed_at")
    joined = c.groupBy(*FILE).agg(F.sort_array(F.collect_list(F.struct("chunk_index", F.coalesce("content", F.lit("")).alias("content")))).alias("_c"), F.max("file_size").alias("size"))
    return joined.select(*FILE, F.lower(F.regexp_extract("file_path", r"\.([A-Za-z0-9]+)$", 1)).alias("extension"), "size", F.concat_ws("", "_c.content").alias("content"))
