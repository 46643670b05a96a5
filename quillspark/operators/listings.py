"""Counts and listings of collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def items(rows: DataFrame, keys: list[str], attributes: list[str], order: str) -> DataFrame:
    """One row per item with its number of rows and the attributes of its first row in ``order``."""
    first = F.min_by(F.struct(*attributes), order)
    return rows.groupBy(*keys).agg(F.count("*").alias("chunks"), first.alias("_f")).select(*keys, "chunks", *[F.col(f"_f.{a}").alias(a) for a in attributes])


def projects(rows: DataFrame, identifier: str = "git_project_identifier", commit: str = "git_commit_hash", order: str = "id") -> DataFrame:
    """Indexed projects: first commit, rows, and whether several commits are mixed."""
    r = rows.filter(F.col(identifier).isNotNull())
    return r.groupBy(identifier).agg(F.min_by(commit, order).alias("commit"), F.count("*").alias("chunks"), (F.countDistinct(commit) > 1).alias("mixed_commits"))


def branches(rows: DataFrame, identifier: str = "git_project_identifier") -> DataFrame:
    """Branches per project, from name#branch."""
    name, branch = F.split_part(identifier, F.lit("#"), F.lit(1)), F.regexp_extract(identifier, "#(.*)$", 1)
    d = rows.filter(F.col(identifier).contains("#")).select(name.alias("project"), branch.alias("branch")).distinct()
    return d.groupBy("project").agg(F.count("*").alias("n_branches"), F.array_join(F.sort_array(F.collect_list("branch")), ",").alias("branches"))


def low_counts(rows: DataFrame, key: str, least: int = 5) -> DataFrame:
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("chunks")).filter(F.col("chunks") < least)


def distinct_items(rows: DataFrame, keys: list[str], path: str = "file_path") -> DataFrame:
    """Rows and distinct paths per group; arrays of paths count each of theirs."""
    if dict(rows.dtypes).get(path, "").startswith("array"):
        rows = rows.withColumn(path, F.explode_outer(path))
    return rows.groupBy(*keys).agg(F.count("*").alias("chunks"), F.countDistinct(path).alias("items"))


def facet(rows: DataFrame, key: str, limit: int = 10_000) -> DataFrame:
    """Distinct values of an attribute, null where there are ``limit`` or more."""
    return rows.agg(F.countDistinct(key).alias("n")).select(F.when(F.col("n") < limit, F.col("n")).alias("distinct_values"))


def manifests(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """One row per file: its stamps, and the declared number of chunks, else the number seen."""
    return chunks.groupBy(*keys).agg(F.min("quick_hash").alias("quick_hash"), F.min("file_hash").alias("file_hash"), F.coalesce(F.max("chunk_count").cast("long"), F.count("*")).alias("chunk_count"), F.max("file_size").alias("file_size"))


def paths_by_content(files: DataFrame, content: str, path: str) -> DataFrame:
    """Contents at several paths, with these. Copies beyond what one row should hold are counted, and the least path shown."""
    return files.filter(F.col(content).isNotNull()).groupBy(content).agg(F.countDistinct(path).alias("n_paths"), F.min(path).alias("first_path"), F.max(path).alias("last_path")).filter("n_paths > 1")


def common_root(rows: DataFrame, path: str = "file_path") -> DataFrame:
    """The longest common folder of all absolute paths, from the least and the greatest; null if it is / or none."""
    p = rows.filter(F.col(path).startswith("/")).agg(F.min(path).alias("a"), F.max(path).alias("b"))
    x, y = F.split("a", "/"), F.split("b", "/")
    n = F.least(F.size(x), F.size(y))
    same = F.filter(F.sequence(F.lit(1), n), lambda i: F.slice(x, 1, i) == F.slice(y, 1, i))
    folder = F.array_join(F.slice(x, 1, F.greatest(F.coalesce(F.array_max(same), F.lit(1)), F.lit(1))), "/")
    whole = F.when(F.col("a") == F.col("b"), F.regexp_replace("a", "/[^/]*$", "")).otherwise(folder)
    return p.select(F.when(whole != "", whole).alias("root"))


def log_usage(log: DataFrame) -> DataFrame:
    """Commands with their runs, failures, mean results and latencies; repeated entries count once.

    Null and negative durations are left out of the latencies. p95 is the order statistic at ceil(0.95 n).
    """
    once = log.dropDuplicates(["entry_id"])
    ok = F.when(F.col("duration_ms") >= 0, F.col("duration_ms"))
    return once.groupBy("command_name").agg(
        F.count("*").alias("runs"), F.count_if(F.col("error_text").isNotNull()).alias("failures"), F.round(F.avg("result_count"), 6).alias("mean_results"),
        F.expr("percentile_disc(0.5) within group (order by case when duration_ms >= 0 then duration_ms end)").cast("long").alias("p50_ms"),
        F.expr("percentile_disc(0.95) within group (order by case when duration_ms >= 0 then duration_ms end)").cast("long").alias("p95_ms"), F.max(ok).alias("max_ms"),
    )


def page_of_items(rows: DataFrame, keys: list[str], limit: int, offset: int = 0, name: str = "filename") -> DataFrame:
    """A page of items by name (where null, by their keys): offset and limit both count items, not rows."""
    g = rows.groupBy(*keys).agg(F.count("*").alias("chunks"), F.min(name).alias(name))
    return g.orderBy(F.coalesce(F.col(name), F.concat_ws("/", *keys)), *keys).offset(offset).limit(limit)


def latencies(log: DataFrame, keys: list[str], duration: str = "duration_ms", shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Order statistics of the durations per group, at ceil(share * n); null and negative durations are left out."""
    ok = log.filter(F.col(duration) >= 0)
    return ok.groupBy(*keys).agg(F.count("*").alias("n"), *[F.expr(f"percentile_disc({x}) within group (order by {duration})").cast("long").alias(f"p{round(x * 100)}_ms") for x in shares])


def store_statistics(rows: DataFrame, path: str = "file_path", project: str = "git_project_identifier", size: str = "file_size") -> DataFrame:
    """Rows, files, projects and bytes of a store; a file's size counts once."""
    files = rows.groupBy(path).agg(F.count("*").alias("n"), F.max(size).alias("size"))
    counted = files.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count_if(F.col(path).isNotNull()).alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("n_bytes"))
    return counted.join(F.broadcast(rows.agg(F.countDistinct(project).alias("n_projects"))), F.lit(True))  # two single rows
