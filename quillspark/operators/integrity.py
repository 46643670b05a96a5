"""Completeness and health of files, projects and collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def file_completeness(chunks: DataFrame, keys: list[str], index: str = "chunk_index", count: str = "chunk_count") -> DataFrame:
    """One row per file: expected and actual chunks, missing and unexpected indices, duplicates, conflicts, is_complete.

    The expected number is the highest declared. Rows without index are left out. Two levels of grouping: indices
    are counted first, so a file's repeated rows are added up before they meet.
    """
    per = chunks.filter(F.col(index).isNotNull()).groupBy(*keys, index).agg(F.count("*").alias("_n"), F.max(count).alias("_hi"), F.min(count).alias("_lo"))
    f = per.groupBy(*keys).agg(
        F.max("_hi").cast("int").alias("expected_chunks"), F.count("*").alias("distinct_chunks"), F.sum("_n").alias("actual_rows"),
        F.sum(F.col("_n") - 1).alias("duplicate_chunks"), (F.max("_hi") != F.min("_lo")).alias("conflicting_counts"), F.sort_array(F.collect_set(index)).alias("_have"),
    )
    want = F.when(F.col("expected_chunks") > 0, F.sequence(F.lit(0), F.col("expected_chunks") - 1)).otherwise(F.array().cast("array<int>"))
    f = f.withColumn("missing_indices", F.array_except(want, F.col("_have").cast("array<int>"))).withColumn("unexpected_indices", F.array_except(F.col("_have").cast("array<int>"), want))
    whole = (F.size("missing_indices") == 0) & (F.size("unexpected_indices") == 0) & F.coalesce(~F.col("conflicting_counts"), F.lit(True)) & F.coalesce(F.col("expected_chunks") > 0, F.lit(False))
    return f.drop("_have").withColumn("is_complete", whole)


def project_completeness(files: DataFrame, project: str) -> DataFrame:
    """Files, complete files and chunks per project, with the share in percent (100 where nothing is expected)."""
    g = files.groupBy(project).agg(F.count("*").alias("files"), F.count_if("is_complete").alias("complete_files"), F.sum("expected_chunks").cast("long").alias("expected_chunks"), F.sum("distinct_chunks").alias("actual_chunks"))
    return g.withColumn("completion", F.when(F.coalesce("expected_chunks", F.lit(0)) == 0, 100.0).otherwise(F.round(100.0 * F.col("actual_chunks") / F.col("expected_chunks"), 3)))


def quality(chunks: DataFrame, keys: list[str], text: str, threshold: float = 0.9) -> DataFrame:
    """Mean score of a group's non-blank texts, characters, and whether the mean is below the threshold."""
    s = F.when(~tx.is_blank(F.col(text)), tx.score_text(F.col(text)))
    g = chunks.groupBy(*keys).agg(F.round(F.avg(s), 3).alias("avg_quality_score"), F.sum(F.length(text)).alias("total_chars"), F.count("*").alias("chunks"))
    return g.withColumn("has_garbled_text", F.coalesce(F.col("avg_quality_score") < threshold, F.lit(False)))


def health(verified: DataFrame) -> DataFrame:
    """Totals over file verifications and is_healthy: nothing incomplete, garbled, dropped out or doubled."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    bad = ~F.coalesce(F.col("is_complete"), F.lit(True)) | flag("has_garbled_text") | flag("suspected_dropout") | flag("has_duplicate_chunks")
    return verified.groupBy("collection").agg(
        F.count("*").alias("files"), F.count_if(~F.coalesce(F.col("is_complete"), F.lit(True))).alias("incomplete_files"), F.count_if(flag("has_garbled_text")).alias("garbled_files"),
        F.count_if(flag("suspected_dropout")).alias("dropout_files"), F.count_if(flag("has_duplicate_chunks")).alias("duplicate_files"), (F.count_if(bad) == 0).alias("is_healthy"),
    )


def quality_manifest(pages: DataFrame, keys: list[str], page: str, n_pages: str, text: str, low: int = 200) -> DataFrame:
    """Per file: covered, empty and low-text pages and the warnings they give."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    g = pages.groupBy(*keys).agg(F.max(n_pages).alias("page_count"), F.sort_array(F.collect_set(F.when(n > 0, F.col(page)))).alias("covered_pages"), F.sort_array(F.collect_set(F.when((n > 0) & (n < low), F.col(page)))).alias("low_text_pages"))
    every = F.when(F.col("page_count") > 0, F.sequence(F.lit(1), F.col("page_count"))).otherwise(F.array().cast("array<int>"))
    g = g.withColumn("empty_pages", F.array_except(every, "covered_pages"))
    warnings = F.filter(F.array(F.when(F.size("empty_pages") > 0, "empty_pages"), F.when(F.size("low_text_pages") > 0, "low_text_pages")), lambda x: x.isNotNull())
    return g.withColumn("quality_warnings", F.array_join(warnings, ","))
