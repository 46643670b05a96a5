"""Changes to a corpus as new states of its tables: each function gives the table as it is after the change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def upsert(rows: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` replaces rows of the same key; both need the same columns."""
    return rows.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def delete(rows: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(doomed.select(*keys).distinct(), keys, "left_anti")


def delete_project(rows: DataFrame, identifier: str, column: str = "git_project_identifier") -> DataFrame:
    """All rows of a project's branch go; other branches and rows of no project stay."""
    return rows.filter(~F.coalesce(F.col(column) == identifier, F.lit(False)))


def rename(rows: DataFrame, moves: DataFrame, path: str = "file_path", name: str | None = "filename") -> DataFrame:
    """(old_path, new_path) applied to path and file name."""
    out = rows.join(moves.select(F.col("old_path").alias(path), F.col("new_path").alias("_new")), path, "left")
    cols = []
    for c in rows.columns:
        if c == path:
            cols.append(F.coalesce("_new", path).alias(path))
        elif c == name:
            cols.append(F.when(F.col("_new").isNotNull(), paths.filename(F.col("_new"))).otherwise(F.col(name)).alias(name))
        else:
            cols.append(F.col(c))
    return out.select(*cols)


def add_locations(locations: DataFrame, new: DataFrame) -> DataFrame:
    """(file_hash, file_path, quick_hash) with further paths of known contents; a known path gets the new stamp."""
    known = new.join(locations.select("file_hash").distinct(), "file_hash", "left_semi")
    return upsert(locations, known, ["file_hash", "file_path"])


def prune(rows: DataFrame, on_disk: DataFrame, folders: list[str], path: str = "file_path") -> DataFrame:
    """Rows whose path lies in the synced folders but is not on disk go."""
    scope = F.lit(False)
    for f in folders:
        scope = scope | paths.under(F.col(path), F.lit(f))
    return delete(rows, rows.filter(scope).select(path).distinct().join(on_disk.select(path), path, "left_anti"), [path])


def better_only(old: DataFrame, new: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Repair: a new row replaces the old only with a higher score; new keys are taken."""
    o = old.select(*keys, F.col(score).alias("_old"))
    take = new.join(o, keys, "left").filter(F.col("_old").isNull() | (F.col(score) > F.col("_old"))).drop("_old")
    return upsert(old, take, keys)


def exclusive(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The latest row of each key, by aggregation (no sort): for tables whose rows repeat. A null time is the earliest."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(at)).alias("_r")).select("_r.*")
