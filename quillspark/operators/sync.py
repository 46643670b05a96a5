"""Change detection, renames, staleness, parity: what keeps a corpus equal to its sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..session import materialise


def unchanged(found: DataFrame, indexed: DataFrame, path: str = "file_path", stamp: str = "quick_hash") -> DataFrame:
    """Found files whose path and stamp are indexed. A null stamp is never unchanged."""
    return found.join(indexed.select(path, stamp).distinct(), [path, stamp], "left_semi")


def changed(found: DataFrame, indexed: DataFrame, path: str = "file_path", stamp: str = "quick_hash") -> DataFrame:
    """Found files that need work: the rest."""
    return found.join(indexed.select(path, stamp).distinct(), [path, stamp], "left_anti")


def classified(found: DataFrame, indexed: DataFrame, path: str = "file_path", content: str = "file_hash") -> DataFrame:
    """(path, status): new, modified, unchanged or orphan."""
    f = found.groupBy(path).agg(F.max(content).alias("_f"), F.lit(True).alias("_in"))
    i = indexed.groupBy(path).agg(F.max(content).alias("_i"), F.lit(True).alias("_was"))
    s = F.when(F.col("_was").isNull(), "new").when(F.col("_in").isNull(), "orphan").when(F.col("_f").eqNullSafe(F.col("_i")), "unchanged").otherwise("modified")
    return f.join(i, path, "full_outer").select(path, s.alias("status"))


def renames(found: DataFrame, indexed: DataFrame, path: str = "file_path", content: str = "file_hash", present: DataFrame | None = None) -> DataFrame:
    """(old_path, new_path, content): new paths whose content is that of indexed paths now gone, paired in order of path.

    Equal contents pair by rank, so n new and m gone paths of one hash make min(n, m) renames. Null hashes pair never.
    ``present`` has all paths that are there, if ``found`` has only some of them.
    """
    f, i = found.select(path, content).filter(F.col(content).isNotNull()).distinct(), indexed.select(path, content).filter(F.col(content).isNotNull()).distinct()
    new = f.join(indexed.select(path).distinct(), path, "left_anti")
    gone = i.join((found if present is None else present).select(path).distinct(), path, "left_anti")
    w = Window.partitionBy(content).orderBy(path)
    a = new.select(content, F.col(path).alias("new_path"), F.row_number().over(w).alias("_r"))
    b = gone.select(content, F.col(path).alias("old_path"), F.row_number().over(w).alias("_r"))
    return b.join(a, [content, "_r"]).select("old_path", "new_path", content)


def duplicates_elsewhere(found: DataFrame, indexed: DataFrame, path: str = "file_path", content: str = "file_hash") -> DataFrame:
    """(new_path, old_path): new paths whose content stands at an indexed path that is still there (the least such)."""
    still = indexed.join(found.select(path).distinct(), path, "left_semi").groupBy(content).agg(F.min(path).alias("old_path"))
    return found.join(indexed.select(path).distinct(), path, "left_anti").join(still, content).select(F.col(path).alias("new_path"), "old_path").distinct()


def stale(indexed: DataFrame, on_disk: DataFrame, folders: list[str], path: str = "file_path") -> DataFrame:
    """Indexed paths in the synced folders that are not on disk."""
    scope = F.lit(False)
    for f in folders:
        scope = scope | paths.under(F.col(path), F.lit(f))
    return indexed.select(path).filter(scope).distinct().join(on_disk.select(path), path, "left_anti")


def orphans(indexed: DataFrame, on_disk: DataFrame, path: str = "file_path") -> DataFrame:
    return indexed.select(path).distinct().join(on_disk.select(path), path, "left_anti")


def uncovered(indexed: DataFrame, on_disk: DataFrame, covered: DataFrame, path: str = "file_path") -> DataFrame:
    """Indexed and on disk, but not covered by the run."""
    return indexed.select(path).intersect(on_disk.select(path)).subtract(covered.select(path))


def parity(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, left_count, right_count, status): synced, mismatch, left_only or right_only, by rows per key."""
    a, b = left.groupBy(*keys).agg(F.count("*").alias("left_count")), right.groupBy(*keys).agg(F.count("*").alias("right_count"))
    status = F.when(F.col("right_count").isNull(), "left_only").when(F.col("left_count").isNull(), "right_only").when(F.col("left_count") == F.col("right_count"), "synced").otherwise("mismatch")
    return a.join(b, keys, "full_outer").select(*keys, F.coalesce("left_count", F.lit(0)).alias("left_count"), F.coalesce("right_count", F.lit(0)).alias("right_count"), status.alias("status"))


def metadata_repair(docs: DataFrame, source: DataFrame, path: str = "file_path", fields: tuple[str, ...] = ("git_project_name", "git_branch", "git_commit_hash"), order: str = "id") -> DataFrame:
    """Rows lacking a field, filled from the file's first other row, with the version id made anew; only rows that differ."""
    have = source.filter(F.col(fields[0]).isNotNull()).groupBy(path).agg(F.min_by(F.struct(*fields), order).alias("_m"))
    lacking = docs.filter(F.greatest(*[F.col(f).isNull().cast("int") for f in fields]) == 1)
    out = lacking.join(have, path)
    for f in fields:
        out = out.withColumn(f, F.coalesce(f, F.col(f"_m.{f}")))
    return out.withColumn("version_identifier", paths.version_id(*[F.col(f) for f in fields])).drop("_m")


def reindex_needed(projects: DataFrame, indexed: DataFrame, identifier: str = "git_project_identifier", commit: str = "git_commit_hash") -> DataFrame:
    """(identifier, action): skip where the indexed commit is the current one, update where another, index where none."""
    i = indexed.filter(F.col(identifier).isNotNull()).groupBy(identifier).agg(F.max(commit).alias("_c"), F.lit(True).alias("_was"))
    return projects.join(i, identifier, "left").select(identifier, F.when(F.col("_was").isNull(), "index").when(F.col(commit).eqNullSafe(F.col("_c")), "skip").otherwise("update").alias("action"))


def phases(pending: DataFrame, newest: Column, oldest: Column, at: str, key: str) -> DataFrame:
    """Pending rows with phase (arrived, covered, backlog) and the number of their run of one phase, in the given order.

    A null time belongs to the run in progress. The rows are range-partitioned by the key; of each range only its first
    and last phase and its number of changes are put in one order, and told to the ranges after it.
    """
    phase = F.when(F.col(at).isNull(), None).when(newest.isNull() | (F.col(at) > newest), "arrived").when(F.col(at) >= oldest, "covered").otherwise("backlog")
    parts = int(pending.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = pending.select(key, at, phase.alias("_p")).repartitionByRange(parts, key)
    df = materialise(df.withColumn("_part", F.spark_partition_id()), "phases")
    w = Window.partitionBy("_part").orderBy(key)
    seen = F.last("_p", ignorenulls=True).over(w)
    df = df.withColumn("_own", seen).withColumn("_change", F.coalesce((F.lag("_own").over(w) != F.col("_own")).cast("long"), F.lit(0)))
    ranges = df.groupBy("_part").agg(F.min_by("_own", F.when(F.col("_own").isNotNull(), F.col(key))).alias("_first"), F.max_by("_own", key).alias("_last"), F.sum("_change").alias("_n"))
    line = Window.orderBy("_part")  # one row a range
    ranges = ranges.withColumn("_in", F.last("_last", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)))
    ranges = ranges.withColumn("_turn", F.coalesce((F.col("_in") != F.col("_first")).cast("long"), F.lit(0)))
    ranges = ranges.withColumn("_before", F.sum(F.col("_n") + F.col("_turn")).over(line) - F.col("_n") - F.col("_turn"))
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = ranges.withColumn("_start", F.coalesce("_in", F.first("_first", ignorenulls=True).over(whole), F.lit("arrived"))).select("_part", "_start", "_before", "_turn")
    df = df.join(F.broadcast(ranges), "_part")
    turned = F.when(F.col("_own").isNotNull(), F.col("_turn")).otherwise(0)
    return df.select(key, at, F.coalesce("_own", "_start").alias("phase"), (F.col("_before") + turned + F.sum("_change").over(w)).alias("segment"))


def back_fill(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the source's files that the target lacks, or has with another number of rows; the target's rows of these files are to be replaced."""
    status = parity(source, target, keys).filter("status in ('left_only', 'mismatch')").select(*keys)
    on = [source[k].eqNullSafe(status[k]) for k in keys]
    return source.join(status, on, "left_semi")


def filled(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """The target after the back-fill; files that only the target has stay."""
    rows = back_fill(source, target, keys).select(*target.columns)
    doomed = rows.select(*keys).distinct()
    return target.join(doomed, [target[k].eqNullSafe(doomed[k]) for k in keys], "left_anti").unionByName(rows)


def parity_by_corpus(left: DataFrame, right: DataFrame, corpus: str, path: str) -> DataFrame:
    """(corpus, synced, mismatch, left_only, right_only, state) over all corpora at once; the state tells which side lacks the corpus."""
    p = parity(left, right, [corpus, path])
    n = [F.count_if(F.col("status") == s).alias(s) for s in ("synced", "mismatch", "left_only", "right_only")]
    state = F.when(F.sum("right_count") == 0, "right missing").when(F.sum("left_count") == 0, "left missing").when(F.count_if(F.col("status") != "synced") == 0, "in parity").otherwise("out of parity")
    return p.groupBy(corpus).agg(*n, state.alias("state"))


def fast_path(projects: DataFrame, heads: DataFrame, identifier: str = "git_project_identifier", commit: str = "git_commit_hash") -> DataFrame:
    """(identifier, skip): a project is passed over whole if its commit is the one of its last sync and its tracked files are clean.

    projects: identifier, commit, clean (null counts as not clean). heads: identifier and commit of the last syncs.
    """
    h = heads.groupBy(identifier).agg(F.max(commit).alias("_head"))
    return projects.join(h, identifier, "left").select(identifier, (F.coalesce(F.col("clean"), F.lit(False)) & F.coalesce(F.col(commit) == F.col("_head"), F.lit(False))).alias("skip"))


def page_counts(files: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """``files`` with page_count filled from facts about the files themselves where it is null."""
    f = facts.groupBy(*keys).agg(F.max("page_count").alias("_pages"))
    on = [files[k].eqNullSafe(f[k]) for k in keys]
    return files.join(f, on, "left").select(*[F.coalesce(files[c], f["_pages"]).alias(c) if c == "page_count" else files[c] for c in files.columns])
