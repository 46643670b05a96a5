"""Views of one chunk table under the names that other stores use, and rows for people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# Field names of the full-text store, and the fields every result shows.
TEXT_NAMES = {"programming_language": "language", "git_project_name": "project", "git_branch": "branch"}
ESSENTIAL = ["file_path", "programming_language", "git_project_name", "git_branch", "page_number", "chunk_index"]
NOT_IN_TEXT_STORE = ("embedding", "chunk_count", "source_hash", "file_hash", "quick_hash")
SCHEMA_VERSION = 1


def text_documents(chunks: DataFrame) -> DataFrame:
    """The full-text store's view: its names, without vectors, hashes and chunk counts."""
    return chunks.select(*[F.col(c).alias(TEXT_NAMES.get(c, c)) for c in chunks.columns if c not in NOT_IN_TEXT_STORE])


def payload(df: DataFrame, fields: list[str] | None = None) -> Column:
    """A JSON object of the fields that are not null."""
    return F.to_json(F.struct(*[f for f in (fields or df.columns) if f in df.columns]))


def from_payload(rows: DataFrame, column: str, schema: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """Payload objects as columns; absent fields get the defaults."""
    df = rows.withColumn("_p", F.from_json(column, schema)).select(*[c for c in rows.columns if c != column], "_p.*")
    return df.fillna(defaults) if defaults else df


def stamped(rows: DataFrame, app_version: str) -> DataFrame:
    """schema_version and app_version where the rows have none of their own."""
    have = set(rows.columns)
    v = F.coalesce("schema_version", F.lit(SCHEMA_VERSION)) if "schema_version" in have else F.lit(SCHEMA_VERSION)
    a = F.coalesce("app_version", F.lit(app_version)) if "app_version" in have else F.lit(app_version)
    return rows.withColumn("schema_version", v).withColumn("app_version", a)


def essential(df: DataFrame, verbose: bool = False) -> DataFrame:
    return df if verbose else df.select(*[c for c in ESSENTIAL if c in df.columns])


def inline_metadata(language: Column, project: Column, branch: Column, page: Column, verbose: bool = False) -> Column:
    """Language: x | Project: y | Branch: z | Page: n; main branches are not told."""
    parts = [F.concat(F.lit("Language: "), language), F.concat(F.lit("Project: "), project)]
    if verbose:
        parts.append(F.when(~branch.isin("main", "master"), F.concat(F.lit("Branch: "), branch)))
    return F.concat_ws(" | ", *parts, F.concat(F.lit("Page: "), page.cast("string")))


def rendered(hits: DataFrame, offset: int = 0, length: int = 200) -> DataFrame:
    """One line per hit: [n] percent, location, snippet. The rows must be a page of results."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.orderBy(F.col("score").desc(), "location")) + offset
    return hits.select(n.alias("n"), F.concat(F.lit("["), n, F.lit("] "), F.floor(F.col("score") * 100), F.lit("% "), F.col("location"), F.lit("\n"), tx.snippet(F.col("content"), length)).alias("line"))


def envelope(rows: DataFrame, **fields) -> DataFrame:
    """One JSON object with status, data and the rows as hits; for a page of results, not a table."""
    hits = rows.agg(F.collect_list(F.struct("*")).alias("hits"), F.count("*").alias("count"))
    extra = [F.lit(v).alias(k) for k, v in fields.items()]
    return hits.select(F.to_json(F.struct(F.lit("success").alias("status"), F.struct(*extra, "count", "hits").alias("data"))).alias("value"))


def schema_state(version: Column, app_version: Column, supported: int = SCHEMA_VERSION) -> Column:
    """legacy, invalid, older, newer, no_app_version or ok, from a version as text."""
    v = version.cast("string")
    n = F.when(v.rlike(r"^\d+$"), v.cast("int"))
    return (
        F.when(v.isNull(), "legacy").when(n.isNull(), "invalid").when(n < supported, "older").when(n > supported, "newer")
        .when(F.coalesce(app_version, F.lit("")) == "", "no_app_version").otherwise("ok")
    )


def count_field(value: Column) -> Column:
    """A non-negative whole number from text, else null; true and false are none."""
    return F.when(value.rlike(r"^\d+$"), value.try_cast("bigint"))


def item_unit(kind: Column) -> Column:
    return F.when(kind == "code", "repositories").when(kind == "markdown", "files").when(kind == "pdf", "documents").otherwise("unknown")


def last_sync(at: Column, chunks: Column) -> Column:
    """The time to the second, or never synced, or unknown where there are chunks all the same."""
    return F.coalesce(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.when(chunks > 0, "unknown").otherwise("never synced"))


def chunk_sizing(models: DataFrame) -> DataFrame:
    """chunk_size, chunk_overlap and late_chunking from a model's backend and dimensions."""
    late = F.col("backend") == "sentence-transformers"
    size = F.when(late & (F.col("dimensions") >= 1024), 768).when(late, 512).otherwise(460)
    df = models.withColumn("late_chunking", late).withColumn("chunk_size", size)
    return df.withColumn("chunk_overlap", F.greatest(F.lit(1), (F.floor(F.col("chunk_size") * 0.15 / 23) * 23).cast("int")))


def model_tiers(models: DataFrame) -> DataFrame:
    """risk and support tiers from parameters (billions), backend, deprecated and default_for."""
    p = F.col("params_billions")
    risk = F.when(p >= 5, "very-high").when(p >= 1, "high").when(p >= 0.3, "medium").otherwise("low")
    support = (
        F.when(F.coalesce("deprecated", F.lit(False)), "deprecated").when(F.coalesce(F.size("default_for"), F.lit(0)) > 0, "stable-default")
        .when(F.coalesce("backend", F.lit("fastembed")) == "fastembed", "stable").when(risk.isin("high", "very-high"), "gpu-opt-in").otherwise("opt-in")
    )
    return models.withColumn("risk", risk).withColumn("support", support)


def match_models(stored: DataFrame, named: DataFrame) -> DataFrame:
    """(model, vector): stored model names matched to named vectors by name, key or canonical name, leftovers alone.

    stored: model, alias, canonical. named: vector.
    """
    keys = stored.select("model", F.explode(F.array_distinct(F.array("model", "alias", "canonical"))).alias("vector")).filter("vector is not null")
    hit = keys.join(named, "vector").groupBy("model").agg(F.min("vector").alias("vector"))
    both = stored.select("model").join(hit, "model", "left")
    return both.unionByName(named.join(hit.select("vector").distinct(), "vector", "left_anti").select(F.lit(None).cast("string").alias("model"), "vector"))


def policy_state(stored: Column, current: Column) -> Column:
    """ok, backfill (none stored) or different, of two prompt policies as structs."""
    return F.when(stored.isNull(), "backfill").when(F.to_json(stored).eqNullSafe(F.to_json(current)), "ok").otherwise("different")


def compared_runs(old: DataFrame, new: DataFrame, same: list[str], value: str = "throughput") -> DataFrame:
    """Speed-up of benchmark runs; rows that differ in what must be the same are told, not compared."""
    a = old.select("run", *[F.col(c).alias(f"_o{c}") for c in same], F.col(value).alias("_old"))
    j = new.select("run", *same, value).join(a, "run")
    ok = F.lit(True)
    for c in same:
        ok = ok & F.col(c).eqNullSafe(F.col(f"_o{c}"))
    return j.select("run", F.when(ok, "compared").otherwise("different").alias("status"), F.when(ok & (F.col("_old") > 0), F.round(F.col(value) / F.col("_old"), 3)).alias("speed_up"))


def qualified(runs: DataFrame, speed_up: float = 1.2, agreement: float = 0.999, soak_minutes: float = 30) -> DataFrame:
    """qualified where every gate is passed, experimental otherwise."""
    ok = (F.col("speed_up") >= speed_up) & (F.col("agreement") >= agreement) & (F.col("soak_minutes") >= soak_minutes)
    return runs.withColumn("decision", F.when(F.coalesce(ok, F.lit(False)), "qualified").otherwise("experimental"))


def stage_profile(stages: DataFrame, stage: str, seconds: str, items: str) -> DataFrame:
    """Time, share of all time and items per second of each stage."""
    from pyspark.sql import Window

    g = stages.groupBy(stage).agg(F.sum(seconds).alias("total"), F.sum(items).alias("items"))
    whole = F.sum("total").over(Window.partitionBy(F.lit(1)))  # of the few rows that are left
    return g.select(stage, "total", F.round(100.0 * F.col("total") / whole, 3).alias("percent"), F.round(F.when(F.col("total") > 0, F.col("items") / F.col("total")), 6).alias("rate"))
