"""Export, import and backup.

The JSON form is one header line and one line per row; the binary form is a parquet directory. Paths can be made
relative on export and put below another root, or remapped, on import.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths
from .store import Store

FORMAT_VERSION = 1


def selected(rows: DataFrame, where: Column | None = None, detach_root: str | None = None, path: str = "file_path") -> DataFrame:
    df = rows.filter(where) if where is not None else rows
    return df.withColumn(path, paths.detach(F.col(path), F.lit(detach_root))) if detach_root else df


def placed(rows: DataFrame, attach_root: str | None = None, remaps: list[tuple[str, str]] = (), path: str = "file_path") -> DataFrame:
    if remaps:
        rows = rows.withColumn(path, paths.remap(F.col(path), list(remaps)))
    return rows.withColumn(path, paths.attach(F.col(path), F.lit(attach_root))) if attach_root else rows


def export_jsonl(rows: DataFrame, to: str, name: str, single_file: bool = False) -> None:
    """Rows as JSON lines, with the header (schema, name, version) beside them; binary columns are base64."""
    spark = rows.sparkSession
    body = rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    (body.coalesce(1) if single_file else body).write.text(f"{to}/rows")
    header = json.dumps({"_header": True, "version": FORMAT_VERSION, "name": name, "schema": rows.schema.jsonValue()})
    spark.createDataFrame([(header,)], "value string").coalesce(1).write.text(f"{to}/header")


def import_jsonl(spark: SparkSession, at: str) -> tuple[dict, DataFrame]:
    """(header, rows); blank lines are passed over, a missing header or a newer version is an error."""
    lines = spark.read.text(f"{at}/header").filter("value <> ''").take(1)
    header = json.loads(lines[0]["value"]) if lines else {}
    if not header.get("_header"):
        raise ValueError("the first line is no header")
    if header["version"] > FORMAT_VERSION:
        raise ValueError(f"version {header['version']} is newer than {FORMAT_VERSION}")
    schema = T.StructType.fromJson(header["schema"])
    rows = spark.read.text(f"{at}/rows").filter(F.trim("value") != "").select(F.from_json("value", schema).alias("r")).select("r.*")
    return header, rows


def import_index_lines(spark: SparkSession, at: str, schema: T.StructType) -> tuple[dict, DataFrame]:
    """Index dumps: lines with _type index_metadata or document."""
    raw = spark.read.text(at).filter(F.trim("value") != "")
    head = raw.filter(F.get_json_object("value", "$._type") == "index_metadata").take(1)
    if not head:
        raise ValueError("the dump has no index_metadata line")
    docs = raw.filter(F.get_json_object("value", "$._type") == "document").select(F.from_json("value", schema).alias("r")).select("r.*")
    return json.loads(head[0]["value"]), docs


def export_binary(rows: DataFrame, to: str) -> None:
    rows.write.option("compression", "zstd").parquet(to)


def import_binary(spark: SparkSession, at: str, store: Store, table: str) -> str:
    """Into a new table; an existing one is an error."""
    if store.exists(table):
        raise FileExistsError(f"there is a table {table} already")
    return store.write(table, spark.read.parquet(at))


def backup(store: Store, tables: list[str], to: str) -> DataFrame:
    """Copies the versions in force, and writes a manifest with their counts of rows."""
    spark, seen = store.spark, []
    for t in tables:
        v = store.version(t)
        df = store.read(t)
        df.write.parquet(f"{to}/{t}")
        seen.append((t, v, spark.read.parquet(f"{to}/{t}").count()))
    manifest = spark.createDataFrame(seen, "table string, version string, n_rows long")
    manifest.coalesce(1).write.json(f"{to}/_manifest")
    return manifest


def restore(store: Store, at: str) -> list[str]:
    """Checks every table's count against the manifest before any is touched, then writes new versions."""
    spark = store.spark
    rows = spark.read.json(f"{at}/_manifest").collect()
    for r in rows:
        n = spark.read.parquet(f"{at}/{r['table']}").count()
        if n != r["n_rows"]:
            raise ValueError(f"{r['table']} has {n} rows; its manifest says {r['n_rows']}")
    for r in rows:
        store.write(r["table"], spark.read.parquet(f"{at}/{r['table']}"))
    return [r["table"] for r in rows]
