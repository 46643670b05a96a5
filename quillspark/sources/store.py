"""Versioned tables on plain files: a change writes new directories, then a numbered pointer to them.

Pointers are only ever added: each is created under the next number, which fails if another writer was first, and
the greatest complete one is in force. So a reader finds a whole version at any moment, and a job that dies leaves
unreferenced files and the old version. A table may be cut into buckets by the hash of a column; a change then writes
the buckets it touches and points to the old files of all others.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # pointers
    def _numbers(self, table: str) -> list[int]:
        at = self._path(f"{self.root}/{table}/_at")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _pointer(self, table: str, n: int) -> dict | None:
        """What a pointer says; None if its writer died before the end."""
        stream = self._fs.open(self._path(f"{self.root}/{table}/_at/{n:012d}"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return json.loads(text) if text.endswith("\n") else None

    def _current(self, table: str) -> dict | None:
        return next((p for n in reversed(self._numbers(table)) if (p := self._pointer(table, n)) is not None), None)

    def _point(self, table: str, pointer: dict, after: dict | None = None) -> None:
        numbers = self._numbers(table)
        to = self._path(f"{self.root}/{table}/_at/{(numbers[-1] if numbers else 0) + 1:012d}")
        if after is not None and self._current(table) != after:
            raise RuntimeError(f"another writer has changed {table}")
        out = self._fs.create(to, False)  # fails if another writer took the number
        out.write(bytearray((json.dumps(pointer) + "\n").encode()))
        out.close()

    # reading
    def version(self, table: str) -> str | None:
        p = self._current(table)
        return p and p["version"]

    def exists(self, table: str) -> bool:
        return self._current(table) is not None

    def _read(self, pointer: dict, parts: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(pointer["schema"])
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """The table as it is now; of a bucketed one only some ``buckets``, if given."""
        p = self._current(table)
        if p is None:
            raise LookupError(f"no table {table}")
        if p["parts"] is None:
            return self._read(p, [f"{self.root}/{table}/{p['version']}"])
        return self._read(p, [f"{self.root}/{table}/{d}" for b, d in sorted(p["parts"].items()) if buckets is None or int(b) in buckets])

    # writing
    def write(self, table: str, df: DataFrame, partition_by: list[str] = ()) -> str:
        """The new version's name. ``df`` may be derived from the table itself."""
        v = f"v-{uuid.uuid4().hex}"
        w = df.write.option("compression", "zstd")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{self.root}/{table}/{v}")
        self._point(table, {"version": v, "parts": None, "schema": df.schema.jsonValue()})
        return v

    @staticmethod
    def bucket(column: Column | str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")

    def touched(self, keys: DataFrame, column: str, buckets: int) -> list[int]:
        """The buckets of some keys; there are at most ``buckets``."""
        return sorted(r[0] for r in keys.select(self.bucket(column, buckets).alias("b")).distinct().collect())

    def write_buckets(self, table: str, rows: DataFrame, column: str, buckets: int, touched: list[int] | None = None) -> str:
        """A new version in which the rows of the touched buckets (all, if None) are ``rows``; the other buckets' files stay."""
        old = self._current(table)
        if touched is not None and (old is None or old["parts"] is None):
            raise LookupError(f"no bucketed table {table}")
        v = f"v-{uuid.uuid4().hex}"
        at = f"{self.root}/{table}/{v}"
        rows.withColumn("_bucket", self.bucket(column, buckets)).repartition("_bucket", column).write.option("compression", "zstd").partitionBy("_bucket").parquet(at)
        made = {s.getPath().getName() for s in self._fs.listStatus(self._path(at))}
        parts = {} if touched is None else {b: d for b, d in old["parts"].items() if int(b) not in set(touched)}
        parts |= {d.split("=")[1]: f"{v}/{d}" for d in made if d.startswith("_bucket=")}
        self._point(table, {"version": v, "parts": parts, "schema": rows.schema.jsonValue()}, old)
        return v

    def restore(self, table: str, v: str) -> None:
        """Puts an older version in force."""
        found = next((p for n in reversed(self._numbers(table)) if (p := self._pointer(table, n)) is not None and p["version"] == v), None)
        if found is None or not self._fs.exists(self._path(f"{self.root}/{table}/{v}")):
            raise LookupError(f"no version {v} of {table}")
        self._point(table, found)

    def tables(self) -> list[str]:
        p = self._path(self.root)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p) if self.exists(s.getPath().getName())) if self._fs.exists(p) else []

    def drop(self, table: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{table}"), True)

    def vacuum(self, table: str) -> int:
        """Deletes the versions of which nothing is in force, and the pointers before the last; the number of versions deleted."""
        p, n = self._current(table), 0
        kept = {p["version"]} | {d.split("/")[0] for d in (p["parts"] or {}).values()}
        numbers = self._numbers(table)
        last = next(k for k in reversed(numbers) if self._pointer(table, k) is not None)
        for k in numbers:
            if k < last:
                self._fs.delete(self._path(f"{self.root}/{table}/_at/{k:012d}"), False)
        for s in self._fs.listStatus(self._path(f"{self.root}/{table}")):
            name = s.getPath().getName()
            if name.startswith("v-") and name not in kept:
                self._fs.delete(s.getPath(), True)
                n += 1
        return n
