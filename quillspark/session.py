"""Session and shared-storage helpers used by every operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "quillspark", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, as a plain parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset, on one machine (tests), a temporary folder is made and set; on a cluster it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        made = tempfile.mkdtemp(prefix="quillspark-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        where = "file://" + made
        spark.conf.set("spark.checkpoint.dir", where)
    return where


_WRITTEN: list[str] = []


def clean(spark: SparkSession) -> int:
    """Deletes what ``materialise`` has written in this process, once its results are no longer read."""
    n = 0
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """Cut the lineage: write ``df`` once to the shared folder and read it back.

    Unlike ``checkpoint()`` this computes the plan once; the copy survives the loss of executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspark/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
