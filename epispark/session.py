"""Session helpers: a tuned local session and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "epispark", **conf: str) -> SparkSession:
    """Session used by tests and ``bench.py``; clusters bring their own session."""
    parts = str(cpus) if str(cpus).isdigit() else "8"
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", parts)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may fall back to a
    temporary folder, because there driver and executors share one file system.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the scratch root; nothing is ever overwritten there."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def scratch_table(df: DataFrame, label: str) -> tuple[DataFrame, Callable[[], None]]:
    """:func:`materialise`, and a handle that deletes the table once nothing reads it any more."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)

    def drop() -> None:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)

    return spark.read.schema(df.schema).parquet(path), drop


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and return the table read back.

    Used to cut lineage: unlike executor-local caching, the written table survives lost executors.
    """
    return scratch_table(df, label)[0]
