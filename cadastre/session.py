"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, shared: str | None = None) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own.

    ``shared`` names the folder for written steps, unless Spark's defaults do.
    """
    builder = SparkSession.builder if shared is None else SparkSession.builder.config("spark.checkpoint.dir", shared)
    return (
        builder.master(f"local[{cores}]")
        .appName("cadastre")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    The session names it in ``spark.checkpoint.dir``; none is made up here.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named


_scope: ContextVar[str | None] = ContextVar("scope", default=None)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[str]:
    """Everything written inside stands below one new folder, which is deleted at the end.

    Results read what was written, so they are used or saved before the scope ends.
    """
    folder = f"{shared_dir(spark).rstrip('/')}/scope-{uuid.uuid4().hex}"
    token = _scope.set(folder)
    try:
        yield folder
    finally:
        _scope.reset(token)
        _delete(spark, folder)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder, or below that of the scope."""
    base = _scope.get() or shared_dir(spark).rstrip("/")
    return f"{base}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage through a written table, which survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of tables from ``materialise`` that nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, table._written)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
