"""Intermediate tables in the folder that all executors share.

A job that reads an intermediate result more than once writes it as a parquet table below
``spark.checkpoint.dir`` and reads it back: lineage ends there, a lost executor costs only the
tasks it ran, and no Python or shuffle work is repeated.  Only a local master may go without the
setting: a temporary folder is then created once per session and set as checkpoint folder.

Tables written inside ``working_tables`` live as long as that block; others until ``release``.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_WORKING: ContextVar[str | None] = ContextVar("working folder", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where none is set, a new temporary one, on a local master only."""
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-lodestone-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set(_SETTING, folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/lodestone/{spark.sparkContext.applicationId}"


def table_dir(spark: SparkSession) -> str:
    """Where tables are written now."""
    return _WORKING.get() or f"{own_dir(spark)}/tables"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def working_tables(spark: SparkSession) -> Iterator[str]:
    """Delete at the end what is written inside, and nothing else: one query's tables, once its result is written or collected."""
    folder = f"{own_dir(spark)}/working-{uuid.uuid4().hex}"
    token = _WORKING.set(folder)
    try:
        yield folder
    finally:
        _WORKING.reset(token)
        _delete(spark, folder)


def release(spark: SparkSession) -> None:
    """Delete what was written outside ``working_tables``; results that still read from it become unreadable."""
    _delete(spark, f"{own_dir(spark)}/tables")


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` below the shared folder and return the table read back."""
    path = f"{table_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
