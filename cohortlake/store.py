"""Tables written once and read back, in the folder that all executors share.

A result may read such tables until it is written itself, so only the caller knows when
they can go: what is written inside a ``scope`` is removed at its end.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[str]] = []
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query go when it ends, and not when the driver next collects garbage.

    For queries that run once, such as those that ``stored`` writes.
    """
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREED)
        else:
            spark.conf.set(_FREED, before)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that ``stored`` and ``stored_by`` write inside, but for those to be kept."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _new_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    path = f"{shared_folder(spark)}/{name}"
    if _scopes and not keep:
        _scopes[-1].append(path)
    return path


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of its own only where that is unset and everything runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` written as Parquet and read again: computed once, and safe from lost executors. With ``keep`` it outlives the scope."""
    spark = df.sparkSession
    path = _new_path(spark, f"{name}-{uuid.uuid4().hex}", keep)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, key: str, name: str) -> DataFrame:
    """As ``stored``, in buckets of ``key``: a join on it needs no exchange of this side.

    The table is external, in the shared folder, and its name leaves the catalog at once.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("path", _new_path(spark, table)).format("parquet").saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out
