"""A cohort's table that takes new samples without being written anew.

Rows lie in a folder per sample, in order inside; a manifest of the same layout holds how
many variants and rows each sample has on each chromosome. Adding samples overwrites their
folders only, and the check that all samples agree reads the manifest alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _overwrite(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sample_id").parquet(path)


def add_samples(rows: DataFrame, path: str, key: str = "sv_id", order: str = "pos", span: int = 10_000_000) -> None:
    """Add the samples of ``rows`` (sample_id, chrnum, ``key``, ``order`` and others), or replace them.

    A sample's rows are dealt by chromosome and stretch, so that a large one is many tasks.
    """
    counts = rows.groupBy("sample_id", "chrnum").agg(F.count_distinct(key).alias("variants"), F.count("*").alias("rows"))
    _overwrite(rows.repartition("sample_id", "chrnum", F.floor(F.col(order) / span)).sortWithinPartitions("sample_id", "chrnum", order), f"{path}/rows")
    # the manifest last: what it lists is there
    _overwrite(counts.repartition("sample_id"), f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, chrnum, variants, rows."""
    return spark.read.parquet(f"{path}/manifest")


def disagreements(spark: SparkSession, path: str) -> DataFrame:
    """chrnum, samples, least, most: chromosomes on which samples differ in their number of variants, or that some sample lacks."""
    each = manifest(spark, path)
    whole = each.agg(F.count_distinct("sample_id").alias("_all"))
    by = each.groupBy("chrnum").agg(F.count("*").alias("samples"), F.min("variants").alias("least"), F.max("variants").alias("most"))
    return by.join(F.broadcast(whole), F.lit(True)).where("least <> most or samples <> _all").drop("_all")  # one row


def read(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """The cohort's rows; with ``check``, after the manifest has shown that all samples agree."""
    if check and (bad := disagreements(spark, path).orderBy("chrnum").limit(5).collect()):
        raise ValueError("samples differ in their variants: " + ", ".join(f"chromosome {r.chrnum}: {r.samples} samples, {r.least} to {r.most}" for r in bad))
    return spark.read.parquet(f"{path}/rows")
