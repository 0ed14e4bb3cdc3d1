"""Window depth kept up to date from a stream of positions (an extension: batch results are the reference)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import shared_folder


def window_totals(rows: DataFrame, width: int) -> DataFrame:
    """chrnum, bucket, n, total from rows chrnum, pos, depth; on a stream, a running aggregate with one state row per bucket."""
    return rows.groupBy("chrnum", F.floor(F.col("pos") / width).cast("int").alias("bucket")).agg(F.count("*").alias("n"), F.sum("depth").alias("total"))


def replay(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Reads the event files as a stream until none is left and returns the totals that it arrived at."""
    table = spark.read.parquet(path)
    source, name = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 8), path.rpartition("/")[2]
    if table.inputFiles()[0].endswith(f"/{name}"):  # one file: a stream reads folders
        source, path = source.option("pathGlobFilter", name), path.rpartition("/")[0]
    events = source.parquet(path)
    rows = events.select(
        (F.col("event_id") % 2 + 1).cast("int").alias("chrnum"),
        F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01', ts)").cast("int").alias("pos"),
        F.round(F.col("value") * 100).cast("long").alias("depth"),
    )
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/totals/number={number}")

    # each batch writes only the buckets it changed; the last word on a bucket counts
    query = window_totals(rows, width).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    if not _written(spark, f"{folder}/totals"):
        return spark.createDataFrame([], "chrnum int, bucket int, n long, total long")
    last = F.max_by(F.struct("n", "total"), "_batch").alias("v")
    return spark.read.parquet(f"{folder}/totals").groupBy("chrnum", "bucket").agg(last).select("chrnum", "bucket", "v.*")


def _written(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
