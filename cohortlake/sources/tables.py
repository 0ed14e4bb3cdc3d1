"""Other text and table sources and sinks: interval lists, BED, item lists, FASTA, partitioned pileups."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import chrom_number, tokens
from ..store import shared_folder


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """item: one per line that isn't empty."""
    return spark.read.text(path).select(F.trim("value").alias("item")).where("item <> ''")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chrnum, beg, end: half-open; a line with one number is the one-based point."""
    t = spark.read.text(path).where(~F.startswith("value", F.lit("#"))).select(tokens(F.col("value")).alias("t")).where("size(t) >= 2")
    first, second = F.expr("try_cast(get(t, 1) as int)"), F.expr("try_cast(get(t, 2) as int)")
    return t.select(chrom_number(F.get("t", F.lit(0))).alias("chrnum"), F.when(second.isNull(), first - 1).otherwise(first).alias("beg"), F.coalesce(second, first).alias("end"))


def read_regions(spark: SparkSession, regions: list[str]) -> DataFrame:
    """region_id, chrnum, beg, end; unreadable ones are left out."""
    from ..functions.scalars import region

    rows = spark.createDataFrame(list(enumerate(regions)), "region_id int, text string").select("region_id", region(F.col("text")).alias("r"))
    return rows.where("r is not null").select("region_id", chrom_number(F.col("r.name")).alias("chrnum"), "r.beg", "r.end")


def read_fasta(spark: SparkSession, path: str, width: int = 100) -> DataFrame:
    """chrnum, bucket, bases: each contig in pieces of ``width``, put together from its lines.

    Names and offsets are filled forward inside a file split (a task's share of lines), and
    a table of one row per split carries the last name and its length so far to the next.
    So no task sees a contig whole; a line is cut at bucket bounds.
    """
    m = F.col("_metadata")
    text = spark.read.text(path).select(m["file_path"].alias("file"), m["file_block_start"].alias("split"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", r"\s+$", "").alias("line"))
    named = F.startswith("line", F.lit(">"))
    rows = text.withColumn("name", F.when(named, chrom_number(F.regexp_extract("line", r"^>\s*(\S+)", 1)))).withColumn("n", F.when(named, 0).otherwise(F.char_length("line")))
    order = Window.partitionBy("file", "split").orderBy("id")
    rows = rows.withColumns({"own": F.last("name", ignorenulls=True).over(order), "part": F.count("name").over(order)})
    before = Window.partitionBy("file", "split", "part").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n").over(before), F.lit(0)))

    tails = rows.groupBy("file", "split", "part").agg(F.sum("n").alias("n"), F.max("own").alias("own")).groupBy("file", "split").agg(F.max(F.struct("part", "n", "own")).alias("t"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.withColumn("sofar", F.coalesce(F.sum("t.n").over(earlier), F.lit(0)))
    start = F.last(F.when(F.col("t.part") > 0, F.col("sofar")), ignorenulls=True).over(earlier)
    carried = carried.select("file", "split", F.last(F.when(F.col("t.part") > 0, F.col("t.own")), ignorenulls=True).over(earlier).alias("carried"), (F.col("sofar") - F.coalesce(start, F.lit(0))).alias("base"))

    first = F.col("part") == 0
    rows = rows.where("n > 0").join(carried, ["file", "split"])
    rows = rows.select(F.when(first, F.col("carried")).otherwise(F.col("own")).alias("chrnum"), (F.col("inside") + F.when(first, F.col("base")).otherwise(0)).alias("at"), "n", "line").where("chrnum is not null")
    last = F.col("at") + F.col("n")
    parts = rows.select("chrnum", "at", last.alias("last"), "line", F.explode(F.sequence(F.floor(F.col("at") / width), F.floor((last - 1) / width))).alias("bucket"))
    beg, end = F.greatest(F.col("at"), F.col("bucket") * width), F.least(F.col("last"), (F.col("bucket") + 1) * width)
    piece = F.struct(beg.alias("at"), F.substring(F.col("line"), (beg - F.col("at") + 1).cast("int"), (end - beg).cast("int")).alias("s"))
    parts = parts.select("chrnum", F.col("bucket").cast("int").alias("bucket"), piece.alias("p"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["s"]), "")
    return parts.groupBy("chrnum", "bucket").agg(joined.alias("bases"))


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """place, line: the lines of one text file, with numbers that grow along it."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))


def write_by_chromosome(rows: DataFrame, path: str, order: str = "pos") -> None:
    """Parquet, a folder per chromosome, in order of position inside files, so that row groups can be skipped."""
    rows.repartition("chrnum", F.floor(F.col(order) / 10_000_000)).sortWithinPartitions("chrnum", order).write.partitionBy("chrnum").parquet(path)


def read_region(spark: SparkSession, path: str, chrnum: int, beg: int | None = None, end: int | None = None, order: str = "pos") -> DataFrame:
    """Rows of one chromosome, of positions [beg, end) if given, from what ``write_by_chromosome`` wrote: other folders aren't listed, other row groups aren't read."""
    rows = spark.read.parquet(path).where(F.col("chrnum") == chrnum)
    rows = rows if beg is None else rows.where(F.col(order) >= beg)
    return rows if end is None else rows.where(F.col(order) < end)


def write_parts(rows: DataFrame, part: Column, name: str) -> str:
    """``rows`` as one Parquet folder with a subfolder per ``part`` (a file of a cohort); the path."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.withColumn("file_id", part).write.partitionBy("file_id").parquet(path)
    return path


def merged(spark: SparkSession, *paths: str) -> DataFrame:
    """The rows of several cohorts' tables, by name of column, in one scan of all their files."""
    frames = [spark.read.parquet(p) for p in paths]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def cohort_counts(rows: DataFrame) -> DataFrame:
    """chrnum, samples, least, most, same: how many variants each sample has per chromosome; a cohort's samples must agree."""
    each = rows.groupBy("sample_id", "chrnum").agg(F.count_distinct("sv_id").alias("n"))
    return each.groupBy("chrnum").agg(F.count("*").alias("samples"), F.min("n").alias("least"), F.max("n").alias("most"), (F.min("n") == F.max("n")).alias("same"))


def checked_cohort(rows: DataFrame) -> DataFrame:
    """``rows``, after a check that all samples have as many variants on each chromosome."""
    bad = cohort_counts(rows).where("not same").orderBy("chrnum").limit(5).collect()
    if bad:
        raise ValueError("samples differ in their number of variants: " + ", ".join(f"chromosome {r.chrnum}: {r.least} to {r.most}" for r in bad))
    return rows
