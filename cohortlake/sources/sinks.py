"""Text files in global order: many part files, whose names follow the order of their rows, under one commit.

Rows are dealt into ranges of the order columns and sorted inside each, so no task sees the
file whole; header lines are rows that come before all others. Spark's committer moves the
parts into place together and leaves a _SUCCESS file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import chrom_name, chrom_number, type_code, type_name
from . import sam, vcf


def write_ordered(rows: DataFrame, order: Sequence[str], line: Column, path: str, header: Sequence[str] = (), mode: str = "error", compression: str = "none") -> None:
    """``line`` of each row, by ``order``, after the ``header`` lines. An empty table gives the header alone."""
    spark = rows.sparkSession
    names = [f"_order{i}" for i in range(len(order))]
    body = rows.select(F.lit(1).alias("_part"), F.lit(0).alias("_at"), *[F.col(c).alias(n) for c, n in zip(order, names, strict=True)], line.cast("string").alias("value"))
    body = body.where(F.col("value").isNotNull())
    if header:
        head = spark.createDataFrame(list(enumerate(header)), "_at int, value string").withColumn("_part", F.lit(0))
        body = body.unionByName(head, allowMissingColumns=True)
    keys = ["_part", "_at", *names]
    body.repartitionByRange(*keys).sortWithinPartitions(*keys).select("value").write.mode(mode).option("compression", compression).text(path)


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """file, place, line: lines with numbers that grow inside their file; files in order of name."""
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))


def interval_line() -> Column:
    """chromosome, start, end, type, id: one candidate as text."""
    code = type_name(type_code(F.col("svtype")))
    return F.concat_ws("\t", chrom_name(F.col("chrnum")), F.col("pos").cast("string"), F.col("end").cast("string"), code, F.col("sv_id").cast("string"))


def write_intervals(sv: DataFrame, path: str, mode: str = "error") -> None:
    """Candidates in order of chromosome, start and end."""
    write_ordered(sv, ("chrnum", "pos", "end", "svtype", "sv_id"), interval_line(), path, mode=mode)


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """chrnum, pos, end, svtype, sv_id from what ``write_intervals`` wrote."""
    f = F.split("value", "\t")
    at = lambda i, kind: F.get(f, F.lit(i)).try_cast(kind)
    rows = spark.read.text(path).where(F.size(f) == 5)
    return rows.select(chrom_number(F.get(f, F.lit(0))).alias("chrnum"), at(1, "int").alias("pos"), at(2, "int").alias("end"), F.get(f, F.lit(3)).alias("svtype"), at(4, "long").alias("sv_id"))


def write_candidates(sv: DataFrame, path: str, mode: str = "error") -> None:
    """A VCF without samples: candidates in order, below the least header."""
    head = ["##fileformat=VCFv4.1", "\t".join(("#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"))]
    write_ordered(vcf.with_line(sv), ("chrnum", "pos", "end", "sv_id"), F.col("line"), path, head, mode)


def write_genotypes(records: DataFrame, samples: Sequence[str], path: str, lengths: dict | None = None, exclude: frozenset = frozenset(), mode: str = "error") -> None:
    """The VCF of a genotyped cohort from ``records`` (chrnum, pos, sv_id, line); ``samples`` in the order of the lines' cells."""
    write_ordered(records, ("chrnum", "pos", "sv_id"), F.col("line"), path, vcf.header(list(samples), lengths, exclude).split("\n"), mode)


def write_alignments(reads: DataFrame, path: str, chromosomes: Sequence[int], mode: str = "error") -> None:
    """SAM text in order of coordinates, below a header that says so."""
    write_ordered(sam.with_line(reads), ("chrnum", "pos", "read_id", "part"), F.col("line"), path, sam.header(list(chromosomes)), mode)
