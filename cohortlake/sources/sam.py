"""SAM text: the supported form of alignments (BAM and CRAM need native libraries)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import chrom_name, chrom_number


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path).withColumnRenamed("value", "line"))


def _tag(fields: Column, name: str) -> Column:
    return F.regexp_extract(F.get(F.filter(F.slice(fields, 12, 1000), lambda t: F.startswith(t, F.lit(f"{name}:"))), F.lit(0)), "^[^:]*:[^:]*:(.*)$", 1)


def parse(lines: DataFrame) -> DataFrame:
    """Alignments from a column ``line``; header lines and those with fewer than 11 fields go. Read names of the form id/part give read_id and part; what isn't a number is null."""
    f = F.split("line", "\t")
    rows = lines.where(F.col("line").isNotNull() & ~F.startswith("line", F.lit("@"))).select(f.alias("f")).where(F.size("f") >= 11)
    at = lambda i: F.get("f", F.lit(i))
    # a filter on a result may run before those above, on header lines too: no cast may fail
    whole = lambda i: at(i).try_cast("int")
    number = lambda c: F.coalesce(c.try_cast("int"), F.lit(0))
    name = F.split(at(0), "/")
    return rows.select(
        F.get(name, F.lit(0)).try_cast("long").alias("read_id"), F.get(name, F.lit(1)).try_cast("int").alias("part"), whole(1).alias("flag"),
        chrom_number(at(2)).alias("chrnum"), whole(3).alias("pos"), whole(4).alias("mapq"), at(5).alias("cigar"),
        F.when(at(6) == "=", chrom_number(at(2))).otherwise(chrom_number(at(6))).alias("mate_chrnum"), whole(7).alias("mate_pos"), whole(8).alias("isize"),
        number(_tag(F.col("f"), "MQ")).alias("mq"), number(_tag(F.col("f"), "NM")).alias("nm"), F.coalesce(_tag(F.col("f"), "SA"), F.lit("")).alias("sa"),
    )


def header(chromosomes: list[int], length: int = 1 << 29) -> list[str]:
    """Header lines of a file in order of coordinates."""
    names = ["X" if c == 23 else "Y" if c == 24 else "M" if c == 25 else str(c) for c in sorted(chromosomes)]
    return ["@HD\tVN:1.6\tSO:coordinate", *[f"@SQ\tSN:chr{n}\tLN:{length}" for n in names]]


def to_lines(reads: DataFrame) -> DataFrame:
    return with_line(reads).select("line")


def with_line(reads: DataFrame) -> DataFrame:
    """``reads`` and as ``line`` their alignment lines."""
    text = lambda c: F.col(c).cast("string")
    mate = F.when(F.col("chrnum") == F.col("mate_chrnum"), "=").otherwise(chrom_name(F.col("mate_chrnum")))
    tags = [F.concat(F.lit("MQ:i:"), text("mq")), F.concat(F.lit("NM:i:"), text("nm")), F.concat(F.lit("SA:Z:"), F.col("sa"))]
    name = F.concat(text("read_id"), F.lit("/"), text("part"))
    return reads.select("*", F.concat_ws("\t", name, text("flag"), chrom_name(F.col("chrnum")), text("pos"), text("mapq"), "cigar", mate, text("mate_pos"), text("isize"), F.lit("*"), F.lit("*"), *tags).alias("line"))
