"""Tables partitioned by chromosome and bin, and queries by a list of regions that read the bins they need.

A row lies in the smallest bin that holds it whole, on one of a few levels of widths, so it
is written once whatever its length. A region names all bins that it touches, on all levels;
the list of regions, so spread out, meets the table on its partition columns. While that
list is small enough for Spark to broadcast it, its bins prune the folders that are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import MAX_COORDINATE
from ..store import stored

LEVELS = (1 << 20, 1 << 23, 1 << 26, MAX_COORDINATE)


def _firsts(levels: tuple[int, ...]) -> list[int]:
    """The number of each level's first bin."""
    out, n = [], 0
    for width in reversed(levels):
        out.append(n)
        n += -(-MAX_COORDINATE // width)
    return out[::-1]


def bin_number(beg: Column, end: Column, levels: tuple[int, ...] = LEVELS) -> Column:
    """The smallest bin that holds [beg, end) whole; places below 0 count as 0, beyond the greatest coordinate as that."""
    lo = F.least(F.greatest(beg, F.lit(0)), F.lit(MAX_COORDINATE - 1))
    hi = F.least(F.greatest(end - 1, lo), F.lit(MAX_COORDINATE - 1))
    fits = [F.when(F.floor(lo / w) == F.floor(hi / w), F.floor(lo / w) + f) for w, f in zip(levels, _firsts(levels), strict=True)]
    return F.coalesce(*fits, F.lit(0)).cast("int")


def bin_numbers(beg: Column, end: Column, levels: tuple[int, ...] = LEVELS) -> Column:
    """All bins, on all levels, that touch [beg, end)."""
    lo = F.least(F.greatest(beg, F.lit(0)), F.lit(MAX_COORDINATE - 1))
    hi = F.least(F.greatest(end - 1, lo), F.lit(MAX_COORDINATE - 1))
    return F.array_distinct(F.concat(*[F.sequence((F.floor(lo / w) + f).cast("int"), (F.floor(hi / w) + f).cast("int")) for w, f in zip(levels, _firsts(levels), strict=True)], F.array(F.lit(0))))


def write(rows: DataFrame, path: str, beg: str = "pos", end: str | None = None, levels: tuple[int, ...] = LEVELS, mode: str = "error") -> None:
    """``rows`` (with chrnum) as Parquet by chromosome and bin, in order of ``beg`` inside files.

    Without ``end`` a row is one place. A bin's rows are dealt over sixteen tasks at most, so a hot
    bin isn't one.
    """
    last = F.col(end) if end else F.col(beg) + 1
    part = F.floor(F.col(beg) / max(1, levels[0] // 16))
    out = rows.withColumn("bin", bin_number(F.col(beg), last, levels))
    out.repartition("chrnum", "bin", part).sortWithinPartitions("chrnum", "bin", beg).write.mode(mode).partitionBy("chrnum", "bin").parquet(path)


def query(table: DataFrame, regions: DataFrame, beg: str = "pos", end: str | None = None, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """The rows of ``table`` (read from what ``write`` wrote, with the same levels) that overlap each region, and ``region_id``.

    ``regions`` has region_id, chrnum, beg and end (half-open); a row in two regions comes twice.
    """
    wanted = regions.select("region_id", F.col("chrnum").cast("int").alias("chrnum"), F.col("beg").alias("_beg"), F.col("end").alias("_end"), F.explode(bin_numbers(F.col("beg"), F.col("end"), levels)).alias("bin"))
    # written, so that Spark knows its size and broadcasts it only if small; the comparison says that it is selective
    wanted = stored(wanted, "regions").where("bin >= 0 and _beg < _end")
    last = F.col(end) if end else F.col(beg) + 1
    met = table.join(wanted, ["chrnum", "bin"]).where((F.col(beg) < F.col("_end")) & (last > F.col("_beg")))
    return met.drop("_beg", "_end", "bin")


def evidence_table(pairs: DataFrame | None = None, splits: DataFrame | None = None, clips: DataFrame | None = None, windows: DataFrame | None = None, width: int = 100) -> DataFrame:
    """sample_id, chrnum, beg, end, kind, mate, qual, pairstr, dp32: pairs, split reads, clips and window depths as one long table, to be written and dumped by region."""
    at = [F.col("pos").alias("beg"), (F.col("pos") + 1).alias("end")]
    parts = []
    if pairs is not None:
        parts.append(pairs.select("sample_id", "chrnum", *at, F.lit("pair").alias("kind"), "mate", "qual", "pairstr"))
    if splits is not None:
        parts.append(splits.select("sample_id", "chrnum", *at, F.lit("split").alias("kind"), "mate", "pairstr"))
    if clips is not None:
        parts.append(clips.select("sample_id", "chrnum", *at, "kind"))
    if windows is not None:
        parts.append(windows.select("sample_id", "chrnum", (F.col("bucket") * width).alias("beg"), ((F.col("bucket") + 1) * width).alias("end"), F.lit("depth").alias("kind"), "dp32"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    columns = {"mate": "int", "qual": "int", "pairstr": "int", "dp32": "int"}
    return out.select("sample_id", "chrnum", "beg", "end", "kind", *[(F.col(c) if c in out.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])
