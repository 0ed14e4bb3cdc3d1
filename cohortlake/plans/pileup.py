"""From reads to everything that genotyping needs of a sample: statistics, depth, GC curve and evidence, as one plan.

Depth is a sweep over the changes at reads' ends and gaps, whose runs are cut at bucket
borders and added up, so rows grow with reads and buckets and never with covered bases.
Evidence is extracted by column rules. All tables have sample_id and chrnum, and ``write``
puts each into a folder per chromosome.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import fixed_depth
from ..operators import depth as D
from ..operators import evidence as E
from ..sources.tables import write_by_chromosome
from ..store import stored

TABLES = ("samples", "windows", "gc_curve", "pairs", "splits", "clips")


def coverage(reads: DataFrame, width: int = 100, most: int = 64_000, bins: int = 1 << 20) -> DataFrame:
    """sample_id, chrnum, bucket, n, total, squares: covered places of each bucket of usable reads, their depths added up, and squared."""
    return D.window_sums(D.coverage_runs(E.usable_reads(reads), most=most, width=bins), width)


def depth_statistics(sums: DataFrame) -> DataFrame:
    """sample_id, avg_dp, std_dp: over covered places, from buckets' sums."""
    n, total, squares = F.sum("n"), F.sum("total"), F.sum("squares")
    mean = total / n
    return sums.groupBy("sample_id").agg(mean.alias("avg_dp"), F.sqrt(F.greatest(F.lit(0.0), squares / n - mean * mean)).alias("std_dp"))


def depth_of_windows(sums: DataFrame) -> DataFrame:
    return sums.select("sample_id", "chrnum", "bucket", fixed_depth(F.col("total") / F.col("n")).alias("dp32"))


def with_bins(windows: DataFrame, profile: DataFrame, bins: int = 100) -> DataFrame:
    """``windows`` with the GC bin (or null) of their bucket, from the profile of the genome."""
    return windows.join(profile.select("chrnum", "bucket", F.least(F.col("bin"), F.lit(255)).alias("bin")), ["chrnum", "bucket"], "left").withColumn("bin", F.when(F.col("bin") <= bins, F.col("bin")))


def gc_corrected_windows(windows: DataFrame, profile: DataFrame, curve: DataFrame) -> DataFrame:
    """sample_id, chrnum, bucket, dp32: bucket to bin to factor; buckets of unknown bin or factor keep their depth."""
    both = with_bins(windows, profile).join(curve, ["sample_id", "bin"], "left")
    corrected = D.gc_corrected(F.col("dp32"), F.coalesce("bin", F.lit(255)), F.coalesce("factor", F.lit(0.0)))
    return both.select("sample_id", "chrnum", "bucket", F.floor(corrected).cast("int").alias("dp32"))


def pileup(reads: DataFrame, profile: DataFrame, width: int = 100, least: float = 100.0) -> dict[str, DataFrame]:
    """Tables by name, from alignments with ``sample_id`` and the genome's GC profile.

    samples: mean and deviation of depth over covered positions and of insert sizes.
    windows: corrected depth of each bucket. gc_curve: factor for each sample and GC bin.
    pairs, splits, clips: evidence; clips at a read's last cycles are left out.
    """
    used = E.usable_reads(reads)
    sums = stored(coverage(reads, width), "coverage")  # three tables are made of it
    sizes = E.insert_sizes(used).groupBy("sample_id").agg(F.avg("isize").alias("avg_isize"), F.stddev_pop("isize").alias("std_isize"))
    samples = depth_statistics(sums).join(sizes, "sample_id", "left")

    by_bin = with_bins(sums, profile).where("bin is not null").groupBy("sample_id", "bin").agg(F.sum("total").alias("dp_sum"), F.sum("n").alias("dp_cnt"))
    curve = D.gc_curve(by_bin, samples.select("sample_id", "avg_dp"), least)
    windows = depth_of_windows(sums)

    who = ("sample_id", "read_id", "part", "chrnum")
    pairs = E.discordant_pairs(used).select(*who, F.col("selfpos").alias("pos"), F.col("matepos").alias("mate"), F.col("matequal").alias("qual"), "pairstr")
    splits = E.split_reads(used).select(*who, "pos", F.col("sa_pos").alias("mate"), "pairstr", "rlen", "sa_rlen", "lclip", "rclip", "sa_lclip", "sa_rclip")
    clips = E.kept_clips(E.soft_clips(used)).select(*who, F.when(F.col("side") == "left", "lclip").otherwise("rclip").alias("kind"), "pos")
    return {"samples": samples, "windows": gc_corrected_windows(windows, profile, curve), "gc_curve": curve, "pairs": pairs, "splits": splits, "clips": clips}


def write(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table under ``folder``; those with positions by chromosome and in order."""
    for name, rows in tables.items():
        if "chrnum" in rows.columns:
            write_by_chromosome(rows, f"{folder}/{name}", "bucket" if name == "windows" else "pos")
        else:
            rows.write.parquet(f"{folder}/{name}")
