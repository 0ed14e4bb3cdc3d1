"""Interval joins on bins, islands, merge chains and best overlap.

A range join is made an equality join: both sides list the bins of ``width`` that
their intervals touch, and a pair is kept in the first bin that both have, so no pair
comes twice and none needs a distinct. Chromosome and bin together are the key, so a
chromosome that holds a third of all rows is many keys. Intervals are half-open
[beg, end).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import overlap_ratio
from . import scan

#: GRCh38 centromeres by chromosome 1..22, X, Y (fixed values; both ends belong to it).
CENTROMERES = (
    (1, 121700000, 125100000),
    (2, 91800000, 96000000),
    (3, 87800000, 94000000),
    (4, 48200000, 51800000),
    (5, 46100000, 51400000),
    (6, 58500000, 62600000),
    (7, 58100000, 62100000),
    (8, 43200000, 47200000),
    (9, 42200000, 45500000),
    (10, 38000000, 41600000),
    (11, 51000000, 55800000),
    (12, 33200000, 37800000),
    (13, 16500000, 18900000),
    (14, 16100000, 18200000),
    (15, 17500000, 20500000),
    (16, 35300000, 38400000),
    (17, 22700000, 27400000),
    (18, 15400000, 21500000),
    (19, 24200000, 28100000),
    (20, 25700000, 30400000),
    (21, 10900000, 13000000),
    (22, 13700000, 17400000),
    (23, 58100000, 63800000),
    (24, 10300000, 10600000),
)
WIDTH = 16_384


def _bins(beg: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(beg / width).cast("int"), F.floor(F.greatest(beg, end - 1) / width).cast("int"))


def overlap_join(left: DataFrame, right: DataFrame, key: str = "chrnum", left_on=("beg", "end"), right_on=("beg", "end"), width: int = WIDTH) -> DataFrame:
    """All pairs with the same ``key`` that overlap: columns l and r, structs of the two rows."""

    def side(df: DataFrame, on: tuple[str, str], name: str) -> DataFrame:
        bins = _bins(F.col(on[0]), F.col(on[1]), width)
        whole = F.struct(*[F.col(c) for c in df.columns]).alias(name)
        return df.where(F.col(key).isNotNull() & F.col(on[0]).isNotNull() & F.col(on[1]).isNotNull()).select(F.col(key).alias("_key"), whole, F.explode(bins).alias("_bin"))

    both = side(left, left_on, "l").join(side(right, right_on, "r"), ["_key", "_bin"])
    lb, le, rb, re = F.col(f"l.{left_on[0]}"), F.col(f"l.{left_on[1]}"), F.col(f"r.{right_on[0]}"), F.col(f"r.{right_on[1]}")
    first = F.floor(F.greatest(lb, rb) / width).cast("int")
    return both.where((le > rb) & (re > lb) & (F.col("_bin") == first)).select("l", "r")


def overlap_semi(left: DataFrame, right: DataFrame, keys: list[str], left_on=("beg", "end"), right_on=("beg", "end"), anti: bool = False, width: int = WIDTH) -> DataFrame:
    """Rows of ``left`` (named by ``keys``) that overlap any (or, with ``anti``, no) row of ``right``."""
    hit = overlap_join(left, right, left_on=left_on, right_on=right_on, width=width).select(*[F.col(f"l.{k}").alias(k) for k in keys]).distinct()
    return left.join(hit, keys, "left_anti" if anti else "left_semi")


def in_centromere(chrnum: Column, beg: Column, end: Column | None = None) -> Column:
    """Whether a position, or a closed interval, touches its chromosome's centromere: a literal map, no join."""
    table = F.create_map(*[x for c, a, b in CENTROMERES for x in (F.lit(c), F.struct(F.lit(a).alias("beg"), F.lit(b).alias("end")))])
    at = F.element_at(table, chrnum)
    return F.coalesce((beg <= at["end"]) & ((beg if end is None else end) >= at["beg"]), F.lit(False))


def islands(rows: DataFrame, by: list[str], beg: str = "pos", end: str = "end", order: list[str] = (), gap: int = 0) -> DataFrame:
    """``rows`` with ``island``: a new one starts where an interval begins ``gap`` or more after all earlier ends."""
    run = [beg, end, *order]
    found = scan.elsewhere(scan.binned(rows, beg), by, run, "max", F.col(end), "_before")
    found = found.withColumn("_start", F.coalesce((F.col(beg) >= F.col("_before") + gap).cast("long"), F.lit(1)))
    found = scan.elsewhere(found, by, run, "sum", F.col("_start"), "_earlier")
    return found.withColumn("island", F.col("_earlier") + F.col("_start")).drop("_before", "_start", "_earlier", scan.BIN)


def merge_chains(sv: DataFrame, least: float = 0.8) -> DataFrame:
    """``sv`` with ``chain``: rows of a type and chromosome in order, joined while the overlap ratio with the one before is above ``least``."""
    by, run = ["svtype", "chrnum"], ["pos", "end", "sv_id"]
    found = scan.previous(scan.binned(sv, "pos"), by, run, [], "_last")
    ro = overlap_ratio(F.col("_last.pos"), F.col("_last.end"), F.col("pos"), F.col("end"))
    found = found.withColumn("_start", F.when(F.col("_last").isNull() | (ro <= least), F.lit(1)).otherwise(F.lit(0)).cast("long"))
    found = scan.elsewhere(found, by, run, "sum", F.col("_start"), "_earlier")
    return found.withColumn("chain", F.col("_earlier") + F.col("_start")).drop("_last", "_start", "_earlier", scan.BIN)


def places(sv: DataFrame, by: list[str] = ("chrnum",), order: list[str] = ("pos", "end", "svtype", "sv_id")) -> DataFrame:
    """``sv`` with ``place``: the number of rows before it in order."""
    return scan.elsewhere(scan.binned(sv, order[0]), list(by), list(order), "sum", F.lit(1), "place").drop(scan.BIN)


def merge_candidates(sv: DataFrame, least: float = 0.8) -> DataFrame:
    """One representative per chain of DEL, DUP and INV candidates: of those with most support, the one nearest to the medians of start and end.

    The median of an even number is the truncated mean of the middle two. The first in order wins ties.
    """
    chains = merge_chains(sv.where(F.col("svtype").isin("DEL", "DUP", "INV")), least)
    group = Window.partitionBy("svtype", "chrnum", "chain")
    top = chains.withColumn("_most", F.max("supp").over(group)).where("supp = _most")

    def median(c: str) -> Column:
        a = F.sort_array(F.collect_list(c).over(group))
        n = F.size(a)
        mid = (n / 2).cast("int")
        return F.when(n % 2 == 1, F.get(a, mid)).otherwise(((F.get(a, mid - 1) + F.get(a, mid)) / 2).cast("int"))

    far = F.pow(F.col("pos").cast("long") - F.col("_mp"), 2) + F.pow(F.col("end").cast("long") - F.col("_me"), 2)
    best = Window.partitionBy("svtype", "chrnum", "chain").orderBy("_far", "pos", "end", "sv_id")
    top = top.withColumn("_mp", median("pos")).withColumn("_me", median("end")).withColumn("_far", far)
    return top.withColumn("_k", F.row_number().over(best)).where("_k = 1").select("sv_id", "chrnum", "pos", "end", "svtype", "supp")


def best_overlap(candidates: DataFrame, support: DataFrame, least: float = 0.6) -> DataFrame:
    """Each candidate with the support of its type and chromosome that overlaps it best (ratio above ``least``), or nulls.

    Ties go to the smaller position, then end, then id.
    """
    pairs = overlap_join(candidates, support, left_on=("pos", "end"), right_on=("pos", "end"))
    ro = overlap_ratio(F.col("l.pos"), F.col("l.end"), F.col("r.pos"), F.col("r.end"))
    pairs = pairs.where("l.svtype = r.svtype").select(F.col("l.sv_id").alias("sv_id"), ro.alias("ro"), "r").where(F.col("ro") > least)
    # the smallest struct is the best: a partial aggregate, no window
    key = F.struct((-F.col("ro")).alias("n"), F.col("r.pos").alias("pos"), F.col("r.end").alias("end"), F.col("r.sv_id").alias("id"), F.col("r.supp").alias("supp"))
    best = pairs.groupBy("sv_id").agg(F.min(key).alias("b"))
    return candidates.join(best, "sv_id", "left").select(*candidates.columns, F.col("b.id").alias("best_id"), (-F.col("b.n")).alias("overlap"), F.col("b.supp").alias("best_supp"))


def with_support(candidates: DataFrame, support: DataFrame, least: float = 0.6) -> DataFrame:
    """``candidates`` with the place and count of their best overlapping support: sup_chrnum, sup_pos, sup_end, sup_supp (nulls without).

    Support is of DEL, DUP and INV; CNV candidates take DUP.
    """
    as_kind = F.when(F.col("svtype") == "CNV", "DUP").otherwise(F.col("svtype"))
    best = best_overlap(candidates.withColumn("svtype", as_kind).select("sv_id", "chrnum", "pos", "end", "svtype"), support.where(F.col("svtype").isin("DEL", "DUP", "INV")), least)
    place = support.select(F.col("sv_id").alias("best_id"), *[F.col(c).alias(f"sup_{c}") for c in ("chrnum", "pos", "end", "supp")])
    return candidates.join(best.select("sv_id", "best_id").join(place, "best_id"), "sv_id", "left").drop("best_id")


def regions_overlapping(records: DataFrame, regions: DataFrame) -> DataFrame:
    """The records of each region in turn; a record in two regions comes twice."""
    return overlap_join(records, regions).select("l.*", F.col("r.region_id").alias("region_id"))


def coalesce_ranges(rows: DataFrame, by: list[str], gap: int) -> DataFrame:
    """Ranges merged where one starts at most ``gap`` after all before it end: by, beg, end, n."""
    run = islands(rows, by, "beg", "end", gap=gap + 1)
    return run.groupBy(*by, "island").agg(F.min("beg").alias("beg"), F.max("end").alias("end"), F.count("*").alias("n")).drop("island")
