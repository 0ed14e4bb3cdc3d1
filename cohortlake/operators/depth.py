"""Depth: per position, per window, GC profile and correction, flanks and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import cigar_length, fixed_depth, gc_content, reference_gaps
from ..store import stored
from . import scan
from .intervals import overlap_join


def bucket_of(pos: Column, width: int) -> Column:
    return F.floor(pos / width).cast("int")


def variant_depth(sv: DataFrame, depth: DataFrame, width: int = 16_384) -> DataFrame:
    """sv_id, sample_id, n, dp32: mean depth over the covered positions in [pos, end).

    Sums up to a position answer each variant as a difference of two, whatever its length.
    """
    keys = ["sample_id", "chrnum"]
    spans = sv.where("end > pos").select(F.col("sv_id").cast("long").alias("sv_id"), "chrnum", "pos", "end").join(depth.select(*keys).distinct(), "chrnum")
    ends = F.explode(F.array(F.struct(F.col("pos").alias("pos"), F.lit(-1).alias("sign")), F.struct(F.col("end").alias("pos"), F.lit(1).alias("sign"))))
    looks = spans.select(*keys, "sv_id", ends.alias("e")).select(*keys, "sv_id", "e.*")
    points = depth.select(*keys, "pos", F.col("depth").alias("total"), F.lit(1).cast("long").alias("n"))
    got = scan.sums_below(points, looks, keys, "pos", ["total", "n"], width)
    signed = lambda c: F.sum(F.col("sign") * F.col(c)).alias(c)
    out = got.groupBy("sv_id", "sample_id").agg(signed("total"), signed("n")).where("n > 0")
    return out.select("sv_id", "sample_id", "n", fixed_depth(F.col("total") / 100 / F.col("n")).alias("dp32"))


def coverage_steps(reads: DataFrame, keys: list[str] = ("sample_id", "chrnum")) -> DataFrame:
    """keys, at, reads, depth: by how much the number of reads, and of those with a base there, changes at a place.

    Two rows a read and two a deletion or skip of it, added up by place: nothing grows with
    the bases that are covered.
    """
    keys, gaps = list(keys), reference_gaps(F.col("cigar"))
    step = lambda at, reads, depth: F.struct(at.alias("at"), F.lit(reads).alias("reads"), F.lit(depth).alias("depth"))
    beg, end = F.col("pos"), F.col("pos") + cigar_length(F.col("cigar"))
    inner = F.flatten(F.transform(gaps, lambda g: F.array(step(beg + g["at"], 0, -1), step(beg + g["at"] + g["n"], 0, 1))))
    steps = reads.where(end > beg).select(*keys, F.explode(F.concat(F.array(step(beg, 1, 1), step(end, -1, -1)), inner)).alias("s"))
    summed = steps.groupBy(*keys, F.col("s.at").alias("at")).agg(F.sum("s.reads").alias("reads"), F.sum("s.depth").alias("depth"))
    return summed.where("reads <> 0 or depth <> 0")


def coverage_runs(reads: DataFrame, keys: list[str] = ("sample_id", "chrnum"), most: int = 64_000, width: int = scan.WIDTH) -> DataFrame:
    """keys, beg, end, depth: runs of equal depth over the places that reads span; deleted and skipped bases count as places without depth.

    A depth beyond ``most`` counts as ``most``.
    """
    keys = list(keys)
    runs = scan.running(coverage_steps(reads, keys), keys, "at", ["reads", "depth"], width)
    return runs.where("reads > 0 and next is not null").select(*keys, F.col("at").alias("beg"), F.col("next").alias("end"), F.least("depth", F.lit(most).cast("long")).alias("depth"))


def window_sums(runs: DataFrame, width: int, keys: list[str] = ("sample_id", "chrnum")) -> DataFrame:
    """keys, bucket, n, total, squares: covered places of each bucket, their depths and squared depths added up. Runs are cut at bucket borders."""
    first, last = F.floor(F.col("beg") / width).cast("int"), F.floor((F.col("end") - 1) / width).cast("int")
    cut = runs.select(*keys, "beg", "end", "depth", F.explode(F.sequence(first, last)).alias("bucket"))
    n = F.least("end", (F.col("bucket") + 1) * width) - F.greatest("beg", F.col("bucket") * width)
    d = F.col("depth")
    return cut.groupBy(*keys, "bucket").agg(F.sum(n).alias("n"), F.sum(n * d).alias("total"), F.sum((n * d).cast("double") * d).alias("squares"))


def position_depth(reads: DataFrame, keys: list[str] = ("chrnum",)) -> DataFrame:
    """Depth runs from alignments [beg, end): a running sum over +1 at starts and -1 at ends: keys, beg, end, depth."""
    keys = list(keys)
    steps = reads.select(*keys, F.explode(F.array(F.struct(F.col("beg").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("s"))
    steps = scan.binned(steps.groupBy(*keys, F.col("s.at").alias("beg")).agg(F.sum("s.d").alias("d")), "beg")
    runs = scan.elsewhere(steps, keys, ["beg"], "sum", F.col("d"), "_sofar")
    runs = scan.elsewhere(runs, keys, ["beg"], "min", F.col("beg"), "end", after=True).withColumn("depth", F.col("_sofar") + F.col("d"))
    return runs.where("depth > 0 and end is not null").select(*keys, "beg", "end", "depth")


def depth_windows(depth: DataFrame, width: int) -> DataFrame:
    """sample_id, chrnum, bucket, dp32: every bucket up to a chromosome's last, empty ones as 0."""
    got = depth.groupBy("sample_id", "chrnum", bucket_of(F.col("pos"), width).alias("bucket")).agg(F.sum("depth").alias("t"), F.count("*").alias("n"))
    got = got.select("sample_id", "chrnum", "bucket", fixed_depth(F.col("t") / 100 / F.col("n")).alias("dp32"))
    last = depth.groupBy("chrnum").agg(F.max(bucket_of(F.col("pos"), width)).alias("last"))
    grid = depth.select("sample_id", "chrnum").distinct().join(last, "chrnum").select("sample_id", "chrnum", F.explode(F.sequence(F.lit(0), "last")).alias("bucket"))
    return grid.join(got, ["sample_id", "chrnum", "bucket"], "left").withColumn("dp32", F.coalesce("dp32", F.lit(0)))


def gc_profile(genome: DataFrame, unknown: int = 255, width: int = 4096) -> DataFrame:
    """chrnum, bucket, bin: mean of the known GC shares of buckets j-2 .. j+1 in percent; the two edge buckets copy their neighbour.

    Windows run over bins of ``width`` buckets with their neighbours' edges copied in. The
    bases are read once, into a written table of numbers, from which one aggregate takes
    what the edge buckets copy: the left one from buckets 0 to 2, the right one from what
    each bucket knows of the one two before it.
    """
    raw = genome.withColumn("_g", gc_content(F.col("bases"))).select("chrnum", "bucket", F.when(F.col("_g") >= 0, F.col("_g")).alias("_g"))
    near = scan.with_halo(raw, "bucket", 4, 1, width)
    order = Window.partitionBy("chrnum", scan.BIN).orderBy("bucket")
    percent = lambda lo, hi: F.coalesce(F.round(F.avg("_g").over(order.rowsBetween(lo, hi)) * 100).cast("int"), F.lit(unknown))
    rows = stored(near.withColumns({"_s": percent(-2, 1), "_two_back": percent(-4, -1)}).where("_own").select("chrnum", "bucket", "_s", "_two_back"), "gc_shares")
    bucket = F.col("bucket")
    first = F.max(F.when(bucket <= 2, F.struct("bucket", "_s")))["_s"]
    ends = rows.groupBy("chrnum").agg(F.max(F.struct("bucket", "_two_back")).alias("_end"), first.alias("_left"), F.max(F.when(bucket == 0, F.col("_s"))).alias("_zero"))
    last = F.col("_end.bucket")
    right = F.when(last < 2, F.col("_zero")).otherwise(F.col("_end._two_back"))
    edge = F.when(bucket < 2, F.col("_left")).when(bucket > last - 2, right).otherwise(F.col("_s"))
    return rows.join(ends, "chrnum").select("chrnum", "bucket", edge.alias("bin"))


def gc_fraction(profile: DataFrame, unknown: int = 255) -> DataFrame:
    """bin, fraction of the known buckets; the two edge buckets of each side don't count. 100 % belongs to bin 99."""
    last = profile.groupBy("chrnum").agg(F.max("bucket").alias("_last"))
    inner = profile.join(last, "chrnum").where((F.col("bucket") >= 2) & (F.col("bucket") <= F.col("_last") - 2) & (F.col("bin") != unknown))
    n = inner.groupBy(F.least("bin", F.lit(99)).alias("bin")).agg(F.count("*").alias("n"))
    return n.select("bin", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("fraction"))  # a hundred rows


def gc_curve(depth_by_bin: DataFrame, averages: DataFrame, least: float = 100.0) -> DataFrame:
    """sample_id, bin, factor: average depth over a kernel-smoothed mean depth (1/4, 1/2, 1, 1/2, 1/4); 0 where the weight is too small."""
    w = Window.partitionBy("sample_id").orderBy("bin")
    weights = ((-2, 0.25), (-1, 0.5), (0, 1.0), (1, 0.5), (2, 0.25))
    near = lambda c: sum(F.coalesce((F.lag(c, -k) if k < 0 else F.lead(c, k)).over(w) if k else F.col(c), F.lit(0)) * v for k, v in weights)
    kernel = depth_by_bin.withColumn("_s", near("dp_sum")).withColumn("_n", near("dp_cnt"))
    curve = F.when(F.col("_n") > least, F.col("_s") / F.col("_n"))
    both = kernel.withColumn("_c", curve).join(averages, "sample_id")
    return both.select("sample_id", "bin", F.coalesce(F.when(F.col("_c") > 0, F.col("avg_dp") / F.col("_c")), F.lit(0.0)).alias("factor"))


def gc_corrected(depth: Column, bin: Column, factor: Column, bins: int = 100) -> Column:
    return F.when((bin < bins - 1) & (factor > 0.1), depth * factor).otherwise(depth)


def median_filter(windows: DataFrame) -> DataFrame:
    """Median of buckets j-2 .. j+2 per sample and chromosome; two cells at each edge copy the nearest one computed."""
    whole = Window.partitionBy("sample_id", "chrnum")
    w = whole.orderBy("bucket")
    five = F.sort_array(F.collect_list("dp32").over(w.rowsBetween(-2, 2)))
    f = windows.withColumn("_m", F.when(F.size(five) == 5, F.get(five, F.lit(2)))).withColumn("_last", F.max("bucket").over(whole))
    first = F.max(F.when(F.col("bucket") == 2, F.col("_m"))).over(whole)
    last = F.max(F.when(F.col("bucket") == F.col("_last") - 2, F.col("_m"))).over(whole)
    return f.select("sample_id", "chrnum", "bucket", F.coalesce(F.when(F.col("bucket") < 2, first).when(F.col("bucket") > F.col("_last") - 2, last).otherwise(F.col("_m")), "dp32").alias("dp32"))


def flank_spans(sv: DataFrame, width: int, reach: int = 15) -> DataFrame:
    """sv_id, chrnum, part (pre, post), lo, hi: the ``reach`` buckets before and after a variant."""
    b, e = bucket_of(F.col("pos"), width), bucket_of(F.col("end"), width)
    span = lambda part, lo, hi: F.struct(F.lit(part).alias("part"), lo.alias("lo"), hi.alias("hi"))
    return sv.select("sv_id", "chrnum", F.explode(F.array(span("pre", b - reach, b - 1), span("post", e + 1, e + reach))).alias("s")).select("sv_id", "chrnum", "s.*")


def segment_spans(sv: DataFrame, width: int) -> DataFrame:
    """sv_id, chrnum, part (first, second), lo, hi, inside: the two parts of a variant's inside buckets.

    Up to 200 of them: halves, without two buckets at each outer edge when there are more
    than 10. Beyond: two runs of 50 from len/8 and 0.625 len. INV has none.
    """
    b, e = bucket_of(F.col("pos"), width), bucket_of(F.col("end"), width)
    rows = sv.where(F.col("svtype") != "INV").withColumn("inside", e - b - 1).where("inside >= 2").withColumn("_b", b + 1)
    n, length = F.col("inside"), F.col("end") - F.col("pos")
    one, two = bucket_of(F.col("pos") + length / 8, width), bucket_of(F.col("pos") + length * 0.625, width)
    trim, half = F.when(n > 10, 2).otherwise(0), F.floor(n / 2).cast("int")
    span = lambda part, lo, hi: F.struct(F.lit(part).alias("part"), lo.alias("lo"), hi.alias("hi"))
    far = F.array(span("first", one, one + 49), span("second", two, two + 49))
    near = F.array(span("first", F.col("_b") + trim, F.col("_b") + half - 1), span("second", F.col("_b") + half, F.col("_b") + n - 1 - trim))
    return rows.select("sv_id", "chrnum", "inside", F.explode(F.when(n > 200, far).otherwise(near)).alias("s")).select("sv_id", "chrnum", "s.*", "inside").where("lo <= hi")


def span_steps(spans: DataFrame, windows: DataFrame, width: int = 4096) -> DataFrame:
    """``spans`` (chrnum, lo, hi and others) for each sample of their chromosome, two rows each, whose total (of dp32) and n add up to those of the buckets lo .. hi.

    Running sums over buckets answer a span by two look-ups, whatever its length.
    """
    keys = ["sample_id", "chrnum"]
    own = [c for c in spans.columns if c not in ("chrnum", "lo", "hi")]
    ends = F.explode(F.array(F.struct(F.col("lo").alias("bucket"), F.lit(-1).alias("sign")), F.struct((F.col("hi") + 1).alias("bucket"), F.lit(1).alias("sign"))))
    looks = spans.join(windows.select(*keys).distinct(), "chrnum").select(*keys, *own, ends.alias("e")).select(*keys, *own, "e.*")
    points = windows.select(*keys, "bucket", F.col("dp32").cast("long").alias("total"), F.lit(1).cast("long").alias("n"))
    got = scan.sums_below(points, looks, keys, "bucket", ["total", "n"], width)
    return got.select("sample_id", *own, *[(F.col("sign") * F.col(c)).alias(c) for c in ("total", "n")])


def part_sum(part: str, column: str) -> Column:
    """The aggregate of ``span_steps``' rows over one part of a variant."""
    return F.coalesce(F.sum(F.when(F.col("part") == part, F.col(column))), F.lit(0))


def flank_means(total_a: Column, n_a: Column, total_b: Column, n_b: Column) -> tuple[Column, Column]:
    """Depth before and after; a flank of two buckets or fewer copies the other, null if both are so short."""
    a, b = F.when(n_a > 2, total_a / 32 / n_a), F.when(n_b > 2, total_b / 32 / n_b)
    return F.coalesce(a, b), F.coalesce(b, a)


def segment_means(total_a: Column, n_a: Column, total_b: Column, n_b: Column) -> tuple[Column, Column, Column]:
    """Depth of both parts together and of each; null without buckets."""
    mean = lambda t, n: F.when(n > 0, t / 32 / n)
    return mean(total_a + total_b, n_a + n_b), mean(total_a, n_a), mean(total_b, n_b)


def _parts(*names: str) -> list[Column]:
    return [part_sum(p, c).alias(f"{p}_{c}") for p in names for c in ("total", "n")]


def _of(*names: str) -> list[Column]:
    return [F.col(f"{p}_{c}") for p in names for c in ("total", "n")]


def flanks(sv: DataFrame, windows: DataFrame, width: int, reach: int = 15, bins: int = 4096) -> DataFrame:
    """sv_id, sample_id, pre, post: mean window depth of ``reach`` buckets before and after."""
    sums = span_steps(flank_spans(sv, width, reach), windows, bins).groupBy("sv_id", "sample_id").agg(*_parts("pre", "post"))
    pre, post = flank_means(*_of("pre", "post"))
    return sums.select("sv_id", "sample_id", pre.alias("pre"), post.alias("post")).where("pre is not null")


def segments(sv: DataFrame, windows: DataFrame, width: int, bins: int = 4096) -> DataFrame:
    """sv_id, sample_id, n, whole, first, second: means of inside buckets and their halves (see ``segment_spans``)."""
    sums = span_steps(segment_spans(sv, width), windows, bins).groupBy("sv_id", "sample_id", "inside").agg(*_parts("first", "second"))
    whole, first, second = segment_means(*_of("first", "second"))
    return sums.select("sv_id", "sample_id", F.col("inside").alias("n"), whole.alias("whole"), first.alias("first"), second.alias("second")).where("whole is not null")


def sv_gc_content(sv: DataFrame, profile: DataFrame, width: int = 100, bins: int = 100, unknown: int = 255) -> DataFrame:
    """sv_id, gc: mean of bin / bins + 0.005 over buckets round(pos/width)-1 .. round(end/width)-1, unknown ones skipped; 0 when none."""
    lo = F.greatest(F.lit(0), F.round(F.col("pos") / width).cast("int") - 1)
    spans = sv.select("sv_id", "chrnum", lo.alias("beg"), (F.round(F.col("end") / width).cast("int")).alias("end"))
    points = profile.where(F.col("bin") != unknown).select("chrnum", F.col("bucket").alias("beg"), (F.col("bucket") + 1).alias("end"), "bin")
    hits = overlap_join(spans, points, width=1024).groupBy(F.col("l.sv_id").alias("sv_id")).agg(F.avg(F.col("r.bin") / bins + 0.005).alias("gc"))
    return sv.select("sv_id").join(hits, "sv_id", "left").select("sv_id", F.coalesce("gc", F.lit(0.0)).alias("gc"))
