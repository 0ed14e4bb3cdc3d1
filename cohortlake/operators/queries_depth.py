"""Queries and SQL of depth and GC operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import surrogates as S
from ..functions import scalars as X
from . import depth as D

QUERIES: dict = {}
SQL: dict[str, str] = {}
HOUR = 3600


def query(name: str, sql: str):
    SQL[name] = sql
    return lambda f: QUERIES.setdefault(name, f)


@query(
    "variant_depth",
    S.with_views("sv", "depth_pos")
    + """SELECT sv_id, sample_id, count(*) AS n, CAST(least(65535, round(32 * (sum(depth)::DOUBLE / 100 / count(*)))) AS INTEGER) AS dp32
FROM sv JOIN depth_pos p ON sv.chrnum = p.chrnum AND p.pos >= sv.pos AND p.pos < sv."end" GROUP BY sv_id, sample_id""",
)
def _(spark, d):
    return D.variant_depth(S.sv(spark, d), S.depth_pos(spark, d))


@query(
    "position_depth",
    S.with_views("bed", extra="""s AS (SELECT chrnum, at AS beg, sum(d) AS d FROM (SELECT chrnum, beg AS at, 1 AS d FROM bed UNION ALL SELECT chrnum, "end", -1 FROM bed) GROUP BY ALL),
r AS (SELECT chrnum, beg, lead(beg) OVER w AS "end", CAST(sum(d) OVER w AS BIGINT) AS depth FROM s WINDOW w AS (PARTITION BY chrnum ORDER BY beg))""").replace(" AS at", " AS x").replace(", at AS beg", ", x AS beg")
    + 'SELECT * FROM r WHERE depth > 0 AND "end" IS NOT NULL',
)
def _(spark, d):
    return D.position_depth(S.bed(spark, d).select("chrnum", "beg", "end"))


@query("depth_stats", S.with_views("depth_pos") + "SELECT sample_id, round(avg(depth), 6) AS avg_dp, round(stddev_pop(depth), 6) AS sd_dp FROM depth_pos GROUP BY sample_id")
def _(spark, d):
    return S.depth_pos(spark, d).groupBy("sample_id").agg(F.round(F.avg("depth"), 6).alias("avg_dp"), F.round(F.stddev_pop("depth"), 6).alias("sd_dp"))


_WIN = """g AS (SELECT sample_id, chrnum, pos // 3600 AS bucket, CAST(least(65535, round(32 * (sum(depth)::DOUBLE / 100 / count(*)))) AS INTEGER) AS dp32 FROM depth_pos GROUP BY ALL),
l AS (SELECT chrnum, max(pos // 3600) AS last FROM depth_pos GROUP BY chrnum),
k AS (SELECT sample_id, chrnum, unnest(range(0, last + 1)) AS bucket FROM (SELECT DISTINCT sample_id, chrnum FROM depth_pos) JOIN l USING (chrnum)),
win AS (SELECT sample_id, chrnum, CAST(bucket AS INTEGER) AS bucket, coalesce(dp32, 0) AS dp32 FROM k LEFT JOIN g USING (sample_id, chrnum, bucket))"""


def _windows(spark, d):
    return D.depth_windows(S.depth_pos(spark, d), HOUR)


@query("depth_windows", S.with_views("depth_pos", extra=_WIN) + "SELECT * FROM win")
def _(spark, d):
    return _windows(spark, d)


@query("sample_mean_depth", S.with_views("depth_pos", extra=_WIN) + "SELECT sample_id, round(avg(dp32) / 32, 6) AS mean_depth FROM win GROUP BY sample_id")
def _(spark, d):
    return _windows(spark, d).groupBy("sample_id").agg(F.round(F.avg("dp32") / 32, 6).alias("mean_depth"))


@query("depth_matrix", S.with_views("depth_pos", extra=_WIN) + "SELECT chrnum, bucket, string_agg(CAST(dp32 AS VARCHAR), ',' ORDER BY sample_id) AS depths FROM win GROUP BY ALL")
def _(spark, d):
    rows = _windows(spark, d).groupBy("chrnum", "bucket").agg(F.sort_array(F.collect_list(F.struct("sample_id", "dp32"))).alias("a"))
    return rows.select("chrnum", "bucket", F.array_join(F.transform("a", lambda x: x["dp32"].cast("string")), ",").alias("depths"))


@query(
    "median_filter",
    S.with_views("depth_pos", extra=_WIN + """,
f AS (SELECT *, CASE WHEN count(*) OVER w = 5 THEN list_sort(list(dp32) OVER w)[3] END AS m, max(bucket) OVER (PARTITION BY sample_id, chrnum) AS last FROM win WINDOW w AS (PARTITION BY sample_id, chrnum ORDER BY bucket ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))""")
    + """SELECT sample_id, chrnum, bucket, CASE WHEN bucket < 2 THEN max(CASE WHEN bucket = 2 THEN m END) OVER p WHEN bucket > last - 2 THEN max(CASE WHEN bucket = last - 2 THEN m END) OVER p ELSE m END AS dp32
FROM f WINDOW p AS (PARTITION BY sample_id, chrnum)""",
)
def _(spark, d):
    return D.median_filter(_windows(spark, d))


_PROFILE = """raw AS (SELECT chrnum, bucket, CASE WHEN gc + a > length(bases) // 2 THEN gc / (gc + a) END AS g
  FROM (SELECT *, length(regexp_replace(bases, '[^GC]', '', 'g')) AS gc, length(regexp_replace(bases, '[^AT]', '', 'g')) AS a FROM genome)),
sm AS (SELECT chrnum, bucket, CAST(coalesce(round(100 * avg(g) OVER (PARTITION BY chrnum ORDER BY bucket ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)), 255) AS INTEGER) AS s, max(bucket) OVER (PARTITION BY chrnum) AS last FROM raw),
profile AS (SELECT chrnum, bucket, last, CASE WHEN bucket < 2 THEN max(CASE WHEN bucket = least(2, last) THEN s END) OVER p
  WHEN bucket > last - 2 THEN max(CASE WHEN bucket = greatest(0, last - 2) THEN s END) OVER p ELSE s END AS bin FROM sm WINDOW p AS (PARTITION BY chrnum))"""


@query("gc_profile", S.with_views("genome", extra=_PROFILE) + "SELECT chrnum, bucket, bin FROM profile")
def _(spark, d):
    return D.gc_profile(S.genome(spark, d))


@query("gc_fraction", S.with_views("genome", extra=_PROFILE) + "SELECT least(bin, 99) AS bin, round(count(*) / sum(count(*)) OVER (), 6) AS fraction FROM profile WHERE bucket >= 2 AND bucket <= last - 2 AND bin <> 255 GROUP BY 1")
def _(spark, d):
    return D.gc_fraction(D.gc_profile(S.genome(spark, d))).withColumn("fraction", F.round("fraction", 6))


# the depth view, dealt over the documents that make the genome view, so that its buckets of 100 meet the GC profile
_POINTS = "pt AS (SELECT sample_id, CAST((CAST(round(pos / 60.0) AS BIGINT) + depth) % 100 + 1 AS INTEGER) AS chrnum, CAST(pos % 1500 AS INTEGER) AS pos, depth FROM depth_pos)"
_GC_DEPTH = _PROFILE + ",\n" + _POINTS + """,
pb AS (SELECT pt.*, CASE WHEN bin <= 100 THEN bin END AS bin FROM pt LEFT JOIN profile p ON p.chrnum = pt.chrnum AND p.bucket = pt.pos // 100),
gd AS (SELECT sample_id, bin, CAST(sum(depth) AS BIGINT) AS dp_sum, count(*) AS dp_cnt FROM pb WHERE bin IS NOT NULL GROUP BY ALL)"""


def _points(spark, d):
    p = S.depth_pos(spark, d)
    chrom = ((F.round(F.col("pos") / 60.0).cast("long") + F.col("depth")) % 100 + 1).cast("int")
    return p.select("sample_id", chrom.alias("chrnum"), (F.col("pos") % 1500).cast("int").alias("pos"), "depth")


def _binned(spark, d):
    from ..plans.pileup import with_bins

    rows = _points(spark, d).withColumn("bucket", D.bucket_of(F.col("pos"), 100))
    return with_bins(rows, D.gc_profile(S.genome(spark, d)))


def _gc_depth(spark, d):
    from ..plans.pileup import with_bins

    sums = _points(spark, d).groupBy("sample_id", "chrnum", D.bucket_of(F.col("pos"), 100).alias("bucket")).agg(F.sum("depth").alias("total"), F.count("*").alias("n"))
    rows = with_bins(sums, D.gc_profile(S.genome(spark, d))).where("bin is not null")
    return rows.groupBy("sample_id", "bin").agg(F.sum("total").alias("dp_sum"), F.sum("n").alias("dp_cnt"))


@query("gc_depth", S.with_views("depth_pos", "genome", extra=_GC_DEPTH) + "SELECT * FROM gd")
def _(spark, d):
    return _gc_depth(spark, d)


_near = lambda c: " + ".join(f"{v} * coalesce({f}, 0)" for f, v in ((f"lag({c}, 2) OVER w", 0.25), (f"lag({c}) OVER w", 0.5), (c, 1), (f"lead({c}) OVER w", 0.5), (f"lead({c}, 2) OVER w", 0.25)))
_FACTOR = _GC_DEPTH + f""", kn AS (SELECT sample_id, bin, ({_near("dp_sum")})::DOUBLE AS s, ({_near("dp_cnt")})::DOUBLE AS n FROM gd WINDOW w AS (PARTITION BY sample_id ORDER BY bin)),
av AS (SELECT sample_id, avg(depth) AS avg_dp FROM depth_pos GROUP BY sample_id),
factor AS (SELECT sample_id, bin, coalesce(CASE WHEN n > 20 AND s > 0 THEN avg_dp / (s / n) END, 0) AS factor FROM kn JOIN av USING (sample_id))"""


def _factors(spark, d):
    averages = S.depth_pos(spark, d).groupBy("sample_id").agg(F.avg("depth").alias("avg_dp"))
    return D.gc_curve(_gc_depth(spark, d), averages, 20.0)


@query("gc_factor", S.with_views("depth_pos", "genome", extra=_FACTOR) + "SELECT sample_id, bin, round(factor, 6) AS factor FROM factor")
def _(spark, d):
    return _factors(spark, d).withColumn("factor", F.round("factor", 6))


@query(
    "gc_correct",
    S.with_views("depth_pos", "genome", extra=_FACTOR) + """SELECT sample_id, chrnum, pos, round(CASE WHEN bin < 99 AND factor > 0.1 THEN depth * factor ELSE depth END, 4) AS corrected FROM pb LEFT JOIN factor USING (sample_id, bin)""",
)
def _(spark, d):
    both = _binned(spark, d).join(_factors(spark, d), ["sample_id", "bin"], "left")
    corrected = D.gc_corrected(F.col("depth"), F.coalesce("bin", F.lit(255)), F.coalesce("factor", F.lit(0.0)))
    return both.select("sample_id", "chrnum", "pos", F.round(corrected, 4).alias("corrected"))


@query("normalize_depth", S.with_views("depth_pos", extra=_WIN) + "SELECT sample_id, chrnum, bucket, round(dp32 / m, 6) AS depth FROM win JOIN (SELECT sample_id, avg(dp32) AS m FROM win GROUP BY sample_id) USING (sample_id)")
def _(spark, d):
    w = _windows(spark, d)
    m = w.groupBy("sample_id").agg(F.avg("dp32").alias("m"))
    return w.join(m, "sample_id").select("sample_id", "chrnum", "bucket", F.round(F.col("dp32") / F.col("m"), 6).alias("depth"))


@query(
    "depth_gate",
    S.with_views("sv", "depth_pos", extra="""v AS (SELECT sv_id, sample_id, avg(depth) / 100 AS m FROM sv JOIN depth_pos p ON sv.chrnum = p.chrnum AND p.pos >= sv.pos AND p.pos < sv."end" GROUP BY ALL)""")
    + "SELECT sv_id FROM v GROUP BY sv_id HAVING avg(least(65535, round(32 * m)) / 32) < 150",
)
def _(spark, d):
    v = D.variant_depth(S.sv(spark, d), S.depth_pos(spark, d))
    return v.groupBy("sv_id").agg(F.avg(F.col("dp32") / 32).alias("m")).where("m < 150").select("sv_id")


_FLANKS = """b AS (SELECT sv_id, chrnum, svtype, pos, "end", pos // 3600 AS lo, "end" // 3600 AS hi FROM sv),
f AS (SELECT sv_id, sample_id, avg(dp32 / 32) FILTER (bucket < lo) AS a, avg(dp32 / 32) FILTER (bucket > hi) AS z, count(*) FILTER (bucket < lo) AS na, count(*) FILTER (bucket > hi) AS nz
  FROM b JOIN win USING (chrnum) WHERE bucket BETWEEN lo - 15 AND lo - 1 OR bucket BETWEEN hi + 1 AND hi + 15 GROUP BY ALL)"""
_FLANKED = "SELECT sv_id, sample_id, round(CASE WHEN na > 2 THEN a ELSE z END, 6) AS pre, round(CASE WHEN nz > 2 THEN z ELSE a END, 6) AS post FROM f WHERE na > 2 OR nz > 2"


@query("flank_depth", S.with_views("sv", "depth_pos", extra=_WIN + ",\n" + _FLANKS) + _FLANKED)
def _(spark, d):
    return D.flanks(S.sv(spark, d), _windows(spark, d), HOUR).withColumns({c: F.round(c, 6) for c in ("pre", "post")})


@query(
    "prepost_stats",
    S.with_views("sv", "depth_pos", extra=_WIN + ",\n" + _FLANKS + f", ff AS ({_FLANKED})")
    + """SELECT sv_id, round(avg(pre) + 0.00013, 3) AS pre_mean, round(stddev_pop(pre) + 0.00013, 3) AS pre_sd, round(avg(post) + 0.00013, 3) AS post_mean, round(stddev_pop(post) + 0.00013, 3) AS post_sd,
  avg(pre) > 100 AND avg(pre) < 900 AND stddev_pop(pre) < 200 AS pre_ok FROM ff GROUP BY sv_id""",
)
def _(spark, d):
    f = D.flanks(S.sv(spark, d), _windows(spark, d), HOUR).withColumns({c: F.round(c, 6) for c in ("pre", "post")})
    ok = (F.avg("pre") > 100) & (F.avg("pre") < 900) & (F.stddev_pop("pre") < 200)
    return f.groupBy("sv_id").agg(*[F.round(g(c) + 0.00013, 3).alias(f"{c}_{n}") for c in ("pre", "post") for g, n in ((F.avg, "mean"), (F.stddev_pop, "sd"))], ok.alias("pre_ok"))


# windows of ten minutes and longer variants, so that both kinds of inside buckets occur; means of thirty-seconds may end on a half, hence the 1e-8 before rounding
_WIN600 = _WIN.replace("3600", "600")
_SPANS = """b AS (SELECT sv_id, chrnum, pos, "end", lo + 1 AS lo, hi - lo - 1 AS n, CASE WHEN hi - lo - 1 > 10 THEN 2 ELSE 0 END AS t FROM (SELECT sv_id, chrnum, svtype, pos, "end" + 110000 AS "end", pos // 600 AS lo, ("end" + 110000) // 600 AS hi FROM sv) WHERE svtype <> 'INV' AND hi - lo - 1 >= 2),
seg AS (SELECT sv_id, chrnum, n, lo + t AS a, lo + n // 2 - 1 AS z, 1 AS s FROM b WHERE n <= 200 UNION ALL SELECT sv_id, chrnum, n, lo + n // 2, lo + n - 1 - t, 2 FROM b WHERE n <= 200
  UNION ALL SELECT sv_id, chrnum, n, CAST(floor((pos + ("end" - pos) / 8) / 600) AS INTEGER), CAST(floor((pos + ("end" - pos) / 8) / 600) AS INTEGER) + 49, 1 FROM b WHERE n > 200
  UNION ALL SELECT sv_id, chrnum, n, CAST(floor((pos + ("end" - pos) * 0.625) / 600) AS INTEGER), CAST(floor((pos + ("end" - pos) * 0.625) / 600) AS INTEGER) + 49, 2 FROM b WHERE n > 200),
s AS (SELECT sv_id, sample_id, n, dp32 / 32 AS x, s FROM seg JOIN win ON win.chrnum = seg.chrnum AND bucket BETWEEN a AND z)"""


@query("segment_depth", S.with_views("sv", "depth_pos", extra=_WIN600 + ",\n" + _SPANS) + "SELECT sv_id, sample_id, CAST(n AS INTEGER) AS n, round(avg(x) + 1e-8, 6) AS whole, round(avg(x) FILTER (s = 1) + 1e-8, 6) AS first, round(avg(x) FILTER (s = 2) + 1e-8, 6) AS second FROM s GROUP BY ALL")
def _(spark, d):
    sv = S.sv(spark, d).withColumn("end", F.col("end") + 110_000)
    return D.segments(sv, D.depth_windows(S.depth_pos(spark, d), 600), 600).withColumns({c: F.round(F.col(c) + 1e-8, 6) for c in ("whole", "first", "second")})


_SVGC = """g AS (SELECT s.sv_id, avg(bin / 100.0::DOUBLE + 0.005) AS gc FROM small s JOIN profile p ON p.chrnum = s.chrnum AND bin <> 255 AND p.bucket BETWEEN greatest(0, CAST(round(pos / 100.0::DOUBLE) AS INTEGER) - 1) AND CAST(round("end" / 100.0::DOUBLE) AS INTEGER) - 1 GROUP BY s.sv_id)"""
_SMALL = 'small AS (SELECT sv_id, chrnum, svtype, CAST(pos % 3000 + 1 AS INTEGER) AS pos, CAST(pos % 3000 + 12 + ("end" - pos) % 2000 AS INTEGER) AS "end" FROM sv)'


def small(spark, d):
    p = F.col("pos") % 3000 + 1
    return S.sv(spark, d).select("sv_id", "chrnum", "svtype", p.alias("pos"), (p + 11 + (F.col("end") - F.col("pos")) % 2000).alias("end"))


@query("sv_gc_content", S.with_views("sv", "genome", extra=_PROFILE + ",\n" + _SMALL + ",\n" + _SVGC) + "SELECT sv_id, round(coalesce(gc, 0), 6) AS gc FROM small LEFT JOIN g USING (sv_id)")
def _(spark, d):
    return D.sv_gc_content(small(spark, d), D.gc_profile(S.genome(spark, d))).withColumn("gc", F.round("gc", 6))


@query("sv_eligible", S.with_views("sv", "genome", extra=_PROFILE + ",\n" + _SMALL + ",\n" + _SVGC) + "SELECT sv_id, svtype FROM small JOIN g USING (sv_id) WHERE chrnum <= 22 AND gc > 0.2 AND gc < 0.75 AND svtype IN ('DEL','DUP','CNV','INV')")
def _(spark, d):
    from ..plans import calling

    sv = small(spark, d)
    return calling.eligible(sv, D.sv_gc_content(sv, D.gc_profile(S.genome(spark, d)))).select("sv_id", "svtype")


@query("merge_samples", S.with_views("depth_pos") + "SELECT sample_id % 5 AS file_id, sample_id, chrnum, count(*) AS n, CAST(sum(depth) AS BIGINT) AS total FROM depth_pos GROUP BY ALL")
def _(spark, d):
    from ..sources import tables

    return tables.merged(spark, tables.write_parts(S.depth_pos(spark, d), F.col("sample_id") % 5, "depth")).groupBy("file_id", "sample_id", "chrnum").agg(F.count("*").alias("n"), F.sum("depth").alias("total"))


@query("merge_var_depth", S.with_views("sv", "depth_pos") + """SELECT sv_id, string_agg(CAST(sample_id AS VARCHAR) || ':' || CAST(dp AS VARCHAR), ',' ORDER BY sample_id) AS depths
FROM (SELECT sv_id, sample_id, CAST(least(65535, round(32 * (sum(depth)::DOUBLE / 100 / count(*)))) AS INTEGER) AS dp FROM sv JOIN depth_pos p ON sv.chrnum = 1 AND p.chrnum = 1 AND p.pos >= sv.pos AND p.pos < sv."end" GROUP BY ALL) GROUP BY sv_id""")
def _(spark, d):
    one = F.col("chrnum") == 1
    v = D.variant_depth(S.sv(spark, d).where(one), S.depth_pos(spark, d).where(one))
    rows = v.groupBy("sv_id").agg(F.sort_array(F.collect_list(F.struct("sample_id", "dp32"))).alias("a"))
    return rows.select("sv_id", F.array_join(F.transform("a", lambda x: F.concat(x["sample_id"].cast("string"), F.lit(":"), x["dp32"].cast("string"))), ",").alias("depths"))


# a file of a cohort holds each sample's variants by chromosome; one sample of the view lacks a part of chromosome 2
_FILES = "cf AS (SELECT sample_id, chrnum, count(*) AS n_var FROM (SELECT DISTINCT sample_id, chrnum, pos // 100000 AS v FROM depth_pos WHERE NOT (sample_id = 3 AND chrnum = 2 AND pos < 500000)) GROUP BY ALL)"


@query("cohort_check", S.with_views("depth_pos", extra=_FILES) + "SELECT chrnum, count(*) AS samples, min(n_var) AS least, max(n_var) AS most, min(n_var) = max(n_var) AS same FROM cf GROUP BY chrnum")
def _(spark, d):
    from ..sources import tables

    rows = S.depth_pos(spark, d).where("not (sample_id = 3 and chrnum = 2 and pos < 500000)")
    return tables.cohort_counts(rows.select("sample_id", "chrnum", F.floor(F.col("pos") / 100_000).alias("sv_id")))


# the reads view's alignments of four samples; a deletion follows its first forty bases
_PILE = """a AS (SELECT read_id % 4 AS sample_id, chrnum, pos, pos + 40 AS gap, coalesce(try_cast(regexp_extract(cigar, '([0-9]+)D', 1) AS INTEGER), 0) AS deleted,
  list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1), lambda x: CAST(x AS INTEGER))) AS len FROM reads WHERE (flag & 1796) = 0 AND mapq >= 1),
e AS (SELECT sample_id, chrnum, gap, deleted, unnest(range(CAST(pos AS BIGINT), CAST(pos + len AS BIGINT))) AS x FROM a),
q AS (SELECT sample_id, chrnum, x, count(*) FILTER (x < gap OR x >= gap + deleted) AS depth FROM e GROUP BY ALL)"""


def _coverage(spark, d):
    from ..plans.pileup import coverage

    # bins of a few windows, so that runs are carried over many of them
    return coverage(S.reads(spark, d).withColumn("sample_id", F.col("read_id") % 4), bins=1 << 15)


@query(
    "pileup_windows",
    S.with_views("reads", extra=_PILE) + """SELECT sample_id, chrnum, CAST(x // 100 AS INTEGER) AS bucket, count(*) AS n, CAST(sum(depth) AS BIGINT) AS total,
  CAST(least(65535, round(32 * (sum(depth)::DOUBLE / count(*)))) AS INTEGER) AS dp32 FROM q GROUP BY ALL""",
)
def _(spark, d):
    from ..plans.pileup import depth_of_windows

    sums = _coverage(spark, d)
    return sums.select("n", "total", *depth_of_windows(sums).columns[:3], X.fixed_depth(F.col("total") / F.col("n")).alias("dp32"))


@query("pileup_stats", S.with_views("reads", extra=_PILE) + "SELECT sample_id, round(avg(depth), 6) AS avg_dp, round(stddev_pop(depth), 6) AS std_dp FROM q GROUP BY sample_id")
def _(spark, d):
    from ..plans.pileup import depth_statistics

    return depth_statistics(_coverage(spark, d)).withColumns({c: F.round(c, 6) for c in ("avg_dp", "std_dp")})
