"""Queries and SQL of what is written and read back: ordered text, tables by region, cohorts that grow."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import surrogates as S
from ..store import shared_folder
from . import cohort, line_source, regions, sam, sinks, vcf

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Bins small enough for the views, whose places end below a few millions.
LEVELS = (1 << 17, 1 << 20, regions.MAX_COORDINATE)


def query(name: str, sql: str):
    SQL[name] = sql
    return lambda f: QUERIES.setdefault(name, f)


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("interval_sink", S.with_views("sv") + 'SELECT sv_id, chrnum, pos, "end", svtype FROM sv')
def _(spark, d):
    path = _folder(spark, "intervals")
    sinks.write_intervals(S.sv(spark, d), path)
    return sinks.read_intervals(spark, path)


@query("vcf_sink", S.with_views("sv") + 'SELECT sv_id, chrnum, pos, "end", svtype, supp FROM sv')
def _(spark, d):
    path = _folder(spark, "candidates")
    sinks.write_candidates(S.sv(spark, d), path)
    return vcf.read(spark, path).select("sv_id", "chrnum", "pos", "end", "svtype", "supp")


@query("vcf_file_region", S.with_views("sv") + 'SELECT sv_id, chrnum, pos, "end", svtype FROM sv WHERE chrnum = 5 AND pos BETWEEN 200000 AND 800000')
def _(spark, d):
    path = _folder(spark, "candidates")
    sinks.write_candidates(S.sv(spark, d), path)
    line_source.register(spark)
    lines = spark.read.format("genomic_lines").option("path", path).option("kind", "vcf").option("split", 1 << 16).load()
    return vcf.parse(lines.where("chrnum = 5 and pos between 200000 and 800000").select("line")).select("sv_id", "chrnum", "pos", "end", "svtype")


@query("sam_file_scan", S.with_views("reads") + "SELECT read_id, part, flag, chrnum, pos, mapq, cigar, mate_pos, isize, mq, nm, sa FROM reads WHERE chrnum = 3 AND pos >= 100000 AND pos < 700000")
def _(spark, d):
    path = _folder(spark, "alignments")
    sinks.write_alignments(S.reads(spark, d), path, range(1, 25))
    line_source.register(spark)
    lines = spark.read.format("genomic_lines").option("path", path).option("kind", "sam").option("split", 1 << 18).load()
    return sam.parse(lines.where("chrnum = 3 and pos >= 100000 and pos < 700000").select("line")).drop("mate_chrnum")


@query("region_list", S.with_views("sv", "bed") + 'SELECT bed_id AS region_id, sv_id, svtype, sv.chrnum, sv.pos, sv."end" FROM sv JOIN bed ON sv.chrnum = bed.chrnum AND sv.pos < bed."end" AND sv."end" > bed.beg')
def _(spark, d):
    path = _folder(spark, "candidates_by_bin")
    regions.write(S.sv(spark, d).drop("supp"), path, "pos", "end", LEVELS)
    wanted = S.bed(spark, d).withColumnRenamed("bed_id", "region_id")
    return regions.query(spark.read.parquet(path), wanted, "pos", "end", LEVELS)


_DUMP = """t AS (SELECT sample_id, chrnum, pos AS beg, pos + 1 AS "end", kind, CASE WHEN kind IN ('pair', 'split') THEN mate END AS mate, CASE WHEN kind = 'pair' THEN qual END AS qual, CASE WHEN kind IN ('pair', 'split') THEN pairstr END AS pairstr, NULL::INTEGER AS dp32
  FROM evidence WHERE kind <> 'filtered'
  UNION ALL SELECT sample_id, chrnum, bucket * 3600, (bucket + 1) * 3600, 'depth', NULL, NULL, NULL, dp32 FROM win)"""


def _dump_sql() -> str:
    from ..operators.queries_depth import _WIN

    return S.with_views("evidence", "depth_pos", "bed", extra=_WIN + ",\n" + _DUMP) + """SELECT bed_id AS region_id, sample_id, t.chrnum, CAST(t.beg AS INTEGER) AS beg, CAST(t."end" AS INTEGER) AS "end", kind, mate, qual, pairstr, dp32
FROM t JOIN bed ON t.chrnum = bed.chrnum AND t.beg < bed."end" AND t."end" > bed.beg"""


@query("evidence_dump", _dump_sql())
def _(spark, d):
    from ..operators import depth as D

    path, ev = _folder(spark, "evidence_by_bin"), S.evidence(spark, d)
    kind = lambda *k: ev.where(F.col("kind").isin(*k))
    rows = regions.evidence_table(kind("pair"), kind("split"), kind("lclip", "rclip"), D.depth_windows(S.depth_pos(spark, d), 3600), 3600)
    regions.write(rows, path, "beg", "end", LEVELS)
    return regions.query(spark.read.parquet(path), S.bed(spark, d).withColumnRenamed("bed_id", "region_id"), "beg", "end", LEVELS)


@query("cohort_added", S.with_views("depth_pos") + "SELECT sample_id, chrnum, count(DISTINCT pos // 100000) AS variants, count(*) AS rows, CAST(sum(depth) AS BIGINT) AS total FROM depth_pos GROUP BY ALL")
def _(spark, d):
    """Samples come in two steps, one of them twice; the manifest against the rows."""
    path, rows = _folder(spark, "cohort"), S.depth_pos(spark, d).withColumn("sv_id", F.floor(F.col("pos") / 100_000))
    cohort.add_samples(rows.where("sample_id < 7"), path)
    cohort.add_samples(rows.where("sample_id >= 6"), path)
    sums = cohort.read(spark, path, check=False).groupBy("sample_id", "chrnum").agg(F.sum("depth").alias("total"))
    return cohort.manifest(spark, path).join(sums, ["sample_id", "chrnum"])
