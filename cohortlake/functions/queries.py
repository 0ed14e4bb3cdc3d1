"""Queries and SQL of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import surrogates as S
from . import scalars as X

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    SQL[name] = sql
    return lambda f: QUERIES.setdefault(name, f)


_NAMES = "CASE o_orderkey % 9 WHEN 0 THEN 'chrX' WHEN 1 THEN 'chrY' WHEN 2 THEN 'chrM' WHEN 3 THEN 'chr1_alt' WHEN 4 THEN 'MT' WHEN 5 THEN 'X' ELSE concat('chr', CAST(o_custkey % 30 AS {})) END"


@query(
    "chrom_parse",
    f"""SELECT o_orderkey AS id, name, CAST(CASE WHEN b = 'X' THEN 23 WHEN b = 'Y' THEN 24 WHEN b IN ('M','MT') THEN 25
  WHEN regexp_full_match(b, '[0-9]{{1,2}}') THEN CAST(b AS INTEGER) ELSE 0 END AS INTEGER) AS chrnum
FROM (SELECT o_orderkey, name, regexp_replace(name, '^[cC]hr', '') AS b FROM (SELECT o_orderkey, {_NAMES.format("VARCHAR")} AS name FROM orders))""",
)
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.expr(_NAMES.format("STRING")).alias("name"))
    return o.withColumn("chrnum", X.chrom_number(F.col("name")))


@query(
    "chrom_name",
    S.with_views("sv") + "SELECT sv_id, 'chr' || CASE c WHEN 23 THEN 'X' WHEN 24 THEN 'Y' WHEN 25 THEN 'M' ELSE CAST(c AS VARCHAR) END AS name FROM (SELECT sv_id, chrnum + CAST(sv_id % 2 AS INTEGER) AS c FROM sv)",
)
def _(spark, d):
    return S.sv(spark, d).select("sv_id", X.chrom_name((F.col("chrnum") + F.col("sv_id") % 2).cast("int")).alias("name"))


@query(
    "svtype_map",
    """SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN 'DEL' WHEN 1 THEN 'DUP' WHEN 2 THEN 'INV' WHEN 3 THEN 'CNV' WHEN 4 THEN 'INS' WHEN 5 THEN 'BND' ELSE 'DEL' END AS name,
  CAST(CASE o_orderpriority[1] WHEN '1' THEN 0 WHEN '2' THEN 1 WHEN '3' THEN 2 ELSE 5 END AS INTEGER) AS code FROM orders""",
)
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    text = F.when(F.col("o_orderpriority").startswith("1"), "DEL").when(F.col("o_orderpriority").startswith("2"), "DUP").when(F.col("o_orderpriority").startswith("3"), "INV").otherwise("TRA")
    return o.select(F.col("o_orderkey").alias("id"), X.type_name(F.col("o_orderkey") % 8).alias("name"), X.type_code(text).cast("int").alias("code"))


@query(
    "gc_content",
    S.with_views("genome", extra="g AS (SELECT *, length(regexp_replace(bases, '[^GC]', '', 'g')) AS gc, length(regexp_replace(bases, '[^AT]', '', 'g')) AS a FROM genome)")
    + "SELECT chrnum, bucket, round(CASE WHEN gc + a > length(bases) // 2 THEN gc / (gc + a) ELSE -1 END, 6) AS gc FROM g",
)
def _(spark, d):
    return S.genome(spark, d).select("chrnum", "bucket", F.round(X.gc_content(F.col("bases")), 6).alias("gc"))


@query("split_tokens", """SELECT p_partkey, CAST(len(t) AS INTEGER) AS n, t[1] AS first_token, t[-1] AS last_token
FROM (SELECT p_partkey, list_filter(string_split_regex(p_name || '  ' || p_type, '[ \\t\\n]'), lambda x: x <> '') AS t FROM part)""")
def _(spark, d):
    t = X.tokens(F.concat("p_name", F.lit("  "), "p_type"))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.size(t).alias("n"), F.element_at(t, 1).alias("first_token"), F.element_at(t, -1).alias("last_token"))


_LEN = "coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[{}]', 1), lambda x: CAST(x AS INTEGER))), 0)"


@query(
    "cigar_stats",
    S.with_views("reads")
    + f"""SELECT cigar, CAST({_LEN.format("MDN=X")} AS INTEGER) AS ref_length,
  CAST(coalesce(nullif(regexp_extract(cigar, '^([0-9]+)S', 1), ''), '0') AS INTEGER) AS left_clip,
  CAST(coalesce(nullif(regexp_extract(cigar, '([0-9]+)S$', 1), ''), '0') AS INTEGER) AS right_clip, count(*) AS n FROM reads GROUP BY cigar""",
)
def _(spark, d):
    left, right = X.clip_lengths(F.col("cigar"))
    by = S.reads(spark, d).groupBy("cigar").agg(F.count("*").alias("n"))
    return by.select("cigar", X.cigar_length(F.col("cigar")).alias("ref_length"), left.alias("left_clip"), right.alias("right_clip"), "n")


@query("cigar_reflen", S.with_views("reads") + f"SELECT DISTINCT cigar, CAST(greatest(1, {_LEN.format('MDN')}) AS INTEGER) AS ref_length FROM reads")
def _(spark, d):
    return S.reads(spark, d).select("cigar").distinct().select("cigar", F.greatest(F.lit(1), X.cigar_length(F.upper("cigar"), "MDN")).alias("ref_length"))


@query(
    "sa_parse",
    S.with_views("reads")
    + r"""SELECT read_id, part, CAST(CASE c WHEN 'X' THEN 23 WHEN 'Y' THEN 24 ELSE CAST(c AS INTEGER) END AS INTEGER) AS sa_chrnum, CAST(p AS INTEGER) AS sa_pos,
  CAST(CASE s WHEN '-' THEN 1 ELSE 0 END AS INTEGER) AS sa_reverse, g AS sa_cigar
FROM (SELECT read_id, part, regexp_extract(sa, '^chr([0-9XY]+),', 1) AS c, regexp_extract(sa, ',([0-9]+),', 1) AS p, regexp_extract(sa, ',([+-]),', 1) AS s, split_part(sa, ',', 4) AS g FROM reads)""",
)
def _(spark, d):
    return S.reads(spark, d).select("read_id", "part", *[c.alias(f"sa_{k}") for k, c in X.supplementary(F.col("sa")).items()])


@query(
    "region_parse",
    S.with_views("sv")
    + """SELECT sv_id, 'chr' || CAST(chrnum AS VARCHAR) AS name, CAST(pos - 1 AS INTEGER) AS beg,
  CAST(CASE WHEN sv_id % 3 = 0 THEN 536870912 ELSE "end" END AS INTEGER) AS "end" FROM sv WHERE sv_id % 3 <> 2 OR pos - 1 <= "end" """,
)
def _(spark, d):
    text = F.concat(F.lit("chr"), F.col("chrnum").cast("string"), F.lit(":"), F.format_number("pos", 0), F.when(F.col("sv_id") % 3 == 0, "").otherwise(F.concat(F.lit("-"), F.format_number("end", 0))))
    return S.sv(spark, d).select("sv_id", X.region(text).alias("r")).where("r is not null").select("sv_id", "r.*")


@query(
    "record_interval",
    S.with_views("sv", "reads")
    + f"""SELECT 'vcf' AS preset, sv_id AS id, CAST(pos - 1 AS INTEGER) AS beg, CAST(greatest(1, "end") AS INTEGER) AS "end" FROM sv
UNION ALL SELECT 'sam', read_id * 10 + part, CAST(greatest(0, pos - 1) AS INTEGER), CAST(greatest(1, greatest(0, pos - 1) + greatest(1, {_LEN.format("MDN")})) AS INTEGER) FROM reads""",
)
def _(spark, d):
    vcf = S.sv(spark, d).select(F.lit("vcf").alias("preset"), F.col("sv_id").alias("id"), F.greatest(F.lit(0), F.col("pos") - 1).alias("beg"), F.greatest(F.lit(1), "end").alias("end"))
    beg = F.greatest(F.lit(0), F.col("pos") - 1)
    sam = S.reads(spark, d).select(
        F.lit("sam").alias("preset"), (F.col("read_id") * 10 + F.col("part")).alias("id"), beg.alias("beg"),
        F.greatest(F.lit(1), beg + F.greatest(F.lit(1), X.cigar_length(F.col("cigar"), "MDN"))).alias("end"),
    )
    return vcf.unionByName(sam)


_BIN = "CASE " + " ".join(f'WHEN (pos >> {s}) = (("end" - 1) >> {s}) THEN (pos >> {s}) + {f}' for s, f in X.BIN_LEVELS) + " ELSE 0 END"


@query("bin_assign", S.with_views("sv") + f"SELECT sv_id, CAST({_BIN} AS INTEGER) AS bin FROM sv")
def _(spark, d):
    return S.sv(spark, d).select("sv_id", X.bin_of(F.col("pos"), F.col("end")).alias("bin"))


@query(
    "bin_list",
    S.with_views("bed")
    + "SELECT bed_id, unnest(flatten([[0], " + ", ".join(f'range((beg >> {s}) + {f}, (("end" - 1) >> {s}) + {f} + 1)' for s, f in reversed(X.BIN_LEVELS)) + "])) AS bin FROM bed",
)
def _(spark, d):
    return S.bed(spark, d).select("bed_id", F.explode(X.bins_over(F.col("beg"), F.col("end"))).alias("bin")).withColumn("bin", F.col("bin").cast("long"))


@query("fixed_depth", S.with_views("depth_pos") + "SELECT sample_id, chrnum, pos, CAST(least(65535, round(depth * 32 / 100.0::DOUBLE)) AS INTEGER) AS dp32 FROM depth_pos")
def _(spark, d):
    return S.depth_pos(spark, d).select("sample_id", "chrnum", "pos", X.fixed_depth(F.col("depth") / 100).alias("dp32"))


@query("l1_distance", S.with_views("sv") + 'SELECT a.sv_id AS a_id, b.sv_id AS b_id, CAST(abs(a.pos - b.pos) + abs(a."end" - b."end") AS INTEGER) AS distance FROM sv a JOIN sv b ON b.sv_id = a.sv_id + 1')
def _(spark, d):
    a = S.sv(spark, d)
    b = a.select((F.col("sv_id") - 1).alias("sv_id"), F.col("sv_id").alias("b_id"), F.col("pos").alias("b_pos"), F.col("end").alias("b_end"))
    return a.join(b, "sv_id").select(F.col("sv_id").alias("a_id"), "b_id", (F.abs(F.col("pos") - F.col("b_pos")) + F.abs(F.col("end") - F.col("b_end"))).alias("distance"))


@query("cn_label", S.with_views("cohort") + "SELECT sv_id, sample_id, CAST(round(2 * depth) AS INTEGER) AS cn FROM cohort")
def _(spark, d):
    return S.cohort(spark, d).select("sv_id", "sample_id", F.round(2 * F.col("depth")).cast("int").alias("cn"))


@query("normal_pdf", S.with_views("cohort") + "SELECT sv_id, sample_id, round(exp(-0.5 * pow((depth - 0.5) / 0.1, 2)) / (0.1 * sqrt(2 * pi())), 4) AS density FROM cohort")
def _(spark, d):
    return S.cohort(spark, d).select("sv_id", "sample_id", F.round(X.normal_pdf(F.col("depth"), F.lit(0.5), F.lit(0.1)), 4).alias("density"))


@query(
    "normal_pdf_2d",
    S.with_views("cohort")
    + "SELECT sv_id, sample_id, round(exp(-0.5 * (0.02 * pow(depth - 0.5, 2) - 0.01 * (depth - 0.5) * (depth2 - 0.5) + 0.01 * pow(depth2 - 0.5, 2)) / 0.000175) / (2 * pi() * sqrt(0.000175)), 4) AS density FROM cohort",
)
def _(spark, d):
    cov = [F.lit(v) for v in (0.01, 0.005, 0.02)]
    return S.cohort(spark, d).select("sv_id", "sample_id", F.round(X.normal_pdf_2d(F.col("depth"), F.col("depth2"), F.lit(0.5), F.lit(0.5), *cov), 4).alias("density"))
