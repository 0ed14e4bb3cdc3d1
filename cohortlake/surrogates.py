"""Genomic views of the test tables, in Spark and as SQL common table expressions.

The operators work on candidate intervals, depths, reads and evidence; these views
give such rows from the driver's tables, by the same projection on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = ("DEL", "DUP", "INV", "CNV", "INS", "BND")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sv(spark, sf_dir) -> DataFrame:
    """Candidates: sv_id, chrnum, pos, end, svtype, supp."""
    o = _read(spark, sf_dir, "orders")
    pos = (F.col("o_orderkey") * 7919 % 1_000_000 + 1).cast("int")
    return o.select(
        F.col("o_orderkey").alias("sv_id"),
        (F.col("o_custkey") % 24 + 1).cast("int").alias("chrnum"),
        pos.alias("pos"),
        (pos + 11 + (F.floor("o_totalprice") % 20_000)).cast("int").alias("end"),
        F.get(F.array(*map(F.lit, TYPES)), (F.col("o_orderkey") % 6).cast("int")).alias("svtype"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("supp"),
    )


def bed(spark, sf_dir) -> DataFrame:
    """Half-open intervals: bed_id, chrnum, beg, end."""
    beg = (F.col("s_suppkey") * 9973 % 1_000_000).cast("int")
    return _read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("bed_id"), (F.col("s_nationkey") % 24 + 1).cast("int").alias("chrnum"), beg.alias("beg"), (beg + 5000).alias("end")
    )


def _seconds():
    return F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01', ts)").cast("int")


def depth_pos(spark, sf_dir) -> DataFrame:
    """Depth at covered positions: sample_id, chrnum, pos, depth."""
    return _read(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).cast("int").alias("sample_id"),
        (F.col("event_id") % 2 + 1).cast("int").alias("chrnum"),
        _seconds().alias("pos"),
        F.round(F.col("value") * 100).cast("long").alias("depth"),
    )


def evidence(spark, sf_dir) -> DataFrame:
    """Reads near breakpoints: ev_id, sample_id, chrnum, kind, pos, mate, qual, pairstr, lengths and clips of both alignments."""
    kinds = F.create_map(*[F.lit(x) for kv in (("click", "lclip"), ("view", "rclip"), ("purchase", "pair"), ("signup", "split")) for x in kv])
    return _read(spark, sf_dir, "events").select(
        F.col("event_id").alias("ev_id"),
        (F.col("user_id") % 10).cast("int").alias("sample_id"),
        (F.col("event_id") % 2 + 1).cast("int").alias("chrnum"),
        F.coalesce(F.element_at(kinds, F.col("event_type")), F.lit("filtered")).alias("kind"),
        _seconds().alias("pos"),
        (_seconds() + F.floor(F.col("value") * 37)).cast("int").alias("mate"),
        (F.col("event_id") % 61).cast("int").alias("qual"),
        (F.col("event_id") % 4).cast("int").alias("pairstr"),
        (F.col("event_id") % 30 + 40).cast("int").alias("rlen"),
        (F.col("event_id") % 20 + 45).cast("int").alias("sa_rlen"),
        *[((F.floor(F.col("event_id") / 4) + i) % 4).cast("int").alias(c) for i, c in enumerate(("lclip", "rclip", "sa_lclip", "sa_rclip"))],
    )


def reads(spark, sf_dir) -> DataFrame:
    """Alignments with flags, CIGAR and tags, as a SAM reader gives them."""
    line = _read(spark, sf_dir, "lineitem")
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    flag = (
        F.lit(1)
        + F.when(q % 3 == 0, 2).otherwise(0)
        + F.when(F.col("l_linestatus") == "F", 16).otherwise(0)
        + F.when(n % 2 == 0, 32).otherwise(0)
        + F.when((F.col("l_returnflag") == "R") & (n == 1), 1024).otherwise(0)
        + F.when((F.col("l_returnflag") == "A") & (q % 5 == 0), 2048).otherwise(0)
    )
    pos = ((F.col("l_orderkey") * 7919 + n * 131) % 1_000_000).cast("int")
    left, right = F.when(n % 3 == 1, F.concat((n + 2).cast("string"), F.lit("S"))).otherwise(""), F.when(q % 4 == 0, F.concat(q.cast("string"), F.lit("S"))).otherwise("")
    body = F.when(n % 5 == 0, F.concat(F.lit("40M"), n.cast("string"), F.lit("D50M"))).otherwise(F.lit("90M"))
    chrom = (F.col("l_suppkey") % 24 + 1).cast("int")
    name = F.when(chrom == 23, "X").when(chrom == 24, "Y").otherwise(chrom.cast("string"))
    return line.select(
        F.col("l_orderkey").alias("read_id"),
        n.alias("part"),
        flag.cast("int").alias("flag"),
        chrom.alias("chrnum"),
        pos.alias("pos"),
        q.alias("mapq"),
        F.concat(left, body, right).alias("cigar"),
        F.when(q % 7 == 0, chrom % 24 + 1).otherwise(chrom).cast("int").alias("mate_chrnum"),
        (pos + F.when(n % 4 == 0, -200).otherwise(q * 17)).cast("int").alias("mate_pos"),
        F.when(n % 4 == 0, -(q * 17)).otherwise(q * 17).cast("int").alias("isize"),
        (F.col("l_partkey") % 61).cast("int").alias("mq"),
        (F.col("l_partkey") % 8).cast("int").alias("nm"),
        F.concat(
            F.lit("chr"), name, F.lit(","), (F.col("l_partkey") * 37 % 1_000_000 + 1).cast("string"), F.lit(","), F.when(n % 2 == 0, "-").otherwise("+"),
            F.lit(","), F.concat(right, F.lit("60M"), left), F.lit(",60,0;"),
        ).alias("sa"),
    )


def genome(spark, sf_dir) -> DataFrame:
    """Reference bases in 100-character buckets: chrnum (a document), bucket, bases."""
    docs = _read(spark, sf_dir, "documents").where("text is not null and length(text) > 0")
    letters = F.translate("text", "EINORSHLDUeinorshldu", "ACGTACGTNNACGTACGTNN")
    parts = F.regexp_extract_all(letters, F.lit("(?s).{1,100}"), F.lit(0))
    return docs.select(F.col("doc_id").cast("int").alias("chrnum"), F.posexplode(parts).alias("bucket", "bases"))


def cohort(spark, sf_dir) -> DataFrame:
    """One row per candidate and sample, 50 samples each: sv_id, sample_id, depth, cnt, depth2, label."""
    e = _read(spark, sf_dir, "embeddings")
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    third = F.col("label") % 3
    return e.select(
        F.floor(F.col("vec_id") / 50).alias("sv_id"),
        (F.col("vec_id") % 50).alias("sample_id"),
        (F.lit(1.0) - 0.5 * third + 0.3 * at(0)).alias("depth"),
        F.greatest(F.lit(0.0), 0.15 * third + 0.1 * at(1)).alias("cnt"),
        (F.lit(1.0) - 0.5 * third + 0.3 * at(2)).alias("depth2"),
        third.cast("int").alias("label"),
    )


CTE = {
    "sv": """sv AS (
  SELECT o_orderkey AS sv_id, CAST(o_custkey % 24 + 1 AS INTEGER) AS chrnum, CAST(o_orderkey * 7919 % 1000000 + 1 AS INTEGER) AS pos,
    CAST(o_orderkey * 7919 % 1000000 + 12 + CAST(floor(o_totalprice) AS BIGINT) % 20000 AS INTEGER) AS "end",
    (['DEL','DUP','INV','CNV','INS','BND'])[CAST(o_orderkey % 6 AS INTEGER) + 1] AS svtype,
    CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS supp FROM orders)""",
    "bed": """bed AS (
  SELECT s_suppkey AS bed_id, CAST(s_nationkey % 24 + 1 AS INTEGER) AS chrnum, CAST(s_suppkey * 9973 % 1000000 AS INTEGER) AS beg,
    CAST(s_suppkey * 9973 % 1000000 + 5000 AS INTEGER) AS "end" FROM supplier)""",
    "depth_pos": """depth_pos AS (
  SELECT CAST(user_id % 10 AS INTEGER) AS sample_id, CAST(event_id % 2 + 1 AS INTEGER) AS chrnum,
    CAST(floor(epoch(ts)) - 1704067200 AS INTEGER) AS pos, CAST(round(value * 100) AS BIGINT) AS depth FROM events)""",
    "evidence": """evidence AS (
  SELECT event_id AS ev_id, CAST(user_id % 10 AS INTEGER) AS sample_id, CAST(event_id % 2 + 1 AS INTEGER) AS chrnum,
    CASE event_type WHEN 'click' THEN 'lclip' WHEN 'view' THEN 'rclip' WHEN 'purchase' THEN 'pair' WHEN 'signup' THEN 'split' ELSE 'filtered' END AS kind,
    CAST(floor(epoch(ts)) - 1704067200 AS INTEGER) AS pos, CAST(floor(epoch(ts)) - 1704067200 + floor(value * 37) AS INTEGER) AS mate,
    CAST(event_id % 61 AS INTEGER) AS qual, CAST(event_id % 4 AS INTEGER) AS pairstr,
    CAST(event_id % 30 + 40 AS INTEGER) AS rlen, CAST(event_id % 20 + 45 AS INTEGER) AS sa_rlen, CAST(event_id // 4 % 4 AS INTEGER) AS lclip,
    CAST((event_id // 4 + 1) % 4 AS INTEGER) AS rclip, CAST((event_id // 4 + 2) % 4 AS INTEGER) AS sa_lclip, CAST((event_id // 4 + 3) % 4 AS INTEGER) AS sa_rclip FROM events)""",
    "reads": """reads AS (
  SELECT l_orderkey AS read_id, l_linenumber AS part,
    CAST(1 + CASE WHEN q % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN l_linestatus = 'F' THEN 16 ELSE 0 END + CASE WHEN l_linenumber % 2 = 0 THEN 32 ELSE 0 END
      + CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 1024 ELSE 0 END + CASE WHEN l_returnflag = 'A' AND q % 5 = 0 THEN 2048 ELSE 0 END AS INTEGER) AS flag,
    chrom AS chrnum, p AS pos, q AS mapq, lc || body || rc AS cigar,
    CAST(CASE WHEN q % 7 = 0 THEN chrom % 24 + 1 ELSE chrom END AS INTEGER) AS mate_chrnum,
    CAST(p + CASE WHEN l_linenumber % 4 = 0 THEN -200 ELSE q * 17 END AS INTEGER) AS mate_pos,
    CAST(CASE WHEN l_linenumber % 4 = 0 THEN -(q * 17) ELSE q * 17 END AS INTEGER) AS isize,
    CAST(l_partkey % 61 AS INTEGER) AS mq, CAST(l_partkey % 8 AS INTEGER) AS nm,
    'chr' || CASE chrom WHEN 23 THEN 'X' WHEN 24 THEN 'Y' ELSE CAST(chrom AS VARCHAR) END || ',' || CAST(l_partkey * 37 % 1000000 + 1 AS VARCHAR) || ','
      || CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '+' END || ',' || rc || '60M' || lc || ',60,0;' AS sa
  FROM (SELECT *, CAST(l_quantity AS INTEGER) AS q, CAST(l_suppkey % 24 + 1 AS INTEGER) AS chrom, CAST((l_orderkey * 7919 + l_linenumber * 131) % 1000000 AS INTEGER) AS p,
      CASE WHEN l_linenumber % 3 = 1 THEN CAST(l_linenumber + 2 AS VARCHAR) || 'S' ELSE '' END AS lc,
      CASE WHEN CAST(l_quantity AS INTEGER) % 4 = 0 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || 'S' ELSE '' END AS rc,
      CASE WHEN l_linenumber % 5 = 0 THEN '40M' || CAST(l_linenumber AS VARCHAR) || 'D50M' ELSE '90M' END AS body FROM lineitem))""",
    "genome": """genome AS (
  SELECT CAST(doc_id AS INTEGER) AS chrnum, CAST(b AS INTEGER) AS bucket, substr(s, CAST(b * 100 + 1 AS BIGINT), 100) AS bases
  FROM (SELECT doc_id, translate(text, 'EINORSHLDUeinorshldu', 'ACGTACGTNNACGTACGTNN') AS s, unnest(range(0, (length(text) - 1) // 100 + 1)) AS b
        FROM documents WHERE text IS NOT NULL AND length(text) > 0))""",
    "cohort": """cohort AS (
  SELECT vec_id // 50 AS sv_id, vec_id % 50 AS sample_id, 1.0::DOUBLE - 0.5::DOUBLE * (label % 3) + 0.3::DOUBLE * embedding[1]::DOUBLE AS depth,
    greatest(0.0::DOUBLE, 0.15::DOUBLE * (label % 3) + 0.1::DOUBLE * embedding[2]::DOUBLE) AS cnt,
    1.0::DOUBLE - 0.5::DOUBLE * (label % 3) + 0.3::DOUBLE * embedding[3]::DOUBLE AS depth2, CAST(label % 3 AS INTEGER) AS label FROM embeddings)""",
}


def with_views(*names: str, extra: str = "") -> str:
    """The WITH clause of these views (and further expressions)."""
    return "WITH " + ",\n".join([*(CTE[n] for n in names), *([extra] if extra else [])]) + "\n"
