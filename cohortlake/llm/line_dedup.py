"""Line dedup (operator 10): DataFrame expressions only.

Lines are exploded, normalised to a key and hashed; distinct documents are
counted per hash; lines of keys over the threshold go, and each document is put
together again from the runs of lines that stay.

Defined results: a null or empty text is one empty line; a document is a
``doc_id``, so rows that repeat a ``doc_id`` count once; a row with a null
``doc_id`` counts as no document and keeps all its lines; a key stays in the
largest ``doc_id`` that holds it (in all rows of that ``doc_id``); a document
that loses every line has the empty text; an empty table gives no rows;
further input columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import stored, unused

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def _lines() -> Column:
    return F.split(F.coalesce("text", F.lit("")), "\n", -1)


def dropped_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """_id, _text (a hash), drops: sorted positions (from 0) of the lines that go.

    Only 128-bit hashes are shuffled. The hashed lines are written once, for counting and
    for dropping. The count is aggregated in two steps, first by (hash, document), so a
    line that many documents hold never meets in one task; its rows meet the written
    table of common keys in a join of two scans, which AQE can split at that line.
    """
    lines = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"), F.posexplode(_lines()).alias("_at", "_line"))
    lines = lines.where(F.col("_id").isNotNull()).withColumn("_key", line_key(F.col("_line"))).where(F.char_length("_key") >= min_chars)
    lines = stored(lines.select("_id", "_text", "_at", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(7), F.col("_key")).alias("_h2")), "lines")
    common = lines.groupBy("_h1", "_h2").agg(F.count_distinct("_id").alias("_docs"), F.max("_id").alias("_keep")).where(F.col("_docs") >= min_docs)
    gone = lines.join(stored(common.select("_h1", "_h2", "_keep"), "common_lines"), ["_h1", "_h2"]).where(F.col("_id") != F.col("_keep"))
    return gone.groupBy("_id", "_text").agg(F.sort_array(F.collect_set("_at")).alias("_drops"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with ``text`` rebuilt, and n_lines and n_dropped added (replacing columns of these names)."""
    gone = dropped_lines(docs, min_chars, min_docs)
    names = {c: unused(c, docs) for c in ("_id", "_text", "_drops", "_all")}
    for old, new in names.items():
        gone = gone.withColumnRenamed(old, new)
    id_, text_, drops, all_ = names.values()
    docs = docs.withColumns({id_: F.col("doc_id"), text_: F.xxhash64("text")})
    both = docs.join(gone.hint("shuffle_hash"), [id_, text_], "left")
    ends = F.concat(F.col(drops), F.array(F.size(all_)))
    starts = F.concat(F.array(F.lit(-1)), F.col(drops))
    runs = F.filter(F.zip_with(starts, ends, lambda a, b: F.struct((a + 2).alias("s"), (b - a - 1).alias("n"))), lambda r: r["n"] > 0)
    kept = F.array_join(F.transform(runs, lambda r: F.array_join(F.slice(all_, r["s"], r["n"]), "\n")), "\n")
    both = both.withColumn(all_, F.when(F.col(drops).isNotNull(), _lines()))
    text = F.coalesce("text", F.lit(""))
    return both.withColumns(
        {
            "n_lines": (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"))) + 1).cast("long"),
            "n_dropped": F.coalesce(F.size(drops), F.lit(0)).cast("long"),
            "text": F.when(F.col(drops).isNull(), text).otherwise(kept),
        }
    ).drop(*names.values())


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, rn, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM (SELECT *, row_number() OVER () AS rn FROM documents)
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.*, coalesce(k.doc_id <> c.keep, false) AS gone FROM k LEFT JOIN c ON k.key = c.key
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id, rn
"""
