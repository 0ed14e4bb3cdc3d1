"""Queries and SQL of read filters and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import surrogates as S
from . import evidence as E

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    SQL[name] = sql
    return lambda f: QUERIES.setdefault(name, f)


_INS = "(flag & 1) <> 0 AND (flag & 2048) = 0 AND (flag & 2) <> 0 AND (flag & 4) = 0 AND pos > 0 AND chrnum = mate_chrnum AND isize > 0"
_CLIP = "coalesce(try_cast(regexp_extract({}, '^([0-9]+)S', 1) AS INTEGER), 0)"
_CLIPR = "coalesce(try_cast(regexp_extract({}, '([0-9]+)S$', 1) AS INTEGER), 0)"
_RLEN = "CAST(coalesce(list_sum(list_transform(regexp_extract_all({}, '([0-9]+)[MDN=X]', 1), lambda x: CAST(x AS INTEGER))), 0) AS INTEGER)"


@query("read_filter", S.with_views("reads") + "SELECT read_id, part, flag, mapq FROM reads WHERE (flag & 1796) = 0 AND mapq >= 1")
def _(spark, d):
    return E.usable_reads(S.reads(spark, d)).select("read_id", "part", "flag", "mapq")


@query("insert_size_stats", S.with_views("reads") + f"SELECT chrnum, count(*) AS n, round(avg(isize), 6) AS avg_isize, round(stddev_pop(isize), 6) AS sd_isize FROM reads WHERE (flag & 1796) = 0 AND {_INS} GROUP BY chrnum")
def _(spark, d):
    rows = E.insert_sizes(E.usable_reads(S.reads(spark, d)))
    return rows.groupBy("chrnum").agg(F.count("*").alias("n"), F.round(F.avg("isize"), 6).alias("avg_isize"), F.round(F.stddev_pop("isize"), 6).alias("sd_isize"))


@query(
    "discordant_pairs",
    S.with_views("reads")
    + f"""SELECT read_id, part, chrnum, pos AS selfpos, mate_pos AS matepos, mq AS matequal, CAST(CASE WHEN (flag & 16) <> 0 THEN 2 ELSE 0 END + CASE WHEN (flag & 32) <> 0 THEN 1 ELSE 0 END AS INTEGER) AS pairstr
FROM reads WHERE (flag & 1796) = 0 AND (flag & 1) <> 0 AND (flag & 2048) = 0 AND NOT ({_INS}) AND mapq >= 10 AND chrnum = mate_chrnum AND pos <= mate_pos AND mq > 10""",
)
def _(spark, d):
    return E.discordant_pairs(E.usable_reads(S.reads(spark, d)))


_CLIPS = f"""cl AS (SELECT read_id, part, chrnum, flag, pos, {_CLIP.format("cigar")} AS l, {_CLIPR.format("cigar")} AS r, {_RLEN.format("cigar")} AS n FROM reads
  WHERE (flag & 1796) = 0 AND mapq >= 10 AND nm < 5 AND regexp_matches(cigar, '[0-9]+[A-Z=].*[0-9]+[A-Z=]')),
clips AS (SELECT read_id, part, chrnum, 'left' AS side, pos, (flag & 16) <> 0 AS cycle_end FROM cl WHERE l >= 5
  UNION ALL SELECT read_id, part, chrnum, 'right', CAST(pos + n AS INTEGER), (flag & 16) = 0 FROM cl WHERE r >= 5)"""


def _clips(spark, d):
    return E.soft_clips(E.usable_reads(S.reads(spark, d)))


@query("soft_clips", S.with_views("reads", extra=_CLIPS) + "SELECT * FROM clips")
def _(spark, d):
    return _clips(spark, d)


@query("clip_drop", S.with_views("reads", extra=_CLIPS) + "SELECT * FROM clips WHERE NOT cycle_end")
def _(spark, d):
    return E.kept_clips(_clips(spark, d))


@query("clip_neighbour", S.with_views("reads", extra=_CLIPS) + "SELECT * FROM clips c WHERE NOT cycle_end OR EXISTS (SELECT 1 FROM clips o WHERE o.chrnum = c.chrnum AND NOT o.cycle_end AND o.pos BETWEEN c.pos - 10 AND c.pos + 10)")
def _(spark, d):
    return E.kept_clips(_clips(spark, d), by_neighbour=True)


@query(
    "split_reads",
    S.with_views("reads", extra=f"""x AS (SELECT *, split_part(sa, ',', 4) AS g, CAST(split_part(sa, ',', 2) AS INTEGER) AS sa_pos FROM reads)""")
    + f"""SELECT read_id, part, chrnum, pos, sa_pos, {_CLIP.format("cigar")} AS lclip, {_CLIPR.format("cigar")} AS rclip, {_CLIP.format("g")} AS sa_lclip, {_CLIPR.format("g")} AS sa_rclip,
  {_RLEN.format("cigar")} AS rlen, {_RLEN.format("g")} AS sa_rlen, CAST(CASE WHEN (flag & 16) <> 0 THEN 2 ELSE 0 END + CASE WHEN split_part(sa, ',', 3) = '-' THEN 1 ELSE 0 END AS INTEGER) AS pairstr
FROM x WHERE (flag & 1796) = 0 AND (flag & 2048) <> 0 AND mapq >= 20 AND {_CLIP.format("cigar")} + {_CLIPR.format("cigar")} > 0 AND {_CLIP.format("g")} + {_CLIPR.format("g")} > 0""",
)
def _(spark, d):
    return E.split_reads(E.usable_reads(S.reads(spark, d)))


# wide variants of the view, so that pairs, splits and clips of the two chromosomes meet their ends
_SVC = 'v AS (SELECT sv_id, CAST(chrnum % 2 + 1 AS INTEGER) AS chrnum, CAST(pos * 2 AS INTEGER) AS pos, CAST(pos * 2 + ("end" - pos) % 4000 AS INTEGER) AS "end", svtype FROM sv)'
_ORD = """o AS (SELECT ev_id, sample_id, chrnum, kind, qual, least(pos, mate) AS self, greatest(pos, mate) AS mate, CAST(CASE WHEN pos > mate THEN (pairstr % 2) * 2 + pairstr // 2 ELSE pairstr END AS INTEGER) AS side FROM evidence)"""
_PAIRS = _SVC + ",\n" + _ORD + """,
pr AS (SELECT sv_id, ev_id, sample_id, self, mate, side, v.pos, v."end" FROM v JOIN o ON v.chrnum = o.chrnum AND (
  (svtype = 'DEL' AND self BETWEEN v.pos - 500 AND v.pos + 100 AND mate >= v."end" - 100 AND mate < v."end" + 500 AND qual > 0)
  OR (svtype IN ('DUP','CNV') AND self >= v.pos - 100 AND self < v.pos + 500 AND mate BETWEEN v."end" - 500 AND v."end" + 100 AND qual > 0)
  OR (svtype = 'INV' AND qual > 30 AND ((side = 0 AND self >= v.pos - 500 AND self < v.pos AND mate >= v."end" - 500 AND mate < v."end" AND mate > v.pos)
    OR (side = 3 AND self >= v.pos - 50 AND self < v.pos + 500 AND self < v."end" AND mate >= v."end" - 50 AND mate < v."end" + 500)))) WHERE kind IN ('pair', 'filtered'))"""


def _sv(spark, d):
    p = F.col("pos") * 2
    return S.sv(spark, d).select("sv_id", (F.col("chrnum") % 2 + 1).cast("int").alias("chrnum"), p.alias("pos"), (p + (F.col("end") - F.col("pos")) % 4000).alias("end"), "svtype")


def _of(spark, d, *kinds):
    return S.evidence(spark, d).where(F.col("kind").isin(*kinds))


def _offsets(spark, d):
    return E.pair_offsets(_sv(spark, d), _of(spark, d, "pair", "filtered"))


@query("pairs_near_sv", S.with_views("sv", "evidence", extra=_PAIRS) + "SELECT sv_id, ev_id, sample_id, self, mate, side FROM pr")
def _(spark, d):
    return E.pairs_near(_sv(spark, d), _of(spark, d, "pair", "filtered"))


@query(
    "pair_histogram",
    S.with_views("sv", "evidence", extra=_PAIRS + """,
h AS (SELECT sv_id, (self - pos + 500) // 10 AS i, 100 + (mate - "end" + 500) // 10 AS j FROM pr),
c AS (SELECT sv_id, unnest(range(greatest(0, i - 5), least(99, i + 5) + 1)) AS cell FROM h WHERE i BETWEEN 0 AND 99 UNION ALL SELECT sv_id, unnest(range(greatest(100, j - 5), least(199, j + 5) + 1)) FROM h WHERE j BETWEEN 100 AND 199)""")
    + "SELECT sv_id, CAST(cell AS INTEGER) AS cell, count(*) AS n FROM c GROUP BY ALL",
)
def _(spark, d):
    return E.smeared_histogram(_offsets(spark, d))


_HITS = """CASE svtype WHEN 'DEL' THEN pos - self > 75 AND pos - self < 375 AND mate - "end" > -75 AND mate - "end" < 300 ELSE self - pos > -75 AND self - pos < 375 AND mate - "end" > -300 AND mate - "end" < 75 END"""


@query("pair_cluster_hits", S.with_views("sv", "evidence", extra=_PAIRS) + f"SELECT sv_id, sample_id, count(*) AS hits FROM (SELECT pr.*, svtype FROM pr JOIN v USING (sv_id)) WHERE {_HITS} GROUP BY ALL")
def _(spark, d):
    return E.pair_cluster_hits(_offsets(spark, d))


_SPLITS = _SVC + """,
sp AS (SELECT sv_id, ev_id, sample_id, svtype, p, q, v.pos AS s, v."end" AS e, side, pe, qe, lclip > 0 AS l, rclip > 0 AS r, sa_lclip > 0 AS sl, sa_rclip > 0 AS sr FROM v
  JOIN (SELECT *, pos AS p, mate - 1 AS q, pos + rlen + 1 AS pe, mate + sa_rlen AS qe, pairstr AS side FROM evidence WHERE kind IN ('split', 'filtered', 'pair')) x USING (chrnum)
  WHERE p BETWEEN v.pos - 500 AND v.pos + 500 OR p BETWEEN v."end" - 500 AND v."end" + 500),
sb AS (SELECT *, CASE svtype WHEN 'DEL' THEN CASE WHEN pe < q THEN pe WHEN qe < p THEN qe END WHEN 'INV' THEN least(CASE WHEN r AND sr THEN pe ELSE p END, CASE WHEN r AND sr THEN qe ELSE q END)
    ELSE CASE WHEN p < qe THEN p WHEN q < pe THEN q END END AS b1,
  CASE svtype WHEN 'DEL' THEN CASE WHEN pe < q THEN q WHEN qe < p THEN p END WHEN 'INV' THEN greatest(CASE WHEN r AND sr THEN pe ELSE p END, CASE WHEN r AND sr THEN qe ELSE q END)
    ELSE CASE WHEN p < qe THEN qe WHEN q < pe THEN pe END END AS b2,
  CASE svtype WHEN 'DEL' THEN CASE WHEN pe < q THEN r AND sl ELSE l AND sr END WHEN 'INV' THEN true ELSE CASE WHEN p < qe THEN l AND sr ELSE r AND sl END END AS clips FROM sp),
sn AS (SELECT sv_id, ev_id, sample_id, CASE svtype WHEN 'DEL' THEN 'inward' WHEN 'INV' THEN 'inverted' ELSE 'outward' END AS way, CAST(b1 AS INTEGER) AS start, CAST(b2 AS INTEGER) AS "end" FROM sb
  WHERE svtype IN ('DEL','DUP','CNV','INV') AND clips AND b1 >= s - 100 AND b2 >= e - 100 AND b2 < e + 100
    AND CASE svtype WHEN 'INV' THEN side IN (1, 2) AND b2 < s + 100 ELSE side IN (0, 3) AND b1 < s + 100 END)"""


def _splits(spark, d):
    return E.splits_near(_sv(spark, d), S.evidence(spark, d).where(F.col("kind").isin("split", "filtered", "pair")))


@query("splits_near_sv", S.with_views("sv", "evidence", extra=_SPLITS) + "SELECT * FROM sn")
def _(spark, d):
    return _splits(spark, d)


_CELLS = _SVC + """,
cc AS (SELECT sv_id, ev_id, sample_id, kind, CAST(c.pos - v.pos + 100 AS INTEGER) AS cell FROM v JOIN evidence c USING (chrnum) WHERE kind IN ('lclip','rclip') AND c.pos >= v.pos - 100 AND c.pos < v.pos + 100
  UNION ALL SELECT sv_id, ev_id, sample_id, kind, CAST(c.pos - v."end" + 300 AS INTEGER) FROM v JOIN evidence c USING (chrnum) WHERE kind IN ('lclip','rclip') AND c.pos >= v."end" - 100 AND c.pos < v."end" + 100)"""


def _clip_rows(spark, d):
    return _of(spark, d, "lclip", "rclip")


def _cells(spark, d):
    return E.clips_near(_sv(spark, d), _clip_rows(spark, d))


@query("clips_near_sv", S.with_views("sv", "evidence", extra=_CELLS) + "SELECT * FROM cc")
def _(spark, d):
    return _cells(spark, d)


@query("clip_histogram", S.with_views("sv", "evidence", extra=_CELLS) + "SELECT sv_id, kind, cell, count(*) AS n FROM cc GROUP BY ALL")
def _(spark, d):
    return E.clip_cells(_sv(spark, d), _clip_rows(spark, d))


@query("clip_mode", S.with_views("sv", "evidence", extra=_CELLS) + "SELECT sv_id, half, cell, n FROM (SELECT *, row_number() OVER (PARTITION BY sv_id, half ORDER BY n DESC, cell) AS k FROM (SELECT sv_id, cell // 200 AS half, cell, count(*) AS n FROM cc GROUP BY ALL)) WHERE k = 1")
def _(spark, d):
    best = E.clip_modes(_sv(spark, d), _clip_rows(spark, d), [])
    return best.select("sv_id", F.col("far").cast("int").alias("half"), "cell", "n")


@query("clip_window_counts", S.with_views("sv", "evidence", extra=_CELLS) + "SELECT sv_id, sample_id, count(*) FILTER (cell BETWEEN 97 AND 103) AS near_start, count(*) FILTER (cell BETWEEN 297 AND 303) AS near_end FROM cc GROUP BY ALL")
def _(spark, d):
    found, far = E.clips_at(_sv(spark, d), _clip_rows(spark, d), ["sample_id"], {"n": (-100, 99), "near": (-3, 3)}), F.col("far")
    near = lambda ok: F.sum(F.when(ok, F.col("near")).otherwise(0))
    return found.groupBy("sv_id", "sample_id").agg(near(~far).alias("near_start"), near(far).alias("near_end"))


_COUNTS = """k AS (SELECT sv_id, sample_id, 'pair' AS kind FROM pr UNION ALL SELECT sv_id, sample_id, way FROM sn UNION ALL SELECT sv_id, sample_id, CASE WHEN cell < 200 THEN 'start' ELSE 'end' END FROM cc),
ec AS (SELECT sv_id, sample_id, count(*) FILTER (kind = 'pair') AS pairs, count(*) FILTER (kind IN ('inward','outward','inverted')) AS splits, count(*) FILTER (kind = 'start') AS clips_start, count(*) FILTER (kind = 'end') AS clips_end FROM k GROUP BY ALL)"""
_ALL = _PAIRS + "," + _SPLITS.removeprefix(_SVC + ",") + "," + _CELLS.removeprefix(_SVC + ",") + ",\n" + _COUNTS


def _counts(spark, d, by=("sample_id",)):
    rows = E.evidence_rows(_of(spark, d, "pair", "filtered"), _of(spark, d, "split", "filtered", "pair"))
    return E.evidence_counts(_sv(spark, d), rows, _clip_rows(spark, d), by)


@query("evidence_counts", S.with_views("sv", "evidence", extra=_ALL) + "SELECT * FROM ec")
def _(spark, d):
    return _counts(spark, d)


@query(
    "evidence_score",
    S.with_views("sv", "evidence", extra=_ALL)
    + """SELECT sv_id, sample_id, round(splits + pairs + (clips_start + clips_end) / 2, 2) AS score,
  CAST(CASE WHEN splits >= 3 OR (svtype = 'INV' AND splits + pairs >= 3) OR (svtype <> 'INV' AND splits + pairs >= 5) OR (clips_start > 0 AND clips_end > 0 AND splits + pairs + (clips_start + clips_end) / 2 >= 5) THEN 1
    WHEN splits + pairs + (clips_start + clips_end) / 2 < 1 THEN 0 ELSE -1 END AS INTEGER) AS gt FROM ec JOIN v USING (sv_id)""",
)
def _(spark, d):
    c = _counts(spark, d).join(_sv(spark, d).select("sv_id", "svtype"), "sv_id")
    gt = E.preliminary_genotype(F.col("splits"), F.col("pairs"), F.col("clips_start"), F.col("clips_end"), F.col("svtype"))
    score = F.col("splits") + F.col("pairs") + (F.col("clips_start") + F.col("clips_end")) / 2
    return c.select("sv_id", "sample_id", F.round(score, 2).alias("score"), F.coalesce(gt, F.lit(-1)).alias("gt"))


@query("evidence_support", S.with_views("sv", "evidence", extra=_ALL) + "SELECT sv_id, CAST(sum(pairs) AS BIGINT) AS pairs, CAST(sum(splits) AS BIGINT) AS splits, sum(pairs) > 4 OR sum(pairs) + sum(splits) > 7 AS supported FROM ec GROUP BY sv_id")
def _(spark, d):
    t = _counts(spark, d, ()).select("sv_id", "pairs", "splits")
    return t.withColumn("supported", (F.col("pairs") > 4) | (F.col("pairs") + F.col("splits") > 7))


@query("split_cluster_hits", S.with_views("sv", "evidence", extra=_SVC) + """SELECT sv_id, sample_id, count(*) AS hits FROM v JOIN evidence x USING (chrnum) WHERE kind = 'split' AND abs(x.pos - v.pos) + abs(x.mate - v."end") <= 600 AND abs(x.pos - v.pos) <= 500 GROUP BY ALL""")
def _(spark, d):
    near = E.near_breakpoints(_sv(spark, d), S.evidence(spark, d).where("kind = 'split'"))
    ds, de = F.abs(F.col("ev.pos") - F.col("sv.pos")), F.abs(F.col("ev.mate") - F.col("sv.end"))
    return near.where((ds + de <= 600) & (ds <= 500)).groupBy("sv.sv_id", "ev.sample_id").agg(F.count("*").alias("hits"))
