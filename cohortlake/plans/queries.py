"""Queries and SQL of the statistics and of genotyping."""

from __future__ import annotations


import numpy as np
from pyspark.sql import functions as F

from .. import surrogates as S
from ..functions import mixture as M
from ..functions import scalars as X
from ..operators.queries_evidence import _ALL as _EVIDENCE
from ..store import stored
from . import calling as C
from . import genotype as G

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    if sql:
        SQL[name] = sql
    return lambda f: QUERIES.setdefault(name, f)


_MOMENTS = """SELECT sv_id, count(*) AS n, round(avg(depth), 6) AS mean_x, round(avg(cnt), 6) AS mean_y, round(var_pop(depth), 6) AS cxx, round(covar_pop(depth, cnt), 6) AS cxy, round(var_pop(cnt), 6) AS cyy"""


def _six(frame, *columns):
    return frame.withColumns({c: F.round(c, 6) for c in columns})


_M = ("mean_x", "mean_y", "cxx", "cxy", "cyy")


@query("masked_moments", S.with_views("cohort") + _MOMENTS + " FROM cohort WHERE sample_id % 3 <> 0 GROUP BY sv_id")
def _(spark, d):
    return _six(G.moments(S.cohort(spark, d).where(F.col("sample_id") % 3 != 0), ["sv_id"]), *_M)


@query("label_gaussians", S.with_views("cohort") + "SELECT sv_id, label, round(avg(depth), 6) AS mean, round(stddev_pop(depth), 6) AS sd, round(count(*) / sum(count(*)) OVER (PARTITION BY sv_id), 6) AS alpha FROM cohort GROUP BY sv_id, label")
def _(spark, d):
    return _six(G.labelled(S.cohort(spark, d), ["depth"]).select("sv_id", "label", "mean", F.col("spread").alias("sd"), "alpha"), "mean", "sd", "alpha")


@query("label_gaussians_2d", S.with_views("cohort") + _MOMENTS.replace("sv_id,", "sv_id, label,", 1) + " FROM cohort GROUP BY sv_id, label")
def _(spark, d):
    return _six(G.labelled(S.cohort(spark, d), ["depth", "cnt"]).drop("alpha", "overlap", "falls"), *_M)


@query("simple_reducers", S.with_views("cohort") + "SELECT sv_id, round(avg(depth), 6) AS mean, round(CASE WHEN count(*) <= 1 THEN 0.01 ELSE stddev_pop(depth) END, 6) AS sd, round(min(depth), 6) AS lo, round(max(depth), 6) AS hi, round(median(depth), 6) AS med FROM cohort GROUP BY sv_id")
def _(spark, d):
    return _six(G.reducers(S.cohort(spark, d)), "mean", "sd", "lo", "hi", "med")


_GT = "g AS (SELECT sv_id, sample_id, CAST(CASE WHEN abs(depth - 1 + 0.5 * label) > 0.05 THEN -1 ELSE label END AS INTEGER) AS gt FROM cohort)"


def _gt(spark, d):
    far = F.abs(F.col("depth") - 1 + 0.5 * F.col("label")) > 0.05
    return S.cohort(spark, d).select("sv_id", "sample_id", F.when(far, -1).otherwise(F.col("label")).alias("gt"))


_COUNTS = _GT + """, c AS (SELECT sv_id, count(*) FILTER (gt < 0) AS n_miss, count(*) FILTER (gt = 0) AS n_ref, count(*) FILTER (gt = 1) AS n_het, count(*) FILTER (gt = 2) AS n_hom, count(*) AS n FROM g GROUP BY sv_id)"""


@query("genotype_counts", S.with_views("cohort", extra=_COUNTS) + "SELECT sv_id, n_miss, n_ref, n_het, n_hom, n_het + 2 * n_hom AS ac, n_ref + n_het + n_hom AS ns, round((n_ref + n_het + n_hom) / n, 6) AS callrate, round((n_het + 2 * n_hom) / (2 * (n_ref + n_het + n_hom)), 6) AS af FROM c")
def _(spark, d):
    return G.genotype_counts(_gt(spark, d)).drop("hwe").withColumns({c: F.round(c, 6) for c in ("callrate", "af")})


@query("hwe_chisq", S.with_views("cohort", extra=_COUNTS + ", f AS (SELECT *, (n_ref + n_het + n_hom)::DOUBLE AS m, (2 * n_ref + n_het) / (2.0::DOUBLE * (n_ref + n_het + n_hom)) AS p, (n_het + 2 * n_hom) / (2.0::DOUBLE * (n_ref + n_het + n_hom)) AS q FROM c)") + """SELECT sv_id, round(CASE WHEN p > 0 THEN pow(m * p * p - n_ref, 2) / (m * p * p) ELSE 0 END + CASE WHEN p * q > 0 THEN pow(m * 2 * p * q - n_het, 2) / (m * 2 * p * q) ELSE 0 END + CASE WHEN q > 0 THEN pow(m * q * q - n_hom, 2) / (m * q * q) ELSE 0 END, 4) AS hwe FROM f""")
def _(spark, d):
    return G.genotype_counts(_gt(spark, d)).select("sv_id", F.round("hwe", 4).alias("hwe"))


@query("biallelic", S.with_views("cohort") + "SELECT sv_id, min(cn) >= 0 AND max(cn) <= 2 AS biallelic FROM (SELECT sv_id, CAST(round(2 * depth) AS INTEGER) AS cn FROM cohort) GROUP BY sv_id")
def _(spark, d):
    cn = F.round(2 * F.col("depth")).cast("int")
    return S.cohort(spark, d).withColumn("cn", cn).groupBy("sv_id").agg(((F.min("cn") >= 0) & (F.max("cn") <= 2)).alias("biallelic"))


@query("bhattacharyya", S.with_views("cohort", extra="m AS (SELECT sv_id, label, avg(depth) AS mu, var_pop(depth) AS v FROM cohort GROUP BY ALL)") + "SELECT a.sv_id, round(max(exp(-0.25 * pow(a.mu - b.mu, 2) / (a.v + b.v) - 0.5 * ln((a.v + b.v) / (2 * sqrt(a.v * b.v))))), 6) AS overlap FROM m a JOIN m b ON a.sv_id = b.sv_id AND a.label < b.label GROUP BY a.sv_id")
def _(spark, d):
    return _six(G.labelled(S.cohort(spark, d), ["depth"]).select("sv_id", "overlap").distinct(), "overlap")


_B2 = """m AS (SELECT sv_id, label, avg(depth) AS mx, avg(depth2) AS my, var_pop(depth) AS xx, covar_pop(depth, depth2) AS xy, var_pop(depth2) AS yy FROM cohort GROUP BY ALL),
p AS (SELECT a.sv_id, a.mx - b.mx AS m1, a.my - b.my AS m2, (a.xx + b.xx) / 2 AS cx, (a.xy + b.xy) / 2 AS cm, (a.yy + b.yy) / 2 AS cy, sqrt((a.xx * a.yy - a.xy * a.xy) * (b.xx * b.yy - b.xy * b.xy)) AS s FROM m a JOIN m b ON a.sv_id = b.sv_id AND a.label < b.label),
q AS (SELECT *, cx * cy - cm * cm AS det FROM p)"""


@query("bhattacharyya_2d", S.with_views("cohort", extra=_B2) + "SELECT sv_id, round(exp(-min(0.125 * (m1 * cy / det - m2 * cm / det) * m1 + (m2 * cx / det - m1 * cm / det) * m2 + 0.5 * ln(det / s))), 4) AS overlap FROM q GROUP BY sv_id")
def _(spark, d):
    fits = G.labelled(S.cohort(spark, d), ["depth", "depth2"])
    return fits.select("sv_id", F.round("overlap", 4).alias("overlap")).distinct()


# three fixed components for assignment: means 1, 0.5, 0 with sd 0.1
_COMPONENTS = ((1.0, 0.1), (0.5, 0.1), (0.0, 0.1))
_DENS = "d AS (SELECT sv_id, sample_id, depth, label, " + ", ".join(f"exp(-0.5 * pow((depth - {m}) / {s}, 2)) / ({s} * sqrt(2 * pi())) AS p{i}" for i, (m, s) in enumerate(_COMPONENTS)) + " FROM cohort)"


def _fixed(second: list[float] | None = None) -> M.Mixture:
    """The three components, in one dimension or with the second coordinate's means."""
    means, alphas = np.array([m for m, _ in _COMPONENTS]), np.full(3, 1 / 3)
    if second is None:
        return M.Mixture(means[:, None], np.array([s for _, s in _COMPONENTS]), alphas, 0.0, 0.0)
    return M.Mixture(np.stack([means, second], axis=1), np.array([s * s * np.eye(2) for _, s in _COMPONENTS]), alphas, 0.0, 0.0)


_BEST = "greatest(p0, p1, p2)"
_CLOSE = "list_sort([p0, p1, p2])[2] / greatest(p0, p1, p2) > 0.1"
_COMP = f"CASE {_BEST} WHEN p0 THEN 0 WHEN p1 THEN 1 ELSE 2 END"


@query("assign_cluster", S.with_views("cohort", extra=_DENS) + f"SELECT sv_id, sample_id, CAST(CASE WHEN {_CLOSE} THEN -1 ELSE {_COMP} END AS INTEGER) AS comp FROM d")
def _(spark, d):
    return G.assigned(S.cohort(spark, d), ["depth"], _fixed(), M.cluster_1d, "comp")


@query("assign_cn", S.with_views("cohort", extra=_DENS) + f"SELECT sv_id, sample_id, CAST(CASE WHEN {_CLOSE} OR (2 - {_COMP} <> floor(2 * depth) AND 2 - {_COMP} <> ceil(2 * depth)) THEN -1 ELSE 2 - {_COMP} END AS INTEGER) AS cn FROM d")
def _(spark, d):
    return G.assigned(S.cohort(spark, d), ["depth"], _fixed(), M.copy_number_1d, "cn")


_D2 = "d AS (SELECT sv_id, sample_id, depth, depth2, cnt, " + ", ".join(f"exp(-0.5 * (pow((depth - {m}) / {s}, 2) + pow(({{y}} - {{m{i}}}) / {s}, 2))) AS p{i}" for i, (m, s) in enumerate(_COMPONENTS)) + " FROM cohort)"


@query("assign_cn_2d", S.with_views("cohort", extra=_D2.format(y="depth2", m0=1.0, m1=0.5, m2=0.0)) + f"SELECT sv_id, sample_id, CAST(CASE WHEN {_CLOSE} OR (2 - {_COMP} <> floor(depth + depth2) AND 2 - {_COMP} <> ceil(depth + depth2)) THEN -1 ELSE 2 - {_COMP} END AS INTEGER) AS cn FROM d")
def _(spark, d):
    return G.assigned(S.cohort(spark, d), ["depth", "depth2"], _fixed([1.0, 0.5, 0.0]), M.copy_number_2d, "cn")


@query("assign_dpcnt", S.with_views("cohort", extra=_D2.format(y="cnt", m0=0.0, m1=0.15, m2=0.3)) + f"SELECT sv_id, sample_id, CAST(CASE WHEN {_CLOSE.replace('0.1', '0.2')} THEN -1 ELSE 2 - {_COMP} END AS INTEGER) AS cn FROM d")
def _(spark, d):
    return G.assigned(S.cohort(spark, d), ["depth", "cnt"], _fixed([0.0, 0.15, 0.3]), M.copy_number_by_first, "cn")


@query("mixture_bic", S.with_views("cohort", extra=_DENS) + "SELECT sv_id, round(-sum(ln((p0 + p1 + p2) / 3)) + 0.5 * 8 * ln(count(*)), 4) AS bic, round(-sum(ln((p0 + p1 + p2) / 3)) + 8, 4) AS aic FROM d GROUP BY sv_id")
def _(spark, d):
    return G.scored(S.cohort(spark, d), _fixed()).withColumns({c: F.round(c, 4) for c in ("bic", "aic")})


@query("del_labels", S.with_views("cohort") + "SELECT sv_id, sample_id, CAST(CASE WHEN depth <= 0.65 AND cnt >= 0.1 THEN CASE WHEN depth < 0.2 THEN 2 ELSE 1 END WHEN cnt < 0.05 AND depth > 0.85 THEN 0 ELSE -1 END AS INTEGER) AS label FROM cohort")
def _(spark, d):
    return S.cohort(spark, d).select("sv_id", "sample_id", F.coalesce(G.deletion_label(F.col("depth"), F.col("cnt")), F.lit(-1)).alias("label"))


@query("dup_labels", S.with_views("cohort", extra="u AS (SELECT sv_id, sample_id, 2 - depth AS depth, cnt FROM cohort)") + "SELECT sv_id, sample_id, CAST(CASE WHEN depth >= 1.35 AND cnt >= 0.1 THEN CASE WHEN depth > 1.85 THEN round(2 * depth) - 2 ELSE 1 END WHEN cnt < 0.05 AND depth > 0.8 AND depth < 1.2 THEN 0 ELSE -1 END AS INTEGER) AS label FROM u")
def _(spark, d):
    return S.cohort(spark, d).select("sv_id", "sample_id", F.coalesce(G.gain_label(2 - F.col("depth"), F.col("cnt")), F.lit(-1)).alias("label"))


@query("shape_test", S.with_views("cohort", extra="m AS (SELECT sv_id, avg(depth) FILTER (label = 0) AS a, avg(depth) FILTER (label = 1) AS b, avg(depth) FILTER (label = 2) AS c FROM cohort GROUP BY sv_id)") + "SELECT sv_id, a BETWEEN 0.8 AND 1.2 AND b BETWEEN 0.4 AND 0.65 AND a - b >= 0.3 AND b - c >= 0.3 AS ok FROM m")
def _(spark, d):
    return G.labelled(S.cohort(spark, d), ["depth"]).select("sv_id", F.col("falls").alias("ok")).distinct()


_CN2 = _DENS + f""", one AS (SELECT sv_id, sample_id, CASE WHEN {_CLOSE} THEN -1 ELSE 2 - {_COMP} END AS a FROM d),
d2 AS (SELECT sv_id, sample_id, {", ".join(f"exp(-0.5 * (pow((depth - {m}) / {s}, 2) + pow((depth2 - {m}) / {s}, 2))) AS p{i}" for i, (m, s) in enumerate(_COMPONENTS))} FROM cohort),
two AS (SELECT sv_id, sample_id, CASE WHEN {_CLOSE} THEN -1 ELSE 2 - {_COMP} END AS b FROM d2)"""


@query("cn_combine", S.with_views("cohort", extra=_CN2) + "SELECT sv_id, sample_id, CAST(CASE WHEN a < 0 THEN b WHEN b < 0 THEN a ELSE round((a + b) / 2) END AS INTEGER) AS cn FROM one JOIN two USING (sv_id, sample_id)")
def _(spark, d):
    by = lambda x, fit: np.where((c := M.copy_number_by_first(x, fit, 0.1)) < 0, -1, c)
    one = G.assigned(S.cohort(spark, d).withColumn("_zero", F.lit(0.0)), ["depth", "_zero"], _fixed([0.0, 0.0, 0.0]), by, "a")
    two = G.assigned(S.cohort(spark, d), ["depth", "depth2"], _fixed([1.0, 0.5, 0.0]), by, "b")
    return one.join(two, ["sv_id", "sample_id"]).select("sv_id", "sample_id", X.combined_copies(F.col("a"), F.col("b")).alias("cn"))


@query("cn_flank_filter", S.with_views("cohort", extra="f AS (SELECT sv_id, avg(depth2) AS m, stddev_pop(depth2) AS s FROM cohort GROUP BY sv_id)") + "SELECT sv_id, sample_id, CAST(CASE WHEN abs(depth2 - m) > 2 * s OR (label > 0 AND abs(depth - depth2) < 2 * s) THEN -1 ELSE label END AS INTEGER) AS cn FROM cohort JOIN f USING (sv_id)")
def _(spark, d):

    def one(rows):
        label = rows["label"].to_numpy()
        off = G.off_flank(rows["depth"].to_numpy(float), label, rows["depth2"].to_numpy(float))
        return rows[["sv_id", "sample_id"]].assign(cn=[-1 if o else int(c) for o, c in zip(off, label, strict=True)])

    return G.per_variant(S.cohort(spark, d).select("sv_id", "sample_id", "depth", "depth2", "label"), one, "sv_id long, sample_id long, cn int")


@query("find_peak", S.with_views("evidence", extra="""h AS (SELECT sample_id, pos // 20000 AS b, count(*) AS n FROM evidence GROUP BY ALL),
k AS (SELECT sample_id, b, (coalesce(lag(n) OVER w, 0) * 0.5 + n + coalesce(lead(n) OVER w, 0) * 0.5) / 2 AS s FROM h WINDOW w AS (PARTITION BY sample_id ORDER BY b)),
p AS (SELECT *, lag(s) OVER w AS l, lead(s) OVER w AS r, sqrt(avg(s * s) OVER (PARTITION BY sample_id)) AS rms FROM k WINDOW w AS (PARTITION BY sample_id ORDER BY b))""") + "SELECT sample_id, CAST(arg_min(b, -s * 1000000 + b) AS INTEGER) AS bucket FROM p WHERE s >= rms AND s > coalesce(l, -1) AND s >= coalesce(r, -1) GROUP BY sample_id")
def _(spark, d):
    from pyspark.sql.window import Window

    h = S.evidence(spark, d).groupBy("sample_id", F.expr("pos div 20000").cast("int").alias("b")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("sample_id").orderBy("b")
    none = F.lit(0)
    s = (F.coalesce(F.lag("n").over(w), none) * 0.5 + F.col("n") + F.coalesce(F.lead("n").over(w), none) * 0.5) / 2
    k = h.withColumn("s", s)
    k = k.withColumns({"l": F.coalesce(F.lag("s").over(w), F.lit(-1)), "r": F.coalesce(F.lead("s").over(w), F.lit(-1)), "rms": F.sqrt(F.avg(F.col("s") * F.col("s")).over(Window.partitionBy("sample_id")))})
    best = F.min_by("b", F.struct((-F.col("s")).alias("s"), "b"))
    return k.where("s >= rms and s > l and s >= r").groupBy("sample_id").agg(best.alias("bucket"))


@query("ro_components", S.with_views("sv", extra="""e AS MATERIALIZED (SELECT a.sv_id AS u, b.sv_id AS v FROM sv a JOIN sv b ON a.chrnum = b.chrnum AND a.svtype = b.svtype AND a.sv_id <> b.sv_id AND a."end" > b.pos AND b."end" > a.pos
  WHERE (least(a."end", b."end") - greatest(a.pos, b.pos)) / (greatest(a."end", b."end") - least(a.pos, b.pos)) > 0.7),
r AS (SELECT sv_id AS u, sv_id AS v FROM sv UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)""").replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT u AS sv_id, min(v) AS component FROM r GROUP BY u")
def _(spark, d):
    from ..operators import graph

    return graph.overlap_components(S.sv(spark, d))


@query("intervals_to_vcf", S.with_views("sv") + """SELECT concat_ws(chr(9), 'chr' || CASE chrnum WHEN 23 THEN 'X' WHEN 24 THEN 'Y' ELSE CAST(chrnum AS VARCHAR) END, CAST(pos AS VARCHAR), CAST(sv_id AS VARCHAR), '.', '<' || svtype || '>', '.', 'PASS',
  'SVTYPE=' || svtype || ';END=' || CAST("end" AS VARCHAR) || ';SVLEN=' || CAST("end" - pos + 1 AS VARCHAR) || ';SUPP=' || CAST(supp AS VARCHAR)) AS line FROM sv""")
def _(spark, d):
    from ..sources import vcf

    return vcf.to_lines(S.sv(spark, d))


@query("vcf_scan", S.with_views("sv") + 'SELECT sv_id, chrnum, pos, "end", svtype FROM sv')
def _(spark, d):
    from ..sources import vcf

    return vcf.parse(vcf.to_lines(S.sv(spark, d))).select("sv_id", "chrnum", "pos", "end", "svtype")


@query("vcf_to_intervals", S.with_views("sv") + 'SELECT CAST(CASE svtype WHEN \'DEL\' THEN 0 WHEN \'DUP\' THEN 1 WHEN \'INV\' THEN 2 WHEN \'CNV\' THEN 3 WHEN \'INS\' THEN 4 ELSE 5 END AS INTEGER) AS code, chrnum, pos, "end" FROM sv')
def _(spark, d):
    from ..sources import vcf

    rows = vcf.parse(vcf.to_lines(S.sv(spark, d)))
    return rows.select(X.type_code(F.col("svtype")).cast("int").alias("code"), "chrnum", "pos", "end")


_CELL = """(CASE gt WHEN 0 THEN '0/0' WHEN 1 THEN '0/1' WHEN 2 THEN '1/1' ELSE './.' END || ':' || CASE WHEN gt < 0 THEN '.' ELSE CAST(2 - gt AS VARCHAR) END || printf(':%.2f:%.2f:%.2f,%.2f,%.2f,%.2f', depth, 20 * depth, 1.0::DOUBLE, depth, depth2, 1.0::DOUBLE)
  || ':' || CAST(CAST(floor(10 * cnt) AS INTEGER) AS VARCHAR) || ':' || CAST(CAST(floor(10 * cnt) AS INTEGER) AS VARCHAR) || ':0:0')"""


@query("vcf_render", S.with_views("cohort", extra=_GT) + f"SELECT sv_id, string_agg({_CELL}, chr(9) ORDER BY sample_id) AS samples FROM g JOIN cohort USING (sv_id, sample_id) GROUP BY sv_id")
def _(spark, d):
    rows = _cohort_table(spark, d, "DEL").drop("gt").join(_gt(spark, d), ["sv_id", "sample_id"]).withColumn("gt", F.when(F.col("gt") >= 0, F.col("gt"))).withColumn("cn", 2 - F.col("gt"))
    rows = rows.withColumns({c: F.col(f"given_{c}") for c in C.COUNTS})
    rows = rows.groupBy("sv_id").agg(F.sort_array(F.collect_list(F.struct("sample_id", C.sample_cell(F.col("svtype")).alias("c")))).alias("a"))
    return rows.select("sv_id", F.array_join(F.transform("a", lambda x: x["c"]), "\t").alias("samples"))


def _cohort_table(spark, d, kind: str | None = None):
    """The cohort view as a table of calls: one type, or four in turn; gains turn the depth around. Every third variant has split reads' breakpoints."""
    c = S.cohort(spark, d)
    names = F.array(*map(F.lit, C.KINDS))
    c = c.withColumn("svtype", F.lit(kind) if kind else F.get(names, (F.col("sv_id") % 4).cast("int")))
    gain = F.col("svtype").isin("DUP", "CNV")
    turned = lambda x: F.when(gain, 2 - F.col(x)).otherwise(F.col(x))
    reads = F.floor(10 * F.col("cnt")).cast("int")
    split = F.col("sv_id") % 3 == 0
    return c.select(
        "sv_id", "sample_id", "svtype", F.lit(20.0).alias("avg_dp"), (20 * turned("depth")).alias("raw"), turned("depth").alias("depth"), F.lit(1.0).alias("pre"), F.lit(1.0).alias("post"),
        turned("depth").alias("first"), turned("depth2").alias("second"), split.alias("has_split"), F.lit(False).alias("has_clip"),
        *[(reads if n < 2 else F.lit(0)).alias(f"{a}_{x}") for a in ("given", "split") for n, x in enumerate(C.COUNTS)], *[F.lit(0).alias(f"clip_{x}") for x in C.COUNTS],
    )


_EM_P = ", ".join(f"a{c} * exp(-0.5 * pow((depth - m{c}) / greatest(s{c}, 1e-4), 2)) / (greatest(s{c}, 1e-4) * sqrt(2 * pi())) AS p{c}" for c in range(3))
_EM_STATE = ", ".join(f"CAST({v} AS DOUBLE) AS {n}{c}" for n, vs in (("m", (1.0, 0.5, 0.0)), ("s", (0.1, 0.1, 0.1)), ("a", (1 / 3, 1 / 3, 1 / 3))) for c, v in enumerate(vs))
_EM_SUMS = ", ".join(f"sum(CASE WHEN t >= 1e-20 THEN p{c} / t ELSE 0 END) AS w{c}, sum(CASE WHEN t >= 1e-20 THEN p{c} / t * depth ELSE 0 END) AS x{c}, sum(CASE WHEN t >= 1e-20 THEN p{c} / t * depth * depth ELSE 0 END) AS q{c}" for c in range(3))
_EM_MEAN = {c: f"((x{c} + {v} * 0.2::DOUBLE) / (w{c} + 0.2::DOUBLE))" for c, v in enumerate((1.0, 0.5, 0.0))}
_EM_STEP = ", ".join(
    [f"{m} AS m{c}" for c, m in _EM_MEAN.items()]
    + [f"sqrt((q{c} - 2 * {m} * x{c} + {m} * {m} * w{c} + 0.002::DOUBLE) / (w{c} + 0.2::DOUBLE)) AS s{c}" for c, m in _EM_MEAN.items()]
    + [f"(w{c} + 0.2::DOUBLE) / (w0 + w1 + w2 + 0.6::DOUBLE) AS a{c}" for c in range(3)]
)
_EM = f"""r AS (SELECT 0 AS i, sv_id, {_EM_STATE} FROM (SELECT DISTINCT sv_id FROM cohort)
  UNION ALL SELECT i + 1 AS i, sv_id, {_EM_STEP} FROM (SELECT i, sv_id, {_EM_SUMS} FROM (SELECT *, p0 + p1 + p2 AS t FROM (SELECT r.*, depth, {_EM_P} FROM r JOIN cohort USING (sv_id) WHERE i < 15)) GROUP BY i, sv_id)),
last AS (SELECT * FROM r WHERE i = 15), dens AS (SELECT sv_id, sum(CASE WHEN t > 0 THEN ln(t) ELSE 0 END) AS ll, count(*) AS n FROM (SELECT *, p0 + p1 + p2 AS t FROM (SELECT last.*, depth, {_EM_P} FROM last JOIN cohort USING (sv_id))) GROUP BY sv_id)"""


def _rounded(fits):
    return fits.withColumns({c: F.round(c, 5) for c in ("mean", "spread", "alpha", "bic")})


@query("em_1d", S.with_views("cohort", extra=_EM).replace("WITH ", "WITH RECURSIVE ", 1) + " UNION ALL ".join(f"SELECT sv_id, {c} AS comp, round(m{c}, 5) AS mean, round(s{c}, 5) AS spread, round(a{c}, 5) AS alpha, round(-ll + 4 * ln(n), 5) AS bic FROM last JOIN dens USING (sv_id)" for c in range(3)))
def _(spark, d):
    return _rounded(G.fitted(S.cohort(spark, d), 1, [[1.0, 0.5, 0.0]]).drop("overlap"))


@query("em_1d_sums", SQL["em_1d"])
def _(spark, d):
    return _rounded(G.fitted_by_sums(S.cohort(spark, d), [1.0, 0.5, 0.0]))


@query("em_2d")
def _(spark, d):
    return G.fitted(S.cohort(spark, d), 2, [[1.0, 0.5, 0.0]])


@query("model_select")
def _(spark, d):
    return G.fitted(S.cohort(spark, d), 1, G.DEL_STARTS)


_KM_LABEL = "CASE least(abs(depth - m0), abs(depth - m1), abs(depth - m2)) WHEN abs(depth - m0) THEN 0 WHEN abs(depth - m1) THEN 1 ELSE 2 END"
_KM_STEP = ", ".join(f"(sum(CASE WHEN l = {c} THEN depth ELSE 0 END) + {v} * 0.2::DOUBLE) / (count(*) FILTER (l = {c}) + 0.2::DOUBLE) AS m{c}" for c, v in enumerate((1.0, 0.5, 0.0)))
_KM = f"""r AS (SELECT 0 AS i, sv_id, 1.0::DOUBLE AS m0, 0.5::DOUBLE AS m1, 0.0::DOUBLE AS m2 FROM (SELECT DISTINCT sv_id FROM cohort)
  UNION ALL SELECT i + 1 AS i, sv_id, {_KM_STEP} FROM (SELECT r.*, depth, {_KM_LABEL} AS l FROM r JOIN cohort USING (sv_id) WHERE i < 14) GROUP BY i, sv_id)"""


@query("kmeans_1d", S.with_views("cohort", extra=_KM).replace("WITH ", "WITH RECURSIVE ", 1) + f"SELECT sv_id, sample_id, {_KM_LABEL} AS label FROM cohort JOIN r USING (sv_id) WHERE i = 14")
def _(spark, d):
    return G.kmeans_labels(S.cohort(spark, d))


def _calls(spark, d):
    return C.call(_cohort_table(spark, d))


@query("genotype_calls")
def _(spark, d):
    return _calls(spark, d).select("sv_id", "sample_id", "gt", "cn", "method")


@query("call_method")
def _(spark, d):
    return _calls(spark, d).groupBy("sv_id").agg(F.first("method").alias("method"), F.first("fit").alias("fit"), F.count("gt").alias("called"))


@query("genotype_records")
def _(spark, d):
    """The whole plan over the views: candidates, variant and window depth, evidence, GC; every line reported."""
    from ..operators import depth as D
    from ..operators import queries_depth as QD
    from ..operators import queries_evidence as Q

    hour = 3600
    points, ev = S.depth_pos(spark, d), S.evidence(spark, d)
    sv = Q._sv(spark, d)
    samples = points.groupBy("sample_id").agg((F.avg("depth") / 100).alias("avg_dp"))
    depth = D.variant_depth(sv, points)
    gc = D.sv_gc_content(QD.small(spark, d), D.gc_profile(S.genome(spark, d)))
    kind = lambda *k: ev.where(F.col("kind").isin(*k))
    # the view's depths are amounts, far above what the depth gate lets pass: a tenth
    tenth = lambda rows, name: stored(rows.withColumn("dp32", (F.col("dp32") / 10).cast("int")), name)
    samples = samples.withColumn("avg_dp", F.col("avg_dp") / 10)
    parts = C.genotype(sv, samples, tenth(depth, "variant_depth"), tenth(D.depth_windows(points, hour), "windows"), kind("pair", "filtered"), kind("split", "filtered", "pair"), kind("lclip", "rclip"), gc, width=hour)
    return C.records(*parts, report_all=True)


_GIVEN_HITS = """hit AS (SELECT sv_id, sample_id, 's' AS k FROM sn JOIN v USING (sv_id) WHERE abs(sn.start - v.pos) + abs(sn."end" - v."end") <= 6
  UNION ALL SELECT sv_id, sample_id, 'p' FROM (SELECT pr.*, svtype, pr.pos - self AS dx, mate - pr."end" AS dy FROM pr JOIN v USING (sv_id))
    WHERE CASE WHEN svtype <> 'INV' THEN dx > 75 AND dx < 375 AND dy > -75 AND dy < 300 WHEN side = 0 THEN dx > 50 AND dx < 400 AND dy < -50 AND dy > -400 WHEN side = 3 THEN dx < 50 AND dx > -375 AND dy > -50 AND dy < 375 ELSE false END
  UNION ALL SELECT sv_id, sample_id, CASE WHEN cell < 200 THEN 'b' ELSE 'e' END FROM (SELECT cc.*, svtype, svtype IN ('DUP', 'CNV') AS gain FROM cc JOIN v USING (sv_id))
    WHERE (svtype = 'INV' OR kind = CASE WHEN gain = (cell < 200) THEN 'lclip' ELSE 'rclip' END) AND (cell % 200) BETWEEN 97 AND CASE WHEN gain THEN 102 ELSE 103 END)"""


@query("given_counts", S.with_views("sv", "evidence", extra=_EVIDENCE + ",\n" + _GIVEN_HITS) + """SELECT sv_id, 'given' AS attempt, sample_id, CAST(count(*) FILTER (k = 's') AS INTEGER) AS splits, CAST(count(*) FILTER (k = 'p') AS INTEGER) AS pairs,
  CAST(count(*) FILTER (k = 'b') AS INTEGER) AS start_clips, CAST(count(*) FILTER (k = 'e') AS INTEGER) AS end_clips FROM hit GROUP BY sv_id, sample_id""")
def _(spark, d):
    """What the plan counts near each candidate's own breakpoints."""
    from ..operators import evidence as E
    from ..operators import queries_evidence as Q

    sv, rows = Q._sv(spark, d), E.evidence_rows(Q._of(spark, d, "pair", "filtered"), Q._of(spark, d, "split", "filtered", "pair"))
    given = sv.select("sv_id", F.lit("given").alias("attempt"), F.lit(0).alias("idx"), F.col("pos").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.lit(1).alias("n"))
    return C.attempt_counts(sv, given, E.evidence_near(sv, rows), Q._clip_rows(spark, d))


def _breaks(spark, d):
    """Split reads of the view, on a grid coarse enough that a variant's reads agree."""
    e = S.evidence(spark, d).where("kind = 'split'")
    step = 2_000
    return e.select((F.floor(F.col("pos") / 200_000)).alias("sv_id"), F.col("sample_id"), (F.floor(F.col("pos") / step) * 4).cast("double").alias("start"), (F.floor(F.col("mate") / step / 50) * 4).cast("double").alias("end"))


@query("split_consensus")
def _(spark, d):
    return G.consensus(_breaks(spark, d), least=2)


@query("modal_cluster")
def _(spark, d):
    return G.modal_cluster(G.consensus(_breaks(spark, d), least=2))


@query("model_select_dpcnt")
def _(spark, d):
    return G.joint_fit(S.cohort(spark, d))


@query("inv_assign")
def _(spark, d):
    return C.call(_cohort_table(spark, d, "INV")).select("sv_id", "sample_id", "gt", "method")


@query("clip_consensus")
def _(spark, d):
    from ..operators import queries_evidence as E

    # the view's clips are thin: variants of 400 ids together, cells of ten bases
    cells = E.E.grouped_cells(E._sv(spark, d), E._clip_rows(spark, d), (F.floor(F.col("sv_id") / 400) * 3), 10)
    sv = E._sv(spark, d).select((F.floor(F.col("sv_id") / 400) * 3).alias("sv_id")).distinct()
    sv = sv.select("sv_id", F.get(F.array(*map(F.lit, ("DEL", "DUP", "INV"))), (F.col("sv_id") / 3 % 3).cast("int")).alias("svtype"), F.lit(10_000).alias("pos"), F.lit(20_000).alias("end"))
    return G.cohort_clusters(C.modal_points(sv, cells, least=1))


@query(
    "stream_windows",
    S.with_views("depth_pos") + "SELECT chrnum, CAST(pos // 3600 AS INTEGER) AS bucket, count(*) AS n, CAST(sum(depth) AS BIGINT) AS total FROM depth_pos GROUP BY ALL",
)
def _(spark, d):
    from ..streaming import buckets

    return buckets.replay(spark, f"{d}/events.parquet", 3600)


@query("sam_scan", S.with_views("reads") + "SELECT read_id, part, flag, chrnum, pos, mapq, cigar, mate_pos, isize, mq, nm, sa FROM reads")
def _(spark, d):
    from ..sources import sam

    return sam.parse(sam.to_lines(S.reads(spark, d))).drop("mate_chrnum")
