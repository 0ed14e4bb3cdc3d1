"""Interval joins against brute force, and the fixtures that decide semantics."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlake.functions import mixture as M
from cohortlake.functions import scalars as X
from cohortlake.operators import depth, evidence, intervals
from cohortlake.plans import genotype
from cohortlake.sources import vcf

SV = "sv_id long, chrnum int, pos int, end int, svtype string, supp int"


def one(spark, columns, row, *exprs):
    return spark.createDataFrame([row], columns).select(*exprs).first()


def test_overlap_joins_against_brute_force(spark):
    rng = np.random.default_rng(7)
    make = lambda n, o: [(o + i, int(c), int(b), int(b + w)) for i, (c, b, w) in enumerate(zip(rng.integers(1, 4, n), rng.integers(0, 3000, n), rng.choice([1, 10, 200, 2500], n), strict=True))]
    a, b = make(300, 0), make(300, 1000)
    la, lb = (spark.createDataFrame(x, "id long, chrnum int, beg int, end int") for x in (a, b))
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[3] > y[2] and y[3] > x[2])
    got = sorted((r.l.id, r.r.id) for r in intervals.overlap_join(la, lb, width=64).collect())
    assert got == want
    semi = {r.id for r in intervals.overlap_semi(la, lb, ["id"]).collect()}
    anti = {r.id for r in intervals.overlap_semi(la, lb, ["id"], anti=True).collect()}
    assert semi == {x for x, _ in want} and semi | anti == {x[0] for x in a} and not semi & anti


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 1000), st.integers(1, 500), st.integers(0, 1000), st.integers(1, 500))
def test_bins_hold_what_overlaps(a, n, b, m):
    of = lambda beg, end: next((f + (beg >> s) for s, f in X.BIN_LEVELS if beg >> s == (end - 1) >> s), 0)
    over = lambda beg, end: {0, *(f + i for s, f in X.BIN_LEVELS for i in range(beg >> s, ((end - 1) >> s) + 1))}
    scale = 40_000
    a, n, b, m = a * scale, n * scale, b * scale, m * scale
    if a + n > b and b + m > a:
        assert of(b, b + m) in over(a, a + n)


def test_chromosome_names(spark):
    names = ["chrX", "Y", "chrM", "MT", "chr1", "22", "chr1_alt", "chr", "", "chr123", None]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(X.chrom_number(F.col("n")).alias("c")).collect()
    assert [r.c for r in rows] == [23, 24, 25, 25, 1, 22, 0, 0, 0, 0, 0]


def test_regions(spark):
    texts = ["c", "c:5", "c:5-9", "c:1,000-2,000", "c:9-5", "c:0-3"]
    rows = [r.r for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.region(F.col("t")).alias("r")).collect()]
    assert [r and (r.beg, r.end) for r in rows] == [(0, 1 << 29), (4, 1 << 29), (4, 9), (999, 2000), None, (0, 3)]


@pytest.mark.parametrize(("cigar", "length", "left", "right"), [("100M", 100, 0, 0), ("5S95M", 95, 5, 0), ("95M5S", 95, 0, 5), ("10S80M10S", 80, 10, 10), ("50M10D50M", 110, 0, 0), ("*", 0, 0, 0), ("5H4I6=7X8N", 21, 0, 0)])
def test_cigars(spark, cigar, length, left, right):
    l, r = X.clip_lengths(F.col("c"))
    got = one(spark, "c string", (cigar,), X.cigar_length(F.col("c")).alias("n"), l.alias("l"), r.alias("r"))
    assert (got.n, got.l, got.r) == (length, left, right)


def test_gc_content(spark):
    for bases, want in (("N" * 10, -1), ("ACGTN", 0.5), ("NNNAC", -1), ("acgt", -1), ("GGGC", 1.0)):
        assert one(spark, "b string", (bases,), X.gc_content(F.col("b")).alias("g")).g == want


def test_centromere_bounds(spark):
    chrom, beg, end = intervals.CENTROMERES[0]
    cases = [(beg - 10, beg - 1, False), (beg - 10, beg, True), (end, end + 5, True), (end + 1, end + 5, False), (beg - 1, end + 1, True), (beg + 1, beg + 2, True)]
    rows = spark.createDataFrame([(chrom, a, b) for a, b, _ in cases], "c int, a int, b int")
    assert [r.x for r in rows.select(intervals.in_centromere(F.col("c"), F.col("a"), F.col("b")).alias("x")).collect()] == [w for *_, w in cases]


def test_merge(spark):
    rows = [(1, 1, 100, 200, "DEL", 2), (2, 1, 101, 201, "DEL", 3), (3, 1, 102, 203, "DEL", 3), (4, 2, 100, 200, "DEL", 1), (5, 1, 500, 600, "DEL", 1), (6, 1, 100, 200, "DUP", 9), (7, 1, 100, 200, "BND", 9)]
    got = intervals.merge_candidates(spark.createDataFrame(rows, SV))
    assert sorted(r.sv_id for r in got.collect()) == [2, 4, 5, 6]
    again = intervals.merge_candidates(got)
    assert sorted(again.collect()) == sorted(got.collect())


def test_best_overlap(spark):
    cand = spark.createDataFrame([(1, 1, 100, 200, "DEL", 0), (2, 1, 300, 400, "DEL", 0), (3, 2, 100, 200, "DEL", 0), (4, 1, 1000, 1100, "DEL", 0)], SV)
    supp = spark.createDataFrame([(10, 1, 100, 190, "DEL", 4), (11, 1, 110, 200, "DEL", 5), (12, 1, 300, 360, "DEL", 6), (13, 1, 100, 200, "DUP", 7), (14, 1, 1100, 1200, "DEL", 8)], SV)
    got = {r.sv_id: (r.best_id, r.overlap) for r in intervals.best_overlap(cand, supp).collect()}
    assert got == {1: (10, 0.9), 2: (None, None), 3: (None, None), 4: (None, None)}


def test_block_edges(spark):
    sv = spark.createDataFrame([(1, 1, 10_000, 60_000, "DEL", 0)], SV)
    points = spark.createDataFrame([(i, 1, p) for i, p in enumerate((9_499, 9_500, 9_999, 10_000, 10_500, 10_501, 60_500, 60_501))], "ev_id long, chrnum int, pos int")
    assert sorted(r.ev.ev_id for r in evidence.near_breakpoints(sv, points).collect()) == [1, 2, 3, 4, 6]


@pytest.mark.parametrize("kind", ["DEL", "DUP", "INV"])
def test_pair_bounds(spark, kind):
    s, e = 10_000, 20_000
    edges = {
        "DEL": [(s - 500, e - 100, 1, 2, True), (s - 501, e, 1, 2, False), (s + 100, e + 499, 1, 2, True), (s + 101, e, 1, 2, False), (s, e + 500, 1, 2, False), (s, e, 0, 2, False)],
        "DUP": [(s - 100, e - 500, 1, 1, True), (s - 101, e, 1, 1, False), (s + 499, e + 100, 1, 1, True), (s + 500, e, 1, 1, False), (s, e + 101, 1, 1, False)],
        "INV": [(s - 500, e - 1, 31, 0, True), (s, e - 1, 31, 0, False), (s - 50, e, 31, 3, True), (s - 51, e, 31, 3, False), (s, e, 30, 3, False), (s, e, 31, 1, False)],
    }[kind]
    rows = spark.createDataFrame([(i, *x[:4]) for i, x in enumerate(edges)], "i int, a int, b int, q int, side int")
    got = rows.orderBy("i").select(evidence.pair_window(F.lit(kind), F.lit(s), F.lit(e), F.col("a"), F.col("b"), F.col("q"), F.col("side")).alias("x")).collect()
    assert [r.x for r in got] == [x[-1] for x in edges]


def test_window_depth_edges(spark):
    rows = spark.createDataFrame([(1, 1, 0, 100), (1, 1, 50, 300), (1, 1, 310, 10_000_000), (2, 1, 999, 100)], "sample_id int, chrnum int, pos int, depth long")
    got = {(r.sample_id, r.bucket): r.dp32 for r in depth.depth_windows(rows, 100).collect()}
    assert len(got) == 20 and got[1, 0] == 64 and got[1, 1] == 0 and got[1, 3] == 65535 and got[2, 9] == 32


@pytest.mark.parametrize("n", [1, 2, 10, 11, 200, 201])
def test_segments_by_inner_buckets(spark, n):
    sv = spark.createDataFrame([(1, 1, 5_050, 5_050 + (n + 1) * 100, "DEL", 0)], SV)
    windows = spark.range(400).select(F.lit(1).alias("sample_id"), F.lit(1).alias("chrnum"), F.col("id").cast("int").alias("bucket"), (F.col("id") * 32).cast("int").alias("dp32"))
    got = depth.segments(sv, windows, 100).collect()
    if n < 2:
        assert not got
    elif n <= 200:
        inner = np.arange(51, 51 + n)
        cut = inner[2:-2] if n > 10 else inner
        half = 51 + n // 2
        assert (got[0].n, got[0]["first"], got[0].second) == (n, cut[cut < half].mean(), cut[cut >= half].mean())
    else:
        assert got[0].whole == pytest.approx((got[0]["first"] + got[0].second) / 2)


def test_vcf_lines(spark):
    lines = ["##x", "", "#CHROM", "chr1\t5\t7\tN\t<DEL>\t.\tPASS\tEND=20;SVTYPE=DEL;SUPP=3", "chrX 9 8 N <DUP> . PASS SVTYPE=DUP", "bad"]
    got = vcf.parse(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert [(r.sv_id, r.chrnum, r.pos, r.end, r.svtype, r.supp) for r in got] == [(7, 1, 5, 20, "DEL", 3), (8, 23, 9, None, "DUP", None)]
    sv = spark.createDataFrame([(1, 24, 5, 50, "INV", 2)], SV)
    same = ("sv_id", "chrnum", "pos", "end", "svtype", "supp")
    assert vcf.parse(vcf.to_lines(sv)).select(*same).collect() == sv.select(*same).collect()
    assert vcf.header(["a", "b"]).endswith("FORMAT\ta\tb")


def test_mixtures():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(1, 0.05, 60), rng.normal(0.5, 0.05, 30), rng.normal(0, 0.05, 10), [9.0]])
    fit = M.em_1d(x, [1.0, 0.5, 0.0])
    assert np.allclose(fit.means[:, 0], [1, 0.5, 0], atol=0.03) and fit.overlap < 0.2
    assert len(M.select([M.em_1d(x, s) for s in ([1.0], [1.0, 0.5], [1.0, 0.5, 0.0])], 0.2).alphas) == 3
    cn = M.copy_number_1d(x[:-1], fit)
    assert (cn[:60] == 2).mean() > 0.95 and (cn[60:90] == 1).mean() > 0.9 and (cn[90:] == 0).mean() > 0.8
    two = M.em_2d(np.stack([x, x], axis=1)[:-1] + rng.normal(0, 0.03, (100, 2)), [1.0, 0.5, 0.0])
    assert np.allclose(two.means[:2, 0], [1, 0.5], atol=0.05) and np.allclose(two.means[2], 0)
    assert M.greedy_clusters(np.array([[0, 0], [1, 2], [50, 50], [2, 1]])) == [(1.0, 1.0, 3), (50.0, 50.0, 1)]


def test_hardy_weinberg(spark):
    hwe = lambda *n: one(spark, "a int, b int, c int", n, genotype.hardy_weinberg(F.col("a"), F.col("b"), F.col("c")).alias("h")).h
    assert hwe(25, 50, 25) == 0 and hwe(50, 0, 50) == 100 and hwe(10, 0, 0) == 0 and hwe(0, 0, 0) is None
