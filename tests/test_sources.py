"""Readers and sinks, and the pileup plan from reads to tables."""

import pytest
from pyspark.sql import functions as F

from cohortlake.functions.scalars import gc_content
from cohortlake.operators import depth as D
from cohortlake.operators import scan
from cohortlake.plans import pileup
from cohortlake.sources import sam, tables, vcf


def test_repeated_and_missing_info_keys(spark):
    lines = ["chr1\t5\t7\tN\t<DEL>\t.\tPASS\tEND=20;SVTYPE=DEL;END=21;SUPP=3;SUPP_VEC=0110;CHR2=chr2", "chr2 9 8 N <DUP> . PASS SVTYPE=DUP;END=;CIEND=5", "X 9 8 N <DUP> . PASS MYEND=4;SVTYPE=DUP;END=40;CHR2=X"]
    got = vcf.parse(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert [tuple(r) for r in got] == [(7, 1, 5, 21, "DEL", 3, 2, "0110"), (8, 2, 9, None, "DUP", None, 2, None), (8, 23, 9, 40, "DUP", None, 23, None)]
    kept = vcf.filter_candidates(vcf.parse(spark.createDataFrame([(x,) for x in lines], "line string")))
    assert [r.chrnum for r in kept.collect()] == [23]


def test_supported_lines(spark):
    rows = spark.createDataFrame([(1, 1, 5, 90, "DEL", 2, "01", 1, 6, 91, 4), (2, 3, 7, 80, "INV", None, None, None, None, None, None)], "sv_id long, chrnum int, pos int, end int, svtype string, supp int, supp_vec string, sup_chrnum int, sup_pos int, sup_end int, sup_supp int")
    assert [r.line.split("\t")[7] for r in vcf.supported_lines(rows).collect()] == ["SVTYPE=DEL;OVERLAP=1:6-91;SUPP=4;N=2;END=90;SUPP_VEC=01", "SVTYPE=INV;SUPP=1;N=0;END=80;SUPP_VEC="]


def test_header():
    lines = vcf.header(["a", "b", "c"], {1: 1000, 23: 500}, {"b"}).split("\n")
    assert lines[0] == "##fileformat=VCFv4.1" and "##contig=<ID=chr1,length=1000>" in lines and "##contig=<ID=chrX,length=500>" in lines and "##contig=<ID=chr2>" in lines
    assert lines[-1].endswith("FORMAT\ta\tc") and len(set(lines)) == len(lines) and sum(x.startswith("##FORMAT") for x in lines) == 9 and all(x.startswith("#") for x in lines)


def test_reheader(spark, tmp_path):
    (tmp_path / "body.txt").write_text("#old\n#older\nchr1\t1\n#not a header\nchr1\t2\n")
    (tmp_path / "head.txt").write_text("#new\n#newer\n#newest\n")
    new = vcf.reheader(tables.numbered(spark, str(tmp_path / "body.txt")), tables.numbered(spark, str(tmp_path / "head.txt")))
    assert [r.line for r in new.orderBy("place").collect()] == ["#new", "#newer", "#newest", "chr1\t1", "#not a header", "chr1\t2"]


@pytest.mark.parametrize("split", [64, 1 << 20])
def test_fasta(spark, tmp_path, split):
    contigs = {"chr1": "ACGT" * 90 + "A", "chr2": "", "chrX": "GATTACA" * 57, "chr7": "C"}
    text = "".join(f">{name} some words\n" + "".join(seq[i : i + 60] + "\n" for i in range(0, len(seq), 60)) for name, seq in contigs.items())
    (tmp_path / "genome.fa").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        got = {(r.chrnum, r.bucket): r.bases for r in tables.read_fasta(spark, str(tmp_path / "genome.fa")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    number = {"chr1": 1, "chr2": 2, "chrX": 23, "chr7": 7}
    assert got == {(number[c], i // 100): s[i : i + 100] for c, s in contigs.items() for i in range(0, len(s), 100)}


def test_region_read_prunes(spark, tmp_path):
    rows = spark.range(3000).select((F.col("id") % 3 + 1).cast("int").alias("chrnum"), F.col("id").cast("int").alias("pos"))
    tables.write_by_chromosome(rows, str(tmp_path / "t"))
    got = tables.read_region(spark, str(tmp_path / "t"), 2, 100, 200)
    assert sorted(r.pos for r in got.collect()) == [p for p in range(100, 200) if p % 3 == 1]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(chrnum" in plan and "GreaterThanOrEqual(pos,100)" in plan


def test_cohorts_must_agree(spark):
    rows = spark.createDataFrame([(s, 1, v) for s in (1, 2) for v in range(5)], "sample_id int, chrnum int, sv_id long")
    assert tables.checked_cohort(rows).count() == 10
    with pytest.raises(ValueError, match="chromosome 1: 4 to 5"):
        tables.checked_cohort(rows.where("not (sample_id = 2 and sv_id = 3)"))


@pytest.mark.parametrize("width", [3, 50, 10_000])
def test_scans_against_loops(spark, width):
    import random

    random.seed(4)
    rows = sorted((random.randint(1, 2), random.randint(0, 400), i, random.randint(-5, 5)) for i in range(300))
    frame = scan.binned(spark.createDataFrame(rows, "c int, p int, i int, v int").repartition(7), "p", width)
    run = ["p", "i"]
    frame = scan.elsewhere(frame, ["c"], run, "sum", F.col("v"), "total")
    frame = scan.elsewhere(frame, ["c"], run, "max", F.col("v"), "top")
    frame = scan.elsewhere(frame, ["c"], run, "min", F.col("p"), "next", after=True)
    got = {r.i: (r.total, r.top, r.next, r.last and r.last.i) for r in scan.previous(frame, ["c"], run, [], "last").collect()}
    for n, (c, p, i, _) in enumerate(rows):
        before = [r for r in rows[:n] if r[0] == c]
        after = [r[1] for r in rows[n + 1 :] if r[0] == c]
        assert got[i] == (sum(r[3] for r in before), max((r[3] for r in before), default=None), min(after, default=None), before[-1][2] if before else None)


@pytest.mark.parametrize(("bins", "most"), [(64, 64_000), (1 << 20, 64_000), (256, 3)])
def test_coverage_against_loops(spark, bins, most):
    import random
    import re

    rng = random.Random(bins + most)
    shapes = ["50M", "10S40M", "20M5D30M", "10M200N15M", "5=2X3D4I10M6S", "30M1D10M2D5M", "*", "20S"]
    reads = [(i, rng.randint(1, 2), 1, rng.randint(0, 1500), rng.choice(shapes)) for i in range(300)]
    frame = spark.createDataFrame([(*r, 60, 0) for r in reads], "read_id int, sample_id int, chrnum int, pos int, cigar string, mapq int, flag int").repartition(5)
    spanned, depth = {}, {}
    for _, sample, _, pos, cigar in reads:
        at = pos
        for n, op in re.findall("([0-9]+)([MIDNSHP=X])", cigar):
            if op in "MDN=X":
                for x in range(at, at + int(n)):
                    spanned[sample, x] = spanned.get((sample, x), 0) + 1
                    depth[sample, x] = depth.get((sample, x), 0) + (op in "M=X")
                at += int(n)
    got = {}
    for r in D.coverage_runs(frame, most=most, width=bins).collect():
        for x in range(r.beg, r.end):
            assert (r.sample_id, x) not in got
            got[r.sample_id, x] = r.depth
    assert got == {k: min(most, depth[k]) for k in spanned}
    sums = pileup.coverage(frame, most=most, bins=bins)
    for r in sums.collect():
        own = [min(most, d) for (s, x), d in depth.items() if s == r.sample_id and x // 100 == r.bucket]
        assert (r.n, r.total, r.squares) == (len(own), sum(own), sum(d * d for d in own))
    # rows by reads, whatever they cover
    assert D.coverage_steps(frame).count() <= 6 * len(reads)


@pytest.mark.parametrize("width", [3, 40, 4096])
def test_spans_against_loops(spark, width):
    import random

    rng = random.Random(width)
    windows = [(s, c, b, rng.randint(0, 900)) for s in (1, 2) for c in (1, 2) for b in range(-3, 120) if rng.random() < 0.8]
    spans = [(i, rng.randint(1, 3), rng.choice("xy"), lo := rng.randint(-20, 130), lo + rng.randint(0, 60)) for i in range(80)]
    steps = D.span_steps(spark.createDataFrame(spans, "sv_id int, chrnum int, part string, lo int, hi int"), spark.createDataFrame(windows, "sample_id int, chrnum int, bucket int, dp32 int"), width)
    got = {(r.sv_id, r.sample_id): (r.total, r.n) for r in steps.groupBy("sv_id", "sample_id").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()}
    for i, c, _, lo, hi in spans:
        for s in (1, 2):
            own = [d for w, k, b, d in windows if w == s and k == c and lo <= b <= hi]
            assert got.get((i, s), (0, 0)) == (sum(own), len(own))


def test_pileup(spark, tmp_path):
    header = ["@HD\tVN:1"]
    line = lambda name, flag, pos, cigar, mate, size, extra="": f"{name}\t{flag}\tchr1\t{pos}\t60\t{cigar}\t=\t{mate}\t{size}\t*\t*\tMQ:i:60\tNM:i:0{extra}"
    proper = [line(f"{i}/1", 0x1 | 0x2 | 0x20, 100 + 7 * i, "50M", 300 + 7 * i, 250 + i) for i in range(40)]
    odd = [line("100/1", 0x1 | 0x20, 150, "50M", 900, 800), line("101/1", 0x800, 200, "30M20S", 200, 0, "\tSA:Z:chr1,701,+,30S20M,60,0;"), line("102/1", 0x1 | 0x2 | 0x20, 260, "40M10S", 500, 280), line("103/1", 0x404, 200, "50M", 0, 0)]
    reads = sam.parse(spark.createDataFrame([(x,) for x in header + proper + odd], "line string")).withColumn("sample_id", F.lit(1))
    genome = spark.createDataFrame([(1, b, ("GC" * 25 + "AT" * 25) if b % 2 else "AT" * 50) for b in range(12)], "chrnum int, bucket int, bases string")
    got = pileup.pileup(reads, D.gc_profile(genome), least=1.0)
    covered = {}
    for start, n in [(100 + 7 * i, 50) for i in range(40)] + [(150, 50), (200, 30), (260, 40)]:
        for p in range(start, start + n):
            covered[p] = covered.get(p, 0) + 1
    s = got["samples"].first()
    assert s.avg_dp == pytest.approx(sum(covered.values()) / len(covered)) and s.avg_isize == pytest.approx((sum(range(250, 290)) + 280) / 41)
    runs = D.coverage_runs(reads.where("read_id < 100")).where("beg <= 107 and end > 107").collect()
    assert [(r.beg, r.end, r.depth) for r in runs] == [(107, 114, 2)]
    assert [(r.pos, r.mate, r.pairstr) for r in got["pairs"].collect()] == [(150, 900, 1)]
    assert [(r.pos, r.mate, r.rlen, r.sa_rlen, r.rclip, r.sa_lclip) for r in got["splits"].collect()] == [(200, 701, 30, 20, 20, 30)]
    assert {r.kind for r in got["clips"].collect()} <= {"lclip", "rclip"}
    factors = {r.bin: r.factor for r in got["gc_curve"].collect()}
    profile = {r.bucket: r.bin for r in D.gc_profile(genome).collect()}
    for r in got["windows"].collect():
        inside = [v for p, v in covered.items() if p // 100 == r.bucket]
        raw, factor = round(32 * sum(inside) / len(inside)), factors.get(profile[r.bucket], 0)
        assert r.dp32 == int(raw * factor if factor > 0.1 else raw)
    pileup.write(got, str(tmp_path / "out"))
    assert tables.read_region(spark, str(tmp_path / "out/pairs"), 1).count() == 1 and spark.read.parquet(str(tmp_path / "out/samples")).count() == 1
    assert genome.select(gc_content(F.col("bases")).alias("g")).agg(F.max("g")).first()[0] == 0.5
