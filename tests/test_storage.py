"""What is written and read back: order of parts, files and splits that are read, folders that are touched."""

import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

from cohortlake.sources import cohort, line_source, regions, sam, sinks, vcf

SV = "sv_id long, chrnum int, pos int, end int, svtype string, supp int"


def parts(path):
    return sorted(p for p in os.listdir(path) if p.startswith("part-"))


def lines_of(path):
    return [x for p in parts(path) for x in Path(path, p).read_text().split("\n")[:-1]]


@pytest.fixture
def uncoalesced(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def candidates(spark, n=400):
    rng = random.Random(n)
    rows = [(i, rng.randint(1, 24), p := rng.randint(1, 5_000_000), p + rng.choice([20, 3_000, 2_000_000]), rng.choice(["DEL", "DUP", "INV"]), rng.randint(1, 9)) for i in range(n)]
    return rows, spark.createDataFrame(rows, SV).repartition(5)


def test_parts_in_global_order_below_one_header(uncoalesced, tmp_path):
    spark = uncoalesced
    rows, frame = candidates(spark)
    sinks.write_candidates(frame, str(tmp_path / "c"))
    got = lines_of(tmp_path / "c")
    assert len(parts(tmp_path / "c")) > 3 and (tmp_path / "c" / "_SUCCESS").exists()
    assert [x[:2] for x in got[:2]] == ["##", "#C"] and not any(x.startswith("#") for x in got[2:])
    assert [int(x.split("\t")[2]) for x in got[2:]] == [r[0] for r in sorted(rows, key=lambda r: (r[1], r[2], r[3], r[0]))]
    assert sorted(tuple(r) for r in vcf.read(spark, str(tmp_path / "c")).select("sv_id", "chrnum", "pos", "end", "svtype", "supp").collect()) == rows
    sinks.write_intervals(frame, str(tmp_path / "i"))
    assert sorted((r.sv_id, r.chrnum, r.pos, r.end, r.svtype) for r in sinks.read_intervals(spark, str(tmp_path / "i")).collect()) == [r[:5] for r in rows]
    assert [r.line for r in sinks.read_ordered(spark, str(tmp_path / "i")).orderBy("file", "place").collect()] == lines_of(tmp_path / "i")
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_intervals(frame, str(tmp_path / "i"))
    sinks.write_intervals(frame.limit(0), str(tmp_path / "none"))
    assert lines_of(tmp_path / "none") == []


def test_genotype_file(spark, tmp_path):
    records = spark.createDataFrame([(2, 7, 5, "chr2\t7\tb\t0/1"), (1, 9, 6, "chr1\t9\ta\t0/0")], "chrnum int, pos int, sv_id long, line string")
    sinks.write_genotypes(records, ["s1", "s2"], str(tmp_path / "g"), {1: 1000}, frozenset({"s2"}))
    got = lines_of(tmp_path / "g")
    assert got == [*vcf.header(["s1"], {1: 1000}).split("\n"), "chr1\t9\ta\t0/0", "chr2\t7\tb\t0/1"]
    sinks.write_genotypes(records.limit(0), ["s1"], str(tmp_path / "empty"))
    assert lines_of(tmp_path / "empty")[-1].startswith("#CHROM")


def files_read(frame):
    """Files that the scans of a plan have read, once it has run."""

    def under(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return under(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return under(plan.plan())
        leaves, total = plan.collectLeaves(), 0
        for i in range(leaves.size()):
            leaf = leaves.apply(i)
            if leaf.getClass().getSimpleName().endswith("QueryStageExec"):
                total += under(leaf)
            elif (metric := leaf.metrics().get("numFiles")).isDefined():
                total += metric.get().value()
        return total

    return under(frame._jdf.queryExecution().executedPlan())


def test_a_list_of_regions_reads_its_bins(spark, tmp_path):
    levels = (1 << 17, 1 << 20, regions.MAX_COORDINATE)
    rows, frame = candidates(spark, 600)
    regions.write(frame, str(tmp_path / "t"), "pos", "end", levels)
    files = sum(len([f for f in fs if f.endswith(".parquet")]) for _, _, fs in os.walk(tmp_path / "t"))
    wanted = [(0, 3, 1_000_000, 1_100_000), (1, 3, 1_050_000, 1_060_000), (2, 9, 0, 50), (3, 25, 0, 9), (4, 7, 5, 5), (5, 2, -20, 3_000_000)]
    table = spark.read.parquet(str(tmp_path / "t"))
    got = regions.query(table, spark.createDataFrame(wanted, "region_id int, chrnum int, beg int, end int"), "pos", "end", levels)
    found = sorted((r.region_id, r.sv_id) for r in got.collect())
    assert found == sorted((i, r[0]) for i, c, b, e in wanted for r in rows if b < e and r[1] == c and r[2] < e and r[3] > b)
    assert 0 < files_read(got) < files / 4
    assert regions.query(table, spark.createDataFrame([], "region_id int, chrnum int, beg int, end int"), "pos", "end", levels).count() == 0


def test_bins_of_levels(spark):
    levels = (16, 64, regions.MAX_COORDINATE)
    rng = random.Random(2)
    spans = [(b := rng.randint(-5, 300), b + rng.randint(1, 90)) for _ in range(200)] + [(regions.MAX_COORDINATE - 3, regions.MAX_COORDINATE + 9)]
    frame = spark.createDataFrame(spans, "b int, e int")
    got = frame.select("b", "e", regions.bin_number(F.col("b"), F.col("e"), levels).alias("one"), regions.bin_numbers(F.col("b"), F.col("e"), levels).alias("all")).collect()
    for r in got:
        for q in got:
            if r.b < q.e and q.b < r.e:
                assert r.one in q.all, (r, q)


def reads(n=3000):
    rng = random.Random(n)
    return sorted((rng.randint(1, 5), rng.randint(1, 9000), rng.choice([0, 4, 16])) for _ in range(n))


@pytest.mark.parametrize("split", [211, 5_000, 1 << 20])
def test_splits_of_sorted_text(spark, tmp_path, split):
    rows = reads()
    text = "".join(x + "\n" for x in sam.header(range(1, 6)))
    text += "".join(f"{i}/1\t{flag}\tchr{c}\t{p}\t60\t{'5M' * (i % 9 + 1)}\t=\t{p}\t0\t*\t*\tNM:i:{i % 3}\n" for i, (c, p, flag) in enumerate(rows))
    path = tmp_path / "a.sam"
    path.write_text(text[:-1])  # the last line has no end
    line_source.register(spark)
    load = lambda **more: spark.read.format("genomic_lines").options(path=str(path), split=split, **more).load()
    if split > 211:
        got = load().collect()
        assert [(r.chrnum, r.pos, r.flag) for r in got] == rows and got[-1].line == text[:-1].split("\n")[-1]
    for c, a, b in ((2, 1000, 2000), (1, 0, 50), (5, 8900, 10_000), (3, 0, 9001), (9, 1, 2)):
        want = [r for r in rows if r[0] == c and a <= r[1] < b]
        reader = line_source.Reader({"path": str(path), "split": split})
        rest = list(reader.pushFilters([EqualTo(("chrnum",), c), GreaterThanOrEqual(("pos",), a), LessThan(("pos",), b)]))
        chosen = reader.partitions()
        found = [(k, p) for s in chosen for batch in reader.read(s) for k, p in zip(batch["chrnum"].to_pylist(), batch["pos"].to_pylist(), strict=True)]
        assert rest == [] and found == [r[:2] for r in want]
        if split == 211:
            every = -(-len(text) // split)
            assert len(chosen) <= len(want) * 60 // split + 4 < every
    if split == 5_000:
        frame = load().where("chrnum = 2 and pos >= 1000 and pos < 2000 and flag = 16")
        assert sorted((r.pos, r.flag) for r in frame.collect()) == sorted((p, f) for c, p, f in rows if c == 2 and 1000 <= p < 2000 and f == 16)
        assert frame.rdd.getNumPartitions() < load().rdd.getNumPartitions() / 2
        unsorted = line_source.Reader({"path": str(path), "split": split, "sorted": "false"})
        list(unsorted.pushFilters([EqualTo(("chrnum",), 2)]))
        assert len(unsorted.partitions()) == -(-(len(text) - 1) // split)


def test_odd_lines(spark, tmp_path):
    (tmp_path / "one.vcf").write_text("##x\n#CHROM\n\nchr1 5 a N <DEL>\r\nchr1_alt\t7\nchrX\tnone\nchr2\n")
    (tmp_path / "two.vcf").write_text("")
    line_source.register(spark)
    got = spark.read.format("genomic_lines").options(path=str(tmp_path), kind="vcf").load().collect()
    assert [(r.chrnum, r.pos, r.flag, r.line) for r in got] == [(1, 5, None, "chr1 5 a N <DEL>"), (0, 7, None, "chr1_alt\t7"), (23, None, None, "chrX\tnone"), (2, None, None, "chr2")]
    assert spark.read.format("genomic_lines").options(path=str(tmp_path / "*.vcf"), kind="vcf").load().where("pos > 5").count() == 1


def test_a_new_sample_touches_its_folder_only(spark, tmp_path):
    path = str(tmp_path / "cohort")
    rows = lambda *samples: spark.createDataFrame([(s, c, v, 10 * v, s) for s in samples for c in (1, 2) for v in range(20)], "sample_id int, chrnum int, sv_id long, pos int, dp32 int")

    def files():
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}

    cohort.add_samples(rows(1, 2, 3), path)
    before = files()
    cohort.add_samples(rows(4), path)
    after = files()
    assert {k: after[k] for k in before} == before and all("sample_id=4" in k for k in after.keys() - before.keys())
    assert cohort.read(spark, path).count() == 160 and cohort.manifest(spark, path).where("variants = 20 and rows = 20").count() == 8
    cohort.add_samples(rows(2).withColumn("dp32", F.lit(99)), path)
    again = files()
    assert all("sample_id=2" in k for k in after.items() ^ again.items() for k in k[:1])
    assert cohort.read(spark, path).where("dp32 = 99").count() == 40 and cohort.read(spark, path).count() == 160
    cohort.add_samples(rows(5).where("chrnum = 1 and sv_id < 19"), path)
    with pytest.raises(ValueError, match="chromosome 1: 5 samples, 19 to 20, chromosome 2: 4 samples"):
        cohort.read(spark, path)
    assert cohort.read(spark, path, check=False).count() == 179


def test_a_scope_removes_what_was_written_in_it(spark):
    from cohortlake import store

    folder = Path(store.shared_folder(spark))
    before = set(os.listdir(folder))
    with store.scope(spark):
        rows = store.stored(spark.range(5), "inner")
        by = store.stored_by(spark.range(5), "id", "buckets")
        kept = store.stored(rows.join(by, "id"), "outer", keep=True)
        assert len(set(os.listdir(folder)) - before) == 3
    assert [x.split("-")[0] for x in set(os.listdir(folder)) - before] == ["outer"] and kept.count() == 5
    with pytest.raises(ZeroDivisionError), store.scope(spark):
        store.stored(spark.range(1), "gone")
        1 / 0  # noqa: B018
    assert not any(x.startswith("gone") for x in os.listdir(folder))
