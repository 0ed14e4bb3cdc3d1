"""The genotyping plan: planted cohorts, and each step against plain Python."""

import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlake.functions import mixture as M
from cohortlake.plans import calling as C
from cohortlake.plans import genotype as G

SV = "sv_id long, chrnum int, pos int, end int, svtype string"
SPLIT = "ev_id long, sample_id long, chrnum int, pos int, mate int, pairstr int, rlen int, sa_rlen int, lclip int, rclip int, sa_lclip int, sa_rclip int"
PAIR = "ev_id long, sample_id long, chrnum int, pos int, mate int, qual int, pairstr int"
CLIP = "ev_id long, sample_id long, chrnum int, kind string, pos int"
HET, HOM, N, DEPTH = range(20, 28), range(28, 30), 30, 30.0


def planted():
    rng = np.random.default_rng(5)
    kinds = {1: "DEL", 2: "DEL", 3: "DEL", 4: "DEL", 5: "DUP", 6: "CNV", 7: "INV", 8: "INS", 9: "DEL", 10: "DEL"}
    sv, windows, depth, splits, pairs, clips = [], [], [], [], [], []
    for i, kind in kinds.items():
        s = 20_000 * i + 50
        s, chrom = (122_000_050, 1) if i == 9 else (s, 2)
        e = s + 2_000
        sv.append((i, chrom, s, e, kind))
        for sample in range(N):
            copies = {"DEL": (1, 0.5, 0), "DUP": (1, 1.5, 2), "CNV": (1, 1.5, 2)}.get(kind, (1, 1, 1))
            at = 2 if sample in HOM else 1 if sample in HET else 0
            inner = max(0.0, copies[at] + rng.normal(0, 0.02)) * DEPTH if i != 10 else DEPTH
            depth.append((i, sample, int(32 * inner)))
            for b in range(s // 100 - 20, e // 100 + 20):
                here = inner if s // 100 <= b <= e // 100 else DEPTH * (1 + rng.normal(0, 0.02))
                windows.append((sample, chrom, b, int(32 * max(0.0, here + rng.normal(0, 0.3)))))
            if at and i in (1, 5, 6):
                for _ in range(5):
                    row = (s - 51, e + 1, 0, 50, 50, 0, 20, 20, 0) if kind == "DEL" else (s, e - 50, 3, 50, 50, 20, 0, 0, 20)
                    splits.append((len(splits), sample, chrom, *row))
            if at and i in (3, 7):
                for _ in range(6 if at == 1 else 14):
                    pairs.append((len(pairs), sample, chrom, *((s - 200, e + 100, 40, 1) if kind == "DEL" else (s - 100, e - 100, 40, 0))))
            if at and i == 2:
                clips += [(len(clips) + k, sample, chrom, kind_of, p) for k in range(5) for kind_of, p in (("rclip", s + 3), ("lclip", e - 2))]
    return sv, windows, depth, splits, pairs, clips


@pytest.fixture(scope="module")
def parts(spark):
    sv, windows, depth, splits, pairs, clips = planted()
    frame = lambda rows, shape: spark.createDataFrame(pd.DataFrame(rows, columns=[c.split()[0] for c in shape.split(", ")]), shape)
    return {
        "sv": frame(sv, SV), "samples": frame([(i, DEPTH) for i in range(N)], "sample_id long, avg_dp double"), "depth": frame(depth, "sv_id long, sample_id long, dp32 int"),
        "windows": frame(windows, "sample_id long, chrnum int, bucket int, dp32 int"), "pairs": frame(pairs, PAIR), "splits": frame(splits, SPLIT), "clips": frame(clips, CLIP),
        "gc": frame([(i, 0.4) for i in range(1, 11)], "sv_id long, gc double"),
    }


def test_planted_cohort(spark, parts):
    sv, clusters, calls = C.genotype(**parts)
    got = defaultdict(dict)
    how = {}
    for r in calls.collect():
        got[r.sv_id][r.sample_id] = (r.gt, r.cn)
        how[r.sv_id] = r.method
    assert how == {1: "split", 2: "clip", 3: "given", 4: "depth", 5: "split", 6: "split", 7: "given", 10: ""}
    for i, cn in ((1, (2, 1, 0)), (2, (2, 1, 0)), (3, (2, 1, 0)), (4, (2, 1, 0)), (5, (2, 3, 4)), (6, (2, 3, 4)), (7, (2, None, None))):
        for sample in range(N):
            at = 2 if sample in HOM else 1 if sample in HET else 0
            assert got[i][sample] == (at, cn[at]), (i, sample)
    assert all(v == (None, None) for v in got[10].values())
    places = {(r.sv_id, r.attempt): (round(r.start), round(r.end), r.n) for r in clusters.collect()}
    assert places[1, "split"] == (20_050, 22_050, 50) and places[2, "clip"] == (40_053, 42_048, 50) and places[5, "split"] == (100_050, 102_050, 50)

    lines = {r.sv_id: r.line.split("\t") for r in C.records(sv, clusters, calls).collect()}
    assert sorted(lines) == [1, 2, 3, 4, 5, 6, 7] and all(len(x) == 9 + N for x in lines.values())
    info = dict(x.partition("=")[::2] for x in lines[1][7].split(";"))
    assert lines[1][:7] == ["chr2", "20050", "DEL_2:20050-22050", ".", "<DEL>", ".", "PASS"] and lines[1][8] == "GT:CN:ND:DP:DD:SP:RP:SC:EC"
    assert (info["SVLEN"], info["AC"], info["NS"], info["AF"], info["N_HET"], info["SPLIT"]) == ("-2001", "12", "30", "0.200000", "8", "(20050,22050)")
    assert lines[1][9 + 20].startswith("0/1:1:") and lines[1][9 + 20].endswith(":5:0:0:0") and "Biallelic" in info and "DPCNT" in info
    assert "READPAIR" in lines[7][7] and "CNT=" in lines[7][7] and lines[7][9].split(":")[4] == "." and "DP=" in lines[4][7] and "DP2=" in lines[4][7]
    assert {r.sv_id for r in C.records(sv, clusters, calls, report_all=True).collect()} == {*lines, 10}


def planted_more():
    """Gains and inversions by every way of calling: (type, way, samples with one changed copy, samples with two)."""
    rng = np.random.default_rng(9)
    many = (range(6, 22), range(22, 30))
    plan = {1: ("DUP", "clip", HET, HOM), 2: ("DUP", "given", HET, HOM), 3: ("DUP", "depth", *many), 4: ("CNV", "given", HET, HOM), 5: ("CNV", "depth", *many), 6: ("INV", "split", HET, HOM), 7: ("INV", "clip", HET, HOM), 8: ("DUP", "split", HET, HOM), 9: ("CNV", "split", HET, HOM)}
    sv, windows, depth, splits, pairs, clips = [], [], [], [], [], []
    for i, (kind, way, het, hom) in plan.items():
        s = 20_000 * i + 50
        e = s + 2_000
        sv.append((i, 3, s, e, kind))
        for sample in range(N):
            at = 2 if sample in hom else 1 if sample in het else 0
            inner = (1 if kind == "INV" else (1, 1.5, 2)[at]) * DEPTH * (1 + rng.normal(0, 0.01))
            depth.append((i, sample, int(32 * inner)))
            windows += [(sample, 3, b, int(32 * ((inner if s // 100 <= b <= e // 100 else DEPTH * (1 + rng.normal(0, 0.02))) + rng.normal(0, 0.2)))) for b in range(s // 100 - 20, e // 100 + 20)]
            if not at:
                continue
            more = (0, 6, 14)[at]
            if way == "split":
                row = (s, e + 1, 1, 50, 50, 20, 0, 20, 0) if kind == "INV" else (s, e - 50, 3, 50, 50, 20, 0, 0, 20)
                splits += [(len(splits) + k, sample, 3, *row) for k in range(more)]
            if way == "given":
                pairs += [(len(pairs) + k, sample, 3, s - 90, e + 50, 40, 1) for k in range(more)]
            if way == "clip":
                ends = [("lclip", s + 2), ("rclip", e - 3)] if kind == "DUP" else [("lclip", s + 2), ("rclip", s + 4), ("lclip", e - 4), ("rclip", e - 2)]
                clips += [(len(clips) + k, sample, 3, *end) for k, end in enumerate(ends * 6)]
                if kind == "INV":  # clips alone don't make a carrier of an inversion
                    pairs += [(len(pairs) + k, sample, 3, s - 100, e - 100, 40, 0) for k in range((0, 4, 30)[at])]
    return plan, sv, windows, depth, splits, pairs, clips


def test_planted_gains_and_inversions_by_every_way(spark):
    plan, *rows = planted_more()
    shapes = (SV, "sample_id long, chrnum int, bucket int, dp32 int", "sv_id long, sample_id long, dp32 int", SPLIT, PAIR, CLIP)
    sv, windows, depth, splits, pairs, clips = (spark.createDataFrame(pd.DataFrame(r, columns=[c.split()[0] for c in shape.split(", ")]), shape) for r, shape in zip(rows, shapes, strict=True))
    samples, gc = spark.createDataFrame([(i, DEPTH) for i in range(N)], "sample_id long, avg_dp double"), spark.createDataFrame([(i, 0.4) for i in plan], "sv_id long, gc double")
    _, clusters, calls = C.genotype(sv, samples, depth, windows, pairs, splits, clips, gc, far_end=True)
    got, how = defaultdict(dict), {}
    for r in calls.collect():
        got[r.sv_id][r.sample_id], how[r.sv_id] = (r.gt, r.cn), r.method
    assert how == {i: way for i, (_, way, _, _) in plan.items()}
    for i, (kind, way, het, hom) in plan.items():
        for sample in range(N):
            at = 2 if sample in hom else 1 if sample in het else 0
            want = (at, (2, None, None)[at] if kind == "INV" else 2 + at)
            if way != "depth":
                assert got[i][sample] == want, (i, kind, way, sample)
            else:  # by depth alone, samples like their flanks and those with odd flanks are missing
                assert got[i][sample] in ((None, None), want), (i, kind, way, sample)
        if way == "depth":
            assert sum(got[i][s][0] is not None for s in (*het, *hom)) >= 18
    assert {(r.sv_id, r.attempt) for r in clusters.where("attempt <> 'given'").collect()} == {(i, way) for i, (_, way, _, _) in plan.items() if way in ("split", "clip")}


def test_mask_gate_force_region(spark, parts):
    out = spark.createDataFrame([(29,), (0,)], "sample_id long")
    *_, calls = C.genotype(**parts, exclude=out)
    rows = calls.collect()
    assert {r.sample_id for r in rows} == set(range(1, 29)) and {r.method for r in rows if r.sv_id == 1} == {"split"}
    force = spark.createDataFrame([(2, 20_050, 22_050, "DEL"), (2, 5, 6, "DEL")], "chrnum int, pos int, end int, svtype string")
    assert [r.sv_id for r in C.eligible(parts["sv"], parts["gc"], force=force).collect()] == [1]
    assert sorted(r.sv_id for r in C.eligible(parts["sv"], parts["gc"], region=(2, 40_050, 80_050)).collect()) == [2, 3]
    assert sorted(r.sv_id for r in C.eligible(parts["sv"], parts["gc"].withColumn("gc", F.when(F.col("sv_id") == 1, 0.2).otherwise(0.74))).collect()) == [2, 3, 4, 5, 6, 7, 10]
    deep = parts["depth"].withColumn("dp32", F.when(F.col("sv_id") == 1, F.lit(150 * 32)).otherwise(F.col("dp32")))
    assert sorted(r.sv_id for r in C.features(parts["sv"].where("sv_id < 3"), parts["samples"], deep, parts["windows"]).select("sv_id").distinct().collect()) == [2]


def evidence(rng, kinds):
    sv = [(i, 1, 10_000, 20_000, k) for i, k in enumerate(kinds)]
    splits, pairs, cells = [], [], []
    for i in range(len(kinds)):
        for s in range(4):
            splits += [(i, s, int(10_000 + rng.integers(-8, 9)), int(20_000 + rng.integers(-8, 9))) for _ in range(rng.integers(0, 9))]
            pairs += [(i, s, int(10_000 - rng.integers(-100, 450)), int(20_000 + rng.integers(-450, 350)), int(rng.integers(0, 4))) for _ in range(rng.integers(0, 9))]
            cells += [(i, s, ("lclip", "rclip")[rng.integers(0, 2)], int(min(max(rng.normal((100, 300)[rng.integers(0, 2)], 3), 0), 399))) for _ in range(rng.integers(0, 40))]
    return sv, splits, pairs, cells


def clip_point(kind, s, e, cells):
    n = Counter(cells)

    def mode(k, far):
        return max(((c, -cell) for (kk, cell), c in n.items() if kk == k and (cell >= 200) == far), default=(0, 0))

    def both(far):
        (ln, lc), (rn, rc) = mode("lclip", far), mode("rclip", far)
        if ln and rn and abs(lc - rc) < 10 and ln + rn >= 3:
            return (-lc - rc) // 2, ln + rn
        if ln >= 3 and rn <= 1:
            return -lc, ln
        if rn >= 3 and ln <= 1:
            return -rc, rn
        return None

    one = lambda k, far: (-mode(k, far)[1], mode(k, far)[0]) if mode(k, far)[0] else None
    ends = {"DEL": (one("rclip", False), one("lclip", True)), "DUP": (one("lclip", False), one("rclip", True)), "INV": (both(False), both(True))}.get(kind)
    if not ends or None in ends:
        return None
    (a, x), (b, y) = ends
    return (s + a - 100, e + b - 300, min(x, y)) if min(x, y) >= 3 and s + a - 100 < e + b - 300 else None


def fold(points):
    out = []
    for s, e, n in points:
        near = min(out, key=lambda c: abs(c[0] - s) + abs(c[1] - e), default=None)
        if near and abs(near[0] - s) + abs(near[1] - e) <= 6:
            near[0] += (s - near[0]) * n / (near[2] + n)
            near[1] += (e - near[1]) * n / (near[2] + n)
            near[2] += n
        else:
            out.append([s, e, n])
    return out


def found_rows(splits, pairs, cells):
    row = lambda frame, tag, kind, a, b, side: frame.select("sv_id", "sample_id", F.lit(tag).alias("tag"), kind.alias("kind"), F.expr(a).cast("int").alias("a"), F.expr(b).cast("int").alias("b"), F.expr(side).cast("int").alias("side"))
    none = F.lit(None).cast("string")
    return row(splits, "split", none, "start", "end", "null").unionByName(row(pairs, "pair", none, "self", "mate", "side")).unionByName(row(cells, "clip", F.col("kind"), "cell", "null", "null"))


def test_clusters_and_counts(spark):
    kinds = ["DEL", "DUP", "CNV", "INV"] * 3
    sv, splits, pairs, cells = evidence(np.random.default_rng(11), kinds)
    frames = [spark.createDataFrame(r, s) for r, s in ((sv, SV), (splits, "sv_id long, sample_id long, start int, end int"), (pairs, "sv_id long, sample_id long, self int, mate int, side int"), (cells, "sv_id long, sample_id long, kind string, cell int"))]
    clusters = C.break_clusters(frames[0], frames[1], frames[3])
    want = {}
    for i, _, s, e, kind in sv:
        own = [max(fold((a, b, 1) for a, b in sorted((x[2], x[3]) for x in splits if x[:2] == (i, k))), key=lambda c: c[2], default=[0, 0, 0]) for k in range(4)]
        want[i, "split"] = fold(c for c in own if c[2] >= 3)
        points = [clip_point(kind, s, e, [x[2:] for x in cells if x[:2] == (i, k)]) for k in range(4)]
        want[i, "clip"] = fold(p for p in points if p)
        want[i, "given"] = [[s, e, 1]]
    got = defaultdict(list)
    for r in sorted(clusters.collect(), key=lambda r: (r.sv_id, r.attempt, r.idx)):
        got[r.sv_id, r.attempt].append((r.start, r.end, r.n))
    assert set(got) == {k for k, v in want.items() if v}
    for k, v in got.items():
        assert np.allclose(v, want[k])

    found = {(r.sv_id, r.attempt, r.sample_id): (r.splits, r.pairs, r.start_clips, r.end_clips) for r in C.attempt_counts(frames[0], clusters, found_rows(*frames[1:])).collect()}
    for (i, attempt), parts_ in got.items():
        kind, (big_s, big_e, _) = kinds[i], max(parts_, key=lambda c: c[2])
        big_s, big_e = math.floor(big_s + 0.5), math.floor(big_e + 0.5)
        for k in range(4):
            sp = sum(abs(x[2] - s) + abs(x[3] - e) <= 6 for x in splits if x[:2] == (i, k) for s, e, _ in parts_)
            pr = 0
            for _, _, a, b, side in (x for x in pairs if x[:2] == (i, k)):
                if kind == "INV":
                    pr += side == 0 and 50 < big_s - a < 400 and 50 < big_e - b < 400 or side == 3 and -50 < a - big_s < 375 and -50 < b - big_e < 375
                else:
                    pr += 75 < big_s - a < 375 and -75 < b - big_e < 300
            near = [0, 0]
            last = 3 if kind in ("DEL", "INV") else 2
            for s, e, _ in parts_:
                at = (min(196, max(3, math.floor(s + 0.5) - 10_000 + 100)), min(396, max(203, math.floor(e + 0.5) - 20_000 + 300)))
                for h in (0, 1):
                    ok = ("lclip", "rclip") if kind == "INV" else (("rclip", "lclip") if kind == "DEL" else ("lclip", "rclip"))[h : h + 1]
                    near[h] += sum(x[2] in ok and at[h] - 3 <= x[3] <= at[h] + last for x in cells if x[:2] == (i, k))
            assert found.get((i, attempt, k), (0, 0, 0, 0)) == (sp, pr, *near), (i, attempt, k, kind)


def test_modal_cluster_takes_the_first_of_equals(spark):
    rows = spark.createDataFrame([(1, 0, 5.0, 6.0, 3), (1, 1, 1.0, 2.0, 3), (1, 2, 0.0, 0.0, 2)], "sv_id long, idx int, start double, end double, n int")
    assert [tuple(r) for r in G.modal_cluster(rows).collect()] == [(1, 5.0, 6.0, 3)]


def test_em_2d_against_loops():
    rng = np.random.default_rng(7)
    xy = np.concatenate([rng.normal(1, 0.05, (20, 2)), rng.normal(0.5, 0.05, (8, 2)), rng.normal(0, 0.02, (2, 2)), [[5.0, 5.0]]])
    start = [1.0, 0.5, 0.0]
    mean, cov, alpha = [np.array([s, s]) for s in start], [0.1 * np.eye(2)] * 3, [1 / 3] * 3

    def density(p, m, c):
        return math.exp(-0.5 * (p - m) @ np.linalg.inv(c) @ (p - m)) / (2 * math.pi * math.sqrt(np.linalg.det(c)))

    for _ in range(15):
        w = [[a * density(p, m, c) for p in xy] for a, m, c in zip(alpha, mean, cov, strict=True)]
        total = [sum(c[i] for c in w) for i in range(len(xy))]
        w = [[c[i] / total[i] if total[i] >= 1e-5 else 0.0 for i in range(len(xy))] for c in w]
        weight = [sum(c) + (0.2 if s >= 0.01 else 0) for c, s in zip(w, start, strict=True)]
        for k, s in enumerate(start):
            free = s >= 0.01
            if free:
                mean[k] = (sum(w[k][i] * p for i, p in enumerate(xy)) + 0.2 * np.array([s, s])) / weight[k]
            scatter = sum(w[k][i] * np.outer(p - mean[k], p - mean[k]) for i, p in enumerate(xy))
            if free:
                scatter = scatter + np.outer(s - mean[k], s - mean[k]) + 0.002 * np.eye(2)
            cov[k] = scatter / weight[k]
        alpha = [x / sum(weight) for x in weight]
    fit = M.em_2d(xy, start)
    assert np.allclose(fit.means, mean) and np.allclose(fit.spreads, cov) and np.allclose(fit.alphas, alpha)
    ll = sum(math.log(t) for p in xy if (t := sum(a * density(p, m, c) for a, m, c in zip(alpha, mean, cov, strict=True))) > 0)
    assert fit.bic == pytest.approx(-ll + 0.5 * 17 * math.log(len(xy)))


def test_shapes():
    one = lambda *m: M.Mixture(np.array(m, float)[:, None], np.full(len(m), 0.1), np.full(len(m), 1 / len(m)), 0, 0)
    two = lambda *m: M.Mixture(np.array(m, float), np.array([np.eye(2)] * len(m)), np.full(len(m), 1 / len(m)), 0, 0)
    assert M.falling(one(1, 0.5, 0)) and not M.falling(one(1, 0.7)) and not M.falling(one(1)) and not M.falling(one(1, 0.5, 0.25))
    assert M.rising(one(1, 1.5, 2)) and not M.rising(one(1, 1.35)) and not M.rising(one(1.3, 1.7))
    assert M.falling(two((1, 1), (0.7, 0.5))) and not M.falling(two((1, 1), (0.7, 0.61))) and not M.falling(two((0.7, 1), (0.4, 0.5)))
    assert M.rising(two((1, 1), (1.3, 1.5))) and not M.rising(two((1, 1), (1.3, 1.39)))


def test_model_selection_by_hand():
    rng = np.random.default_rng(2)
    flat, split = rng.normal(1, 0.05, 40), np.concatenate([rng.normal(1, 0.05, 30), rng.normal(0.5, 0.05, 10)])
    for x, k in ((flat, 1), (split, 2)):
        fits = [M.em_1d(x, list(s)) for s in G.DEL_STARTS]
        good = [f for f in fits if f.overlap < 0.2]
        best = M.select(fits, 0.2)
        assert best.bic == min(f.bic for f in good) and len(best.alphas) == k


def test_many_variants_at_once_equal_one_by_one():
    rng = np.random.default_rng(3)
    sizes, start = [40, 1, 60, 35], [1.0, 0.5, 0.0]
    x = [rng.normal(np.resize(start, n), 0.05) for n in sizes]
    y = [np.resize(start, len(v)) + rng.normal(0, 0.05, len(v)) for v in x]
    (px, py), use = G.padded([np.concatenate(x), np.concatenate(y)], np.concatenate([[0], np.cumsum(sizes)]))
    for s in ([1.0], start[:2], start):
        one, two = M.em_1d_many(px, use, s), M.em_2d_many(np.stack([px, py], axis=2), use, s)
        for i in range(4):
            for many, single in ((one[i], M.em_1d(x[i], s)), (two[i], M.em_2d(np.stack([x[i], y[i]], axis=1), s))):
                if sizes[i] == 1 and many.means.shape[1] == 2:
                    continue  # one point has no covariance
                assert np.allclose(many.means, single.means) and np.allclose(many.spreads, single.spreads) and many.bic == pytest.approx(single.bic) and many.overlap == pytest.approx(single.overlap)


def test_whole_variants_of_batches():
    rows = pd.DataFrame({"sv_id": np.repeat([3, 5, 6, 9], [4, 1, 10, 2]), "v": range(17)})
    for size in (1, 3, 100):
        for most in (1, 5, 1000):
            got = list(G.by_variant((rows.iloc[i : i + size] for i in range(0, 17, size)), most))
            assert [v for r, _ in got for v in r["v"]] == list(range(17))
            assert [r["sv_id"].iloc[f] for r, first in got for f in first[:-1]] == [3, 5, 6, 9]
    assert list(G.by_variant(iter([]))) == []


def test_mixtures_by_sums_of_a_large_cohort(spark):
    rng = np.random.default_rng(8)
    n = 100_000
    at = rng.choice([1.0, 0.5, 0.0], n, p=[0.7, 0.25, 0.05])
    frame = pd.DataFrame({"sv_id": np.repeat([1, 2], n // 2), "sample_id": np.arange(n), "depth": at + rng.normal(0, 0.06, n), "depth2": at + rng.normal(0, 0.08, n)})
    rows = spark.createDataFrame(frame).repartition(8)
    start = [1.0, 0.5, 0.0]
    one, two = ({(r.sv_id, r.comp): r for r in G.fitted_by_sums(rows, start, dims).collect()} for dims in (1, 2))
    for i in (1, 2):
        own = frame[frame.sv_id == i]
        fit, pair = M.em_1d(own.depth.to_numpy(), start), M.em_2d(own[["depth", "depth2"]].to_numpy(), start)
        for c in range(3):
            assert (one[i, c].mean, one[i, c].spread, one[i, c].alpha) == pytest.approx((fit.means[c, 0], fit.spreads[c], fit.alphas[c]), rel=1e-9, abs=1e-9)
            assert (two[i, c].mean, two[i, c].spread, two[i, c].alpha) == pytest.approx((pair.means[c, 0], np.sqrt(pair.spreads[c, 0, 0]), pair.alphas[c]), rel=1e-9, abs=1e-9)
        assert one[i, 0].bic == pytest.approx(fit.bic, rel=1e-9) and two[i, 0].bic == pytest.approx(pair.bic, rel=1e-9)
    with pytest.raises(ValueError):
        G.fitted_by_sums(rows, [1.0])
