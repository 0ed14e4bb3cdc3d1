"""The queries without SQL against plain Python over the rows that they read."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_calling import clip_point, fold

from cohortlake import registry
from cohortlake import surrogates as S
from cohortlake.operators import queries_evidence as E
from cohortlake.plans import queries as P

SF = "/root/testdata/sf0.001"
QUERIES = registry.queries()


@pytest.fixture(scope="module")
def cohort(spark):
    out = defaultdict(list)
    for r in S.cohort(spark, SF).orderBy("sv_id", "sample_id").collect():
        out[r.sv_id].append((r.depth, r.depth2, r.cnt, r.label))
    return out


def em_1d(x, start):
    """mean, sd, alpha of each component, and the score, by loops."""
    n, k = len(x), len(start)
    density = lambda v, m, s: math.exp(-0.5 * ((v - m) / s) ** 2) / (s * math.sqrt(2 * math.pi))
    if k == 1:
        m = sum(x) / n
        s = max(math.sqrt(sum((v - m) ** 2 for v in x) / n), 1e-4)
        return [(m, s, 1.0)], -sum(math.log(density(v, m, s)) for v in x) + math.log(n)
    fit = [(m, 0.1, 1 / k) for m in start]
    for _ in range(15):
        p = [[a * density(v, m, max(s, 1e-4)) for m, s, a in fit] for v in x]
        p = [[q / sum(row) for q in row] if sum(row) >= 1e-20 else [0.0] * k for row in p]
        weight = [sum(row[c] for row in p) + 0.2 for c in range(k)]
        mean = [(sum(row[c] * v for row, v in zip(p, x, strict=True)) + 0.2 * start[c]) / weight[c] for c in range(k)]
        sd = [math.sqrt((sum(row[c] * (v - mean[c]) ** 2 for row, v in zip(p, x, strict=True)) + 0.002) / weight[c]) for c in range(k)]
        fit = [(mean[c], sd[c], weight[c] / sum(weight)) for c in range(k)]
    total = [sum(a * density(v, m, max(s, 1e-4)) for m, s, a in fit) for v in x]
    return fit, -sum(math.log(t) for t in total if t > 0) + 0.5 * (3 * k - 1) * math.log(n)


def test_model_select(spark, cohort):
    got = defaultdict(list)
    for r in QUERIES["model_select"](spark, SF).orderBy("sv_id", "comp").collect():
        got[r.sv_id].append(r)
    assert set(got) == set(cohort)
    for i, rows in cohort.items():
        best = None
        for start in ([1.0], [1.0, 0.5], [1.0, 0.5, 0.0]):
            fit, score = em_1d([r[0] for r in rows], start)
            overlap = 0.0
            for a in range(len(fit)):
                for b in range(a):
                    v = fit[a][1] ** 2 + fit[b][1] ** 2
                    overlap = max(overlap, math.exp(-0.25 * (fit[a][0] - fit[b][0]) ** 2 / v - 0.5 * math.log(v / (2 * fit[a][1] * fit[b][1]))))
            if overlap < 0.2 and (best is None or score < best[1]):
                best = (fit, score)
        assert len(got[i]) == len(best[0]) and got[i][0].bic == pytest.approx(best[1])
        for r, (m, s, a) in zip(got[i], best[0], strict=True):
            assert (r.mean, r.spread, r.alpha) == pytest.approx((m, s, a))


def test_em_2d(spark, cohort):
    got = {(r.sv_id, r.comp): r for r in QUERIES["em_2d"](spark, SF).collect()}
    assert len(got) == 3 * len(cohort)
    start = [1.0, 0.5, 0.0]
    for i, rows in list(cohort.items())[:3]:
        xy = np.array([r[:2] for r in rows])
        mean, cov, alpha = [np.array([s, s]) for s in start], [0.1 * np.eye(2)] * 3, [1 / 3] * 3
        for _ in range(15):
            w = np.array([[a * math.exp(-0.5 * (p - m) @ np.linalg.inv(c) @ (p - m)) / (2 * math.pi * math.sqrt(np.linalg.det(c))) for p in xy] for a, m, c in zip(alpha, mean, cov, strict=True)])
            total = w.sum(axis=0)
            w = np.where(total >= 1e-5, w / np.where(total >= 1e-5, total, 1), 0)
            weight = w.sum(axis=1) + np.array([0.2, 0.2, 0.0])
            for k, s in enumerate(start):
                pull = np.array([s, s])
                mean[k] = (w[k] @ xy + 0.2 * pull) / weight[k] if s else mean[k]
                scatter = sum(w[k][j] * np.outer(p - mean[k], p - mean[k]) for j, p in enumerate(xy))
                cov[k] = (scatter + (np.outer(pull - mean[k], pull - mean[k]) + 0.002 * np.eye(2) if s else 0)) / weight[k]
            alpha = list(weight / weight.sum())
        for k in range(3):
            assert (got[i, k].mean, got[i, k].spread, got[i, k].alpha) == pytest.approx((mean[k][0], math.sqrt(cov[k][0, 0]), alpha[k]))


def test_split_consensus_and_its_mode(spark):
    rows = defaultdict(list)
    for r in P._breaks(spark, SF).collect():
        rows[r.sv_id, r.sample_id].append((r.start, r.end))
    want = {}
    for sv in {i for i, _ in rows}:
        own = [max(fold((a, b, 1) for a, b in sorted(rows[i, s])), key=lambda c: c[2]) for i, s in sorted(k for k in rows if k[0] == sv)]
        want[sv] = fold(c for c in own if c[2] >= 2)
    got = defaultdict(list)
    for r in QUERIES["split_consensus"](spark, SF).orderBy("sv_id", "idx").collect():
        got[r.sv_id].append((r.start, r.end, r.n))
    assert set(got) == {i for i, c in want.items() if c} and got
    for i, c in got.items():
        assert np.allclose(c, want[i])
    modes = {r.sv_id: (r.start, r.end, r.n) for r in QUERIES["modal_cluster"](spark, SF).collect()}
    assert set(modes) == set(got)
    for i, c in got.items():
        assert modes[i] == pytest.approx(max(c, key=lambda x: x[2]))


def test_clip_consensus(spark):
    cells = defaultdict(list)
    for r in E._cells(spark, SF).collect():
        cells[r.sv_id // 400 * 3, r.sample_id].append((r.kind, r.cell // 10 * 10))
    got = defaultdict(list)
    for r in QUERIES["clip_consensus"](spark, SF).orderBy("sv_id", "idx").collect():
        got[r.sv_id].append((r.start, r.end, r.n))
    assert got
    # least=1 for the view's thin clips: what the helper of three or more accepts must be among the clusters' members
    for (i, s), own in cells.items():
        kind = ("DEL", "DUP", "INV")[i // 3 % 3]
        if (p := clip_point(kind, 10_000, 20_000, own)) and max(Counter(own).values()) >= 3:
            assert any(n >= p[2] for _, _, n in got[i]), (i, s)


def test_calls_follow_their_counts(spark):
    """genotype_calls and inv_assign: genotypes agree with copy numbers, and only methods whose breakpoints are there are used."""
    calls = QUERIES["genotype_calls"](spark, SF).collect()
    assert len(calls) == S.cohort(spark, SF).count()
    for r in calls:
        kind = ("DEL", "DUP", "CNV", "INV")[r.sv_id % 4]
        assert r.method in ({"", "given", "depth", "split"} if r.sv_id % 3 == 0 else {"", "given", "depth"}) - ({"depth"} if kind == "INV" else set())
        if r.gt is not None and r.cn is not None and kind != "INV":
            assert r.gt == (2 - r.cn if kind == "DEL" else min(2, max(0, r.cn - 2)))
        assert r.method or (r.gt is None and r.cn is None)
    assert {r.method for r in QUERIES["inv_assign"](spark, SF).select("method").distinct().collect()} <= {"", "given", "split"}
    methods = {r.sv_id: r for r in QUERIES["call_method"](spark, SF).collect()}
    assert {i: r.called for i, r in methods.items()} == {i: sum(c.gt is not None for c in calls if c.sv_id == i) for i in methods}


def test_records_of_the_whole_plan(spark):
    rows = QUERIES["genotype_records"](spark, SF).collect()
    assert rows and len({r.sv_id for r in rows}) == len(rows)
    samples = S.depth_pos(spark, SF).select("sample_id").distinct().count()
    wanted = {r.sv_id: r for r in E._sv(spark, SF).where(F.col("svtype").isin("DEL", "DUP", "CNV", "INV")).collect()}
    for r in rows:
        f, sv = r.line.split("\t"), wanted[r.sv_id]
        assert len(f) == 9 + samples and (f[0], f[1], f[4]) == (f"chr{sv.chrnum}", str(sv.pos), f"<{sv.svtype}>")
        info = dict(x.partition("=")[::2] for x in f[7].split(";"))
        cells = [c.split(":") for c in f[9:]]
        gts = Counter(c[0] for c in cells)
        assert (info["END"], int(info["NS"]), int(info["AC"])) == (str(sv.end), samples - gts["./."], gts["0/1"] + 2 * gts["1/1"])
        assert (f[6] == "PASS") == (int(info["NS"]) > 0)
