"""Genotyping of a cohort as one plan: candidates, depth, evidence and GC in; calls and VCF records out.

Everything up to the fits is joins and aggregates keyed by variant (and sample). What is
known of a variant and a sample (depth, flanks, segments, evidence) meets in one exchange by
variant and one aggregate; the fits run over whole variants of sorted partitions, many at a
time as arrays.

Each variant tries breakpoints in turn: those that split reads agree on, those that
clips agree on, those given. An attempt counts its evidence per sample, labels samples by
depth and count, fits labelled mixtures and must pass its tests. Deletions go on to clips
or given ends only if the attempt before found no breakpoints; deletions and gains end
with mixtures of depth alone, inversions without.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import mixture as M
from ..functions.scalars import chrom_name, genotype_text
from ..operators import depth as D
from ..operators import evidence as E
from ..operators.intervals import in_centromere
from ..store import stored
from . import genotype as G

ATTEMPTS = ("split", "clip", "given")
COUNTS = ("splits", "pairs", "start_clips", "end_clips")
KINDS = ("DEL", "DUP", "CNV", "INV")
#: Cohorts with a mean depth from here on are taken for repeats.
MOST_DEPTH = 150.0
#: Greatest overlap of an inversion's clusters, and the least mean count of its carriers.
INV_OVERLAP, INV_CARRIERS = 0.3, 0.15


def eligible(sv: DataFrame, gc: DataFrame, least: float = 0.2, most: float = 0.75, force: DataFrame | None = None, region: tuple[int, int, int] | None = None) -> DataFrame:
    """Candidates that are genotyped: DEL, DUP, CNV and INV of autosomes, outside centromeres, of medium GC content (``gc``: sv_id, gc).

    ``force`` (chrnum, pos, end, svtype) leaves only the listed ones, ``region`` only starts in [beg, end) of a chromosome.
    """
    keep = F.col("svtype").isin(*KINDS) & F.col("chrnum").between(1, 22) & ~in_centromere(F.col("chrnum"), F.col("pos"), F.col("end"))
    if region:
        keep = keep & (F.col("chrnum") == region[0]) & (F.col("pos") >= region[1]) & (F.col("pos") < region[2])
    out = sv.where(keep).join(gc.where((F.col("gc") > least) & (F.col("gc") < most)).select("sv_id"), "sv_id", "left_semi")
    return out.join(force, ["chrnum", "pos", "end", "svtype"], "left_semi").select(*sv.columns) if force is not None else out


def features(sv: DataFrame, samples: DataFrame, depth: DataFrame, windows: DataFrame, width: int = 100, clusters: DataFrame | None = None, counts: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """A row for each variant and sample, all rows of a variant in one partition: sv_id, sample_id, svtype, avg_dp, raw, depth, pre, post, first, second, has_split, has_clip and the counts of each attempt.

    ``samples`` has sample_id and avg_dp, ``depth`` the variants' mean depths (dp32), ``windows``
    the GC-corrected buckets. All but raw are shares of the sample's mean. The inside buckets'
    mean, where there is one, takes the place of the variant's mean; inversions have no
    buckets and flanks of 1. Variants whose raw depth averages ``MOST_DEPTH`` or more go; samples in
    ``exclude`` count for that and go then. The rows are variants times samples by nature; a sample
    without depth has 0. All that is known of them is one long table, aggregated once.
    """
    keys = ["sv_id", "sample_id"]
    key = [F.col(c).cast("long").alias(c) for c in keys]
    kinds = sv.select("sv_id", "svtype")
    has = {f"has_{a}": F.count_if(F.col("attempt") == a) > 0 for a in ("split", "clip")}
    if clusters is not None:
        kinds = kinds.join(clusters.groupBy("sv_id").agg(*[c.alias(n) for n, c in has.items()]), "sv_id", "left").fillna(False, list(has))
    else:
        kinds = kinds.withColumns({n: F.lit(False) for n in has})
    who = samples.select("sample_id", F.col("avg_dp").cast("double").alias("avg_dp"))
    who = who.withColumn("_out", F.lit(False)) if exclude is None else who.join(exclude.select("sample_id", F.lit(True).alias("_out")).distinct(), "sample_id", "left").fillna(False, ["_out"])
    spans = D.flank_spans(sv, width).unionByName(D.segment_spans(sv, width).drop("inside"))
    parts = [kinds.crossJoin(who).select(*key, "svtype", *has, "avg_dp", "_out"), depth.select(*key, (F.col("dp32") / 32).alias("raw")), D.span_steps(spans, windows).select(*key, "part", "total", "n")]
    if counts is not None:
        parts.append(counts.select(*key, "attempt", *COUNTS))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    if counts is None:
        rows = rows.withColumns({"attempt": F.lit(None).cast("string")} | {c: F.lit(None).cast("int") for c in COUNTS})
    held = [F.max(c).alias(c) for c in ("svtype", *has, "avg_dp", "_out")] + [F.coalesce(F.max("raw"), F.lit(0.0)).alias("raw")]
    spans = [D.part_sum(p, c).alias(f"{p}_{c}") for p in ("pre", "post", "first", "second") for c in ("total", "n")]
    tries = [F.coalesce(F.sum(F.when(F.col("attempt") == a, F.col(c))), F.lit(0)).cast("int").alias(f"{a}_{c}") for a in ATTEMPTS for c in COUNTS]
    # one exchange, by variant, for the aggregate, the gate and the fits
    cells = rows.repartition("sv_id").groupBy(*keys).agg(*held, *spans, *tries).where("avg_dp is not null")
    cells = cells.withColumn("_mean", F.avg("raw").over(Window.partitionBy("sv_id"))).where((F.col("_mean") < MOST_DEPTH) & ~F.col("_out"))
    of = lambda a, b: [F.col(f"{p}_{c}") for p in (a, b) for c in ("total", "n")]
    (pre, post), (whole, first, second) = D.flank_means(*of("pre", "post")), D.segment_means(*of("first", "second"))
    inv, share = F.col("svtype") == "INV", lambda c: c / F.col("avg_dp")
    flank = lambda c: F.when(inv, F.lit(1.0)).otherwise(F.coalesce(share(c), F.lit(0.0)))
    return cells.select(
        *keys, "svtype", "avg_dp", "raw", F.when(inv, share(F.col("raw"))).otherwise(F.coalesce(share(whole), share(F.col("raw")))).alias("depth"),
        flank(pre).alias("pre"), flank(post).alias("post"), share(first).alias("first"), share(second).alias("second"), *has, *[f"{a}_{c}" for a in ATTEMPTS for c in COUNTS],
    )


def clip_points(sv: DataFrame, cells: DataFrame, least: int = 3) -> DataFrame:
    """sv_id, sample_id, start, end, n: each sample's breakpoints by its most frequent clip cells (lowest cell on ties), with ``least`` clips on both sides.

    Deletions take right clips at the start and left clips at the end, duplications the
    reverse. Inversions take both kinds: their middle when the modes lie within 9 bases,
    else the one kind that has ``least`` against at most one of the other. CNV has no rule.
    """
    return modal_points(sv, cells.groupBy("sv_id", "sample_id", "kind", (F.col("cell") >= 200).alias("far"), "cell").agg(F.count("*").alias("n")), least)


def modal_points(sv: DataFrame, n: DataFrame, least: int = 3) -> DataFrame:
    """``clip_points`` from counted cells (sv_id, sample_id, kind, far, cell, n): all of them, or the most frequent ones."""
    mode = lambda kind, far: F.max(F.when((F.col("kind") == kind) & (F.col("far") == far), F.struct("n", (-F.col("cell")).alias("c"))))
    best = n.groupBy("sv_id", "sample_id").agg(*[mode(k, far).alias(f"{k[0]}{int(far)}") for k in ("lclip", "rclip") for far in (False, True)])
    side = lambda name: F.struct((-F.col(f"{name}.c")).alias("c"), F.coalesce(F.col(f"{name}.n"), F.lit(0)).alias("n"))
    best = best.select("sv_id", "sample_id", *[side(x).alias(x) for x in ("l0", "r0", "l1", "r1")])

    def both(h: int) -> Column:
        lt, rt = F.col(f"l{h}"), F.col(f"r{h}")
        close = (lt["n"] >= 1) & (rt["n"] >= 1) & (F.abs(lt["c"] - rt["c"]) < 10) & (lt["n"] + rt["n"] >= least)
        middle = F.struct(F.floor((lt["c"] + rt["c"]) / 2).cast("int").alias("c"), (lt["n"] + rt["n"]).alias("n"))
        return F.when(close, middle).when((lt["n"] >= least) & (rt["n"] <= 1), lt).when((rt["n"] >= least) & (lt["n"] <= 1), rt)

    kind = F.col("svtype")
    start = F.when(kind == "DEL", F.col("r0")).when(kind == "DUP", F.col("l0")).when(kind == "INV", both(0))
    end = F.when(kind == "DEL", F.col("l1")).when(kind == "DUP", F.col("r1")).when(kind == "INV", both(1))
    points = best.join(sv.select("sv_id", "svtype", "pos", "end"), "sv_id").select("sv_id", "sample_id", "pos", F.col("end").alias("_end"), start.alias("s"), end.alias("e"))
    out = points.select("sv_id", "sample_id", (F.col("pos") + F.col("s.c") - 100).cast("int").alias("start"), (F.col("_end") + F.col("e.c") - 300).cast("int").alias("end"), F.least("s.n", "e.n").alias("n"))
    return out.where((F.col("n") >= least) & (F.col("start") < F.col("end")))


def break_clusters(sv: DataFrame, splits: DataFrame, cells: DataFrame, least: int = 3) -> DataFrame:
    """sv_id, attempt, idx, start, end, n: breakpoints that the cohort's split reads and clips agree on, and those given. ``cells`` are clips or, with n and far, counted cells."""
    split = G.consensus(splits, least).withColumn("attempt", F.lit("split"))
    points = modal_points if "n" in cells.columns else clip_points
    clip = G.cohort_clusters(points(sv, cells, least)).withColumn("attempt", F.lit("clip"))
    given = sv.select("sv_id", F.lit(0).alias("idx"), F.col("pos").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.lit(1).alias("n"), F.lit("given").alias("attempt"))
    return split.unionByName(clip).unionByName(given).select("sv_id", "attempt", "idx", "start", "end", "n")


def attempt_counts(sv: DataFrame, clusters: DataFrame, found: DataFrame, clips: DataFrame | None = None) -> DataFrame:
    """sv_id, attempt, sample_id, splits, pairs, start_clips, end_clips: evidence near each attempt's breakpoints. ``found`` as ``evidence_near`` gives it; ``clips`` are those that aren't in it and are counted by place.

    Split reads count for every cluster within 6 bases (sum of both ends), clips for every
    cluster whose cells lie within 3 of them; pairs count once, by the largest cluster. What
    is in ``found`` meets the clusters in one join.
    """
    first = Window.partitionBy("sv_id", "attempt").orderBy(F.desc("n"), "idx")
    at = lambda c: F.floor(F.col(c) + 0.5).cast("int")
    c = clusters.withColumn("largest", F.row_number().over(first) == 1)
    c = c.join(sv.select("sv_id", "svtype", *([] if clips is None else ["chrnum"]), "pos", F.col("end").alias("_end")), "sv_id")
    c = c.select(
        "sv_id", "attempt", "svtype", "largest", *([] if clips is None else ["chrnum", "pos", "_end"]), F.col("start").alias("cs"), F.col("end").alias("ce"), at("start").alias("s"), at("end").alias("e"),
        F.least(F.lit(196), F.greatest(F.lit(3), at("start") - F.col("pos") + 100)).alias("s_cell"), F.least(F.lit(396), F.greatest(F.lit(203), at("end") - F.col("_end") + 300)).alias("e_cell"),
    )
    kind = F.when(F.col("tag") == "clip", F.col("kind")).otherwise(F.col("tag"))
    met = found.select("sv_id", "sample_id", kind.alias("kind"), "a", "b", "side").join(c, "sv_id")
    inv, gain, a, b = F.col("svtype") == "INV", F.col("svtype").isin("DUP", "CNV"), F.col("a"), F.col("b")
    split = (F.col("kind") == "split") & (F.abs(a - F.col("cs")) + F.abs(b - F.col("ce")) <= 6)
    dx, dy = F.col("s") - a, b - F.col("e")
    inward = (dx > 75) & (dx < 375) & (dy > -75) & (dy < 300)
    turned = F.when(F.col("side") == 0, (dx > 50) & (dx < 400) & (dy < -50) & (dy > -400)).when(F.col("side") == 3, (dx < 50) & (dx > -375) & (dy > -50) & (dy < 375)).otherwise(False)
    pair = (F.col("kind") == "pair") & F.col("largest") & F.when(inv, turned).otherwise(inward)
    last = F.when(gain, 2).otherwise(3)
    clip = lambda cell, kind: (inv | (F.col("kind") == kind)) & F.col("kind").isin("lclip", "rclip") & (a >= F.col(cell) - 3) & (a <= F.col(cell) + last)
    starts, ends = clip("s_cell", F.when(gain, "lclip").otherwise("rclip")), clip("e_cell", F.when(gain, "rclip").otherwise("lclip"))
    sums = zip(COUNTS, (split, pair, starts, ends), strict=True)
    out = met.where(split | pair | starts | ends).groupBy("sv_id", "attempt", "sample_id").agg(*[F.count_if(x).alias(n) for n, x in sums])
    if clips is not None:
        spot = lambda x, far: F.struct(x.alias("place"), F.lit(far).alias("far"))
        spots = F.array(spot(F.col("pos") + F.col("s_cell") - 100, False), spot(F.col("_end") + F.col("e_cell") - 300, True))
        places = c.select("sv_id", "attempt", "svtype", "chrnum", F.explode(spots).alias("x")).select("sv_id", "attempt", "svtype", "chrnum", "x.*")
        near = E.clips_at(places, clips.where(F.col("kind").isin("lclip", "rclip")), ["sample_id", "kind"], {"wide": (-3, 3), "narrow": (-3, 2)})
        far = F.col("far")
        n = F.when(inv | (F.col("kind") == F.when(gain == far, "rclip").otherwise("lclip")), F.when(gain, F.col("narrow")).otherwise(F.col("wide"))).otherwise(0)
        near = near.withColumn("n", n).where("n > 0").select("sv_id", "attempt", "sample_id", *[F.lit(0).alias(x) for x in COUNTS[:2]], F.when(far, 0).otherwise(F.col("n")).alias(COUNTS[2]), F.when(far, F.col("n")).otherwise(0).alias(COUNTS[3]))
        out = out.unionByName(near).groupBy("sv_id", "attempt", "sample_id").agg(*[F.sum(x).alias(x) for x in COUNTS])
    return out.withColumns({x: F.col(x).cast("int") for x in COUNTS})


def _to_gt(kind: str, cn: np.ndarray) -> np.ndarray:
    if kind == "DEL":
        return np.where((cn >= 0) & (cn <= 2), 2 - cn, -1)
    return np.where(cn < 0, -1, np.where(cn <= 2, 0, np.where(cn == 3, 1, 2)))


def _good(gt: np.ndarray) -> bool:
    ns, ac = int((gt >= 0).sum()), int(gt[gt > 0].sum())
    return ns >= 0.5 * len(gt) and 0 < ac < 2 * ns


def _by_evidence(kind: str, x: np.ndarray, cnt: np.ndarray, limit: float):
    """gt, cn and mixture of depth and count together, or None."""
    label = G.labels(kind, x, cnt)
    if not (label > 0).any():
        return None
    xy = np.stack([x, cnt], axis=1)
    fits = [M.em_2d(xy, [1.0])] + [f for k in range(2, label.max() + 2) if (f := M.labelled_2d(xy, label, k))]
    fit = M.select(fits, limit)
    if fit is None or len(fit.alphas) < 2:
        return None
    cn = M.copy_number_by_first(xy, fit)
    if kind == "DEL":
        sure, not_ref, not_carrier = (x > 0.85) & (cnt < 0.05), (x < 0.8) | (cnt > 0.1), (x > 0.75) | (cnt < 0.05)
    else:
        sure, not_ref, not_carrier = (x > 0.8) & (x < 1.2) & (cnt < 0.05), (x > 1.25) | (cnt > 0.1), (x < 1.3) | (cnt < 0.05)
    cn = np.where(cn == 2, np.where(not_ref, -1, 2), np.where((cn == -1) & sure, 2, np.where(not_carrier, -1, cn)))
    gt = _to_gt(kind, cn)
    return (gt, np.where(gt >= 0, cn, -1), fit) if _good(gt) else None


def _inversion(cnt: np.ndarray, first: np.ndarray, reads: np.ndarray):
    """gt, cn and mixture of counts alone; ``first`` is the genotype by evidence scores, ``reads`` are split reads and pairs."""
    label, carriers = first.copy(), first > 0
    mean = cnt[carriers].mean()
    fit = M.em_1d(cnt, [1.0])
    fit.bic = M._bic(M.density_1d(cnt, fit.means[:, 0], fit.spreads), np.ones(1), 2)
    for k in (2, 3):
        if k == 3:
            label = np.where(carriers & (cnt > 1.5 * mean), 2, label)
            if not (label == 2).any():
                break
        new = M.labelled_1d(cnt, label, k)
        if new and new.bic < fit.bic and new.overlap < INV_OVERLAP and new.means[1, 0] > INV_CARRIERS:
            fit = new
    if len(fit.alphas) < 2:
        return None
    c = M.cluster_1d(cnt, fit)
    gt = np.where(c == 0, np.where(cnt > 0.1, -1, 0), np.where(cnt < 0.05, np.where(c == -1, 0, -1), c))
    ac = int(gt[gt > 0].sum())
    return (gt, np.where(gt == 0, 2, -1), fit) if _good(gt) and int(reads[gt > 0].sum()) // ac >= 1 else None


def _steady(v: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Whether a flank lies near 1 in the cohort; variants x samples."""
    n = use.sum(axis=1)
    mean = v.sum(axis=1) / n
    sd = np.sqrt((np.where(use, v - mean[:, None], 0) ** 2).sum(axis=1) / n)
    return (mean > 0.8) & (mean < 1.2) & (sd < 0.2)


def _depth_fits(kind: str, x: np.ndarray, two: tuple[np.ndarray, np.ndarray], has_two: np.ndarray, use: np.ndarray, limit: float) -> list[tuple]:
    """For each variant the chosen mixtures of its depth and of its two inside segments, or None."""
    starts, shape = (G.DEL_STARTS, M.falling) if kind == "DEL" else (G.DUP_STARTS, M.rising)
    limits = np.full(len(x), limit)

    def chosen(fits: list[M.Mixtures], which: np.ndarray) -> dict:
        best = M.select_many(fits, limits[: len(which)])
        good = ((int(v), fits[b][i]) for i, (v, b) in enumerate(zip(which, best, strict=True)) if b > 0)  # one component alone has no shape
        return {v: f for v, f in good if shape(f)}

    one = chosen([M.em_1d_many(x, use, s) for s in starts], np.arange(len(x)))
    # a deletion needs a fit of its depth
    which = np.flatnonzero(has_two & (np.isin(np.arange(len(x)), list(one)) if kind == "DEL" else True))
    xy = np.stack([t[which] for t in two], axis=2)
    pair = chosen([M.em_2d_many(xy, use[which], s) for s in starts], which) if len(which) else {}
    return [(one.get(i), pair.get(i)) for i in range(len(x))]


def _by_depth(kind: str, x: np.ndarray, two: np.ndarray | None, pre: np.ndarray, post: np.ndarray, one: M.Mixture | None, pair: M.Mixture | None):
    """gt, cn and mixtures of depth alone; the two inside segments, where there are any, as a second fit."""
    if one is None and (pair is None or kind == "DEL"):
        return None
    a = M.copy_number_1d(x, one) if one is not None else np.full(len(x), -1)
    b = M.copy_number_2d(two, pair) if pair is not None else np.full(len(x), -1)
    cn = np.where(a < 0, b, np.where(b < 0, a, np.floor((a + b) / 2 + 0.5).astype(int)))
    if kind != "DEL":
        cn = np.where(G.off_flank(x, cn, pre) | G.off_flank(x, cn, post) | (cn < 2), -1, cn)
    gt = _to_gt(kind, cn)
    return (gt, np.where(gt >= 0, cn, -1), one, pair) if _good(gt) else None


def _text(name: str, fit: M.Mixture) -> str:
    num = lambda *v: ",".join(f"{float(x):.3f}" for x in v)
    spread = lambda s: num(s) if np.ndim(s) == 0 else num(s[0, 0], s[0, 1], s[1, 1])
    parts = "::".join(f"{num(*m)}:{spread(s)}:{num(a)}" for m, s, a in zip(fit.means, fit.spreads, fit.alphas, strict=True))
    return f"{name}=({parts});{name}Overlap={fit.overlap:.3f}"


def _first_genotype(inv: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """1 with enough evidence, 0 with hardly any, else -1; ``inv``: whether a row's variant is an inversion."""
    splits, pairs, start, end = counts.T
    total = splits + pairs + (start + end) / 2
    carrier = np.where(inv, splits + pairs >= 3, (splits >= 3) | (splits + pairs >= 5) | ((start > 0) & (end > 0) & (total >= 5)))
    return np.where(carrier, 1, np.where(total < 1, 0, -1))


#: Numbers in one array of a fit: variants x components x samples.
FIT_SIZE = 1 << 21
_CARRIED = ("svtype", "avg_dp", "raw", "depth", "pre", "post", "first", "second")


def call_variants(rows: pd.DataFrame, first: np.ndarray, max_overlap: float = G.OVERLAP) -> pd.DataFrame:
    """The calls of whole variants from their samples' rows (columns of ``features``), sorted; ``first``: where each variant begins, and the number of rows."""
    kinds = rows["svtype"].to_numpy(object)[first[:-1]]
    x, pre, post, avg = (rows[c].to_numpy(float) for c in ("depth", "pre", "post", "avg_dp"))
    two = rows[["first", "second"]].to_numpy(float)
    variants, n = len(kinds), len(rows)
    gt, cn, counts = np.full(n, -1), np.full(n, -1), np.zeros((n, 4))
    method, fit = np.full(variants, "", object), np.full(variants, "", object)
    inv, sizes = np.repeat(kinds == "INV", np.diff(first)), np.diff(first)
    limit = max_overlap * np.where(np.isin(kinds, ("DUP", "CNV")), G.GAIN, 1.0)
    some = lambda hit: np.logical_or.reduceat(hit, first[:-1])
    on = np.ones(variants, bool)
    for attempt in ATTEMPTS:
        has = on & (rows[f"has_{attempt}"].to_numpy(bool)[first[:-1]] if attempt != "given" else True)
        if not has.any():
            continue
        own = rows[[f"{attempt}_{c}" for c in COUNTS]].to_numpy(float)
        counts = np.where(np.repeat(has, sizes)[:, None], own, counts)
        start = _first_genotype(inv, own)
        cnt = (own[:, 0] + own[:, 1] + (own[:, 2] + own[:, 3]) / 2) / avg
        for v in np.flatnonzero(has & some(start == 1) & some(start == 0)):
            at = slice(first[v], first[v + 1])
            found = _inversion(cnt[at], start[at], own[at, 0] + own[at, 1]) if kinds[v] == "INV" else _by_evidence(kinds[v], x[at], cnt[at], limit[v])
            if found:
                gt[at], cn[at], best = found
                method[v], fit[v], on[v] = attempt, _text("CNT" if kinds[v] == "INV" else "DPCNT", best), False
        # a deletion whose breakpoints were found doesn't try others
        on &= ~(has & (kinds == "DEL"))
    for kind in ("DEL", "DUP", "CNV"):
        left = np.flatnonzero((method == "") & (kinds == kind))
        while len(left):
            step = max(1, FIT_SIZE // (7 * int(sizes[left].max())))
            part, left = left[:step], left[step:]
            take = np.concatenate([np.arange(first[v], first[v + 1]) for v in part])
            (px, pa, pb, ppre, ppost), use = G.padded([c[take] for c in (x, two[:, 0], two[:, 1], pre, post)], np.concatenate([[0], np.cumsum(sizes[part])]))
            if kind != "DEL":
                calm = _steady(ppre, use) & _steady(ppost, use)
                part, px, pa, pb, use = part[calm], px[calm], pa[calm], pb[calm], use[calm]
            if not len(part):
                continue
            has_two = ~(np.isnan(np.where(use, pa, 0)) | np.isnan(np.where(use, pb, 0))).any(axis=1)
            for v, (one, pair) in zip(part, _depth_fits(kind, px, (pa, pb), has_two, use, float(limit[part[0]])), strict=True):
                at = slice(first[v], first[v + 1])
                if found := _by_depth(kind, x[at], two[at], pre[at], post[at], one, pair):
                    gt[at], cn[at], one, pair = found
                    method[v], fit[v] = "depth", ";".join(_text(name, f) for name, f in (("DP", one), ("DP2", pair)) if f is not None)
    odd = (cn >= 0) & ((cn < 2) | (cn > 4))
    biallelic = np.isin(kinds, ("DEL", "INV")) | ~some(odd)
    each = lambda a: np.repeat(a, sizes)
    return pd.DataFrame(
        {
            "sv_id": rows["sv_id"].to_numpy(), "sample_id": rows["sample_id"].to_numpy(), "gt": gt, "cn": cn, "method": each(method), "passed": each(method != ""), "fit": each(fit), "biallelic": each(biallelic),
            **{c: counts[:, i].astype(int) for i, c in enumerate(COUNTS)}, **{c: rows[c].to_numpy() for c in _CARRIED},
        }
    )


def call(table: DataFrame, max_overlap: float = G.OVERLAP, together: bool = False) -> DataFrame:
    """sv_id, sample_id, gt, cn (nulls are missing), method (empty: none passed), passed, fit, biallelic, the evidence of the last attempt, and the features.

    ``together``: all rows of a variant lie in one partition already, as ``features`` leaves them.
    """
    shape = "sv_id long, sample_id long, gt int, cn int, method string, passed boolean, fit string, biallelic boolean, " + ", ".join(f"{c} int" for c in COUNTS)
    shape += ", svtype string, " + ", ".join(f"{c} double" for c in _CARRIED[1:])
    table = table.withColumns({c: F.col(c).cast("long") for c in ("sv_id", "sample_id")})
    rows = (table if together else table.repartition("sv_id")).sortWithinPartitions("sv_id", "sample_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, first in G.by_variant(batches):
            yield call_variants(part, first, max_overlap)

    out = rows.mapInPandas(run, shape)
    return out.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in ("gt", "cn")})


def genotype(
    sv: DataFrame, samples: DataFrame, depth: DataFrame, windows: DataFrame, pairs: DataFrame, splits: DataFrame, clips: DataFrame, gc: DataFrame,
    exclude: DataFrame | None = None, force: DataFrame | None = None, region: tuple[int, int, int] | None = None, max_overlap: float = G.OVERLAP, width: int = 100, far_end: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates, break clusters and calls (with features). Samples in ``exclude`` (sample_id) take part in no fit and get no call; the depth gate counts them."""
    sv = stored(eligible(sv, gc, force=force, region=region), "candidates")  # read by every step
    if exclude is not None:
        drop = lambda rows: rows.join(exclude.select("sample_id"), "sample_id", "left_anti")
        pairs, splits, clips = drop(pairs), drop(splits), drop(clips)
    near = stored(E.evidence_near(sv, E.evidence_rows(pairs, splits), far_end), "near")
    clusters = stored(break_clusters(sv, E.split_hits(near), E.clip_modes(sv, clips, ["sample_id", "kind"])), "clusters")
    cells = features(sv, samples, depth, windows, width, clusters, attempt_counts(sv, clusters, near, clips), exclude)
    return sv, clusters, call(cells, max_overlap, together=True)


def sample_cell(kind: Column) -> Column:
    """GT:CN:ND:DP:DD:SP:RP:SC:EC of one sample; DD is before, both inside segments, after."""
    two = lambda c: F.coalesce(F.format_string("%.2f", c), F.lit("."))
    dd = F.when(kind == "INV", F.lit(".")).otherwise(F.concat_ws(",", two(F.col("pre")), two(F.col("first")), two(F.col("second")), two(F.col("post"))))
    number = lambda c: F.col(c).cast("string")
    return F.concat_ws(":", genotype_text(F.coalesce("gt", F.lit(-1))), F.coalesce(number("cn"), F.lit(".")), two(F.col("depth")), two(F.col("raw")), dd, *map(number, COUNTS))


def records(sv: DataFrame, clusters: DataFrame, calls: DataFrame, report_all: bool = False) -> DataFrame:
    """chrnum, pos, sv_id, line: a VCF line for each variant that passed (all of them with ``report_all``), samples in order of id."""
    rows = calls if report_all else calls.where("passed")
    stat = lambda c: F.concat(F.lit(f"{c.upper()}=("), F.format_string("%.2f", F.avg(c)), F.lit(","), F.format_string("%.2f", F.stddev_pop(c)), F.lit(")")).alias(c)
    one = lambda c: F.first(c).alias(c)
    cells = F.sort_array(F.collect_list(F.struct("sample_id", sample_cell(F.col("svtype")).alias("cell")))).alias("cells")
    each = rows.groupBy("sv_id").agg(one("method"), one("passed"), one("fit"), one("biallelic"), stat("pre"), stat("post"), cells)
    at = lambda x: F.floor(x + 0.5).cast("int").cast("string")
    place = F.concat_ws(":", F.transform(F.sort_array(F.collect_list(F.struct("idx", "start", "end"))), lambda c: F.concat(at(c["start"]), F.lit(","), at(c["end"]))))
    breaks = clusters.where("attempt <> 'given'").groupBy("sv_id", F.col("attempt").alias("method")).agg(F.concat(F.upper(F.col("attempt")), F.lit("=("), place, F.lit(")")).alias("breaks"))
    counts = G.genotype_counts(rows.select("sv_id", "gt"))
    whole = sv.join(each, "sv_id").join(counts, "sv_id").join(breaks, ["sv_id", "method"], "left")
    number, size = lambda c: F.col(c).cast("string"), F.col("end") - F.col("pos") + 1
    named = lambda n, c: F.concat(F.lit(n + "="), c)
    info = F.concat_ws(
        ";", named("SVTYPE", F.col("svtype")), named("END", number("end")), named("SVLEN", F.when(F.col("svtype") == "DEL", -size).otherwise(size).cast("string")), named("AC", number("ac")),
        named("NS", number("ns")), named("CALLRATE", F.format_string("%.2f", F.col("callrate"))), named("AF", F.format_string("%.6f", F.col("af"))), named("N_MISS", number("n_miss")),
        named("N_HOMREF", number("n_ref")), named("N_HET", number("n_het")), named("N_HOMALT", number("n_hom")), named("HWECHISQ", F.format_string("%.2f", F.col("hwe"))), "pre", "post",
        F.nullif(F.col("fit"), F.lit("")), F.when(F.col("biallelic"), "Biallelic"), F.when(F.col("method") == "given", "READPAIR").otherwise(F.col("breaks")),
    )
    name = F.concat(F.col("svtype"), F.lit("_"), number("chrnum"), F.lit(":"), number("pos"), F.lit("-"), number("end"))
    line = F.concat_ws(
        "\t", chrom_name(F.col("chrnum")), number("pos"), name, F.lit("."), F.concat(F.lit("<"), "svtype", F.lit(">")), F.lit("."), F.when(F.col("passed"), "PASS").otherwise("FAIL"),
        info, F.lit("GT:CN:ND:DP:DD:SP:RP:SC:EC"), F.array_join(F.transform("cells", lambda c: c["cell"]), "\t"),
    )
    return whole.select("chrnum", "pos", "sv_id", line.alias("line"))
