"""Cohort genotyping: labels, mixture fits and break clusters per variant.

Fits run over batches of whole variants as arrays; ``fitted_by_sums`` fits cohorts whose
variants are too large for a task. Break clusters are array expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mixture as M
from ..functions.scalars import normal_pdf, normal_pdf_2d
from ..store import stored

#: Greatest overlap of two components; half as much again for gains.
OVERLAP, GAIN = 0.2, 1.5
DEL_STARTS = ([1.0], [1.0, 0.5], [1.0, 0.5, 0.0])
DUP_STARTS = tuple([1.0 + 0.5 * i for i in range(k)] for k in range(1, 8))


def deletion_label(depth: Column, cnt: Column) -> Column:
    return F.when((depth <= 0.65) & (cnt >= 0.1), F.when(depth < 0.2, 2).otherwise(1)).when((cnt < 0.05) & (depth > 0.85), 0)


def gain_label(depth: Column, cnt: Column) -> Column:
    carrier = (depth >= 1.35) & (cnt >= 0.1)
    return F.when(carrier, F.when(depth > 1.85, F.round(2 * depth).cast("int") - 2).otherwise(1)).when((cnt < 0.05) & (depth > 0.8) & (depth < 1.2), 0)


def hardy_weinberg(ref: Column, het: Column, hom: Column) -> Column:
    """Chi-square of genotype counts over the classes that are expected at all."""
    n = ref + het + hom
    p, q = (2 * ref + het) / (2 * n), (het + 2 * hom) / (2 * n)
    term = lambda seen, expect: F.when(expect > 0, (expect - seen) * (expect - seen) / expect).otherwise(F.lit(0.0))
    return F.when(n > 0, term(ref, n * p * p) + term(het, n * 2 * p * q) + term(hom, n * q * q))


def genotype_counts(calls: DataFrame) -> DataFrame:
    """sv_id, n_miss, n_ref, n_het, n_hom, ac, ns, callrate, af, hwe."""
    n = lambda v: F.count_if(F.col("gt") == v)
    c = calls.groupBy("sv_id").agg(F.count_if(F.coalesce("gt", F.lit(-1)) < 0).alias("n_miss"), n(0).alias("n_ref"), n(1).alias("n_het"), n(2).alias("n_hom"), F.count("*").alias("n"))
    c = c.withColumn("ns", F.col("n_ref") + F.col("n_het") + F.col("n_hom")).withColumn("ac", F.col("n_het") + 2 * F.col("n_hom"))
    return c.select(
        "sv_id", "n_miss", "n_ref", "n_het", "n_hom", "ac", "ns", (F.col("ns") / F.col("n")).alias("callrate"),
        F.when(F.col("ns") > 0, F.col("ac") / (2 * F.col("ns"))).otherwise(0.0).alias("af"),
        F.coalesce(hardy_weinberg(F.col("n_ref"), F.col("n_het"), F.col("n_hom")), F.lit(0.0)).alias("hwe"),
    )


def labels(kind: str, x: np.ndarray, cnt: np.ndarray) -> np.ndarray:
    """As ``deletion_label`` and ``gain_label``, for a group's arrays; -1 for none."""
    if kind == "DEL":
        return np.where((x <= 0.65) & (cnt >= 0.1), np.where(x < 0.2, 2, 1), np.where((cnt < 0.05) & (x > 0.85), 0, -1))
    carrier = np.where(x > 1.85, np.floor(2 * x + 0.5).astype(int) - 2, 1)
    return np.where((x >= 1.35) & (cnt >= 0.1), carrier, np.where((cnt < 0.05) & (x > 0.8) & (x < 1.2), 0, -1))


def padded(columns: list[np.ndarray], first: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns of rows sorted by variant as arrays of variants x samples, and a mask; ``first``: where each variant's rows begin, and their number."""
    sizes = np.diff(first)
    use = np.arange(sizes.max(initial=0)) < sizes[:, None]
    out = []
    for c in columns:
        a = np.zeros(use.shape)
        a[use] = c
        out.append(a)
    return out, use


def by_variant(batches: Iterator[pd.DataFrame], rows_at_once: int = 50_000) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Sorted rows as tables of whole variants (about ``rows_at_once`` rows, one variant at least), and where each variant begins."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        if sum(map(len, held)) >= rows_at_once:
            rows = pd.concat(held, ignore_index=True)
            ids = rows["sv_id"].to_numpy()
            cut = int(np.searchsorted(ids, ids[-1]))  # the last variant may go on
            if cut:
                yield rows.iloc[:cut], _starts(ids[:cut])
            held = [rows.iloc[cut:].reset_index(drop=True)]
    rows = pd.concat(held, ignore_index=True) if held else None
    if rows is not None and len(rows):
        yield rows, _starts(rows["sv_id"].to_numpy())


def _starts(ids: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]])


def _sorted_variants(rows: DataFrame) -> DataFrame:
    return rows.repartition("sv_id").sortWithinPartitions("sv_id", "sample_id")


def fitted(cohort: DataFrame, dims: int, starts) -> DataFrame:
    """sv_id, comp, mean, spread, alpha, bic, overlap: the chosen mixture of each variant. Variants of a batch are fitted together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, first in by_variant(batches):
            columns, use = padded([rows[c].to_numpy(float) for c in ("depth", "depth2")[:dims]], first)
            many = (lambda s: M.em_1d_many(columns[0], use, s)) if dims == 1 else (lambda s: M.em_2d_many(np.stack(columns, axis=2), use, s))
            fits = [many(list(s)) for s in starts]
            best = np.maximum(M.select_many(fits, np.full(len(use), OVERLAP)), 0)
            ids = rows["sv_id"].to_numpy()[first[:-1]]
            for i, f in enumerate(fits):
                at = np.flatnonzero(best == i)
                k = f.alphas.shape[1]
                spread = f.spreads if dims == 1 else np.sqrt(f.spreads[..., 0, 0])
                flat = lambda a: a[at].ravel()  # noqa: B023, E731
                yield pd.DataFrame(
                    {"sv_id": np.repeat(ids[at], k), "comp": np.tile(np.arange(k), len(at)), "mean": flat(f.means[..., 0]), "spread": flat(spread), "alpha": flat(f.alphas), "bic": np.repeat(f.bic[at], k), "overlap": np.repeat(f.overlap[at], k)}
                )

    columns = ["sv_id", "sample_id", "depth", "depth2"][: 2 + dims]
    return _sorted_variants(cohort.select(*columns)).mapInPandas(run, "sv_id long, comp int, mean double, spread double, alpha double, bic double, overlap double")


def _sums_1d(rows: DataFrame, params: DataFrame, start: list[float]) -> DataFrame:
    """One round in one dimension: each sample's shares, added up by variant and component about the old means, give the new ones."""
    k, x = len(start), F.col("depth")
    p = [F.col(f"a{c}") * normal_pdf(x, F.col(f"m{c}"), F.col(f"s{c}")) for c in range(k)]
    met = rows.join(params, "sv_id").select("sv_id", *[(x - F.col(f"m{c}")).alias(f"d{c}") for c in range(k)], *[v.alias(f"p{c}") for c, v in enumerate(p)], *[f"m{c}" for c in range(k)])
    total = sum((F.col(f"p{c}") for c in range(k)), F.lit(0.0))
    share = lambda c: F.when(F.col("_t") >= M.OUTLIER_1D, F.col(f"p{c}") / F.col("_t")).otherwise(F.lit(0.0))
    met = met.withColumn("_t", total)
    sums = met.groupBy("sv_id").agg(*[e for c in range(k) for e in (F.first(f"m{c}").alias(f"m{c}"), F.sum(share(c)).alias(f"w{c}"), F.sum(share(c) * F.col(f"d{c}")).alias(f"x{c}"), F.sum(share(c) * F.col(f"d{c}") * F.col(f"d{c}")).alias(f"q{c}"))])
    weight = [F.col(f"w{c}") + M.PSEUDO for c in range(k)]
    whole = sum(weight, F.lit(0.0))
    out = []
    for c, v in enumerate(start):
        shift = (F.col(f"x{c}") + (v - F.col(f"m{c}")) * M.PSEUDO) / weight[c]
        spread = F.col(f"q{c}") - 2 * shift * F.col(f"x{c}") + shift * shift * F.col(f"w{c}") + M.PRIOR_VARIANCE * M.PSEUDO
        out += [(F.col(f"m{c}") + shift).alias(f"m{c}"), F.sqrt(spread / weight[c]).alias(f"s{c}"), (weight[c] / whole).alias(f"a{c}")]
    return sums.select("sv_id", *out)


def _regular(a: Column, b: Column, c: Column) -> Column:
    """What is added to the diagonal of [[a, b], [b, c]] so that its determinant is 1e-20 or more: the least multiple of 1e-10."""
    least = (-(a + c) + F.sqrt((a + c) * (a + c) - 4 * (a * c - b * b - 1e-20))) / 2
    return F.when(a * c - b * b < 1e-20, F.ceil(least / 1e-10) * 1e-10).otherwise(F.lit(0.0))


def _sums_2d(rows: DataFrame, params: DataFrame, start: list[float]) -> DataFrame:
    """One round in two dimensions, as ``_sums_1d``."""
    k, at, free = len(start), range(len(start)), [v >= 0.01 for v in start]
    dx, dy = [F.col("depth") - F.col(f"m{c}") for c in at], [F.col("depth2") - F.col(f"n{c}") for c in at]
    p = [F.col(f"a{c}") * normal_pdf_2d(F.col("depth"), F.col("depth2"), *[F.col(f"{n}{c}") for n in ("m", "n", "xx", "xy", "yy")]) for c in at]
    met = rows.join(params, "sv_id").select("sv_id", *[f"{n}{c}" for c in at for n in "mn"], *[e for c in at for e in (dx[c].alias(f"x{c}"), dy[c].alias(f"y{c}"), p[c].alias(f"p{c}"))])
    met = met.withColumn("_t", sum((F.col(f"p{c}") for c in at), F.lit(0.0)))
    share = lambda c: F.when(F.col("_t") >= M.OUTLIER_2D, F.col(f"p{c}") / F.col("_t")).otherwise(F.lit(0.0))
    moments = {"w": lambda c: F.lit(1.0), "sx": lambda c: F.col(f"x{c}"), "sy": lambda c: F.col(f"y{c}"), "sxx": lambda c: F.col(f"x{c}") * F.col(f"x{c}"), "sxy": lambda c: F.col(f"x{c}") * F.col(f"y{c}"), "syy": lambda c: F.col(f"y{c}") * F.col(f"y{c}")}
    sums = met.groupBy("sv_id").agg(*[F.first(f"{n}{c}").alias(f"{n}{c}") for c in at for n in "mn"], *[F.sum(share(c) * f(c)).alias(f"{n}{c}") for c in at for n, f in moments.items()])
    col = lambda n, c: F.col(f"{n}{c}")
    weight = [col("w", c) + (M.PSEUDO if free[c] else 0.0) for c in at]
    whole, out = sum(weight, F.lit(0.0)), []
    for c, v in enumerate(start):
        some = F.greatest(weight[c], F.lit(1e-300))
        gx, gy = ((col("sx", c) + (v - col("m", c)) * M.PSEUDO) / some, (col("sy", c) + (v - col("n", c)) * M.PSEUDO) / some) if free[c] else (F.lit(0.0), F.lit(0.0))
        mx, my = col("m", c) + gx, col("n", c) + gy
        prior = lambda a, b, diagonal: (a * b + (M.PRIOR_VARIANCE * M.PSEUDO if diagonal else 0.0)) if free[c] else F.lit(0.0)  # noqa: B023, E731
        xx = (col("sxx", c) - 2 * gx * col("sx", c) + gx * gx * col("w", c) + prior(v - mx, v - mx, True)) / some
        xy = (col("sxy", c) - gx * col("sy", c) - gy * col("sx", c) + gx * gy * col("w", c) + prior(v - mx, v - my, False)) / some
        yy = (col("syy", c) - 2 * gy * col("sy", c) + gy * gy * col("w", c) + prior(v - my, v - my, True)) / some
        out += [mx.alias(f"m{c}"), my.alias(f"n{c}"), xx.alias(f"xx{c}"), xy.alias(f"xy{c}"), yy.alias(f"yy{c}"), (weight[c] / whole).alias(f"a{c}")]
    raw = sums.select("sv_id", *out)
    more = {f"{n}{c}": F.col(f"{n}{c}") + _regular(F.col(f"xx{c}"), F.col(f"xy{c}"), F.col(f"yy{c}")) for c in at for n in ("xx", "yy")}
    return raw.withColumns(more)


def fitted_by_sums(cohort: DataFrame, start: list[float], dims: int = 1, keep: int = 5) -> DataFrame:
    """sv_id, comp, mean, spread, alpha, bic: the mixture from one start (two components at least) for cohorts of any size.

    No task needs a variant whole: samples meet their variant's parameters in a join, and sums of
    shares, added up in part where the samples are, give the next ones. Parameters are
    written every ``keep`` rounds, so that plans stay short.
    """
    k = len(start)
    if k < 2:
        raise ValueError("one component needs no rounds: take mean and deviation")
    rows = cohort.select("sv_id", *("depth", "depth2")[:dims])
    first = {1: lambda c: ((start[c], "m"), (0.1, "s"), (1 / k, "a")), 2: lambda c: ((start[c], "m"), (start[c], "n"), (0.1, "xx"), (0.0, "xy"), (0.1, "yy"), (1 / k, "a"))}[dims]
    params = rows.select("sv_id").distinct().select("sv_id", *[F.lit(float(v)).alias(f"{n}{c}") for c in range(k) for v, n in first(c)])
    for i in range(1, M.ROUNDS + 1):
        params = (_sums_1d if dims == 1 else _sums_2d)(rows, params, start)
        if i % keep == 0 or i == M.ROUNDS:
            params = stored(params, "mixtures")
    if dims == 1:
        p = [F.col(f"a{c}") * normal_pdf(F.col("depth"), F.col(f"m{c}"), F.col(f"s{c}")) for c in range(k)]
    else:
        p = [F.col(f"a{c}") * normal_pdf_2d(F.col("depth"), F.col("depth2"), *[F.col(f"{n}{c}") for n in ("m", "n", "xx", "xy", "yy")]) for c in range(k)]
    seen = rows.join(params, "sv_id").select("sv_id", sum(p, F.lit(0.0)).alias("t")).groupBy("sv_id").agg(F.sum(F.when(F.col("t") > 0, F.log("t")).otherwise(0.0)).alias("ll"), F.count("*").alias("n"))
    free = 3 * k - 1 if dims == 1 else 6 * k - 1
    both = params.join(seen.select("sv_id", (-F.col("ll") + 0.5 * free * F.log(F.col("n").cast("double"))).alias("bic")), "sv_id")
    spread = lambda c: F.col(f"s{c}") if dims == 1 else F.sqrt(f"xx{c}")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("comp"), F.col(f"m{c}").alias("mean"), spread(c).alias("spread"), F.col(f"a{c}").alias("alpha")) for c in range(k)]))
    return both.select("sv_id", "bic", each.alias("e")).select("sv_id", "e.*", "bic")


def per_variant(cohort: DataFrame, one: Callable[[pd.DataFrame], pd.DataFrame], shape: str) -> DataFrame:
    """``one`` of each variant's rows, in order of samples. Partitions are sorted and read in batches of whole variants."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, first in by_variant(batches):
            yield pd.concat([one(rows.iloc[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)], ignore_index=True)

    return _sorted_variants(cohort).mapInPandas(run, shape)


def labelled(cohort: DataFrame, columns: list[str], most: int = 3) -> DataFrame:
    """sv_id, label, mean, spread, alpha of one column, or sv_id, label, mean_x, mean_y, cxx, cxy, cyy, alpha of two; overlap: the fits that the joint steps of the plan start from."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        x, label = rows[columns].to_numpy(float), rows["label"].to_numpy()
        fit = M.labelled_1d(x[:, 0], label, most) if len(columns) == 1 else M.labelled_2d(x, label, most)
        there = [c for c in range(most) if (label == c).any()]
        if fit is None:
            return pd.DataFrame(columns=[f.split()[0] for f in shape.split(", ")])
        out = {"sv_id": rows["sv_id"].iloc[0], "label": there, "n": [int((label == c).sum()) for c in there]}
        if len(columns) == 1:
            out |= {"mean": fit.means[:, 0], "spread": fit.spreads}
        else:
            out |= {"mean_x": fit.means[:, 0], "mean_y": fit.means[:, 1], "cxx": fit.spreads[:, 0, 0], "cxy": fit.spreads[:, 0, 1], "cyy": fit.spreads[:, 1, 1]}
        return pd.DataFrame(out | {"alpha": fit.alphas, "overlap": fit.overlap, "falls": M.falling(fit)})

    numbers = "mean double, spread double" if len(columns) == 1 else "mean_x double, mean_y double, cxx double, cxy double, cyy double"
    shape = f"sv_id long, label int, n long, {numbers}, alpha double, overlap double, falls boolean"
    return per_variant(cohort.select("sv_id", "sample_id", "label", *columns), one, shape)


def assigned(cohort: DataFrame, columns: list[str], fit: M.Mixture, how: Callable[[np.ndarray, M.Mixture], np.ndarray], name: str) -> DataFrame:
    """sv_id, sample_id and as ``name`` what ``how`` (a rule of ``mixture``) gives each sample by a mixture that is known."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows[columns].to_numpy(float)
        return pd.DataFrame({"sv_id": rows["sv_id"], "sample_id": rows["sample_id"], name: how(x[:, 0] if len(columns) == 1 else x, fit)})

    return per_variant(cohort.select("sv_id", "sample_id", *columns), one, f"sv_id long, sample_id long, {name} int")


def scored(cohort: DataFrame, fit: M.Mixture) -> DataFrame:
    """sv_id, bic, aic of a known mixture of depth."""
    k = len(fit.alphas)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows["depth"].to_numpy(float)
        bic = M._bic(M.density_1d(x, fit.means[:, 0], fit.spreads), fit.alphas, 3 * k - 1)
        return pd.DataFrame({"sv_id": [rows["sv_id"].iloc[0]], "bic": [bic], "aic": [bic - 0.5 * (3 * k - 1) * np.log(len(x)) + 3 * k - 1]})

    return per_variant(cohort.select("sv_id", "sample_id", "depth"), one, "sv_id long, bic double, aic double")


def moments(rows: DataFrame, by: list[str], x: str = "depth", y: str = "cnt") -> DataFrame:
    """by, n, mean_x, mean_y, cxx, cxy, cyy: population moments of two columns."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.var_pop(x).alias("cxx"), F.covar_pop(x, y).alias("cxy"), F.var_pop(y).alias("cyy"))


def reducers(rows: DataFrame, x: str = "depth") -> DataFrame:
    """sv_id, mean, sd (0.01 of a single sample), lo, hi, med."""
    sd = F.when(F.count("*") <= 1, 0.01).otherwise(F.stddev_pop(x))
    return rows.groupBy("sv_id").agg(F.avg(x).alias("mean"), sd.alias("sd"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.median(x).alias("med"))


def off_flank(x: np.ndarray, cn: np.ndarray, flank: np.ndarray) -> np.ndarray:
    """Samples whose flank is odd in the cohort, and those with a copy number that look like their flank: gains by depth alone leave them out."""
    m, s = flank.mean(), flank.std()
    return (np.abs(flank - m) > 2 * s) | ((cn > 0) & (np.abs(x - flank) < 2 * s))


def kmeans_labels(cohort: DataFrame, starts=(1.0, 0.5, 0.0)) -> DataFrame:
    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("sample_id")
        _, label = M.kmeans_1d(group["depth"].to_numpy(float), list(starts))
        return pd.DataFrame({"sv_id": group["sv_id"], "sample_id": group["sample_id"], "label": label})

    return cohort.groupBy("sv_id").applyInPandas(one, "sv_id long, sample_id long, label int")


def _folded(points: Column, reach: float) -> Column:
    """array<struct<s, e, n>>: clusters of points (s, e, n) in order. A point joins the nearest cluster (the first of equally near ones) within ``reach``, weighted by n, or opens one."""
    none = F.filter(points, lambda p: F.lit(False))

    def add(held: Column, p: Column) -> Column:
        far = F.transform(held, lambda c, i: F.struct((F.abs(c["s"] - p["s"]) + F.abs(c["e"] - p["e"])).alias("d"), i.alias("i")))
        near = F.array_min(far)

        def moved(c: Column, i: Column) -> Column:
            n = c["n"] + p["n"]
            new = F.struct((c["s"] + (p["s"] - c["s"]) * p["n"] / n).alias("s"), (c["e"] + (p["e"] - c["e"]) * p["n"] / n).alias("e"), n.alias("n"))
            return F.when(i == near["i"], new).otherwise(c)

        return F.when(near["d"] <= reach, F.transform(held, moved)).otherwise(F.concat(held, F.array(p)))

    return F.aggregate(points, none, add)


def consensus(breaks: DataFrame, least: int = 3, reach: float = 6.0) -> DataFrame:
    """sv_id, idx, start, end, n: breakpoint clusters; each sample's points in order make clusters, whose largest (of ``least`` or more) join the cohort's.

    Equal points are counted first, so a sample's list is bounded by the places around a
    variant's ends and not by its reads. Both folds are array expressions.
    """
    place = breaks.groupBy("sv_id", "sample_id", F.col("start").cast("double").alias("s"), F.col("end").cast("double").alias("e")).agg(F.count("*").alias("n"))
    own = place.groupBy("sv_id", "sample_id").agg(F.sort_array(F.collect_list(F.struct("s", "e", "n"))).alias("points"))
    found = own.withColumn("c", _folded(F.col("points"), reach))
    # the first of the largest
    best = F.array_max(F.transform("c", lambda c, i: F.struct(c["n"].alias("n"), (-i).alias("i"))))
    own = found.withColumn("b", F.get("c", -best["i"])).where(F.col("b.n") >= least)
    return cohort_clusters(own.select("sv_id", "sample_id", F.col("b.s").alias("start"), F.col("b.e").alias("end"), F.col("b.n").alias("n")), reach)


def cohort_clusters(points: DataFrame, reach: float = 6.0) -> DataFrame:
    """As ``consensus``, from one breakpoint (start, end, n reads) for each sample, in order of samples."""
    p = F.struct("sample_id", F.col("start").cast("double").alias("s"), F.col("end").cast("double").alias("e"), F.col("n").cast("long").alias("n"))
    rows = points.groupBy("sv_id").agg(F.sort_array(F.collect_list(p)).alias("points"))
    bare = F.transform("points", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["n"].alias("n")))
    each = rows.select("sv_id", F.posexplode(_folded(bare, reach)).alias("idx", "c"))
    return each.select("sv_id", "idx", F.col("c.s").alias("start"), F.col("c.e").alias("end"), F.col("c.n").cast("int").alias("n"))


def modal_cluster(clusters: DataFrame) -> DataFrame:
    """sv_id, start, end, n: the largest cluster, the first of equally large ones."""
    best = F.max(F.struct("n", (-F.col("idx")).alias("i"), "start", "end")).alias("b")
    return clusters.groupBy("sv_id").agg(best).select("sv_id", "b.start", "b.end", "b.n")


def joint_fit(cohort: DataFrame) -> DataFrame:
    """sv_id, comps, bic, overlap: depth and evidence together, one component against labelled fits of two and three."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("sample_id")
        xy = group[["depth", "cnt"]].to_numpy(float)
        label = labels("DEL", *xy.T)
        fits = [M.em_2d(xy, [1.0])] + [f for k in (2, 3) if (f := M.labelled_2d(xy, label, k))]
        best = M.select(fits, OVERLAP) or fits[0]
        return pd.DataFrame({"sv_id": [group["sv_id"].iloc[0]], "comps": [len(best.alphas)], "bic": [best.bic], "overlap": [best.overlap]})

    return cohort.groupBy("sv_id").applyInPandas(one, "sv_id long, comps int, bic double, overlap double")
