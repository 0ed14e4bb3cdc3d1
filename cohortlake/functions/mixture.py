"""Gaussian mixtures of one and two dimensions, in numpy, for many variants at once.

The ``_many`` functions take arrays of variants x samples (and a mask, where variants differ in
their samples); the rounds and starts are fixed, so all variants advance together.

Fits run 15 rounds from given means. A pseudo-count of 0.2 pulls each mean to its start
and each variance to 0.01. Samples that no component explains are left out of a round.
Scores are half the usual scale: -LL + (3k - 1) / 2 ln n (6k - 1 in two dimensions).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ROUNDS, PSEUDO, PRIOR_VARIANCE, LEAST_SD = 15, 0.2, 0.01, 1e-4
OUTLIER_1D, OUTLIER_2D = 1e-20, 1e-5


@dataclass
class Mixture:
    means: np.ndarray  # k x d
    spreads: np.ndarray  # k sds, or k x 2 x 2 covariances
    alphas: np.ndarray
    bic: float
    overlap: float


def density_1d(x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """Components x samples."""
    sd = np.maximum(sd, LEAST_SD)[:, None]
    return np.exp(-0.5 * ((x[None] - mean[:, None]) / sd) ** 2) / (sd * np.sqrt(2 * np.pi))


def _det(cov: np.ndarray) -> np.ndarray:
    return cov[..., 0, 0] * cov[..., 1, 1] - cov[..., 0, 1] * cov[..., 1, 0]


def regular(cov: np.ndarray) -> np.ndarray:
    """Covariances with as much added to their diagonals as keeps each determinant at 1e-20 or more."""
    cov = cov.copy()
    while (low := _det(cov) < 1e-20).any():
        cov[low] += 1e-10 * np.eye(2)
    return cov


def density_2d(xy: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Components x samples."""
    cov = regular(np.asarray(cov, float))
    det = _det(cov)[:, None]
    x, y = (xy[None] - mean[:, None]).transpose(2, 0, 1)
    a, b, c = (cov[:, i, j][:, None] for i, j in ((0, 0), (0, 1), (1, 1)))
    return np.exp(-0.5 * (c * x * x - 2 * b * x * y + a * y * y) / det) / (2 * np.pi * np.sqrt(det))


@dataclass
class Mixtures:
    """The fits of many variants with equally many components."""

    means: np.ndarray  # variants x k x d
    spreads: np.ndarray
    alphas: np.ndarray
    bic: np.ndarray
    overlap: np.ndarray

    def __getitem__(self, i: int) -> Mixture:
        return Mixture(self.means[i], self.spreads[i], self.alphas[i], float(self.bic[i]), float(self.overlap[i]))


def overlap_1d(mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """Greatest Bhattacharyya coefficient of two components; the last axis is that of components."""
    best = np.zeros(mean.shape[:-1])
    for i in range(mean.shape[-1]):
        for j in range(i):
            v = sd[..., i] ** 2 + sd[..., j] ** 2
            best = np.maximum(best, np.exp(-0.25 * (mean[..., i] - mean[..., j]) ** 2 / v - 0.5 * np.log(v / (2 * sd[..., i] * sd[..., j]))))
    return best


def overlap_2d(mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """As in one dimension; the factor 1/8 belongs to the first coordinate's term only (kept for equal model choice)."""
    least = np.full(mean.shape[:-2], np.inf)
    own = _det(regular(cov))
    for i in range(mean.shape[-2]):
        for j in range(i):
            c, m = (cov[..., i, :, :] + cov[..., j, :, :]) / 2, mean[..., j, :] - mean[..., i, :]
            det = _det(c)
            safe = np.where(np.abs(det) > 1e-300, det, 1e-300)
            x, y = m[..., 0], m[..., 1]
            first = (x * c[..., 1, 1] - y * c[..., 1, 0]) / safe * x
            second = (y * c[..., 0, 0] - x * c[..., 0, 1]) / safe * y
            spread = np.sqrt(np.maximum(1e-40, own[..., i] * own[..., j]))
            least = np.minimum(least, 0.125 * first + second + 0.5 * np.log(np.maximum(det, 1e-20) / spread))
    return np.exp(-least)


def _bic(density: np.ndarray, alphas: np.ndarray, free: int) -> float:
    total = alphas @ density
    seen = total > 0
    return float(-np.log(total[seen]).sum() + 0.5 * free * np.log(max(1, density.shape[1])))


def _bic_many(p: np.ndarray, use: np.ndarray, free: int) -> np.ndarray:
    """``p``: weighted densities, variants x components x samples."""
    total = p.sum(axis=1)
    seen = (total > 0) & use
    return -np.log(np.where(seen, total, 1)).sum(axis=1) + 0.5 * free * np.log(np.maximum(1, use.sum(axis=1)))


def _density_1d(x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """Variants x components x samples."""
    sd = np.maximum(sd, LEAST_SD)[..., None]
    return np.exp(-0.5 * ((x[:, None] - mean[..., None]) / sd) ** 2) / (sd * np.sqrt(2 * np.pi))


def _density_2d(xy: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Variants x components x samples; ``xy`` is variants x samples x 2."""
    cov = regular(cov)
    det = _det(cov)[..., None]
    d = xy[:, None] - mean[:, :, None]
    x, y = d[..., 0], d[..., 1]
    a, b, c = cov[..., 0, 0, None], cov[..., 0, 1, None], cov[..., 1, 1, None]
    return np.exp(-0.5 * (c * x * x - 2 * b * x * y + a * y * y) / det) / (2 * np.pi * np.sqrt(det))


def _shares(p: np.ndarray, use: np.ndarray, least: float) -> np.ndarray:
    """Responsibilities; samples that no component explains, or that aren't there, have none."""
    total = p.sum(axis=1)
    ok = (total >= least) & use
    return np.where(ok[:, None], p / np.where(ok, total, 1)[:, None], 0)


def em_1d_many(x: np.ndarray, use: np.ndarray, start: list[float]) -> Mixtures:
    """``x``: variants x samples; ``use``: which of them are there."""
    start, n, k = np.asarray(start, float), np.maximum(use.sum(axis=1), 1)[:, None], len(start)
    x = np.where(use, x, 0.0)
    if k == 1:
        mean = x.sum(axis=1, keepdims=True) / n
        sd = np.maximum(np.sqrt((np.where(use, x - mean, 0) ** 2).sum(axis=1, keepdims=True) / n), LEAST_SD)
        return Mixtures(mean[..., None], sd, np.ones_like(sd), _bic_many(_density_1d(x, mean, sd), use, 2), np.zeros(len(x)))
    mean, sd, alpha = np.tile(start, (len(x), 1)), np.full((len(x), k), 0.1), np.full((len(x), k), 1 / k)
    for _ in range(ROUNDS):
        p = _shares(alpha[..., None] * _density_1d(x, mean, sd), use, OUTLIER_1D)
        weight = p.sum(axis=2) + PSEUDO
        mean = ((p * x[:, None]).sum(axis=2) + start * PSEUDO) / weight
        sd = np.sqrt(((p * (x[:, None] - mean[..., None]) ** 2).sum(axis=2) + PRIOR_VARIANCE * PSEUDO) / weight)
        alpha = weight / weight.sum(axis=1, keepdims=True)
    return Mixtures(mean[..., None], sd, alpha, _bic_many(alpha[..., None] * _density_1d(x, mean, sd), use, 3 * k - 1), overlap_1d(mean, sd))


def em_2d_many(xy: np.ndarray, use: np.ndarray, start: list[float]) -> Mixtures:
    """``xy``: variants x samples x 2. Each start mean holds for both coordinates; a component that starts at (0, 0) keeps its mean and gets no pseudo-count."""
    start, n, k = np.repeat(np.asarray(start, float)[:, None], 2, axis=1), np.maximum(use.sum(axis=1), 1), len(start)
    xy = np.where(use[..., None], xy, 0.0)
    if k == 1:
        mean = xy.sum(axis=1) / n[:, None]
        d = np.where(use[..., None], xy - mean[:, None], 0)
        mean, cov = mean[:, None], regular(d.transpose(0, 2, 1) @ d / n[:, None, None])[:, None]
        return Mixtures(mean, cov, np.ones((len(xy), 1)), _bic_many(_density_2d(xy, mean, cov), use, 5), np.zeros(len(xy)))
    mean, cov, alpha = np.tile(start, (len(xy), 1, 1)), np.tile(0.1 * np.eye(2), (len(xy), k, 1, 1)), np.full((len(xy), k), 1 / k)
    free = (start >= 0.01).any(axis=1)
    for _ in range(ROUNDS):
        p = _shares(alpha[..., None] * _density_2d(xy, mean, cov), use, OUTLIER_2D)
        weight = p.sum(axis=2) + PSEUDO * free
        some = np.maximum(weight, 1e-300)
        mean = np.where(free[:, None], (p @ xy + start * PSEUDO * free[:, None]) / some[..., None], mean)
        d = xy[:, None] - mean[:, :, None]
        scatter = (p[..., None] * d).swapaxes(2, 3) @ d
        pull = start - mean
        prior = pull[..., :, None] * pull[..., None, :] + PRIOR_VARIANCE * PSEUDO * np.eye(2)
        cov = regular((scatter + prior * free[:, None, None]) / some[..., None, None])
        alpha = weight / weight.sum(axis=1, keepdims=True)
    return Mixtures(mean, cov, alpha, _bic_many(alpha[..., None] * _density_2d(xy, mean, cov), use, 6 * k - 1), overlap_2d(mean, cov))


def em_1d(x: np.ndarray, start: list[float]) -> Mixture:
    x = np.asarray(x, float)[None]
    return em_1d_many(x, np.ones(x.shape, bool), start)[0]


def em_2d(xy: np.ndarray, start: list[float]) -> Mixture:
    xy = np.asarray(xy, float)[None]
    return em_2d_many(xy, np.ones(xy.shape[:2], bool), start)[0]


def select_many(fits: list[Mixtures], most_overlap: np.ndarray) -> np.ndarray:
    """For each variant the index of its lowest score among the fits that overlap less than the limit; -1 without any."""
    score = np.stack([np.where(f.overlap < most_overlap, f.bic, np.inf) for f in fits])
    return np.where(np.isfinite(score).any(axis=0), score.argmin(axis=0), -1)


def select(fits: list[Mixture], most_overlap: float) -> Mixture | None:
    """The lowest score among those whose components overlap less than the limit."""
    return min((f for f in fits if f.overlap < most_overlap), key=lambda f: f.bic, default=None)


def labelled_1d(x: np.ndarray, label: np.ndarray, k: int) -> Mixture | None:
    """Moments of the labels 0 .. k-1; the score counts all samples. None without two labels that have samples."""
    parts = [x[label == c] for c in range(k) if (label == c).any()]
    if len(parts) < 2:
        return None
    mean, sd = np.array([p.mean() for p in parts]), np.array([max(p.std(), LEAST_SD) for p in parts])
    alpha = np.array([len(p) for p in parts]) / sum(map(len, parts))
    return Mixture(mean[:, None], sd, alpha, _bic(density_1d(x, mean, sd), alpha, 3 * len(parts) - 1), float(overlap_1d(mean, sd)))


def labelled_2d(xy: np.ndarray, label: np.ndarray, k: int) -> Mixture | None:
    """Moments of the labels 0 .. k-1, those without samples left out; the score counts all samples. None without two labels that have samples."""
    mean, cov, alpha = [], [], []
    for c in range(k):
        part = xy[label == c]
        if not len(part):
            continue
        mean.append(part.mean(axis=0))
        cov.append(regular(np.cov(part.T, bias=True).reshape(2, 2)))
        alpha.append(len(part))
    if len(mean) < 2:
        return None
    mean, cov, alpha = np.stack(mean), np.stack(cov), np.array(alpha) / sum(alpha)
    return Mixture(mean, cov, alpha, _bic(density_2d(xy, mean, cov), alpha, 6 * len(alpha) - 1), float(overlap_2d(mean, cov)))


def falling(fit: Mixture) -> bool:
    """Shape of a deletion: the first mean near 1, the second near 1/2, steps of 0.3 at least. In two dimensions the steps are of sums."""
    m = fit.means
    if m.shape[1] == 1:
        m = m[:, 0]
        return bool(len(m) > 1 and 0.8 <= m[0] <= 1.2 and 0.4 <= m[1] <= 0.65 and (-np.diff(m) >= 0.3).all())
    near = len(m) > 1 and m[0, 0] >= 0.8 and 0.8 <= m[0, 1] <= 1.2
    return bool(near and not (m[1] < 0.4).all() and not (m[1] > 0.6).all() and (-np.diff(m.sum(axis=1)) >= 0.6).all())


def rising(fit: Mixture) -> bool:
    """Shape of a gain: the first mean near 1, the second 1.4 at least, steps of 0.3 at least."""
    m = fit.means
    if m.shape[1] == 1:
        m = m[:, 0]
        return bool(len(m) > 1 and 0.8 <= m[0] <= 1.2 and m[1] >= 1.4 and (np.diff(m) >= 0.3).all())
    near = len(m) > 1 and m[0, 0] >= 0.8 and 0.8 <= m[0, 1] <= 1.2
    return bool(near and not (m[1] < 1.4).all() and (np.diff(m.sum(axis=1)) >= 0.6).all())


def _likeliest(density: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest component (without its weight), and whether the runner-up comes near."""
    order = np.sort(density, axis=0)
    near = order[-2] / np.maximum(order[-1], 1e-300) > ratio if len(density) > 1 else np.zeros(density.shape[1], bool)
    return density.argmax(axis=0), near


def cluster_1d(x: np.ndarray, fit: Mixture, ratio: float = 0.1) -> np.ndarray:
    best, near = _likeliest(density_1d(x, fit.means[:, 0], fit.spreads), ratio)
    return np.where(near, -1, best)


def copy_number_2d(xy: np.ndarray, fit: Mixture, ratio: float = 0.1) -> np.ndarray:
    """round(mean + mean) of the likeliest component, or -1 when that isn't floor or ceiling of x + y or the runner-up comes near."""
    best, near = _likeliest(density_2d(xy, fit.means, fit.spreads), ratio)
    cn, both = np.floor(fit.means[best].sum(axis=1) + 0.5).astype(int), xy.sum(axis=1)
    return np.where(near | ((cn != np.ceil(both)) & (cn != np.floor(both))), -1, cn)


def copy_number_1d(x: np.ndarray, fit: Mixture, ratio: float = 0.1) -> np.ndarray:
    """round(2 x mean) of the likeliest component, or -1 when that isn't floor or ceiling of 2x or the runner-up comes near."""
    best, near = _likeliest(density_1d(x, fit.means[:, 0], fit.spreads), ratio)
    cn = np.floor(2 * fit.means[best, 0] + 0.5).astype(int)
    return np.where(near | ((cn != np.ceil(2 * x)) & (cn != np.floor(2 * x))), -1, cn)


def copy_number_by_first(xy: np.ndarray, fit: Mixture, ratio: float = 0.2) -> np.ndarray:
    best, near = _likeliest(density_2d(xy, fit.means, fit.spreads), ratio)
    return np.where(near, -1, np.floor(2 * fit.means[best, 0] + 0.5).astype(int))


def kmeans_1d(x: np.ndarray, start: list[float], rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    mean, start = np.asarray(start, float), np.asarray(start, float)
    for _ in range(rounds):
        label = np.abs(x[None] - mean[:, None]).argmin(axis=0)
        mean = np.array([(x[label == c].sum() + PSEUDO * s) / ((label == c).sum() + PSEUDO) for c, s in enumerate(start)])
    return mean, label


def greedy_clusters(points: np.ndarray, reach: float = 6.0) -> list[tuple[float, float, int]]:
    """(start, end, n) in arrival order: a point joins the nearest running mean within the L1 distance, or opens a cluster."""
    found: list[list[float]] = []
    for s, e in points:
        near = min(found, key=lambda c: abs(c[0] - s) + abs(c[1] - e), default=None)
        if near is not None and abs(near[0] - s) + abs(near[1] - e) <= reach:
            near[2] += 1
            near[0] += (s - near[0]) / near[2]
            near[1] += (e - near[1]) / near[2]
        else:
            found.append([s, e, 1])
    return [(a, b, int(n)) for a, b, n in found]
