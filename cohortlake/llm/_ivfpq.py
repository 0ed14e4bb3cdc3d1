"""Inverted lists of coarse centroids with product-quantised residuals, for operators 4 and 6.

Centroids and subspace codewords are fitted by k-means on a bounded sample (chosen by
the hash of ``vec_id``); every row is then indexed. The index has a fixed size that
the list and codeword counts bound, so it is broadcast.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows that the index is fitted on, most lists, codewords per subspace.
SAMPLE, MAX_LISTS, CODES = 16_384, 1_024, 64


def matrix(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of usable vectors (finite, not zero, of one width) as doubles, and which rows they are."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    width = width or (int(Counter(lengths[lengths > 0].tolist()).most_common(1)[0][0]) if (lengths > 0).any() else 0)
    at = np.flatnonzero(lengths == width) if width else np.zeros(0, np.int64)
    values = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    x = values.reshape(-1, width) if width else np.zeros((0, 0))
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return x[good], at[good]


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        a = (x @ centers.T - 0.5 * (centers**2).sum(axis=1)).argmax(axis=1)
        n = np.bincount(a, minlength=len(centers))
        sums = np.stack([np.bincount(a, x[:, j], len(centers)) for j in range(x.shape[1])], axis=1)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    return centers


@dataclass
class Index:
    width: int
    centers: np.ndarray  # lists x width
    words: np.ndarray  # subspaces x codewords x width of a subspace
    share: float = 1.0  # of the lists, what a query must probe for the recall asked of ``fit``

    def lists(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centers.T - 0.5 * (self.centers**2).sum(axis=1)).argmax(axis=1).astype(np.int32)

    def _split(self, x: np.ndarray) -> np.ndarray:
        m, _, w = self.words.shape
        padded = np.zeros((len(x), m * w))
        padded[:, : x.shape[1]] = x
        return padded.reshape(len(x), m, w)

    def codes(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        r = self._split(x - self.centers[lists])
        return np.stack([(r[:, i] @ w.T - 0.5 * (w**2).sum(axis=1)).argmax(axis=1) for i, w in enumerate(self.words)], axis=1).astype(np.uint8)

    def decoded(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        r = np.concatenate([w[codes[:, i]] for i, w in enumerate(self.words)], axis=1)
        return self.centers[lists] + r[:, : self.width]

    def tables(self, x: np.ndarray) -> np.ndarray:
        """Inner products of each row's subvectors with all codewords: rows x subspaces x codewords."""
        return np.einsum("qmw,mcw->qmc", self._split(x), self.words)


def looked_up(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Sums of table entries by code: queries x members."""
    out = np.zeros((len(tables), len(codes)))
    for i in range(tables.shape[1]):
        out += tables[:, i][:, codes[:, i]]
    return out


def _needed_share(index: Index, x: np.ndarray, k: int, recall: float, queries: int = 512) -> float:
    """Share of the lists, nearest first, that hold ``recall`` of the k nearest (by inner product) of some rows among the others. """
    if len(x) <= k or len(index.centers) == 1:
        return 1.0
    asked = min(queries, len(x))
    product = x[:asked] @ x.T
    product[np.arange(asked), np.arange(asked)] = -np.inf
    top = np.argpartition(-product, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(x[:asked] @ index.centers.T), axis=1), axis=1)
    met = np.take_along_axis(place, index.lists(x)[top], axis=1)
    return float((np.quantile(met, recall) + 1) / len(index.centers))


def fit(vectors: DataFrame, n: int, unit: bool, subspace: int = 4, sample: int = SAMPLE, k: int = 0, recall: float = 1.0) -> Index | None:
    """An index over about n rows of (vec_id, embedding); None if no row is usable. With ``k``, its share of lists is measured on the sample."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow()
    x, _ = matrix(rows.column("embedding"))
    if not len(x):
        return None
    # equal vectors count once: a group of copies decides neither lists nor codewords
    x = np.random.default_rng(0).permutation(np.unique(x, axis=0))
    if unit:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
    lists = int(min(MAX_LISTS, max(1, n**0.5 / 2), max(1, len(x) // 16)))
    centers = kmeans(x, lists)
    index = Index(x.shape[1], centers, np.zeros((-(-x.shape[1] // subspace), 1, subspace)))
    r = index._split(x - centers[index.lists(x)])
    index.words = np.stack([_filled(kmeans(r[:, i], CODES, 8, i)) for i in range(r.shape[1])])
    if k:
        index.share = _needed_share(index, x, k, recall)
    return index


def _filled(words: np.ndarray) -> np.ndarray:
    return np.concatenate([words, np.repeat(words[:1], CODES - len(words), axis=0)]) if len(words) < CODES else words
