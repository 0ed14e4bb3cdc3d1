"""Quality classifier (operator 12): Bradley-Terry ranking of documents by pairwise preferences.

A document is a vector of measures of its text: shares of kinds of characters, of repeated
words, pairs and lines, lengths. From labelled rows, pairs of a good and a bad document
are formed, each saying that the first is preferred. The chance of that is the logistic
function of the difference of the two scores; a score is linear in the measures, so
the weights are those of a logistic regression on differences of vectors without an
intercept. They are found by Newton's method: each round adds up gradient and
curvature over the pairs in the tasks, and only these sums (as many as weights, squared)
reach the driver.

The threshold is a quantile of the labelled documents' scores: of ``QUANTILES`` of them
the one that misplaces fewest labelled documents, nearest to the share of bad ones on
ties. A score of 0.5 is that quantile. Scores are counted in ``BINS`` bins between the least and
the greatest, and a quantile is the least score of the bin it falls into.

Moments, weights and threshold come from all labelled rows that aren't held out: each row of
the larger class makes ``PARTNERS`` pairs, dealt in turn over all rows of the other class, so that
every row of both takes part. Labels of held-out rows are never read; language, source and id are
no measures. All documents are measured once, and scored.

Defined results: null and empty texts have measures of zero and get a score like any
other; every input row gives one row; a row without ``doc_id`` is not held out and has no
label; of several labels of a ``doc_id`` the largest counts; without labels of both kinds
all scores are 0.5; an empty table gives no rows; columns besides ``doc_id`` and ``text`` are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import stored
from ._text import NONSPACE, bounds, flat, hashes, mix, pieces

PARTNERS, QUANTILES, BINS = 8, 256, 1 << 14
#: A label's rows are numbered in so many groups at least, and in as many as hold so many rows each.
GROUPS, GROUP = 256, 50_000
#: Rows of the smaller class that are broadcast to those of the larger.
SMALL = 20_000
#: Weight of the penalty on the squared weights, rounds of Newton's method, bytes of text worked on at once.
PENALTY, ROUNDS, SLICE = 1.0, 12, 2 << 20
THRESHOLD = 0.5
#: Standardised measures are cut off here, so that a single odd one can't outweigh all others.
MOST = 5.0

#: Kinds of bytes: 0 inside a character, 1 beyond ASCII, 2 capital, 3 small letter, 4 digit, 5 line break, 6 other space, 7 full stop or question mark, 8 exclamation mark, 9 other mark of prose, 10 other.
_KIND = np.full(256, 10, np.uint8)
_KIND[0x80:0xC0] = 0
_KIND[0xC0:] = 1
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[10] = 2, 3, 4, 5
_KIND[[9, 11, 12, 13, 32]] = 6
_KIND[[ord("."), ord("?")]], _KIND[ord("!")], _KIND[[ord(c) for c in ",;:'\"()-"]] = 7, 8, 9
_KINDS = 11
_NOT_BREAK = np.ones(256, bool)
_NOT_BREAK[10] = False

MEASURES = (
    "words", "word_length", "distinct_words", "distinct_pairs", "commonest_word", "word_twice", "distinct_lines", "line_words", "capitals", "digits", "beyond_ascii",
    "stops", "exclamations", "marks", "symbols", "spaces", "breaks", "words_end_in_mark", "words_without_letter", "capital_words",
)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float = 0.0


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _kinds(data: np.ndarray, offsets: np.ndarray, step: int = 1 << 19) -> np.ndarray:
    """Bytes of each kind in each text, counted over slices."""
    n = len(offsets) - 1
    out = np.zeros((n, _KINDS), np.int64)
    for lo in range(0, len(data), step):
        hi = min(lo + step, len(data))
        a, b = int(np.searchsorted(offsets, lo, "right")) - 1, int(np.searchsorted(offsets, hi, "left"))
        within = np.diff(np.clip(offsets[a : b + 1], lo, hi))
        row = np.repeat(np.arange(b - a), within)
        out[a:b] += np.bincount(row * _KINDS + _KIND[data[lo:hi]], minlength=(b - a) * _KINDS).reshape(b - a, _KINDS)
    return out


def _distinct(values: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct values each text has, and how often its commonest one."""
    key = mix(values ^ mix(text.astype(np.uint64) + np.uint64(1)))
    _, at, times = np.unique(key, return_index=True, return_counts=True)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, text[at], times)
    return np.bincount(text[at], minlength=n), most


def measures(column: pa.Array) -> np.ndarray:
    """A row of ``MEASURES`` for each text of an Arrow column; all zero for a text without words."""
    data, offsets = flat(column)
    n = len(offsets) - 1
    kinds = _kinds(data, offsets)
    starts, ends, first = bounds(data, offsets, NONSPACE)
    words = np.diff(first)
    text = np.repeat(np.arange(n), words)
    value = hashes(data, starts, ends, 17)
    some = np.maximum(words, 1).astype(float)
    distinct, most = _distinct(value, text, n)
    pair = np.flatnonzero(text[1:] == text[:-1])
    pairs, _ = _distinct(mix(value[pair] * np.uint64(3)) + value[pair + 1], text[pair], n)
    twice = np.bincount(text[pair][value[pair] == value[pair + 1]], minlength=n)
    line_starts, line_ends, line_first = bounds(data, offsets, _NOT_BREAK)
    lines = np.diff(line_first)
    line_text = np.repeat(np.arange(n), lines)
    distinct_lines, _ = _distinct(hashes(data, line_starts, line_ends, 19), line_text, n)
    chars = np.maximum(kinds[:, 1:].sum(axis=1), 1).astype(float)
    letter = np.isin(_KIND, (1, 2, 3))
    per_word = lambda hit: np.bincount(text[hit], minlength=n) / some
    run = np.concatenate([[0], np.cumsum(letter[data])]) if len(data) else np.zeros(1, np.int64)
    last = _KIND[data[ends - 1]] if len(ends) else np.zeros(0, np.uint8)
    share = lambda *k: kinds[:, list(k)].sum(axis=1) / chars
    out = np.stack(
        [
            np.log1p(words), (chars - kinds[:, 5] - kinds[:, 6]) / some, distinct / some, pairs / np.maximum(words - 1, 1), most / some, twice / some, distinct_lines / np.maximum(lines, 1), np.log1p(words / np.maximum(lines, 1)),
            share(2), share(4), share(1), share(7), share(8), share(9), share(10), share(6), share(5), per_word(last >= 7), per_word(run[ends] == run[starts]),
            per_word(_KIND[data[starts]] == 2 if len(starts) else np.zeros(0, bool)),
        ],
        axis=1,
    )
    out[words == 0] = 0.0
    return out


def _matrix(column: pa.Array, d: int = len(MEASURES)) -> np.ndarray:
    """A column of lists of ``d`` numbers as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _ranks(x: np.ndarray, model: Model) -> np.ndarray:
    return np.clip((x - model.mean) / model.scale, -MOST, MOST) @ model.weights


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, _x (measures) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, SLICE):
            x = measures(batch.column(1))
            yield pa.record_batch({"doc_id": batch.column(0), "_x": pa.array(list(x), pa.list_(pa.float64()))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, _x array<double>")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """_id, _label (0 or 1), _x: all labelled rows that aren't held out, written."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    one = usable.groupBy(F.col("doc_id").alias("_id")).agg((F.max("quality").cast("int") > 0).cast("int").alias("_label"))
    return stored(rows.join(one, F.col("doc_id") == F.col("_id")).select("_id", "_label", "_x"), "labelled")


def _placed(labelled: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """_label, _place (from 0, within a label, in an order by hash), _x: numbered in groups, of which no task holds more than a few."""
    groups = F.when(F.col("_label") > 0, max(GROUPS, -(-sizes[1] // GROUP))).otherwise(max(GROUPS, -(-sizes[0] // GROUP)))
    # rows alike in id and measures are the same in any order
    rows = labelled.withColumn("_hash", F.xxhash64("_id", "_x", F.lit(5))).withColumn("_group", F.pmod("_hash", groups).cast("int"))
    earlier = Window.partitionBy("_label").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_label", "_group").agg(F.count("*").alias("_n"))
    firsts = counts.select("_label", "_group", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    within = F.row_number().over(Window.partitionBy("_label", "_group").orderBy("_hash", "_id"))
    placed = rows.withColumn("_place", within - 1).join(firsts, ["_label", "_group"])
    return stored(placed.select("_label", (F.col("_place") + F.col("_first")).alias("_place"), "_x"), "placed")


def _pairs(placed: DataFrame, sizes: dict[int, int], partners: int) -> DataFrame:
    """_a (measures of the preferred), _b (of the other): each row of the larger class with ``partners`` of the other, spread evenly over it."""
    many, few = (1, 0) if sizes[1] >= sizes[0] else (0, 1)
    step = max(1, sizes[few] // partners)
    with_key = placed.where(F.col("_label") == many).select(F.col("_x").alias("_m"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(min(partners, sizes[few]) - 1)), lambda j: (F.col("_place") + j * step) % sizes[few])).alias("_place"))
    others = placed.where(F.col("_label") == few).select("_place", F.col("_x").alias("_f"))
    both = with_key.join(F.broadcast(others) if sizes[few] <= SMALL else others, "_place")
    good, bad = ("_m", "_f") if many == 1 else ("_f", "_m")
    return stored(both.select(F.col(good).alias("_a"), F.col(bad).alias("_b")), "preferences")


def _summed(pairs: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, int]:
    """Gradient and curvature of the logistic loss over all pairs: a row of sums for each task, added up by Spark."""
    shared, d = pairs.sparkSession.sparkContext.broadcast(model), len(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total = shared.value, np.zeros(d * d + d + 1)
        for batch in batches:
            a, b = (_matrix(batch.column(i), d) for i in (0, 1))
            z = np.clip((a - model.mean) / model.scale, -MOST, MOST) - np.clip((b - model.mean) / model.scale, -MOST, MOST)
            p = 1 / (1 + np.exp(-np.clip(z @ model.weights, -500, 500)))
            total[:d] += z.T @ (1 - p)
            total[d:-1] += (z.T @ (z * (p * (1 - p))[:, None])).ravel()
            total[-1] += len(z)
        yield pa.record_batch({"k": np.arange(len(total)), "v": total})

    got = pairs.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas().sort_values("k")["v"].to_numpy(float)
    return (got[:d], got[d:-1].reshape(d, d), int(got[-1])) if len(got) else (np.zeros(d), np.zeros((d, d)), 0)


def _threshold(labelled: DataFrame, model: Model, bad_share: float) -> float:
    """The quantile of the labelled rows' scores that misplaces fewest of them."""
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"_label": batch.column(0), "_s": _ranks(_matrix(batch.column(1)), shared.value)})

    ranked = stored(labelled.select("_label", "_x").mapInArrow(run, "_label int, _s double"), "ranked")
    lo, hi = ranked.agg(F.min("_s"), F.max("_s")).first()
    place = F.least(F.floor((F.col("_s") - lo) * (BINS / max(hi - lo, 1e-9))), F.lit(BINS - 1)).cast("int")
    n, least = np.zeros((2, BINS), np.int64), np.full(BINS, np.inf)
    for r in ranked.groupBy(place.alias("bin"), "_label").agg(F.count("*").alias("n"), F.min("_s").alias("least")).collect():  # two rows a bin
        n[r["_label"], r["bin"]] = r["n"]
        least[r["bin"]] = min(least[r["bin"]], r["least"])
    whole = np.cumsum(n.sum(axis=0))
    shares = [i / QUANTILES for i in range(1, QUANTILES)]
    at = np.searchsorted(whole, [int(q * (whole[-1] - 1)) for q in shares], "right")  # the bins that hold these ranks
    below = (np.cumsum(n, axis=1) - n)[:, at]
    wrong = below[1] + n[0].sum() - below[0]
    return float(least[at[min(range(len(at)), key=lambda j: (wrong[j], abs(shares[j] - bad_share)))]])


def fit(docs: DataFrame, labels: DataFrame, partners: int = PARTNERS) -> Model | None:
    """Weights and threshold; None without labels of both kinds."""
    return fit_measured(measured(docs), labels, partners)


def fit_measured(rows: DataFrame, labels: DataFrame, partners: int = PARTNERS) -> Model | None:
    """As ``fit``, from the rows of ``measured``."""
    labelled = _labelled(rows, labels)
    d = len(MEASURES)
    moments = labelled.groupBy(F.col("_label").alias("y")).agg(
        F.count("*").alias("n"), *[f(F.get("_x", F.lit(i))).alias(f"{k}{i}") for i in range(d) for k, f in (("s", F.sum), ("q", lambda c: F.sum(c * c)))]
    )
    rows = {r["y"]: r for r in moments.collect()}  # one row for each kind of label
    if set(rows) != {0, 1}:
        return None
    sizes = {y: rows[y]["n"] for y in rows}
    total = sum(sizes.values())
    mean, square = (np.array([sum(rows[y][f"{k}{i}"] for y in rows) / total for i in range(d)]) for k in "sq")
    scale = np.sqrt(np.maximum(square - mean * mean, 0))
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(d))
    pairs = _pairs(_placed(labelled, sizes), sizes, partners)
    for _ in range(ROUNDS):
        gradient, curvature, n = _summed(pairs, model)
        # pairs repeat rows, so the penalty counts them as one sample of the size of the labelled rows
        weight = total / max(n, 1)
        step = np.linalg.solve(weight * curvature + PENALTY * np.eye(d), weight * gradient - PENALTY * model.weights)
        model = Model(model.mean, model.scale, model.weights + np.clip(step, -3, 3))
        if np.abs(step).max() < 1e-6:
            break
    model.threshold = _threshold(labelled, model, sizes[0] / total)
    return model


def _scores(x: np.ndarray, model: Model | None) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    return 1 / (1 + np.exp(-np.clip(_ranks(x, model) - model.threshold, -500, 500)))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score: from 0 to 1, 0.5 at the threshold."""
    return score_measured(measured(docs), model)


def score_measured(rows: DataFrame, model: Model | None) -> DataFrame:
    """As ``score``, from the rows of ``measured``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"doc_id": batch.column(0), "score": _scores(_matrix(batch.column(1)), shared.value)})

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "_x").mapInArrow(run, f"doc_id {kind}, score double")


def keep_good(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with all columns, without the documents that score below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, SLICE):
            yield batch.filter(pa.array(_scores(measures(batch.column(batch.schema.get_field_index("text"))), shared.value) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = stored(measured(docs), "measured")
    model = fit_measured(rows, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    scored = score_measured(rows, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
