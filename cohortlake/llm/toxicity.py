"""Toxicity by maximum-scoring segments (operator 5).

Fit: over a bounded sample of labelled documents, chosen by the hash of ``doc_id``
(``MAX_LABELLED`` rows at most; all of them below that) and written once, the distinct
contexts of each word (the word before, the word, the word after) are counted by label. Copies
of a document count as one document, for a word's occurrences too; a word whose toxic
occurrences bring few new contexts belongs to such a group. Each word gets its log-odds in
toxic against clean text with an informative Dirichlet prior (the pooled rate, ``PRIOR``
contexts strong) and a z-score. A word's score is its log-odds where they are significant,
in either direction: clearly toxic words score above zero, clearly clean ones below (down to
``CLEANEST``, so that one of them doesn't cut a passage in two). Words of which the sample can't tell score
``DRIFT``, slightly below zero, so a clean text drifts down.

Score: a linear scan (Ruzzo and Tompa) finds all maximal-scoring segments of a
text's word scores. Chance segments follow an extreme-value law: the best of a text of
n words stays below s with probability exp(-K n exp(-lambda s)). Lambda and K are
fitted by maximum likelihood to the best segments of the labelled clean documents
(those without any are known to lie below the least toxic word's score); with too few of them,
lambda solves E[exp(lambda s)] = 1 over clean words. A segment of score S then has the
value lambda S - ln(K n); those of ``SIGNIFICANT`` or more are passages. A document's
evidence is the least joint probability of its best r passages (the sum statistic of
Karlin and Altschul), as -ln p, whatever its size; a logistic curve over the logarithm of
1 plus the evidence, fitted on the same labelled rows in bins, turns it into a probability.

The model is a table of words that are seen in ``MIN_CONTEXTS`` contexts of the bounded
sample at least and whose log-odds are significant, so its size is bounded too and it is
broadcast. Scores come from the text alone. Labels of held-out rows are never read.

Defined results: null and empty texts have no evidence and get the curve's value
there; every input row gives one row; without usable labels all scores are 0; an
empty table gives no rows; columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import stored
from ._text import ALNUM, hashes, mix, pieces, release, text_words

MAX_LABELLED = 20_000
#: Weight of the prior in contexts; least (binomial) z-score, either way, and contexts of a word whose log-odds count; score of other words; least score of a clean word; least extreme-value score of a passage.
PRIOR, MIN_Z, MIN_CONTEXTS, DRIFT, CLEANEST, SIGNIFICANT = 1000.0, 4.0, 5, -0.05, -1.0, 2.0
#: Least log-odds of a toxic word, and least share of new contexts among its toxic occurrences, against that of all words.
MIN_ODDS, MIN_FRESH = 1.0, 0.5
THRESHOLD = 0.3
#: Values of lambda to choose from, and the least clean documents with a segment for the fit.
RATES, LEAST_SEGMENTS = np.geomspace(0.05, 5.0, 93), 30
#: Bins of log(1 + evidence) for the fit of the curve; the last one is open.
_BINS, _STEP = 64, 0.125
#: Bytes of text that are worked on at once.
SLICE = 1 << 20


@dataclass
class Model:
    words: np.ndarray  # sorted hashes of words with significant log-odds
    scores: np.ndarray  # their scores; all others have DRIFT
    rate: float = 1.0  # lambda
    log_k: float = -2.0  # ln K
    intercept: float = -20.0
    slope: float = 0.0


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, starts, ends, first = text_words(batch, ALNUM)
    return hashes(data, starts, ends, 5), first


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, start, end) of a list of numbers, in linear time.

    Only positive scores can start a segment; the totals before and after each are
    read from a running sum, so the loop visits positive scores alone.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    out: list[list[float]] = []  # left total, right total, start, end, last earlier segment with a smaller left total
    for i in np.flatnonzero(scores > 0).tolist():
        left, right, start = total[i], total[i + 1], i
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][0] >= left:
                j = out[j][4]
            if j < 0 or out[j][1] >= right:
                out.append([left, right, start, i + 1, j])
                break
            left, start = out[j][0], out[j][2]
            del out[j:]
    return [(right - left, int(a), int(b)) for left, right, a, b, _ in out]


def word_scores(words: np.ndarray, model: Model) -> np.ndarray:
    if not len(model.words) or not len(words):
        return np.full(len(words), DRIFT)
    at = np.minimum(np.searchsorted(model.words, words), len(model.words) - 1)
    return np.where(model.words[at] == words, model.scores[at], DRIFT)


def best_segment(words: np.ndarray, model: Model) -> float:
    """The score of the best segment, 0 without any toxic word."""
    return max((s for s, _, _ in segments(word_scores(words, model))), default=0.0)


def _evidence(words: np.ndarray, model: Model) -> tuple[float, list[tuple[float, int, int]]]:
    scores, passages = word_scores(words, model), []
    if (scores > 0).any():
        cut = math.log(len(words)) + model.log_k
        passages = [(v, a, b) for s, a, b in segments(scores) if (v := model.rate * s - cut) >= SIGNIFICANT]
    return joint([v for v, _, _ in passages]), passages


def _probability(evidence: np.ndarray, model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.intercept + model.slope * np.log1p(evidence), -700, 700)))


def joint(values: list[float]) -> float:
    """-ln of the least probability of r passages together: T - (r - 1) ln T + ln r! + ln (r - 1)!, with T the sum of the best r values."""
    best = total = 0.0
    for r, v in enumerate(sorted(values, reverse=True), 1):
        total += v
        best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r))
    return best


def gumbel(sums: np.ndarray, m: float, total: float, silent: float, least: float, rates: np.ndarray) -> tuple[float, float] | None:
    """lambda and ln K of greatest likelihood over ``rates``, from the best segments of clean texts.

    ``sums``: for each rate the sum of n exp(-rate S) over the m texts with a segment,
    ``total``: their sum of S, ``silent``: the words of texts whose best lies below ``least``.
    """
    if m < LEAST_SEGMENTS:
        return None
    weight = sums + silent * np.exp(-rates * least)
    likelihood = m * np.log(m / weight) + m * np.log(rates) - rates * total
    i = int(likelihood.argmax())
    return float(rates[i]), float(np.log(m / weight[i]))


def _training(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """_label, text of at most ``limit`` labelled rows that aren't held out."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    one = usable.groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("_label"))
    sample = one.orderBy(F.xxhash64("_id"), "_id").limit(limit)
    return docs.join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("_label", "text")


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per distinct (label, word, context) of a batch."""
    for batch in pieces(batches, SLICE):
        words, first = _words(batch)
        label = np.repeat(batch.column(0).to_numpy(zero_copy_only=False) > 0, np.diff(first))
        before, after = np.roll(words, 1), np.roll(words, -1)
        edge = first[:-1][np.diff(first) > 0]
        before[edge] = 0
        after[first[1:][np.diff(first) > 0] - 1] = 1
        context = mix(mix(before) + words * np.uint64(3) + mix(after ^ np.uint64(0x5555)))
        _, at, n = np.unique(context ^ label.astype(np.uint64), return_index=True, return_counts=True)
        yield pa.record_batch(
            {"_label": label[at].astype(np.int32), "_word": words[at].view(np.int64), "_context": context[at].view(np.int64), "_n": n.astype(np.int64)}
        )


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Model:
    sample = stored(_training(docs, labels, limit), "labelled")
    # exact copies count once, in contexts and in occurrences
    texts = sample.groupBy("_label", F.sha2("text", 256)).agg(F.first("text").alias("text"))
    seen = texts.select("_label", "text").mapInArrow(_contexts, "_label int, _word long, _context long, _n long").groupBy("_label", "_word", "_context").agg(F.sum("_n").alias("_n"))
    toxic = F.col("_label") == 1
    counts = seen.groupBy("_word").agg(F.count_if(~toxic).alias("n0"), F.count_if(toxic).alias("n1"), F.coalesce(F.sum(F.when(toxic, F.col("_n"))), F.lit(0)).alias("m1"))
    counts = stored(counts, "words")
    sizes = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n0", "n1", "m1")]).first()
    clean, toxic = float(sizes["n0"]), float(sizes["n1"])
    if not clean or not toxic:
        return Model(np.zeros(0, np.uint64), np.zeros(0))
    n = F.col("n0") + F.col("n1")
    prior = F.lit(PRIOR) * n / (clean + toxic)
    in0, in1 = F.col("n0") + prior, F.col("n1") + prior
    odds = F.log(in1 / (toxic + PRIOR - in1)) - F.log(in0 / (clean + PRIOR - in0))
    p = toxic / (clean + toxic)
    z = (F.col("n1") - n * p) / F.sqrt(n * p * (1 - p))
    fresh = F.col("n1") / F.col("m1") >= MIN_FRESH * toxic / float(sizes["m1"])
    up = (F.col("n1") >= MIN_CONTEXTS) & (z >= MIN_Z) & (odds >= MIN_ODDS) & fresh
    down = (F.col("n0") >= MIN_CONTEXTS) & (z <= -MIN_Z) & (odds < DRIFT)
    marked = counts.withColumn("odds", F.when(up, odds).when(down, F.greatest(odds, F.lit(CLEANEST)))).where("odds is not null")
    got = marked.toPandas()  # words of many contexts in a bounded sample
    words = got["_word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    model = Model(words[order], got["odds"].to_numpy(float)[order])
    # lambda: the clean documents' words are the null model
    share = got["n0"].to_numpy(float)[order] / clean
    lo, hi = 1e-3, 2.0
    for _ in range(60):
        mid = (lo + hi) / 2
        below = (1 - share.sum()) * math.exp(mid * DRIFT) + float(share @ np.exp(mid * model.scores)) < 1
        lo, hi = (mid, hi) if below else (lo, mid)
    model.rate = lo
    model.log_k = math.log(max(1e-5, float(share[model.scores > 0].sum())))
    model.rate, model.log_k = _extremes(sample, model) or (model.rate, model.log_k)
    return _calibrated(sample, model)


def _extremes(sample: DataFrame, model: Model) -> tuple[float, float] | None:
    """lambda and ln K from the best segment of each clean document of the sample: sums per rate, one small row per task."""
    if not (model.scores > 0).any():
        return None
    shared, least = sample.sparkSession.sparkContext.broadcast(model), float(model.scores[model.scores > 0].min())

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, (m, total, silent) = np.zeros(len(RATES)), (0, 0.0, 0)
        for batch in pieces(batches, SLICE):
            words, first = _words(batch)
            for i, y in enumerate(batch.column(0).to_pylist()):
                part = words[first[i] : first[i + 1]]
                if y > 0 or not len(part):
                    continue
                best = best_segment(part, shared.value)
                if best > 0:
                    held += len(part) * np.exp(-RATES * best)
                    m, total = m + 1, total + best
                else:
                    silent += len(part)
        yield pa.record_batch({"rate": np.arange(len(RATES)), "held": held, "m": np.full(len(RATES), m), "total": np.full(len(RATES), total), "silent": np.full(len(RATES), silent)})

    got = sample.mapInArrow(sums, "rate long, held double, m long, total double, silent long").groupBy("rate").agg(*[F.sum(c).alias(c) for c in ("held", "m", "total", "silent")])
    got = got.orderBy("rate").toPandas()
    if not len(got):
        return None
    return gumbel(got.held.to_numpy(float), float(got.m[0]), float(got.total[0]), float(got.silent[0]), least, RATES)


def _calibrated(sample: DataFrame, model: Model) -> Model:
    """The logistic curve of the label over the evidence, from counts per bin."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, _BINS), np.int64)
        for batch in pieces(batches, SLICE):
            words, first = _words(batch)
            for i, y in enumerate(batch.column(0).to_pylist()):
                x, _ = _evidence(words[first[i] : first[i + 1]], shared.value)
                n[int(y > 0), min(_BINS - 1, int(math.log1p(x) / _STEP))] += 1
        yield pa.record_batch({"bin": np.arange(_BINS), "n0": n[0], "n1": n[1]})

    got = sample.mapInArrow(bins, "bin long, n0 long, n1 long").groupBy("bin").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).orderBy("bin").toPandas()
    model.intercept, model.slope = logistic(got.bin.to_numpy() * _STEP, got.n0.to_numpy(float), got.n1.to_numpy(float))
    return model


def logistic(x: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> tuple[float, float]:
    """Intercept and slope (0 at least) of the share of n1 over x."""
    w = np.array([math.log((n1.sum() + 1) / (n0.sum() + 1)), 0.0])
    for _ in range(50):  # Newton's method, slightly regularised
        p = 1 / (1 + np.exp(-np.clip(w[0] + w[1] * x, -30, 30)))
        n = n0 + n1
        grad = np.array([(n1 - n * p).sum(), ((n1 - n * p) * x).sum()]) - 0.1 * w
        v = n * p * (1 - p)
        hess = np.array([[v.sum(), (v * x).sum()], [(v * x).sum(), (v * x * x).sum()]]) + 0.1 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), max(0.0, float(w[1]))


def score(docs: DataFrame, model: Model, with_passages: bool = False) -> DataFrame:
    """doc_id, score (and passages: extreme-value score, first word, word after the last)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    extra = ", passages array<struct<value:double,start:int,end:int>>" if with_passages else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in pieces(batches, SLICE):
            words, first = _words(batch)
            found = [_evidence(words[a:b], model) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            out = {"doc_id": batch.column(0), "score": _probability(np.array([f[0] for f in found]), model)}
            if with_passages:
                out["passages"] = pa.array(
                    [[{"value": v, "start": a, "end": b} for v, a, b in f[1]] for f in found],
                    pa.list_(pa.struct([("value", pa.float64()), ("start", pa.int32()), ("end", pa.int32())])),
                )
            yield pa.record_batch(out)
        release()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double{extra}")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with all columns, without the documents that score ``threshold`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in pieces(batches, SLICE):
            words, first = _words(batch)
            x = np.array([_evidence(words[a:b], model)[0] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)])
            yield batch.filter(pa.array(_probability(x, model) < threshold))
        release()

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model, with_passages=True)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )
