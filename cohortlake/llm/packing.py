"""Best-fit packing of tokenized documents by length patterns (operator 8).

Token counts and checksums of the pieces are written once. All that the driver
sees is the histogram of piece lengths (at most ``max_tokens`` numbers): patterns
of two and three lengths that fill a sequence exactly are enumerated, their repeat
counts are fitted to the histogram by non-negative least squares and rounded down,
and what is left is packed by best fit, again on counts. The plan says, for the
i-th piece of a length, its sequence and place; so each piece needs only its rank
among the pieces of its length, which is counted in salted groups: a length that a
third of all pieces have never meets in one task.

Defined results: a null text is an empty document, which is the separator alone;
rows that repeat or share a ``doc_id``, or have none, are packed as documents of
their own; an empty table gives no rows; columns besides ``doc_id`` and ``text``
are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import stored
from ._text import pieces as text_slices
from ._text import release

MAX_TOKENS, SEPARATOR = 2048, 0
#: A length's pieces are ranked in so many salted groups at least, and in as many as hold so many pieces each.
SALTS, GROUP = 256, 50_000
#: Rows of the plan that are broadcast; a longer plan is joined by length.
SMALL_PLAN = 500_000
#: Bytes of words and ids that a worker remembers (estimated), and the longest word worth remembering.
CACHE_BYTES, REMEMBERED = 128 << 20, 200
#: Bytes of an entry besides its word and ids, and how many runs of marks are remembered.
ENTRY, MARKS = 200, 1_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Words(dict):
    """Ids by word; ``learn`` gives those of a word that isn't there."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, word: str) -> bytes:
        return self.learn(word)


class WordEncoder:
    """Ids as little-endian 32-bit bytes, through the ids of space-separated words.

    The byte-level splitter starts a new token at each single space or line break
    between two other characters, whatever stands around, so a text's ids are those
    of the parts that start there.
    """

    #: White space that the fast cut doesn't look at, and neighbours at which it would be wrong.
    _odd = (*"\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680", *map(chr, range(0x2000, 0x200B)), *"\u2028\u2029\u202f\u205f\u3000", "  ", " \n", "\n ", "\n\n")
    _between = re.compile(r"(?<=\S)(?=[ \n]\S)")

    _latin = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cache, self.size = Tokenizer.from_file(path), _Words(self._learn), 0
        self.model, self.marks = self.tokenizer.model, {}
        # the byte-level alphabet: printable bytes stand for themselves, others for what follows U+00FF
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        self.alphabet = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.space = self.alphabet[32]

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _parts(self, text: str) -> list[str]:
        """What starts at spaces, without the space; what starts at line breaks, with the break."""
        if text and text[0] not in " \n" and text[-1] not in " \n" and not any(c in text for c in self._odd):
            return text.replace("\n", " \n").split(" ")
        first, *rest = self._between.split(text)
        return [first, *(p[1:] if p[0] == " " else p for p in rest)]

    def _learn(self, word: str) -> bytes:
        """Words of letters, with or without marks after them, are one token each to the splitter; the rest goes through all of it."""
        stem = word.rstrip(punctuation)
        before = ""
        if word[0] == "\n":
            before, stem = "\n", stem[1:]
        plain = stem.isascii()
        if plain and stem.isalpha() or self._latin.fullmatch(stem):
            after = word[len(before) + len(stem) :]
            # a word's own ids may be known from where it stood without marks
            ids = self.cache.get(stem) if after and not before else None
            if ids is None:
                spelt = stem if before else " " + stem
                spelt = spelt.replace(" ", self.space) if plain else spelt.encode().decode("latin-1").translate(self.alphabet)
                ids = array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()
            if before:
                ids = self._marks(before) + ids
            if after:
                ids += self._marks(after)
        else:
            ids = self._ids([word if before else " " + word])[0]
        if len(word) <= REMEMBERED:
            if self.size > CACHE_BYTES:
                self.cache.clear()
                self.size = 0
            self.cache[word] = ids
            self.size += ENTRY + 2 * len(word) + len(ids)
        return ids

    def _marks(self, text: str) -> bytes:
        """Ids of a run of marks after a word, or of a line break before one: the splitter keeps them apart from it."""
        if text not in self.marks:
            if len(self.marks) > MARKS:
                self.marks.clear()
            ids = self._ids([text])[0]
            if len(text) > REMEMBERED:
                return ids
            self.marks[text] = ids
        return self.marks[text]

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [self._parts(t) for t in texts]
        heads = self._ids([p.pop(0) for p in parts])
        ids_of = self.cache.__getitem__
        return [head + b"".join(map(ids_of, part)) for head, part in zip(heads, parts, strict=True)]


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """One for each Python worker, which serves many tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def tokenized(docs: DataFrame, path: str, max_tokens: int = MAX_TOKENS, separator: int = SEPARATOR, keep_ids: bool = False) -> DataFrame:
    """A row per piece: _row, doc_id, piece, start, length, ids_crc32 (and ids, if asked for)."""
    end = np.array([separator], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in text_slices(batches, 1 << 20):
            encoded = encoder.encode(batch.column(2).fill_null("").to_pylist())
            who, number, start, length, crc, kept = [], [], [], [], [], []
            for i, ids in enumerate(encoded):
                ids += end
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    to = at + (n - at - 1) % max_tokens + 1 if not at else at + max_tokens
                    part = ids[4 * at : 4 * to]
                    who.append(i), number.append(k), start.append(at), length.append(to - at), crc.append(zlib.crc32(part))
                    if keep_ids:
                        kept.append(np.frombuffer(part, "<i4"))
                    at, k = to, k + 1
            which = pa.array(who, pa.int64())
            columns = {
                "_row": batch.column(0).take(which),
                "doc_id": batch.column(1).take(which),
                "piece": pa.array(number, pa.int32()),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
            }
            if keep_ids:
                columns["ids"] = pa.array(kept, pa.list_(pa.int32()))
            yield pa.record_batch(columns)
        release()

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = ", ids array<int>" if keep_ids else ""
    return rows.mapInArrow(cut, f"_row long, doc_id {kind}, piece int, start long, length long, ids_crc32 long{ids}")


def patterns(size: int, grid: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths a >= b >= c with a + b + c = size; c is 0 or, in threes, b or c is a multiple of size / grid."""
    step = max(1, size // grid)
    a = np.arange((size + 1) // 2, size)
    found = [np.stack([a, size - a, np.zeros_like(a)])]
    b = np.arange(step, size, step)
    x, y = (v.ravel() for v in np.meshgrid(np.arange(1, size), b))
    keep = size - x - y >= 1
    threes = np.sort(np.stack([x[keep], y[keep], size - x[keep] - y[keep]]), axis=0)[::-1]
    if threes.shape[1]:
        found.append(np.unique(threes, axis=1))
    return tuple(np.concatenate(found, axis=1))


def fit(histogram: np.ndarray, columns: tuple[np.ndarray, ...], steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|^2, by accelerated projected gradients."""
    n = len(histogram)
    real = [c > 0 for c in columns]

    def apply(x):
        return sum(np.bincount(c[r], x[r], n) for c, r in zip(columns, real, strict=True))

    def back(v):
        return sum(np.where(r, v[c], 0.0) for c, r in zip(columns, real, strict=True))

    u = np.ones(len(columns[0]))
    for _ in range(30):
        u = back(apply(u))
        u /= np.linalg.norm(u)
    rate = 0.95 / np.linalg.norm(back(apply(u)))
    x = y = np.zeros(len(columns[0]))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - rate * back(apply(y) - histogram))
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y, x = new + (before - 1) / t * (new - x), new
    return x


def plan(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths in one sequence, how many such sequences)] that hold exactly the pieces of the histogram."""
    left = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    out: list[tuple[tuple[int, ...], int]] = [((size,), int(left[size]))] if left[size] else []
    left[size] = 0
    if left.sum() > 0:
        columns = patterns(size)
        repeats = np.floor(fit(left.astype(float), columns)).astype(np.int64)
        for j in np.argsort(-repeats, kind="stable"):
            if repeats[j] <= 0:
                break
            lengths = tuple(int(c[j]) for c in columns if c[j])
            n = min(int(repeats[j]), *(int(left[v]) // lengths.count(v) for v in lengths))
            if n > 0:
                out.append((lengths, n))
                for v in lengths:
                    left[v] -= n
    # best fit, longest first, on counts: rooms[s] holds [lengths, sequences] with s tokens free
    rooms: dict[int, list[list]] = {}
    for length in range(size - 1, 0, -1):
        n = int(left[length])
        while n:
            free = min((s for s in rooms if s >= length), default=0)
            if free:
                group = rooms[free][-1]
                fits = free // length
                k = min(n // fits, group[1]) or 1
                put = min(fits, n)
                group[1] -= k
                rooms.setdefault(free - put * length, []).append([group[0] + (length,) * put, k])
                if not group[1]:
                    rooms[free].remove(group)
                    if not rooms[free]:
                        del rooms[free]
                n -= k * put
            else:
                fits = size // length
                k = n // fits or 1
                put = min(fits, n)
                rooms.setdefault(size - put * length, []).append([(length,) * put, k])
                n -= k * put
    return out + [(tuple(lengths), k) for groups in rooms.values() for lengths, k in groups]


def slots(sequences: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, sequence of the first, offset) for each place of each pattern."""
    out, used, base = [], {}, 0
    for lengths, n in sequences:
        offset = 0
        for length in lengths:
            lo = used.get(length, 0)
            out.append((length, lo, lo + n, base, offset))
            used[length] = lo + n
            offset += length
        base += n
    return out


def pack(docs: DataFrame, path: str, max_tokens: int = MAX_TOKENS, separator: int = SEPARATOR, keep_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for)."""
    spark = docs.sparkSession
    rows = stored(tokenized(docs, path, max_tokens, separator, keep_ids), "pieces")
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = slots(plan(histogram, max_tokens))
    places = spark.createDataFrame(table, "_length long, _lo long, _hi long, _base long, offset long")

    # the histogram says how many groups each length needs
    groups = F.lit([max(SALTS, -(-histogram.get(n, 0) // GROUP)) for n in range(max_tokens + 1)])
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_row", "piece"), F.get(groups, F.col("length").cast("int"))).cast("int"))
    counts = rows.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    within = Window.partitionBy("length", "_salt").orderBy("_row", "piece")
    ranked = rows.withColumn("_rank", F.row_number().over(within) - 1).join(firsts, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_first"))
    # a few places for each pattern, of which there are as many as lengths and grid steps make: their number is known here
    places = F.broadcast(places) if len(table) <= SMALL_PLAN else places
    at = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    placed = ranked.join(places, at)
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("_base") + F.col("_rank") - F.col("_lo")).alias("sequence_id"),
        "offset",
        *(["ids"] if keep_ids else []),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
