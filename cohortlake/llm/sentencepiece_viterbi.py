"""SentencePiece encoding and decoding by batched Viterbi (operator 9).

A text is normalised as the model's own encoder does it for this model (a space
before the text, spaces written as U+2581) and cut before each run of U+2581, which
no piece crosses. Distinct words of one length advance together: all substrings'
hashes are probed in the sorted piece keys at once, and at each end position a
vectorised maximum over the piece lengths stores scores and backpointers. Characters
that no piece covers become byte pieces.

The result is the segmentation of the greatest total piece score; of equal totals
the one whose last piece is longest, at each position. (A model trained as BPE
merges pairs instead when its own library encodes; its piece scores serve as the
scores here. A plain dynamic program over strings is the test's reference.)

Defined results: a null or empty text has no ids and decodes to the empty text;
every input row gives one row; an empty table gives no rows; columns besides
``doc_id`` and ``text`` are ignored. The symbol U+2581 itself in a text reads as a
space, as in the library; so texts are compared after that replacement.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._text import mix, pieces

SPACE = "▁"
#: Bytes of words and ids that a worker remembers (estimated), the longest word worth remembering, and cells of one Viterbi block.
CACHE_BYTES, REMEMBERED, CELLS = 192 << 20, 200, 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Viterbi:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        #: Pieces that can be chosen, by id.
        self.text = {i: model.id_to_piece(i) for i in ids}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(model.get_piece_size()) if model.is_byte(i)}
        self.of_byte = {i: b for b, i in self.bytes.items()}
        if any(SPACE in p.lstrip(SPACE) for p in self.text.values()):
            raise ValueError("a piece has a space after other characters; words can't be cut there")
        self.longest = max(map(len, self.text.values()))
        keys, scores = np.zeros(len(ids), np.uint64), np.array([model.get_score(i) for i in ids])
        for k in {len(p) for p in self.text.values()}:
            at = [j for j, i in enumerate(ids) if len(self.text[i]) == k]
            keys[at] = self._hash(self._codes([self.text[ids[j]] for j in at], k), k)[:, 0]
        order = np.argsort(keys)
        self.keys, self.ids, self.scores = keys[order], np.array(ids)[order], scores[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        #: Whether any key starts with these 20 bits: most substrings are no pieces and need no search.
        self.first_bits = np.zeros(1 << 20, bool)
        self.first_bits[self.keys >> np.uint64(44)] = True
        #: What an uncovered character costs: below all pieces, as in the library.
        self.unknown = scores.min() - 10.0
        self.cache: dict[str, bytes] = {}
        self.size = 0

    @staticmethod
    def _codes(words: list[str], n: int) -> np.ndarray:
        return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n)

    @staticmethod
    def _hash(codes: np.ndarray, k: int) -> np.ndarray:
        """Hashes of all substrings of k characters, by where they start."""
        m = codes.shape[1] - k + 1
        out = np.full((len(codes), m), k, np.uint64)
        for i in range(k):
            out = (out + codes[:, i : i + m] + np.uint64(1)) * _P
            out ^= out >> np.uint64(29)
        return mix(out)

    def _starting(self, codes: np.ndarray, top: int) -> np.ndarray:
        """Piece (its index, or -1) that starts at s and has k characters, as [k, word, s]."""
        w, n = codes.shape
        piece = np.full((top + 1, w, n), -1, np.int32)
        for k in range(1, min(top, n) + 1):
            h = self._hash(codes, k)
            row, start = np.nonzero(self.first_bits[h >> np.uint64(44)])
            h = h[row, start]
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            piece[k, row, start] = np.where(self.keys[at] == h, at, -1)
        return piece

    def _same_length(self, words: list[str], n: int) -> list[bytes]:
        """The words advance together, in blocks of ends, so that memory doesn't grow with a word's length but for its backpointers."""
        codes = self._codes(words, n)
        w, top = len(words), min(n, self.longest)
        best = np.zeros((n + 1, w))
        back, chosen = np.zeros((n + 1, w), np.int32), np.zeros((n + 1, w), np.int32)
        block = max(top, CELLS // (w * top))
        for lo in range(0, n, block):
            hi, base = min(n, lo + block), max(0, lo - top + 1)
            piece = self._starting(codes[:, base:hi], top)
            for end in range(lo + 1, hi + 1):
                ks = np.arange(min(end, top), 0, -1)
                found = piece[ks, :, end - ks - base]
                score = np.where(found >= 0, self.scores[found], -np.inf)
                score[-1] = np.where(found[-1] >= 0, score[-1], self.unknown)
                score += best[end - ks]
                k = score.argmax(axis=0)[None]
                best[end], back[end], chosen[end] = np.take_along_axis(score, k, 0)[0], ks[k[0]], np.take_along_axis(found, k, 0)[0]
        out = []
        for j in range(w):
            ids, end = [], n
            while end:
                p = int(chosen[end, j])
                if p >= 0:
                    ids.append(int(self.ids[p]))
                else:
                    ids += [self.bytes[b] for b in reversed(words[j][end - 1].encode("utf-8", "surrogatepass"))]
                end -= int(back[end, j])
            out.append(np.array(ids[::-1], "<u4").tobytes())
        return out

    def learn(self, words: set[str]) -> None:
        """Put the ids of these words in the cache."""
        by_length: dict[int, list[str]] = {}
        for word in words:
            by_length.setdefault(len(word), []).append(word)
        for n, group in by_length.items():
            step = max(1, CELLS // (n * min(n, self.longest)))
            for i in range(0, len(group), step):
                part = group[i : i + step]
                self.cache.update(zip(part, self._same_length(part, n), strict=True))

    @staticmethod
    def words(text: str) -> list[str]:
        """The normalised text, cut before each run of spaces."""
        if not text:
            return []
        if SPACE in text:
            text = text.replace(SPACE, " ")
        parts = text.split(" ")
        if "  " not in text and parts[0]:
            return [SPACE + part for part in parts]
        out, run = [], SPACE
        last = len(parts) - 1
        for i, part in enumerate(parts):
            if part or i == last:
                out.append(run + part)
                run = SPACE
            else:
                run += SPACE
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.words(t) for t in texts]
        if self.size > CACHE_BYTES:
            self.cache.clear()
            self.size = 0
        new = {w for w in set().union(*cut) if w not in self.cache}
        self.learn(new)
        get = self.cache.__getitem__
        out = [np.frombuffer(b"".join(map(get, words)), "<u4") for words in cut]
        for word in new:
            if len(word) > REMEMBERED:
                self.cache.pop(word)
            else:
                self.size += 200 + 4 * len(word) + len(self.cache[word])
        return out

    def decode(self, ids: list[int]) -> str:
        """Pieces put together; runs of byte pieces as UTF-8; without the space before the text."""
        out, raw = [], bytearray()
        if self.of_byte.keys().isdisjoint(ids):
            get = self.text.get
            out, ids = [get(i, "") for i in ids], ()
        for i in ids:
            if i in self.of_byte:
                raw.append(self.of_byte[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.text.get(i, ""))
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


_models: dict[str, Viterbi] = {}


def _model(path: str) -> Viterbi:
    if path not in _models:
        _models[path] = Viterbi(path)
    return _models[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids: the piece ids of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in pieces(batches, 2 << 20):
            ids = [x.view("<i4") for x in model.encode(batch.column(1).fill_null("").to_pylist())]
            yield pa.record_batch({"doc_id": batch.column(0), "ids": pa.array(ids, pa.list_(pa.int32()))})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text: what the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            yield pa.record_batch({"doc_id": batch.column(0), "text": pa.array([model.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32, decoded_sha256, exact: encoded, and decoded again in the same pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in pieces(batches, 2 << 20):
            texts = batch.column(1).fill_null("").to_pylist()
            ids = model.encode(texts)
            back = [model.decode(x.tolist()) for x in ids]
            yield pa.record_batch(
                {
                    "doc_id": batch.column(0),
                    "n_ids": pa.array([len(x) for x in ids], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                    "decoded_sha256": pa.array([hashlib.sha256(b.encode()).hexdigest() for b in back]),
                    "exact": pa.array([b == t.replace(SPACE, " ") for b, t in zip(back, texts, strict=True)]),
                }
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_ids long, ids_crc32 long, decoded_sha256 string, exact boolean")


def query(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path())
