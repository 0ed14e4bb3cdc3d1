"""Operators on texts against brute force, and their defined results on odd input."""

import hashlib
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.llm import license_scan, line_dedup, ngram_join, packing, sentencepiece_viterbi, toxicity

SF = "/root/testdata/sf0.001"
SHAPE = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, "   "), (4, "\n\n"), (None, "some text here"), (5, "É é ÜBER 日本 語"), (6, "x"), (6, "x"), (7, "word " * 60_000), (8, "a" * 200_000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


# --- license scan


def base_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    found = []
    for t in license_scan.PHRASES:
        p = t.text.split()
        found += [(i, t.label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), found


def test_license_base_places(spark, docs, texts):
    extra = [(10_001, "Under the MIT License! CC-BY-NC cc by nc"), (10_002, "cc by nc " * 400), (10_003, "Apache License, Version 2.0")]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, SHAPE))
    got = {r.doc_id: r for r in license_scan.scan(table).collect()}
    assert len(got) == len(texts) + 3
    for doc_id, text in (texts | dict(extra)).items():
        n, found = base_places(text)
        r = got[doc_id]
        assert (r.n_words, r.n_base) == (n, len(found)), doc_id
        assert r.base_labels == ",".join(sorted({x for _, x in found}))
        assert (r.first_word, r.last_word) == ((min(found)[0], max(found)[0]) if found else (None, None))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_notice_with_changed_words(spark):
    text = "intro This work is licenced under the GNU General Public License, version 3. outro"
    other = "a b c this work is about the general public and version three of nothing"
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame([(1, text), (2, other)], SHAPE)).collect()}
    assert got[1].labels == "gpl-3" and got[1].n_base == 0 and got[2].labels == ""


def labels_by_hand(text, k=3):
    """All labels, and the best share, of a text: hits, merged diagonals, words in order, rivals of one place."""
    words, found, best = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text)), [], 0.0
    for number, t in enumerate(license_scan.PHRASES + license_scan.NOTICES):
        p = t.text.split()
        hits = [(i, j) for i in range(len(p) - k + 1) for j in range(len(words) - k + 1) if p[i : i + k] == words[j : j + k]]
        groups = []
        for d in sorted({j - i for i, j in hits}):
            if groups and d - groups[-1][-1] <= (0 if t.phrase else license_scan.SLACK):
                groups[-1].append(d)
            else:
                groups.append([d])
        for group in groups:
            at, before, covered = -1, -k, set()
            for i, j in sorted(h for h in hits if h[1] - h[0] in group):
                if j > at and i > before:
                    covered |= set(range(i, i + k))
                    at, before = j, i
            share = sum(h[1] - h[0] in group for h in hits) / (len(p) - k + 1) if t.phrase else len(covered) / len(p)
            found.append((t.phrase, group[0], number, t.label, share))
            best = max(best, min(1.0, share))
    labels, place = {f[3] for f in found if f[0] and f[4] >= 1}, []
    for f in sorted(f for f in found if not f[0]) + [None]:
        if place and (f is None or f[1] - place[-1][1] > license_scan.SLACK):
            top = max(x[4] for x in place)
            names = {x[3] for x in place if x[4] == top}
            labels |= names if len(names) == 1 and top >= license_scan.MIN_SHARE else set()
            place = []
        place.append(f)
    return ",".join(sorted(labels)), best


def test_license_labels_against_brute_force(spark, texts):
    rng = np.random.default_rng(3)
    rows = dict(list(texts.items())[:40])
    filler = [w for t in list(texts.values())[:5] for w in (t or "").split()][:300] + ["license", "the", "gnu", "this work is"]
    for i in range(150):
        words = [str(w) for w in rng.choice(filler, rng.integers(0, 30))]
        for n in rng.integers(0, len(license_scan.NOTICES), rng.integers(1, 4)):
            notice = license_scan.NOTICES[n].text.split()
            for _ in range(rng.integers(0, 4)):
                at = rng.integers(0, len(notice))
                notice[at : at + 1] = [[], ["changed"], [notice[at], "more"], [notice[at]] * 2][rng.integers(0, 4)]
            words += [*notice, *map(str, rng.choice(filler, rng.integers(0, 6)))]
        rows[50_000 + i] = " ".join(words)
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(list(rows.items()), SHAPE)).collect()}
    seen = set()
    for doc_id, text in rows.items():
        labels, best = labels_by_hand(text)
        assert got[doc_id].labels == labels, (doc_id, text)
        assert got[doc_id].score == pytest.approx(best), doc_id
        seen |= set(labels.split(","))
    assert len(seen) > 8


def test_license_changed_words_and_rivals(spark):
    texts = [
        ("cc-by-sa", "This work is licenced under a Creative Commons attribution share-alike license"),
        ("gpl-2", "this work was licensed under the gnu general public license version 2"),
        ("", "creative commons attribution"),
        ("", "license general gnu public the under licensed is work this"),
    ]
    got = {r.doc_id: r.labels for r in license_scan.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], SHAPE)).collect()}
    assert got == {i: want for i, (want, _) in enumerate(texts)}


def test_license_odd(spark):
    got = license_scan.scan(spark.createDataFrame([(a, b, "x", 1) for a, b in ODD], SHAPE + ", label string, _row int")).collect()
    assert len(got) == len(ODD) and sum(r.doc_id == 6 for r in got) == 2
    assert license_scan.scan(spark.createDataFrame([], SHAPE)).count() == 0


# --- line dedup


def dedup(rows, least=20, most=3):
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= least:
                held[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or not (len(held[key(x)]) >= most and i != max(held[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_line_dedup(spark, texts):
    shared = "A line that several documents share\t"
    rows = [*texts.items(), *ODD, (50_001, f"{shared}\nown"), (50_002, f" {shared.upper()}"), (50_003, f"\n{shared}\n{shared}\n"), (50_003, f"\n{shared}\n{shared}\n"), (None, shared)]
    frame = spark.createDataFrame([(*r, "a", 3) for r in rows], SHAPE + ", _id string, _drops int")
    got = line_dedup.dedup_lines(frame)
    assert {"_id", "_drops"} <= set(got.columns)
    assert sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()], key=repr) == dedup(rows)
    assert line_dedup.dedup_lines(spark.createDataFrame([], SHAPE)).count() == 0


# --- n-gram join


def components(rows, k, num, den):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    least = {}
    for (doc_id, _), r in zip(rows, root, strict=True):
        least[r] = min(least.get(r, doc_id), doc_id)
    return sorted((d, len(s), least[r]) for (d, _), s, r in zip(rows, sets, root, strict=True))


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_ngram_components(spark, texts, k, num):
    rng = np.random.default_rng(k)
    base = [f"w{i}" for i in range(120)]
    group = []
    for i in range(60):  # a chain of near copies: neighbours are alike, the ends aren't
        base = base.copy()
        base[rng.integers(len(base))] = f"n{i}"
        group.append((20_000 + i, " ".join(base)))
    passage = " ".join(f"p{i}" for i in range(60))
    shared = [(30_000 + i, " ".join(f"d{i}x{j}" for j in range(rng.integers(5, 200))) + " " + passage) for i in range(40)]
    rows = [*texts.items(), *group, *shared, (40_000, None), (40_001, ""), (40_002, "one two"), (40_003, "ONE two"), (40_004, "one two")]
    got = ngram_join.jaccard_components(spark.createDataFrame([(*r, 0) for r in rows], SHAPE + ", node int"), k, num, 100)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == components(rows, k, num, 100)


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_ngram_short_near_copies(spark, k, num):
    rows = []
    for n in range(5, 13):  # a pair has fewer shingles in common than the highest level
        for i in range(12):
            words = [f"c{n}x{i}w{j}" for j in range(n)]
            rows += [(len(rows) + j, " ".join(t)) for j, t in enumerate([words, words[:-1], words[1:], [*words, "more"]])]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, SHAPE), k, num, 100)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == components(rows, k, num, 100)


def test_ngram_sets_that_share_a_hash(spark, texts):
    rows = [*list(texts.items())[:80], (40_002, "one two"), (40_004, "one two"), *[(50_000 + i, " ".join(f"a{j}" for j in range(40 + i))) for i in range(12)]]
    frame = spark.createDataFrame(rows, SHAPE).repartition(70)  # counters of more tasks than meet at once
    got = ngram_join.jaccard_components(frame, 5, 80, 100, slot_bits=12, node_bits=4)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == components(rows, 5, 80, 100)


def test_ngram_odd(spark):
    got = ngram_join.jaccard_components(spark.createDataFrame(ODD, SHAPE)).collect()
    assert len(got) == len(ODD)
    assert all((r.component_id is None) == (r.doc_id is None) for r in got)
    assert ngram_join.jaccard_components(spark.createDataFrame([], SHAPE)).count() == 0
    kept = ngram_join.keep_one(spark.createDataFrame([(1, "a b c d e f", 1), (2, "a b c d e f", 2), (None, "a b c d e f", 3), (4, None, 4)], SHAPE + ", _gone int"))
    assert sorted(r._gone for r in kept.collect()) == [1, 3, 4]


# --- packing


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    rows = [*texts.items(), *[(i and i + 90_000, t) for i, t in ODD[:-3]], *[(i + 90_000, t) for i, t in ODD[-2:]], (99_999, "a  b\n\nc \n d\te 'll <|endoftext|>")]
    got = packing.pack(spark.createDataFrame([(*r, 5) for r in rows], SHAPE + ", length int"), packing.tokenizer_path(), keep_ids=True).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        parts = sorted(by[doc_id], key=lambda r: r.piece)
        assert [x for p in parts for x in p.ids] == ids
        assert [p.start for p in parts] == np.cumsum([0, *[p.length for p in parts]])[:-1].tolist()
        assert all(p.length == 2048 for p in parts[1:])
    seq = defaultdict(list)
    for r in got:
        seq[r.sequence_id].append((r.offset, r.length))
    for s in seq.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(seq) <= np.ceil(total / 2048) * 1.03 + 2
    assert packing.pack(spark.createDataFrame([], SHAPE), packing.tokenizer_path()).count() == 0


@pytest.mark.parametrize("n", [1, 50, 5_000, 300_000])
def test_packing_plan_holds_all_pieces(n):
    rng = np.random.default_rng(n)
    lengths, counts = np.unique(np.minimum(512, 1 + rng.lognormal(4, 1.2, n).astype(int)), return_counts=True)
    plan, got = packing.plan(dict(zip(lengths.tolist(), counts.tolist(), strict=True)), 512), defaultdict(int)
    for pattern, k in plan:
        assert sum(pattern) <= 512
        for x in pattern:
            got[x] += k
    assert got == dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    assert sum(k for _, k in plan) <= 1.02 * np.ceil((lengths * counts).sum() / 512) + 2


# --- SentencePiece


def best_score(model, word):
    score = dict(zip(model.ids.tolist(), model.scores.tolist(), strict=True))
    piece = {p: score[i] for i, p in model.text.items()}
    best = [0.0] + [-np.inf] * len(word)
    for e in range(1, len(word) + 1):
        for k in range(1, min(e, model.longest) + 1):
            s = piece.get(word[e - k : e], model.unknown if k == 1 else None)
            if s is not None:
                best[e] = max(best[e], best[e - k] + s)
    return best[-1]


def test_sentencepiece_best_segmentation(texts):
    model = sentencepiece_viterbi.Viterbi(sentencepiece_viterbi.model_path())
    score = dict(zip(model.ids.tolist(), model.scores.tolist(), strict=True))
    words = sorted({w for t in list(texts.values())[:60] for w in model.words(t)})[:1500] + ["▁émoji😀", "▁", "▁▁▁x", "▁" + "ab" * 300]
    model.learn(set(words))
    for word in words:
        ids = np.frombuffer(model.cache[word], "<u4").tolist()
        assert "".join(model.text.get(i, "") for i in ids if i in model.text) == "".join(c for c in word if c in set(model.text.values()))
        if all(i in score for i in ids):
            assert sum(score[i] for i in ids) == best_score(model, word)


def test_sentencepiece_blocks_and_memory():
    model = sentencepiece_viterbi.Viterbi(sentencepiece_viterbi.model_path())
    rng = np.random.default_rng(1)
    long = "▁" + "".join(rng.choice(list("abcdeéß漢"), 3_000))
    whole = model._same_length([long], len(long))
    cells, sentencepiece_viterbi.CELLS = sentencepiece_viterbi.CELLS, 1 << 10
    try:
        assert model._same_length([long], len(long)) == whole
    finally:
        sentencepiece_viterbi.CELLS = cells
    # lines without spaces aren't remembered, and what is stays within its bound
    for i in range(20):
        lines = ["".join(rng.choice(list("漢字仮名交文"), 500)) for _ in range(50)]
        assert [model.decode(x.tolist()) for x in model.encode(lines)] == lines
    assert model.size == 0 and not model.cache
    model.encode([" ".join(str(j) for j in range(20_000))])
    most, sentencepiece_viterbi.CACHE_BYTES = sentencepiece_viterbi.CACHE_BYTES, 1000
    try:
        model.encode(["one two"])
    finally:
        sentencepiece_viterbi.CACHE_BYTES = most
    assert set(model.cache) == {"▁one", "▁two"}


def test_sentencepiece_odd(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, ids string, extra int")
    path = sentencepiece_viterbi.model_path()
    assert sentencepiece_viterbi.round_trip(empty, path).count() == 0
    assert sentencepiece_viterbi.decode(sentencepiece_viterbi.encode(empty, path), path).count() == 0
    rows = spark.createDataFrame([(1, "a b", "x", 2), (1, "a b", "y", 3), (None, None, None, None)], empty.schema)
    back = sentencepiece_viterbi.decode(sentencepiece_viterbi.encode(rows, path), path).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == [(0, ""), (1, "a b"), (1, "a b")]


def test_packing_cache():
    encoder = packing.WordEncoder(packing.tokenizer_path())
    rng = np.random.default_rng(2)
    for _ in range(10):
        lines = ["".join(rng.choice(list("漢字仮名交文ab"), 600)) + " ok." for _ in range(50)] + ["x " + "b" * 700 + "."]
        want = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in lines]
        assert encoder.encode(lines) == want
    assert encoder.size < 5_000 and all(len(w) <= packing.REMEMBERED for w in encoder.cache)


def test_sentencepiece_round_trip(spark, texts):
    rows = [*texts.items(), *ODD, (70, "  two  spaces "), (71, "tabs\tand\nlines"), (72, "😀 ▁ x")]
    got = sentencepiece_viterbi.round_trip(spark.createDataFrame(rows, SHAPE), sentencepiece_viterbi.model_path()).collect()
    assert len(got) == len(rows) and all(r.exact for r in got)
    want = {(i, hashlib.sha256((t or "").replace("▁", " ").encode()).hexdigest()) for i, t in rows}
    assert {(r.doc_id, r.decoded_sha256) for r in got} == want
    encoded = sentencepiece_viterbi.encode(spark.createDataFrame(rows, SHAPE), sentencepiece_viterbi.model_path())
    back = sentencepiece_viterbi.decode(encoded, sentencepiece_viterbi.model_path())
    assert sorted((r.doc_id or -1, r.text) for r in back.collect()) == sorted((i or -1, (t or "").replace("▁", " ")) for i, t in rows)


# --- toxicity


def test_segments_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(300):
        x = rng.choice([-2.0, -1.0, -0.5, 1.0, 1.5, 3.0], rng.integers(1, 14))
        total = np.concatenate([[0], np.cumsum(x)])
        # maximal: every proper prefix and suffix is positive, and no larger such run contains it
        runs = [(a, b) for a in range(len(x)) for b in range(a + 1, len(x) + 1) if all(total[i] > total[a] for i in range(a + 1, b + 1)) and all(total[b] > total[i] for i in range(a, b))]
        want = [(a, b) for a, b in runs if not any((c, d) != (a, b) and c <= a and b <= d for c, d in runs)]
        assert [(a, b) for _, a, b in toxicity.segments(x)] == sorted(want)


def test_extreme_value_fit():
    rng = np.random.default_rng(6)
    rate, k, least = 1.3, 0.02, 1.0
    n = rng.integers(50, 2_000, 20_000)
    # the best segment of n words stays below s with probability exp(-k n exp(-rate s)); below the least score nothing is seen
    s = np.log(k * n / -np.log(rng.random(len(n)))) / rate
    seen = s >= least
    rates = np.geomspace(0.2, 5, 200)
    sums = np.array([(n[seen] * np.exp(-r * s[seen])).sum() for r in rates])
    got = toxicity.gumbel(sums, seen.sum(), s[seen].sum(), n[~seen].sum(), least, rates)
    assert got[0] == pytest.approx(rate, rel=0.05) and got[1] == pytest.approx(np.log(k), abs=0.15)
    assert toxicity.gumbel(sums, toxicity.LEAST_SEGMENTS - 1, 1.0, 1.0, least, rates) is None


def test_joint_evidence():
    import math

    for values in ([], [3.0], [2.5, 4.0], [2.0, 2.0, 9.0, 3.0]):
        best = 0.0
        for r in range(1, len(values) + 1):
            t = sum(sorted(values)[-r:])
            best = max(best, -math.log(math.exp(-t) * t ** (r - 1) / (math.factorial(r) * math.factorial(r - 1))))
        assert toxicity.joint(values) == pytest.approx(best)


def test_toxicity_against_plain_python(spark):
    """The whole way from labelled texts to scores, with dictionaries of words in place of hashes and tables."""
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    words = {i: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) for i, t in docs.items()}
    seen = [defaultdict(lambda: defaultdict(int)) for _ in (0, 1)]
    for y, text in sorted({(label[i], docs[i]) for i in label}):
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        for i, w in enumerate(own):
            seen[y][w][own[i - 1] if i else None, own[i + 1] if i + 1 < len(own) else None] += 1
    n = [{w: len(c) for w, c in s.items()} for s in seen]
    m1 = {w: sum(c.values()) for w, c in seen[1].items()}
    clean, toxic = sum(n[0].values()), sum(n[1].values())
    score = {}
    for w in {*n[0], *n[1]}:
        a, b = n[0].get(w, 0), n[1].get(w, 0)
        prior = 1000 * (a + b) / (clean + toxic)
        odds = np.log((b + prior) / (toxic + 1000 - b - prior)) - np.log((a + prior) / (clean + 1000 - a - prior))
        p = toxic / (clean + toxic)
        z = (b - (a + b) * p) / np.sqrt((a + b) * p * (1 - p))
        if b >= 5 and z >= 4 and odds >= 1 and b / m1[w] >= 0.5 * toxic / sum(m1.values()):
            score[w] = odds
        elif a >= 5 and z <= -4 and odds < -0.05:
            score[w] = max(odds, -1.0)
    assert any(v > 0 for v in score.values())
    scored = {i: np.array([score.get(w, -0.05) for w in own]) for i, own in words.items()}
    best = {i: max((s for s, _, _ in toxicity.segments(x)), default=0.0) for i, x in scored.items()}
    least, sums, m, total, silent = min(v for v in score.values() if v > 0), np.zeros(len(toxicity.RATES)), 0, 0.0, 0
    for i in label:
        if not label[i] and words[i]:
            if best[i] > 0:
                sums, m, total = sums + len(words[i]) * np.exp(-toxicity.RATES * best[i]), m + 1, total + best[i]
            else:
                silent += len(words[i])
    found = toxicity.gumbel(sums, m, total, silent, least, toxicity.RATES)
    if not found:
        share = {w: n[0].get(w, 0) / clean for w in score}
        at = np.linspace(1e-3, 2, 400_001)
        mean = (1 - sum(share.values())) * np.exp(at * -0.05) + sum(share[w] * np.exp(at * score[w]) for w in score)
        rate = at[np.flatnonzero(mean < 1)[-1]] if (mean < 1).any() else 1e-3
        found = rate, np.log(max(1e-5, sum(share[w] for w in score if score[w] > 0)))
    rate, log_k = found

    def evidence(i):
        values = [rate * s - np.log(len(words[i])) - log_k for s, _, _ in toxicity.segments(scored[i])]
        return toxicity.joint([v for v in values if v >= 2.0])

    x = {i: np.log1p(evidence(i)) for i in docs}
    bins = [np.zeros(64), np.zeros(64)]
    for i in label:
        bins[label[i]][min(63, int(x[i] / 0.125))] += 1
    a, b = toxicity.logistic(np.arange(64) * 0.125, *bins)
    gradient = [bins[1] - (bins[0] + bins[1]) / (1 + np.exp(-a - b * np.arange(64) * 0.125))]
    assert abs(gradient[0].sum() - 0.1 * a) < 1e-6 and abs((gradient[0] * np.arange(64) * 0.125).sum() - 0.1 * b) < 1e-6
    got = {r.doc_id: r.score for r in toxicity.query(spark, sf).collect()}
    assert set(got) == set(docs)
    for i in docs:
        assert got[i] == pytest.approx(1 / (1 + np.exp(-a - b * x[i])), abs=1e-4), i


def test_toxicity_evidence_is_not_capped():
    model = toxicity.Model(np.array([7], np.uint64), np.array([3.0]), rate=1.0, log_k=-5.0, intercept=-4.0, slope=3.0)
    at = [toxicity._evidence(np.full(n, 7, np.uint64), model)[0] for n in (20, 200, 2_000, 20_000)]
    scores = toxicity._probability(np.array(at), model)
    assert at[0] > 32 and (np.diff(scores) > 0).all() and scores[-1] < 1


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.query(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    hit = ((held.toxic == 1) & (held.predicted == 1)).sum()
    assert hit / (held.toxic == 1).sum() > 0.85 and hit / (held.predicted == 1).sum() > 0.85


def test_toxicity_odd(spark):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    frame = spark.createDataFrame([(*r, 1) for r in ODD], SHAPE + ", score int")
    model = toxicity.fit(frame, empty)
    assert toxicity.score(frame, model).where("score < 0.3").count() == len(ODD)
    assert toxicity.keep_clean(frame, model).columns == frame.columns
    words = [f"plain{i}" for i in range(400)]
    rng = np.random.default_rng(1)
    rows = [(i, " ".join([*rng.choice(words, 30), *(["vile"] if i % 4 == 0 else []), *rng.choice(words, 30)])) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, SHAPE)
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model, with_passages=True).collect()}
    assert all((got[i].score >= 0.3) == (i % 4 == 0) for i in range(400))
    assert toxicity.keep_clean(docs, model).count() == 300
    assert toxicity.score(spark.createDataFrame([], SHAPE), model).count() == 0


def test_toxicity_many_copies_of_a_toxic_document(spark):
    words, rng = [f"plain{i}" for i in range(400)], np.random.default_rng(2)
    text = lambda toxic: " ".join([*rng.choice(words, 30), *(["vile"] if toxic else []), *rng.choice(words, 30)])
    rows = [(i, text(i % 4 == 0)) for i in range(400)]
    copied = text(True)
    rows += [(1_000 + i, copied) for i in range(500)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0 or i >= 1_000)) for i, _ in rows], "doc_id long, toxic int")
    # other toxic documents without the word, so that most toxic words are fresh
    more = [(2_000 + i, text(False)) for i in range(600)]
    labels = labels.unionByName(spark.createDataFrame([(i, 1) for i, _ in more], "doc_id long, toxic int"))
    model = toxicity.fit(spark.createDataFrame(rows + more, SHAPE), labels)
    assert len(model.words) == 1


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "best_fit_packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, SF)
    assert clean.columns == columns
    lines = stages["line_dedup"](spark, clean, SF)
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    assert lines.columns == columns
    assert sorted((r.doc_id, r.text) for r in lines.collect()) == sorted((r[0], r[3]) for r in dedup(rows))
    one = stages["ngram_join"](spark, lines, SF)
    rows = [(r.doc_id, r.text) for r in lines.collect()]
    assert {r.doc_id for r in one.collect()} == {d for d, _, c in components(rows, 5, 80, 100) if d == c}
    packed = stages["best_fit_packing"](spark, one, SF)
    assert packed.select("doc_id").distinct().count() == one.count()
    assert corpus_pipeline.run(spark, SF).agg(F.sum("length")).first()[0] == packed.agg(F.sum("length")).first()[0]


def test_pipeline_odd(spark, tmp_path):
    import corpus_pipeline

    def run(name, rows):
        folder = tmp_path / name
        shape = SHAPE + ", lang string, source string, n_chars long"
        spark.createDataFrame([(*r, "en", None, None) for r in rows], shape).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        return corpus_pipeline.run(spark, str(folder)).collect()

    assert run("empty", []) == []
    near = "one two three four five six seven eight nine ten eleven twelve"
    got = run("odd", [*ODD, (20, near), (21, near + " thirteen"), (22, near), (None, near)])
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.piece, r.start, r.length))
    # rows that repeat a doc_id stay together, rows without one stay, copies of a smaller doc_id go; nothing is cut but the long ones
    assert {i: len(v) for i, v in pieces.items() if len(v) > 1} == {6: 2, None: 2, 7: len(pieces[7]), 8: len(pieces[8])}
    assert set(pieces) == {1, 2, 3, 4, 5, 6, 7, 8, 20, None} and len(pieces[7]) > 20
    assert [s for _, s, _ in sorted(pieces[7])] == list(np.cumsum([0] + [n for *_, n in sorted(pieces[7])])[:-1])


def test_packing_words_with_marks():
    encoder, whole = packing.WordEncoder(packing.tokenizer_path()), []
    ids_of = encoder._ids
    encoder._ids = lambda texts: whole.extend(texts) or ids_of(texts)
    rng = np.random.default_rng(5)
    stems = ["".join(rng.choice(list("aeonrstÉßdlÀ"), 7)) for _ in range(200)]
    lines = ["x " + " ".join(s + m for s in stems) + "\n" + "\n".join(s + m for s in stems) for m in ("", ".", "***", "$$$", "'", ".'\"", "_", "…", "'s", "!?'ll", "。")]
    want = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in lines]
    assert encoder.encode(lines) == want
    # marks after words of letters are looked up by themselves: only what has other characters goes through the splitter
    assert [w for w in whole if w.endswith(("***", "$$$"))] == ["***", "$$$"]
    # the cache is emptied within a text, and what it holds is bounded
    most, packing.CACHE_BYTES = packing.CACHE_BYTES, 20_000
    try:
        small = packing.WordEncoder(packing.tokenizer_path())
        assert small.encode(lines) == want and small.size < 21_000
    finally:
        packing.CACHE_BYTES = most


def test_ngram_join_frees_its_shuffles(spark):
    def shuffles():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
        return {b for b in blocks.split() if b.startswith("shuffle_")}

    key, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", shuffles()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out, left = ngram_join.jaccard_components(docs, k=4, num=85, den=100), None
    for _ in range(50):  # files are removed in the background
        left = shuffles() - before
        if not left:
            break
        time.sleep(0.2)
    assert not left and spark.conf.get(key) == "false"
    # the result can be run twice
    assert out.count() == docs.count() and out.collect() == out.collect()
