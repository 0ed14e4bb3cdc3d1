"""Filter audit, quality ranking and conversation repair against brute force, and their results on odd input."""

import hashlib
import random
import zlib
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortlake.llm import conversation_repair as repair
from cohortlake.llm import filter_audit, quality_ranking

SF = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"


# --- filter audit


def fails(text):
    words = [w for w in "".join(" " if c in WHITE else c for c in text).split(" ") if w]
    return {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
        "D": any(c in "#$%&*|" for c in text),
    }


def brute_audit(docs, labels):
    first, marks = {}, {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    for i, q, t in labels:
        a = marks.setdefault(i, [0, 0])
        a[0], a[1] = max(a[0], q or 0), max(a[1], t or 0)
    rows = []
    for i, text, source in docs:
        f = fails(text or "") | {"E": i is not None and i > first[text or ""]}
        rows.append((source or "", f, *(marks.get(i, (0, 0)) if i is not None else (0, 0))))
    out, total = {}, {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for k, x in enumerate(order):
                lost, gone = [r for r in left if r[1][x]], [r for r in own if r not in left]
                gone = [r for r in own if any(r[1][y] for y in order[:k])]
                left = [r for r in left if not r[1][x]]
                out[part, "".join(order), k + 1] = [
                    len(left), len(lost), sum(r[1][x] for r in gone), sum(r[1][x] and sum(r[1].values()) == 1 for r in own), sum(r[2] == 1 for r in lost), sum(r[3] == 1 for r in lost)
                ]
                total[part, x] = total.get((part, x), 0) + len(lost)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def collected(frame):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in frame.collect()}


def test_audit_of_odd_documents(spark):
    rng = random.Random(3)
    pool = ["", None, " \n", "Short text.", "word " * 250, " ".join(f"w{i}" for i in range(220)), "ABC " * 210, "a # b", "\x0b".join(f"x{i}" for i in range(205)), "É" * 9000, "one\ttwo " * 60_000]
    docs = [(i if rng.random() > 0.1 else None, rng.choice(pool), rng.choice(["a", "b", None, ""])) for i in range(60)] + [(7, "Short text.", "a")] * 2
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 60, 2)] + [(4, 1, 1), (None, 1, 1)]
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, source string, n long, part string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert collected(filter_audit.audit(filter_audit.judged(table, marks))) == brute_audit(docs, labels)
    assert not spark.sparkContext._jsc.getPersistentRDDs()
    assert filter_audit.audit(filter_audit.judged(table.limit(0), marks.limit(0))).count() == 0


def test_audit_visits_every_set_once(spark):
    rows = spark.createDataFrame([("p", i % 2 == 0, i % 3 == 0, i % 5 == 0, i % 7 == 0, False) for i in range(400)], "part string, x boolean, y boolean, z boolean, good boolean, toxic boolean")
    got = filter_audit.edges(rows, ["x", "y", "z"]).collect()
    assert len(got) == 12 and len({r.edge for r in got}) == 12  # four sets of filters or fewer leave each filter out
    shapley = {r.filter_order[r.step - 1]: r.shapley for r in filter_audit.audit(rows, ["x", "y", "z"]).collect()}
    assert sum(shapley.values()) == 6 * sum(i % 2 == 0 or i % 3 == 0 or i % 5 == 0 for i in range(400))
    with pytest.raises(ValueError):
        filter_audit.audit(rows, list("abcdefg"))


# --- quality ranking


def test_measures_by_hand():
    texts = ["A b, b! c3\n\nc3 ##", None, "", "   ", "É"]
    got = quality_ranking.measures(pa.array(texts))
    at = dict(zip(quality_ranking.MEASURES, got[0], strict=True))
    n = len(texts[0])
    want = {
        "words": np.log1p(6), "word_length": 11 / 6, "distinct_words": 6 / 6, "distinct_pairs": 5 / 5, "commonest_word": 1 / 6, "word_twice": 0, "distinct_lines": 1, "capitals": 1 / n, "digits": 2 / n, "symbols": 2 / n,
        "exclamations": 1 / n, "marks": 1 / n, "spaces": 4 / n, "breaks": 2 / n, "words_end_in_mark": 3 / 6, "words_without_letter": 1 / 6, "capital_words": 1 / 6,
    }
    want |= {"word_length": (n - 6) / 6, "distinct_words": len(set(texts[0].split())) / 6, "commonest_word": 2 / 6, "word_twice": 1 / 6}
    for name, v in want.items():
        assert at[name] == pytest.approx(v), name
    assert not got[1:4].any() and got[4][quality_ranking.MEASURES.index("beyond_ascii")] == 1
    many = quality_ranking.measures(pa.array([*texts, "x y " * 400_000]))
    assert np.allclose(many[:5], got) and quality_ranking._kinds(np.zeros(0, np.uint8), np.zeros(1, np.int64)).shape == (0, 11)


def test_gradient_over_pairs(spark):
    rng = np.random.default_rng(1)
    a, b, d = rng.normal(size=(500, 20)), rng.normal(size=(500, 20)), 20
    model = quality_ranking.Model(np.full(d, 0.1), np.full(d, 2.0), rng.normal(size=d))
    pairs = spark.createDataFrame([(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)], "_a array<double>, _b array<double>").repartition(5)
    gradient, curvature, n = quality_ranking._summed(pairs, model)
    z = (a - b) / 2
    p = 1 / (1 + np.exp(-z @ model.weights))
    assert n == 500 and np.allclose(gradient, z.T @ (1 - p)) and np.allclose(curvature, z.T @ (z * (p * (1 - p))[:, None]))


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in quality_ranking.query(spark, sf).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    marked = [r for r in labels.collect() if got[r.doc_id].held_out]
    for q in (0, 1):
        own = [got[r.doc_id].predicted == q for r in marked if r.quality == q]
        assert len(own) > 10 and sum(own) / len(own) >= 0.97
    # what held-out rows are labelled makes no difference
    turned = labels.withColumn("quality", F.when(quality_ranking.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality_ranking.score(docs, quality_ranking.fit(docs, turned))
    assert {r.doc_id: r.score for r in again.collect()} == pytest.approx({i: r.score for i, r in got.items()}, abs=1e-9)


def test_quality_odd_input(spark):
    odd = [(1, None), (2, ""), (None, "some text"), (4, "x"), (4, "x"), (5, "w " * 50_000)]
    table = spark.createDataFrame([(*r, 0.5) for r in odd], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(2, 1), (4, None), (None, 0)], "doc_id long, quality int")
    assert quality_ranking.fit(table, labels) is None
    assert [r.score for r in quality_ranking.score(table, None).collect()] == [0.5] * 6
    model = quality_ranking.Model(np.zeros(20), np.ones(20), np.ones(20))
    assert quality_ranking.score(table, model).count() == 6 and quality_ranking.keep_good(table, model).columns == table.columns
    assert quality_ranking.score(table.limit(0), model).count() == 0 and quality_ranking.fit(table.limit(0), labels) is None


def test_quality_learns_from_all_labelled_rows(spark):
    # more labelled rows than the 20,000 that a fit once took
    n = 24_000
    texts = F.when(F.col("id") % 8 == 0, F.concat(F.lit("!! ## "), F.col("id"))).otherwise(F.concat(F.lit("Plain words here "), F.col("id"), F.lit(".")))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), texts.alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 8 == 0, 0).otherwise(1).alias("quality")).where(~quality_ranking.held_out(F.col("doc_id")))
    more = labels.unionByName(spark.range(n, 3 * n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality")))
    extra = docs.unionByName(spark.range(n, 3 * n).select(F.col("id").alias("doc_id"), F.lit("Others say a b c d.").alias("text")))
    labelled = quality_ranking._labelled(quality_ranking.measured(extra), more)
    want = {r["quality"]: r["count"] for r in more.where(~quality_ranking.held_out(F.col("doc_id"))).groupBy("quality").count().collect()}
    assert sum(want.values()) > 40_000 and labelled.count() == sum(want.values())
    # places number each label's rows from 0, and every row of both labels is in a pair
    placed = quality_ranking._placed(labelled, want)
    got = {r["_label"]: (r["n"], r["lo"], r["hi"]) for r in placed.groupBy("_label").agg(F.countDistinct("_place").alias("n"), F.min("_place").alias("lo"), F.max("_place").alias("hi")).collect()}
    assert got == {y: (k, 0, k - 1) for y, k in want.items()}
    marked = placed.withColumn("_x", F.array(F.col("_label").cast("double"), F.col("_place").cast("double")))
    pairs = quality_ranking._pairs(marked, want, 8)
    ends = pairs.agg(F.count("*").alias("n"), F.countDistinct(F.col("_a")[1]).alias("a"), F.countDistinct(F.col("_b")[1]).alias("b"), F.min(F.col("_a")[0]).alias("y"), F.max(F.col("_b")[0]).alias("z")).first()
    assert tuple(ends) == (8 * want[1], want[1], want[0], 1.0, 0.0)
    # the moments of the model are those of all rows
    rows, model = labelled.select("_label", "_x").collect(), quality_ranking.fit(extra, more)
    x, y = np.array([r["_x"] for r in rows]), np.array([r["_label"] for r in rows])
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, np.where(x.std(axis=0) > 1e-6, x.std(axis=0), model.scale), rtol=1e-6)
    # the threshold misplaces as few rows as the best quantile
    assert ((quality_ranking._ranks(x, model) >= model.threshold) == (y == 1)).all()


# --- conversation repair


def brute_turns(turns):
    """Rows after damage, by conversation."""
    out = {}
    for conv, turn, role, text in turns:
        text_of = lambda v: " " if v is None else str(v)
        way = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        rows = out.setdefault(conv, [])
        t = "" if way == 1 else "".join(c for c in text_of(text) if c not in ".!?") if way == 2 else text_of(text)
        rows += [(turn, "user" if way == 4 else text_of(role), t)] * (0 if way == 0 else 2 if way == 3 else 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest())
    return {c: sorted(rows, key=key) for c, rows in out.items()}


def brute_repair(rows):
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(WHITE)
        faults.append(2 if not bare else 3 if (role, text) in seen else 0 if bare[-1] in ".!?" else 1)
        seen.add((role, text))
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    full = {"u": "user", "a": "assistant"}

    @cache
    def best(i, q, added):
        """(cost, edits, turns) from turn i on, after ``added`` insertions in a row."""
        ways = []
        if i == len(rows) and q in ("", "a"):
            ways.append((0, "", ()))
        if added < 4:
            for x in "ua":
                if (q, x) in after and (w := best(i, after[q, x], added + 1)):
                    ways.append((3 + w[0], "I" + w[1], (f"{full[x]}:", *w[2])))
        if i < len(rows):
            _, role, text = rows[i]
            if w := best(i + 1, q, 0):
                ways.append((4 + w[0], "D" + w[1], w[2]))
            if faults[i] < 2:
                extra = 3 * faults[i]
                if (q, role[:1]) in after and (w := best(i + 1, after[q, role[:1]], 0)):
                    ways.append((extra + w[0], "K" + w[1], (f"{role}:{text}", *w[2])))
                for x in "ua":
                    if (q, x) in after and (w := best(i + 1, after[q, x], 0)):
                        ways.append((3 + extra + w[0], "R" + w[1], (f"{full[x]}:{text}", *w[2])))
        return min(ways) if ways else None

    for i in range(len(rows), 0, -50):  # keeps the recursion shallow
        for q in ("", "s", "u", "a"):
            best(i, q, 0)
    cost, edits, turns = best(0, "", 0)
    numbered = [t for t, _, _ in rows if t is not None]
    gaps = max(numbered) - min(numbered) + 1 - len(set(numbered)) if numbered else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, faults.count(2), faults.count(3), faults.count(1), illegal, cost, edits, hashlib.sha256("\n".join(turns).encode()).hexdigest()


def repaired(frame):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in repair.repair(frame).collect()}


@pytest.fixture
def uncoalesced(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_repair_of_odd_conversations(uncoalesced):
    spark, rng = uncoalesced, random.Random(7)
    roles, texts = ["user", "user", "assistant", "assistant", "system", "tool", "", None], ["Hello there.", "And now?", "no end", "", " \t", None, "Ja!", "a.\n", "É日本."]
    turns = []
    for conv in [*range(30), None]:
        for i in range(rng.choice([1, 2, 3, 5, 9, 14])):
            turns.append((conv, rng.choice([i, i, i, i + 1, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.4 else f"text {rng.random()}."))
    turns += [(77, i // 2, ("user", "assistant")[i % 2], f"t {i % 90}.") for i in range(220)]  # one conversation over most ranges
    turns += [(78, None, "user", "same.")] * 60
    table = spark.createDataFrame([(*t, "x", 1) for t in turns], "conv_id long, turn long, role string, text string, audit string, block long")
    got = repaired(repair.damaged(table))
    want = {c: brute_repair(rows) for c, rows in brute_turns(turns).items()}
    assert set(got) == set(want)
    assert {c: got[c] for c in want if got[c] != want[c]} == {}
    assert repaired(repair.damaged(table.limit(0))) == {}
    plain = sorted((t, r, x) for c, t, r, x in turns if c == 77)
    plain.sort(key=lambda r: (r[0], r[1], hashlib.md5(r[2].encode()).hexdigest()))
    assert repaired(repair.as_turns(table.where("conv_id = 77"))) == {77: brute_repair(plain)}


def test_repair_when_nothing_is_left(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    table = spark.createDataFrame([(dropped, 0, "user", "a.")], "conv_id long, turn long, role string, text string")
    assert repaired(repair.damaged(table)) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repair_matches_its_sql(spark):
    from compare import assert_same, duck

    assert_same(repair.query(spark, SF).toPandas(), duck(SF).execute(repair.SQL).df())
