"""Filter interaction audit (operator 11): a trie of filter orders, walked depth first.

Every order in which filters can run is a path in a trie; what survives a prefix of a
path depends only on the set of its filters, so each set is one node, visited once. A
visit persists the survivors (narrow rows: part, one flag per filter, marks), counts
the actual removals on all edges that leave the node, part by part, and hands
``survivors.where(not failing)`` on to the children not visited yet. Survivors are
given back when their subtree is done, so there are never more at once than filters,
and all descend from a written table, so a lost executor costs a recomputation only.
The counts go to a table; all 120 orders are read off it, without another pass.

Copies of a text are found by two 64-bit hashes: their smallest ``doc_id`` comes from a
partial aggregate, and meets the documents in a join of written tables, which AQE splits
at a text that very many documents share. The number of parts is not bounded anywhere.

Defined results: a null text is the empty text (no words: no failure of B; no code
points: none of C); a null source is the part ''; every row of ``documents`` counts, also
rows that repeat a ``doc_id`` (they aren't copies of each other, as no id is smaller);
a row without ``doc_id`` fails no E, is nobody's original and has no label; of several
labels of a ``doc_id`` the largest counts; an empty table gives no rows; columns besides
doc_id, text and source are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import shared_folder, stored

FILTERS = ("A", "B", "C", "D", "E")
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The trie has a node for each set of filters and the report a row for each order and step.
MOST_FILTERS = 6
_COUNTS = ("n", "removed", "good_lost", "toxic_lost")


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters that look at one text: short, repetitive, shouting, with symbols."""
    text = F.coalesce(text, F.lit(""))
    bare = F.btrim(text, F.lit(SPACE))
    words = F.split(bare, r"[\x20\x09-\x0D]+")
    n = F.when(bare == "", 0).otherwise(F.size(words))
    capitals = F.char_length(text) - F.char_length(F.translate(text, UPPER, ""))
    return {
        "A": n < 200,
        "B": (n > 0) & (100 * F.size(F.array_distinct(words)) < 50 * n),
        "C": 100 * capitals.cast("long") > 2 * F.char_length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E (whether the document fails), good, toxic (whether it is labelled so): a row per document, written."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("part"), *[c.alias(k) for k, c in text_failures(F.col("text")).items()],
        F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit(11), text).alias("_h2"),
    )
    rows = stored(rows, "failures")
    copies = rows.groupBy("_h1", "_h2").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).where("_first < _last")
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("_quality"), F.max("toxic").alias("_toxic"))
    both = rows.join(stored(copies.drop("_last"), "copied_texts"), ["_h1", "_h2"], "left").join(marks, "doc_id", "left")
    is_one = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    copy = F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False))
    return stored(both.select("part", "A", "B", "C", "D", copy.alias("E"), is_one("_quality").alias("good"), is_one("_toxic").alias("toxic")), "judged")


def edges(rows: DataFrame, filters: Sequence[str]) -> DataFrame:
    """part, edge (set before * filters + filter), n, removed, good_lost, toxic_lost: actual removals on every edge of the trie that has survivors."""
    count, path, done = len(filters), f"{shared_folder(rows.sparkSession)}/edges-{uuid.uuid4().hex}", set()
    whole = (1 << count) - 1

    def visit(state: int, survivors: DataFrame) -> None:
        done.add(state)
        left = [i for i in range(count) if not state >> i & 1]
        held = survivors if len(left) == 1 else survivors.persist(StorageLevel.MEMORY_AND_DISK)
        lost = lambda i, more=F.lit(True): F.count_if(F.col(filters[i]) & more)
        out = [F.struct(F.lit(state * count + i).alias("edge"), F.count("*").alias("n"), lost(i).alias("removed"), lost(i, F.col("good")).alias("good_lost"), lost(i, F.col("toxic")).alias("toxic_lost")) for i in left]
        held.groupBy("part").agg(F.array(*out).alias("edges")).select("part", F.explode("edges").alias("e")).select("part", "e.*").write.mode("append").parquet(path)
        for i in left:
            child = state | 1 << i
            if child != whole and child not in done:
                visit(child, held.where(~F.col(filters[i])).drop(filters[i]))
        if held.is_cached:
            held.unpersist()

    visit(0, rows)
    return rows.sparkSession.read.schema("part string, edge int, n long, removed long, good_lost long, toxic_lost long").parquet(path)


def audit(rows: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """A row per part, order and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``rows`` has part, good, toxic and a flag named as each filter (true: fails). A part's
    counts are at most one small struct per edge, so they meet in one row.
    """
    count = len(filters)
    if not 1 <= count <= MOST_FILTERS:
        raise ValueError(f"from 1 to {MOST_FILTERS} filters can be audited")
    whole = (1 << count) - 1
    each = edges(rows, filters).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("edge", F.struct(*_COUNTS)))).alias("m"))
    got = lambda edge, c: F.coalesce(F.col("m")[edge][c], F.lit(0).cast("long"))
    weight = lambda s: factorial(s.bit_count()) * factorial(count - 1 - s.bit_count())
    states = [[s for s in range(whole) if not s >> i & 1] for i in range(count)]
    shapley = [sum(got(s * count + i, "removed") * weight(s) for s in states[i]) for i in range(count)]
    alone = [got((whole ^ 1 << i) * count + i, "removed") for i in range(count)]
    steps = []
    for order in permutations(range(count)):
        state = 0
        for k, i in enumerate(order):
            steps.append(("".join(filters[j] for j in order), k + 1, state * count + i, i))
            state |= 1 << i
    table = F.from_json(F.lit("[" + ",".join(f'{{"o":"{o}","k":{k},"e":{e},"f":{f}}}' for o, k, e, f in steps) + "]"), "array<struct<o:string,k:int,e:int,f:int>>")
    out = each.withColumns({"shapley": F.array(*shapley), "alone": F.array(*alone)}).select("*", F.explode(table).alias("s"))
    edge, which = F.col("s.e"), F.col("s.f")
    return out.select(
        "part", F.col("s.o").alias("filter_order"), F.col("s.k").alias("step"), (got(edge, "n") - got(edge, "removed")).alias("kept"), got(edge, "removed").alias("removed"),
        (got(which, "removed") - got(edge, "removed")).alias("redundant"), F.get("alone", which).alias("unique_fails"), got(edge, "good_lost").alias("good_lost"), got(edge, "toxic_lost").alias("toxic_lost"),
        F.get("shapley", which).alias("shapley"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return audit(judged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")))


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), m AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), v AS (
  SELECT part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
    100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false) AS e, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
  FROM t LEFT JOIN m ON t.doc_id = m.doc_id
), g AS (
  SELECT part, [a, b, c, d, e] AS fails, good, toxic, count(*) AS n FROM v GROUP BY ALL
), f AS (SELECT unnest(range(1, 6)) AS i
), o AS (
  SELECT [p.i, q.i, r.i, s.i, u.i] AS o FROM f p, f q, f r, f s, f u WHERE len(list_distinct([p.i, q.i, r.i, s.i, u.i])) = 5
), k AS (SELECT o, f.i AS step, o[f.i] AS own, o[1:f.i - 1] AS before FROM o, f
), x AS (
  SELECT part, o, step, own, n, good, toxic, fails[own] AS bad, len(list_filter(before, lambda z: fails[z])) > 0 AS gone,
    fails[own] AND len(list_filter(fails, lambda z: z)) = 1 AS lone FROM g, k
), y AS (
  SELECT part, array_to_string(list_transform(o, lambda z: substr('ABCDE', CAST(z AS BIGINT), 1)), '') AS filter_order, own, CAST(step AS INTEGER) AS step,
    CAST(coalesce(sum(n) FILTER (NOT gone AND NOT bad), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (NOT gone AND bad), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (gone AND bad), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (lone), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(n) FILTER (NOT gone AND bad AND good), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (NOT gone AND bad AND toxic), 0) AS BIGINT) AS toxic_lost
  FROM x GROUP BY part, o, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM y
"""
