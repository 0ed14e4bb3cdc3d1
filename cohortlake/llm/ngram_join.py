"""N-gram Jaccard join by adaptive multi-match prefixes (operator 3).

A document's set is its distinct k-word shingles, as 64-bit hashes. Sets are put in
one global order, rare shingles first. If two sets reach the similarity, they share
at least l of the first |x| - t + l shingles, for any l, where t is the least overlap
that x can have with a partner. Each document picks its own l: from the exact number
of documents that hold each shingle of its prefix it estimates the postings read and
the candidates left for l = 1, 2, 4, 8 and takes the cheapest; a longer prefix needs
correspondingly more shared shingles before a pair is verified. No l above t is taken:
a pair may have just t shingles in common.

Order: by the count of a shingle's slot in a table of counters over all documents, then
by hash. The table has 2^22 slots, and more with the size of the input up to 2^26; that
bounds what is broadcast (a byte a slot). Tasks' counters are added up in steps of 64.
Any order gives the same result; a good one only saves candidates.

A set is named by a 64-bit hash. Where two different sets share it (a second hash tells), all but
one of them get new names; with n sets, about n^2 / 2^65 pairs do, so these names fit in memory.

Before a candidate's sets are read, its parity sketches are compared: ``BITS`` bits, each the
parity of the shingles that hash to it. They differ in at most as many bits as the sets
in shingles, so no true pair is lost, and pairs of a large group that are merely related
go in the join itself.

Result: the class (component) of each document and not the pairs, so that large
groups cost no square of their size. Equal sets are one node. Rounds of pivots come
first: each shingle draws two of its nodes anew, and every node of another component
meets them, so that a large group of near copies grows together in a few rounds of
linear cost. Then, exactly, all candidate pairs that still lie in different components
are verified, with levels chosen for what is left. Pairs inside a component can't change
the result. Whole sets are compared; they are written once, for the documents that share
a prefix shingle at all.

Defined results: null and empty texts, and texts without words, have the empty set
and link with nothing; with fewer words than k the whole sequence is one shingle;
every input row gives one row, and rows that share a ``doc_id`` are classed by their
texts; a null ``doc_id`` is no id: it gets a null component and links nothing; an empty
table gives no rows; columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._graph import components
from ._store import shuffles_freed, stored, stored_by, unused
from ._text import NONSPACE, grams, hashes, mix, pieces, release, text_words

SLOT_BITS, MOST_SLOT_BITS, RANGE = 22, 26, 1 << 16
#: Tasks' counters that are added up at once.
AT_ONCE = 64
LEVELS = (1, 2, 4, 8)
#: What a candidate costs against reading one posting, for choosing l: little, as sketches are compared where postings meet.
VERIFY = 0.25
BITS = 512
SKETCH = tuple(f"s{i}" for i in range(BITS // 64))
#: Rounds of pivots at most; they end sooner when a round joins less than this part of the nodes still apart.
PIVOT_ROUNDS, LEAST_JOINED = 8, 0.2
#: A slot is hot when it holds this many times the mean, this many at least, and so many at any rate.
HOT, LEAST_HOT, MOST_COLD, SALTS = 16, 1_000, 1_000_000, 256
#: Bytes of text that are made shingles at once.
SLICE = 1 << 20


def shingle_sets(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingles."""
    data, starts, ends, first = text_words(batch, NONSPACE)
    words = hashes(data, starts, ends, 3)
    g, at = grams(words, first, k)
    cut = np.searchsorted(at, first)
    out = []
    for i in range(len(first) - 1):
        if first[i + 1] - first[i] >= k:
            s = g[cut[i] : cut[i + 1]]
            s.sort()
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif first[i + 1] > first[i]:
            h = np.full(1, 17, np.uint64)
            for j in range(first[i], first[i + 1]):
                h = mix(h + words[j : j + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(s: np.ndarray, bits: int = 64) -> int:
    """A hash of a whole set, which names its node."""
    return int((np.bitwise_xor.reduce(mix(s)) ^ np.add.reduce(s * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)) >> (64 - bits) if len(s) else 0


def other_of(s: np.ndarray) -> int:
    """Another, independent hash of it."""
    return int(np.bitwise_xor.reduce(mix(s ^ np.uint64(0xABCD))).view(np.int64)) if len(s) else 0


def name_of(s: np.ndarray, names: dict[int, dict[int, int]], bits: int = 64) -> int:
    """The node of a set, by its new name where it has one."""
    node = node_of(s, bits)
    return names[node].get(other_of(s), node) if node in names else node


def parity(s: np.ndarray) -> np.ndarray:
    """64-bit words: for each of ``BITS`` slots, whether an odd number of the set's items falls into it."""
    odd = np.bincount((s & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def least_overlaps(n: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Least overlap of a set of n with any partner, and with one that is no smaller."""
    return -(-num * n // den), -(-2 * num * n // (num + den))


def _survey(batches: Iterator[pa.RecordBatch], k: int, slot_bits: int, bits: int) -> Iterator[pa.RecordBatch]:
    """A row per document (node and other: hashes of its set), and this task's counts of shingles per slot, in ranges."""
    slots, task = np.zeros(1 << slot_bits, np.uint32), TaskContext.get().partitionId()
    none = lambda n, t: pa.nulls(n, t)
    for batch in pieces(batches, SLICE):
        sets = shingle_sets(batch, k)
        n = np.array([len(s) for s in sets], np.int64)
        sketches = np.stack([parity(s) for s in sets])
        if n.sum():
            slots += np.bincount((np.concatenate(sets) >> np.uint64(64 - slot_bits)).astype(np.int64), minlength=len(slots)).astype(np.uint32)
        yield pa.record_batch(
            {
                "doc_id": batch.column(0),
                "n": pa.array(n),
                "node": pa.array(np.array([node_of(s, bits) for s in sets], np.int64)),
                "other": pa.array(np.array([other_of(s) for s in sets], np.int64)),
                **{c: pa.array(np.ascontiguousarray(sketches[:, i])) for i, c in enumerate(SKETCH)},
                "range": none(len(n), pa.int32()),
                "task": none(len(n), pa.int32()),
                "counts": none(len(n), pa.binary()),
            }
        )
    parts = slots.reshape(-1, min(RANGE, len(slots)))
    used = np.flatnonzero(parts.any(axis=1))
    for i in used:  # one at a time, so that no copy of all counters is held
        yield pa.record_batch(
            {
                "doc_id": none(1, pa.int64()),
                "n": none(1, pa.int64()),
                "node": none(1, pa.int64()),
                "other": none(1, pa.int64()),
                **{c: none(1, pa.int64()) for c in SKETCH},
                "range": pa.array([i], pa.int32()),
                "task": pa.array([task], pa.int32()),
                "counts": pa.array([zlib.compress(parts[i].tobytes(), 1)], pa.binary()),
            }
        )
    del slots, parts
    release()


def _summed(table: pa.Table) -> pa.Table:
    total = 0
    for blob in table.column("counts"):
        total = total + np.frombuffer(zlib.decompress(blob.as_py()), np.uint32).astype(np.int64)
    total = np.minimum(total, (1 << 32) - 1).astype(np.uint32)
    return pa.table({"range": table.column("range")[:1], "part": table.column("part")[:1], "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def _slot_bits(docs: DataFrame) -> int:
    """One slot for 256 bytes of input, as far as Spark knows their number, within bounds."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(MOST_SLOT_BITS, max(SLOT_BITS, (size >> 8).bit_length())) if size < 1 << 60 else SLOT_BITS


def _quarters(counts: np.ndarray | float) -> np.ndarray:
    """log2 in quarters."""
    return np.round(4 * np.log2(1 + np.asarray(counts, float))).astype(np.uint8)


def _slot_table(survey: DataFrame, slot_bits: int) -> tuple[np.ndarray, int]:
    """log2 (in quarters) of each slot's count, and from where on a slot is hot. Counts of ``AT_ONCE`` tasks at most meet in one group, step by step."""
    parts = survey.where("counts is not null").select("range", F.col("task").alias("part"), "counts")
    last = parts.agg(F.max("part")).first()[0]
    while last is not None:
        parts = parts.withColumn("part", F.floor(F.col("part") / AT_ONCE).cast("int")).groupBy("range", "part").applyInArrow(_summed, "range int, part int, counts binary")
        last //= AT_ONCE
        if not last:
            break
    out = np.zeros(1 << slot_bits, np.uint8)
    size, whole = min(RANGE, len(out)), 0
    for r in parts.toLocalIterator():  # a table of bounded size
        counts = np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
        out[r["range"] * size : (r["range"] + 1) * size] = _quarters(counts)
        whole += int(counts.sum(dtype=np.uint64))
    return out, int(_quarters(min(MOST_COLD, max(LEAST_HOT, HOT * whole / len(out)))))


def _prefixes(batches: Iterator[pa.RecordBatch], shared, names: dict, k: int, num: int, den: int, slot_bits: int, bits: int) -> Iterator[pa.RecordBatch]:
    """node, n, shingle, at: the longest prefix of each set, by the count of slots; shingles of hot slots are marked."""
    (slots, limit), done = shared.value, set()
    for batch in pieces(batches, SLICE):
        rows: list[tuple[np.ndarray, ...]] = []
        for s in shingle_sets(batch, k):
            if not len(s):
                continue
            node = name_of(s, names, bits)
            if node in done:  # equal sets have equal rows
                continue
            done.add(node)
            n = len(s)
            p = min(n, n - int(least_overlaps(np.array(n), num, den)[0]) + LEVELS[-1])
            # s is sorted by hash; the stable sort keeps that order among equal counts
            slot = slots[(s >> np.uint64(64 - slot_bits)).astype(np.int64)]
            order = np.argsort(slot, kind="stable")[:p]
            rows.append((np.full(p, node), np.full(p, n), s[order].view(np.int64), np.arange(1, p + 1), slot[order] >= limit))
        if rows:
            node, n, shingle, at, hot = (np.concatenate(c) for c in zip(*rows, strict=True))
            yield pa.record_batch({"node": node, "n": n.astype(np.int32), "shingle": shingle, "at": at.astype(np.int32), "hot": hot})
    release()


def _sets(batches: Iterator[pa.RecordBatch], names: dict, k: int, bits: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, SLICE):
        node = batch.column(1).to_pylist()
        # rows that share a doc_id may have other texts
        at = [(i, s.view(np.int64)) for i, s in enumerate(shingle_sets(batch, k)) if name_of(s, names, bits) == node[i]]
        items = pa.array([s for _, s in at], pa.list_(pa.int64()))
        kept = batch.take(pa.array([i for i, _ in at], pa.int64()))
        yield pa.record_batch({"doc_id": kept.column(0), "node": kept.column(1), "items": items})
    release()


def _verify(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """u, v of the pairs that reach the similarity."""
    for batch in batches:
        a, b = batch.column(2), batch.column(3)
        keep = []
        for i in range(batch.num_rows):
            x, y = a[i].values.to_numpy(), b[i].values.to_numpy()
            # both are sorted as unsigned and distinct
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(den * both >= num * (len(x) + len(y) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
    release()


def _linked(pairs: DataFrame, facts: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (u, v) of nodes whose whole sets reach the similarity.

    ``sets`` are in buckets of doc_id and stay there: a pair goes to the set of u, and with it to that
    of v, so each pair moves one set, once. Joins compare nodes by an expression, as the buckets are
    of doc_id alone.
    """
    ids = lambda c: facts.select(F.col("node").alias(c), F.col("doc_id").alias(f"doc_{c}"))
    pairs = stored(pairs.join(ids("u"), "u").join(ids("v"), "v").select("u", "v", "doc_u", "doc_v"), "pairs")
    ends = F.array(*[F.struct(F.col(f"doc_{c}").alias("_id"), F.col(c).alias("_node")) for c in ("u", "v")])
    needed = pairs.select(F.explode(ends).alias("_end")).select("_end.*").distinct().hint("shuffle_hash")
    found = sets.join(needed, (F.col("doc_id") == F.col("_id")) & (F.col("node").bitwiseXOR(F.col("_node")) == 0))
    found = found.select("doc_id", "node", "items").dropDuplicates(["doc_id", "node"])

    def with_set(rows: DataFrame, c: str) -> DataFrame:
        sets = found.select(F.col("doc_id").alias("_id"), F.col("node").alias("_node"), F.col("items").alias(f"items_{c}"))
        return rows.join(sets, (F.col(f"doc_{c}") == F.col("_id")) & (F.col(c).bitwiseXOR(F.col("_node")) == 0)).drop("_id", "_node", f"doc_{c}")

    both = with_set(with_set(pairs, "u"), "v").select("u", "v", "items_u", "items_v")
    return stored(both.mapInArrow(partial(_verify, num=num, den=den), "u long, v long").distinct(), "links")


def _shared_only(rows: DataFrame) -> DataFrame:
    """node, n, prefix: each node's list of (shingle, at), of shingles that more than one node has.

    One exchange by shingle. A shingle of a hot slot may be in any number of rows; it is kept
    unseen and dealt over ``SALTS`` groups, so that what meets in a group is bounded. The
    lists make later joins by node as small as the number of nodes.
    """
    salt = F.when(F.col("hot"), 1 + F.pmod(F.xxhash64("node"), F.lit(SALTS))).otherwise(0)
    whole = Window.partitionBy("shingle", "_salt")
    seen = rows.withColumn("_salt", salt).withColumns({"_lo": F.min("node").over(whole), "_hi": F.max("node").over(whole)}).where("hot or _lo <> _hi")
    return seen.groupBy("node", "n").agg(F.collect_set(F.struct("shingle", "at")).alias("prefix"))


def _least_level(num: int, den: int, smaller: bool) -> Column:
    """The least l whose prefix has a shingle at ``at``, in a set that is the larger or the smaller of a pair."""
    n = F.col("n").cast("long")
    overlap = F.ceil(2 * n * num / (num + den)) if smaller else F.ceil(n * num / den)
    return F.greatest(F.lit(1), F.col("at") - (n - overlap)).cast("int")


def _with_level(lists: DataFrame, num: int, den: int) -> DataFrame:
    """``lists``, whose elements have ``df`` too, with l: the level whose prefix costs least by the postings of its shingles."""
    n = F.col("n").cast("long")
    beyond = n - F.ceil(n * num / den)

    def cost(level: int) -> Column:
        postings = F.aggregate("prefix", F.lit(0).cast("long"), lambda sum_, x: sum_ + F.when(x["at"] - beyond <= level, x["df"]).otherwise(F.lit(0)))
        # l is at most the least overlap, num * n / den rounded up; least() skips the nulls of the other levels
        return F.when(n * num > (level - 1) * den, F.struct((postings * (1 + VERIFY / level)).alias("cost"), F.lit(level).alias("l")))

    return lists.withColumn("l", F.least(*[cost(level) for level in LEVELS])["l"])


def _grouped(frame: DataFrame, group: DataFrame | None, name: str, to: str) -> DataFrame:
    """``frame`` with the component of node ``name`` as ``to``."""
    if group is None:
        return frame.withColumn(to, F.col(name))
    return frame.join(group.select(F.col("node").alias(name), F.col("component").alias(to)), name, "left").withColumn(to, F.coalesce(to, name))


def _joined(group: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components with these links added: each node's link to its component stands for the links before."""
    return components(links if group is None else links.unionByName(group.select(F.col("node").alias("u"), F.col("component").alias("v"))))


def _mixed(lists: DataFrame, group: DataFrame | None, level: int | None, num: int, den: int) -> DataFrame:
    """node, n, shingle, at, component, df of shingles that more than one component has; of the prefixes of one ``level``, or whole ones."""
    rows = _grouped(lists, group, "node", "component").select("node", "n", "component", F.explode("prefix").alias("p")).select("node", "n", "component", "p.*")
    rows = rows if level is None else rows.where(_least_level(num, den, False) <= level)
    both = rows.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("df")).where("lo <> hi").select("shingle", "df")
    return rows.join(both, "shingle")


def _differ(a: str, b: str) -> Column:
    return sum(F.bit_count(F.col(f"{c}{a}").bitwiseXOR(F.col(f"{c}{b}"))) for c in SKETCH)


def _may_reach(a: str, b: str, num: int, den: int) -> Column:
    """|A and B| is at most (|A| + |B| - bits that differ) / 2."""
    return _differ(a, b) * (den + num) <= (F.col(f"n{a}") + F.col(f"n{b}")) * (den - num)


def _fact(facts: DataFrame, name: str) -> DataFrame:
    return facts.select(F.col("node").alias(name), F.col("n").alias(f"n{name}"), *[F.col(c).alias(f"{c}{name}") for c in SKETCH])


def _to_pivots(rows: DataFrame, facts: DataFrame, seed: int, num: int, den: int) -> DataFrame:
    """u, v: for each node the likeliest pivot of its shingles, and one pair at most for two components.

    Each shingle has two pivots, drawn by a hash of the round, the shingle and the node, so
    that a node of a large group meets many of its members in few rounds.
    """
    rank = F.struct(F.xxhash64(F.lit(seed), "shingle", "node").alias("h"), "node", "n", "component")
    pivots = rows.groupBy("shingle").agg(F.array_distinct(F.array(F.min(rank), F.max(rank))).alias("p"))
    pivots = pivots.select("shingle", F.explode("p").alias("p")).select("shingle", F.col("p.node").alias("y"), F.col("p.n").alias("ny"), F.col("p.component").alias("cy"))
    met = rows.select("shingle", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("component").alias("cx")).join(pivots, "shingle")
    met = met.where(F.col("cx") != F.col("cy")).where(F.least("nx", "ny") * den >= F.greatest("nx", "ny") * num)
    met = met.select("x", "y", "cx", "cy").distinct().join(_fact(facts, "x"), "x").join(_fact(facts, "y"), "y").where(_may_reach("x", "y", num, den))
    best = F.min(F.struct(_differ("x", "y").alias("d"), "x", "y", "cx", "cy"))
    met = met.groupBy(F.least("cx", "cy").alias("a"), F.greatest("cx", "cy").alias("b")).agg(best.alias("best")).select("best.*")
    met = met.groupBy("x").agg(F.min(F.struct("d", "y")).alias("best")).select("x", F.col("best.y").alias("y"))
    return met.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()


def _candidates(rows: DataFrame, facts: DataFrame, num: int, den: int) -> DataFrame:
    """u, v: exactly the candidate pairs that lie in different components.

    ``rows`` are those of mixed shingles, by which each node's level is chosen. The larger
    set probes; of equal sizes the larger node. Sketches are compared where two rows meet.
    """
    lists = rows.groupBy("node", "n", "component").agg(F.collect_list(F.struct("shingle", "at", "df")).alias("prefix"))
    lists = stored(_with_level(lists, num, den).join(facts.select("node", *SKETCH), "node"), "index")
    each = lists.select("node", "n", "component", "l", *SKETCH, F.explode("prefix").alias("p")).select("node", "n", "component", "l", *SKETCH, "p.shingle", "p.at")

    def side(name: str, *more: Column) -> list[Column]:
        return [F.col("node").alias(name), F.col("n").alias(f"n{name}"), F.col("component").alias(f"c{name}"), *[F.col(c).alias(f"{c}{name}") for c in SKETCH], *more]

    probes = each.where(_least_level(num, den, False) <= F.col("l")).select(*side("x", F.col("shingle"), F.col("l")))
    index = each.select(*side("y", F.col("shingle").alias("shingle_y"), _least_level(num, den, True).alias("index"))).where(F.col("index") <= LEVELS[-1])
    sizes = ((F.col("nx") > F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") > F.col("y")))) & (F.col("ny") * den >= F.col("nx") * num)
    # all in the join itself, so that what a large group's pairs share isn't made rows first
    meet = (F.col("shingle") == F.col("shingle_y")) & (F.col("cx") != F.col("cy")) & (F.col("index") <= F.col("l")) & sizes & _may_reach("x", "y", num, den)
    pairs = probes.join(index, meet).groupBy("x", "y", "l").agg(F.count("*").alias("shared")).where("shared >= l")
    return pairs.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))


def _new_names(reps: DataFrame) -> dict[int, dict[int, int]]:
    """node to other to new node, for all but one of the different sets that share a node."""
    shared = reps.groupBy("node").agg(F.count("*").alias("_sets")).where("_sets > 1").select("node")
    found = sorted((r["node"], r["other"]) for r in reps.join(shared, "node").select("node", "other").collect())  # n^2 / 2^65 pairs of n sets
    moved = [b for a, b in zip(found, found[1:]) if a[0] == b[0]]
    for seed in range(100 if moved else 0):
        digest = lambda pair: int.from_bytes(hashlib.blake2b(repr((seed, *pair)).encode(), digest_size=8).digest(), "little", signed=True)  # noqa: B023, E731
        new = {pair: digest(pair) for pair in moved}
        table = reps.sparkSession.createDataFrame([(v,) for v in new.values()], "node long")
        if len(set(new.values())) == len(new) and not reps.join(table, "node", "left_semi").limit(1).count():
            names: dict[int, dict[int, int]] = {}
            for (node, other), v in new.items():
                names.setdefault(node, {})[other] = v
            return names
    if moved:
        raise RuntimeError("no new names were free in 100 tries")
    return {}


def _renamed(rows: DataFrame, names: dict[int, dict[int, int]]) -> DataFrame:
    if not names:
        return rows
    table = rows.sparkSession.createDataFrame([(n, o, v) for n, by in names.items() for o, v in by.items()], "node long, other long, _name long")
    return rows.join(table, ["node", "other"], "left").withColumn("node", F.coalesce("_name", "node")).drop("_name")


def _grown(docs: DataFrame, k: int, num: int, den: int, slot_bits: int | None, node_bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents with their nodes, the nodes, and the components of those that aren't their own."""
    spark = docs.sparkSession
    slot_bits = slot_bits or _slot_bits(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    survey = docs.mapInArrow(
        partial(_survey, k=k, slot_bits=slot_bits, bits=node_bits), "doc_id long, n long, node long, other long, " + ", ".join(f"{c} long" for c in SKETCH) + ", range int, task int, counts binary"
    )
    survey = stored(survey, "survey")
    each = survey.where("n is not null").select("doc_id", "n", "node", "other")
    usable = survey.where("n > 0 and doc_id is not null")
    reps = usable.groupBy("node", "other").agg(F.min("doc_id").alias("doc_id"), F.min("n").cast("int").alias("n"), *[F.min(c).alias(c) for c in SKETCH])
    reps = stored(reps, "nodes")
    names = _new_names(reps)
    reps, each = _renamed(reps, names), _renamed(each, names)
    slots = spark.sparkContext.broadcast(_slot_table(survey, slot_bits))

    shape = "node long, n int, shingle long, at int, hot boolean"
    rows = docs.where("doc_id is not null").mapInArrow(partial(_prefixes, shared=slots, names=names, k=k, num=num, den=den, slot_bits=slot_bits, bits=node_bits), shape)
    lists = stored(_shared_only(rows), "prefixes")

    facts = stored(reps.join(lists.select("node"), "node", "left_semi").select("node", "doc_id", "n", *SKETCH), "facts")
    texts = docs.join(facts.select("node", F.col("doc_id").alias("_id")).hint("shuffle_hash"), F.col("doc_id") == F.col("_id"))
    sets = stored_by(texts.select("doc_id", "node", "text").mapInArrow(partial(_sets, names=names, k=k, bits=node_bits), "doc_id long, node long, items array<long>"), "doc_id", "sets")

    # rounds of pivots, while they join a good part of what is still apart
    group = None
    for seed in range(PIVOT_ROUNDS):
        apart = stored(_mixed(lists, group, 1, num, den), "apart")
        found = _linked(_to_pivots(apart, facts, seed, num, den), facts, sets, num, den)
        group = _joined(group, found)
        if found.count() < LEAST_JOINED * apart.select("node").distinct().count():
            break

    # exactly all candidates that lie in different components still
    found = _linked(_candidates(_mixed(lists, group, None, num, den), facts, num, den), facts, sets, num, den)
    return each, reps, _joined(group, found)


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, slot_bits: int | None = None, node_bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id: documents linked when den * |A and B| >= num * |A or B|, and their classes.

    ``slot_bits``: size of the table of counts (by the input's size if not given). ``node_bits``: bits of
    the hash that names a set; fewer only make more sets need new names.
    """
    with shuffles_freed(docs.sparkSession):  # what is written on the way outlives its shuffles
        each, reps, group = _grown(docs, k, num, den, slot_bits, node_bits)

    # from nodes to documents: the class's smallest doc_id
    classes = _grouped(reps.select("node", "doc_id"), group, "node", "component")
    least = classes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = classes.select("node", "component").join(least, "component").select("node", "component_id")
    own = F.col("doc_id")
    out = each.join(named, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(own.isNotNull(), F.col("component_id"))).otherwise(own).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` without those whose class has a smaller ``doc_id``; all columns stay, and so do rows without ``doc_id``.

    Rows that share a ``doc_id`` go or stay together.
    """
    gone = unused("_gone", docs)
    others = jaccard_components(docs, k, num, den).where("component_id <> doc_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(others, F.col("doc_id") == F.col(gone), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, num=85, den=100)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))) END AS ss
  FROM w
), e AS MATERIALIZED (SELECT doc_id, len(ss) AS n, unnest(ss) AS g FROM s),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x
)
SELECT s.doc_id, CAST(len(s.ss) AS BIGINT) AS n_shingles, min(r.y) AS component_id
FROM s JOIN r ON r.x = s.doc_id GROUP BY s.doc_id, len(s.ss)
"""
