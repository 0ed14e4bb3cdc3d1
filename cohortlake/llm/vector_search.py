"""Approximate nearest neighbours by inner product: inverted file with product-quantised residuals (operator 6).

Rows are dealt by list: short lists share a group, crowded ones are cut into parts of
bounded size. A query goes only to the groups that hold a list it probes, in blocks, so
each (group, part, block) is bounded. It probes its nearest lists: as many as held
``RECALL`` of the k nearest on the sample that the index is fitted on (few where vectors
form clusters, more than half where they form none), and more until they hold k ids. In a
group, centroid part plus table look-ups of the residual codes give approximate products
(equal vectors are one node, with its smallest ids); the best ``DEPTH``, and all whose code's
error could put them among the k best, are reranked by the exact product of the original
vectors in double precision, and the group's best k go on. The k best over all groups are the result.

Cost: the queries are a fixed share of all rows, so the products grow with their
number times the rows of the probed lists.

Defined results: vectors that are null, zero, hold null or non-finite components or
have not the usual width take no part, nor do rows without ``vec_id``; of rows that
repeat a ``vec_id`` the smallest vector counts; with fewer candidates than k all are
returned; equal scores go by smaller ``vec_id``; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _ivfpq
from ._store import stored

#: Share of the sample's nearest rows that the probed lists hold, and candidates reranked per query and group, as a multiple of k.
RECALL, DEPTH = 0.97, 6
#: Deviations of a code's error that count as usual; pairs reranked at once.
SPREAD, STEP = 2.0, 1 << 16
#: Members of a group's part, and queries of a block.
SHARD, BLOCK = 4_096, 2_048


def _groups(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group and number of parts of each list: neighbours share a group up to ``SHARD`` members."""
    group, parts, held, number = np.zeros(len(members), np.int64), np.ones(len(members), np.int64), 0, 0
    for i, n in enumerate(members.tolist()):
        if held and held + n > SHARD:
            number, held = number + 1, 0
        group[i], parts[i], held = number, max(1, -(-n // SHARD)), held + n
    return group, parts


def _allowed(near: np.ndarray, held: np.ndarray, probed: int, k: int) -> np.ndarray:
    """Queries x lists: the ``probed`` nearest lists, and more until k ids besides the query's are reached."""
    ranked = np.argsort(-near, axis=1)
    before = np.cumsum(held[ranked], axis=1) - held[ranked]
    out = np.zeros(near.shape, bool)
    np.put_along_axis(out, ranked, (np.arange(near.shape[1]) < probed) | (before <= k), axis=1)
    return out


def _reranked(approx: np.ndarray, error: np.ndarray, k: int) -> np.ndarray:
    """Queries x nodes: the DEPTH * k best by ``approx``, and those whose ``error`` reaches up to the k-th."""
    n = approx.shape[1]
    if not n:
        return np.zeros(approx.shape, bool)
    ranked = np.partition(-approx, [min(k, n) - 1, min(DEPTH * k, n) - 1], axis=1)
    kth, deep = -ranked[:, min(k, n) - 1], -ranked[:, min(DEPTH * k, n) - 1]
    return np.isfinite(approx) & ((approx >= deep[:, None]) | (approx + error >= kth[:, None]))


def search(vectors: DataFrame, is_query: Column, k: int = 20, probes: float | None = None, sample: int = _ivfpq.SAMPLE, recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row with ``is_query`` the k other rows found nearest; ``probes`` sets the share of lists itself."""
    spark = vectors.sparkSession
    rows = vectors.where("vec_id is not null and embedding is not null").groupBy(F.col("vec_id").cast("long").alias("vec_id"))
    rows = stored(rows.agg(F.min("embedding").alias("embedding"), F.max(is_query).alias("query")), "vectors")
    shape = "query_id long, vec_id long, score double"
    index = _ivfpq.fit(rows, rows.count(), unit=False, sample=sample, k=k, recall=recall)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    plain = spark.sparkContext.broadcast(index)
    probed = max(1, round((index.share if probes is None else probes) * len(index.centers)))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = plain.value
        for batch in batches:
            x, at = _ivfpq.matrix(batch.column(1), index.width)
            if len(at):
                lists = index.lists(x)
                kept = batch.take(pa.array(at))
                yield pa.record_batch(
                    {
                        "vec_id": kept.column(0),
                        "embedding": kept.column(1),
                        "query": kept.column(2),
                        "list": pa.array(lists),
                        "codes": pa.array([c.tobytes() for c in index.codes(x, lists)], pa.binary()),
                    }
                )

    kind = rows.schema["embedding"].dataType.simpleString()
    all_rows = stored(rows.mapInArrow(coded, f"vec_id long, embedding {kind}, query boolean, list int, codes binary"), "coded")
    held = np.zeros(len(index.centers), np.int64)
    for r in all_rows.groupBy("list").count().collect():  # a row for each list, of which there are MAX_LISTS at most
        held[r["list"]] = r["count"]
    group, parts = _groups(held)
    shared = spark.sparkContext.broadcast((index, held, group))
    where = spark.createDataFrame([(i, int(g), int(p)) for i, (g, p) in enumerate(zip(group, parts, strict=True))], "list int, group long, parts int")

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each group that a query must go to."""
        index, held, group = shared.value
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        for batch in batches:
            x, _ = _ivfpq.matrix(batch.column(1), index.width)
            row, to = np.nonzero(np.logical_or.reduceat(_allowed(x @ index.centers.T, held, probed, k), first, axis=1))
            kept = batch.take(pa.array(row))
            yield pa.record_batch({"vec_id": kept.column(0), "embedding": kept.column(1), "list": kept.column(2), "codes": kept.column(3), "group": pa.array(group[first][to])})

    asks = all_rows.where("query").select("vec_id", "embedding", "list", "codes")
    asks = stored(asks.mapInArrow(routed, f"vec_id long, embedding {kind}, list int, codes binary, group long"), "asked")
    blocks = asks.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(n)).cast("int")
    columns = ["group", "part", "block", "asks", "vec_id", "embedding", "list", "codes"]
    members = all_rows.join(where, "list").join(blocks, "group").withColumn("part", deal("parts", 0))
    members = members.select("*", each("blocks").alias("block"), F.lit(False).alias("asks")).select(*columns)
    asking = asks.join(where.groupBy("group").agg(F.max("parts").alias("parts")), "group").join(blocks, "group").withColumn("block", deal("blocks", 1))
    asking = asking.select("*", each("parts").alias("part"), F.lit(True).alias("asks")).select(*columns)

    def nearest(table: pa.Table) -> pa.Table:
        index, everywhere, _ = shared.value
        asks = table.column("asks").to_numpy()
        ids = table.column("vec_id").to_numpy()
        x, _ = _ivfpq.matrix(table.column("embedding"), index.width)
        order = np.lexsort((ids, asks))
        q, m = order[asks[order]], order[~asks[order]]
        # equal vectors are one node; of its ids a query can use the k + 1 smallest at most, itself among them
        _, one, node = np.unique((x[m] + 0.0).view(f"V{8 * index.width}").ravel(), return_index=True, return_inverse=True)
        by = np.argsort(node, kind="stable")
        place = np.arange(len(m)) - np.searchsorted(node[by], node[by])
        copies = np.full((len(one), min(k, place.max(initial=0)) + 1), -1)
        use = place < copies.shape[1]
        copies[node[by][use], place[use]] = by[use]
        # nodes by list, then by smallest id
        lists = table.column("list").to_numpy()[m[one]]
        order = np.lexsort((one, lists))
        one, lists, copies = one[order], lists[order], copies[order]
        owned = np.where(copies >= 0, ids[m[copies]], 0) if len(m) else copies
        codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)[m[one]]
        nodes = x[m[one]]
        error = np.linalg.norm(nodes - index.decoded(lists, codes), axis=1)
        out: list[tuple[np.ndarray, ...]] = []
        edges = np.searchsorted(lists, np.arange(len(index.centers) + 1))
        for i in range(0, len(q) if len(m) else 0, 256):
            part = q[i : i + 256]
            near = x[part] @ index.centers.T
            allowed = _allowed(near, everywhere, probed, k)
            tables = index.tables(x[part])
            approx = np.full((len(part), len(nodes)), -np.inf)
            for c in np.flatnonzero(np.diff(edges)):
                a, b = edges[c], edges[c + 1]
                who = np.flatnonzero(allowed[:, c])
                approx[who, a:b] = near[who, c, None] + _ivfpq.looked_up(tables[who], codes[a:b])
            alone = (copies[:, 1:] < 0).all(axis=1)
            approx[(ids[part][:, None] == owned[None, :, 0]) & alone] = -np.inf
            # the best by table, and all that a usual error of their codes (and of the k-th) could lift to the k-th place
            best = _reranked(approx, np.linalg.norm(x[part], axis=1)[:, None] * error[None] * (SPREAD / index.width**0.5), k)
            row, col = np.nonzero(best)
            exact = np.concatenate([np.einsum("nd,nd->n", x[part[row[j : j + STEP]]], nodes[col[j : j + STEP]]) for j in range(0, len(row), STEP)] or [np.zeros(0)])
            # the k best nodes by their smallest id, then the k best of their ids
            first = owned[col, 0]
            if owned.shape[1] > 1:
                first = np.where((first == ids[part][row]) & ~alone[col], owned[col, 1], first)
            order = np.lexsort((first, -exact, row))
            place = np.arange(len(row)) - np.searchsorted(row[order], row[order])
            order, place = order[place < k], place[place < k]
            top = np.full((len(part), k), -1)
            top[row[order], place] = order
            best, exact = col[top] if len(col) else np.zeros(top.shape, int), np.where(top >= 0, exact[top] if len(exact) else -np.inf, -np.inf)
            each = owned[best].reshape(len(part), -1)
            exact = np.repeat(exact, owned.shape[1], axis=1)
            exact[(copies[best] < 0).reshape(each.shape) | (each == ids[part][:, None])] = -np.inf
            top = np.lexsort((each, -exact), axis=1)[:, :k]
            score = np.take_along_axis(exact, top, 1)
            found = np.take_along_axis(each, top, 1)
            use = np.isfinite(score)
            out.append((np.repeat(ids[part], use.sum(axis=1)), found[use], score[use]))
        a, b, c = (np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": a, "vec_id": b, "score": c})

    found = members.unionByName(asking).groupBy("group", "part", "block").applyInArrow(nearest, shape)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
