"""Embedding near-dedup by product quantisation (operator 4).

Vectors are scaled to length 1 and indexed: a coarse list and residual codes, with the
length e of the residual's quantisation error. Two vectors of cosine c lie
sqrt(2 - 2c) apart, so for the threshold's distance r

* a partner's list is one whose bisector with the vector's own list lies within r;
  these are sufficient probes: no pair is lost between lists;
* a member of a probed list is a candidate if its table-lookup distance to the vector
  is at most r + e, by the triangle inequality;
* candidates are reranked by the exact cosine in double precision.

So all pairs at or above the threshold are found. Vectors are compared inside their
label only. Equal vectors are collapsed first and counted by their number. A list's
members and the vectors that probe it are cut into blocks, and each pair of blocks is
one task group of bounded size; a group returns link counts and a spanning forest of
its links, not the pairs.

Defined results: vectors that are null, zero, hold null or non-finite components or
have not the usual width, and those with a null label, link with nothing; every input
row gives one row; rows that repeat a ``vec_id`` count as separate vectors with one
name; a null ``vec_id`` gets no component and links nothing; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _ivfpq
from ._graph import components
from ._store import stored

THRESHOLD = 0.98
#: Members and probing vectors in one block.
MEMBERS, ASKING = 2_048, 4_096
_SLACK = 1e-6


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component, by repeated minima over the edges."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def near_links(nodes: DataFrame, index: _ivfpq.Index, threshold: float) -> DataFrame:
    """node, links (weighted with the other's ``copies``), root: per group, from rows (node, label, embedding, copies)."""
    shared = nodes.sparkSession.sparkContext.broadcast(index)
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + _SLACK
    kind = nodes.schema["embedding"].dataType.simpleString()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The row in its own list, and for each list beyond it that it must probe."""
        index = shared.value
        between = np.linalg.norm(index.centers[:, None] - index.centers[None], axis=2)
        for batch in batches:
            x, at = _ivfpq.matrix(batch.column(2), index.width)
            if not len(at):
                continue
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            own = index.lists(x)
            codes = index.codes(x, own)
            error = np.linalg.norm(x - index.decoded(own, codes), axis=1)
            square = (index.centers**2).sum(axis=1) - 2 * x @ index.centers.T
            gap = (square - square[np.arange(len(x)), own][:, None]) / (2 * np.maximum(between[own], 1e-12))
            # a pair in two lists is met in the higher one
            probe = (gap <= radius) & (np.arange(len(index.centers))[None] > own[:, None])
            row, to = np.nonzero(probe)
            who = np.concatenate([np.arange(len(x)), row])
            kept = batch.take(pa.array(at[who]))
            yield pa.record_batch(
                {
                    "node": kept.column(0),
                    "label": kept.column(1),
                    "embedding": kept.column(2),
                    "copies": kept.column(3),
                    "list": pa.array(np.concatenate([own, to]).astype(np.int32)),
                    "member": pa.array(np.arange(len(who)) < len(x)),
                    "codes": pa.array([codes[w].tobytes() for w in who], pa.binary()),
                    "error": pa.array(error[who]),
                }
            )

    rows = stored(nodes.mapInArrow(coded, f"node long, label long, embedding {kind}, copies long, list int, member boolean, codes binary, error double"), "probes")
    sizes = rows.groupBy("label", "list").agg(F.count_if("member").alias("members"), F.count_if(~F.col("member")).alias("asking"))
    sizes = sizes.where("members > 0").select(
        "label", "list", F.ceil(F.col("members") / MEMBERS).cast("int").alias("mb"), F.ceil(F.col("asking") / ASKING).cast("int").alias("ab")
    )
    rows = rows.join(sizes, ["label", "list"])
    block = F.when(F.col("member"), F.pmod(F.xxhash64("node"), "mb")).otherwise(F.pmod(F.xxhash64("node"), F.greatest("ab", F.lit(1)))).cast("int")
    rows = rows.withColumn("block", block)
    every = lambda n: F.sequence(F.lit(0), n - 1)
    # groups: members with members (block pairs a <= b), and members with the vectors of other lists that probe them
    b = F.col("block")
    pairs_in = F.transform(every(F.col("mb")), lambda o: F.struct(F.lit(0).alias("how"), F.least(b, o).alias("a"), F.greatest(b, o).alias("b")))
    pairs_out = F.transform(F.filter(every(F.greatest("ab", F.lit(1))), lambda o: F.col("ab") > 0), lambda o: F.struct(F.lit(1).alias("how"), b.alias("a"), o.alias("b")))
    asks = F.transform(every(F.col("mb")), lambda o: F.struct(F.lit(1).alias("how"), o.alias("a"), b.alias("b")))
    dealt = rows.withColumn("at", F.explode(F.when(F.col("member"), F.concat(pairs_in, pairs_out)).otherwise(asks)))
    dealt = dealt.select("label", "list", "at.how", "at.a", "at.b", "block", "member", "node", "embedding", "copies", "codes", "error")

    def linked(table: pa.Table) -> pa.Table:
        index = shared.value
        table = table.sort_by([("node", "ascending")])
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        member, block = table.column("member").to_numpy(), table.column("block").to_numpy()
        x, _ = _ivfpq.matrix(table.column("embedding"), index.width)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        inside = table.column("how")[0].as_py() == 0
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        left = np.flatnonzero(member & (block == a))
        right = np.flatnonzero(block == b) if inside else np.flatnonzero(~member)
        same = inside and a == b
        own = np.full(1, table.column("list")[0].as_py())
        codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint8).reshape(len(node), -1)
        error = table.column("error").to_numpy()
        center = index.centers[own[0]]
        # |decoded|^2 of the left side, for distances by look-ups
        decoded = index.decoded(np.repeat(own, len(left)), codes[left])
        square = (decoded**2).sum(axis=1)
        first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(0, len(right), 512):
            part = right[i : i + 512]
            product = (x[part] @ center)[:, None] + _ivfpq.looked_up(index.tables(x[part]), codes[left])
            distance = np.sqrt(np.maximum(0.0, 1 + square[None] - 2 * product))
            r, c = np.nonzero(distance <= radius + error[left][None] + _SLACK)
            r, c = part[r], left[c]
            if same:
                r, c = r[r < c], c[r < c]
            for j in range(0, len(r), 1 << 17):
                rr, cc = r[j : j + (1 << 17)], c[j : j + (1 << 17)]
                near = np.einsum("nd,nd->n", x[rr], x[cc]) >= threshold
                first.append(rr[near])
                second.append(cc[near])
        i, j = np.concatenate(first), np.concatenate(second)
        count = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
        root = _forest(i, j, len(node))
        use = np.flatnonzero(count)
        return pa.table({"node": node[use], "links": count[use].astype(np.int64), "root": node[root[use]]})

    return dealt.groupBy("label", "list", "how", "a", "b").applyInArrow(linked, "node long, links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, sample: int = _ivfpq.SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row per vector."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    usable = rows.where("vec_id is not null and label is not null and embedding is not null")
    # equal vectors of a label are one node, named by the smallest vec_id. The hash only spares moving vectors around.
    rows = rows.withColumn("_h", F.xxhash64("embedding"))
    nodes = usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    nodes = stored(nodes.select("node", "label", "embedding", "copies"), "nodes")
    n = nodes.count()
    index = _ivfpq.fit(nodes.withColumnRenamed("node", "vec_id"), n, unit=True, sample=sample)
    if index is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = stored(near_links(nodes, index, threshold), "near")
    group = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("embedding", lambda v: v != 0)
    good = nodes.withColumn("good", finite & (F.size("embedding") == index.width))
    classes = (
        good.join(links, "node", "left")
        .join(group, "node", "left")
        .select(
            F.col("label").alias("_label"),
            F.col("embedding").alias("_e"),
            F.when(F.col("good"), F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(0).alias("n_links"),
            F.when(F.col("good"), F.coalesce("component", "node")).alias("component_id"),
            F.xxhash64("embedding").alias("_eh"),
        )
    )
    out = rows.join(classes, (F.col("_h") == F.col("_eh")) & (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_e")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept")
    )


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
), g AS (
  SELECT *, sqrt(list_inner_product(e, e)) AS n FROM v WHERE list_inner_product(e, e) > 0 AND isfinite(list_inner_product(e, e))
), p AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.98
), r AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings
  UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x
), c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT x AS vec_id, (SELECT count(*) FROM p WHERE p.x = c.x) AS n_links, component_id, x = component_id AS kept FROM c
"""
