"""License scans by diagonal voting (operator 1).

All rolling k-gram hashes of a document's words are Spark-joined to the positions
of the same hashes in license templates. A hit at document word p and template
word t votes for the diagonal p - t. Votes are counted per (document, template,
diagonal); neighbouring diagonals, which small insertions and deletions make, are
merged, and a template position that votes on several of them counts once. A merged
span is verified by its words in order: going along the template, hits must not step
back in the document, and the share of the template's words that they cover decides
(a phrase needs every k-gram on one diagonal). Of notices that start at one place, the
one with the greatest share counts; notices of different licenses that tie there are
ambiguous and give no label. Each hit compares a second 64-bit hash of another kind, so
128 bits of hash stand for the words.

The templates are given by the caller and bounded (``MAX_GRAMS`` k-grams), so they
are broadcast. Hits alone are shuffled, once, by row.

Defined results: null and empty texts have no words and no labels; every input row
gives one row, also rows that repeat or have a null ``doc_id``; an empty table
gives no rows; columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._text import ALNUM, bounds, flat, grams, hashes, pieces, text_words

K = 3
MAX_GRAMS = 1_000_000


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: bool = False


#: Phrases of the query's contract: every place counts.
PHRASES = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)
#: Notices: found also when some words are changed. Short forms of how works are placed under a license, and the grants of permissive licenses.
NOTICES = (
    Template("gpl-3", "this work is licensed under the gnu general public license version 3"),
    Template("gpl-2", "this work is licensed under the gnu general public license version 2"),
    Template("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    Template("gpl-2", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    Template("lgpl", "this work is licensed under the gnu lesser general public license"),
    Template("agpl-3", "this work is licensed under the gnu affero general public license version 3"),
    Template("mpl-2", "this work is subject to the terms of the mozilla public license version 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    Template("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    Template("mit", "released under the mit license see the license file for details"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("mit", "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    Template("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    Template("apache-2", "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike license"),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution share alike license"),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial license"),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution non commercial license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
)
#: Share of a notice's words that a span must hold in order, and how far merged diagonals may lie apart.
MIN_SHARE, SLACK = 0.7, 2


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = flat(pa.array([text.lower()]))
    starts, ends, first = bounds(data, offsets, ALNUM)
    return tuple(grams(hashes(data, starts, ends, seed), first, K)[0].view(np.int64) for seed in (1, 2))


def template_positions(spark, templates: Iterable[Template]) -> DataFrame:
    """_g, _check, _template, _t, _n (k-grams), _label, _phrase; and the mark of a document's own row (template -1)."""
    rows = [(0, 0, -1, 0, 0, "", False)]
    for i, t in enumerate(templates):
        g, c = _grams(t.text)
        if not len(g):
            raise ValueError(f"a template needs at least {K} words: {t.text!r}")
        rows += [(int(a), int(b), i, j, len(g), t.label, t.phrase) for j, (a, b) in enumerate(zip(g, c, strict=True))]
    if len(rows) > MAX_GRAMS:
        raise ValueError(f"{len(rows)} template k-grams; at most {MAX_GRAMS} are broadcast")
    return spark.createDataFrame(rows, "_g long, _check long, _template int, _t int, _n int, _label string, _phrase boolean")


def _document_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per k-gram (_p: its first word), and one per document with _d_g 0 (_p: number of words)."""
    for batch in pieces(batches, 2 << 20):
        data, starts, ends, first = text_words(batch, ALNUM)
        g, at = grams(hashes(data, starts, ends, 1), first, K)
        c, _ = grams(hashes(data, starts, ends, 2), first, K)
        owner = np.searchsorted(first, at, "right") - 1
        n = np.diff(first)
        who = np.concatenate([np.arange(len(n)), owner])
        zero = np.zeros(len(n), np.int64)
        yield pa.record_batch(
            {
                "_row": batch.column(0).take(pa.array(who)),
                "doc_id": batch.column(1).take(pa.array(who)),
                "_p": np.concatenate([n, at - first[owner]]).astype(np.int32),
                "_d_g": np.concatenate([zero, g.view(np.int64)]),
                "_d_check": np.concatenate([zero, c.view(np.int64)]),
            }
        )


def spans(docs: DataFrame, templates: Iterable[Template] = PHRASES + NOTICES, min_share: float = MIN_SHARE) -> DataFrame:
    """_row, doc_id, n_words (on a document's own row, where label is null), label, phrase, start, share, found."""
    templates = tuple(templates)
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    all_grams = rows.mapInArrow(_document_grams, "_row long, doc_id long, _p int, _d_g long, _d_check long")
    where = F.broadcast(template_positions(docs.sparkSession, templates))
    hits = all_grams.join(where, (F.col("_d_g") == F.col("_g")) & (F.col("_d_check") == F.col("_check")))
    hits = hits.select("_row", "doc_id", "_template", "_label", "_phrase", "_n", "_t", "_p", (F.col("_p") - F.col("_t")).alias("_diagonal"))
    votes = (
        hits.repartition("_row")
        .groupBy("_row", "doc_id", "_template", "_label", "_phrase", "_n", "_diagonal")
        .agg(F.count("*").alias("_votes"), F.collect_list(F.when(F.col("_template") >= 0, F.struct("_t", "_p"))).alias("_hits"), F.max(F.when(F.col("_template") < 0, F.col("_p"))).alias("n_words"))
    )
    order = Window.partitionBy("_row", "_template").orderBy("_diagonal")
    apart = F.coalesce(F.col("_diagonal") - F.lag("_diagonal").over(order) > F.when(F.col("_phrase"), 0).otherwise(SLACK), F.lit(True))
    merged = (
        votes.withColumn("_new", apart.cast("int"))
        .withColumn("_group", F.sum("_new").over(order))
        .groupBy("_row", "doc_id", "_template", "_label", "_phrase", "_n", "_group")
        .agg(F.sum("_votes").alias("_votes"), F.sort_array(F.flatten(F.collect_list("_hits"))).alias("_hits"), F.min("_diagonal").alias("start"), F.max("n_words").alias("n_words"))
    )
    merged = merged.withColumn("_share", F.when(F.col("_phrase"), F.col("_votes") / F.col("_n")).otherwise(_in_order(F.col("_hits")) / (F.col("_n") + K - 1))).drop("_hits")
    # notices that start at one place compete: "version 2" against "version 3"
    place = Window.partitionBy("_row", "_phrase").orderBy("start", "_template")
    apart = F.coalesce(F.col("start") - F.lag("start").over(place) > SLACK, F.lit(True))
    merged = merged.withColumn("_new", apart.cast("int")).withColumn("_place", F.sum("_new").over(place))
    rivals = Window.partitionBy("_row", "_phrase", "_place")
    own = F.col("_template") < 0
    merged = merged.withColumn("_best", F.max(F.when(~own, F.col("_share"))).over(rivals))
    merged = merged.withColumn("_winners", F.size(F.collect_set(F.when(~own & (F.col("_share") >= F.col("_best")), F.col("_label"))).over(rivals)))
    share = F.least(F.col("_share"), F.lit(1.0))
    notice = (share >= min_share) & (F.col("_share") >= F.col("_best")) & (F.col("_winners") == 1)
    return merged.select(
        "_row",
        "doc_id",
        F.when(own, F.col("n_words")).cast("long").alias("n_words"),
        F.when(~own, F.col("_label")).alias("label"),
        (F.col("_phrase") & ~own).alias("phrase"),
        F.when(~own, F.col("start")).alias("start"),
        F.when(~own, share).alias("share"),
        (~own & F.when(F.col("_phrase"), share >= 1.0).otherwise(notice)).alias("found"),
    )


def _in_order(hits: Column) -> Column:
    """Template words covered by hits (t, p), sorted: of a position's hits the first that doesn't step back in the document counts."""
    start = F.struct(F.lit(-K).alias("t"), F.lit(-1).alias("p"), F.lit(0).alias("words"))

    def step(sofar: Column, hit: Column) -> Column:
        ahead = (hit["_p"] > sofar["p"]) & (hit["_t"] > sofar["t"])
        words = sofar["words"] + F.least(F.lit(K), hit["_t"] - sofar["t"])
        return F.when(ahead, F.struct(hit["_t"].alias("t"), hit["_p"].alias("p"), words.alias("words"))).otherwise(sofar)

    return F.aggregate(hits, start, step, lambda x: x["words"])


def scan(docs: DataFrame, templates: Iterable[Template] = PHRASES + NOTICES, min_share: float = MIN_SHARE) -> DataFrame:
    """A row per document: words, places of phrases, labels of phrases and of all templates, score."""
    base = F.col("phrase") & F.col("found")
    labels = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    return (
        spans(docs, templates, min_share)
        .groupBy("_row", "doc_id")
        .agg(
            F.max("n_words").alias("n_words"),
            F.count_if(base).alias("n_base"),
            F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
            labels(base).alias("base_labels"),
            labels(F.col("found")).alias("labels"),
            F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
        )
        .drop("_row")
    )


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
