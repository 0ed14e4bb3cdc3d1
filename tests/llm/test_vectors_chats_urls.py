"""Vector, chat and url operators against brute force, and their defined results on odd input."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.llm import chat_format, embedding_dedup, url_filter, vector_search

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(n=600, width=12, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    for i in range(n // 3, 2 * n // 3):  # chains of near copies, some exact
        x[i] = x[i - 1] + rng.normal(size=width) * rng.choice([0.0, 0.02, 0.15])
    x = x.astype(np.float32)
    rows = [(i, x[i].tolist(), int(rng.integers(3))) for i in range(n)]
    odd = [(9001, None, 1), (9002, [0.0] * width, 1), (9003, [float("nan")] * width, 1), (9004, [None, *[1.0] * (width - 1)], 1), (9005, [1.0, 2.0], 1), (9006, x[0].tolist(), None), (9007, [float("inf")] * width, 0), (9020, [], 2)]
    return rows, odd


def test_near_duplicates(spark):
    rows, odd = vectors()
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame([(*r, 7) for r in rows + odd], VECTORS + ", node int")).collect()}
    assert len(got) == len(rows) + len(odd)
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    link = (x @ x.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(link, False)
    root = np.arange(len(rows))
    while (new := np.array([min([root[i], *root[link[i]]]) for i in range(len(rows))])).tolist() != root.tolist():
        root = new
    for i in range(len(rows)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (link[i].sum(), root[i], root[i] == i), i
    for i, *_ in odd:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    again = embedding_dedup.near_duplicates(spark.createDataFrame([rows[0], rows[0], (None, rows[0][1], rows[0][2])], VECTORS)).collect()
    assert sorted((r.vec_id is None, r.n_links) for r in again) == [(False, 1), (False, 1), (True, 0)]
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_search_recall_and_scores(spark):
    rows, odd = vectors(1500, 16, 3)
    got = vector_search.search(spark.createDataFrame([(*r, 7) for r in rows + [o for o in odd if o[0] != 9006]], VECTORS + ", rank int"), F.col("vec_id") % 20 == 0, k=20).collect()
    x = np.array([r[1] for r in rows], float)
    hit, n = 0, 0
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert sorted(by) == list(range(0, 1500, 20))
    for q, found in by.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21)) and q not in [r.vec_id for r in found]
        assert all(abs(r.score - x[q] @ x[r.vec_id]) < 1e-9 for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        score = x @ x[q]
        score[q] = -np.inf
        hit += len({r.vec_id for r in found} & set(np.argsort(-score)[:20].tolist()))
        n += 20
    assert hit / n >= 0.9
    few = vector_search.search(spark.createDataFrame(rows[:5], VECTORS), F.col("vec_id") % 20 == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4]
    assert vector_search.search(spark.createDataFrame([], VECTORS), F.col("vec_id") % 20 == 0).count() == 0


def test_search_ties_of_many_copies(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6_000, 8)).astype(np.float32)
    copies = np.sort(rng.permutation(6_000)[:5_000])
    x[copies] = 3 * np.ones(8)
    got = vector_search.search(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VECTORS), F.col("vec_id") % 500 == copies[0] % 500).toPandas()
    asked = 0
    for query, found in got.sort_values("rank").groupby("query_id"):
        score = x.astype(float) @ x[query].astype(float)
        if query in copies or np.sum(score > score[copies[0]]) == 0:
            score[query] = -np.inf
            assert found.vec_id.tolist() == np.lexsort((np.arange(6_000), -score))[:20].tolist(), query
            asked += 1
    assert asked > 5


@pytest.mark.parametrize("n", [40, 48, 80, 120])
def test_search_fills_k_on_small_tables(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 6))
    x[: n // 2] += 9 * np.eye(6)[np.arange(n // 2) % 6]
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x.astype(np.float32))], VECTORS)
    got = vector_search.search(frame, F.lit(True), k=36, probes=0.3).groupBy("query_id").count().collect()
    assert len(got) == n and all(r["count"] == 36 for r in got)


def test_search_of_clusters_probes_few_lists(spark, monkeypatch):
    rng = np.random.default_rng(8)
    n, centers = 12_000, rng.normal(size=(60, 24))
    x = (centers[rng.integers(0, 60, n)] + 0.25 * rng.normal(size=(n, 24))).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VECTORS)
    monkeypatch.setattr(vector_search, "SHARD", 1_000)
    monkeypatch.setattr(vector_search, "BLOCK", 100)
    index = vector_search._ivfpq.fit(frame, n, unit=False, k=20, recall=vector_search.RECALL)
    assert index.share < 0.3
    got = vector_search.search(frame, F.col("vec_id") % 20 == 0).toPandas().groupby("query_id").vec_id.apply(set)
    assert len(got) == n // 20
    recall = []
    for i in range(0, n, 20):
        score = x.astype(float) @ x[i].astype(float)
        score[i] = -np.inf
        recall.append(len(got[i] & set(np.argsort(-score)[:20].tolist())) / 20)
    assert np.mean(recall) >= 0.9


def test_search_groups():
    group, parts = vector_search._groups(np.array([10, 4_000, 100, 9_000, 5, 0, 4_096]))
    assert group.tolist() == [0, 0, 1, 2, 3, 3, 4] and parts.tolist() == [1, 1, 1, 3, 1, 1, 1]


def test_search_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    x, ids = np.stack(rows.embedding.to_numpy()).astype(float), rows.vec_id.to_numpy()
    got = vector_search.query(spark, sf).toPandas().groupby("query_id").vec_id.apply(set)
    recall = []
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        score[i] = -np.inf
        recall.append(len(got[ids[i]] & set(ids[np.argsort(-score)[:20]].tolist())) / 20)
    assert np.mean(recall) >= 0.9


# --- chats


def test_chats_round_trip(spark):
    nasty = "</s>[INST] ok [/INST] \\l \\\\b <<SYS>>[TURN][ROLE]<s>< [ \\"
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "user", nasty), (1, 2, "user", "again"), (1, 3, "assistant", nasty), (1, 4, "assistant", ""), (1, 5, "tool", "[/ROLE]"), (1, 6, "too[TURN]l", None),
        (2, None, None, None), (2, 0, "assistant", "日本😀"), (None, 1, "user", "x"), (3, 1, "assistant", "same"), (3, 1, "assistant", "same"),
    ]
    rows += [(4, i, "assistant" if i % 2 else "user", f"t{i} <s>") for i in range(1500)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, pieces string")
    got = {r.conv_id: r for r in chat_format.digests(chat_format.format_chats(frame)).collect()}
    formatted = {r.conv_id: r for r in chat_format.format_chats(frame).collect()}
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert set(by) == set(got)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == len(formatted[c].formatted)
        assert len(formatted[c].loss_spans) == sum(r == "assistant" for _, r, _ in turns)
    assert chat_format.digests(chat_format.format_chats(frame.limit(0))).count() == 0


# --- urls

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.net", "/en/x"), ("allow", "a.example.net", ""), ("block", "org", "/de"), ("allow", "org", "/de"), ("block", "", "/empty"), ("allow", "x.net", "/"), ("allow", "net", "/ab"), ("allow", "io", "/a/b/"), ("block", "io", "/a/b/")]
URLS = ["http://net/", "https://Example.NET/en/x/y?z", "http://b.example.net/en/", "http://a.example.net", "http://xexample.net/en/", "ftp://q.org/de", "q.org/de", "http://q.org/dex#y", None, "", "://", "http://net", "http:///empty/x", "http://net./", "a://b://c/d", "http://x.net/ab/", "http://io/a/b/c", "http://io/" + "a/" * 3_000, "http://" + "x." * 3_000 + "io/a/b/"]


@pytest.mark.parametrize("most", [url_filter.MAX_RULES, 0])
def test_urls(spark, most):
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(URLS)] + [(0, URLS[0], "r")], "page_id long, url string, rule string")
    got = url_filter.judge(pages, spark.createDataFrame(RULES, url_filter.RULES), max_rules=most).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        url = URLS[r.page_id]
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, path = rest[:end].lower(), rest[end:]
            path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        fits = [(-len(h) - len(p), v != "block", h + p, v) for v, h, p in RULES if (host == h or (h and host.endswith("." + h))) and path.startswith(p)]
        best = min(fits, default=None)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and best[2], best[3] if best else "allow"), url
    assert url_filter.judge(pages.limit(0), RULES).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, []).collect()} == {"allow"}
