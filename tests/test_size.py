"""Queries on tables grown as larger ones are: rows repeated with shifted keys, so that places are shared."""

import duckdb
import numpy as np
import pytest
from compare import assert_same, duck
from pyspark.sql import functions as F

from cohortlake import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def make(tmp_path_factory):
    """A folder of orders and events, each the table of sf0.001 through some SQL."""

    def write(orders: str = "SELECT * FROM t", events: str = "SELECT * FROM t") -> str:
        folder = tmp_path_factory.mktemp("grown")
        con = duckdb.connect()
        for name, sql in (("orders", orders), ("events", events)):
            con.execute(f"COPY (WITH t AS (SELECT * FROM '{SF}/{name}.parquet') {sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        return str(folder)

    return write


def same(spark, folder: str, *names: str) -> None:
    con = duck(folder)
    for name in names:
        want = con.execute(SQL[name]).df()
        assert len(want), name
        assert_same(QUERIES[name](spark, folder).toPandas(), want, name)


def test_force_list_leaves_out_others_of_the_same_place(spark, make):
    # a million ids on, an order has the same position
    folder = make("SELECT * FROM t UNION ALL SELECT * REPLACE (o_orderkey + 6000000 AS o_orderkey) FROM t")
    same(spark, folder, "force_list")


def joined(df) -> int:
    """The rows that all joins of a query put out."""
    df.collect()

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        own = node.metrics().get("numOutputRows").get().value() if "Join" in name else 0
        return own + sum(walk(node.children().apply(i)) for i in range(node.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


ONE_SPOT = 200


@pytest.fixture(scope="module")
def spot(make):
    """Candidates of a few places with as many equal clips at each, some of two samples."""
    orders = f"SELECT t.* REPLACE (o_orderkey % 5 + k * 6000000 AS o_orderkey, 0 AS o_custkey, 1000 AS o_totalprice) FROM t, range({ONE_SPOT}) r(k) WHERE o_orderkey < 5"
    events = f"""SELECT t.* REPLACE (t.event_id * 2 + 1 + k * 2000 AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (2 + (event_id % 5) * 15838 + k % 3) SECOND AS ts, k % 2 AS user_id,
      CASE k % 2 WHEN 0 THEN 'click' ELSE 'view' END AS event_type) FROM t, range({ONE_SPOT}) r(k) WHERE event_id < 5"""
    return make(orders, events)


@pytest.mark.parametrize("name", ["clip_mode", "clip_histogram", "clip_window_counts", "evidence_counts", "evidence_score", "evidence_support"])
def test_clips_are_counted_before_they_meet_candidates(spark, spot, name):
    same(spark, spot, name)
    # 200 candidates of a place and 200 clips there were 40,000 rows for each place
    assert joined(QUERIES[name](spark, spot)) < 60 * ONE_SPOT


def test_evidence_on_grown_tables(spark, make):
    orders = "SELECT t.* REPLACE (o_orderkey + k * 1500 AS o_orderkey, o_custkey + k * 150 AS o_custkey) FROM t, range(2) r(k)"
    events = "SELECT t.* REPLACE (event_id + k * 1000 AS event_id, ts + INTERVAL (k % 2) SECOND AS ts) FROM t, range(6) r(k)"
    same(spark, make(orders, events), "pairs_near_sv", "clips_near_sv", "pair_histogram", "pair_cluster_hits", "clip_histogram", "clip_mode", "clip_window_counts", "evidence_counts", "evidence_support")


@pytest.mark.parametrize("far_end", [False, True])
def test_little_but_true_evidence_meets(spark, far_end):
    """Windows and breaks against plain Python; what shares a block is a few times what is true."""
    from cohortlake.operators import evidence as E

    rng = np.random.default_rng(3)
    place = lambda n: rng.integers(0, 8_000, n)
    n, m = 400, 3000
    kinds = ["DEL", "DUP", "CNV", "INV", "INS", None]
    sv = [(i, kinds[i % 6], 1, int(p), int(p + w)) for i, (p, w) in enumerate(zip(place(n), rng.integers(11, 3000, n), strict=True))]
    ev = [(i, i % 3, 1, int(p), int(p + w), int(q), int(s), 40, 50, *map(int, c)) for i, (p, w, q, s, c) in enumerate(zip(place(m), rng.integers(-300, 3500, m), rng.integers(0, 61, m), rng.integers(0, 4, m), rng.integers(0, 2, (m, 4)), strict=True))]
    left = spark.createDataFrame(sv, "sv_id long, svtype string, chrnum int, pos int, end int")
    right = spark.createDataFrame(ev, "ev_id long, sample_id int, chrnum int, pos int, mate int, qual int, pairstr int, rlen int, sa_rlen int, lclip int, rclip int, sa_lclip int, sa_rclip int").withColumn("kind", F.lit("lclip"))
    pairs, splits, clips = E.pair_rows(right), E.split_rows(right), E.clip_rows(right)

    window = E.pair_window(F.col("svtype"), F.col("s.pos"), F.col("s.end"), F.col("pos"), F.col("mate"), F.col("qual"), F.col("side"))
    every = lambda rows: left.select("svtype", F.struct(*left.columns).alias("s")).crossJoin(rows)
    want = {("pair", r.s.sv_id, r.ev_id, r.pos, r.mate) for r in every(pairs).where(window).collect()}
    for r in every(splits).collect():
        a, b = {"DEL": (r.del_beg, r.del_end), "DUP": (r.dup_beg, r.dup_end), "CNV": (r.dup_beg, r.dup_end), "INV": (r.inv_beg, r.inv_end)}.get(r.svtype, (None, None))
        s, e = r.s.pos, r.s.end
        if a is None or min(abs(r.pos - s), abs(r.pos - e)) > 500 or not -100 <= b - e < 100 or a < s - 100:
            continue
        if (b if r.svtype == "INV" and not far_end else a) < s + 100:
            want.add(("split", r.s.sv_id, r.ev_id, a, b))
    for i, _, _, s, e in sv:
        for j, _, _, p, *_ in ev:
            want |= {("clip", i, j, p - x + c, None) for x, c in ((s, 100), (e, 300)) if -100 <= p - x < 100}
    rows = E.evidence_rows(right, right, right)
    got = [(r.tag, r.sv_id, r.ev_id, r.a, r.b) for r in E.evidence_near(left, rows, far_end).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {t for t, *_ in got} == {"pair", "split", "clip"}
    for tag, alone in (("pair", pairs), ("split", splits), ("clip", clips)):
        assert E._meetings(left, alone, far_end).count() < 8 * sum(t == tag for t, *_ in got) + 1000, tag


def test_clips_of_attempts_are_counted_before_they_meet_candidates(spark, spot):
    same(spark, spot, "given_counts")
    assert joined(QUERIES["given_counts"](spark, spot)) < 60 * ONE_SPOT


def test_clip_cells_of_groups_are_counted_before_they_meet_candidates(spark, spot):
    from cohortlake.operators import queries_evidence as Q

    con, width = duck(spot), 10
    cells = con.execute(SQL["clips_near_sv"].replace("SELECT * FROM cc", f"SELECT sv_id // 400 * 3 AS sv_id, sample_id, kind, cell >= 200 AS far, cell // {width} * {width} AS cell, count(*) AS n FROM cc GROUP BY ALL")).df()
    got = Q.E.grouped_cells(Q._sv(spark, spot), Q._clip_rows(spark, spot), F.floor(F.col("sv_id") / 400) * 3, width)
    assert len(cells)
    assert_same(got.toPandas(), cells)
    assert joined(QUERIES["clip_consensus"](spark, spot)) < 60 * ONE_SPOT


def test_components_of_dense_and_thin_places(spark, make, monkeypatch):
    """Against union-find over all pairs; tables of links stay far below the pairs."""
    from cohortlake.operators import graph

    rng = np.random.default_rng(5)
    spread = [(int(p), int(w), k) for p, w, k in zip(rng.integers(0, 60_000, 300), np.exp(rng.uniform(np.log(12), np.log(20_000), 300)), rng.integers(0, 2, 300), strict=True)]
    dense = [(5_000 + int(a), 4_000 + int(b), 0) for a, b in zip(rng.integers(0, 300, 300), rng.integers(0, 300, 300), strict=True)]
    rows = [(i * 6 + k, p, w) for i, (p, w, k) in enumerate(spread + dense)]
    # the view's start is (key * 7919) % 1000000 + 1 and its length 11 + price: keys that give these starts, of types by key % 6
    inverse = pow(7919, -1, 1_000_000)
    table, seen = [], set()
    for _, p, w in rows:
        key = p * inverse % 1_000_000
        while key in seen:
            key += 6_000_000
        seen.add(key)
        table.append((key, p + 1, p + 12 + w % 20_000, key % 6))
    values = ", ".join(f"({k}, {e - s - 11})" for k, s, e, _ in table)
    folder = make(f"SELECT t.* REPLACE (CAST(x.k AS BIGINT) AS o_orderkey, 1::BIGINT AS o_custkey, CAST(x.w AS DOUBLE) AS o_totalprice) FROM (SELECT * FROM t LIMIT 1) t, (VALUES {values}) x(k, w)")
    root = {k: k for k, *_ in table}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    pairs = 0
    for i, (a, s, e, k) in enumerate(table):
        for b, s2, e2, k2 in table[:i]:
            if k == k2 and 10 * (min(e, e2) - max(s, s2)) > 7 * (max(e, e2) - min(s, s2)):
                pairs += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    sizes, stored = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name, *more: (out := stored(df, name, *more), name == "edges" and sizes.append(out.count()))[0])
    got = {r.sv_id: r.component for r in QUERIES["ro_components"](spark, folder).collect()}
    assert got == {k: find(k) for k in root} and 1 < len(set(got.values())) < len(got)
    assert pairs > 6 * len(table) and sizes and max(sizes) < 3 * len(table)
