"""URL filters by a trie over reversed host labels and path segments (operator 2).

A rule (verdict, host, path prefix) sits at the node reached by its host's labels
from the right and then its path's whole segments; what follows the last slash of
its path must start the url's next segment. A walk down the trie along a url meets
exactly the rules that fit it; the longest host and path wins, of equally long ones
the blocking one, and of those the one whose text is smallest.

Up to ``MAX_RULES`` rules are broadcast as a trie. Beyond that ``judge`` joins the
urls' trie paths (host suffix and segment prefix) to the rule table instead, which
gives the same results; no url's path is followed deeper than the deepest rule.

Defined results: a url that is null or has no ``://`` has empty host and path and
no rule; every input row gives one row; an empty table gives no rows; columns
besides ``page_id`` and ``url`` are ignored; without rules all are ``default``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .line_dedup import LOWER, UPPER

MAX_RULES, MAX_RULE_CHARS = 100_000, 2_000
RULES = "verdict string, host string, path string"
#: Rules of the query's contract.
CONTRACT = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Trie:
    """Nodes are dicts; the key None holds [(-length, not blocking, rule, verdict, rest of path)]."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in rules:
            *whole, rest = path.split("/")
            node = self.root
            for label in [*reversed(host.split(".")), *("/" + s for s in whole)]:
                node = node.setdefault(label, {})
            # the least comes first: the longest, then the blocking, then the smallest rule
            node.setdefault(None, []).append((-len(host) - len(path), verdict != "block", host + path, verdict, rest))
            node[None].sort()

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        segments = path.split("/")
        best, node = None, self.root
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            best = self._along(node, segments, best)
        return best and (best[2], best[3])

    @staticmethod
    def _along(node: dict, segments: list[str], best):
        for i, segment in enumerate(segments):
            for rule in node.get(None, ()):
                if segment.startswith(rule[4]) and (best is None or rule[:3] < best[:3]):
                    best = rule
            node = node.get("/" + segment) if i < len(segments) - 1 else None
            if node is None:
                break
        return best


def _with_trie(pages: DataFrame, rules: list, default: str) -> DataFrame:
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(rules)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shared.value)
        for batch in batches:
            found = [trie.find(h, p) or (None, default) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.record_batch(
                [*batch.columns, pa.array([r for r, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.mapInArrow(walk, f"page_id {kind}, host string, path string, rule string, verdict string")


def _with_join(pages: DataFrame, rules: DataFrame, default: str, most_labels: int, most_segments: int) -> DataFrame:
    """The same walk as rows: each url's (host suffix, segment prefix) pairs, joined to the rules by equality.

    Suffixes have at most as many labels, and prefixes as many segments, as any rule.

    A host of the most common kind has few suffixes, and AQE splits a skewed key of
    this inner join. The best rule is a partial aggregate per row.
    """
    labels, segments = F.split("host", r"\.", -1), F.split("path", "/", -1)
    keyed = pages.withColumn("_row", F.monotonically_increasing_id())
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - most_labels + 1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(
        F.sequence(F.lit(0), F.least(F.size(segments), F.lit(most_segments)) - 1),
        lambda i: F.struct(
            F.array_join(F.slice(segments, F.lit(1), i), "/").alias("whole"), i.alias("depth"), F.get(segments, i).alias("next")
        ),
    )
    places = keyed.select("_row", F.explode(suffixes).alias("_host"), "path").select("_row", "_host", F.explode(prefixes).alias("_at"))
    places = places.select("_row", "_host", F.col("_at.depth").alias("_depth"), F.col("_at.whole").alias("_whole"), F.col("_at.next").alias("_next"))
    parts = F.split("path", "/", -1)
    entries = rules.select(
        F.col("host").alias("_host"),
        (F.size(parts) - 1).alias("_depth"),
        F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/").alias("_whole"),
        F.get(parts, F.size(parts) - 1).alias("_rest"),
        F.struct(
            (-F.char_length("host") - F.char_length("path")).alias("n"),
            (F.col("verdict") != "block").alias("b"),
            F.concat("host", "path").alias("rule"),
            "verdict",
        ).alias("_rule"),
    )
    hits = places.join(entries, ["_host", "_depth", "_whole"]).where(F.startswith("_next", "_rest"))
    best = hits.groupBy("_row").agg(F.min("_rule").alias("_rule"))
    return keyed.join(best, "_row", "left").select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", F.lit(default)).alias("verdict")
    )


def judge(pages: DataFrame, rules: DataFrame | list, default: str = "allow", max_rules: int = MAX_RULES) -> DataFrame:
    """page_id, host, path, rule (host and path of the rule that won, or null), verdict."""
    spark = pages.sparkSession
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    table = rules if isinstance(rules, DataFrame) else spark.createDataFrame(rules, RULES)
    table = table.select("verdict", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path")).where("verdict is not null")
    most = lambda c: F.coalesce(F.max(c), F.lit(0))
    size = table.agg(
        F.count("*").alias("n"), most(F.char_length("host") + F.char_length("path")).alias("chars"),
        most(F.size(F.split("host", r"\.", -1))).alias("labels"), most(F.size(F.split("path", "/", -1))).alias("segments"),
    ).first()
    if size["n"] > max_rules or size["chars"] > MAX_RULE_CHARS:
        return _with_join(urls, table, default, max(1, size["labels"]), max(1, size["segments"]))
    return _with_trie(urls, [tuple(r) for r in table.collect()], default)


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), CONTRACT)


SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), h AS (
  SELECT page_id, regexp_extract(coalesce(r, ''), '^[^/?#]*') AS raw, coalesce(r, '') AS r FROM u
), p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(r, length(raw) + 1), '^[^?#]*') AS path FROM h
), rules(v, rh, rp) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), m AS (
  SELECT p.page_id, rh || rp AS rule, v,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(rh) + length(rp) DESC, v DESC) AS k
  FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
)
SELECT p.page_id, host, path, m.rule, coalesce(m.v, 'allow') AS verdict
FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.k = 1
"""
