"""Chat formatting (operator 7): relational, Spark expressions only.

Template, per run of adjacent turns of one role ("block"):

    system     <<SYS>> ... <</SYS>>
    user       [INST] ... [/INST]
    assistant  <s> ... </s>
    other      [ROLE]name[TURN] ... [/ROLE]

Turns inside a block are separated by ``[TURN]``. Any of these control strings
inside a text or role name is escaped by replacing its first character with a
backslash code, and backslashes themselves are escaped, so that the formatted
string parses back to exactly the turns that went in.

Defined results: a null text or role counts as the empty string; a null
``turn`` sorts first; rows with equal turns sort by role, then text; repeated
rows are repeated turns; rows with a null ``conv_id`` form one conversation;
an empty table gives no rows; further input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the template writes before and after a block of each known role.
OPEN = {"system": "<<SYS>>", "user": "[INST]", "assistant": "<s>"}
CLOSE = {"system": "<</SYS>>", "user": "[/INST]", "assistant": "</s>"}
OTHER_OPEN, OTHER_CLOSE, TURN = "[ROLE]", "[/ROLE]", "[TURN]"

_ANGLE = r"<(?=/?s>|</?SYS>>)"
_SQUARE = r"\[(?=/?INST\]|/?ROLE\]|TURN\])"
#: One whole block of the formatted string.
_BLOCK = r"(?s)(<<SYS>>.*?<</SYS>>|\[INST\].*?\[/INST\]|<s>.*?</s>|\[ROLE\].*?\[/ROLE\])"
_CHUNK = 256


def escape(text: Column) -> Column:
    """Make every control string in ``text`` unreadable as one, reversibly."""
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    text = F.regexp_replace(text, _ANGLE, r"\\l")
    return F.regexp_replace(text, _SQUARE, r"\\i")


def unescape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\l"), F.lit("<"))
    text = F.replace(text, F.lit("\\i"), F.lit("["))
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def _by_role(role: Column, table: dict[str, str], other: Column) -> Column:
    out = other
    for name, value in table.items():
        out = F.when(role == name, F.lit(value)).otherwise(out)
    return out


def _spans(pieces: Column) -> Column:
    """[start, length) in code points of the pieces under the loss mask.

    Two levels of running sums, so that the array that ``aggregate`` copies
    at each step has at most 256 entries (or one per 256 pieces).
    """
    empty = F.array().cast("array<struct<start:long,length:long>>")

    def inside(chunk: Column) -> Column:
        return F.aggregate(
            chunk,
            F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans")),
            lambda acc, p: F.struct(
                (acc["at"] + F.char_length(p["s"])).alias("at"),
                F.when(
                    p["loss"],
                    F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), F.char_length(p["s"]).cast("long").alias("length")))),
                ).otherwise(acc["spans"]).alias("spans"),
            ),
        )

    last = F.floor((F.size(pieces) - 1) / _CHUNK).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), last), lambda i: inside(F.slice(pieces, i * _CHUNK + 1, F.lit(_CHUNK))))
    bases = F.aggregate(
        chunks,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("bases")),
        lambda acc, c: F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["bases"], F.array(acc["at"])).alias("bases")),
    )["bases"]
    moved = F.zip_with(
        chunks, bases, lambda c, base: F.transform(c["spans"], lambda s: F.struct((s["start"] + base).alias("start"), s["length"].alias("length")))
    )
    return F.flatten(moved)


def format_chats(turns: DataFrame, train_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans (one [start, length) per text of ``train_role``).

    One shuffle by ``conv_id``; sorting, merging and joining happen in arrays.
    """
    rows = turns.select(
        "conv_id",
        F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))

    def pieces(x: Column, i: Column) -> Column:
        prev, after = F.get(F.col("t"), i - 1)["role"], F.get(F.col("t"), i + 1)["role"]
        role = x["role"]
        opens = F.coalesce(prev != role, F.lit(True))
        closes = F.coalesce(after != role, F.lit(True))
        head = F.when(opens, _by_role(role, OPEN, F.concat(F.lit(OTHER_OPEN), escape(role), F.lit(TURN)))).otherwise(F.lit(TURN))
        tail = F.when(closes, _by_role(role, CLOSE, F.lit(OTHER_CLOSE))).otherwise(F.lit(""))
        piece = lambda s, loss: F.struct(s.alias("s"), loss.alias("loss"))
        return F.array(piece(head, F.lit(False)), piece(escape(x["text"]), role == train_role), piece(tail, F.lit(False)))

    out = convs.select("conv_id", F.flatten(F.transform("t", pieces)).alias("pieces"))
    return out.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"),
        _spans(F.col("pieces")).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns parsed out of a formatted string."""

    def turns(block: Column) -> Column:
        known = F.coalesce(*[F.when(F.startswith(block, F.lit(o)), F.lit(r)) for r, o in OPEN.items()])
        opened, closed = F.lit(None).cast("int"), F.lit(None).cast("int")
        for role in OPEN:
            opened = F.when(known == role, F.lit(len(OPEN[role]))).otherwise(opened)
            closed = F.when(known == role, F.lit(len(CLOSE[role]))).otherwise(closed)
        opened, closed = F.coalesce(opened, F.lit(len(OTHER_OPEN))), F.coalesce(closed, F.lit(len(OTHER_CLOSE)))
        body = F.substring(block, opened + 1, F.char_length(block) - opened - closed)
        parts = F.split(body, r"\[TURN\]", -1)
        role = F.coalesce(known, unescape(F.get(parts, F.lit(0))))
        texts = F.when(known.isNull(), F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)
        return F.transform(texts, lambda s: F.struct(role.alias("role"), unescape(s).alias("text")))

    return F.flatten(F.transform(F.regexp_extract_all(formatted, F.lit(_BLOCK), F.lit(1)), turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def digests(formatted: DataFrame) -> DataFrame:
    """What the query returns, read back from ``format_chats``' output."""
    back = formatted.select(
        "conv_id",
        read_back(F.col("formatted")).alias("turns"),
        loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def query(spark, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame(
        [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string"
    )
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return digests(format_chats(turns.unionByName(extra)))


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), n AS (
  SELECT *, row_number() OVER w AS k,
         coalesce(lag(role) OVER w <> role, true) AS opens, coalesce(lead(role) OVER w <> role, true) AS closes
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), p AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
    + len(regexp_extract_all(text, '</?s>|<</?SYS>>|\[/?INST\]|\[/?ROLE\]|\[TURN\]'))
    + CASE WHEN NOT opens THEN 6
           ELSE CASE role WHEN 'system' THEN 7 WHEN 'user' THEN 6 WHEN 'assistant' THEN 3 ELSE 12 + length(role) END END
    + CASE WHEN NOT closes THEN 0
           ELSE CASE role WHEN 'system' THEN 8 WHEN 'user' THEN 7 WHEN 'assistant' THEN 4 ELSE 7 END END AS n_chars
  FROM n
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n_chars) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""
