"""Conversation structure repair (operator 13): a backward cost-to-go table, then a greedy walk along tight steps.

A repaired conversation reads ``(s?(ua)+)?`` by the initials of its roles. The grammar has
four states (nothing yet, after a system turn, after a user turn, after an assistant
turn). From the last turn back, each state gets the least cost of what is left; from the
first turn on, the walk takes the ASCII-least edit among those whose cost and remaining cost
add up to that least cost. A turn matters to this only by its symbol (initial; sound,
truncated or to be deleted), and cost tables matter only by their differences, of which
there are few; so steps are remembered by (differences, symbol).

Turns are dealt into ranges of (conversation, turn, role, digest of text, row), so a
conversation that a third of all turns belong to is many tasks. What lies whole inside a
range is repaired there, while rows stream by. The first and the last conversation of a
range may go on in others: their turns are written as blocks. A block is a matrix of least
costs from state to state; matrices of a conversation (at most one for each range) are
chained backward, which gives each block the costs behind it; each block then says where it
ends for each state where it may start, and one chain forward fixes the starts. Only the
digest of such a conversation's text, which is sequential by nature, runs in one task,
as a stream.

Defined results: a null role or text is one space (an initial that is never legal), and so is a
null conv_id or turn inside the text that decides the damage; rows with a null ``conv_id``
are one conversation; null turns come first, equal turns in order of role and then of the text's
MD5; rows that repeat are turns of their own; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import stored

SPACE = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Faults of a turn; blank ones and duplicates must go. ``GONE`` marks a row that the damage dropped, so that its conversation is known.
SOUND, CUT, BLANK, DUPLICATE, GONE = range(5)
#: States: nothing yet, after system, after user, after assistant. What a kept initial leads to; the role that an inserted or changed turn takes, and its state.
LEGAL = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEXT = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))
ACCEPTED = (0, 3)
FAR = 1 << 60
#: Least cost from each state when no turn is left.
END = (0, 6, 3, 0)
_TO = [tuple(0 if q == r else FAR for q in range(4)) for r in range(4)]


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: rows dropped (``gone``), emptied, without stops, repeated or given to the user, by the CRC-32 of ``conv_id:turn``."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.pmod(F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")), F.lit(20))
    text = F.when(way == 0, F.lit(None)).when(way == 1, F.lit("")).when(way == 2, F.translate(text_of("text"), ".!?", "")).otherwise(text_of("text"))
    role = F.when(way == 4, F.lit("user")).otherwise(text_of("role"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (way == 0).alias("gone"), F.when(way == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"))
    return rows.select("conv_id", "turn", "role", "text", "gone", F.explode("copies").alias("copy")).drop("copy")


def as_turns(turns: DataFrame) -> DataFrame:
    """``turns`` as ``repair`` takes them, undamaged."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return turns.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), F.lit(False).alias("gone"))


def _fault(role: str, text: str, seen: set) -> int:
    """The first fault of a turn; ``seen`` holds the conversation's turns before it."""
    bare = text.strip(SPACE)
    known = (role, text) in seen
    seen.add((role, text))
    return BLANK if not bare else DUPLICATE if known else SOUND if bare[-1] in ".!?" else CUT


@lru_cache(maxsize=1 << 16)
def step(after: tuple[int, ...], initial: str, fault: int):
    """Costs before a turn from those ``after`` it (less their least, and that least), and for each state the walk over the turn.

    A walk is (letters, state behind it, roles inserted before the turn, role of the turn: None if
    deleted, '' if kept); None where no walk leads anywhere.
    """
    if fault == GONE:
        return after, 0, tuple(("", q, (), None) for q in range(4))
    extra = TRUNCATED if fault == CUT else 0

    def own(q: int) -> list[tuple[int, str, int, str | None]]:
        out = [(DELETE, "D", q, None)]
        if fault in (SOUND, CUT):
            if initial in LEGAL[q]:
                out.append((extra, "K", LEGAL[q][initial], ""))
            out.append((REROLE + extra, "R", *NEXT[q]))
        return out

    here = [min(cost + after[r] for cost, _, r, _ in own(q)) for q in range(4)]
    ways = [q1 for q1, _ in NEXT]
    # two insertions come back to the kind of state where they began, so more never help
    costs = [min(here[q], INSERT + here[ways[q]], 2 * INSERT + here[ways[ways[q]]], FAR) for q in range(4)]
    walks: list = []
    for start in range(4):
        q, letters, added = start, "", []
        while costs[start] < FAR:
            tight = [("I", None)] if costs[q] == INSERT + costs[ways[q]] else []
            tight += [(letter, (r, role)) for cost, letter, r, role in own(q) if cost + after[r] == costs[q]]
            letter, move = min(tight, key=lambda t: t[0])
            letters += letter
            if move is None:
                added.append(NEXT[q][1])
                q = ways[q]
                continue
            walks.append((letters, move[0], tuple(added), move[1]))
            break
        else:
            walks.append(None)
    least = min(costs)
    return tuple(min(c - least, FAR) if c < FAR else FAR for c in costs), least, tuple(walks)


def symbol(role: str, fault: int) -> tuple[str, int]:
    """What a turn is to the grammar."""
    return (role[:1] if fault in (SOUND, CUT) and role[:1] in "sua" else "-"), fault


def backward(symbols: list[tuple[str, int]], after: tuple[int, ...]) -> tuple[list[int], list]:
    """Costs before all turns, and each turn's walks, from the costs after them."""
    least = min(after)
    now, total, walks = tuple(c - least if c < FAR else FAR for c in after), least, []
    for symbol in reversed(symbols):
        now, more, walk = step(now, *symbol)
        total += more
        walks.append(walk)
    return [total + c if c < FAR else FAR for c in now], walks[::-1]


def closing(state: int) -> tuple[str, list[str]]:
    """Letters and roles of the turns inserted after the last one."""
    letters, roles = "", []
    while state not in ACCEPTED:
        state, role = NEXT[state]
        letters, roles = letters + "I", [*roles, role]
    return letters, roles


def forward(rows: list[tuple[str, str]], walks: list, state: int, last: bool) -> tuple[str, list[str], int]:
    """Letters, repaired turns (``role:text``) and the state behind them; with ``last`` the conversation is closed."""
    letters, out = [], []
    for (role, text), walk in zip(rows, walks, strict=True):
        some, state, added, own = walk[state]
        letters.append(some)
        out += [f"{r}:" for r in added]
        if own is not None:
            out.append(f"{own or role}:{text}")
    if last:
        some, roles = closing(state)
        letters.append(some)
        out += [f"{r}:" for r in roles]
    return "".join(letters), out, state


_COUNTS = ("blank", "duplicate", "truncated", "illegal")


def _counts(rows: list[tuple[int | None, str, str, bool]], faults: list[int]) -> dict:
    """Counts over a run of turns, and what is needed to add them to those of the next run."""
    there = [(t, role[:1]) for (t, role, _, _), f in zip(rows, faults, strict=True) if f != GONE]
    turns = [t for t, _ in there if t is not None]
    return {
        "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT),
        "illegal": sum(a + b not in ("su", "ua", "au") for (_, a), (_, b) in zip(there, there[1:])),
        "first": there[0][1] if there else None, "last": there[-1][1] if there else None,
        "least": turns[0] if turns else None, "most": turns[-1] if turns else None, "turns": sum(a != b for a, b in zip(turns, turns[1:])) + 1 if turns else 0,
    }


def _whole(rows: list[tuple[int | None, str, str, bool]]) -> dict:
    """The result of a conversation whose turns are all here."""
    seen: set = set()
    faults = [GONE if gone else _fault(role, text, seen) for _, role, text, gone in rows]
    costs, walks = backward([symbol(role, f) for (_, role, _, _), f in zip(rows, faults, strict=True)], END)
    letters, out, _ = forward([(role, text) for _, role, text, _ in rows], walks, 0, True)
    c = _counts(rows, faults)
    gaps = c["most"] - c["least"] + 1 - c["turns"] if c["turns"] else 0
    return {"gaps": gaps, **{k: c[k] for k in _COUNTS}, "cost": costs[0], "audit": letters, "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest()}


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_RESULT_TYPES = [(f.split()[0], pa.int64() if f.endswith("long") else pa.string()) for f in _RESULT.split(", ")]
#: Rows handed on at once.
BATCH = 4096


def _ranges(kind: str):
    """A task over one sorted range: results of the conversations that lie inside it, turns of the first and the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId()
        ids, results, cut, held, number, id_type = [], [], [], [], 0, None
        conv, there, first = None, False, True

        def out() -> pa.RecordBatch:
            n, m = len(ids), len(cut)
            result = [pa.array([r[name] for r in results], t) for name, t in _RESULT_TYPES]
            columns = {"conv_id": pa.concat_arrays([pa.array(ids, id_type), pa.array([c[0] for c in cut], id_type)])}
            columns |= {name: pa.concat_arrays([a, pa.nulls(m, t)]) for (name, t), a in zip(_RESULT_TYPES, result, strict=True)}
            own = (("block", pa.int64()), ("at", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("gone", pa.bool_()))
            columns |= {name: pa.concat_arrays([pa.nulls(n, t), pa.array([c[i + 1] for c in cut], t)]) for i, (name, t) in enumerate(own)}
            ids.clear(), results.clear(), cut.clear()
            return pa.record_batch(columns)

        for batch in batches:
            id_type = batch.column(0).type
            who, turns, roles, texts, gone = (batch.column(i).to_pylist() for i in range(5))
            for c, *row in zip(who, turns, roles, texts, gone, strict=True):
                if there and c != conv:
                    if not first:
                        ids.append(conv), results.append(_whole(held))
                    held, first = [], False
                conv, there = c, True
                row[2] = row[2] or ""
                if first:  # may have begun in an earlier range, so nothing is gained by holding it
                    cut.append((c, block, number, *row))
                    number += 1
                else:
                    held.append(row)
                if len(ids) + len(cut) >= BATCH:
                    yield out()
        for row in held:  # may go on in a later range
            cut.append((conv, block, number, *row))
            number += 1
            if len(cut) >= BATCH:
                yield out()
        if there:
            yield out()

    return run, f"conv_id {kind}, {_RESULT}, block long, at long, turn long, role string, text string, gone boolean"


def _blocks(pieces: DataFrame, kind: str) -> DataFrame:
    """conv_id, block, at, turn, role, text, fault: the turns of divided conversations, written."""
    key = [F.xxhash64("text"), F.xxhash64(F.lit(13), F.col("text"))]
    rows = pieces.withColumns({"_h1": key[0], "_h2": key[1]})
    place = F.struct("block", "at")
    again = rows.where("not gone").groupBy("conv_id", "role", "_h1", "_h2").agg(F.count("*").alias("_n"), F.min(place).alias("_first")).where("_n > 1")
    both = rows.alias("a").join(
        again.alias("b"), F.expr("a.conv_id <=> b.conv_id and a.role = b.role and a._h1 = b._h1 and a._h2 = b._h2"), "left"
    )
    bare = F.btrim(F.col("a.text"), F.lit(SPACE))
    fault = F.when(F.col("a.gone"), GONE).when(bare == "", BLANK).when(F.col("b._first").isNotNull() & (F.struct("a.block", "a.at") != F.col("b._first")), DUPLICATE)
    fault = fault.when(F.substring(bare, -1, 1).isin(".", "!", "?"), SOUND).otherwise(CUT)
    return stored(both.select(*[F.col(f"a.{c}").alias(c) for c in ("conv_id", "block", "at", "turn", "role", "text")], fault.cast("int").alias("fault")), "turn_blocks")


def _by_conversation(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.sort_values("block")


def _divided(pieces: DataFrame, kind: str) -> DataFrame:
    """Results of the conversations that lie in several ranges (or at the edge of one)."""
    rows = _blocks(pieces, kind)
    matrix = ", ".join(f"m{q}{r} long" for q in range(4) for r in range(4))

    def symbols(group: pd.DataFrame) -> list[tuple[str, int]]:
        return [symbol(r, f) for r, f in zip(group["role"], group["fault"].tolist(), strict=True)]

    def whole_number(v) -> int | None:
        return None if v is None or pd.isna(v) else int(v)

    def measured(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        faults = group["fault"].tolist()
        c = _counts([(whole_number(t), r, "", False) for t, r in zip(group["turn"], group["role"], strict=True)], faults)
        columns = [backward(symbols(group), _TO[r])[0] for r in range(4)]
        cells = {f"m{q}{r}": columns[r][q] for q in range(4) for r in range(4)}
        return pd.DataFrame([{"conv_id": group["conv_id"].iloc[0], "block": group["block"].iloc[0], **c, **cells}])

    counts = "blank long, duplicate long, truncated long, illegal long, first string, last string, least long, most long, turns long"
    narrow = rows.select("conv_id", "block", "at", "turn", F.substring("role", 1, 1).alias("role"), "fault")
    blocks = stored(narrow.groupBy("conv_id", "block").applyInPandas(measured, f"conv_id {kind}, block long, {counts}, {matrix}"), "blocks")

    def behind(group: pd.DataFrame) -> pd.DataFrame:
        """The costs behind each block, from the last block back."""
        group, after, out = _by_conversation(group), list(END), []
        for r in group.iloc[::-1].to_dict("records"):
            out.append((r["conv_id"], r["block"], list(after), len(out) == 0))
            after = [min(FAR, *(r[f"m{q}{p}"] + after[p] for p in range(4))) for q in range(4)]
        return pd.DataFrame(out, columns=["conv_id", "block", "after", "is_last"])

    costs = blocks.groupBy("conv_id").applyInPandas(behind, f"conv_id {kind}, block long, after array<long>, is_last boolean")
    costs = stored(costs, "costs_behind")
    same = lambda left, right: left.alias("a").join(right.alias("b"), F.expr("a.conv_id <=> b.conv_id and a.block = b.block")).select("a.*", *[f"b.{c}" for c in right.columns if c not in ("conv_id", "block")])

    def ends(group: pd.DataFrame) -> pd.DataFrame:
        """Where a block ends, for each state where it may start."""
        group = group.sort_values("at")
        _, walks = backward(symbols(group), tuple(int(c) for c in group["after"].iloc[0]))
        out = list(range(4))
        for walk in walks:
            out = [-1 if q < 0 or walk[q] is None else walk[q][1] for q in out]
        return pd.DataFrame([{"conv_id": group["conv_id"].iloc[0], "block": group["block"].iloc[0], "ends": out}])

    leads = same(narrow, costs).groupBy("conv_id", "block").applyInPandas(ends, f"conv_id {kind}, block long, ends array<int>")

    def fixed(group: pd.DataFrame) -> pd.DataFrame:
        """The state where each block starts."""
        state, out = 0, []
        for r in _by_conversation(group).to_dict("records"):
            out.append((r["conv_id"], r["block"], state, list(r["after"]), r["is_last"]))
            state = int(r["ends"][state])
        return pd.DataFrame(out, columns=["conv_id", "block", "state", "after", "is_last"])

    starts = stored(same(leads, costs).groupBy("conv_id").applyInPandas(fixed, f"conv_id {kind}, block long, state int, after array<long>, is_last boolean"), "starts")

    def mended(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        head = group.iloc[0]
        _, walks = backward(symbols(group), tuple(int(c) for c in head["after"]))
        letters, out, _ = forward(list(zip(group["role"], group["text"].fillna(""), strict=True)), walks, int(head["state"]), bool(head["is_last"]))
        return pd.DataFrame([{"conv_id": head["conv_id"], "block": head["block"], "audit": letters, "n": len(out), "body": "\n".join(out)}])

    parts = stored(same(rows, starts).groupBy("conv_id", "block").applyInPandas(mended, f"conv_id {kind}, block long, audit string, n long, body string"), "mended_blocks")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A running digest for each conversation over its blocks in order."""
        conv, held, some, there, id_type = None, hashlib.sha256(), False, False, None
        for batch in batches:
            id_type = batch.column(0).type
            for c, n, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if there and c != conv:
                    yield pa.record_batch({"conv_id": pa.array([conv], id_type), "repaired_sha256": [held.hexdigest()]})
                    held, some = hashlib.sha256(), False
                conv, there = c, True
                if n:
                    held.update((("\n" if some else "") + body).encode())
                    some = True
        if there:
            yield pa.record_batch({"conv_id": pa.array([conv], id_type), "repaired_sha256": [held.hexdigest()]})

    hashes = parts.select("conv_id", "n", "body", "block").repartition("conv_id").sortWithinPartitions("conv_id", "block").select("conv_id", "n", "body").mapInArrow(digests, f"conv_id {kind}, repaired_sha256 string")
    audits = parts.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "audit"))), lambda p: p["audit"]), "").alias("audit"))

    def added(group: pd.DataFrame) -> pd.DataFrame:
        """A conversation's counts and cost from its blocks'."""
        blocks, costs = _by_conversation(group).to_dict("records"), list(END)
        for r in reversed(blocks):
            costs = [min(FAR, *(r[f"m{q}{p}"] + costs[p] for p in range(4))) for q in range(4)]
        total = {c: sum(int(r[c]) for r in blocks) for c in _COUNTS}
        there = [r for r in blocks if r["first"] is not None]
        total["illegal"] += sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(there, there[1:]))
        numbered = [r for r in blocks if int(r["turns"])]
        turns = sum(int(r["turns"]) for r in numbered) - sum(int(a["most"]) == int(b["least"]) for a, b in zip(numbered, numbered[1:]))
        gaps = int(numbered[-1]["most"]) - int(numbered[0]["least"]) + 1 - turns if numbered else 0
        return pd.DataFrame([{"conv_id": blocks[0]["conv_id"], "gaps": gaps, **total, "cost": costs[0]}])

    sums = blocks.groupBy("conv_id").applyInPandas(added, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long")
    one = lambda left, right, c: left.alias("a").join(right.alias("b"), F.expr("a.conv_id <=> b.conv_id")).select("a.*", f"b.{c}")
    return one(one(sums, audits, "audit"), hashes, "repaired_sha256")


def repair(turns: DataFrame) -> DataFrame:
    """A row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. ``turns`` as ``damaged`` or ``as_turns`` gives them."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    # a row's number tells identical turns apart, so that a range can end between them
    rows = turns.withColumns({"turn": F.col("turn").cast("long"), "_row": F.monotonically_increasing_id(), "_text": F.md5(F.coalesce("text", F.lit("")))})
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("_text"), F.col("_row")]
    run, shape = _ranges(kind)
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "gone").mapInArrow(run, shape)
    dealt = stored(dealt, "repaired")
    names = [name for name, _ in _RESULT_TYPES]
    done = dealt.where("block is null").select("conv_id", *names)
    return done.unionByName(_divided(dealt.where("block is not null").drop(*names), kind).select("conv_id", *names))


def query(spark, sf_dir: str) -> DataFrame:
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")))


def _sql() -> str:
    """Costs and ASCII-least edits from the last turn back, a recursion per conversation; the CRC-32 over a table made by its rule."""
    moves = []
    for q in range(4):
        t, name = NEXT[q]
        kept = " ".join(f"WHEN '{i}' THEN {r + 1}" for i, r in LEGAL[q].items())
        own = f"""least({{'c': 4 + j[{q + 1}].c, 'e': 'D' || j[{q + 1}].e, 'o': j[{q + 1}].o}},
      CASE WHEN fault < 2 THEN {{'c': 3 + x + j[{t + 1}].c, 'e': 'R' || j[{t + 1}].e, 'o': list_prepend('{name}:' || text, j[{t + 1}].o)}} END,
      CASE WHEN fault < 2 AND (CASE init {kept} END) IS NOT NULL THEN {{'c': x + j[CASE init {kept} END].c, 'e': 'K' || j[CASE init {kept} END].e, 'o': list_prepend(role || ':' || text, j[CASE init {kept} END].o)}} END)"""
        moves.append(own)
    add = lambda b, q: f"{{'c': 3 + {b}[{NEXT[q][0] + 1}].c, 'e': 'I' || {b}[{NEXT[q][0] + 1}].e, 'o': list_prepend('{NEXT[q][1]}:', {b}[{NEXT[q][0] + 1}].o)}}"
    relaxed = lambda b: "[" + ", ".join(f"least({b}[{q + 1}], {add(b, q)})" for q in range(4)) + "]"
    none = "CAST([] AS VARCHAR[])"
    end = "[" + ", ".join(f"{{'c': {c}, 'e': '{e}', 'o': {o}}}" for c, e, o in ((0, "", none), (6, "II", "['user:', 'assistant:']"), (3, "I", "['assistant:']"), (0, "", none))) + "]"
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE bits AS (
  SELECT i, 0 AS k, i AS v FROM (SELECT unnest(range(256)) AS i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8
), tbl AS (SELECT list(v ORDER BY i) AS l FROM bits WHERE k = 8
), raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations
), crc AS (
  SELECT raw.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(s, ''), lambda c: CAST(unicode(c) AS BIGINT))),
    lambda a, b: xor(a >> 8, tbl.l[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS way FROM raw, tbl
), dam AS (
  SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role,
    CASE way WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE way WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM crc WHERE way <> 0
), ord AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS k FROM dam
), num AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS again, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) || left(role, 1) AS pair, trim(text, {white}) AS bare FROM ord
), flt AS (
  SELECT *, left(role, 1) AS init, CASE WHEN bare = '' THEN 2 WHEN again > 1 THEN 3 WHEN right(bare, 1) IN ('.', '!', '?') THEN 0 ELSE 1 END AS fault, count(*) OVER (PARTITION BY conv_id) AS n FROM num
), dp AS (
  SELECT conv_id, CAST(n AS BIGINT) AS k, CAST({end} AS STRUCT(c BIGINT, e VARCHAR, o VARCHAR[])[]) AS j FROM (SELECT DISTINCT conv_id, n FROM flt)
  UNION ALL
  SELECT conv_id, k, {relaxed("b")} FROM (SELECT conv_id, k, {relaxed("b")} AS b FROM (
    SELECT dp.conv_id, dp.k - 1 AS k, [{", ".join(moves)}] AS b
    FROM (SELECT f.*, CASE f.fault WHEN 1 THEN 3 ELSE 0 END AS x, d.j FROM dp d JOIN flt f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.k = d.k) AS dp))
), best AS (SELECT conv_id, j[1] AS b FROM dp WHERE k = 0
), cnt AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 2) AS blank, count(*) FILTER (fault = 3) AS duplicate,
    count(*) FILTER (fault = 1) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM flt GROUP BY conv_id
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.e, '') AS audit, sha256(coalesce(array_to_string(b.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN cnt ON cnt.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id
"""


SQL = _sql()
