"""Conversation structure repair: the cheapest edits that give a conversation the grammar `(s?(ua)+)?` over its roles' initials.

Nodes of the lattice are (turn index, grammar state); a turn is kept, given another role or deleted, which leads to the next index, and an
empty turn can be inserted, which leads to another state of the same index. Dijkstra's search over it, never written out, settles nodes
by (cost, audit), the audit being the edits' initials so far, and stops at the first settled accepting end node.

The key is sound: a cost is at least 0 and an audit only grows. Two audits that lead to one node have a letter other than I for each
turn, so that one can only begin with the other if it has fewer insertions after the same edits, and then their costs differ: of two
audits of equal cost the lesser stays the lesser whatever follows.

A conversation may hold any share of all turns. Turns are sorted in ranges of (conversation, turn) and cut into chunks of bounded rows.
Where a conversation runs over the edge of a chunk, the search runs from each state at the one edge to every state at the other; the
least keys over neighbouring chunks are combined by twos. Edits go back to the chunks, so turns of one conversation are repaired
in many tasks. Only a hash over a whole conversation, which is one sequence by its nature, is one task's, and streams.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgefield.llm._common import forget, lean, parts, whole_groups, written

CHUNK_BITS = 9  # 512 turns in a chunk
GRAMMAR = "(s?(ua)+)?"
INSERT, DELETE, REROLE, TRUNCATED = 5, 2, 1, 5  # costs; keeping costs 0, and a truncated turn that stays costs more
_START, _SYSTEM, _USER, _ASSISTANT = range(4)  # states: what the last role was
_ACCEPTING = (_START, _ASSISTANT)
_SPACE = r"\x20\x09-\x0D"
NO_FAULT, BLANK, DUPLICATE, CUT = range(4)


class Turn(NamedTuple):
    initial: str
    fault: int


def _next(state: int) -> int:
    """The state after the one role that can be inserted or set here: a user's turn, or an assistant's after it."""
    return _ASSISTANT if state == _USER else _USER


def _kept(state: int, initial: str) -> int | None:
    if initial == "s" and state == _START:
        return _SYSTEM
    if initial == ("a" if state == _USER else "u"):
        return _next(state)
    return None


def cheapest(turns: list[Turn], start: int = _START, whole: bool = True) -> dict[int, tuple[int, str]]:
    """(cost, audit) of the cheapest edits from a state before the turns to states after them.

    whole: the search stops at the first settled accepting end node, the only one in the answer; otherwise all four states are settled
    that can be reached."""
    heap: list[tuple[int, str, int, int]] = [(0, "", 0, start)]
    settled: set[tuple[int, int]] = set()
    found: dict[int, tuple[int, str]] = {}
    n = len(turns)
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in settled:
            continue
        settled.add((i, state))
        if i == n:
            if not whole:
                found[state] = (cost, audit)
            elif state in _ACCEPTING:
                return {state: (cost, audit)}
        then = _next(state)
        if (i, then) not in settled:
            heapq.heappush(heap, (cost + INSERT, audit + "I", i, then))
        if i < n:
            initial, fault = turns[i]
            heapq.heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
            if fault not in (BLANK, DUPLICATE):
                stays = cost + (TRUNCATED if fault == CUT else 0)
                kept = _kept(state, initial)
                if kept is not None:
                    heapq.heappush(heap, (stays, audit + "K", i + 1, kept))
                heapq.heappush(heap, (stays + REROLE, audit + "R", i + 1, then))
    return found


def _joined(left: list, right: list) -> list:
    """Tables from state to state of two neighbouring stretches, as one: the least (cost, audit) over the states between."""
    out = []
    for x in range(4):
        for y in range(4):
            both = [(left[4 * x + k][0] + right[4 * k + y][0], left[4 * x + k][1] + right[4 * k + y][1]) for k in range(4) if left[4 * x + k] and right[4 * k + y]]
            out.append(min(both, default=None))
    return out


def damaged(turns: DataFrame) -> DataFrame:
    """A stated damage to try the repair on: crc32 of `conv_id:turn`, by 20, drops a turn (0), empties its text (1), takes its `[.!?]`
    away (2), repeats it (3) or makes it the user's (4). Nulls of role and text become one space, as those of the ids do in the checksum.

    conv_id and turn stay as they are; other columns go. No rows give no rows."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.col("_kind")
    rows = turns.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")], F.pmod(F.crc32(F.concat_ws(":", *named).cast("binary")), F.lit(20)).alias("_kind"))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))
    return rows.drop("_copy")


def _ordered(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and at, which rises in the order of (conv_id, turn, role, text), nulls first; written.

    Turns that agree in all four may be any number: a last key that is each row's own parts them among ranges."""
    rows = turns.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]).withColumn("_tie", F.monotonically_increasing_id())
    by = ["conv_id", "turn", "role", "text", "_tie"]
    ranges = rows.repartitionByRange(parts(turns.sparkSession), *by).sortWithinPartitions(*by).drop("_tie")
    return written(ranges.withColumn("at", F.monotonically_increasing_id()), "turns")


def _chunk() -> Column:
    return F.shiftright("at", CHUNK_BITS)


def _faulty(ordered: DataFrame) -> DataFrame:
    """conv_id, at, chunk, initial and the first fault of each turn."""
    blank = ~F.col("text").rlike(f"[^{_SPACE}]")
    same = F.unhex(F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    rows = ordered.select("conv_id", "at", _chunk().alias("chunk"), F.substring("role", 1, 1).alias("initial"), blank.alias("_blank"), (~F.col("text").rlike(rf"[.!?][{_SPACE}]*\z")).alias("_cut"), same.alias("_same"))
    rows = written(rows, "flags")
    again = rows.where("NOT _blank").groupBy("_same").agg(F.min("at").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    fault = F.when(F.col("_blank"), BLANK).when(F.col("at") > F.col("_first"), DUPLICATE).when(F.col("_cut"), CUT).otherwise(NO_FAULT)
    out = rows.join(again, "_same", "left").select("conv_id", "at", "chunk", "initial", fault.cast("int").alias("fault"))
    out._written_path = rows._written_path
    return out


_LEGAL = {"su", "ua", "au"}


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the turns of chunks: a row for each conversation in a chunk, with what its turns count and the tables from state to state."""
    for table in whole_groups(batches, "chunk"):
        names = ("chunk", "conv_id", "at", "initial", "fault")
        rows = list(zip(*[table.column(c).to_pylist() for c in names]))
        starts = [k for k, r in enumerate(rows) if not k or r[:2] != rows[k - 1][:2]]
        out: dict[str, list] = {c: [] for c in ("conv_id", "chunk", "first_at", "n", "blank", "duplicate", "truncated", "illegal", "initials", "costs", "audits")}
        for lo, hi in zip(starts, [*starts[1:], len(rows)]):
            chunk, conv_id, first_at = rows[lo][:3]
            turns = [Turn(*r[3:]) for r in rows[lo:hi]]
            opens = lo > 0 and rows[lo - 1][0] == chunk  # another conversation stands before it in its chunk
            ends = hi < len(rows) and rows[hi][0] == chunk
            keys: list = [None] * 16
            for start in (_START,) if opens else range(4):
                for end, key in cheapest(turns, start, whole=opens and ends).items():
                    keys[4 * start + end] = key
            faults = [t.fault for t in turns]
            illegal = sum(a.initial + b.initial not in _LEGAL for a, b in zip(turns, turns[1:]))
            values = (conv_id, chunk, first_at, len(turns), faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), illegal, [turns[0].initial, turns[-1].initial], [k and k[0] for k in keys], [k and k[1] for k in keys])
            for column, value in zip(out.values(), values):
                column.append(value)
        longs = ("chunk", "first_at", "n", "blank", "duplicate", "truncated", "illegal")
        kinds = {c: pa.int64() for c in longs} | {"conv_id": table.schema.field("conv_id").type, "initials": pa.list_(pa.string()), "costs": pa.list_(pa.int64()), "audits": pa.list_(pa.string())}
        yield pa.RecordBatch.from_pydict({c: pa.array(v, kinds[c]) for c, v in out.items()})


def _cut(audit: str, sizes: list[int]) -> list[str]:
    """The audit's share of each stretch: up to the edit of its last turn; the last stretch takes what is left."""
    out, at = [], 0
    for size in sizes[:-1]:
        lo = at
        while size:
            size -= audit[at] != "I"
            at += 1
        out.append(audit[lo:at])
    return [*out, audit[at:]]


def _planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the stretches of conversations: the edits of each stretch, and on a conversation's first one what the conversation comes to."""
    for table in whole_groups(batches, "conv_id"):
        rows = table.to_pylist()
        starts = [k for k, r in enumerate(rows) if not k or r["conv_id"] != rows[k - 1]["conv_id"]]
        out: dict[str, list] = {c: [] for c in ("conv_id", "chunk", "first_at", "n", "edits", "before", "system", "first", "blank", "duplicate", "truncated", "illegal", "cost", "audit")}
        for lo, hi in zip(starts, [*starts[1:], len(rows)]):
            group = rows[lo:hi]
            tables = [[c is not None and (c, a) or None for c, a in zip(r["costs"], r["audits"])] for r in group]
            while len(tables) > 1:
                tables = [_joined(*pair) if len(pair) == 2 else pair[0] for pair in (tables[k : k + 2] for k in range(0, len(tables), 2))]
            cost, audit = min(tables[0][end] for end in _ACCEPTING if tables[0][end])
            illegal = sum(r["illegal"] for r in group) + sum(a["initials"][1] + b["initials"][0] not in _LEGAL for a, b in zip(group, group[1:]))
            system = (len(audit) - audit.count("D")) % 2 == 1  # u and a come in pairs
            before = 0
            for k, (r, edits) in enumerate(zip(group, _cut(audit, [r["n"] for r in group]))):
                sums = [sum(x[c] for x in group) for c in ("blank", "duplicate", "truncated")] if not k else [0, 0, 0]
                values = (r["conv_id"], r["chunk"], r["first_at"], r["n"], edits, before, system, not k, *sums, 0 if k else illegal, 0 if k else cost, None if k else audit)
                for column, value in zip(out.values(), values):
                    column.append(value)
                before += len(edits) - edits.count("D")
        kinds = {c: pa.int64() for c in out} | {"conv_id": table.schema.field("conv_id").type, "edits": pa.string(), "audit": pa.string(), "system": pa.bool_(), "first": pa.bool_()}
        yield pa.RecordBatch.from_pydict({c: pa.array(v, kinds[c]) for c, v in out.items()})


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns of a stretch after a row that has its edits, as repaired turns; a batch at a time, whatever a stretch comes to in bytes."""
    edits, at, left, position, system, conv_id = "", 0, 0, 0, False, None
    for batch in batches:
        rows: list[tuple] = []

        def inserted() -> None:
            nonlocal at, position
            while at < len(edits) and edits[at] == "I":
                rows.append((conv_id, position, None, "I", ("user", "assistant")[(position - system) % 2], ""))
                position += 1
                at += 1

        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "edits", "n", "before", "system")]
        for conv, turn, role, text, plan, n, before, has_system in zip(*columns):
            if plan is not None:
                edits, at, left, position, system, conv_id = plan, 0, n, before, int(has_system), conv
                continue
            inserted()
            edit = edits[at]
            at += 1
            left -= 1
            if edit == "D":
                rows.append((conv, None, turn, "D", role, text))
            else:
                rows.append((conv, position, turn, edit, role if edit == "K" else ("user", "assistant")[(position - system) % 2], text))
                position += 1
            if not left:
                inserted()
        columns = list(zip(*rows)) if rows else [[]] * 6
        kinds = (batch.schema.field("conv_id").type, pa.int64(), batch.schema.field("turn").type, pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_pydict({c: pa.array(v, kind) for c, v, kind in zip(("conv_id", "position", "turn", "edit", "role", "text"), columns, kinds)})


class Repair(NamedTuple):
    """turns: conv_id, position, turn, edit, role, text. One row for each turn, an inserted one too (no turn), and a deleted one (no
    position). summary: conv_id, blank, duplicate, truncated, illegal, gaps, cost, audit; a row for each conversation that has turns."""

    turns: DataFrame
    summary: DataFrame


def repaired(turns: DataFrame) -> Repair:
    """turns: conv_id, turn, role, text; others are not looked at. A conversation's turns are taken in the order of turn, nulls first, and
    of role and text where turns share it.

    A null role or text is one space, and a turn whose role has no known initial is given a role or deleted. Turns without a conv_id
    are one conversation. Repeated rows are duplicates, all but the first. Empty texts are blank. A text of any length is held with the
    batch it is in only. An audit is one value, so a conversation's edits, a byte for each turn, are held in one task, sixteen times at worst
    while they are chosen. No rows give no rows."""
    spark = turns.sparkSession
    n = parts(spark)
    kinds = dict(turns.dtypes)
    key = f"conv_id {kinds['conv_id']}"
    ordered = _ordered(turns)
    faulty = _faulty(ordered)
    schema = f"{key}, chunk long, first_at long, n long, blank long, duplicate long, truncated long, illegal long, initials array<string>, costs array<long>, audits array<string>"
    stretches = written(faulty.repartition(n, "chunk").sortWithinPartitions("chunk", "at").mapInArrow(lean(_stretches), schema), "stretches")
    forget(faulty)
    schema = f"{key}, chunk long, first_at long, n long, edits string, before long, system boolean, first boolean, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    plans = written(stretches.repartition(n, "conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(lean(_planned), schema), "plans")
    forget(stretches)
    nothing = lambda kind: F.lit(None).cast(kind)
    heads = plans.select("chunk", F.col("first_at").alias("at"), F.lit(0).alias("_row"), "conv_id", nothing(kinds["turn"]).alias("turn"), nothing("string").alias("role"), nothing("string").alias("text"), "edits", "n", "before", "system")
    rows = ordered.select(_chunk().alias("chunk"), "at", F.lit(1).alias("_row"), "conv_id", "turn", "role", "text", nothing("string").alias("edits"), nothing("long").alias("n"), nothing("long").alias("before"), nothing("boolean").alias("system"))
    edited = heads.union(rows).repartition(n, "chunk").sortWithinPartitions("chunk", "at", "_row").mapInArrow(lean(_edited), f"{key}, position long, turn {kinds['turn']}, edit string, role string, text string")
    counted = ordered.groupBy("conv_id").agg(F.min("turn").alias("_lo"), F.max("turn").alias("_hi"), F.count_distinct("turn").alias("_n"))
    gaps = counted.select("conv_id", F.coalesce(F.col("_hi") - F.col("_lo") + 1 - F.col("_n"), F.lit(0)).cast("long").alias("gaps"))
    same = gaps["conv_id"].eqNullSafe(plans["conv_id"])
    summary = plans.where("first").join(gaps, same).select(plans["conv_id"], "blank", "duplicate", "truncated", "illegal", "gaps", "cost", "audit")
    return Repair(edited, summary)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's `role:text` lines, joined by newlines, from turns in order; nothing but the hash is held."""
    of, state = None, None
    for batch in batches:
        done: list[tuple] = []
        for conv_id, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "text")]):
            if state is not None and conv_id == of:
                state.update(b"\n")
            else:
                if state is not None:
                    done.append((of, state.hexdigest()))
                of, state = conv_id, hashlib.sha256()
            state.update(f"{role}:{text}".encode())
        kind = batch.schema.field("conv_id").type
        yield pa.RecordBatch.from_pydict({"conv_id": pa.array([d[0] for d in done], kind), "repaired_sha256": pa.array([d[1] for d in done], pa.string())})
    if state is not None:
        yield pa.RecordBatch.from_pydict({"conv_id": pa.array([of], kind), "repaired_sha256": pa.array([state.hexdigest()], pa.string())})


def digests(original: DataFrame, repair: Repair) -> DataFrame:
    """A row for each conv_id of the original turns: counts of faults, cost, audit and the hash of the repaired conversation.

    Those that have no turns left to repair get zeros, the empty audit and the hash of nothing."""
    n = parts(original.sparkSession)
    there = repair.turns.where("edit != 'D'").select("conv_id", "position", "role", "text")
    key = f"conv_id {dict(original.dtypes)['conv_id']}"
    hashes = there.repartition(n, "conv_id").sortWithinPartitions("conv_id", "position").mapInArrow(lean(_hashed), f"{key}, repaired_sha256 string")
    ids = original.select("conv_id").distinct()
    out = ids.join(repair.summary.withColumnRenamed("conv_id", "_s"), F.col("conv_id").eqNullSafe(F.col("_s")), "left").drop("_s")
    out = out.join(hashes.withColumnRenamed("conv_id", "_h"), F.col("conv_id").eqNullSafe(F.col("_h")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def _oracle() -> str:
    """The damage and the repair of `conversations` as DuckDB SQL: least keys by state (cost in eight digits, then the audit), turn by turn."""
    table = []
    for i in range(16):
        for _ in range(4):
            i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    half = lambda c: f"xor({c} >> 4, {table}[1 + ({c} & 15)])"
    step = lambda k, cost, letter: f"printf('%08d', substr({k}, 1, 8)::INT + {cost}) || substr({k}, 9) || '{letter}'"
    # two insertions at most are of use before a turn or at the end: user and assistant
    once = {2: f"least(k2, {step('least(k0, k1, k3)', 5, 'I')})", 3: f"least(k3, {step('k2', 5, 'I')})"}
    twice = {2: f"least(k2, {step('k3', 5, 'I')})", 3: f"least(k3, {step('k2', 5, 'I')})"}
    stays = "(CASE WHEN fault = 3 THEN 5 ELSE 0 END)"
    may = "fault NOT IN (1, 2)"
    keep = lambda k, initial: f"CASE WHEN {may} AND ini = '{initial}' THEN {step(k, stays, 'K')} END"
    role = lambda k: f"CASE WHEN {may} THEN {step(k, f'1 + {stays}', 'R')} END"
    before = "least(k0, k1, k3)"
    return rf"""
WITH RECURSIVE z AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
       list_transform(regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'), lambda p: ('0x' || p)::BIGINT) AS b FROM conversations),
y AS (SELECT * EXCLUDE b, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: {half(half("xor(c, x)"))}), 4294967295) % 20 AS kind FROM z),
x AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM y WHERE kind != 0),
w AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
             NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut FROM x),
v AS (SELECT conv_id, turn, role, text, i, substr(role, 1, 1) AS ini, CASE WHEN blank THEN 1 WHEN again THEN 2 WHEN cut THEN 3 ELSE 0 END AS fault FROM w),
n AS (SELECT conv_id, count(*) AS n, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
             coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM v GROUP BY conv_id),
il AS (SELECT conv_id, count(*) AS illegal FROM (SELECT conv_id, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS p, i FROM v) WHERE i > 1 AND p NOT IN ('su', 'ua', 'au') GROUP BY conv_id),
d AS (SELECT conv_id, 0::BIGINT AS i, '00000000' AS k0, NULL::VARCHAR AS k1, NULL::VARCHAR AS k2, NULL::VARCHAR AS k3 FROM n
      UNION ALL
      SELECT conv_id, i, {step('k0', 2, 'D')},
             least({step('k1', 2, 'D')}, {keep('k0', 's')}),
             least({step('k2', 2, 'D')}, {keep(before, 'u')}, {role(before)}),
             least({step('k3', 2, 'D')}, {keep('k2', 'a')}, {role('k2')})
      FROM (SELECT conv_id, i, ini, fault, k0, k1, {twice[2]} AS k2, k3 FROM (SELECT conv_id, i, ini, fault, k0, k1, k2, {once[3]} AS k3 FROM (
            SELECT d.conv_id, v.i, v.ini, v.fault, k0, k1, {once[2]} AS k2, k3 FROM d JOIN v ON v.conv_id IS NOT DISTINCT FROM d.conv_id AND v.i = d.i + 1)))),
e AS (SELECT conv_id, least(k0, {once[3].replace('k2', '(' + once[2] + ')')}) AS k FROM d JOIN n USING (conv_id) WHERE d.i = n.n),
a AS (SELECT conv_id, substr(k, 1, 8)::BIGINT AS cost, substr(k, 9) AS audit FROM e),
l AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM a),
m AS (SELECT conv_id, p, audit[p] AS letter, length(replace(audit[:p], 'I', '')) AS i, length(replace(audit[:p], 'D', '')) - 1 AS o, length(replace(audit, 'D', '')) % 2 AS odd FROM l WHERE audit[p] != 'D'),
f AS (SELECT m.conv_id, m.p, CASE WHEN letter = 'K' THEN v.role WHEN (o - odd) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE v.text END AS line
      FROM m LEFT JOIN v ON v.conv_id IS NOT DISTINCT FROM m.conv_id AND v.i = m.i),
h AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY p)) AS h FROM f GROUP BY conv_id),
o AS (SELECT DISTINCT conv_id FROM conversations)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM o LEFT JOIN n USING (conv_id) LEFT JOIN il USING (conv_id) LEFT JOIN a USING (conv_id) LEFT JOIN h USING (conv_id)
"""


ORACLE_SQL = _oracle()
