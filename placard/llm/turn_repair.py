"""Repair of conversations' structure by cheapest edits.

A repaired conversation's roles, by their initials, are (s?(ua)+)?. Rows are
kept, get another role, or go; empty user and assistant turns may come in. Which
edits are cheapest is a shortest path over (rows done, state of the pattern). All
costs are integers of at most ``MOST``, so the queue is Dial's: a ring of
buckets, one for each distance still possible, and no heap. It runs backward from
the end and records each node's distance to it; then a walk from the start
follows tight arcs (whose cost is the difference of their ends' distances) and,
of those, the least letter. The letters are the audit: Delete, Insert, Keep,
Rerole.

Conversations are sorted by ranges and cut into segments of at most ``ROWS`` rows
or ``CHARS`` characters, so one conversation may lie in many tasks. Where one has
several segments, each gives its costs from each state to each; combined from the
end, they give the distances at each border, then each segment walks from all
four states, which fixes the states at the borders, and then each is repaired by
itself. A row's earlier equals in other segments come from a table of digests.
What is joined for a whole conversation is one short row for each segment, and
the audit; the repaired text is hashed piece by piece.

Edge cases: null roles and texts are one space; rows of equal turn (null first)
are ordered by role, then text; a conversation of repeated rows keeps the first;
rows without conv_id belong to no conversation and are left out; a conversation
without rows after damage has zeros, an empty audit and the hash of the empty
string; very long texts stay in the one row they are in; an empty table gives an
empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placard.llm.common import fresh_path, only, small, staged, table
from placard.llm.prefix_trie import crc32_sql

ROWS, CHARS = 4096, 8 << 20
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 3, 4, 3, 3
MOST = REROLE + UNFINISHED
#: States of the pattern: nothing yet, after s, after u, after a. It may end where the distance is 0.
START, END, FAR = 0, (0, None, None, 0), 1 << 60
#: The state after an inserted or reroled turn: user, or assistant after a user.
TURN = (2, 2, 3, 2)
#: The states after a kept turn, by its role's initial.
KEPT_TURN = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
_VISIBLE = re.compile(r"[^\x20\x09-\x0D]")


def digest(role: str, text: str) -> bytes:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def faults(roles: list[str], texts: list[str], seen: set[bytes]) -> list[int]:
    """Each row's first fault, or 0; seen holds the digests of equal rows before these."""
    found, known = [], set(seen)
    for role, text in zip(roles, texts, strict=True):
        row = digest(role, text)
        if not _VISIBLE.search(text):
            found.append(BLANK)
        elif row in known:
            found.append(DUPLICATE)
        else:
            found.append(0 if text.rstrip("\x20\t\n\v\f\r")[-1] in ".!?" else TRUNCATED)
        known.add(row)
    return found


def arcs(role: str, fault: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, state after, cost) of each edit of a row, least letter first."""
    yield "D", state, DELETE
    if fault in (0, TRUNCATED):
        more = UNFINISHED if fault else 0
        if (after := KEPT_TURN.get(role[:1], (None,) * 4)[state]) is not None:
            yield "K", after, KEEP + more
        yield "R", TURN[state], REROLE + more


def distances(roles: list[str], found: list[int], goal: tuple[int | None, ...]) -> list[int]:
    """The distance from each node, 4 * rows done + state, to the end, whose states have the distances goal; by Dial's algorithm."""
    n = len(roles)
    back: list[list[tuple[int, int]]] = [[] for _ in range(4 * n + 4)]
    for i in range(n + 1):
        for state in range(4):
            here = 4 * i + state
            back[4 * i + TURN[state]].append((here, INSERT))
            if i < n:
                for _, after, cost in arcs(roles[i], found[i], state):
                    back[4 * i + 4 + after].append((here, cost))
    known = [(4 * n + q, d) for q, d in enumerate(goal) if d is not None and d < FAR]
    first = min((d for _, d in known), default=0)
    ring = MOST + 1 + max((d for _, d in known), default=0) - first
    buckets: list[list[int]] = [[] for _ in range(ring)]
    out, waiting, now = [FAR] * (4 * n + 4), 0, first
    for node, d in known:
        out[node] = d
        buckets[(d - first) % ring].append(node)
        waiting += 1
    while waiting:
        bucket = buckets[(now - first) % ring]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if out[node] != now:
                continue  # reached at a lower distance since
            for before, cost in back[node]:
                d = now + cost
                if d < out[before]:
                    out[before] = d
                    buckets[(d - first) % ring].append(before)
                    waiting += 1
        now += 1
    return out


def walk(roles: list[str], found: list[int], far: list[int], goal: tuple[int | None, ...], state: int) -> tuple[str, list[int], int]:
    """The least of the cheapest audits from a state, the states after its letters, and the last state.

    An insert between two segments belongs to the later one, so only the last ends with inserts.
    """
    audit, states, i, n = [], [], 0, len(roles)
    while i < n or far[4 * i + state] != goal[state]:
        options = [("I", 4 * i + TURN[state], INSERT)]
        if i < n:
            options += [(letter, 4 * i + 4 + after, cost) for letter, after, cost in arcs(roles[i], found[i], state)]
        letter, node, _ = min(o for o in options if far[4 * i + state] == far[o[1]] + o[2])
        audit.append(letter)
        i, state = divmod(node, 4)
        states.append(state)
    return "".join(audit), states, state


def repaired(roles: list[str], texts: list[str], audit: str, states: list[int]) -> list[str]:
    """The lines role:text that an audit leaves."""
    out, i = [], 0
    for letter, state in zip(audit, states, strict=True):
        if letter == "K":
            out.append(f"{roles[i]}:{texts[i]}")
        elif letter != "D":
            out.append(f"{'user' if state == 2 else 'assistant'}:{texts[i] if letter == 'R' else ''}")
        i += letter != "I"
    return out


SEGMENT = "conv_id long, at long, roles array<string>, texts array<string>, low long, high long, n_turns long"


def segments(rows: DataFrame) -> DataFrame:
    """SEGMENT: consecutive rows (conv_id, turn, role, text) of a conversation; at gives their order, low, high and n_turns its turn numbers."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict = {}

        def done() -> pa.RecordBatch:
            turns = sorted({t for t in now.pop("turns") if t is not None})
            return pa.RecordBatch.from_pylist([now | {"low": turns[0] if turns else None, "high": turns[-1] if turns else None, "n_turns": len(turns)}], SCHEMA)

        for batch in batches:
            for conv_id, turn, role, text, at in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "at")], strict=True):
                if now and (now["conv_id"] != conv_id or len(now["roles"]) >= ROWS or chars >= CHARS):
                    yield done()
                    now = {}
                if not now:
                    now, chars = {"conv_id": conv_id, "at": at, "roles": [], "texts": [], "turns": []}, 0
                now["roles"].append(role)
                now["texts"].append(text)
                now["turns"].append(turn)
                chars += len(text)
        if now:
            yield done()

    longs, strings = pa.int64(), pa.list_(pa.string())
    SCHEMA = pa.schema([("conv_id", longs), ("at", longs), ("roles", strings), ("texts", strings), ("low", longs), ("high", longs), ("n_turns", longs)])
    by = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("row")]
    dealt = rows.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("row")).repartitionByRange(*by).sortWithinPartitions(*by)
    path = fresh_path(rows.sparkSession, "segments")
    dealt.drop("row").withColumn("at", F.monotonically_increasing_id()).mapInArrow(cut, SEGMENT).write.parquet(path)
    return rows.sparkSession.read.schema(SEGMENT).parquet(path)


def _each(df: DataFrame, schema: str, function) -> DataFrame:
    """A row of schema for each segment: conv_id, at and what function(row) returns."""
    fields = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                rows = [dict(zip(fields, (r["conv_id"], r["at"], *function(r)), strict=True)) for r in batch.slice(k, 64).to_pylist()]
                yield pa.RecordBatch.from_pylist(rows, arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return df.mapInArrow(run, schema)


def _matrix(row: dict) -> tuple:
    """Costs from each state before a segment to each state after it, row by row."""
    found = faults(row["roles"], row["texts"], set(row["seen"] or ()))
    columns = [distances(row["roles"], found, tuple(0 if q == end else None for q in range(4)))[:4] for end in range(4)]
    return ([columns[end][q] for q in range(4) for end in range(4)],)


def _exits(row: dict) -> tuple:
    found = faults(row["roles"], row["texts"], set(row["seen"] or ()))
    far = distances(row["roles"], found, tuple(row["goal"]))
    return ([walk(row["roles"], found, far, row["goal"], q)[2] if far[q] < FAR else -1 for q in range(4)],)


RESULT = "conv_id long, at long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, lines array<string>"


def _repair(row: dict) -> tuple:
    roles, texts, goal, entry = row["roles"], row["texts"], tuple(row["goal"] or END), row["entry"] or START
    found = faults(roles, texts, set(row["seen"] or ()))
    far = distances(roles, found, goal)
    audit, states, state = walk(roles, found, far, goal, entry)
    lines = repaired(roles, texts, audit, states)
    gaps = row["high"] - row["low"] + 1 - row["n_turns"] if row["n_turns"] else 0
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
    counts = [found.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)]
    alone = row["goal"] is None
    sha = hashlib.sha256("\n".join(lines).encode()).hexdigest() if alone else None
    return (gaps, *counts, illegal, far[entry] - (goal[state] or 0), audit, sha, None if alone else lines)


def _goals(row: dict) -> Iterator[dict]:
    """Distances at the end of each segment of a conversation, from the segments' matrices, last first."""
    goal = [FAR if d is None else d for d in END]
    for part in reversed(row["parts"]):
        yield {"conv_id": row["conv_id"], "at": part["at"], "goal": goal}
        costs = part["matrix"]
        goal = [min(min(costs[4 * q + e] + goal[e] for e in range(4)), FAR) for q in range(4)]


def _entries(row: dict) -> Iterator[dict]:
    state = START
    for part in row["parts"]:
        yield {"conv_id": row["conv_id"], "at": part["at"], "entry": state}
        state = part["exits"][state]


def _in_order(df: DataFrame, column: str, schema: str, function) -> DataFrame:
    """function over each conversation's segments in order, of which df has one short row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist(list(function(row)), arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return df.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", column))).alias("parts")).mapInArrow(run, schema)


def _borders(many: DataFrame) -> DataFrame:
    """(conv_id, at, seen, goal, entry) of the segments of conversations that have several."""
    spark = many.sparkSession
    rows = many.select("conv_id", "at", F.explode(F.arrays_zip("roles", "texts")).alias("r"))
    row = F.unhex(F.sha2(F.concat(F.length("r.roles").cast("string"), F.lit(":"), F.col("r.roles"), F.col("r.texts")), 256))
    once = rows.select("conv_id", "at", row.alias("row")).distinct().withColumn("first", F.expr("min(at) over (partition by conv_id, row)"))
    seen = staged(once.filter("at > first").groupBy("conv_id", "at").agg(F.collect_list("row").alias("seen")))
    many = many.join(seen, ["conv_id", "at"], "left")
    goals = staged(_in_order(_each(many, "conv_id long, at long, matrix array<long>", _matrix), "matrix", "conv_id long, at long, goal array<long>", _goals))
    exits = _each(many.join(goals, ["conv_id", "at"]), "conv_id long, at long, exits array<int>", _exits)
    entries = _in_order(exits, "exits", "conv_id long, at long, entry int", _entries)
    return staged(entries.join(goals, ["conv_id", "at"]).join(seen, ["conv_id", "at"], "left"))


def _whole(parts: DataFrame, light: DataFrame) -> DataFrame:
    """The results of conversations of several segments (RESULT, and conv_id, at, low, high, n_turns, first and last initial of each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, begun = None, hashlib.sha256(), False
        row = lambda: pa.RecordBatch.from_pylist([{"conv_id": now, "repaired_sha256": sha.hexdigest()}])
        for batch in batches:
            for conv_id, lines in zip(batch.column("conv_id").to_pylist(), batch.column("lines").to_pylist(), strict=True):
                if conv_id != now:
                    if now is not None:
                        yield row()
                    now, sha, begun = conv_id, hashlib.sha256(), False
                if lines:
                    sha.update((b"\n" if begun else b"") + "\n".join(lines).encode())
                    begun = True
        if now is not None:
            yield row()

    hashes = parts.select("conv_id", "at", "lines").repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(run, "conv_id long, repaired_sha256 string")
    order = "over (partition by conv_id order by at)"
    pairs = light.selectExpr("*", f"lag(high) {order} = low as same", f"lag(last) {order} || first not in ('su', 'ua', 'au') as broken")
    turns = pairs.groupBy("conv_id").agg(F.expr("coalesce(max(high) - min(low) + 1 - sum(n_turns) + count_if(same), 0) as gaps"), F.expr("count_if(broken) as broken"))
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "audit"))), lambda p: p["audit"]), "").alias("audit")
    sums = parts.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], audit)
    return sums.join(turns, "conv_id").join(hashes, "conv_id").withColumn("illegal", F.col("illegal") + F.col("broken"))


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair(conversations: DataFrame) -> DataFrame:
    """COLUMNS for each conversation of conversations (conv_id, turn, role, text)."""
    clean = only(conversations, "conv_id", "turn", "role", "text").filter("conv_id is not null").withColumns({c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")})
    cut = segments(clean)
    first = lambda role: F.substring(role, 1, 1)
    light = cut.select("conv_id", "at", "low", "high", "n_turns", first(F.col("roles")[0]).alias("first"), first(F.element_at("roles", -1)).alias("last"))
    # Few conversations have several segments: long ones, and those at the border of two tasks.
    light = staged(light.withColumn("n", F.expr("count(*) over (partition by conv_id)")).filter("n > 1"))
    borders = small(_borders(cut.join(small(light.select("conv_id", "at")), ["conv_id", "at"], "left_semi")), 1 << 16)
    parts = staged(_each(cut.join(borders, ["conv_id", "at"], "left"), RESULT, _repair))
    whole = _whole(parts.filter("lines is not null"), light)
    return parts.filter("lines is null").select(*COLUMNS).unionByName(whole.select(*COLUMNS))


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with the faults that the CRC-32 of conv_id:turn deals out."""
    kind = F.crc32(F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    rows = only(conversations, "conv_id", "turn", "role", "text").filter("conv_id is not null").withColumn("kind", kind).filter("kind <> 0")
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(role).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    every = only(conversations, "conv_id").filter("conv_id is not null").distinct()
    nothing = {c: F.lit(0).cast("long") for c in COLUMNS[1:7]} | {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    found = every.join(repair(damaged(conversations)), "conv_id", "left")
    return found.select("conv_id", *[F.coalesce(c, empty).alias(c) for c, empty in nothing.items()])


_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: Each edit of a row in each state, after at most two inserts: state, letters, initial of a kept row or none, state after, inserts.
_STEPS = ", ".join(
    f"({q}, '{'I' * k}{letter}', {repr(initial) if initial else 'null'}, {after}, {k})"
    for q in range(4)
    for k, at in enumerate((q, TURN[q], TURN[TURN[q]]))
    for letter, initial, after in [("D", None, at), ("R", None, TURN[at]), *[("K", c, to[at]) for c, to in KEPT_TURN.items() if to[at] is not None]]
)
OP13_SQL = f"""
with recursive o as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as body, {crc32_sql("(conv_id::varchar || ':' || coalesce(turn::varchar, ' '))")} % 20 as kind
    from conversations where conv_id is not null),
d as (
    select conv_id, turn, case when kind = 4 then 'user' else role end as role,
        case kind when 1 then '' when 2 then regexp_replace(body, '[.!?]', '', 'g') else body end as body
    from o, unnest(range(case when kind = 3 then 2 else 1 end)) where kind <> 0),
r as (select *, row_number() over (partition by conv_id order by turn nulls first, role, body) as i, trim(body, {_SPACES}) as seen from d),
f as (
    select *, case when seen = '' then 'blank' when row_number() over (partition by conv_id, role, body order by i) > 1 then 'duplicate'
            when right(seen, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
        role[1] as initial, lag(role[1]) over (partition by conv_id order by i) || role[1] not in ('su', 'ua', 'au') as illegal
    from r),
n as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) as n, count_if(illegal) as illegal,
        count_if(fault = 'blank') as blank, count_if(fault = 'duplicate') as duplicate, count_if(fault = 'truncated') as truncated from f group by conv_id),
steps(q, letters, initial, after, inserts) as (values {_STEPS}),
best as (
    select conv_id, 0::bigint as i, 0 as q, 0 as cost, '' as audit from n
    union all
    (select conv_id, i, q, arg_min(cost, (cost, audit)), arg_min(audit, (cost, audit)) from (
        select b.conv_id, b.i + 1 as i, s.after as q, b.audit || s.letters as audit,
            b.cost + {INSERT} * s.inserts + case right(s.letters, 1) when 'D' then {DELETE} when 'R' then {REROLE} else 0 end
                + case when f.fault = 'truncated' and right(s.letters, 1) <> 'D' then {UNFINISHED} else 0 end as cost
        from best b join f on f.conv_id = b.conv_id and f.i = b.i + 1 join steps s on s.q = b.q
        where right(s.letters, 1) = 'D' or f.fault not in ('blank', 'duplicate') and (s.initial is null or s.initial = f.initial)) group by conv_id, i, q)),
e as (
    select conv_id, arg_min(cost, (cost, audit)) as cost, arg_min(audit, (cost, audit)) as audit from (
        select b.conv_id, cost + {INSERT} * t.n as cost, audit || repeat('I', t.n) as audit
        from best b join n using (conv_id) join (values (0, 0), (3, 0), (2, 1), (1, 2)) t(q, n) using (q) where b.i = n.n) group by conv_id),
l as (
    select conv_id, j, audit[j] as letter, count_if(audit[j] <> 'I') over w as i, count_if(audit[j] <> 'D') over w as turn from e, unnest(range(1, length(audit) + 1)) as u(j)
    window w as (partition by conv_id order by j)),
k as (
    select l.*, f.role, f.body, coalesce(max(case when l.turn = 1 and l.letter = 'K' and f.initial = 's' then 1 end) over (partition by l.conv_id), 0) as s
    from l left join f on f.conv_id = l.conv_id and f.i = l.i where letter <> 'D'),
t as (
    select conv_id, string_agg(case when letter = 'K' then role when (turn - s) % 2 = 1 then 'user' else 'assistant' end || ':' || case letter when 'I' then '' else body end, chr(10) order by j) as said
    from k group by conv_id)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
    coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit, sha256(coalesce(said, '')) as repaired_sha256
from (select distinct conv_id from o) c left join n using (conv_id) left join e using (conv_id) left join t using (conv_id)
"""
