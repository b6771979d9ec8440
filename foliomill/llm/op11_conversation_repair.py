"""Conversation structure repair by depth-first branch and bound.

The edits of a conversation's rows, in order: Keep, Rerole to user or assistant, Delete, Insert an empty turn.  Kept,
reroled and inserted roles must read, by their initials, ``(s?(ua)+)?``.  A node of the search is the number of rows done
and the last role's initial.  The search runs on an explicit stack; a prefix is left where its cost and the least that the
rows behind it can cost pass the incumbent (cost, audit), or where the node's dominance table holds a better prefix.  It
ends with an empty stack, so the incumbent is proved best.

Two different audits that reach one node at one cost differ before either ends, as a longer one holds an insert more; so
the better prefix stays the better one whatever follows.  For the same reason long conversations are searched in blocks
of ``BLOCK`` rows from each initial to each, and the blocks' results are put together in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliomill.llm.common import quoted, table

BLOCK = 16
BLANK = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

# The last role: none yet, system, user, assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
# Which roles may follow, and which of user and assistant does.
FOLLOWS = ((SYSTEM, USER), (USER,), (ASSISTANT,), (USER,))
TURN = (USER, USER, ASSISTANT, USER)
NAMES = ("", "system", "user", "assistant")
ENDS = (START, ASSISTANT)

# A row in the search: its role (0: any other), 4 more if truncated, 8 if it must go.
MUST_GO = 8

SUMMARY = [
    *(T.StructField(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
    T.StructField("audit", T.StringType()),
    T.StructField("repaired_sha256", T.StringType()),
]


def least(row: int) -> int:
    """What a row costs whatever stands beside it."""
    if row == MUST_GO:
        return DELETE
    return min(DELETE, (0 if row % 4 else REROLE) + (TRUNCATED if row >= 4 else 0))


@lru_cache(1 << 16)
def search(rows: bytes, entry: int, last: bool) -> tuple[tuple[int, str] | None, ...]:
    """The best (cost, audit) from ``entry`` to each last role, right after the last row; to the end if ``last``.

    With ``last`` the result is one pair, of an audit whose roles are whole.
    """
    n = len(rows)
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + least(rows[i])
    exits: list[tuple[int, str] | None] = [None] * (1 if last else 4)
    nodes: dict[tuple[int, int], tuple[int, str]] = {(0, entry): (0, "")}  # the dominance tables
    stack = [(0, entry, 0, "")]

    def beaten(i: int, cost: int, audit: str) -> bool:
        bound = cost + rest[i]
        return all(e is not None and (bound > e[0] or bound == e[0] and audit > e[1][: len(audit)]) for e in exits)

    def push(i: int, state: int, cost: int, audit: str) -> None:
        held = nodes.get((i, state))
        if (held is None or (cost, audit) < held) and not beaten(i, cost, audit):
            nodes[i, state] = (cost, audit)
            stack.append((i, state, cost, audit))

    while stack:
        i, state, cost, audit = stack.pop()
        if nodes[i, state] != (cost, audit) or beaten(i, cost, audit):
            continue
        if i == n and (not last or state in ENDS):
            at = 0 if last else state
            if exits[at] is None or (cost, audit) < exits[at]:
                exits[at] = (cost, audit)
        if i < n or last:
            push(i, TURN[state], cost + INSERT, audit + "I")
        if i < n:
            row = rows[i]
            push(i + 1, state, cost + DELETE, audit + "D")
            if row != MUST_GO:
                more = cost + (TRUNCATED if row >= 4 else 0)
                push(i + 1, TURN[state], more + REROLE, audit + "R")
                if row % 4 in FOLLOWS[state]:
                    push(i + 1, row % 4, more + KEEP, audit + "K")
    return tuple(exits)


def replay(state: int, audit: str, rows: list[tuple[str, str]]) -> Iterator[tuple[str, int, str, str]]:
    """The edits of ``audit`` that leave a turn: edit, its row (-1: inserted), role, text."""
    at = 0
    for edit in audit:
        if edit == "I":
            state = TURN[state]
            yield edit, -1, NAMES[state], ""
            continue
        if edit != "D":
            role, text = rows[at]
            state = TURN[state] if edit == "R" else INITIALS[role[:1]]
            yield edit, at, NAMES[state] if edit == "R" else role, text
        at += 1


class Path:
    """The best edits up to one last role: cost, order of its audit among the others', audit as a chain, hash so far."""

    def __init__(self, cost: int = 0, order: int = 0, chain: tuple | None = None, hashed=None):
        self.cost, self.order, self.chain = cost, order, chain
        self.hashed = hashed or hashlib.sha256()
        self.lines = hashed is not None

    def audit(self) -> str:
        out, chain = [], self.chain
        while chain:
            chain, part = chain
            out.append(part)
        return "".join(reversed(out))


class Conversation:
    """One conversation, row by row.  Holds a block of rows, and of all others a digest and the audits' letters."""

    def __init__(self):
        self.seen: set[bytes] = set()
        self.turns = [None, None, 0]  # least, greatest, number of different ones (rows come by turn)
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before: str | None = None
        self.paths = {START: Path()}
        self.rows: list[tuple[str, str]] = []
        self.classes = bytearray()

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            if self.turns[1] != turn:
                self.turns[2] += 1
            self.turns[0] = turn if self.turns[0] is None else self.turns[0]
            self.turns[1] = turn
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        end = text.rstrip(BLANK)[-1:]
        kind = INITIALS.get(initial, 0)
        if not end:
            self.blank += 1
            kind = MUST_GO
        elif digest in self.seen:
            self.duplicate += 1
            kind = MUST_GO
        elif end not in ".!?":
            self.truncated += 1
            kind += 4
        self.seen.add(digest)
        if len(self.rows) == BLOCK:
            self.step(False)
        self.rows.append((role, text))
        self.classes.append(kind)

    def step(self, last: bool) -> None:
        """Take the rows held into the paths."""
        found: dict[int, tuple[int, int, str, int]] = {}
        for entry, path in self.paths.items():
            for exit_, best in enumerate(search(bytes(self.classes), entry, last)):
                if best:
                    way = (path.cost + best[0], path.order, best[1], entry)
                    found[exit_] = min(found.get(exit_, way), way)
        paths = {}
        order = sorted(found, key=lambda e: found[e][1:3])
        for exit_, (cost, _, audit, entry) in found.items():
            old = self.paths[entry]
            path = Path(cost, order.index(exit_), (old.chain, audit), old.hashed.copy())
            path.lines = old.lines
            for _, _, role, text in replay(entry, audit, self.rows):
                path.hashed.update(f"{chr(10) if path.lines else ''}{role}:{text}".encode())
                path.lines = True
            paths[exit_] = path
        self.paths, self.rows, self.classes = paths, [], bytearray()

    def summary(self) -> tuple:
        self.step(True)
        best = self.paths[0]
        low, high, different = self.turns
        gaps = 0 if low is None else high - low + 1 - different
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, best.cost, best.audit(), best.hashed.hexdigest())


def in_order(turns: DataFrame, conversation: str, turn: str, role: str, text: str, copies: str | None) -> DataFrame:
    """A conversation's rows in one partition, by turn (null first), role and text."""
    null = F.lit(" ")
    rows = turns.select(
        quoted(conversation).alias("conversation"),
        quoted(turn).cast("bigint").alias("turn"),
        F.coalesce(quoted(role), null).alias("role"),
        F.coalesce(quoted(text), null).alias("text"),
        (F.lit(1) if copies is None else quoted(copies)).cast("bigint").alias("copies"),
    )
    return rows.repartition("conversation").sortWithinPartitions("conversation", "turn", "role", "text")


def repair(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    copies: str | None = None,
) -> DataFrame:
    """One row per conversation: its faults, the cost and audit of its cheapest repair, SHA-256 of the repaired lines.

    ``copies`` names a column that says how often a row stands (adjacently); 0 leaves it out, though its conversation is
    given.  Null roles and texts are one space; rows whose conversation is null are one conversation.  Rows of one turn are
    taken by role and text; a role without an initial can only be reroled or deleted.  An empty table gives no rows.

    A conversation passes one task as a sorted stream, which SHA-256 demands; of its rows the task holds ``BLOCK``, a digest
    of 16 bytes of each, and up to four audits of a letter per edit.
    """
    kind = turns.schema[conversation].dataType
    schema = T.StructType([T.StructField(conversation, kind), *SUMMARY])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_, out = None, None, []
        types = None

        def made() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            types = [batch.column(0).type, *[pa.int64()] * 6, pa.string(), pa.string()]
            for key, at, who, what, times in zip(*(c.to_pylist() for c in batch.columns)):
                if open_ is None or key != now:
                    if open_ is not None:
                        out.append((now, *open_.summary()))
                    now, open_ = key, Conversation()
                for _ in range(times):
                    open_.add(at, who, what)
            if len(out) > 4096:
                yield made()
        if open_ is not None:
            out.append((now, *open_.summary()))
            yield made()

    return in_order(turns, conversation, turn, role, text, copies).mapInArrow(run, schema)


def repaired(
    turns: DataFrame,
    audits: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    copies: str | None = None,
) -> DataFrame:
    """The turns that the ``audits`` of ``repair`` leave: conversation, ``position`` from 0, ``edit`` (K, R or I), ``role``, ``text``.

    Takes the rows and parameters that ``repair`` was given.  Turns come out as their conversation streams by.
    """
    kind = turns.schema[conversation].dataType
    rows = turns.withColumn("_audit", F.lit(None).cast("string"))
    heads = audits.select(
        quoted(conversation).alias("conversation"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"),
        F.lit(1).cast("bigint").alias("copies"), F.col("audit"),
    )
    null = F.lit(" ")
    body = rows.select(
        quoted(conversation).alias("conversation"), quoted(turn).cast("bigint").alias("turn"), F.coalesce(quoted(role), null).alias("role"),
        F.coalesce(quoted(text), null).alias("text"), (F.lit(1) if copies is None else quoted(copies)).cast("bigint").alias("copies"), F.col("_audit").alias("audit"),
    )
    # The audit comes first: null turns do as well, but its other columns are empty and the audit is not null.
    both = heads.union(body).withColumn("first", F.col("audit").isNull())
    both = both.repartition("conversation").sortWithinPartitions("conversation", "first", "turn", "role", "text")
    schema = T.StructType(
        [
            T.StructField(conversation, kind),
            T.StructField("position", T.LongType()),
            *(T.StructField(n, T.StringType()) for n in ("edit", "role", "text")),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, position = "", 0, START, 0
        for batch in batches:
            out: list[tuple] = []

            def put(key, edits: str, row: list[tuple[str, str]]) -> None:
                nonlocal state, position
                for edit, _, who, what in replay(state, edits, row):
                    out.append((key, position, edit, who, what))
                    state, position = INITIALS[who[:1]], position + 1

            columns = [batch.column(c).to_pylist() for c in ("conversation", "role", "text", "copies", "audit")]
            for key, who, what, times, given in zip(*columns):
                if given is not None:
                    audit, at, state, position = given, 0, START, 0
                    times = 0
                for _ in range(times):
                    upto = at
                    while audit[upto] == "I":
                        upto += 1
                    put(key, audit[at : upto + 1], [(who, what)])
                    at = upto + 1
                # What is inserted behind the last row has no row to wait for.
                if audit[at:] and not audit[at:].strip("I"):
                    put(key, audit[at:], [])
                    at = len(audit)
            if out:
                types = [batch.column("conversation").type, pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=schema.names)

    return both.mapInArrow(run, schema)


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` with faults put in by a checksum of id and turn: ``copies`` is 0 for a dropped row, 2 for a repeated one."""
    null = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), null), F.lit(":"), F.coalesce(F.col("turn").cast("string"), null))
    hit = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", null)
    return turns.select(
        "conv_id",
        "turn",
        F.when(hit == 4, "user").otherwise(F.coalesce("role", null)).alias("role"),
        F.when(hit.isin(0, 1), "").when(hit == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1).alias("copies"),
    )


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair(damage(table(spark, folder, "conversations")), copies="copies")


def twin() -> str:
    """The same by dynamic programming over all rows' positions, in SQL.

    ``s0`` to ``s3`` are the best (cost, audit, lines) by last role; a struct compares by its fields in order.
    """

    def then(state: str, cost: str, edit: str, line: str = "''") -> str:
        return f"CASE WHEN {state} IS NOT NULL THEN struct_pack(c := {state}.c + {cost}, a := {state}.a || '{edit}', t := {state}.t || {line}) END"

    def inserted(state: str, role: str) -> str:
        return then(state, "2", "I", f"chr(10) || '{role}:'")

    def deleted(state: str) -> str:
        return then(state, "3", "D")

    def stays(state: str, name: str) -> str:
        keep = then(state, "cut", "K", "chr(10) || role || ':' || text")
        change = then(state, "2 + cut", "R", f"chr(10) || '{name}:' || text")
        return f"CASE WHEN NOT gone AND initial = '{name[0]}' THEN {keep} END, CASE WHEN NOT gone THEN {change} END"

    kept_system = then("s0", "cut", "K", "chr(10) || role || ':' || text")
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    user = f"least(s2, {inserted('s0', 'user')}, {inserted('s1', 'user')}, {inserted('s3', 'user')})"
    pair = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
    return f"""
        WITH RECURSIVE bits AS (
            SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc),
        marked AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
                        string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: unicode(x)::BIGINT)),
                    lambda c, b: xor(crc[xor(c % 256, b) + 1], c // 256)), 4294967295) % 20 AS hit
            FROM conversations, bits),
        damaged AS (
            SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
                CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN translate(text, '.!?', '') ELSE text END AS text
            FROM marked, range(CASE WHEN hit = 3 THEN 2 ELSE 1 END) WHERE hit <> 0),
        placed AS (
            SELECT *, row_number() OVER w AS spot,
                left(role, 1) AS initial, lag(left(role, 1)) OVER w || left(role, 1) AS pair, right(rtrim(text, {spaces}), 1) AS final
            FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
        judged AS (
            SELECT *, final = '' OR again AS gone, CASE WHEN final IN ('.', '!', '?') THEN 0 ELSE 1 END AS cut
            FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY spot) > 1 AS again FROM placed)),
        counted AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (final = '') AS blank,
                count(*) FILTER (final <> '' AND again) AS duplicate, count(*) FILTER (NOT gone AND cut = 1) AS truncated,
                count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
            FROM judged GROUP BY conv_id),
        best AS (
            SELECT conv_id, 0::BIGINT AS spot, struct_pack(c := 0::BIGINT, a := '', t := '') AS s0,
                NULL::{pair} AS s1, NULL::{pair} AS s2, NULL::{pair} AS s3
            FROM counted
            UNION ALL
            SELECT conv_id, spot, {deleted('s0')}, least({deleted('s1')}, CASE WHEN NOT gone AND initial = 's' THEN {kept_system} END),
                least({deleted('u')}, {stays('s0', 'user')}, {stays('s1', 'user')}, {stays('v', 'user')}),
                least({deleted('v')}, {stays('u', 'assistant')})
            FROM (SELECT b.conv_id, j.spot, s0, s1, {user} AS u, least(s3, {inserted(f'({user})', 'assistant')}) AS v, gone, cut, initial, role, text
                FROM best b JOIN judged j ON j.conv_id IS NOT DISTINCT FROM b.conv_id AND j.spot = b.spot + 1)),
        ended AS (
            SELECT b.conv_id, least(s0, s3, {inserted(f'({user})', 'assistant')}) AS e
            FROM best b JOIN counted c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.n = b.spot)
        SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
            coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(e.c, 0)::BIGINT AS cost,
            coalesce(e.a, '') AS audit, sha256(coalesce(substr(e.t, 2), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o
        LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended d ON d.conv_id IS NOT DISTINCT FROM o.conv_id"""
