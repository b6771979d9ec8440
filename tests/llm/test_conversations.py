import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pandas as pd
import pytest

from foliomill.llm.op11_conversation_repair import BLOCK, MUST_GO, damage, op11_conversation_repair, repair, repaired, search, twin

SMALL = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
GOOD = re.compile(r"(s?(ua)+)?")


def cheapest(roles, faults):
    """Uniform-cost search over whole edit sequences; every audit of a prefix counts, none is thrown away but by its node."""
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, at, initials, out = heapq.heappop(queue)
        if at == len(roles) and GOOD.fullmatch(initials):
            return cost, audit, list(out)
        # What follows depends on the rows done and on how the initials can go on.
        node = (at, initials[-1:])
        if node in done:
            continue
        done.add(node)
        steps = []
        for name in ("user", "assistant"):
            steps.append((2, "I", 0, name, (-1, name)))
        if at < len(roles):
            steps.append((3, "D", 1, "", None))
            if faults[at] not in ("blank", "duplicate"):
                cut = faults[at] == "truncated"
                steps.append((cut, "K", 1, roles[at], (at, roles[at])))
                steps += [(2 + cut, "R", 1, name, (at, name)) for name in ("user", "assistant")]
        for more, edit, rows, name, made in steps:
            now = initials + (name[:1] or "?" if made else "")
            if re.fullmatch(r"s?(ua)*u?", now):
                heapq.heappush(queue, (cost + more, audit + edit, at + rows, now, out + ((made,) if made else ())))


def expected(rows):
    """Summary of one conversation's rows (turn, role, text), and its repaired lines."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, seen = [], set()
    for _, role, text in rows:
        end = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, out = cheapest([r for _, r, _ in rows], faults)
    lines = [f"{name}:{rows[at][2] if at >= 0 else ''}" for at, name in out]
    counts = [faults.count(x) for x in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), lines


ROLES = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "sir"]
TEXTS = ["Yes.", "No", "", " \t", None, "a b.c", "Is it so?  \n", "x", "y!", "ü.", "."]


def conversations(seed, count, most):
    rng = random.Random(seed)
    for c in range(count):
        n = rng.randrange(1, most)
        for t in range(n):
            turn = None if rng.random() < 0.05 else t + rng.choice([0, 0, 0, 3])
            text = rng.choice(TEXTS) if rng.random() < 0.5 else f"Text {rng.randrange(9999)}."
            yield (None if c == 0 else c, turn, rng.choice(ROLES[: rng.choice([2, 3, 9])]), text)


@pytest.mark.parametrize("most", [9, 4 * BLOCK])
def test_repairs_are_the_cheapest(spark, most):
    rows = list(conversations(most, 60, most))
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", cost int")
    plan = repair(df)
    assert plan.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {r[0]: tuple(r)[1:] for r in plan.collect()}
    lines = {}
    for r in sorted(repaired(df, plan).collect(), key=lambda r: r.position):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert set(got) == {r[0] for r in rows}
    for conv, summary in got.items():
        want, out = expected([r[1:] for r in rows if r[0] == conv])
        assert summary == want
        assert lines.get(conv, []) == out


def test_blocks_change_nothing():
    rng = random.Random(3)
    for _ in range(300):
        rows = bytes(rng.choice([1, 2, 3, 0, 5, 6, 7, 4, MUST_GO]) for _ in range(rng.randrange(2, 12)))
        whole = search(rows, 0, True)[0]
        cut = rng.randrange(1, len(rows))
        parts = [
            (a[0] + b[0], a[1] + b[1]) for e, a in enumerate(search(rows[:cut], 0, False)) if a for b in [search(rows[cut:], e, True)[0]] if b
        ]
        assert min(parts) == whole


def test_edge_cases(spark):
    assert repair(spark.createDataFrame([], SCHEMA)).count() == 0
    empty = hashlib.sha256(b"").hexdigest()
    df = spark.createDataFrame([(1, 5, "user", "Hi.", 0), (2, 1, "user", "Hi.", 2), (2, 2, "assistant", "Yo", 1)], SCHEMA + ", copies int")
    got = {r.conv_id: tuple(r)[1:] for r in repair(df, copies="copies").collect()}
    assert got[1] == (0, 0, 0, 0, 0, 0, "", empty)
    assert got[2][1:7] == (0, 1, 1, 1, 4, "KDK")
    # A conversation whose paths never meet: two ways to read it differ from its first row on.
    many = spark.createDataFrame([(1, i, "tool", f"Line {i}.") for i in range(501)], SCHEMA)
    row = repair(many).first()
    assert row["cost"] == 1003 and row["audit"] == "D" + "R" * 500


def damaged(rows):
    for conv, turn, role, text in rows:
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        for _ in range(0 if hit == 0 else 2 if hit == 3 else 1):
            yield conv, turn, "user" if hit == 4 else role, text


def test_query_and_twin(spark, tmp_path):
    rows = list(conversations(8, 150, 9)) + [(7, 3, "user", "Hi.")] * 3
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r[0]: tuple(r) for r in op11_conversation_repair(spark, str(tmp_path)).collect()}
    left = list(damaged(rows))
    for conv in {r[0] for r in rows}:
        assert got[conv][1:] == expected([r[1:] for r in left if r[0] == conv])[0]
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    want = {r[0]: tuple(r) for r in con.sql(twin()).fetchall()}
    assert len(want) == len(got) and want == got
    assert damage(spark.createDataFrame([], SCHEMA)).count() == 0


def test_given_table(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SMALL}/conversations.parquet'")
    assert sorted(con.sql(twin()).fetchall()) == sorted(map(tuple, op11_conversation_repair(spark, SMALL).collect()))
