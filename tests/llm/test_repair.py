"""Conversation repair against an exhaustive search and a plain pass."""

import hashlib
import heapq
import random
import zlib

import pytest

from gridloom.llm import repair
from gridloom.llm.repair import audits, coded, damaged, repair_report, repaired_turns, turns

SCHEMA = "conv_id bigint, turn bigint, role string, text string, place string"
COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def legal(roles: str) -> bool:
    rest = roles[1:] if roles[:1] == "s" else roles
    return roles == "" or (rest != "" and rest == "ua" * (len(rest) // 2))


def searched(rows):
    """Least (cost, audit, lines) by best-first search over all edits, insertions of both roles anywhere included."""
    seen = set()
    heap = [(0, "", 0, ())]
    while heap:
        cost, audit, k, lines = heapq.heappop(heap)
        roles = "".join(x[0] for x in lines)
        if k == len(rows) and legal(roles):
            return cost, audit, lines
        key = (audit, k, lines)
        if key in seen or len(audit) > 2 * len(rows) + 3:
            continue
        seen.add(key)
        step = [("I", 3, k, f"{r}:") for r in ("user", "assistant")]
        if k < len(rows):
            role, text, forced, late = rows[k]
            step.append(("D", 4, k + 1, None))
            if not forced:
                step.append(("K", late, k + 1, f"{role}:{text}"))
                step += [("R", 3 + late, k + 1, f"{r}:{text}") for r in ("user", "assistant")]
        for letter, c, to, line in step:
            new = lines if line is None else (*lines, line)
            r = "".join(x[:1] or "?" for x in new)
            if r == "" or legal(r) or legal(r + "a") or legal(r + "ua"):
                heapq.heappush(heap, (cost + c, audit + letter, to, new))


def marked(rows):
    """(role, text, forced, late) and counts of rows in order."""
    seen, out, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        out.append((role, text, fault in ("blank", "duplicate"), 3 * (fault == "truncated")))
    return out, counts


def passed(rows):
    """Least (cost, audit, lines) by one forward pass that carries the audits."""
    start = {0: (0, "", ())}
    role_of = {0: "user", 1: "user", 2: "assistant", 3: "user"}
    after = {0: 2, 1: 2, 2: 3, 3: 2}
    for role, text, forced, late in rows:
        opened = dict(start)
        for s, (c, a, x) in start.items():
            opened[after[s]] = min(opened.get(after[s], (10**9,)), (c + 3, a + "I", (*x, f"{role_of[s]}:")))
        new = {s: (c + 4, a + "D", x) for s, (c, a, x) in start.items()}
        if not forced:
            for source in (start, opened):
                for s, (c, a, x) in source.items():
                    ways = [(after[s], (c + 3 + late, a + "R", (*x, f"{role_of[s]}:{text}")))]
                    if role[:1] == role_of[s][:1]:
                        ways.append((after[s], (c + late, a + "K", (*x, f"{role}:{text}"))))
                    if role[:1] == "s" and s == 0:
                        ways.append((1, (c + late, a + "K", (*x, f"{role}:{text}"))))
                    for t, w in ways:
                        new[t] = min(new.get(t, (10**9,)), w)
        start = new
    ends = [start[s] for s in (0, 3) if s in start]
    if 1 in start:
        c, a, x = start[1]
        ends.append((c + 6, a + "II", (*x, "user:", "assistant:")))
    if 2 in start:
        c, a, x = start[2]
        ends.append((c + 3, a + "I", (*x, "assistant:")))
    return min(ends)


def expected(rows, solve=passed):
    """Row of totals of one conversation of (turn, role, text)."""
    if not rows:
        return {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
    said, counts = marked([r[1:] for r in order])
    cost, audit, lines = solve(said)
    given = {t for t, *_ in rows if t is not None}
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(order, order[1:]))
    gaps = max(given) - min(given) + 1 - len(given) if given else 0
    return counts | {"gaps": gaps, "illegal": illegal, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


TEXTS = ["Yes.", "no", "", "  \n", "Why?", "Ok!  ", "x", "a.b"]
ROLES = ["system", "user", "assistant", "tool", "", "user", "assistant"]


def conversation(rng, n, few=True):
    out = []
    for t in range(n):
        text = rng.choice(TEXTS) if few else rng.choice([f"t{rng.random()}.", "same.", "", f"cut{rng.random()}"])
        out.append((rng.choice([t, t, t, t + 1, None]), rng.choice(ROLES), text))
    return out


def got_rows(df):
    return {r["conv_id"]: {c: r[c] for c in COLUMNS} for r in df.collect()}


def test_small_conversations_equal_exhaustive_search(spark):
    rng = random.Random(4)
    convs = {i: conversation(rng, rng.randint(1, 5)) for i in range(120)}
    rows = [(i, *r, "x") for i, c in convs.items() for r in c]
    rng.shuffle(rows)
    got = got_rows(repair_report(turns(spark.createDataFrame(rows, SCHEMA).repartition(7))))
    assert got == {i: expected(c, searched) for i, c in convs.items()}
    assert got == {i: expected(c) for i, c in convs.items()}


@pytest.mark.parametrize("parts,most", [(9, 1 << 20), (5, 7)])
def test_long_conversations_are_divided(spark, parts, most):
    rng = random.Random(parts)
    convs = {1: conversation(rng, 5, False), 2: conversation(rng, 700, False), 3: conversation(rng, 300, False), 4: conversation(rng, 1), None: conversation(rng, 40)}
    rows = [(i, *r, "x") for i, c in convs.items() for r in c]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r["conv_id"]: r.asDict() for r in audits(coded(turns(spark.createDataFrame(rows, SCHEMA))), most).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    for i, c in convs.items():
        want = expected(c)
        assert {k: got[i][k] for k in COLUMNS[:-1]} == {k: want[k] for k in COLUMNS[:-1]}


def test_repaired_turns_and_digest(spark):
    rng = random.Random(8)
    convs = {i: conversation(rng, rng.randint(1, 30)) for i in range(20)}
    df = spark.createDataFrame([(i, *r, "x") for i, c in convs.items() for r in c], SCHEMA)
    by = {}
    for r in repaired_turns(df).collect():
        by.setdefault(r["conv_id"], []).append((r["place"], r["edit"], r["role"], r["text"]))
    for i, c in convs.items():
        want = expected(c)
        mine = sorted(by.get(i, []))
        assert [p for p, *_ in mine] == list(range(len(mine)))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for _, _, r, t in mine).encode()).hexdigest() == want["repaired_sha256"]
        assert "".join(e for _, e, *_ in mine) == want["audit"].replace("D", "")
        assert legal("".join(r[0] for _, _, r, _ in mine))


def test_damage_and_edge_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair_report(damaged(turns(empty))).collect() == []
    rows = [(i, t, "user" if t % 2 == 0 else "assistant", f"Text {t}. Ok", "x") for i in range(40) for t in range(6)]
    rows += [(100, None, None, None, None), (100, None, "user", "Hi.", None), (100, None, "user", "Hi.", None), (None, 3, "user", "q?", None), (None, None, "assistant", "Yes", None)]
    gone = next(i for i in range(1000, 9000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "lost.", None))
    want = {}
    for i in {r[0] for r in rows}:
        hurt = []
        for _, t, role, text, _ in (r for r in rows if r[0] == i):
            role, text = role if role is not None else " ", text if text is not None else " "
            d = zlib.crc32(f"{' ' if i is None else i}:{' ' if t is None else t}".encode()) % 20
            if d == 0:
                continue
            text = "" if d == 1 else text.translate({ord(c): None for c in ".!?"}) if d == 2 else text
            hurt += [(t, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
        want[i] = expected(hurt)
    got = got_rows(repair_report(damaged(turns(spark.createDataFrame(rows, SCHEMA)))))
    assert got == want and got[gone]["audit"] == ""


def test_many_equal_rows_of_a_turn(spark):
    rows = [(1, 0, "user", "Hi.", "x")] * 500 + [(1, 1, "assistant", "Yes.", "x")] * 3
    got = got_rows(repair_report(turns(spark.createDataFrame(rows, SCHEMA))))
    assert got[1]["audit"] == "K" + "D" * 499 + "KDD" and got[1] == expected([r[1:4] for r in rows])
    assert coded(turns(spark.createDataFrame(rows, SCHEMA))).count() == 2


def test_moves_are_prefix_free():
    assert all(not b.startswith(a) for a in repair.WORDS for b in repair.WORDS if a != b) and list(repair.WORDS) == sorted(repair.WORDS)
