"""Conversation repair: cheapest edits to a legal order of turns, reconstructed in linear space."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import SPACE_CHARS, TEXTS_A_BATCH, written

# States: nothing yet, after the system turn, after a user turn, after an assistant turn.
NEXT_ROLE = ("user", "user", "assistant", "user")  # what may be inserted or a row's role set to; a state allows one
NEXT_STATE = (2, 2, 3, 2)
FAR = 1 << 50
# Codes of rows: initial of the role, then flags.
INITIALS = {"s": 0, "u": 1, "a": 2}
OTHER, FORCED, STOPPED = 3, 4, 8
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 3, 4, 3, 3
WORDS = ("D", "IK", "IR", "K", "R")  # edits of one row in ASCII order; none begins another
#: Cost and edits from each state to the end of a conversation.
ENDINGS = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))


@cache
def moves(code: int) -> tuple[tuple[int, int, int, int], ...]:
    """(from, to, cost, word) of the cheapest way, the least word of equals, between each two states over one row.

    An insertion stands before the row that follows it and never before a
    deletion: "D" first costs the same and is the lesser audit. More than one
    insertion at a place only leads back to the state before.
    """
    best: dict[tuple[int, int], tuple[int, int]] = {(s, s): (DELETE, 0) for s in range(4)}
    if not code & FORCED:
        late = UNFINISHED if code & STOPPED else 0
        for s in range(4):
            for inserted, at in ((0, s), (1, NEXT_STATE[s])):
                ways = [(NEXT_STATE[at], REROLE, WORDS.index("IR" if inserted else "R"))]
                kept = {0: 1 if at == 0 and not inserted else None, 1: 2 if at != 2 else None, 2: 3 if at == 2 else None}.get(code & 3)
                if kept is not None:
                    ways.append((kept, KEEP, WORDS.index("IK" if inserted else "K")))
                for to, cost, word in ways:
                    way = (cost + INSERT * inserted + late, word)
                    best[s, to] = min(best.get((s, to), (FAR, 0)), way)
    return tuple((s, to, cost, word) for (s, to), (cost, word) in sorted(best.items()))


def forward(codes: bytes, extra: np.ndarray, lo: int, hi: int, start: int) -> tuple[list[int], list[int]]:
    """Cost of the cheapest edits from ``start`` before row lo to each state after row hi-1, and the order of their least audits.

    Two audits differ first at an edit that both have, so their order stays
    whatever follows; ranks are all that must be carried.
    """
    cost, rank = [FAR] * 4, [0] * 4
    cost[start] = 0
    for i in range(lo, hi):
        new, by = [FAR] * 4, [0] * 4
        for s, to, c, word in moves(codes[i]):
            if cost[s] < FAR:
                v, r = cost[s] + c, rank[s] * 8 + word
                if v < new[to] or (v == new[to] and r < by[to]):
                    new[to], by[to] = v, r
        order = sorted(by)
        more = DELETE * int(extra[i])
        cost, rank = [v + more if v < FAR else FAR for v in new], [order.index(r) for r in by]
    return cost, rank


def backward(codes: bytes, extra: np.ndarray, lo: int, hi: int, end: int) -> list[int]:
    """Cost of the cheapest edits from each state before row lo to ``end`` after row hi-1."""
    cost = [FAR] * 4
    cost[end] = 0
    for i in range(hi - 1, lo - 1, -1):
        new = [FAR] * 4
        for s, to, c, _ in moves(codes[i]):
            new[s] = min(new[s], c + cost[to])
        more = DELETE * int(extra[i])
        cost = [v + more if v < FAR else FAR for v in new]
    return cost


def crossing(before: tuple[list[int], list[int]], after: list[int]) -> int:
    """State in the middle of the cheapest edits, of equals that of the least audit."""
    return min((f + b, r, s) for s, (f, r, b) in enumerate(zip(*before, after, strict=True)))[2]


def audit(codes: bytes, extra: np.ndarray, lo: int, hi: int, start: int, end: int) -> Iterator[str]:
    """Pieces of the least audit between two states, by Hirschberg's halving: cost vectors from both ends meet in the middle."""
    if hi - lo == 1:
        word = next(w for s, to, _, w in moves(codes[lo]) if (s, to) == (start, end))
        yield WORDS[word]
        if extra[lo]:
            yield "D" * int(extra[lo])
    elif hi > lo:
        mid = (lo + hi) // 2
        state = crossing(forward(codes, extra, lo, mid, start), backward(codes, extra, mid, hi, end))
        yield from audit(codes, extra, lo, mid, start, state)
        yield from audit(codes, extra, mid, hi, state, end)


def last_state(cost: list[int], rank: list[int]) -> int:
    """The state after the last row of the cheapest conversation."""
    return min((c + ENDINGS[s][0], r, s) for s, (c, r) in enumerate(zip(cost, rank, strict=True)))[2]


def blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def stopped(text: Column) -> Column:
    return ~F.right(F.rtrim(text, F.lit(SPACE_CHARS)), F.lit(1)).isin(".", "!", "?")


def turns(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text, copies: null roles and texts are one space, every row stands once."""
    space = F.lit(" ")
    return df.select(df[id_col].alias("conv_id"), df[turn_col].cast("bigint").alias("turn"), F.coalesce(df[role_col], space).alias("role"), F.coalesce(df[text_col], space).alias("text"), F.lit(1).cast("bigint").alias("copies"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of :func:`turns` damaged by crc32(`conv_id:turn`) % 20; dropped rows have no ``copies``, repeated ones two."""
    part = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    text = F.when(part == 1, F.lit("")).when(part == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(part == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(part == 0, F.lit("")).otherwise(text).alias("text"),
        (F.col("copies") * F.when(part == 0, 0).when(part == 3, 2).otherwise(1)).alias("copies"),
    )


def _digest() -> Column:
    return F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))


def coded(rows: DataFrame) -> DataFrame:
    """One short row for equal rows of a turn: conv_id, turn, role, digest, code, copies, without texts."""
    flags = F.when(blank(F.col("text")), FORCED).when(stopped(F.col("text")), STOPPED).otherwise(0)
    initial = F.left("role", F.lit(1))
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER)
    short = rows.where("copies > 0").select("conv_id", "turn", "role", _digest().alias("digest"), initial.alias("initial"), code.alias("code"), flags.alias("flags"), "copies")
    once = short.groupBy("conv_id", "turn", "role", "digest").agg(F.first("initial").alias("initial"), F.first("code").alias("code"), F.first("flags").alias("flags"), F.sum("copies").alias("copies"))
    once = written(once, "turns")
    place = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn"))
    seen = once.groupBy("conv_id", "digest").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1").select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), "first")
    both = once.join(seen, once["conv_id"].eqNullSafe(seen["_conv"]) & (once["digest"] == seen["_digest"]), "left")
    later = F.coalesce(place > F.col("first"), F.lit(False))
    return both.select("conv_id", "turn", "role", "digest", "initial", "code", "flags", later.alias("later"), "copies")


_RUN = (
    "seq bigint, closed boolean, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, low bigint, high bigint, turns bigint, "
    "cost bigint, audit string, codes binary, extra array<bigint>, costs array<bigint>, ranks array<bigint>"
)


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def _run_row(cols: dict[str, list], seq: int, closed: bool) -> dict:
    """Counts of a run of neighbouring rows of one conversation, with its audit if it is the whole one, else its costs from each state to each."""
    flags, copies, initials = cols["flags"], cols["copies"], cols["initial"]
    forced = [f == FORCED or d for f, d in zip(flags, cols["later"], strict=True)]
    codes = bytes(c | (FORCED if x else f) for c, f, x in zip(cols["code"], flags, forced, strict=True))
    extra = np.array(copies, np.int64) - 1
    given = [t for t in cols["turn"] if t is not None]
    row = {
        "conv_id": cols["conv_id"][0],
        "seq": seq,
        "closed": closed,
        "blank": sum(n for f, n in zip(flags, copies, strict=True) if f == FORCED),
        "duplicate": sum(n - (not d) for f, d, n in zip(flags, cols["later"], copies, strict=True) if f != FORCED),
        "truncated": sum(f == STOPPED and not d for f, d in zip(flags, cols["later"], strict=True)),
        "illegal": int(extra.sum()) + sum(not _legal(a, b) for a, b in zip(initials, initials[1:])),
        "first": initials[0],
        "last": initials[-1],
        "low": given[0] if given else None,
        "high": given[-1] if given else None,
        "turns": 1 + sum(a != b for a, b in zip(given, given[1:])) if given else 0,
        "cost": None, "audit": None, "codes": None, "extra": None, "costs": None, "ranks": None,
    }
    n = len(codes)
    if closed:
        whole = forward(codes, extra, 0, n, 0)
        end = last_state(*whole)
        row["cost"] = whole[0][end] + ENDINGS[end][0]
        row["audit"] = "".join(audit(codes, extra, 0, n, 0, end)) + ENDINGS[end][1]
    else:
        ways = [forward(codes, extra, 0, n, s) for s in range(4)]
        row |= {"codes": codes, "extra": extra.tolist(), "costs": [c for w in ways for c in w[0]], "ranks": [r for w in ways for r in w[1]]}
    return row


def runs(short: DataFrame, most: int = 1 << 20) -> DataFrame:
    """Runs of neighbouring rows: a row for each conversation of a range of rows, cut after ``most`` distinct rows.

    Conversations at the ends of a range may go on in the next one and are
    left open, so one conversation of any share of all rows is dealt over
    many tasks.
    """
    kind = short.schema["conv_id"].dataType.simpleString()
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    ranged = short.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    schema = pa.schema([("conv_id", pa.null())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal schema
        held: dict[str, list] = {}
        rows: list[dict] = []
        cut = seq = 0
        opening = True  # the first conversation of a range may have begun before

        def close(last: bool, more: bool = False) -> None:
            nonlocal held, opening, cut, seq
            rows.append(_run_row(held, seq, not (opening or last or more or cut)))
            opening = opening and more
            cut, held, seq = (1 if more else 0), {}, seq + 1

        for batch in batches:
            if not batch.num_rows:
                continue
            if not seq:
                seq = batch.column("part")[0].as_py() << 40
            cols = {c: batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "code", "flags", "later", "copies")}
            ids = cols["conv_id"]
            edges = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
            for lo, hi in zip(edges, edges[1:]):
                if held and held["conv_id"][0] != ids[lo]:
                    close(False)
                while lo < hi:
                    room = most - len(held.get("conv_id", ()))
                    for c, v in cols.items():
                        held.setdefault(c, []).extend(v[lo : min(hi, lo + room)])
                    lo = min(hi, lo + room)
                    if len(held["conv_id"]) >= most:
                        close(False, more=True)
            if len(rows) >= 2000:
                yield as_batch(rows, batch.schema.field("conv_id").type)
                rows = []
            schema = batch.schema
        if held:
            close(True)
        if rows:
            yield as_batch(rows, schema.field("conv_id").type)

    return ranged.mapInArrow(run, f"conv_id {kind}, {_RUN}")


_RUN_TYPES = {
    "seq": pa.int64(), "closed": pa.bool_(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(), "first": pa.string(), "last": pa.string(),
    "low": pa.int64(), "high": pa.int64(), "turns": pa.int64(), "cost": pa.int64(), "audit": pa.string(), "codes": pa.binary(), "extra": pa.list_(pa.int64()), "costs": pa.list_(pa.int64()), "ranks": pa.list_(pa.int64()),
}


def as_batch(rows: list[dict], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"conv_id": pa.array([r["conv_id"] for r in rows], kind)} | {c: pa.array([r[c] for r in rows], t) for c, t in _RUN_TYPES.items()})


def _meet(segments: list[dict]) -> tuple[int, list[int]]:
    """Cost of a conversation of several segments and the states between them (one more than there are segments), by the same halving."""
    costs = [np.array(s["costs"]).reshape(4, 4).tolist() for s in segments]
    ranks = [np.array(s["ranks"]).reshape(4, 4).tolist() for s in segments]

    def ahead(lo: int, hi: int, start: int) -> tuple[list[int], list[int]]:
        cost, rank = [FAR if s != start else 0 for s in range(4)], [0] * 4
        for c, r in zip(costs[lo:hi], ranks[lo:hi], strict=True):
            ways = [min(((cost[p] + c[p][s], rank[p] * 8 + r[p][s]) for p in range(4) if cost[p] < FAR and c[p][s] < FAR), default=(FAR, 0)) for s in range(4)]
            order = sorted(w[1] for w in ways)
            cost, rank = [w[0] for w in ways], [order.index(w[1]) for w in ways]
        return cost, rank

    def back(lo: int, hi: int, end: int) -> list[int]:
        cost = [FAR if s != end else 0 for s in range(4)]
        for c in reversed(costs[lo:hi]):
            cost = [min(FAR, *(c[s][t] + cost[t] for t in range(4))) for s in range(4)]
        return cost

    def between(lo: int, hi: int, start: int, end: int) -> list[int]:
        if hi - lo < 2:
            return []
        mid = (lo + hi) // 2
        state = crossing(ahead(lo, mid, start), back(mid, hi, end))
        return [*between(lo, mid, start, state), state, *between(mid, hi, state, end)]

    whole = ahead(0, len(segments), 0)
    end = last_state(*whole)
    return whole[0][end] + ENDINGS[end][0], [0, *between(0, len(segments), 0, end), end]


_TOTALS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"


def audits(short: DataFrame, most: int = 1 << 20) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation of ``coded`` rows.

    Conversations within one range are done there. Of the others (two in a
    range at most, and long ones) each range sends costs from each state to
    each; the crossings between ranges are chosen from these, and each range
    then finds its own piece of the audit.
    """
    kind = short.schema["conv_id"].dataType.simpleString()
    found = written(runs(short, most), "runs")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0).cast("bigint"))
    closed = found.where("closed").select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for parts in batch.column("parts").to_pylist():
                cost, states = _meet(parts)
                given = [p for p in parts if p["turns"]]
                distinct = sum(p["turns"] for p in given) - sum(a["high"] == b["low"] for a, b in zip(given, given[1:]))
                row = {c: sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated", "illegal")}
                row["illegal"] += sum(not _legal(a["last"], b["first"]) for a, b in zip(parts, parts[1:]))
                row |= {"gaps": given[-1]["high"] - given[0]["low"] + 1 - distinct if given else 0, "cost": cost}
                rows.append(row | {"at": [{"seq": p["seq"], "start": s, "end": t, "last": k == len(parts) - 1} for k, (p, s, t) in enumerate(zip(parts, states, states[1:], strict=False))]})
            at = pa.list_(pa.struct([("seq", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("last", pa.bool_())]))
            names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
            yield pa.RecordBatch.from_pydict({"conv_id": batch.column("conv_id")} | {c: pa.array([r[c] for r in rows], pa.int64()) for c in names} | {"at": pa.array([r["at"] for r in rows], at)})

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = []
            for r in batch.select(["start", "end", "last", "codes", "extra"]).to_pylist():
                pieces.append("".join(audit(r["codes"], np.array(r["extra"]), 0, len(r["codes"]), r["start"], r["end"])) + (ENDINGS[r["end"]][1] if r["last"] else ""))
            yield pa.RecordBatch.from_pydict({"conv_id": batch.column("conv_id"), "seq": batch.column("seq"), "piece": pa.array(pieces, pa.string())})

    part = F.struct("seq", "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns", "costs", "ranks")
    open_ = found.where("NOT closed")
    met = open_.groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    met = written(met.mapInArrow(meet, f"conv_id {kind}, {_TOTALS}, at array<struct<seq:bigint,start:int,end:int,last:boolean>>"), "met")
    ways = met.select(F.explode("at").alias("at")).select("at.*")
    pieces = open_.select("conv_id", "seq", "codes", "extra").join(ways, "seq").mapInArrow(solve, f"conv_id {kind}, seq bigint, piece string")
    joined = pieces.groupBy(F.col("conv_id").alias("_conv")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "piece"))), lambda p: p["piece"]), "").alias("audit"))
    whole = met.drop("at").join(joined, met["conv_id"].eqNullSafe(joined["_conv"])).drop("_conv")
    return closed.unionByName(whole)


def repaired(rows: DataFrame) -> DataFrame:
    """Turns after repair, preceded by a row of totals for each conversation.

    conv_id, place, edit, role, text and the totals with the audit, which only
    the row of place -1 has. The rows of a conversation follow each other in
    one partition: each row meets its edits there in one pass over the sorted
    rows, of which no more than a batch is held.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    nothing = [F.lit(None).cast("string" if c == "audit" else "bigint").alias(c) for c in names]
    said = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", F.when(F.col("copies") > 0, _digest()).alias("digest"), F.col("text"), "copies", *nothing)
    heads = written(audits(coded(rows)), "audits").select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.lit("").alias("text"), F.lit(0).cast("bigint").alias("copies"), *names)
    order = [F.col("conv_id").asc_nulls_first(), "kind", F.col("turn").asc_nulls_first(), "role", "digest"]
    stream = heads.unionByName(said).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "kind", "role", "text", "copies", *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, current, state, edits, place = False, None, 0, "", 0
        at = 0
        for batch in batches:
            ids, places, done, roles, texts, heads_ = [], [], [], [], [], []

            def put(edit: str, role: str, text: str) -> None:
                nonlocal place
                ids.append(current), places.append(place), done.append(edit), roles.append(role), texts.append(text), heads_.append(None)
                place += 1

            def insert() -> None:
                nonlocal state, at
                while at < len(edits) and edits[at] == "I":
                    role = NEXT_ROLE[state]
                    state, at = NEXT_STATE[state], at + 1
                    put("I", role, "")

            columns = {c: batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text", "copies", *names)}
            for k, conv in enumerate(columns["conv_id"]):
                if not known or conv != current:
                    if known:
                        insert()
                    known, current, state, place, at, edits = True, conv, 0, 0, 0, ""
                    head = {c: columns[c][k] for c in names} if columns["kind"][k] == 0 else dict.fromkeys(names, 0) | {"audit": ""}
                    edits = head["audit"]
                    ids.append(conv), places.append(-1), done.append(None), roles.append(None), texts.append(None), heads_.append(head)
                    if columns["kind"][k] == 0:
                        continue
                for _ in range(columns["copies"][k]):
                    insert()
                    edit, at = edits[at], at + 1
                    if edit == "K":
                        role = columns["role"][k]
                        state = INITIALS[role[0]] + 1
                        put(edit, role, columns["text"][k])
                    elif edit == "R":
                        role = NEXT_ROLE[state]
                        state = NEXT_STATE[state]
                        put(edit, role, columns["text"][k])
            # The last conversation may go on; what may be inserted at its end comes with the next batch, or below.
            yield out(batch.schema.field("conv_id").type, ids, places, done, roles, texts, heads_)
            id_type = batch.schema.field("conv_id").type
        if known:
            ids, places, done, roles, texts, heads_ = [], [], [], [], [], []
            while at < len(edits):
                ids.append(current), places.append(place), done.append("I"), roles.append(NEXT_ROLE[state]), texts.append(""), heads_.append(None)
                state, at, place = NEXT_STATE[state], at + 1, place + 1
            yield out(id_type, ids, places, done, roles, texts, heads_)

    def out(kind_: pa.DataType, ids, places, done, roles, texts, heads_) -> pa.RecordBatch:
        plain = {"conv_id": pa.array(ids, kind_), "place": pa.array(places, pa.int64()), "edit": pa.array(done, pa.string()), "role": pa.array(roles, pa.string()), "text": pa.array(texts, pa.string())}
        return pa.RecordBatch.from_pydict(plain | {c: pa.array([h and h[c] for h in heads_], pa.string() if c == "audit" else pa.int64()) for c in names})

    return stream.mapInArrow(run, f"conv_id {kind}, place bigint, edit string, role string, text string, {_TOTALS}, audit string")


def repaired_turns(df: DataFrame, **columns: str) -> DataFrame:
    """conv_id, place, edit, role, text of the repaired conversations of ``df`` (columns named as in :func:`turns`)."""
    return repaired(turns(df, **columns)).where("place >= 0").select("conv_id", "place", "edit", "role", "text")


def repair_report(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of ``rows`` (as of :func:`turns`).

    A row is blank without a character other than white space, else duplicate
    if its role and text were seen before, else truncated if its last such
    character is no ``.``, ``!`` or ``?``. Null roles and texts are one space;
    null turns come first, rows of one turn go by role and then by the MD5 of
    role and text; null ids are one conversation; rows without ``copies``
    only name their conversation, which has zeros and no audit if it has no
    others. An empty table gives no rows; other columns are ignored. Equal
    rows of a turn are counted before they are moved. A conversation's audit
    and the digest of its texts are single values, so its texts pass one task
    in order, a batch at a time; all that decides on edits is dealt out.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, digest, id_type = None, None, pa.null()
        for batch in batches:
            ready = []
            id_type = batch.schema.field("conv_id").type
            columns = {c: batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text", *names)}
            for k, place in enumerate(columns["place"]):
                if place < 0:
                    if head is not None:
                        ready.append(head | {"repaired_sha256": digest.hexdigest()})
                    head, digest = {c: columns[c][k] for c in ("conv_id", *names)}, hashlib.sha256()
                else:
                    digest.update(f"{chr(10) if place else ''}{columns['role'][k]}:{columns['text'][k]}".encode())
            if ready:
                yield report(ready, id_type)
        if head is not None:
            yield report([head | {"repaired_sha256": digest.hexdigest()}], id_type)

    def report(ready: list[dict], id_type: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"conv_id": pa.array([r["conv_id"] for r in ready], id_type)} | {c: pa.array([r[c] for r in ready], pa.string() if c in ("audit", "repaired_sha256") else pa.int64()) for c in (*names, "repaired_sha256")})

    found = repaired(rows).mapInArrow(run, f"conv_id {kind}, {_TOTALS}, audit string, repaired_sha256 string")
    return written(found, "repaired", TEXTS_A_BATCH)
