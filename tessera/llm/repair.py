"""Repair of conversations' structure by edits of least cost.

A backward pass over rows and grammar states gives the least cost still to come, a forward
walk takes among the edits that keep to it the ASCII-least. What the passes read of a row
is one byte; rows are sorted by ranges over all conversations, cut into pieces of bounded
size, and pieces joined by the costs at their ends, so a conversation of any length is
shared by many tasks. Texts take no part until the repaired turns are hashed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: States: nothing yet, after system, after user, after assistant; conversations may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (0, None, None, 0)
#: The role that may be put into each state, and the state it leads to.
NEXT = ((USER, "user"), (USER, "user"), (ASSISTANT, "assistant"), (USER, "user"))
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: A row's byte: its initial's state (0: another role) and its fault times 4.
FINE, TRUNCATED, MUST_GO = 0, 4, 8
INSERT, REROLE, DELETE, UNFINISHED = 3, 3, 4, 3
FAR = 1 << 60


def keeps(code: int, state: int) -> bool:
    role = code & 3
    return bool(role) and (state == START if role == SYSTEM else NEXT[state][0] == role)


def costs(codes: bytes, end: tuple) -> list[list[int]]:
    """The least cost from before each row, and from after the last, in each state, to where ``end`` is the cost of ending in each state."""

    def inserted(at: list[int]) -> list[int]:
        for _ in range(2):  # from any state two insertions reach all states that can be inserted
            at = [min(c, INSERT + at[NEXT[s][0]]) for s, c in enumerate(at)]
        return at

    now = inserted([FAR if e is None else e for e in end])
    out = [now]
    for code in reversed(codes):
        best = []
        for state in range(4):
            ways = [DELETE + now[state]]
            if code < MUST_GO:
                more = UNFINISHED if code & TRUNCATED else 0
                ways.append(REROLE + more + now[NEXT[state][0]])
                if keeps(code, state):
                    ways.append(more + now[code & 3])
            best.append(min(ways))
        now = inserted(best)
        out.append(now)
    return out[::-1]


def walk(codes: bytes, to_go: list[list[int]], end: tuple, state: int) -> tuple[str, int]:
    """The edits' initials from ``state`` on, the ASCII-least of those of least cost, and the state they lead to."""
    edits = []
    at, left = 0, to_go[0][state]
    while True:
        if at == len(codes) and end[state] is not None and left == end[state]:
            return "".join(edits), state
        into = NEXT[state][0]
        code = codes[at] if at < len(codes) else MUST_GO
        if at < len(codes) and left == DELETE + to_go[at + 1][state]:
            edits.append("D")
            at, left = at + 1, left - DELETE
            continue
        if left == INSERT + to_go[at][into]:
            edits.append("I")
            state, left = into, left - INSERT
            continue
        cost = UNFINISHED if code & TRUNCATED else 0
        if keeps(code, state) and left == cost + to_go[at + 1][code & 3]:
            edits.append("K")
            at, left, state = at + 1, left - cost, code & 3
        else:
            edits.append("R")
            at, left, state = at + 1, left - cost - REROLE, into


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows damaged by crc32(``conv_id:turn``) % 20; nulls are one space, but a null turn or conv_id stays one.

    0 drops a row, 1 empties its text, 2 takes ``.!?`` out, 3 has it twice, 4 makes it the user's.
    """
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("dice")).where("dice <> 0")
    text = F.when(F.col("dice") == 1, "").when(F.col("dice") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("dice") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("dice") == 3, 2).otherwise(1).alias("copies"))


KEY = ["conv_id", "role", "d1", "d2"]
PIECE = ["conv_id", "part", "piece"]
STATS = ["blank", "duplicate", "truncated", "illegal"]
PIECES = "conv_id long, part int, piece int, codes binary, role array<string>, d1 array<long>, d2 array<long>, matrix array<long>, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long"


def cut(turns: DataFrame, longest: int) -> DataFrame:
    """The rows of each conversation in order, in pieces of at most ``longest``: a byte, a role and a digest each, and what is counted of them."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ended = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1)).isin(".", "!", "?")
    thin = turns.withColumns({"fault": F.when(blank, MUST_GO).when(ended, FINE).otherwise(TRUNCATED), "d1": F.xxhash64("text"), "d2": F.xxhash64(F.lit(1), "text")})
    seen = thin.groupBy(*KEY, "turn", "fault").agg(F.sum("copies").alias("n"))
    # a mark before the first row of its role and text says that it repeats none
    first = thin.groupBy(*KEY).agg(F.min(F.struct(F.col("turn").isNotNull().alias("there"), "turn")).turn.alias("turn")).withColumns({"fault": F.lit(-1), "n": F.lit(0).cast("long")})
    ordered = seen.unionByName(first).select("conv_id", "turn", "role", "d1", "d2", "fault", "n")
    by = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "d1", "d2"]

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        made: list[tuple] = []
        now, piece, rows, marked, stats = None, 0, [], None, dict.fromkeys(STATS, 0)
        last = last_turn = None
        turn_range: list = []
        turns = 0

        def close() -> None:
            nonlocal piece, rows, stats, turn_range, turns, last
            if not rows:
                return
            codes = bytes(r[0] for r in rows)
            units = [tuple(0 if t == s else None for t in range(4)) for s in range(4)]
            matrix = [c for end in units for c in costs(codes, end)[0]]
            low, high = (turn_range[0], turn_range[-1]) if turn_range else (None, None)
            made.append((now[0], task, piece, codes, *([r[k] for r in rows] for k in (1, 2, 3)), matrix, *(stats[s] for s in STATS), rows[0][1][:1], rows[-1][1][:1], low, high, turns))
            piece, rows, stats, turn_range, turns, last = piece + 1, [], dict.fromkeys(STATS, 0), [], 0, None

        for part in parts:
            for conv, turn, role, d1, d2, fault, n in zip(*(part.column(k).to_pylist() for k in range(7)), strict=True):
                if (conv,) != now:
                    close()
                    now, piece, last_turn = (conv,), 0, None
                if fault < 0:
                    marked = (conv, turn, role, d1, d2)
                    continue
                fresh = marked == (conv, turn, role, d1, d2)
                for k in range(n):
                    if len(rows) == longest:
                        close()
                    twice = fault < MUST_GO and not (fresh and k == 0)
                    rows.append((INITIALS.get(role[:1], 0) | (MUST_GO if twice else fault), role, d1, d2))
                    stats["blank"] += fault == MUST_GO
                    stats["duplicate"] += twice
                    stats["truncated"] += fault == TRUNCATED and not twice
                    stats["illegal"] += last is not None and last + role[:1] not in ("su", "ua", "au")
                    last = role[:1]
                    if turn is not None and (turn != last_turn or not turn_range):
                        turns += turn != last_turn
                        turn_range = [turn_range[0] if turn_range else turn, turn]
                        last_turn = turn
                if len(made) >= 200:
                    yield batch(made, PIECES)
                    made = []
        close()
        yield batch(made, PIECES)

    return ordered.repartitionByRange(*by).sortWithinPartitions(*by, "fault").mapInArrow(scan, PIECES)


def batch(rows: list[tuple], kinds: str) -> pa.RecordBatch:
    """Rows as a batch of the types that a DDL string names."""
    known = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = []
    for field in kinds.split(", "):
        name, kind = field.split(" ")
        fields.append(pa.field(name, pa.list_(known[kind[6:-1]]) if kind.startswith("array") else known[kind]))
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, fields, strict=True)], schema=pa.schema(fields))


def in_turn(pieces: DataFrame, down: bool = False) -> DataFrame:
    """Pieces by conversation, in order or against it; they are read one after the other and none is kept."""
    step = F.desc if down else F.asc
    return pieces.repartition("conv_id").sortWithinPartitions(F.asc("conv_id"), step("part"), step("piece"))


def with_ends(pieces: DataFrame) -> DataFrame:
    """(conv_id, part, piece, ends): the least cost from the end of each piece on, in each state; -1 where there is no way."""
    kinds = "conv_id long, part int, piece int, ends array<long>"

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, end = None, FINAL
        for part in parts:
            made = []
            for conv, task, piece, matrix in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
                if (conv,) != now:
                    now, end = (conv,), FINAL
                made.append((conv, task, piece, [-1 if e is None else e for e in end]))
                ways = np.array(matrix).reshape(4, 4) + np.array([FAR if e is None else e for e in end])[:, None]
                end = tuple(None if c >= FAR else int(c) for c in ways.min(axis=0))
            yield batch(made, kinds)

    return in_turn(pieces.select(*PIECE, "matrix"), down=True).mapInArrow(scan, kinds)


def with_edits(pieces: DataFrame) -> DataFrame:
    """(conv_id, part, piece, cost, edits, exits), each of the last three by the state in which a piece is entered."""
    kinds = "conv_id long, part int, piece int, cost array<long>, edits array<string>, exits array<int>"

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            made = []
            for conv, task, piece, codes, ends in zip(*(part.column(k).to_pylist() for k in range(5)), strict=True):
                end = tuple(None if e < 0 else e for e in ends)
                to_go = costs(codes, end)
                ways = [walk(codes, to_go, end, s) for s in range(4)]
                made.append((conv, task, piece, to_go[0], [w[0] for w in ways], [w[1] for w in ways]))
            yield batch(made, kinds)

    return pieces.select(*PIECE, "codes", "ends").mapInArrow(scan, kinds)


STEPS = "conv_id long, part int, piece int, edits string, entered int, last int, cost long, blank long, duplicate long, truncated long, illegal long, gaps long"


def chained(pieces: DataFrame) -> DataFrame:
    """Each piece with its edits and the state in which it's entered; the counts so far, which are the conversation's where ``last`` is 1."""

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, before = None, None, None
        for part in parts:
            made = []
            for row in part.to_pylist():
                if (row["conv_id"],) != now:
                    if waiting:
                        made.append((*waiting[:5], 1, *waiting[6:]))
                    now, before, state, cost = (row["conv_id"],), None, START, row["cost"][START]
                    sums, low, high, turns = [0] * len(STATS), None, None, 0
                elif waiting:
                    made.append(waiting)
                sums = [a + row[s] for a, s in zip(sums, STATS, strict=True)]
                if before:
                    sums[3] += before["last"] + row["first"] not in ("su", "ua", "au")
                if row["low"] is not None:
                    # a turn that goes on in another task is counted there again
                    turns += row["turns"] - (row["low"] == high and row["part"] != before["part"])
                    low, high = row["low"] if low is None else low, row["high"]
                gaps = 0 if low is None else (high - low + 1 - turns + (1 << 63)) % (1 << 64) - (1 << 63)
                waiting = (row["conv_id"], row["part"], row["piece"], row["edits"][state], state, 0, cost, *sums, gaps)
                before, state = row, row["exits"][state]
            yield batch(made, STEPS)
        if waiting:
            yield batch([(*waiting[:5], 1, *waiting[6:])], STEPS)

    wanted = [*PIECE, "cost", "edits", "exits", *STATS, "first", "last", "low", "high", "turns"]
    return in_turn(pieces.select(*wanted)).mapInArrow(scan, STEPS)


LINES = "conv_id long, part int, piece int, place int, as_role string, role string, d1 long, d2 long"


def lines(pieces: DataFrame) -> DataFrame:
    """A row for each repaired turn: its place, its role, and the role and digest of the row it is made of, null where it is inserted."""

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            made = []
            for row in part.to_pylist():
                at, state = 0, row["entered"]
                for place, edit in enumerate(row["edits"]):
                    into, said = NEXT[state]
                    where = (row["conv_id"], row["part"], row["piece"], place)
                    if edit == "I":
                        made.append((*where, said, None, None, None))
                        state = into
                        continue
                    if edit != "D":
                        role = row["role"][at]
                        made.append((*where, role if edit == "K" else said, role, row["d1"][at], row["d2"][at]))
                        state = INITIALS[role[:1]] if edit == "K" else into
                    at += 1
                if len(made) > 50_000:
                    yield batch(made, LINES)
                    made = []
            yield batch(made, LINES)

    return pieces.select(*PIECE, "role", "d1", "d2", "edits", "entered").mapInArrow(scan, LINES)


def digests(said: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of turns by place; a digest is of bytes in order, so a conversation's turns stream through one task, which keeps none of them."""
    kinds = "conv_id long, repaired_sha256 string"

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for part in parts:
            made = []
            for conv, role, text in zip(*(part.column(c).to_pylist() for c in ("conv_id", "as_role", "text")), strict=True):
                if (conv,) != now:
                    if now:
                        made.append((*now, digest.hexdigest()))
                    now, digest = (conv,), hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            yield batch(made, kinds)
        if now:
            yield batch([(*now, digest.hexdigest())], kinds)

    return said.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece", "place").mapInArrow(scan, kinds)


def text_keys() -> list:
    return ["conv_id", "role", F.xxhash64("text").alias("_d1"), F.xxhash64(F.lit(1), "text").alias("_d2")]


def repaired(turns: DataFrame, longest: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Of turns (conv_id, turn, role, text, copies): (conv_id, part, piece, place, as_role, text), the repaired turns in order, and (conv_id, audit, cost, gaps, blank, duplicate, truncated, illegal).

    Rows of a conversation are ordered by turn (null first), then role, then a digest of the
    text; ``copies`` of a row stand together. Equal rows are counted before they are dealt.
    Pieces of at most ``longest`` rows are what a task holds of a conversation.
    """
    work = Workspace(turns.sparkSession, "repair")
    pieces = work.save(cut(turns, longest), "pieces")

    def beside(more: DataFrame) -> DataFrame:
        named = more.withColumnsRenamed({c: f"_{c}" for c in PIECE})
        on = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("part") == F.col("_part")) & (F.col("piece") == F.col("_piece"))
        return pieces.drop(*(c for c in more.columns if c not in PIECE)).join(named, on).drop(*(f"_{c}" for c in PIECE))

    ways = work.save(with_edits(beside(with_ends(pieces))), "ways")
    steps = work.save(chained(beside(ways)), "steps")
    whole = [F.max(F.when(F.col("last") == 1, F.col(c))).alias(c) for c in ("cost", "gaps", *STATS)]
    inside = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "piece", "edits"))), lambda x: x["edits"]), "")
    totals = steps.groupBy("conv_id").agg(inside.alias("audit"), *whole)
    made = lines(beside(steps.select(*PIECE, "edits", "entered")))
    texts = turns.groupBy(*text_keys()).agg(F.min("text").alias("text")).withColumnsRenamed({"conv_id": "_conv_id", "role": "_role"})
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("role") == F.col("_role")) & (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2"))
    wanted = [*PIECE, "place", "as_role"]
    kept = made.where("role is not null").join(texts, same).select(*wanted, "text")
    return kept.unionByName(made.where("role is null").select(*wanted, F.lit("").alias("text"))), totals



def digest(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conv_id of turns (conv_id, turn, role, text), damaged and repaired.

    Null roles and texts are one space; rows of a null conv_id are one conversation; null
    turns come first. Rows that repeat another are duplicates of it, blank ones blank. A
    conversation of which no row is left has zeros and no edits; an empty table has none.
    Differences of turns beyond 64 bits wrap.
    """
    known = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said, totals = repaired(damaged(known))
    every = known.select("conv_id").distinct()
    same = lambda name: F.col("conv_id").eqNullSafe(F.col(name))
    both = every.join(totals.withColumnRenamed("conv_id", "_a"), same("_a"), "left").join(digests(said).withColumnRenamed("conv_id", "_b"), same("_b"), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *STATS, "cost")]
    return both.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
