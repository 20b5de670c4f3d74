"""Conversations brought into the order  system? (user assistant)+  by the cheapest edits.

A row's first fault counts: blank (only white space), duplicate (its role and text were there before in
the conversation), truncated (its last visible character ends no sentence).  Keep costs 0, a new role
(user or assistant) 3, Delete 4 and is the only way for blank and duplicate rows, an inserted empty row
3; a truncated row that stays costs 3 more.  Of equally cheap edits the ASCII-least letters (D I K R) win.

Rows become one-byte symbols of role and fault without their texts.  Spark sorts the symbols by range, so
that a long conversation lies over many tasks, and each task collapses its runs.  The runs of a
conversation, never more than the letters of its audit, meet in one task.  There costs to go are carried
backwards: a run of n equal symbols is advanced through cached binary powers of the symbol's 4 x 4
min-plus transition, and the choices are unrolled forwards in slices, so the vectors kept are bounded.
States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.  Texts are shuffled once, after
the plan is there, and stream behind their conversation's audit.

Null roles and texts are one space; null conversation ids are one conversation; null turns come first and
count in no gap.  Rows of one turn are ordered by role, then by a hash of the text; equal rows are
neighbours, of which all but one are duplicates.  An empty role has no initial and is replaced or deleted.
Very long texts are only hashed and looked at from their end.  Other columns are left out and never clash.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import parts_for, written

WHITE = " \t\n\x0b\f\r"
SLICE = 1024  # symbols whose costs to go are held at once while choices are unrolled
ROW_BYTES = 8 << 20  # stored bytes of the input a task sorts

RE_ROLE, DELETE, INSERT, CUT = 3, 4, 3, 3  # costs
FAR = 1 << 60
INITIALS = "sua"  # role classes 0, 1, 2; 3 is any other
FINE, TRUNCATED, DUPLICATE, BLANK = range(4)
INSERTED = (2, 2, 3, 2)  # the state that an insertion leads to
KEPT = ({0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2})  # state -> role class -> state
LEGAL = {(0, 1), (1, 2), (2, 1)}
ROLE_OF = {2: "user", 3: "assistant"}  # what an inserted or renamed row that leads to a state says
END = (0, 2 * INSERT, INSERT, 0)  # cost from a state to an allowed end

Matrix = tuple[tuple[int, ...], ...]


def times(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product."""
    return tuple(tuple(min(x + b[k][j] for k, x in enumerate(row)) for j in range(4)) for row in a)


def apply(a: Matrix, v: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(x + y for x, y in zip(row, v)) for row in a)


@lru_cache(maxsize=None)
def options(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of a row, letters ascending."""
    role, fault = divmod(symbol, 4)
    out = [("D", DELETE, state)]
    if fault in (FINE, TRUNCATED):
        more = CUT if fault == TRUNCATED else 0
        if role in KEPT[state]:
            out.append(("K", more, KEPT[state][role]))
        out.append(("R", RE_ROLE + more, INSERTED[state]))
    return out


@lru_cache(maxsize=4096)
def power(symbol: int, k: int) -> Matrix:
    """The transition of 2**k rows of a symbol: costs from the state before them to the state behind them, insertions included."""
    if k:
        half = power(symbol, k - 1)
        return times(half, half)
    inserted = tuple(tuple(0 if s == t else INSERT if INSERTED[s] == t else 2 * INSERT if INSERTED[INSERTED[s]] == t else FAR for t in range(4)) for s in range(4))
    edit = [[FAR] * 4 for _ in range(4)]
    for s in range(4):
        for _, cost, t in options(symbol, s):
            edit[s][t] = min(edit[s][t], cost)
    return times(inserted, tuple(map(tuple, edit)))


def before(symbol: int, n: int, v: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go before n rows of a symbol, from those behind them."""
    k = 0
    while n:
        if n & 1:
            v = apply(power(symbol, k), v)
        n, k = n >> 1, k + 1
    return v


def plan(symbols: np.ndarray, lengths: np.ndarray) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of a conversation, given as runs."""
    runs = list(zip(symbols.tolist(), lengths.tolist()))
    behind = [END]
    for symbol, n in reversed(runs):
        behind.append(before(symbol, n, behind[-1]))
    behind.reverse()
    cost, state, audit = behind[0][0], 0, []
    for (symbol, n), end in zip(runs, behind[1:]):
        while n:
            some = min(n, SLICE)
            n -= some
            steps = [before(symbol, n, end)]
            for _ in range(some):
                steps.append(apply(power(symbol, 0), steps[-1]))
            for now, then in zip(reversed(steps[1:]), reversed(steps[:-1])):
                while True:
                    least = now[state]
                    (_, delete, _), *stay = options(symbol, state)
                    if delete + then[state] == least:
                        audit.append("D")
                        break
                    if INSERT + now[INSERTED[state]] == least:
                        audit.append("I")
                        state = INSERTED[state]
                        continue
                    letter, state = next((x, t) for x, c, t in stay if c + then[t] == least)
                    audit.append(letter)
                    break
    while END[state]:
        audit.append("I")
        state = INSERTED[state]
    return cost, "".join(audit)


def messages(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn long, role, text) of a table; null roles and texts are one space."""
    blank = F.lit(" ")
    return table.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), blank).alias("role"), F.coalesce(F.col(text_col), blank).alias("text"))


def _initial(role: Column) -> Column:
    """The role class of INITIALS, 3 for others."""
    first = F.left(role, F.lit(1))
    return F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)


def _keys() -> tuple[Column, Column]:
    return F.xxhash64("text").alias("h0"), F.xxhash64("text", F.lit(1)).alias("h1")


def symbols(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, h0, h1, role_class, fault, n) of messages: n equal rows of a turn, where fault is the first one's."""
    end = F.rtrim("text", F.lit(WHITE))
    fault = F.when(end == "", BLANK).when(F.right(end, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    same = rows.select("conv_id", "turn", "role", *_keys(), fault.alias("fault")).groupBy("conv_id", "turn", "role", "h0", "h1").agg(F.max("fault").alias("fault"), F.count("*").alias("n"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    several = same.groupBy("conv_id", "role", "h0", "h1").agg(F.count("*").alias("turns"), F.min(place).alias("first")).where("turns > 1")
    key = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("conv_id", "role", "h0", "h1")]
    met = same.alias("x").join(several.alias("y"), key[0] & key[1] & key[2] & key[3], "left")
    later = F.col("y.first").isNotNull() & ~F.col("y.first.turn").eqNullSafe(F.col("x.turn"))
    return met.select("x.conv_id", "x.turn", "x.role", "x.h0", "x.h1", _initial(F.col("x.role")).alias("role_class"), F.when(later & (F.col("x.fault") != BLANK), DUPLICATE).otherwise(F.col("x.fault")).alias("fault"), F.col("x.n").alias("n"))


def _collapsed(conv: pa.Array, turn: pa.Array, role: np.ndarray, fault: np.ndarray, n: np.ndarray) -> Iterator[tuple]:
    """(row of conv, lo, hi, turns, symbols, lengths) for each conversation of a batch in order."""
    code = conv.dictionary_encode(null_encoding="encode").indices.to_numpy()
    cut = np.concatenate(([0], np.flatnonzero(code[1:] != code[:-1]) + 1, [len(code)]))
    known = turn.is_valid().to_numpy(zero_copy_only=False)
    t = turn.fill_null(0).to_numpy()
    first = role * 4 + fault
    rest = role * 4 + np.where(fault == BLANK, BLANK, DUPLICATE)
    symbol, length = np.stack((first, rest), 1).astype(np.uint8), np.stack((np.ones_like(n), n - 1), 1)
    for a, b in zip(cut[:-1], cut[1:]):
        s, m = symbol[a:b].ravel(), length[a:b].ravel()
        s, m = s[m > 0], m[m > 0]
        at = np.concatenate(([0], np.flatnonzero(s[1:] != s[:-1]) + 1))
        mine = t[a:b][known[a:b]]
        turns = int((mine[1:] != mine[:-1]).sum()) + 1 if len(mine) else 0
        yield a, (int(mine[0]) if turns else None), (int(mine[-1]) if turns else None), turns, s[at], np.add.reduceat(m, at)


def _illegal(symbols_: np.ndarray, lengths: np.ndarray) -> int:
    role = (symbols_ // 4).tolist()
    return int(lengths.sum() - len(lengths)) + sum(pair not in LEGAL for pair in zip(role, role[1:]))


def plans(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) per conversation of messages."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "h0", "h1"]
    parts = parts_for(rows, ROW_BYTES)
    dealt = symbols(rows).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, b in enumerate(batches):
            if not b.num_rows:
                continue
            found = list(_collapsed(b.column("conv_id"), b.column("turn"), *(b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("role_class", "fault", "n"))))
            row, lo, hi, turns, s, m = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id").take(pa.array(row)), b.column("part").take(pa.array(row)), pa.array([at] * len(row), pa.int32()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(turns, pa.int64()), pa.array([x.tobytes() for x in s], pa.binary()), pa.array([x.astype("<i8").tobytes() for x in m], pa.binary())],
                ["conv_id", "part", "at", "lo", "hi", "turns", "symbols", "lengths"],
            )

    runs = dealt.mapInArrow(collapse, f"conv_id {kind}, part int, at int, lo long, hi long, turns long, symbols binary, lengths binary")
    gathered = runs.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "part", "at")

    def finished(conv, pieces: list[tuple]) -> list:
        s = np.concatenate([np.frombuffer(x[3], np.uint8) for x in pieces])
        m = np.concatenate([np.frombuffer(x[4], "<i8") for x in pieces])
        known = [x for x in pieces if x[2]]
        turns = sum(x[2] for x in known) - sum(x[1] == y[0] for x, y in zip(known, known[1:]))
        gaps = known[-1][1] - known[0][0] + 1 - turns if known else 0
        count = np.bincount(s % 4, weights=m, minlength=4).astype(np.int64).tolist()
        cost, audit = plan(s, m)
        return [conv, gaps, count[BLANK], count[DUPLICATE], count[TRUNCATED], _illegal(s, m), cost, audit]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[tuple] = []
        now, kept = None, pa.string()
        for b in batches:
            done: list[list] = []
            convs = b.column("conv_id").to_pylist()
            for conv, *piece in zip(convs, *(b.column(c).to_pylist() for c in ("lo", "hi", "turns", "symbols", "lengths"))):
                if pieces and conv != now:
                    done.append(finished(now, pieces))
                    pieces = []
                now = conv
                pieces.append(tuple(piece))
            kept = b.schema.field("conv_id").type
            if done:
                yield _plan_batch(done, kept)
        if pieces:
            yield _plan_batch([finished(now, pieces)], kept)

    return gathered.mapInArrow(solve, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


PLANNED = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def _plan_batch(rows: list[list], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:-1]), pa.array(columns[-1], pa.string())], ["conv_id", *PLANNED])


class Walk:
    """Follows one conversation's audit along its rows: every call gives the rows that come out, as (role, text, edit)."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = INSERTED[self.state]
            yield ROLE_OF[self.state], "", "I"

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "D":
            return
        if letter == "K":
            self.state = KEPT[self.state][INITIALS.index(role[0])]
            yield role, text, "K"
        else:
            self.state = INSERTED[self.state]
            yield ROLE_OF[self.state], text, "R"


def _along(rows: DataFrame, planned: DataFrame, every: DataFrame | None) -> DataFrame:
    """Conversations one after the other in each part: a row that names it, its plan, its messages in order."""
    nothing = {"turn": "long", "role": "string", "text": "string", "h0": "long", "h1": "long"}
    plan_nulls = [F.lit(None).cast("string" if c == "audit" else "long").alias(c) for c in PLANNED]
    text_nulls = [F.lit(None).cast(t).alias(c) for c, t in nothing.items()]
    all_ = rows.select("conv_id", F.lit(2).alias("kind"), "turn", "role", "text", *_keys(), *plan_nulls).union(planned.select("conv_id", F.lit(1).alias("kind"), *text_nulls, *PLANNED))
    if every is not None:
        all_ = all_.union(every.select(F.col("conv_id"), F.lit(0).alias("kind"), *text_nulls, *plan_nulls))
    return all_.repartition(parts_for(rows, ROW_BYTES), "conv_id").sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "h0", "h1")


def repaired(rows: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """(conv_id, place, turn, role, text, edit): the conversations of messages as they are after the edits.

    place counts from 0; turn is null for inserted rows; edit is K, R or I."""
    planned = written(plans(rows), "plans") if planned is None else planned
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, now, place, type_ = None, None, 0, None
        for b in batches:
            out: list[tuple] = []
            type_ = b.schema.field("conv_id").type

            def put(found, turn):
                nonlocal place
                for role, text, edit in found:
                    out.append((now, place, None if edit == "I" else turn, role, text, edit))
                    place += 1

            for conv, what, turn, role, text, audit in zip(*(b.column(c).to_pylist() for c in ("conv_id", "kind", "turn", "role", "text", "audit"))):
                if what == 1:
                    if walk:
                        put(walk.inserted(), None)
                    walk, now, place = Walk(audit), conv, 0
                else:
                    put(walk.row(role, text), turn)
            if out:
                yield _row_batch(out, type_)
        if walk:
            out = []
            for role, text, edit in walk.inserted():
                out.append((now, place, None, role, text, edit))
                place += 1
            if out:
                yield _row_batch(out, type_)

    return _along(rows, planned, None).mapInArrow(run, f"conv_id {kind}, place long, turn long, role string, text string, edit string")


def _row_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["conv_id", "place", "turn", "role", "text", "edit"])


def repair_digests(rows: DataFrame, every: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """The plans of messages and the sha256 of the repaired `role:text` lines, a row for each conv_id of every (distinct).

    A conversation without messages has zeros, an empty audit and the hash of nothing.  Lines stream into the hash."""
    planned = written(plans(rows), "plans") if planned is None else planned
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # conv_id, plan, walk, hash, whether a line is in it

        def put(found) -> None:
            for role, text, _ in found:
                held[3].update((b"\n" if held[4] else b"") + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                held[4] = True

        def end() -> list:
            put(held[2].inserted())
            return [held[0], *held[1], held[3].hexdigest()]

        kept = pa.string()
        for b in batches:
            done = []
            kept = b.schema.field("conv_id").type
            for conv, what, role, text, *numbers in zip(*(b.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text", *PLANNED))):
                if what == 0:
                    if held:
                        done.append(end())
                    held = [conv, [0] * 6 + [""], Walk(""), hashlib.sha256(), False]
                elif what == 1:
                    held[1], held[2] = numbers, Walk(numbers[-1])
                else:
                    put(held[2].row(role, text))
            if done:
                yield _digest_batch(done, kept)
        if held:
            yield _digest_batch([end()], kept)

    return _along(rows, planned, every).mapInArrow(run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def _digest_batch(rows: list[list], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:7]), *(pa.array(c, pa.string()) for c in columns[7:])], ["conv_id", *PLANNED, "repaired_sha256"])
