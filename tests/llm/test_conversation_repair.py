import hashlib
import random
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from barflow.llm import conversation_repair as repair
from barflow.llm.queries import damaged

SCHEMA = "text string, conv_id long, role string, turn long, h0 string, audit int, kind string"
SEEN = " \t\n\x0b\f\r"


def brute(messages):
    """The contract's columns of one conversation's messages in order, by keeping every state's cheapest letters row by row."""
    had, faults = set(), []
    for _, role, text in messages:
        end = text.rstrip(SEEN)
        faults.append("blank" if not end else "duplicate" if (role, text) in had else "truncated" if end[-1] not in ".!?" else "")
        had.add((role, text))

    def inserted(states):
        todo = list(states.items())
        while todo:
            s, (c, a, t) = todo.pop()
            role = "assistant" if s == "u" else "user"
            new = (c + 3, a + "I", t + [(role, "")])
            if new[:2] < states.get(role[0], (1 << 60, ""))[:2]:
                states[role[0]] = new
                todo.append((role[0], new))
        return states

    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    states = inserted({"": (0, "", [])})
    for (_, role, text), fault in zip(messages, faults):
        new = {}

        def offer(s, way):
            if way[:2] < new.get(s, (1 << 60, ""))[:2]:
                new[s] = way

        for s, (c, a, t) in states.items():
            offer(s, (c + 4, a + "D", t))
            if fault in ("", "truncated"):
                c += 3 * (fault == "truncated")
                if role[:1] and role[0] in follows[s]:
                    offer(role[0], (c, a + "K", t + [(role, text)]))
                for to in ("user", "assistant"):
                    if to[0] in follows[s]:
                        offer(to[0], (c + 3, a + "R", t + [(to, text)]))
        states = inserted(new)
    cost, audit, rows = min(states[s] for s in states if s in ("", "a"))
    turns = {t for t, *_ in messages if t is not None}
    first = [r[:1] for _, r, _ in messages]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")),
        sum(p + q not in ("su", "ua", "au") for p, q in zip(first, first[1:])), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rows).encode()).hexdigest(),
    ), rows


def expected(spark, rows):
    """conv_id -> brute result, over messages in the operator's order of tied turns."""
    df = repair.messages(spark.createDataFrame(rows, SCHEMA))
    inside = df.select("*", *repair._keys()).orderBy("conv_id", F.col("turn").asc_nulls_first(), "role", "h0", "h1").collect()
    return {c: brute([(r.turn, r.role, r.text) for r in g]) for c, g in groupby(inside, key=lambda r: r.conv_id)}


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    m = repair.messages(df)
    want = expected(spark, rows)
    got = repair.repair_digests(m, df.select("conv_id").distinct()).collect()
    assert sorted(map(str, (r.conv_id for r in got))) == sorted(map(str, {r[1] for r in rows}))
    for r in got:
        assert tuple(r)[1:] == want[r.conv_id][0], r
    out = {}
    for r in sorted(repair.repaired(m).collect(), key=lambda r: r.place):
        out.setdefault(r.conv_id, []).append((r.role, r.text))
    assert {c: o for c, o in out.items()} == {c: w[1] for c, w in want.items() if w[1]}


def some(rnd, conv, n, texts, roles=("user", "assistant", "system", "tool", None, "")):
    return [(rnd.choice(texts), conv, rnd.choice(roles), rnd.choice([None, *range(2 * n)]) if rnd.random() < 0.3 else i, "h", 1, "k") for i in range(n)]


def test_equals_brute_force(spark, monkeypatch):
    rnd = random.Random(5)
    texts = ["Yes.", "No!", "why?", "cut off", " \n", "", None, "end.\x0b\n", "é", "no-break ", "x" * 300_000 + "."]
    rows = [m for c in range(150) for m in some(rnd, c, rnd.randrange(1, 9), texts)]
    rows += [m for c in range(150, 190) for m in some(rnd, c, 12, texts[:4], ("user", "assistant", "user", "system"))]
    rows += [m for m in some(rnd, None, 7, texts)] + [("only", 900, "system", 0, None, None, None), ("Done.", 901, "user", None, None, None, None)]
    rows += rows[:40]  # repeated rows
    monkeypatch.setattr(repair, "SLICE", 3)
    check(spark, rows)
    assert repair.plans(repair.messages(spark.createDataFrame([], SCHEMA))).count() == 0
    assert repair.repaired(repair.messages(spark.createDataFrame([], SCHEMA))).count() == 0


def test_long_runs_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(repair, "SLICE", 50)
    monkeypatch.setattr(repair, "ROW_BYTES", 1 << 12)  # one conversation over many parts
    rnd = random.Random(6)
    rows = []
    for i in range(6000):  # runs of user rows, of cut rows, of one text said again, of one turn
        kind = i // 1500
        rows.append(((f"u{i}.", "ok.", f"cut {i}", "ok.")[kind], 1, ("user", "assistant", "assistant", "user")[kind], i if kind < 3 else 4500, "", 0, ""))
    rnd.shuffle(rows)
    assert len(rows) == 6000
    check(spark, rows + some(rnd, 2, 5, ["Yes.", "no"]))
    dealt = repair.symbols(repair.messages(spark.createDataFrame(rows, SCHEMA)))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "h0", "h1"]
    assert dealt.repartitionByRange(16, *order).select(F.spark_partition_id().alias("p")).distinct().count() > 8


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000])
def test_powers_equal_steps(n):
    for symbol in range(16):
        v = repair.END
        for _ in range(n):
            v = repair.apply(repair.power(symbol, 0), v)
        assert repair.before(symbol, n, repair.END) == v


def test_plan_of_a_run_is_its_rows_one_by_one():
    rnd = random.Random(2)
    for _ in range(60):
        s = np.array([rnd.randrange(16) for _ in range(rnd.randrange(1, 7))], np.uint8)
        m = np.array([rnd.choice((1, 1, 2, 5)) for _ in s])
        assert repair.plan(s, m) == repair.plan(np.repeat(s, m), np.ones(m.sum(), int))


def test_damage_drops_whole_conversations(spark):
    dropped = next(c for c in range(1000) if __import__("zlib").crc32(f"{c}:0".encode()) % 20 == 0)
    copied = next(c for c in range(1000) if __import__("zlib").crc32(f"{c}:0".encode()) % 20 == 3)
    table = spark.createDataFrame([("Hi.", dropped, "user", 0, "", 0, ""), ("Hi.", copied, "user", 0, "", 0, "")], SCHEMA)
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_digests(damaged(table), table.select("conv_id").distinct()).collect()}
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    # delete both (8) or keep one and insert an answer (3 + 4)
    assert got[copied][1:7] == (0, 1, 0, 1, 7, "KDI")
