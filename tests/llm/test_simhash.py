import random

import numpy as np
import xxhash

from barflow.llm.simhash import blocks, near_duplicates, reach

SCHEMA = "text string, doc_id long, lang string, fp long, key long, root long"


def brute(rows, words=3, threshold=3):
    prints = []
    for t, d in rows:
        import re

        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        sh = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        prints.append(sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)) if h else 0)
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= threshold:
                group[find(i)] = find(j)
    ids = {}
    for i, (_, d) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return sorted((d is None, d or 0, f"{p:016x}", ids.get(find(i))) for i, ((_, d), p) in enumerate(zip(rows, prints)))


def rows(n=300):
    rnd = random.Random(1)
    vocabulary = [f"w{i}é" for i in range(200)]
    out = [("", 5000), (None, 5001), ("One", 5002), ("one two", 5003), ("ONE\ttwo", 5004), ("no id", None), ("  x y z q", 5005)]
    base = [rnd.choices(vocabulary, k=rnd.choice([4, 60, 400])) for _ in range(40)]
    for i in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2])):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        out.append((" ".join(w), i))
    return [*out, out[-1], out[-1]]


def got(spark, data, **more):
    df = spark.createDataFrame([(t, d, "en", 1, 2, 3) for t, d in data], SCHEMA)
    return sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in near_duplicates(df, **more).collect())


def test_against_all_pairs(spark):
    data = rows()
    assert got(spark, data) == brute(data)


def test_other_thresholds_and_slices(spark, monkeypatch):
    monkeypatch.setattr("barflow.llm.simhash.SLICE", 4)
    monkeypatch.setattr("barflow.llm.simhash.PLACES", 2)
    data = rows(120)
    for t in (0, 3, 6):
        assert got(spark, data, threshold=t, words=2) == brute(data, 2, t)


def test_dense_groups_keep_no_pairs():
    rng = np.random.default_rng(5)
    fp = np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)) for base in rng.integers(0, 1 << 63, 3).astype(np.uint64)])
    home = np.ones(len(fp), bool)
    a, b = reach(fp, home, 3)
    assert len(a) == len(fp) - 3  # three components, a link less than members each
    assert (np.bitwise_count(a ^ b) <= 3).all()
    strangers = reach(fp, ~home, 3)
    assert len(strangers[0]) == 0  # no pair has a member at home
    one = home & False
    one[0] = True
    a, b = reach(fp[:3000], one[:3000], 2)
    assert len(a) == int((np.bitwise_count(fp[:3000] ^ fp[0]) <= 2).sum()) - 1


def test_empty_table(spark):
    assert got(spark, []) == []
    assert blocks(3) == [(0, 31), (32, 31)]


def test_rounds_of_few_edges_run_in_few_tasks(spark, monkeypatch):
    from barflow.llm.components import LEAST_TASKS, components

    edges = spark.createDataFrame([(i, i + 1) for i in range(10)], "a long, b long").repartition(64)
    parts, frame = [], type(edges)
    monkeypatch.setattr(frame, "distinct", lambda self, f=frame.distinct: f(self).repartition(64))
    checkpoint = frame.checkpoint
    monkeypatch.setattr(frame, "checkpoint", lambda self: (out := checkpoint(self), parts.append(out.rdd.getNumPartitions()))[0])
    assert {r.root for r in components(edges).collect()} == {0}
    assert len(parts) > 1 and parts[0] == 64 and max(parts[1:]) <= LEAST_TASKS
