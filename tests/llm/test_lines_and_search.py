import math
import random

import numpy as np
from pyspark.sql import functions as F

from barflow.llm.line_dedup import dedup_lines
from barflow.llm.vector_search import top_k

SCHEMA = "text string, doc_id long, source string, line string, pos int, n_lines int"


def lines_brute(rows, min_sites, min_chars):
    sites, first = {}, {}
    for t, d, s, *_ in rows:
        for p, x in enumerate((t or "").split("\n") if t is not None else []):
            if len(x) >= min_chars:
                sites.setdefault(x, set()).add(s)
                here = (d is not None, d or 0, p)
                first[x] = min(first.get(x, here), here)
    out = []
    for t, d, s, *_ in rows:
        if t is None:
            out.append((str(d), s, None))
            continue
        kept = [x for p, x in enumerate(t.split("\n")) if not (len(x) >= min_chars and len(sites[x]) >= min_sites and first[x] != (d is not None, d or 0, p))]
        out.append((str(d), s, "\n".join(kept)))
    return sorted(out, key=str)


def test_lines(spark):
    rnd = random.Random(3)
    common = [f"line {i} said by many é" for i in range(12)]
    rows = []
    for i in range(400):
        text = "\n".join(rnd.choice([rnd.choice(common[: 1 + i % 12]), f"own {rnd.random()}", "", "short"]) for _ in range(rnd.randrange(12)))
        rows.append((text, i, f"s{rnd.randrange(3 + i % 12)}", "a", 1, 2))
    rows += [(None, 900, "s1", "a", 1, 2), ("", 901, None, "a", 1, 2), (common[0], None, "s2", "a", 1, 2), (common[0], 902, None, "a", 1, 2), rows[5], rows[5], ("x" * 300000, 903, "s1", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for least in (2, 5, 10):
        got = dedup_lines(df, least, 10)
        assert got.columns == df.columns
        salted = dedup_lines(df, least, 10, small=0, occurrences=9)
        for out in (got, salted):
            assert sorted(((str(r.doc_id), r.source, r.text) for r in out.collect()), key=str) == lines_brute(rows, least, 10)
    assert dedup_lines(spark.createDataFrame([], SCHEMA), 2, 1).count() == 0


def test_texts_of_very_many_lines(spark):
    line = "a line that repeats and repeats"
    rows = [("\n".join([line, "own"] * 100_000), 1, "s1", "a", 1, 2), *((line + "\nx", i, f"s{i}", "a", 1, 2) for i in range(2, 13))]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, SCHEMA).drop("n_lines"), counts=True).collect()}
    assert got[1].text == "\n".join([line, *["own"] * 100_000]) and (got[1].n_lines, got[1].n_removed) == (200_000, 99_999)
    assert all((got[i].text, got[i].n_removed) == ("x", 1) for i in range(2, 13))


def search_brute(rows, every, k):
    sound = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in {(i, tuple(v)) for i, v in sound if i % every == 0}:
        scored = sorted((-max(-(1 << 63) + 1, min((1 << 63) - 1, sum(a * b for a, b in zip(q, v)))), j) for j, v in sound if j != i and len(v) == len(q))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def test_search(spark, monkeypatch):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] + 0.2 * rng.normal(size=8)]) for i in range(900)]
    rows += [(900 + i, rows[0][1]) for i in range(30)]  # equal scores
    rows += [(2000, None), (2010, [1.0, None]), (2020, [float("nan")] * 8), (2030, [float("inf")] * 8), (2040, [0.5, 1.0]), (2041, [0.25, -3.0]), (None, [1.0] * 8), (2051, [0.0] * 8)]
    df = spark.createDataFrame([(v, i, "x", 1) for i, v in rows], "embedding array<float>, vec_id long, v string, dim int")
    for shard, batch in ((1 << 20, 2048), (64 << 7, 7), (64 << 5, 2048)):
        monkeypatch.setattr("barflow.llm.vector_search.SHARD_BYTES", shard)
        monkeypatch.setattr("barflow.llm.vector_search.BATCH", batch)
        got = sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 10 == 0).collect())
        assert got == search_brute(rows, 10, 10)
    assert top_k(df.limit(0), F.lit(True)).count() == 0
    assert top_k(df.where("vec_id < 3"), F.col("vec_id") == 0).count() == 2


def searched(spark, rows, every=10):
    return sorted(tuple(r) for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % every == 0).collect())


def test_repeated_query_ids_have_a_list_each(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(200)]
    rows += [(0, [float(x) for x in rng.normal(size=6)]), (10, rows[10][1]), (3, rows[4][1])]
    got = searched(spark, rows)
    assert got == search_brute(rows, 10, 10)
    assert sum(r[0] == 0 for r in got) == 20 and sum(r[0] == 10 for r in got) == 10


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(3)
    for size in (1e6, 1e9):  # beyond 2**53, beyond 64 bits
        rows = [(i, [float(x) for x in size * rng.normal(size=5)]) for i in range(60)]
        assert searched(spark, rows) == search_brute(rows, 10, 10)


def test_shards_and_leaves_are_left_out(spark, monkeypatch):
    """On clustered vectors a query goes to few blocks, and in a tree scores under half of the rows."""
    from barflow.llm import vector_search as search

    rng = np.random.default_rng(4)
    centres = 4 * rng.normal(size=(24, 12))
    x = np.floor(search.SCALE * (centres[np.arange(6000) % 24] + 0.3 * rng.normal(size=(6000, 12))))
    seen = []
    search.tree_search(search.BallTree(x), np.arange(6000), x[:100], np.arange(100), np.full(100, search.LOWEST), 10, seen)
    assert sum(seen) < 0.5 * 100 * 6000
    monkeypatch.setattr(search, "SHARD_BYTES", 12 * 8 * 250)
    rows = [(i, [float(v) / search.SCALE for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("_asks", F.lit(False))
    held, known, _, _ = search.dealt_shards(search.vectors(df))
    sizes = [r["count"] for r in held.groupBy("shard").count().collect()]
    assert sum(sizes) == 6000 and max(sizes) < 1000 and len(sizes) >= 12
    blocks = [len(known[12].reached(q, float(np.sort(x @ q)[-11]))) for q in x[:100]]
    assert np.mean(blocks) < 0.5 * sum(known[12].blocks)


def test_a_shard_of_equal_vectors_goes_in_blocks(spark, monkeypatch):
    monkeypatch.setattr("barflow.llm.vector_search.SHARD_BYTES", 8 * 6 * 40)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(200)]
    rows += [(1001 + i, rows[0][1]) for i in range(300)]
    assert searched(spark, rows) == search_brute(rows, 10, 10)
