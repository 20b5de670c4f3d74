import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barflow.llm import hard_negatives as mining
from barflow.llm.hard_negatives import MultiIndex, codebook, hard_negatives, nearest, window

SCHEMA = "embedding array<double>, vec_id long, label int, dim int, score long, i string, shard long"


def brute(rows, every, scale=256):
    sound = [(i, lab, [math.floor(scale * x) for x in v]) for v, i, lab, *_ in rows if None not in (v, i, lab) and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, lab, q in {(i, lab, tuple(v)) for i, lab, v in sound if i % every == 0}:
        scored = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, v)))), j, other) for j, other, v in sound if len(v) == len(q))
        positives = [(j, -s) for s, j, other in scored if other == lab and j != i][:5]
        for j, s in positives:
            fits = [(m, -t) for t, m, other in scored if other != lab and 30 * s <= -100 * t <= 90 * s][:10]
            out += [(i, j, r + 1, m, s, t) for r, (m, t) in enumerate(fits)]
    return sorted(out)


def clustered(n, dim, seed=0, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(2 * labels, dim))
    return [([float(np.float32(x)) for x in 0.3 * (centres[i % (2 * labels)] + 0.4 * rng.normal(size=dim))], i, i % labels, 1, 2, "x", 3) for i in range(n)]


def mined(spark, rows, every=10, **more):
    return sorted(tuple(r) for r in hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % every == 0, **more).collect())


def test_equals_brute_force(spark, monkeypatch):
    rows = clustered(500, 8)
    end = (1, 2, "x", 3)
    rows += [(rows[0][0], 600 + i, i % 3, *end) for i in range(40)]  # equal vectors, equal scores
    rows += [(None, 700, 1, *end), ([1.0, None], 710, 1, *end), ([float("nan")] * 8, 720, 1, *end), ([float("inf")] * 8, 730, 1, *end), ([], 740, 1, *end), (rows[3][0], 750, None, *end), (rows[3][0], None, 1, *end)]
    rows += [([0.5, x], 800 + k, k % 2, *end) for k, x in enumerate((0.1, 0.4, 1.0, -2.0, 0.3, 0.2))] + [([float(k)], 810 + k, k % 2, *end) for k in range(12)]
    rows += [([0.0] * 8, 850, 1, *end)]  # scores of zero
    rows += [rows[20], (rows[20][0], 20, 3, *end), (rows[30][0], 21, 2, *end)]  # repeated ids, equal and not
    want = brute(rows, 10)
    assert len(want) > 500
    for shard, words, some in ((32 << 20, None, 256), (64 << 7, 4, 7), (64 << 5, 9, 1)):
        monkeypatch.setattr(mining, "SHARD_BYTES", shard)
        monkeypatch.setattr(mining, "SOME_ROWS", some)
        assert mined(spark, rows, words=words) == want
    monkeypatch.setattr(mining, "SAMPLE_ROWS", 5)  # most lengths are not in the sample
    assert mined(spark, rows, words=3) == want


def test_odd_tables(spark):
    rows = clustered(40, 6)
    assert mined(spark, []) == []
    assert mined(spark, rows, every=1000_000) == brute(rows, 1000_000)
    assert mined(spark, [(v, i, 1, *r) for v, i, _, *r in rows]) == []
    assert mined(spark, rows[:2], every=1) == []


def test_large_components(spark):
    rows = [([x * 1e6 for x in v], i, *r) for v, i, *r in clustered(60, 6)]  # beyond 2**53
    want = brute(rows, 10)
    assert max(r[4] for r in want) > 1 << 53
    assert mined(spark, rows) == want
    huge = [([x * 1e9 for x in v], i, *r) for v, i, *r in clustered(60, 6)]  # beyond 64 bits
    assert mined(spark, huge) == brute(huge, 10)


def test_a_cell_with_most_rows_goes_to_several_shards(spark, monkeypatch):
    monkeypatch.setattr(mining, "SHARD_BYTES", 64 << 5)
    rows = clustered(200, 8)
    rows += [(rows[0][0], 1001 + i, i % 5, 1, 2, "x", 3) for i in range(400)]
    held, known, _ = mining.indexed(mining.vectors(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, 256, "vec_id", "embedding", "label"), 5)
    sizes = [r["count"] for r in held.groupBy("shard").count().collect()]
    assert sum(sizes) == 600 and max(sizes) < 80  # of 32 each, about
    assert mined(spark, rows, words=5) == brute(rows, 10)


def shard_of(n, words, seed=1):
    x = np.floor(256 * np.array([r[0] for r in clustered(n, 16, seed)]))
    books = tuple(codebook(h, words) for h in mining.halves(x))
    i, j = (nearest(h, w)[0] for h, w in zip(mining.halves(x), books))
    return x, MultiIndex(x, np.arange(n), np.arange(n) % 4, i, j, books)


def test_cells_come_by_descending_bounds_and_bound_their_rows():
    x, index = shard_of(3000, 12)
    for q in x[:20]:
        seen, last = 0, math.inf
        for bound, a, b in index.visits(q):
            assert (index.x[a:b] @ q).max() <= bound <= last + 1e-6
            last, seen = bound, seen + b - a
        assert seen == len(x)


def test_search_stops_on_certified_windows():
    x, index = shard_of(20_000, 40)
    part = []
    for at in range(40):
        q, label = x[at], at % 4
        (found,), scored = index.search(q, (index.labels == label) & (index.ids != at), [(mining.LOWEST, mining.HIGHEST)], 5, mining.LOWEST)
        score = (x @ q).astype(int)
        ids = np.flatnonzero((np.arange(len(x)) % 4 == label) & (np.arange(len(x)) != at))
        best = ids[np.lexsort((ids, -score[ids]))][:5]
        assert found[1].tolist() == best.tolist() and found[0].tolist() == score[best].tolist()
        part.append(scored / (len(x) / 4))
    assert np.mean(part) < 0.6  # rows of the own cluster, about


@pytest.mark.parametrize("s", [-7, -1, 0, 1, 3, 99, 100, 12345])
def test_windows(s):
    low, high = window(s, 30, 90)
    assert [t for t in range(-2 * abs(s) - 2, 2 * abs(s) + 3) if 30 * s <= 100 * t <= 90 * s] == list(range(low, high + 1))
