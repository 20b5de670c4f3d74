import time

import numpy as np
import pytest

from barflow.llm import packing


def lengths(low, high, n):
    return np.bincount(np.random.default_rng(low).integers(low, high + 1, n), minlength=2049)


def best_fit(counts):
    """Sequences of best-fit decreasing, one piece after the other."""
    room = np.zeros(2049, int)
    used = 0
    for n in range(2048, 0, -1):
        for _ in range(counts[n]):
            fits = np.flatnonzero(room[n:])
            r = n + int(fits[0]) if len(fits) else 2048
            if len(fits):
                room[r] -= 1
            else:
                used += 1
            room[r - n] += 1
    return used


@pytest.mark.parametrize(("low", "high", "most"), [(1, 2048, 1.0), (600, 1000, 0.97), (500, 1300, 1.0), (700, 700, 1.0), (2048, 2048, 1.0), (1, 500, 1.0), (683, 1400, 1.0)])
@pytest.mark.parametrize("times", [1, 50])
def test_plans_pack_by_configurations(monkeypatch, low, high, most, times):
    counts = lengths(low, high, 4000)
    placed, filled = [], packing._substituted

    def counted(*args):
        out = filled(*args)
        placed.append(sum(many * len(items) for many, _, items in out))
        return out

    def kept(left, by_room, capacity):  # pieces in configurations, and what the plan that keeps them takes
        inside = sum(many * k for row in by_room for many, _, items in row for n, k in items)
        out = best_fit_of(left, by_room, capacity)
        plans.append((sum(b[0] for b in out), inside))
        return out

    plans, best_fit_of = [], packing._best_fit
    monkeypatch.setattr(packing, "_substituted", counted)
    monkeypatch.setattr(packing, "_best_fit", kept)
    began = time.process_time()
    plan = packing.plan_sequences(counts * times)
    assert time.process_time() - began < 60
    got = np.zeros(2049, int)
    for many, items in plan:
        assert sum(n * k for n, k in items) <= 2048
        for n, k in items:
            got[n] += many * k
    assert (got == counts * times).all()
    large = int(counts[513:2048].sum()) * times
    assert sum(placed) >= large / 2
    best = min(p for p, _ in plans)
    assert max(inside for p, inside in plans if p == best) >= large / 2  # of the plan that is taken, too
    if times == 1:
        assert sum(many for many, _ in plan) <= best_fit(counts) * most


def test_no_pieces_no_sequences():
    assert packing.plan_sequences(np.zeros(2049, int)) == []


@pytest.mark.parametrize(("low", "high"), [(683, 1400), (1, 2048), (600, 1000), (500, 1300)])
def test_never_more_sequences_than_best_fit(low, high):
    counts = lengths(low, high, 8000)
    assert sum(many for many, _ in packing.plan_sequences(counts)) <= best_fit(counts)


def test_columns_of_the_same_names_change_nothing(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = spark.createDataFrame([(1, "a b c"), (2, None), (3, "word " * 3000)], "doc_id long, text string")
    clash = plain.selectExpr("doc_id as id", "text as body", "7 as piece", "8 as start", "9 as length", "10L as ids_crc32", "11 as chunk", "12 as doc_id", "'no' as text")
    want = sorted(map(tuple, packing.pack_documents(plain, path).collect()))
    assert sorted(map(tuple, packing.pack_documents(clash, path, id_col="id", text_col="body").collect())) == want
    assert len(want) == 4
