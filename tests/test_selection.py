"""Selections one after the other, zones of dense prices, and as-of joins, against sequential definitions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barflow.functions import spaced as P
from barflow.functions.asof import asof
from barflow.operators import swings as S

T0 = dt.datetime(2024, 1, 1)


def greedy(places, gap):
    out = []
    for x in sorted(places):
        if not out or x - out[-1] >= gap:
            out.append(x)
    return out


@pytest.mark.parametrize("gap", [1, 14, 40])
def test_spaced_is_greedy(spark, monkeypatch, gap):
    monkeypatch.setattr(P, "SPAN", 16)
    rnd = random.Random(gap)
    of = {"dense": list(range(5, 6000)), "some": rnd.sample(range(9000), 3000), "far": [3, 4, 700, 40_000, 40_001, 1_000_000], "before": list(range(-300, 300, 3))}
    rows = [(k, x, -x) for k, xs in of.items() for x in xs]
    got = P.spaced(spark.createDataFrame(rows, "k string, x long, y long"), ["k"], "x", gap)
    assert got.columns == ["k", "x", "y"] and all(r.y == -r.x for r in got.collect())
    for k, xs in of.items():
        assert sorted(r.x for r in got.where(F.col("k") == k).collect()) == greedy(xs, gap)


def test_spaced_long_series(spark):
    rows = spark.range(600_000).select(F.lit("s").alias("k"), F.col("id").alias("x")).where("x % 7 < 5")
    got = [r.x for r in P.spaced(rows, ["k"], "x", 14).orderBy("x").collect()]
    assert got == greedy((x for x in range(600_000) if x % 7 < 5), 14)


def test_spaced_odd_rows(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 4, 2), ("a", 4, 1), ("b", 5, None)], "k string, x long, y long")
    assert sorted(map(tuple, P.spaced(df, ["k"], "x", 3).collect())) == [("a", 4, 1), ("b", 5, None)]
    assert P.spaced(df.where("false"), ["k"], "x", 3).count() == 0


def clusters(prices):
    out = []
    for p in sorted(prices):
        if out and p - out[-1][1] <= out[-1][0] * S.TOLERANCE:
            out[-1][1:] = [p, out[-1][2] + 1]
        else:
            out.append([p, p, 1])
    return [tuple(c) for c in out]


def zones_from(runs):
    each = runs.select("symbol", "_low", F.posexplode(S._clusters(F.col("pieces"), S.TOLERANCE)).alias("i", "z"))
    return [(r.bottom, r.top, r.touches) for r in each.orderBy("symbol", "_low", "i").select("z.*").collect()]


def test_zones_of_dense_prices_need_no_long_array(spark):
    points = spark.range(200_000).select(F.lit("s").alias("symbol"), F.lit("1m").alias("timeframe"), (100 + F.rand(1) * 100).alias("price"), F.when(F.rand(2) < 0.5, "low").otherwise("high").alias("kind"))
    prices = [r.price for r in points.select("price").collect()]
    runs = S.price_runs(points)
    assert runs.agg(F.max(F.size("pieces"))).first()[0] < 1000
    assert zones_from(runs) == clusters(prices)


def test_zones_with_gaps_about_the_tolerance(spark):
    rnd, price, prices = random.Random(7), 1.0, []
    for _ in range(4000):
        price += price * rnd.choice([0.0, 0.0001, 0.0029, 0.003, 0.0031]) * rnd.choice([0.1, 0.5, 1.0])
        prices.append(price)
    df = spark.createDataFrame([("s", "1m", p, "high") for p in prices], "symbol string, timeframe string, price double, kind string")
    assert zones_from(S.price_runs(df)) == clusters(prices) and len(clusters(prices)) > 20


def test_asof_with_a_hot_key(spark):
    rnd = random.Random(8)
    at = lambda: T0 + dt.timedelta(seconds=rnd.randrange(400_000))
    left = [(i, "hot" if rnd.random() < 0.9 else rnd.choice("abc"), at()) for i in range(6000)]
    right = [("hot" if rnd.random() < 0.9 else rnd.choice("ab"), at(), i, None if i % 5 == 0 else float(i)) for i in range(3000)]
    a = spark.createDataFrame(left + [(-1, "hot", None), (-2, None, T0), (1, *left[1][1:])], "id long, k string, ts timestamp")
    b = spark.createDataFrame(right + [("hot", None, 9999, 1.0), (None, T0, 9998, 1.0)], "k string, rts timestamp, seq long, v double")
    by = {}
    for k, t, s, v in sorted(right, key=lambda r: (r[1], r[2])):
        by.setdefault(k, []).append((t, v))
    for bucket, within in (("6 hours", None), ("11 minutes", "30 minutes")):
        got = {r.id: (r.asof_ts, r.v) for r in asof(a, b, ["k"], "ts", "rts", ["v"], "seq", bucket, within).collect()}
        assert len(got) == 6002 and got[-1] == got[-2] == (None, None)
        for i, k, t in left:
            earlier = [x for x in by.get(k, []) if x[0] <= t and (not within or x[0] >= t - dt.timedelta(minutes=30))]
            assert got[i] == (earlier[-1] if earlier else (None, None))
    assert asof(a, b, ["k"], "ts", "rts", ["v"], "seq").count() == 6003
    assert asof(a, b.where("false"), ["k"], "ts", "rts", ["v"], "seq").where("v is null").count() == 6003
    with pytest.raises(ValueError):
        asof(a.withColumn("v", F.lit(1)), b, ["k"], "ts", "rts", ["v"], "seq")
