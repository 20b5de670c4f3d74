"""Forms that spread a long series are the same as the plain definitions; sources and sinks."""

import datetime as dt
import random

from pyspark.sql import functions as F

from barflow.operators import structure as G
from barflow.operators import supply_demand as H
from barflow.operators import swings as S
from barflow.sources import bars as B

BLOCKS = "symbol string, timeframe string, side string, break_pos long, x long, top double, bottom double"


def walk(n, seed=1):
    rnd, price, out = random.Random(seed), 100.0, []
    for i in range(n):
        a, price = price, max(1.0, price + rnd.uniform(-1, 1))
        out.append(("s", "1m", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), a, max(a, price) + rnd.random(), min(a, price) - rnd.random(), price, float(rnd.randrange(1, 100)), i))
    return out


def bars_of(spark, rows):
    return spark.createDataFrame(rows, "symbol string, timeframe string, ts timestamp, open double, high double, low double, close double, volume double, pos long")


def test_mitigation_over_many_buckets(spark):
    rows, rnd = walk(400), random.Random(2)
    blocks = [("s", "1m", rnd.choice(["bull", "bear"]), i, x, rows[x][4] + rnd.uniform(-1, 6), rows[x][5] - rnd.uniform(-1, 6)) for i, x in enumerate(rnd.choices(range(400), k=150))]
    want = {b[3]: next((r[8] for r in rows[b[4] + 1 :] if (r[5] < b[6] if b[2] == "bull" else r[4] > b[5])), None) for b in blocks}
    for bucket in (4, 7, 512):
        got = {r.break_pos: r.mitigated for r in G.mitigation(spark.createDataFrame(blocks, BLOCKS), bars_of(spark, rows), bucket).collect()}
        assert got == want
    assert None in want.values() and len(set(want.values())) > 40


def test_cooldown_is_greedy(spark):
    rnd = random.Random(3)
    at = sorted(rnd.sample(range(3000), 500))
    found = spark.createDataFrame([("s", "1m", k, x - 3, x, 2.0, 1.0, 5.0) for k in ("supply", "demand") for x in at], "symbol string, timeframe string, kind string, x1 long, x2 long, top double, bottom double, delta double")
    want, last = [], -100
    for x in at:
        if x - last >= 14:
            want.append(x)
            last = x
    for kind in ("supply", "demand"):
        assert sorted(r.x2 for r in H.cooled(found).where(F.col("kind") == kind).collect()) == want


def test_contained_zones_go(spark):
    rnd = random.Random(4)
    zones = [("s", "1m", "supply", i, i, b + rnd.choice([0.5, 1.0, 3.0]), b, float(rnd.randrange(1, 9)), None, None) for i in range(120) for b in [rnd.uniform(0, 12)]]
    stays = lambda a: not any(z[5] >= a[5] and z[6] <= a[6] and (abs(z[7]) > abs(a[7]) or (abs(z[7]) == abs(a[7]) and z[4] < a[4])) for z in zones)
    df = spark.createDataFrame(zones, "symbol string, timeframe string, kind string, x1 long, x2 long, top double, bottom double, delta double, hi double, lo double")
    assert sorted(r.x2 for r in H.standing(df).collect()) == sorted(z[4] for z in zones if stays(z))


def test_zones_equal_one_fold_over_all_swings(spark):
    bars = bars_of(spark, walk(1500, 5))
    by = S.with_swings(bars).groupBy(*B.SERIES).agg(F.collect_list("swing_high").alias("h"), F.collect_list("swing_low").alias("l"))
    want = [(r.zone, r.z.price, r.z.touches, r.z.kind) for r in by.select(F.posexplode(S.zones_of(F.col("h"), F.col("l"))).alias("zone", "z")).collect()]
    got = sorted((r.zone, r.price, r.touches, r.kind) for r in S.zones(bars).collect())
    assert [(a, round(b, 9), c, d) for a, b, c, d in got] == [(a, round(b, 9), c, d) for a, b, c, d in want] and len(want) > 5


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 12.0)], "Feature string, VIF double")
    assert B.lower_names(df).columns == ["feature", "vif"]
    B.write_report(B.lower_names(df), str(tmp_path / "report"), "vif")
    assert [r.feature for r in spark.read.option("header", True).csv(str(tmp_path / "report")).collect()] == ["b", "a"]
    for brier in (0.2, 0.1):
        rows = spark.createDataFrame([("x", "1H", brier)], "symbol string, timeframe string, brier double")
        B.append_metadata(rows.withColumn("run", F.lit(brier)), str(tmp_path / "metrics"))
    assert spark.read.json(str(tmp_path / "metrics")).count() == 2
    assert B.latest_metadata(spark, str(tmp_path / "metrics")).count() == 1


def test_series_tables_read_only_the_pair(spark, tmp_path):
    rows = spark.createDataFrame([(s, t, 1.0) for s in "ab" for t in ("1H", "4H")], "symbol string, timeframe string, rsi double")
    B.write_series(rows, str(tmp_path / "features"))
    one = B.read_series(spark, str(tmp_path / "features"), "a", "4H")
    assert one.count() == 1 and len(one.inputFiles()) == 4
    assert "PartitionFilters: [isnotnull(symbol" in one._jdf.queryExecution().toString().replace("#", "").split("Physical Plan")[1].replace("  ", " ") or "PartitionFilters" in one._jdf.queryExecution().toString()
