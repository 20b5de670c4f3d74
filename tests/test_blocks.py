"""Positions, halos and scans of long series equal windows over whole series, and spread over tasks."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barflow.functions import blocks
from barflow.functions.blocks import in_blocks, previous, rows, scanned
from barflow.operators import features as X
from barflow.operators import indicators as I
from barflow.operators import structure as G
from barflow.operators import supply_demand as H
from barflow.operators import swings as S
from barflow.sources import bars as B


def whole_series():
    return Window.partitionBy(*B.SERIES).orderBy("ts")


def long_series(spark, n, timeframe="1m", name="a"):
    """n bars of one series, a minute apart with a gap now and then, made by Spark."""
    i = F.col("id")
    at = F.timestamp_seconds(F.lit(1704067200) + 60 * i + F.floor(i / 1000) * 86400)
    price = lambda i: 100 + 10 * F.sin(i / 37) + 5 * F.sin(i / 5.3)
    close, before = price(i), price(i - 1)
    return spark.range(n).select(F.lit(name).alias("symbol"), F.lit(timeframe).alias("timeframe"), at.alias("ts"), before.alias("open"), (F.greatest(close, before) + F.abs(F.sin(i))).alias("high"), (F.least(close, before) - F.abs(F.cos(i))).alias("low"), close.alias("close"), (i * 7919 % 97).cast("double").alias("volume"))


def test_positions_equal_row_numbers(spark, monkeypatch):
    rnd = random.Random(1)
    data = [(s, t, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)) for s, t in (("a", "1m"), ("a", "1H"), ("b", "odd")) for m in rnd.sample(range(100_000), 400)]
    df = spark.createDataFrame(data + [("a", "1m", None)], "symbol string, timeframe string, ts timestamp")
    for span in (3, 4096):
        monkeypatch.setattr(B, "SPAN", span)
        got = {(r.symbol, r.timeframe, r.ts): (r.pos, r.n) for r in B.with_pos(df.where("ts is not null"), "n").collect()}
        want = {(r.symbol, r.timeframe, r.ts): (r.p - 1, 400) for r in df.where("ts is not null").withColumn("p", F.row_number().over(whole_series())).collect()}
        assert got == want


def test_a_million_bars_of_one_series_use_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # parts are small here
    try:
        check_a_million_bars(spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def check_a_million_bars(spark):
    df = B.with_pos(long_series(spark, 1_000_000))
    assert df.agg(F.min("pos"), F.max("pos"), F.count_distinct("pos")).first()[:] == (0, 999_999, 1_000_000)
    parts = lambda df: df.groupBy(F.spark_partition_id().alias("p")).count().collect()
    for out in (df, I.with_averages(df, {"e": 20}).select("pos", "e")):
        sizes = [r["count"] for r in parts(out)]
        assert sum(sizes) == 1_000_000 and len(sizes) > 3 and max(sizes) < 600_000
    # the average is the recurrence at the very end, across hundreds of blocks
    last = [r.close for r in df.orderBy(F.desc("pos")).limit(2000).collect()][::-1]
    y = last[0]
    for v in last[1:]:
        y += 2 / 21 * (v - y)
    assert I.with_averages(df, {"e": 20}).where("pos = 999999").first().e == pytest.approx(y, rel=1e-12)


def test_no_window_over_bars_is_by_series_alone(spark):
    """Before summaries of blocks, every window of an average is over (series, span) or (series, block)."""
    df = I.with_averages(B.with_pos(long_series(spark, 9000)), {"e": 20})
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    windows = [line.split("windowspecdefinition(")[1].split("ASC")[0] for line in plan.split("\n") if "Window [" in line and "sum(_c#" not in line]
    assert len(windows) >= 2 and all("_span" in w or "_block" in w for w in windows)
    assert plan.count("sum(_c#") == 1  # one row a span


def test_halos_equal_whole_windows(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 16)
    df = B.with_pos(long_series(spark, 500).unionByName(long_series(spark, 70, "1H", "b")))
    whole = df.withColumns({"m": F.max("high").over(whole_series().rowsBetween(-7, 9)), "p": F.lag("close", 12).over(whole_series()), "c": F.count("*").over(whole_series().rowsBetween(-7, 9))})
    cut = in_blocks(df, 12, 9, lambda d: d.withColumns({"m": F.max("high").over(rows(-7, 9)), "p": previous("close", 12), "c": F.count("*").over(rows(-7, 9))}))
    key = lambda out: sorted((r.symbol, r.pos, r.m, r.p or -1, r.c) for r in out.collect())
    assert key(cut) == key(whole)


def test_scans_equal_whole_windows(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 16)
    df = B.with_pos(long_series(spark, 300).unionByName(long_series(spark, 40, "1H", "b")))
    df = df.withColumns({"v": F.when(F.col("pos") % 11 == 3, F.col("close")), "g": F.round(F.col("close") - 100).cast("long")})
    upto, before = whole_series().rowsBetween(Window.unboundedPreceding, 0), whole_series().rowsBetween(Window.unboundedPreceding, -1)
    after = whole_series().rowsBetween(1, Window.unboundedFollowing)
    whole = df.withColumns({"a": F.last("v", True).over(upto), "b": F.last("v", True).over(before), "c": F.sum("g").over(upto), "d": F.count("v").over(before), "e": F.min("low").over(after), "f": F.max("high").over(after), "h": F.first("v", True).over(after), "i": F.min("v").over(before)})
    whole = whole.withColumn("k", F.max("c").over(upto))
    cut = scanned(df, {"a": ("last", "v", True), "b": ("last", "v", False), "c": ("sum", "g", True), "d": ("count", "v", False), "i": ("min", "v", False), "k": ("peak", "g", True)}, {"e": ("min", "low", False), "f": ("max", "high", False), "h": ("last", "v", False)})
    key = lambda out: sorted((r.symbol, r.pos, *(str(r[c]) for c in "abcdefhi"), int(r["k"])) for r in out.collect())
    assert key(cut) == key(whole)


@pytest.mark.parametrize("alpha", [0.9, 0.5, 0.3, 2 / 21, 1 / 14, 0.001])
def test_averages_of_any_weight(spark, alpha):
    from barflow.functions.ema import reach, with_ema

    df = B.with_pos(long_series(spark, 7000))
    got = [r.e for r in in_blocks(df, reach(alpha), 0, lambda d: with_ema(d, {"e": (F.col("close"), alpha)})).orderBy("pos").collect()]
    y = None
    for r, g in zip(df.orderBy("pos").collect(), got):
        y = r.close if y is None else y + alpha * (r.close - y)
        assert g == pytest.approx(y, rel=1e-11)


def test_operators_do_not_depend_on_blocks(spark, monkeypatch):
    """Blocks far smaller than a series give what one block gives."""
    b = long_series(spark, 1500)
    forms = {
        "swings": lambda: S.swings(B.with_pos(b)).select("pos", "kind", "price"),
        "structure": lambda: S.with_rolling_structure(B.with_pos(b)).select("pos", "smc_bias", "near.price"),
        "breaks": lambda: G.breaks(B.with_pos(b), "internal"),
        "blocks": lambda: G.live_order_blocks(B.with_pos(b), "internal"),
        "zones": lambda: H._found(B.with_pos(b)).selectExpr("kind", "x1", "x2", "round(top, 9)", "round(delta, 9)", "round(hi, 9)", "round(lo, 9)"),
        "spike": lambda: H.with_spike(B.with_pos(b)).select("pos", "spike"),
        "entropy": lambda: I.with_entropy(B.with_pos(b), causal=True).selectExpr("pos", "round(entropy_20, 9)"),
        "barrier": lambda: X.triple_barrier(X.matrix(b)).selectExpr("ts", "label", "label_bars", "round(rsi, 9)", "round(zone_dist_atr, 9)"),
    }
    want = {k: sorted(map(str, f().collect())) for k, f in forms.items()}
    monkeypatch.setattr(blocks, "BLOCK", 64)
    for k, f in forms.items():
        assert sorted(map(str, f().collect())) == want[k] and want[k], k
