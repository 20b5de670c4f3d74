"""Hand-made series, random series against sequential definitions, and invariants."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barflow.operators import evaluation as E
from barflow.operators import features as X
from barflow.operators import indicators as I
from barflow.operators import structure as G
from barflow.operators import supply_demand as H
from barflow.operators import swings as S
from barflow.operators import volume_profile as V
from barflow.sources import bars as B

T0 = datetime(2024, 1, 1)


def frame(spark, rows, step=60):
    """rows of (open, high, low, close, volume) as one hourly series."""
    data = [("s", "1H", T0 + timedelta(minutes=step * i), *map(float, r)) for i, r in enumerate(rows)]
    return B.with_pos(spark.createDataFrame(data, B.BAR_SCHEMA))


def flat(closes):
    return [(c, c, c, c, 1) for c in closes]


def walk(n, seed):
    rnd, p, out = random.Random(seed), 100.0, []
    for _ in range(n):
        o = p
        p = max(1.0, p + rnd.gauss(0, 1))
        out.append((o, max(o, p) + abs(rnd.gauss(0, 0.5)), min(o, p) - abs(rnd.gauss(0, 0.5)), p, rnd.randrange(1, 50)))
    return out


def test_constant_closes(spark):
    df = I.with_entropy(I.with_averages(I.with_rsi(frame(spark, flat([5] * 30))), {"e": 20}))
    assert {(r.rsi, round(r.e, 9), r.entropy_20) for r in df.collect()} == {(100.0, 5.0, None)}


def test_averages_over_several_blocks(spark):
    rows = walk(1500, 1)
    got = [r.e for r in I.with_averages(frame(spark, rows), {"e": 50}).orderBy("pos").collect()]
    y = rows[0][3]
    for r, g in zip(rows, got):
        y = y + 2 / 51 * (r[3] - y)
        assert g == pytest.approx(y, rel=1e-12)


def test_rsi_over_several_blocks(spark):
    rows = walk(700, 2)
    got = [r.rsi for r in I.with_rsi(frame(spark, rows)).orderBy("pos").collect()]
    gain = loss = 0.0
    for i, g in enumerate(got):
        if i:
            d = rows[i][3] - rows[i - 1][3]
            up, down = max(d, 0), max(-d, 0)
            gain, loss = (up, down) if i == 1 else (gain + (up - gain) / 14, loss + (down - loss) / 14)
        assert g == pytest.approx(100 - 100 / (1 + gain / loss) if loss else 100, rel=1e-9)


def test_plateau_and_outside_bar(spark):
    rows = [(1, 2, 1, 1.5, 1)] * 20
    assert S.swings(frame(spark, rows)).groupBy("kind").count().orderBy("kind").collect()[0]["count"] == 10
    rows = [(5, 6, 4, 5, 1)] * 5 + [(5, 9, 1, 5, 1)] + [(5, 6, 4, 5, 1)] * 5
    assert sorted((r.pos, r.kind) for r in S.swings(frame(spark, rows)).collect()) == [(5, "high"), (5, "low")]


def test_zone_clusters(spark):
    p = 100.0
    z = spark.range(1).select(S.zones_of(F.array(F.lit(p * 1.004), F.lit(p)), F.array(F.lit(p * 1.002), F.lit(p * 1.008))).alias("z")).first().z
    assert [(round(x.bottom, 6), round(x.top, 6), x.touches, x.kind) for x in z] == [(p, round(p * 1.004, 6), 3, "resistance"), (round(p * 1.008, 6), round(p * 1.008, 6), 1, "support")]


def test_barriers(spark):
    base = dict(rsi=0.5, macd_pct=0.0, ema_cross=0.0, atr_pct=1.0, ret_1=0.0, ret_5=0.0, entropy_20=0.5, smc_bias=0, zone_dist_atr=1.0, at_zone=0)

    def labels(highs_lows):
        data = [("s", "1H", T0 + timedelta(hours=i), *base.values(), float(h), float(l), 100.0) for i, (h, l) in enumerate(highs_lows)]
        df = spark.createDataFrame(data, ["symbol", "timeframe", "ts", *base, "high", "low", "close"])
        return [(r.label, r.label_bars) for r in X.triple_barrier(df, 3).orderBy("ts").collect()]

    calm = (100.5, 99.5)
    assert labels([calm] * 6) == [(0, 3)] * 3
    assert labels([calm, calm, (103, 98), calm, calm, calm])[:2] == [(0, 2), (0, 1)]
    assert labels([calm, (103, 99.5), calm, calm, calm])[0] == (1, 1)
    assert labels([calm, (100, 98.9), (103, 99.5), calm, calm])[0] == (0, 1)


def test_gaps(spark):
    up = [(1, 2, 1, 2, 1), (2, 4, 2, 4, 1), (4, 5, 3, 5, 1)]
    assert [(r.kind, r.top, r.bottom) for r in S.fair_gaps_basic(frame(spark, up)).collect()] == [("bullish", 3.0, 2.0)]
    down = [(5, 5, 4, 4, 1), (4, 4, 2, 2, 1), (2, 3, 1, 1, 1)]
    assert [(r.kind, r.top, r.bottom) for r in S.fair_gaps_basic(frame(spark, down)).collect()] == [("bearish", 4.0, 3.0)]


def test_breaks_against_a_scan(spark):
    for seed in range(3):
        rows = walk(400, seed + 10)
        df = frame(spark, rows)
        for scope, z in G.SCOPES.items():
            hi, lo, close = [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows]
            leg, bias, up, down, want = 0, None, None, None, []
            for i in range(len(rows)):
                new = leg
                if i >= z:
                    if hi[i - z] > max(hi[i - z + 1 : i + 1]):
                        new = 0
                    elif lo[i - z] < min(lo[i - z + 1 : i + 1]):
                        new = 1
                if new != leg:
                    if new == 0:
                        up = [hi[i - z], i - z, False]
                    else:
                        down = [lo[i - z], i - z, False]
                leg = new
                if up and not up[2] and i and close[i] > up[0] and close[i - 1] <= up[0]:
                    want.append((i, up[1], "bull", "CHoCH" if bias == "bear" else "BOS"))
                    bias, up[2] = "bull", True
                if down and not down[2] and i and close[i] < down[0] and close[i - 1] >= down[0]:
                    want.append((i, down[1], "bear", "CHoCH" if bias == "bull" else "BOS"))
                    bias, down[2] = "bear", True
            got = sorted((r.pos, r.pivot_pos, r.side, r.tag) for r in G.breaks(df, scope).collect())
            assert got == sorted(want) and want


def test_cooldown(spark):
    found = spark.createDataFrame([("s", "1H", "supply", x) for x in (10, 23, 24, 37, 38, 60)], "symbol string, timeframe string, kind string, x2 long")
    assert sorted(r.x2 for r in H.cooled(found).collect()) == [10, 24, 38, 60]


def test_value_area_grows_upward(spark):
    rows = [(1, 10, 0, 5, 100), (1, 10, 0, 5, 100), (4, 6, 4, 5, 50)]
    r = V.profile(frame(spark, rows)).first()
    assert r.va_low <= r.poc_price <= r.va_high


def test_conformal_rank(spark):
    def q(n):
        rows = [("s", "1H", T0 + timedelta(hours=i), i / 1000, 0) for i in range(n)]
        return E.conformal(spark.createDataFrame(rows, "symbol string, timeframe string, ts timestamp, proba double, label int")).collect()

    assert q(95) == []
    assert q(100)[0].q_hat == pytest.approx((80 + 18) / 1000)


def test_folds_are_disjoint_and_ordered(spark):
    rows = [("s", "1H", T0 + timedelta(hours=i), 0.5, i % 2) for i in range(100)]
    t = E.fold_table(spark.createDataFrame(rows, "symbol string, timeframe string, ts timestamp, proba double, label int")).orderBy("fold").collect()
    assert [(r.n_train, r.n_test) for r in t] == [(20, 16), (36, 16), (52, 16), (68, 16), (84, 16)]
    assert all(a.test_to < b.test_from for a, b in zip(t, t[1:]))


def test_macro_days_without_bars(spark):
    bars = frame(spark, flat([1, 1, 1]), step=1440)
    macro = spark.createDataFrame([(T0.date() - timedelta(days=1), 10.0, 20.0, 5.0), (T0.date() + timedelta(days=2), 12.0, 60.0, 4.0)], "day date, dxy double, vix double, tnx double")
    plain = [(r.vix_level, r.tnx_level) for r in X.attach_macro(bars, macro).orderBy("ts").collect()]
    assert plain == [(1.0, 0.4)] * 3
    asof = [(r.vix_level, r.tnx_level) for r in X.attach_macro_asof(bars, macro).orderBy("ts").collect()]
    assert asof == [(0.4, 0.5), (0.4, 0.5), (1.0, 0.4)]


def test_trade_log(spark, tmp_path):
    rows = spark.createDataFrame([(0.5,), (1.5,), (None,)], "tier_a_prob double")
    bad = B.append_log(rows, f"{tmp_path}/log")
    assert bad.count() == 2 and spark.read.parquet(f"{tmp_path}/log").count() == 1


def test_series_round_trip(spark, tmp_path):
    df = frame(spark, walk(20, 3)).drop("pos")
    B.write_series(df, f"{tmp_path}/bars")
    B.write_series(df.limit(5), f"{tmp_path}/bars")
    assert B.read_bars(spark, f"{tmp_path}/bars", "s", "1H").count() == 5
    df.select("ts", "open", "high", "low", "close", "volume").coalesce(1).write.option("header", True).csv(f"{tmp_path}/csv")
    assert B.read_bars(spark, f"{tmp_path}/csv", "s", "1H", "csv").count() == 20
    assert B.read_macro(spark, f"{tmp_path}/none").count() == 0


def test_invariants(spark):
    m = X.matrix(frame(spark, walk(300, 7)).drop("pos"))
    assert m.where("rsi < 0 or rsi > 1 or entropy_20 < 0 or entropy_20 > 1.000001 or atr_pct <= 0").count() == 0
    l = X.triple_barrier(m)
    assert l.where("label_bars < 1 or label_bars > 10").count() == 0
    assert not math.isnan(m.agg(F.sum("macd_pct")).first()[0])
