"""Order statistics and ranks equal sorted values, with ties, ends and few values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from barflow.functions import ranks

SCHEMA = "symbol string, timeframe string, v double"


def values():
    rnd = random.Random(3)
    return {
        "many": [rnd.random() for _ in range(3000)],
        "ties": [rnd.choice([0.0, 0.25, 0.250001, 1.0]) for _ in range(500)],
        "close": [0.5 + i * 1e-12 for i in range(400)],
        "one": [0.3],
        "ends": [0.0, 1.0],
    }


def frame(spark):
    return spark.createDataFrame([(s, "1H", v) for s, vs in values().items() for v in vs] + [("many", "1H", None)], SCHEMA).repartition(5)


@pytest.mark.parametrize("bins", [4, 1 << 16])
def test_order_statistics_and_quantiles(spark, monkeypatch, bins):
    monkeypatch.setattr(ranks, "BINS", bins)
    df, rnd = frame(spark), random.Random(4)
    targets = [(s, "1H", str(k), k) for s, vs in values().items() for k in {0, len(vs) - 1, len(vs), *(rnd.randrange(len(vs)) for _ in range(20))}]
    got = {(r.symbol, int(r.name)): r.found for r in ranks.order_statistics(df, "v", spark.createDataFrame(targets, "symbol string, timeframe string, name string, rank long")).collect()}
    assert got == {(s, k): sorted(values()[s])[k] for s, _, _, k in targets if k < len(values()[s])}
    qs = [0.0, 0.1, 0.5, 0.7, 1.0]
    for r in ranks.quantiles(df, "v", qs).collect():
        vs = sorted(values()[r.symbol])
        for q, v in zip(qs, r.q):
            at = q * (len(vs) - 1)
            a, b = vs[math.floor(at)], vs[math.ceil(at)]
            assert v == a + (b - a) * (at - math.floor(at))


@pytest.mark.parametrize("bins", [4, 1 << 16])
def test_weight_below(spark, monkeypatch, bins):
    monkeypatch.setattr(ranks, "BINS", bins)
    by = frame(spark).where("v is not null").groupBy("symbol", "timeframe", "v").agg(F.count("*").alias("n"))
    for r in ranks.below(by, "v", "n").collect():
        assert r.below == sum(x < r.v for x in values()[r.symbol])


def test_no_window_over_values_is_by_series_alone(spark):
    plan = ranks.quantiles(frame(spark), "v", [0.5])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    assert windows and all("_s" in line.split("windowspecdefinition(")[1] for line in windows)
    assert "percentile" not in plan
