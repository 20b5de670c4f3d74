import datetime as dt
import math
import random

import numpy as np
from pyspark.sql import functions as F

from barflow.operators import indicators as I
from barflow.operators import training as T
from barflow.operators import trees
from barflow.plans.queries import QUERIES, bars
from barflow.sources import bars as B

SMALL = "/root/testdata/sf0.01"


def test_streamed_bars_equal_batch_bars(spark):
    streamed = {(r.symbol, r.ts): (r.open, r.high, r.low, r.close, r.volume) for r in QUERIES["stream_bars"](spark, SMALL).collect()}
    batch = {(r.symbol, r.ts): (r.open, r.high, r.low, r.close, r.volume) for r in QUERIES["bars_from_ticks_1h"](spark, SMALL).collect()}
    # the last buckets stay open until the watermark passes them
    assert len(streamed) >= len(batch) - 5 * 4 and all(batch[k] == v for k, v in streamed.items())


def test_streamed_averages_equal_windows(spark):
    got = {(r.symbol, r.ts): (r.ema, r.rsi, r.atr) for r in QUERIES["stream_ema"](spark, SMALL).collect()}
    df = I.with_atr(I.with_rsi(I.with_averages(B.with_pos(bars(spark, SMALL)), {"e": 20})))
    want = {(r.symbol, r.ts): (r.e, r.rsi, r.atr) for r in df.collect()}
    assert got.keys() == want.keys()
    assert max(abs(a - b) for k in got for a, b in zip(got[k], want[k])) < 1e-5


def test_reading_stream(spark):
    assert QUERIES["stream_reading"](spark, SMALL).count() == 5


def test_late_ticks_are_dropped(spark, tmp_path):
    from barflow.streaming.live import stream_bars

    schema = "symbol string, ts timestamp, price double, volume double, event_id long"
    day = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    batches = [[("a", day(0, 5), 1.0, 1.0, 1), ("a", day(6), 2.0, 1.0, 2)], [("a", day(0, 30), 9.0, 1.0, 3), ("a", day(5), 3.0, 1.0, 4), ("a", day(12), 4.0, 1.0, 5)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = stream_bars(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.ts.hour, r.high, r.volume) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, 1.0, 1.0), (5, 3.0, 1.0), (6, 2.0, 1.0)]  # 00:30 came past the watermark of 04:00


def test_readings_keep_only_the_tails(spark, tmp_path):
    from barflow.streaming.live import stream_readings

    every = bars(spark, SMALL).where("symbol in ('click', 'view')")
    for k in range(3):
        part = every.where((F.col("ts") >= F.lit(dt.datetime(2024, 1, 1 + 9 * k))) & (F.col("ts") < F.lit(dt.datetime(2024, 1, 10 + 9 * k))))
        part.where("symbol = 'click'" if k == 1 else "true").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(B.BAR_SCHEMA).parquet(str(tmp_path / "in"))
        stream_readings(source, str(tmp_path / "readings"), lambda b: b.groupBy(*B.SERIES).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")), str(tmp_path / "state"), window=150).awaitTermination()
    got = {r.symbol: r for r in spark.read.parquet(str(tmp_path / "readings")).collect()}
    seen = every.where(F.col("ts") < F.lit(dt.datetime(2024, 1, 28)))
    click, view = seen.where("symbol = 'click'"), seen.where("symbol = 'view'").where((F.dayofmonth("ts") < 10) | (F.dayofmonth("ts") >= 19))
    for name, rows in (("click", click), ("view", view)):
        want = B.tail(rows, 150).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")).first()
        assert (got[name].n, got[name].first, got[name].last) == tuple(want)


def test_silent_series_become_stale_and_come_back(spark, tmp_path):
    from barflow.streaming.live import stream_stale

    bar = lambda s, m: (s, "1m", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), 1.0, 1.0, 1.0, 1.0, 1.0)
    got, seen = {}, []
    for k, rows in enumerate([[bar("a", 0), bar("b", 0)], [bar("a", 1), bar("a", 2)], [bar("a", 3)], [bar("b", 4), bar("a", 4)], [bar("a", 9)]]):
        spark.createDataFrame(rows, B.BAR_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = stream_stale(spark.readStream.schema(B.BAR_SCHEMA).parquet(str(tmp_path / "in")))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        last = spark.read.parquet(str(tmp_path / "out")).groupBy("symbol").agg(F.max_by("stale", F.struct("last_ts", "stale")).alias("stale")).collect()
        got = {r.symbol: r.stale for r in last}
        seen.append((got["a"], got["b"]))
    # at minute 2 b is 2 behind: not more than two bars; at 3 it is; at 9 again
    assert seen == [(False, False), (False, False), (False, True), (False, False), (False, True)]


def test_state_of_tails_does_not_grow(spark, tmp_path):
    from barflow.streaming.live import stream_tails

    sizes = []
    for k in range(6):
        rows = [("a", "1m", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=60 * k + i), *([float(i)] * 5)) for i in range(60)]
        spark.createDataFrame(rows, B.BAR_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = stream_tails(spark.readStream.schema(B.BAR_SCHEMA).parquet(str(tmp_path / "in")), 100).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        sizes.append(sum(op["numRowsTotal"] for p in query.recentProgress[-1:] for op in p["stateOperators"]))
    assert sizes[-1] == sizes[2]
    out = spark.read.parquet(str(tmp_path / "out")).groupBy(F.input_file_name()).count().collect()
    assert sorted(r["count"] for r in out if r["count"]) == [60, 100, 100, 100, 100, 100]


def test_models(spark):
    r = QUERIES["train_logreg"](spark, SMALL).collect()
    assert len(r) == 5 and all(0 < x.brier < 0.3 and x.optimal for x in r)
    p = QUERIES["platt"](spark, SMALL)
    assert p.where("proba < 0 or proba > 1 or proba is null").count() == 0
    imp = QUERIES["feature_importance"](spark, SMALL).collect()
    assert len({x.symbol for x in imp}) == 5
    for s in {x.symbol for x in imp}:
        own = [abs(x.coefficient) for x in imp if x.symbol == s]
        assert own == sorted(own, reverse=True)


def series(n, of, names="ab", timeframe="15m"):
    """n labelled rows (x, y, label) of each name; of(i, name) gives them."""
    return [(s, timeframe, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=15 * i), *of(i, s)) for s in names for i in range(n)]


LABELED = "symbol string, timeframe string, ts timestamp, x double, y double, label int"


def test_a_pairs_model_is_fitted_on_its_own_rows(spark):
    rows = spark.createDataFrame(series(120, lambda i, s: (float(i % 7), 0.0, int((i % 7 > 3) == (s == "a")))), LABELED)
    model = T.calibrated(rows, ["x"])
    (up,), (down,) = ([r.coefficient for r in T.importance(model, rows, ["x"]).where(F.col("symbol") == s).collect()] for s in "ab")
    assert up > 0 > down
    got = T.score(rows, model, ["x"]).collect()
    assert len(got) == 240 and all((r.proba > 0.5) == (r.label == 1) for r in got)


def test_probabilities_minimise_the_penalised_loss(spark, tmp_path):
    """Each fold's model of the rows before it, intercept penalised: no coordinate move is better, and its probabilities follow from it."""
    rnd = random.Random(4)
    draw = lambda i, s: (x := rnd.gauss(0, 1), y := rnd.gauss(5, 3), int(rnd.random() < 1 / (1 + math.exp(-(x + 0.1 * y - 0.2)))))  # noqa: E731, F841
    rows = spark.createDataFrame(series(300, draw), LABELED)
    scored, model = T.out_of_sample(rows, ["x", "y"])
    assert model.where("residual > 1e-9").count() == 0
    parts = {r.symbol: r.parts for r in model.collect()}
    for s in "ab":
        data = [(r.fold, r.x, r.y, r.label, r.proba) for r in scored.where(F.col("symbol") == s).orderBy("ts").collect()]
        assert [d[0] for d in data] == [max(0, (i - 50) // 50 + 1) if i >= 50 else 0 for i in range(300)]
        for k in range(1, 6):
            train = [d for d in data if d[0] < k]
            n, p = len(train), parts[s][k - 1]
            scale = []
            for c in (1, 2):
                m = sum(d[c] for d in train) / n
                scale.append((m, math.sqrt(sum((d[c] - m) ** 2 for d in train) / n)))
            w = [p.w[j] * scale[j][1] for j in range(2)]
            w.append(p.bias + sum(p.w[j] * scale[j][0] for j in range(2)))
            z = lambda d, w: sum(w[j] * (d[1 + j] - scale[j][0]) / scale[j][1] for j in range(2)) + w[2]  # noqa: B023, E731
            loss = lambda w: sum(map(abs, w)) + T.C * sum(math.log1p(math.exp(-z(d, w) if d[3] else z(d, w))) for d in train)  # noqa: B023, E731
            best = loss(w)
            for j in range(3):
                for e in (1e-3, -1e-3):
                    assert loss([v + e * (i == j) for i, v in enumerate(w)]) > best - 1e-10
            for d in data:
                if d[0] == k:
                    assert abs(d[4] - 1 / (1 + math.exp(-z(d, w)))) < 1e-9
    T.save(model, str(tmp_path / "model"))
    assert sorted(map(str, T.load(spark, str(tmp_path / "model")).collect())) == sorted(map(str, model.collect()))


def test_calibration_minimises_the_smoothed_loss(spark):
    rnd = random.Random(5)
    rows = spark.createDataFrame(series(240, lambda i, s: (x := rnd.gauss(0, 1), 0.0, int(rnd.random() < 1 / (1 + math.exp(-2 * x)))), "a"), LABELED)
    (parts,) = [r.parts for r in T.calibrated(rows, ["x"]).collect()]
    data = [(r.x, r.label) for r in rows.orderBy("ts").collect()]
    for k, p in enumerate(parts):
        test = data[40 * (k + 1) : 40 * (k + 2)]
        ones = sum(y for _, y in test)
        hi, lo = (ones + 1) / (ones + 2), 1 / (len(test) - ones + 2)
        loss = lambda a, b: sum(math.log1p(math.exp(z)) - (hi if y else lo) * z for x, y in test for z in [a * (p.bias + p.w[0] * x) + b])  # noqa: B023, E731
        best = loss(p.slope, p.shift)
        assert all(loss(p.slope + e, p.shift + f) > best - 1e-10 for e, f in ((1e-3, 0), (-1e-3, 0), (0, 1e-3), (0, -1e-3)))


def test_run_index_has_every_pair(spark):
    got = {(r.symbol, r.timeframe): r for r in QUERIES["run_index"](spark, SMALL).collect()}
    assert len(got) == 10
    assert all(r.status == ("skipped" if t == "1H" else "ok") and r.rows > 0 for (_, t), r in got.items())  # 1H has some 600 rows of 1500


def test_run_index_without_a_trained_pair(spark):
    few = spark.createDataFrame(series(30, lambda i, s: (0.0, 0.0, i % 2)), LABELED).selectExpr("symbol", "timeframe", "ts", "label", *(f"cast(x as double) as {c}" for c in T.TECHNICAL))
    assert {(r.symbol, r.status) for r in T.run_pairs(few, B.timeframes(spark)).collect()} == {("a", "skipped"), ("b", "skipped")}


def test_inner_fits_are_the_published_splits():
    fits = trees.inner_fits([("a", "15m", 100)], 5, 3)
    assert len(fits) == 15 and [f["slot"] for f in fits] == list(range(15))
    # outer folds of 16 rows test from 20 on; inner ones are a quarter of the rows before
    assert [(f["fold"], f["a"], f["b"]) for f in fits[:4]] == [(1, 5, 10), (1, 10, 15), (1, 15, 20), (2, 9, 18)]
    assert all(f["b"] <= 20 + 16 * (f["fold"] - 1) for f in fits)


def grown_alone(codes, label, w, depth, columns):
    """One tree by looking at every split of every node: rows -> value."""
    total, ones = sum(w), sum(a * b for a, b in zip(w, label))
    mixed = lambda n, y: 2 * y * (n - y) / n
    best = (1e-10, None)
    for c in columns if depth else ():
        for cut in range(trees.BINS - 1):
            left = [i for i in range(len(w)) if codes[i][c] <= cut]
            n, y = sum(w[i] for i in left), sum(w[i] * label[i] for i in left)
            if 0 < n < total and (gain := mixed(total, ones) - mixed(n, y) - mixed(total - n, ones - y)) > best[0] + 1e-9:
                best = (gain, (c, cut))
    if not best[1]:
        return lambda row: ones / total
    c, cut = best[1]
    sides = [[i for i in range(len(w)) if (codes[i][c] <= cut) == side and w[i]] for side in (True, False)]
    yes, no = (grown_alone([codes[i] for i in s], [label[i] for i in s], [w[i] for i in s], depth - 1, columns) for s in sides)
    return lambda row: (yes if row[c] <= cut else no)(row)


def test_trees_grow_as_one_by_one(spark, monkeypatch):
    """A forest whose nodes may split on all columns, against trees grown node by node on the same samples; pairs, fits and parts apart."""
    rnd = random.Random(6)
    rows = spark.createDataFrame(series(90, lambda i, s: (x := rnd.gauss(0, 1), y := rnd.gauss(0, 1), int(x * y + rnd.gauss(0, 0.3) > 0))), LABELED).repartition(5)  # noqa: F841
    monkeypatch.setattr(trees, "_drawn", lambda q, t, nodes, width: np.tile(np.arange(width), (nodes, 1)))
    table, pairs = T.training_rows(rows, ["x", "y"])
    table = trees.binned(table, pairs, 2)
    fits = trees.inner_fits(pairs, 5, 3)
    done = trees.fitted(table, fits, "random_forest", 2, {"trees": 3, "depth": 3})
    data = {p: sorted((r.pos, r.label, list(r.codes)) for r in table.where(F.col("pair") == p).collect()) for p in (0, 1)}
    for q in (0, 7, 14, 15, 29):
        mine = [d for d in data[fits[q]["pair"]] if d[0] < fits[q]["a"]]
        every = np.array([d[2] for d in data[fits[q]["pair"]]], np.uint8)
        for t in range(3):
            w = trees._bootstrap(np.array([d[0] for d in mine]), q, t).astype(float)
            drawn = [(d, v) for d, v in zip(mine, w) if v]
            alone = grown_alone([d[2] for d, _ in drawn], [d[1] for d, _ in drawn], [v for _, v in drawn], 3, (0, 1))
            assert np.allclose(done.trees.scores(q, t, every), [alone(c) for c in every], atol=1e-6)


def test_levels_read_packed_rows(spark):
    """Training reads blocks: far fewer values than rows, each row in one; chosen rows lie column by column."""
    rows = spark.createDataFrame(series(90, lambda i, s: (float(i % 7), float(i % 5), i % 2)), LABELED)
    table, pairs = T.training_rows(rows, ["x", "y"])
    table = trees.binned(table, pairs, 2)
    blocks = trees.packed(table, 2)
    want = sorted((r.pair, r.pos, r.fold, r.label, *r.codes, *r.x) for r in table.collect())
    assert blocks.count() <= 2 * table.rdd.getNumPartitions() < len(want) and trees.packed(blocks, 2) is blocks
    got = []
    for p, b in trees._blocks(blocks.toArrow().to_batches(), 2):
        got += [(p, *map(int, (n, f, y)), *map(int, c), *x.tolist()) for n, f, y, c, x in zip(b["pos"], b["fold"], b["label"], b["codes"], b["x"])]
        assert trees._some(b["codes"], np.arange(3)).flags.f_contiguous
    assert sorted(got) == want


def test_boosting_with_settled_margins_is_the_same(spark, monkeypatch):
    rnd = random.Random(7)
    rows = spark.createDataFrame(series(90, lambda i, s: (x := rnd.gauss(0, 1), y := rnd.gauss(0, 1), int(x + y * y + rnd.gauss(0, 0.3) > 1))), LABELED)  # noqa: F841
    table, pairs = T.training_rows(rows, ["x", "y"])
    table, fits = trees.binned(table, pairs, 2), trees.inner_fits(pairs, 5, 3)
    codes = np.array([list(r.codes) for r in table.collect()], np.uint8)
    for kind, size in (("gradient_boost", {"rounds": 5, "depth": 2}), ("ada_boost", {"rounds": 6})):
        got = []
        for every in (100, 2):
            monkeypatch.setattr(trees, "SETTLED", every)
            done = trees.fitted(table, fits, kind, 2, size)
            got.append([done.scores(q, codes, None) for q in range(len(fits))])
        assert np.allclose(got[0], got[1], atol=1e-9) and np.std(got[0]) > 0.01


def test_isotonic_and_benchmarks(spark):
    x, p = trees._isotonic([(0, 2, 0), (10, 2, 2), (20, 2, 0), (30, 1, 1)])
    assert x == [0, 0.001, 0.002, 0.003] and p == [0, 0.5, 0.5, 1]
    rows = spark.createDataFrame(series(400, lambda i, s: (float(i % 11), float(i % 5), int((i % 11 > 5) == (s == "a")))), LABELED)
    got = {(r.symbol, r.model): r for r in trees.benchmarks(rows, ["x", "y"], rounds={"random_forest": {"trees": 8}, "gradient_boost": {"rounds": 5}, "ada_boost": {"rounds": 3}}).collect()}
    assert set(got) == {(s, m) for s in "ab" for m in trees.BENCHMARKS}
    assert all(r.brier < 0.15 and r.auc > 0.9 and r.train_s > 0 and abs(r.confidence + r.brier - 1) < 1e-9 for r in got.values())


def test_cards_and_readings_come_from_the_trained_model(spark, monkeypatch):
    monkeypatch.setattr(trees, "benchmarks", lambda rows: rows.select(*B.SERIES).distinct().selectExpr("*", "'naive_bayes' as model", "0.2 as brier", "0.6 as auc", "0.8 as confidence", "1.0D as train_s"))
    cards = {(r.symbol, r.model): r for r in QUERIES["model_cards"](spark, SMALL).collect()}
    assert len(cards) == 10 and {m for _, m in cards} == {"LogReg-L1", "naive_bayes"}
    assert all(len(r.spark) == (30 if r.active else 20) and r.accuracy >= 0 for r in cards.values())
    assert all(0.1 < r.brier < 0.25 and 0.6 < r.auc < 1 for r in cards.values() if r.active)
    got = QUERIES["reading_trained"](spark, SMALL).collect()
    assert {(r.timeframe, r.is_probability) for r in got} == {("15m", True), ("1H", False)} and len(got) == 10
    for r in got:
        assert (r.probability_lo < r.probability < r.probability_hi or r.probability in (0, 1)) if r.is_probability else r.probability_lo == r.probability == r.probability_hi
        assert r.ev_positive == (r.probability_lo > 1 / 3)


def test_rows_walk_trees_by_columns_of_codes():
    rng = np.random.default_rng(3)
    codes, grown = rng.integers(0, trees.BINS, (500, 4)).astype(np.uint8), trees.Trees(1, 1, 5)
    grown.column[0, 0, :31] = rng.integers(-1, 4, 31)
    grown.bin[0, 0, :31] = rng.integers(0, trees.BINS, 31)
    want = []
    for c in codes:
        at = 0
        while at < 31 and grown.column[0, 0, at] >= 0:
            at = 2 * at + 1 + int(c[grown.column[0, 0, at]] > grown.bin[0, 0, at])
        want.append(at)
    assert grown.node(0, 0, codes).tolist() == want


def test_training_rows_are_dealt_over_tasks(spark, monkeypatch):
    """Adaptive shuffles leave a few files; the passes of training read as many parts as the rows deserve, whatever the input's."""
    rows = [("s", "15m", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=15 * i), float(i % 7), float(i % 5), i % 2) for i in range(600)]
    labeled = spark.createDataFrame(rows, "symbol string, timeframe string, ts timestamp, a double, b double, label int").coalesce(1)
    monkeypatch.setattr(T, "LEAST_ROWS", 100)
    few, pairs = T.training_rows(labeled, ["a", "b"], 5)
    assert pairs == [("s", "15m", 600)] and few.count() == 600
    assert len({r.f for r in few.selectExpr("input_file_name() as f").collect()}) == 6
    monkeypatch.setattr(T, "PART_ROWS", 50)
    assert len({r.f for r in T.training_rows(labeled, ["a", "b"], 5)[0].selectExpr("input_file_name() as f").collect()}) == 12
