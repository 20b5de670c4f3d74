"""Streams: ticks to bars, incremental averages per series, refreshed readings, stale series."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from barflow.sources.bars import BAR_SCHEMA, RULES, SERIES

LATE = "2 hours"


def stream_bars(ticks: DataFrame, timeframe: str = "1H", late: str = LATE) -> DataFrame:
    """Closed bars of a tick stream (symbol, ts, price, volume, event_id); ticks past the watermark are dropped."""
    seq = F.struct("ts", "event_id")
    g = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", RULES[timeframe]).alias("w"))
    out = g.agg(F.min_by("price", seq).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", seq).alias("close"), F.sum("volume").alias("volume"))
    return out.select("symbol", F.lit(timeframe).alias("timeframe"), F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


class Averages(StatefulProcessor):
    """EMA, Wilder RSI and ATR of each series, one state row a series; bars of a batch are taken in time order."""

    def __init__(self, span: int = 20, n: int = 14):
        self.alpha, self.wilder = 2.0 / (span + 1), 1.0 / n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "pos long, close double, ema double, gain double, loss double, atr double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        bars = pd.concat([r[["ts", "high", "low", "close"]] for r in rows]).sort_values("ts")  # one trigger's bars of a series
        pos, close, ema, gain, loss, atr = self.state.get() if self.state.exists() else (-1, 0.0, 0.0, 0.0, 0.0, 0.0)
        out = []
        for ts, high, low, now in bars.itertuples(index=False):
            pos += 1
            span = high - low
            if pos == 0:
                ema, atr = now, span
            else:
                up, down = max(now - close, 0.0), max(close - now, 0.0)
                ema += self.alpha * (now - ema)
                atr += self.wilder * (max(span, abs(high - close), abs(low - close)) - atr)
                gain, loss = (up, down) if pos == 1 else (gain + self.wilder * (up - gain), loss + self.wilder * (down - loss))
            close = now
            rsi = 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss)
            out.append((*key, ts, pos, ema, rsi, atr))
        self.state.update((pos, close, ema, gain, loss, atr))
        yield pd.DataFrame(out, columns=["symbol", "timeframe", "ts", "pos", "ema", "rsi", "atr"])

    def close(self) -> None:
        pass


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _keyed(bars: DataFrame, processor: StatefulProcessor, shape: str, time: str = "None") -> DataFrame:
    """A processor over a stream's series.  Keyed state of this kind needs the RocksDB store: set it, or have it set."""
    conf = bars.sparkSession.conf
    if conf.get("spark.sql.streaming.stateStore.providerClass", None) != ROCKS:
        conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return bars.groupBy(*SERIES).transformWithStateInPandas(statefulProcessor=processor, outputStructType=shape, outputMode="append", timeMode=time)


def stream_averages(bars: DataFrame, span: int = 20) -> DataFrame:
    """Per bar of a stream its position in the series, EMA, RSI and ATR.

    A trigger's bars of a series are put in order together: bound triggers (maxFilesPerTrigger) over files in time order."""
    return _keyed(bars, Averages(span), "symbol string, timeframe string, ts timestamp, pos long, ema double, rsi double, atr double")


class Tail(StatefulProcessor):
    """The last bars of each series as keyed state of bounded size; a trigger gives them for the series that it touches."""

    def __init__(self, window: int):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bars = handle.getListState("bars", "ts timestamp, open double, high double, low double, close double, volume double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = [pd.DataFrame(list(self.bars.get()), columns=BAR)] if self.bars.exists() else []
        for part in rows:  # never more than the window and one part
            kept = [pd.concat([*kept, part[BAR]]).drop_duplicates("ts", keep="last").sort_values("ts").tail(self.window)]
        out = kept[0]
        self.bars.put([tuple(r) for r in out.itertuples(index=False)])
        yield out.assign(symbol=key[0], timeframe=key[1])[["symbol", "timeframe", *BAR]]

    def close(self) -> None:
        pass


BAR = ["ts", "open", "high", "low", "close", "volume"]


def stream_tails(bars: DataFrame, window: int = 200) -> DataFrame:
    """In every trigger the last `window` bars of each series that got bars; of bars with one timestamp the last counts."""
    return _keyed(bars, Tail(window), BAR_SCHEMA)


def stream_readings(bars: DataFrame, sink: str, reading: Callable[[DataFrame], DataFrame], checkpoint: str, window: int = 200) -> StreamingQuery:
    """On every batch of closed bars: rewrites the readings of the batch's series from their last `window` bars.

    Those bars are keyed state, so a batch reads nothing but itself and the state of its series."""

    def refresh(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            # a batch that is run again after a failure gives the same readings again
            reading(batch).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*SERIES).parquet(sink)

    return stream_tails(bars, window).writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Silence(StatefulProcessor):
    """An event-time timer a series: it fires where the newest bar of all is too far from the series' last."""

    def __init__(self, seconds: dict[str, int], intervals: int):
        self.limit = {k: intervals * v for k, v in seconds.items()}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "ts timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = max(r["ts"].max() for r in rows)
        before = self.last.get()[0] if self.last.exists() else None
        if before is not None and pd.Timestamp(before) >= last:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((last.to_pydatetime(),))
        if key[1] in self.limit:  # past the limit, not at it
            self.handle.registerTimer(int(last.timestamp() * 1000) + 1000 * self.limit[key[1]] + 1)
        yield pd.DataFrame([(*key, last, False)], columns=["symbol", "timeframe", "last_ts", "stale"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([(*key, pd.Timestamp(self.last.get()[0]), True)], columns=["symbol", "timeframe", "last_ts", "stale"])

    def close(self) -> None:
        pass


def stream_stale(bars: DataFrame, intervals: int = 2, late: str = "0 seconds") -> DataFrame:
    """(symbol, timeframe, last_ts, stale) events: not stale with every newer bar, stale when its timer fires.

    What a series is, is its last event."""
    seconds = {r.k: r.s for r in bars.sparkSession.createDataFrame([(k, v) for k, v in RULES.items()], "k string, v string").select("k", F.expr("case v " + " ".join(f"when '{v}' then unix_seconds(timestamp_seconds(0) + interval {v})" for v in RULES.values()) + " end").alias("s")).collect()}
    return _keyed(bars.withWatermark("ts", late), Silence(seconds, intervals), "symbol string, timeframe string, last_ts timestamp, stale boolean", "EventTime")


def stale(bars: DataFrame, intervals: int = 2) -> DataFrame:
    """Series whose last bar is more than `intervals` bars older than the newest of all."""
    last = bars.groupBy(*SERIES).agg(F.max("ts").alias("last_ts"))
    now = last.agg(F.max("last_ts").alias("now"))
    seconds = F.create_map(*(x for k, v in RULES.items() for x in (F.lit(k), F.unix_timestamp(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {v}")))))
    age = F.unix_timestamp("now") - F.unix_timestamp("last_ts")
    keyed = last.withColumn("_k", F.lit(1)).join(F.broadcast(now.withColumn("_k", F.lit(1))), "_k")  # `now` is one row
    return keyed.select(*SERIES, "last_ts", (age > intervals * seconds[F.col("timeframe")]).alias("stale"))
