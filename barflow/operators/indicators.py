"""Technical indicators of bars with a position (see sources.bars.with_pos).

Columns that look back over rows are expressions on haloed frames (functions.blocks); what starts with with_ takes
bars with or without a halo."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.functions.blocks import in_blocks, previous, ranged, rows, scanned
from barflow.functions.ema import reach, span, wilder, with_ema
from barflow.sources.bars import SERIES


def true_range() -> Column:
    """Largest of high-low and the distances from the last close; the first bar has high-low."""
    last = previous("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - last), F.abs(F.col("low") - last))


def with_rsi(bars: DataFrame, n: int = 14, out: str = "rsi") -> DataFrame:
    """Wilder RSI: averages start at the first difference; 100 where there is no loss, or no difference."""
    return in_blocks(bars, reach(wilder(n)) + 1, 0, lambda df: _rsi(df, n, out))


def _rsi(bars: DataFrame, n: int, out: str) -> DataFrame:
    change = F.col("close") - previous("close")
    df = bars.withColumns({"_up": F.greatest(change, F.lit(0.0)), "_down": F.greatest(-change, F.lit(0.0)), "_p": F.col("pos") - 1})
    df = df.withColumns({c: F.when(F.col("_p") >= 0, F.col(c)).otherwise(F.lit(0.0)) for c in ("_up", "_down")})
    df = with_ema(df, {"_gain": (F.col("_up"), wilder(n)), "_loss": (F.col("_down"), wilder(n))}, "_p")
    ratio = F.col("_gain") / F.nullif(F.col("_loss"), F.lit(0.0))
    return df.withColumn(out, F.coalesce(100 - 100 / (1 + ratio), F.lit(100.0))).drop("_up", "_down", "_p", "_gain", "_loss")


def with_atr(bars: DataFrame, n: int = 14, out: str = "atr") -> DataFrame:
    atr = lambda df: with_ema(df.withColumn("_tr", true_range()), {out: (F.col("_tr"), wilder(n))}).drop("_tr")
    return in_blocks(bars, reach(wilder(n)) + 1, 0, atr)


def with_true_range(bars: DataFrame, out: str = "tr", long: str | None = None, n: int = 200) -> DataFrame:
    """The true range, and its mean over n bars in column long."""

    def ranges(df: DataFrame) -> DataFrame:
        df = df.withColumn(out, true_range())
        return df.withColumn(long, sma_atr(n, out)) if long else df

    return in_blocks(bars, n if long else 1, 0, ranges)


def sma_atr(n: int = 200, tr: str = "tr") -> Column:
    return F.avg(tr).over(rows(-(n - 1), 0))


def with_averages(bars: DataFrame, spans: dict[str, int]) -> DataFrame:
    return in_blocks(bars, max(reach(span(n)) for n in spans.values()), 0, lambda df: with_ema(df, {k: (F.col("close"), span(n)) for k, n in spans.items()}))


def with_macd(bars: DataFrame) -> DataFrame:
    """macd is EMA12 less EMA26 of the close, macd_signal its EMA9."""

    def signal(df: DataFrame) -> DataFrame:
        df = with_averages(df, {"_fast": 12, "_slow": 26}).withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
        return with_ema(df, {"macd_signal": (F.col("macd"), span(9))})

    return in_blocks(bars, reach(span(26), span(9)), 0, signal)


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    return in_blocks(bars, n - 1, 0, lambda df: _bollinger(df, n, k))


def _bollinger(bars: DataFrame, n: int, k: float) -> DataFrame:
    w = rows(-(n - 1), 0)
    full = F.count("close").over(w) == n
    df = bars.withColumns({"bb_mid": F.when(full, F.avg("close").over(w)), "_sd": F.when(full, F.stddev_pop("close").over(w))})
    df = df.withColumns({"bb_upper": F.col("bb_mid") + k * F.col("_sd"), "bb_lower": F.col("bb_mid") - k * F.col("_sd")})
    return df.withColumn("bb_pct", (F.col("close") - F.col("bb_lower")) / F.nullif(F.col("bb_upper") - F.col("bb_lower"), F.lit(0.0))).drop("_sd")


def trend_bias(bars: DataFrame) -> DataFrame:
    """(symbol, timeframe, bias, code) on each series' last bar; neutral below 50 bars."""
    df = with_averages(bars, {"_a": 20, "_b": 50})
    last = df.groupBy(*SERIES).agg(F.count("*").alias("n"), F.max_by(F.struct("_a", "_b"), "ts").alias("v"))
    bias = F.when(F.col("n") < 50, "neutral").when(F.col("v._a") > F.col("v._b"), "bullish").when(F.col("v._a") < F.col("v._b"), "bearish").otherwise("neutral")
    return last.select(*SERIES, bias.alias("bias")).withColumn("code", bias_code(F.col("bias")))


def bias_code(bias: Column) -> Column:
    return F.when(bias == "bullish", 1).when(bias == "bearish", -1).otherwise(0)


def confluence(biases: DataFrame) -> DataFrame:
    """Votes of a symbol's timeframes: a bias needs more votes than each other one; confluence means all agree."""
    votes = {k: F.count_if(F.col("bias") == k).alias(k) for k in ("bullish", "bearish", "neutral")}
    v = biases.groupBy("symbol").agg(*votes.values(), F.count("*").alias("n"))
    b, s, n = F.col("bullish"), F.col("bearish"), F.col("neutral")
    bias = F.when((b > s) & (b > n), "bullish").when((s > b) & (s > n), "bearish").otherwise("neutral")
    return v.select("symbol", *votes, bias.alias("bias"), (F.greatest(b, s, n) == F.col("n")).alias("confluence"))


def log_return(n: int) -> Column:
    return F.ln("close") - F.ln(previous("close", n))


def with_returns(bars: DataFrame, lags: dict[str, int]) -> DataFrame:
    return in_blocks(bars, max(lags.values()), 0, lambda df: df.withColumns({c: log_return(n) for c, n in lags.items()}))


def with_entropy(bars: DataFrame, n: int = 20, bins: int = 10, out: str = "entropy_20", causal: bool = False) -> DataFrame:
    """Shannon entropy of the n log-returns before a bar, over equal bins of the series' range, from 0 to 1.

    The bins span the whole series' returns, as the published definition has it; causal takes only
    returns before the bar."""
    if causal:
        bars = in_blocks(bars, 1, 0, lambda df: df.withColumn("_r", log_return(1)))
        bars = scanned(bars, {"_lo": ("min", "_r", False), "_hi": ("max", "_r", False)})
    return in_blocks(bars, n + 1, 0, lambda df: _entropy(df, n, bins, out, causal))


def _entropy(df: DataFrame, n: int, bins: int, out: str, causal: bool) -> DataFrame:
    if not causal:
        df = ranged(df.withColumn("_r", log_return(1)), "_r", "_lo", "_hi")
    before = rows(-n, -1)
    width = (F.col("_hi") - F.col("_lo")) / bins
    if causal:
        values = F.filter(F.collect_list("_r").over(before), lambda x: x.isNotNull())
        df = df.withColumn("_v", values)
        bucket = lambda x: F.least(F.floor((x - F.col("_lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))
        counts = [F.size(F.filter("_v", lambda x, k=k: bucket(x) == k)) for k in range(bins)]
    else:
        edge = lambda k: F.col("_lo") + width * k
        inside = [(F.col("_r") >= edge(k)) & (F.col("_r") <= F.col("_hi") if k == bins - 1 else F.col("_r") < edge(k + 1)) for k in range(bins)]
        df = df.withColumn("_b", F.coalesce(*(F.when(c, k) for k, c in enumerate(inside))))
        counts = [F.coalesce(F.sum((F.col("_b") == k).cast("int")).over(before), F.lit(0)) for k in range(bins)]
    df = df.withColumn("_c", F.array(*counts)).withColumn("_n", F.count("_r").over(before))
    share = lambda x: x / F.lit(float(n))
    total = F.aggregate("_c", F.lit(0.0), lambda a, x: a - F.when(x > 0, share(x) * F.log2(share(x))).otherwise(F.lit(0.0)))
    ok = (F.col("_n") == n) & (F.col("_hi") > F.col("_lo"))
    return df.withColumn(out, F.when(ok, total / math.log2(bins))).drop("_r", "_lo", "_hi", "_b", "_c", "_n", "_v")


def simple_rsi(closes: int = 15) -> Column:
    """RSI of plain means over the last closes; 50 with fewer, 100 without a loss (column close, aggregated per bar)."""
    w = rows(-(closes - 2), 0)
    change = F.col("_change")
    gain, loss = F.avg(F.greatest(change, F.lit(0.0))).over(w), F.avg(F.greatest(-change, F.lit(0.0))).over(w)
    return F.when(F.col("pos") < closes - 1, 50.0).when(loss == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(gain, loss)))
