"""The feature matrix, macro series on bars, cross-timeframe features, and triple-barrier labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.functions.blocks import W, in_blocks, rows, scanned
from barflow.functions.ema import reach, span, wilder, with_ema
from barflow.operators.indicators import log_return, true_range, with_averages, with_entropy, with_rsi
from barflow.operators.swings import with_rolling_structure, with_zone_distance
from barflow.sources.bars import SERIES, SIZE, dedupe_last, fill, tail, with_pos

TECHNICAL = ["rsi", "macd_pct", "ema_cross", "atr_pct", "ret_1", "ret_5", "entropy_20", "smc_bias", "zone_dist_atr", "at_zone"]
MACRO = ["dxy_return_1d", "vix_level", "tnx_level"]
LEAST_BARS = 60
TAKE, STOP = 2.0, 1.0


def clean_macro(macro: DataFrame) -> DataFrame:
    """Days with dxy; vix and tnx filled (the whole table is one short daily series)."""
    return fill(macro.where("dxy is not null"), ["vix", "tnx"], [], "day")


def attach_macro(bars: DataFrame, macro: DataFrame) -> DataFrame:
    """Macro features by the bar's day; gaps are filled over bars, so days without a bar are lost."""
    daily = macro.groupBy("day").agg(*(F.last(c, True).alias(c) for c in ("dxy", "vix", "tnx")))
    df = bars.withColumn("day", F.col("ts").cast("date")).join(daily, "day", "left").drop("day")
    posed = df if "pos" in df.columns else with_pos(df)
    both = scanned(posed, {f"_{c}": ("last", c, True) for c in ("dxy", "vix", "tnx")}, {f"_n{c}": ("last", c, True) for c in ("dxy", "vix", "tnx")})
    filled = both.withColumns({c: F.coalesce(f"_{c}", f"_n{c}") for c in ("dxy", "vix", "tnx")})
    out = _macro_features(filled.drop(*(f"_{k}{c}" for k in ("", "n") for c in ("dxy", "vix", "tnx"))))
    return out if "pos" in bars.columns else out.drop("pos")


def _macro_features(posed: DataFrame) -> DataFrame:
    return in_blocks(posed, 1, 0, _macro_of)


def _macro_of(df: DataFrame) -> DataFrame:
    return df.withColumns({"dxy_return_1d": F.ln(F.col("dxy") / F.lag("dxy").over(W())), "vix_level": F.least(F.col("vix") / 50, F.lit(1.0)), "tnx_level": F.col("tnx") / 10}).drop("dxy", "vix", "tnx")


def attach_macro_asof(bars: DataFrame, macro: DataFrame) -> DataFrame:
    """The same from the last macro day up to the bar's day, also one without a bar.

    The values are carried on once over the calendar (the days of both, a few thousand a decade); bars
    then meet them by day."""
    bars = bars.withColumn("day", F.col("ts").cast("date"))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    days = macro.select("day", "dxy", "vix", "tnx").unionByName(bars.select("day").distinct(), allowMissingColumns=True).groupBy("day").agg(*(F.max(c).alias(c) for c in ("dxy", "vix", "tnx")))
    carried = days.select("day", *(F.last(c, True).over(w).alias(c) for c in ("dxy", "vix", "tnx")))
    return _macro_features(with_pos(bars.join(carried, "day").drop("day"))).drop("pos")


def matrix(bars: DataFrame, macro: DataFrame | None = None, drop: bool = True, seq: str | None = None) -> DataFrame:
    """Features of each bar.  drop leaves out bars with a null (the warm-up), and gives no rows below 60 bars.

    Of bars with one timestamp the last by column seq counts, where it is given."""
    bars = dedupe_last(bars, seq) if seq else bars
    df = with_pos(bars, "_n").where(F.col("_n") >= LEAST_BARS).drop("_n")
    df = attach_macro(df, macro) if macro is not None else df
    df = in_blocks(df, max(reach(span(50)), reach(wilder(14)) + 1), 0, _features)
    df = df.select(*SERIES, "ts", *TECHNICAL, *(MACRO if macro is not None else []), "high", "low", "close")
    return df.dropna() if drop else df


def _features(df: DataFrame) -> DataFrame:
    """TECHNICAL of a haloed frame: all windows over one shuffle."""
    df = with_rsi(df).withColumn("_tr", true_range())
    df = with_ema(df, {"_e12": (F.col("close"), span(12)), "_e26": (F.col("close"), span(26)), "_e20": (F.col("close"), span(20)), "_e50": (F.col("close"), span(50)), "atr": (F.col("_tr"), wilder(14))})
    df = with_zone_distance(with_rolling_structure(with_entropy(df)))
    return df.withColumns(
        {
            "rsi": F.col("rsi") / 100,
            "macd_pct": (F.col("_e12") - F.col("_e26")) / F.col("close") * 100,
            "ema_cross": F.signum(F.col("_e20") - F.col("_e50")),
            "atr_pct": F.col("atr") / F.col("close") * 100,
            "ret_1": log_return(1),
            "ret_5": log_return(5),
        }
    )


def last_row(bars: DataFrame, macro: DataFrame | None = None, window: int = 200, exact: bool = False) -> DataFrame:
    """Features of the last bar, from the last `window` bars alone (exact: from all bars)."""
    rows_ = matrix(bars if exact else tail(bars, window), macro)
    return tail(rows_, 1)


def cross_timeframe(daily: DataFrame, finer: dict[str, DataFrame]) -> DataFrame:
    """Daily bars with the last RSI and EMA cross of each finer series' day."""
    out = daily.withColumn("day", F.col("ts").cast("date"))
    for name, bars in finer.items():
        df = in_blocks(with_pos(bars), reach(span(50)), 0, lambda df: with_averages(with_rsi(df), {"_a": 20, "_b": 50}))
        last = df.groupBy("symbol", F.col("ts").cast("date").alias("day")).agg(F.max_by("rsi", "ts").alias(f"rsi_{name}"), F.max_by(F.signum(F.col("_a") - F.col("_b")), "ts").alias(f"ema_cross_{name}"))
        out = out.join(last, ["symbol", "day"], "left")
    return out.drop("day")


def triple_barrier(rows_: DataFrame, horizon: Column | int = 10, most: int = 10, places: bool = False) -> DataFrame:
    """label and label_bars of matrix rows: which barrier the next rows touch first; both at once is a stop.

    Rows count after nulls are gone.  The last `horizon` rows of a series have no label.  places keeps the
    position of the labelled rows (pos) and their number (SIZE)."""
    h = F.lit(horizon) if isinstance(horizon, int) else horizon
    absolute = F.col("atr_pct") / 100 * F.col("close")
    df = with_pos(rows_, "_n").withColumns({"_up": F.col("close") + TAKE * absolute, "_down": F.col("close") - STOP * absolute, "_h": h})
    df = in_blocks(df, 0, most, lambda df: df.withColumn("_next", F.collect_list(F.struct("high", "low")).over(rows(1, most))))
    touches = F.transform(F.slice("_next", F.lit(1), F.col("_h")), lambda x, i: F.struct((i + 1).alias("bars"), F.when(x["low"] <= F.col("_down"), 0).when(x["high"] >= F.col("_up"), 1).alias("label")))
    first = F.get(F.filter(touches, lambda t: t["label"].isNotNull()), F.lit(0))
    df = df.where(F.col("pos") < F.col("_n") - F.col("_h"))
    return df.withColumns({"label": F.coalesce(first["label"], F.lit(0)), "label_bars": F.coalesce(first["bars"], F.col("_h")), SIZE: F.col("_n") - F.col("_h")}).drop("_up", "_down", "_h", "_n", "_next", *([] if places else ["pos", SIZE]))


def label_balance(labeled: DataFrame) -> DataFrame:
    return labeled.groupBy(*SERIES).agg(F.count("*").alias("n"), F.avg("label").alias("positive_rate"), F.avg("label_bars").alias("mean_bars"))
