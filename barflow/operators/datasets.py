"""Derived datasets of scored, labelled rows: backtest, KPIs, distributions, trades, gauges, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.functions.blocks import scanned
from barflow.functions.ranks import quantiles
from barflow.sources.bars import SERIES, settled, with_pos

QUANTILE = 0.7
RISK = 0.02
#: Bars a year of each timeframe.
BARS_PER_YEAR = {"1m": 52 * 5 * 60 * 24 / 7, "5m": 252 * 24 * 12, "15m": 252 * 24 * 4, "1H": 252 * 24, "4H": 252 * 6, "1D": 252, "1W": 52}


def _by() -> Window:
    return Window.partitionBy(*SERIES)


def bars_per_year() -> Column:
    table = F.create_map(*(x for k, v in BARS_PER_YEAR.items() for x in (F.lit(k), F.lit(float(v)))))
    return F.coalesce(F.try_element_at(table, F.col("timeframe")), F.lit(252.0))


def thresholds(scored: DataFrame, q: float = QUANTILE) -> DataFrame:
    return quantiles(scored, "proba", [q]).select(*SERIES, F.col("q")[0].alias("threshold"))


def with_taken(scored: DataFrame, q: float = QUANTILE) -> DataFrame:
    """taken: the probability reaches the series' own quantile."""
    return scored.join(thresholds(scored, q), SERIES).withColumn("taken", (F.col("proba") >= F.col("threshold")).cast("int"))


def equity(scored: DataFrame) -> DataFrame:
    """pnl_r (2 for a win, -1 for a loss, 0 when not taken), its running sum, that in percent at RISK each, its peak so far,
    and the last bar's pnl_r."""
    pnl = F.when(F.col("taken") == 1, F.when(F.col("label") == 1, 2.0).otherwise(-1.0)).otherwise(0.0)
    df = with_taken(scored if "pos" in scored.columns else with_pos(scored)).withColumn("pnl_r", pnl)
    df = scanned(df, {"equity_r": ("sum", "pnl_r", True), "peak_r": ("peak", "pnl_r", True), "before_r": ("last", "pnl_r", False)})
    return df.withColumn("equity_pct", F.col("equity_r") * RISK)


def metrics(scored: DataFrame) -> DataFrame:
    """Trades, win rate, Sharpe, Sortino, drawdown, Calmar and the in-sample Brier score of each series."""
    df = equity(scored).withColumns({"down": F.col("equity_r") - F.col("peak_r"), "ret": F.nullif(F.col("pnl_r") - F.col("before_r"), F.lit(0.0))})
    loss = F.when(F.col("ret") < 0, F.col("ret"))
    a = df.groupBy(*SERIES).agg(
        F.sum("taken").alias("trades"),
        F.sum(F.when(F.col("taken") == 1, F.col("label"))).alias("wins"),
        F.max_by("equity_r", "ts").alias("last"),
        F.count("ret").alias("n_ret"),
        F.avg("ret").alias("mean"),
        F.stddev_samp("ret").alias("sd"),
        F.stddev_samp(loss).alias("sd_loss"),
        F.min("down").alias("dd"),
        F.avg(F.pow(F.col("proba") - F.col("label"), 2)).alias("brier"),
        F.max("threshold").alias("threshold"),
    )
    scale = F.sqrt(bars_per_year())
    ok = (F.col("n_ret") > 10) & (F.col("sd") > 0)
    ratio = lambda sd: F.coalesce(F.when(ok & (F.col(sd) > 0), F.col("mean") / F.col(sd) * scale), F.lit(0.0))
    return a.select(
        *SERIES,
        F.col("trades").cast("long").alias("total_trades"),
        F.round(F.coalesce(F.col("wins") / F.nullif(F.col("trades"), F.lit(0)), F.lit(0.0)), 4).alias("win_rate"),
        F.round("last", 2).alias("total_profit_r"),
        F.round(F.col("last") * RISK, 2).alias("total_profit_pct"),
        F.round(ratio("sd"), 3).alias("sharpe"),
        F.round(ratio("sd_loss"), 3).alias("sortino"),
        F.round(F.coalesce(F.when(F.col("dd") < 0, F.col("last") / F.abs("dd")), F.lit(0.0)), 3).alias("calmar"),
        F.round("dd", 2).alias("max_drawdown_r"),
        F.round("brier", 4).alias("brier_score"),
        F.round("threshold", 4).alias("threshold"),
    )


def last_equity(scored: DataFrame, n: int = 30) -> DataFrame:
    """Per series its last probability, the last change of equity and the last n equity values."""
    df = equity(scored).withColumn("_r", F.row_number().over(_by().orderBy(F.desc("ts"))))
    return df.where(F.col("_r") <= n).groupBy(*SERIES).agg(
        F.max_by("proba", "ts").alias("last_proba"),
        F.coalesce(F.max(F.when(F.col("_r") == 1, F.col("equity_r"))) - F.max(F.when(F.col("_r") == 2, F.col("equity_r"))), F.lit(0.0)).alias("today_r"),
        F.transform(F.array_sort(F.collect_list(F.struct("ts", "equity_r"))), lambda x: x["equity_r"]).alias("spark"),
    )


def kpis(scored: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """The ten headline numbers, one row for each: (id, value, text, change, up, sparkline).

    live (proba) overrides the value of the two that show the last probability."""
    df = metrics(scored).join(last_equity(scored), SERIES)
    shown = F.col("last_proba")
    if live is not None:
        df = df.join(live.select(*SERIES, F.round("proba", 4).alias("_live")), SERIES, "left")
        shown = F.coalesce("_live", "last_proba")
    score = F.round(shown * 100, 1)
    p, today, win = F.col("last_proba"), F.round("today_r", 2), F.col("win_rate")
    up, edge, ev, none = p >= 0.5, F.round((p - 0.5) * 100, 1), F.round(win * 2 - (1 - win), 3), F.lit(None).cast("string")
    zero = F.lit(0.0)
    cards = [
        ("total_profit", F.col("total_profit_r"), none, today, F.col("today_r") >= 0),
        ("win_rate", F.round(win * 100, 2), none, zero, F.lit(None).cast("boolean")),
        ("current_position", F.lit(None).cast("double"), F.when(up, "LONG").otherwise("SHORT"), zero, up),
        ("ai_confidence", score, none, edge, up),
        ("prediction", F.lit(None).cast("double"), F.when(up, "BULLISH").otherwise("BEARISH"), zero, up),
        ("today_profit", today, none, zero, F.col("today_r") >= 0),
        ("sharpe", F.col("sharpe"), none, zero, F.col("sharpe") > 0),
        ("max_dd", F.col("max_drawdown_r"), none, zero, F.lit(False)),
        ("expected_value", ev, none, zero, ev > 0),
        ("probability_score", score, none, edge, up),
    ]
    none_shown, week = F.array().cast("array<double>"), F.slice("spark", F.greatest(F.size("spark") - 6, F.lit(1)), 7)
    lines = {i: F.col("spark") for i in ("total_profit", "win_rate", "ai_confidence", "probability_score")} | {"today_profit": week}
    rows = F.array(*(F.struct(F.lit(i).alias("id"), v.cast("double").alias("value"), t.alias("text"), c.alias("change"), u.alias("up"), lines.get(i, none_shown).alias("sparkline")) for i, v, t, c, u in cards))
    return df.select(*SERIES, F.explode(rows).alias("k")).select(*SERIES, "k.*")


def histogram(scored: DataFrame, bins: int = 20) -> DataFrame:
    """(bin, count, cumulative_pct) over [0, 1], empty bins too; the last bin is closed."""
    b = F.greatest(F.least(F.floor(F.col("proba") * bins), F.lit(bins - 1)), F.lit(0)).cast("int")
    counts = scored.groupBy(*SERIES, b.alias("bin")).agg(F.count("*").alias("n"))
    grid = counts.select(*SERIES).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    df = grid.join(counts, [*SERIES, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return df.withColumn("cumulative_pct", F.sum("n").over(_by().orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(_by()) * 100)


def probability_stats(scored: DataFrame) -> DataFrame:
    q = [0.1, 0.25, 0.5, 0.75, 0.9]
    df = scored.groupBy(*SERIES).agg(F.max_by("proba", "ts").alias("current"), F.avg("proba").alias("mean"), F.stddev_pop("proba").alias("std"))
    df = df.join(quantiles(scored, "proba", q), SERIES)
    return df.select(*SERIES, *(F.round(F.col("q")[i], 3).alias(f"p{int(x * 100)}") for i, x in enumerate(q)), *(F.round(c, 4).alias(c) for c in ("current", "mean", "std")))


def recent_trades(scored: DataFrame, limit: int = 50) -> DataFrame:
    df = with_taken(scored).where("taken = 1").withColumn("n", F.row_number().over(_by().orderBy(F.desc("ts")))).where(F.col("n") <= limit)
    win = F.col("label") == 1
    pnl = F.when(win, 2.0).otherwise(-1.0)
    return df.select(*SERIES, F.col("n").cast("int").alias("n"), "ts", F.round("close", 2).alias("entry"), F.round(F.col("close") * (1 + pnl * F.col("atr_pct") / 100 / 2), 2).alias("exit"), pnl.alias("pnl"), F.when(win, "TP").otherwise("SL").alias("status"), "label_bars", F.round("proba", 3).alias("confidence"))


def gauges(scored: DataFrame) -> DataFrame:
    """(gauge, value, top) of the seven confidence gauges."""
    df = metrics(scored).join(last_equity(scored, 2), SERIES)
    floor = lambda c, k: F.round(F.greatest(F.col(c), F.lit(0.0)) * k, 1)
    score = F.round(F.greatest(1 - F.col("brier_score"), F.lit(0.0)) * 100, 1)
    items = [("Confidence", score, 100), ("Risk", F.round(100 - score, 1), 100), ("Probability", F.round(F.col("last_proba") * 100, 1), 100), ("Expected Profit", floor("total_profit_r", 1), 50), ("Sharpe", floor("sharpe", 25), 100), ("Sortino", floor("sortino", 25), 100), ("Calmar", floor("calmar", 40), 100)]
    return df.select(*SERIES, F.explode(F.array(*(F.struct(F.lit(g).alias("gauge"), v.alias("value"), F.lit(m).alias("top")) for g, v, m in items))).alias("g")).select(*SERIES, "g.*")


def insight_flags(scored: DataFrame, skill: DataFrame, auc: DataFrame) -> DataFrame:
    """What the insight cards say, as flags of each series' last row."""
    last = scored.groupBy(*SERIES).agg(F.max_by(F.struct("proba", "entropy_20", "atr_pct", "rsi", "smc_bias", "at_zone"), "ts").alias("r"))
    last = last.join(quantiles(scored, "proba", [0.5]).select(*SERIES, F.col("q")[0].alias("median")), SERIES)
    df = last.join(skill.select(*SERIES, "skill"), SERIES, "left").join(auc, SERIES, "left").select(*SERIES, "r.*", "median", "skill", "auc")
    p = F.col("proba")
    pick = lambda *cases: F.coalesce(*(F.when(c, v) for c, v in cases))
    return df.select(
        *SERIES,
        F.when(p >= 0.5, "LONG").otherwise("SHORT").alias("direction"),
        pick((F.col("skill") >= 0.10, "edge"), (F.col("skill") >= 0, "weak"), (F.lit(True), "none")).alias("skill_tag"),
        # the lower bound is tested first, so the higher one is never reached
        pick((F.col("auc") >= 0.55, "useful"), (F.col("auc") >= 0.60, "clear edge"), (F.lit(True), "near-random")).alias("auc_tag"),
        pick((F.col("entropy_20") > 0.8, "noise"), (F.col("entropy_20") < 0.6, "structured"), (F.lit(True), "mixed")).alias("regime"),
        (F.col("atr_pct") > 1.5).alias("elevated"),
        (F.col("rsi") > 0.7).alias("overbought"),
        pick((F.col("smc_bias") > 0, "bullish"), (F.col("smc_bias") < 0, "bearish"), (F.lit(True), "neutral")).alias("structure"),
        (F.col("at_zone") == 1).alias("at_zone"),
        (p > F.col("median")).alias("above_median"),
        F.round(F.greatest((p * 2 - (1 - p)) / 2, F.lit(0.0)) * 100, 3).alias("kelly_pct"),
    )


def extremes(scored: DataFrame) -> DataFrame:
    """Lowest and highest equity (the first bar of each) and the last value with a band of two R."""
    e = equity(scored).withColumnRenamed("pos", "i")
    at = lambda sign: F.min_by(F.struct("i", "equity_r"), F.struct((sign * F.col("equity_r")).alias("v"), F.col("i").alias("j")))
    df = e.groupBy(*SERIES).agg(at(1).alias("lo"), at(-1).alias("hi"), F.max_by("equity_r", "i").alias("last"))
    return df.select(*SERIES, F.col("lo.i").alias("min_pos"), F.col("lo.equity_r").alias("min_r"), F.col("hi.i").alias("max_pos"), F.col("hi.equity_r").alias("max_r"), "last", (F.col("last") - 2).alias("band_low"), (F.col("last") + 2).alias("band_high"))


#: Fixed value: the active model's name on its card.
ACTIVE = "LogReg-L1"


def model_cards(model: DataFrame, auc: DataFrame, benchmarks: DataFrame, scored: DataFrame) -> DataFrame:
    """A card for each series' trained model and benchmarks: scores, accuracy, training time, confidence, last equity values.

    scored has the trained model's probabilities of all labelled rows, auc its area out of sample.  The model's accuracy is
    its trades' win rate; benchmarks have none and show the last 20 of the model's 30 equity values."""
    trained = metrics(scored).join(model.select(*SERIES, "train_s"), SERIES).join(auc, SERIES, "left")
    active = trained.select(*SERIES, F.lit(ACTIVE).alias("model"), F.col("brier_score").alias("brier"), F.coalesce("auc", F.lit(0.5)).alias("auc"), F.round("win_rate", 3).alias("accuracy"), "train_s", F.lit(True).alias("active"))
    others = benchmarks.select(*SERIES, "model", F.round("brier", 4).alias("brier"), F.round("auc", 4).alias("auc"), F.lit(0.0).alias("accuracy"), "train_s", F.lit(False).alias("active"))
    every = settled(active.unionByName(others), "cards")
    shown = F.when(F.col("active"), F.col("spark")).otherwise(F.slice("spark", F.greatest(F.size("spark") - 19, F.lit(1)), 20))
    return every.join(last_equity(scored).select(*SERIES, "spark"), SERIES).withColumns({"spark": shown, "confidence": F.round(F.greatest(1 - F.col("brier"), F.lit(0.0)), 4)})
