"""The live reading, news overlay and market overview."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barflow.operators.evaluation import heuristic
from barflow.operators.features import TECHNICAL, last_row
from barflow.functions.blocks import in_blocks, previous
from barflow.operators.indicators import simple_rsi
from barflow.operators.swings import nearest_zone, structure_bias, with_swings, zones_of
from barflow.operators.training import score
from barflow.sources.bars import SERIES, tail, with_pos

AT_ZONE = 0.003
FALLBACK = 0.08
BREAK_EVEN = 1.0 / 3.0
CAP = 0.02


def intervals(predicted: DataFrame, conformal: DataFrame) -> DataFrame:
    """lo, hi and ev_positive of predictions (proba, is_probability); a heuristic has no interval."""
    df = predicted.join(conformal.select(*SERIES, "q_hat"), SERIES, "left")
    q = F.when(F.col("is_probability"), F.coalesce("q_hat", F.lit(FALLBACK))).otherwise(0.0)
    p = F.col("proba")
    df = df.withColumns({"lo": F.when(F.col("is_probability"), F.greatest(p - q, F.lit(0.0))).otherwise(p), "hi": F.when(F.col("is_probability"), F.least(p + q, F.lit(1.0))).otherwise(p)})
    return df.withColumn("ev_positive", F.col("lo") > BREAK_EVEN).drop("q_hat")


def sizing(predicted: DataFrame) -> DataFrame:
    """Kelly sizing for 2:1, halved and capped, in percent, and the expected return in R."""
    p = F.col("proba")
    full = F.greatest((p * 2.0 - (1 - p)) / 2.0, F.lit(0.0))
    return predicted.withColumns({"full_kelly_pct": F.round(full * 100, 3), "half_kelly_pct": F.round(full * 50, 3), "final_pct": F.round(F.least(full * 0.5, F.lit(CAP)) * 100, 3), "expected_r": F.round(p * 2 - (1 - p), 3)})


def tier_b(bars: DataFrame, n: int = 100) -> DataFrame:
    """Structure bias and nearest zone of the last n bars; at_zone is within 0.3 % of the price."""
    last = with_pos(tail(bars, n))
    by = with_swings(last).groupBy(*SERIES).agg(F.max_by("close", "ts").alias("price"), F.collect_list("swing_high").alias("h"), F.collect_list("swing_low").alias("l"))
    df = by.withColumn("z", nearest_zone(zones_of(F.col("h"), F.col("l")), F.col("price")))
    far = F.col("z.distance") / F.col("price")
    df = df.select(*SERIES, "price", F.col("z.kind").alias("zone_kind"), F.round("z.price", 2).alias("zone_price"), F.round(far * 100, 3).alias("distance_pct"), F.coalesce(far < AT_ZONE, F.lit(False)).alias("at_zone"))
    name = F.when(F.col("bias") > 0, "bullish").when(F.col("bias") < 0, "bearish").otherwise("neutral")
    return df.join(structure_bias(last).select(*SERIES, name.alias("bias")), SERIES)


def predictions(bars: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """The probability of each series' last bar: the trained model's (operators.training) where it has one, else the heuristic's."""
    last = last_row(bars)
    if model is None:
        return last.withColumn("proba", heuristic()).withColumn("is_probability", F.lit(False))
    known = score(last, model, how="left").withColumn("is_probability", F.col("proba").isNotNull())
    return known.withColumn("proba", F.coalesce("proba", heuristic()))


def readings(bars: DataFrame, conformal: DataFrame, news: DataFrame, timeframes: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """One row for each series: prediction, interval, structure, news, sizing and the feature map."""
    p = sizing(intervals(predictions(bars, model), conformal))
    h = F.broadcast(timeframes.select(F.col("id").alias("timeframe"), F.col("horizon").alias("horizon_bars")))
    df = p.join(tier_b(bars).withColumnRenamed("at_zone", "b_at_zone"), SERIES).join(h, "timeframe").join(news, "symbol", "left")
    return df.select(
        *SERIES,
        F.col("ts").alias("asof"),
        F.round("price", 2).alias("price"),
        "horizon_bars",
        F.struct(F.round("proba", 4).alias("probability"), F.round("lo", 4).alias("probability_lo"), F.round("hi", 4).alias("probability_hi"), "ev_positive", "is_probability", F.when(F.col("proba") >= 0.5, "LONG").otherwise("SHORT").alias("direction")).alias("tier_a"),
        F.struct("bias", "zone_kind", "zone_price", "distance_pct", F.col("b_at_zone").alias("at_zone")).alias("tier_b"),
        F.struct(F.coalesce("news_score", F.lit(0.0)).alias("score"), F.coalesce("news_count", F.lit(0)).alias("count"), F.coalesce("tag", F.lit("neutral")).alias("tag")).alias("news"),
        F.struct("full_kelly_pct", "half_kelly_pct", "final_pct").alias("sizing"),
        F.map_from_arrays(F.array(*map(F.lit, TECHNICAL)), F.array(*(F.col(c).cast("double") for c in TECHNICAL))).alias("features"),
    )


def recent_headlines(headlines: DataFrame, hours: int = 72, most: int = 20, keyword: str | None = None) -> DataFrame:
    """Per symbol the newest headlines with a title, at most `hours` older than the newest of all."""
    df = headlines.where(F.length(F.trim("title")) > 0)
    df = df.where(F.lower("title").contains(keyword.lower())) if keyword else df
    now = df.agg(F.max("published_at").alias("now"))
    df = df.join(F.broadcast(now), F.col("published_at") >= F.col("now") - F.expr(f"interval {hours} hours")).drop("now")
    w = Window.partitionBy("symbol").orderBy(F.desc("published_at"), "doc_id")
    return df.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)


#: A term of a news query: a quoted phrase, or a word that is not OR.
_TERM = re.compile(r'"([^"]+)"|(\S+)')


def query_terms(news_query: str | None) -> list[str]:
    """The lower-case terms of a query that joins words and quoted phrases by OR."""
    found = (phrase or word for phrase, word in _TERM.findall(news_query or ""))
    return list(dict.fromkeys(t.lower() for t in found if t != "OR"))


def matched_headlines(headlines: DataFrame, catalog: DataFrame) -> DataFrame:
    """headlines once for each symbol of the catalog (id, news_query) whose query has a term in the title, as symbol.

    Terms are whole words or phrases in any case.  One automaton of all symbols' terms reads each title once; the
    catalog is a table of few rows, read by the driver.  A null title matches nothing."""
    import ahocorasick

    owners: dict[str, list[str]] = {}
    for symbol, query in catalog.select("id", "news_query").collect():
        for term in query_terms(query):
            owners.setdefault(term, []).append(symbol)
    terms = headlines.sparkSession.sparkContext.broadcast(owners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for term in terms.value:
            automaton.add_word(term, term)
        automaton.make_automaton()
        for b in batches:
            row, symbol = [], []
            for i, title in enumerate(b.column("title").to_pylist()):
                text, own = (title or "").lower(), set()
                for end, term in automaton.iter(text) if len(automaton) else ():
                    start = end - len(term) + 1
                    if not text[start - 1 : start].isalnum() and not text[end + 1 : end + 2].isalnum():
                        own.update(terms.value[term])
                row += [i] * len(own)
                symbol += sorted(own)
            out = b.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(symbol, pa.string()) if n == "symbol" else out.column(n) for n in b.schema.names], b.schema.names)

    rows = headlines.withColumn("symbol", F.lit(None).cast("string"))
    return rows.mapInArrow(run, rows.schema)


def parsed_score(text):
    """The first number in a text, held to [-1, 1]; 0 without one."""
    found = F.regexp_extract(text, r"-?\d+(?:\.\d+)?", 0)
    return F.coalesce(F.greatest(F.least(found.try_cast("double"), F.lit(1.0)), F.lit(-1.0)), F.lit(0.0))


def news_overlay(headlines: DataFrame) -> DataFrame:
    """(symbol, news_score, news_count, tag) of recent headlines."""
    df = headlines.groupBy("symbol").agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("s"), F.count("*").alias("news_count"))
    tag = F.when(F.col("s") > 0.15, "bullish").when(F.col("s") < -0.15, "bearish").otherwise("neutral")
    return df.select("symbol", F.round("s", 4).alias("news_score"), "news_count", tag.alias("tag"))


def market(bars: DataFrame) -> DataFrame:
    """Per series its last price and volume, change and closes over 30 bars, and a signal from a plain RSI."""
    df = in_blocks(bars, 15, 0, lambda df: df.withColumn("_change", F.col("close") - previous("close")).withColumn("rsi", simple_rsi()))
    df = tail(df, 30).groupBy(*SERIES).agg(F.array_sort(F.collect_list(F.struct("ts", "close"))).alias("c"), F.max_by("volume", "ts").alias("volume"), F.max_by("rsi", "ts").alias("rsi"))
    first, last = F.get("c", F.lit(0))["close"], F.element_at("c", -1)["close"]
    return df.select(*SERIES, F.round(last, 2).alias("price"), F.round((last - first) / first * 100, 2).alias("change"), F.transform("c", lambda x: F.round(x["close"], 2)).alias("spark"), F.col("volume").cast("long").alias("volume"), F.when(F.col("rsi") > 55, "bullish").when(F.col("rsi") < 45, "bearish").otherwise("neutral").alias("signal"))
