"""Sources and sinks: ticks, bars, macro series, catalogs, headlines and the trade log."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SERIES = ["symbol", "timeframe"]
SIZE = "_size"  # column of a series' number of rows, where positions leave it
SPAN = 4096  # bars of a timeframe that are numbered together
BAR_SCHEMA = "symbol string, timeframe string, ts timestamp, open double, high double, low double, close double, volume double"
CSV_SCHEMA = "ts timestamp, open double, high double, low double, close double, volume double"
#: The Spark interval of each timeframe.
RULES = {"1m": "1 minute", "5m": "5 minutes", "15m": "15 minutes", "1H": "1 hour", "4H": "4 hours", "1D": "1 day", "1W": "1 week"}
#: Rows a pair must have before it is trained, and bars a barrier looks ahead.
TIMEFRAMES = [("1m", 300, 10), ("5m", 1000, 10), ("15m", 1000, 10), ("1H", 1500, 10), ("4H", 800, 10), ("1D", 400, 10), ("1W", 200, 5)]
#: The default symbol and timeframe for unknown ones.
DEFAULT_SYMBOL, DEFAULT_TIMEFRAME = "XAUUSD", "1D"
#: The catalog's symbols with their names, sources in order, macro series and their sources, and news queries.
SYMBOLS = [
    ("XAUUSD", "Gold", ["GC=F", "XAUUSD=X"], True, {"dxy": ["DX-Y.NYB", "UUP"], "vix": ["^VIX"], "tnx": ["^TNX"]}, 'gold OR XAUUSD OR "gold price"'),
    ("BTCUSD", "Bitcoin", ["BTC-USD"], False, None, "bitcoin OR BTC"),
    ("ETHUSD", "Ethereum", ["ETH-USD"], False, None, "ethereum OR ETH"),
    ("NAS100", "Nasdaq 100", ["^NDX", "^IXIC"], False, None, "nasdaq"),
    ("SPX500", "S&P 500", ["^GSPC"], False, None, '"S&P 500" OR SPX'),
]


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that the session names; a temporary one only where it names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: what follows neither recomputes nor replans it."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null in every double column, once, where data come in."""
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.lower() for c in df.columns))


def read_series(spark: SparkSession, path: str, symbol: str | None = None, timeframe: str | None = None, form: str = "parquet") -> DataFrame:
    """A table that is partitioned by symbol and timeframe (bars, features, labels): other pairs' folders are not read."""
    rows = spark.read.format(form).load(path)
    for c, v in (("symbol", symbol), ("timeframe", timeframe)):
        rows = rows.where(F.col(c) == v) if v else rows
    return rows


def read_bars(spark: SparkSession, path: str, symbol: str | None = None, timeframe: str | None = None, form: str = "parquet") -> DataFrame:
    """Bars from a table partitioned by symbol and timeframe, or from one pair's CSV; rows with a null go."""
    if form == "csv":
        rows = spark.read.schema(CSV_SCHEMA).option("header", True).csv(path).withColumns({"symbol": F.lit(symbol), "timeframe": F.lit(timeframe)})
    else:
        rows = read_series(spark, path, symbol, timeframe, form)
    columns = [f.name for f in T._parse_datatype_string(BAR_SCHEMA).fields]
    return without_nan(rows.select(*columns)).dropna()


def write_series(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Overwrites only the pairs that df has."""
    df.write.format(form).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*SERIES).save(path)


def write_report(df: DataFrame, path: str, by: str, form: str = "csv") -> None:
    df.orderBy(F.desc(by)).write.mode("overwrite").option("header", True).format(form).save(path)


def append_metadata(rows: DataFrame, path: str, form: str = "json") -> None:
    """Appends a run's metrics, benchmarks or index rows, stamped with the run's time."""
    rows.withColumn("generated_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).write.mode("append").format(form).save(path)


def latest_metadata(spark: SparkSession, path: str, form: str = "json", by: str = "generated_at") -> DataFrame:
    """Of what append_metadata wrote the last row, by the column, of each pair (and model)."""
    rows = spark.read.format(form).load(path)
    keys = [c for c in (*SERIES, "model") if c in rows.columns]
    w = Window.partitionBy(*keys).orderBy(F.desc(by))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def append_log(readings: DataFrame, path: str) -> DataFrame:
    """Appends the readings whose probability is in [0, 1]; gives back the others."""
    ok = F.col("tier_a_prob").between(0, 1)
    readings.where(ok).write.mode("append").parquet(path)
    return readings.where(~F.coalesce(ok, F.lit(False)))


def _ticks(df: DataFrame, symbol: Column, ts: Column, price: Column, volume: Column, order: Column) -> DataFrame:
    return df.select(symbol.alias("symbol"), ts.cast("timestamp").alias("ts"), price.cast("double").alias("price"), volume.cast("double").alias("volume"), order.alias("seq"))


def ticks_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value > 0")
    return _ticks(e, F.col("event_type"), F.col("ts"), F.col("value"), F.get_json_object("props", "$.k"), F.struct("ts", "event_id"))


def ticks_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ticks(table(spark, sf_dir, "orders"), F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_totalprice"), F.lit(1.0), F.struct("o_orderkey"))


def ticks_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    return _ticks(l, F.col("l_returnflag"), F.col("l_shipdate"), F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))


def bars_from_ticks(ticks: DataFrame, timeframe: str = "1H") -> DataFrame:
    """One bar for each series and bucket that has ticks; partial aggregates combine before the shuffle."""
    bucket = F.window("ts", RULES[timeframe]).start
    g = ticks.groupBy("symbol", bucket.alias("bucket"))
    out = g.agg(F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.sum("volume").alias("volume"))
    return out.select("symbol", F.lit(timeframe).alias("timeframe"), F.col("bucket").alias("ts"), "open", "high", "low", "close", "volume")


def resample(bars: DataFrame, timeframe: str, start: str | None = None) -> DataFrame:
    """Coarser bars; start shifts the buckets (buckets align to midnight UTC otherwise)."""
    bucket = F.window("ts", RULES[timeframe], RULES[timeframe], start).start if start else F.window("ts", RULES[timeframe]).start
    g = bars.groupBy("symbol", bucket.alias("bucket"))
    out = g.agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
    return out.select("symbol", F.lit(timeframe).alias("timeframe"), F.col("bucket").alias("ts"), "open", "high", "low", "close", "volume")


def dedupe_last(rows: DataFrame, seq: str) -> DataFrame:
    """Of rows with one timestamp in a series the last that came in."""
    w = Window.partitionBy(*SERIES, "ts").orderBy(F.desc(seq))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def tail(rows: DataFrame, n: int) -> DataFrame:
    """The last n rows of each series."""
    w = Window.partitionBy(*SERIES).orderBy(F.desc("ts"))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def with_pos(rows: DataFrame, size: str | None = None) -> DataFrame:
    """rows with pos, their place in the series from 0, and with the series' number of rows in column size.

    Rows are numbered inside spans of time that hold SPAN bars of the timeframe; a span starts where the counts of
    those before it end.  So a long series is numbered by many tasks, and a window over series sees a row a span."""
    rows = settled(rows, "rows")  # read twice: counted and numbered
    seconds = F.create_map(*(x for k, v in RULES.items() for x in (F.lit(k), F.unix_seconds(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {v}")))))
    width = F.coalesce(F.try_element_at(seconds, F.col("timeframe")), F.lit(86400)) * SPAN
    cut = rows.withColumn("_span", F.floor(F.unix_seconds("ts") / width))
    numbered = cut.withColumn("_i", F.row_number().over(Window.partitionBy(*SERIES, "_span").orderBy("ts")))
    whole = Window.partitionBy(*SERIES)
    counts = cut.groupBy(*SERIES, "_span").agg(F.count("*").alias("_c"))
    starts = F.coalesce(F.sum("_c").over(whole.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = numbered.join(counts.select(*SERIES, "_span", starts.alias("_start"), *([F.sum("_c").over(whole).alias(size)] if size else [])), [*SERIES, "_span"])
    return placed.withColumn("pos", F.col("_start") + F.col("_i") - 1).drop("_span", "_i", "_start")


def macro_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    day = F.col("l_shipdate").cast("date").alias("day")
    return l.groupBy(day).agg(F.avg("l_extendedprice").alias("dxy"), F.avg("l_quantity").alias("vix"), (100 * F.avg("l_tax")).alias("tnx"))


def join_macro(dxy: DataFrame, vix: DataFrame, tnx: DataFrame) -> DataFrame:
    """Three daily series (day, value) as one table: the days of dxy; gaps of the others are filled.

    Days are unique in each series; the one ordered pass is over days, a few thousand a decade."""
    named = [s.groupBy("day").agg(F.last("value", True).alias(c)) for s, c in ((dxy, "dxy"), (vix, "vix"), (tnx, "tnx"))]
    rows = named[0].join(named[1], "day", "left").join(named[2], "day", "left").where("dxy is not null")
    return fill(rows, ["vix", "tnx"], [], "day")


def read_macro(spark: SparkSession, path: str) -> DataFrame:
    """The daily macro table; empty where there is none."""
    from pyspark.errors import AnalysisException

    schema = "day date, dxy double, vix double, tnx double"
    try:
        return without_nan(spark.read.schema(schema).parquet(path))
    except AnalysisException:
        return spark.createDataFrame([], schema)


def fill(df: DataFrame, columns: list[str], keys: list[str], order: str) -> DataFrame:
    """The last value before a gap, or the first after it where there is none before."""
    w = Window.partitionBy(*keys).orderBy(order)
    past, future = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({c: F.coalesce(F.last(c, True).over(past), F.first(c, True).over(future)) for c in columns})


def first_source(rows: DataFrame, rank: str = "rank") -> DataFrame:
    """Of several sources of a symbol the rows of the first, in rank order, that has any."""
    return rows.withColumn("_r", F.min(rank).over(Window.partitionBy("symbol"))).where(F.col(rank) == F.col("_r")).drop("_r")


def symbols(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SYMBOLS, "id string, name string, tickers array<string>, has_macro boolean, macro map<string, array<string>>, news_query string")


def sources(symbol_ids: DataFrame) -> DataFrame:
    """(symbol, series, ticker, rank) of a catalog: price and macro sources in the order in which they are tried."""
    every = F.map_concat(F.create_map(F.lit("price"), "tickers"), F.coalesce("macro", F.create_map().cast("map<string, array<string>>")))
    named = symbol_ids.select(F.col("id").alias("symbol"), F.explode(every).alias("series", "of"))
    return named.select("symbol", "series", F.posexplode("of").alias("rank", "ticker")).select("symbol", "series", "ticker", "rank")


def timeframes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TIMEFRAMES, "id string, min_bars int, horizon int")


def with_defaults(rows: DataFrame, symbol_ids: DataFrame, timeframe_ids: DataFrame) -> DataFrame:
    """Unknown symbols and timeframes become the default ones (the catalogs are a few rows: broadcast)."""
    s = symbol_ids.select(F.col("id").alias("_s"))
    t = timeframe_ids.select(F.col("id").alias("_t"))
    out = rows.join(F.broadcast(s), rows.symbol == F.col("_s"), "left").join(F.broadcast(t), rows.timeframe == F.col("_t"), "left")
    return out.withColumns({"symbol": F.coalesce("_s", F.lit(DEFAULT_SYMBOL)), "timeframe": F.coalesce("_t", F.lit(DEFAULT_TIMEFRAME))}).drop("_s", "_t")


def available_pairs(symbol_ids: DataFrame, timeframe_ids: DataFrame, trained: DataFrame) -> DataFrame:
    """The catalog's pairs that have a trained model."""
    every = symbol_ids.select(F.col("id").alias("symbol"), F.lit(1).alias("_k")).join(F.broadcast(timeframe_ids.select(F.col("id").alias("timeframe"), F.lit(1).alias("_k"))), "_k").drop("_k")  # catalogs: a few rows each
    return every.join(trained.select(*SERIES), SERIES, "left_semi").select(*SERIES)


def headlines(spark: SparkSession, sf_dir: str, symbols: tuple[str, ...] = ()) -> DataFrame:
    """Documents as headlines: the first line, a score of quality less toxicity, and a time of publication by doc_id.

    Their symbol is the source, or one of symbols in turn by doc_id."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    at = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("doc_id"), F.lit(168)) * 3600)
    return d.join(l, "doc_id", "left").withColumn("symbol", F.element_at(F.array(*map(F.lit, symbols)), (F.pmod("doc_id", F.lit(len(symbols))) + 1).cast("int")) if symbols else F.col("source")).select("doc_id", "symbol", F.substring_index("text", "\n", 1).alias("title"), at.alias("published_at"), (F.col("quality") - F.col("toxic")).cast("double").alias("score"))
