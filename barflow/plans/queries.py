"""Registered queries: each operator over bars that Spark derives from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.functions.asof import asof
from barflow.functions.blocks import in_blocks
from barflow.functions.ema import reach, wilder
from barflow.operators import datasets as D
from barflow.operators import evaluation as E
from barflow.operators import features as X
from barflow.operators import indicators as I
from barflow.operators import reading as R
from barflow.operators import structure as G
from barflow.operators import supply_demand as H
from barflow.operators import swings as S
from barflow.operators import volume_profile as V
from barflow.sources import bars as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
KEY = B.SERIES
AT = [*KEY, "ts"]


def query(f):
    """Registers f; its doubles are rounded so that sums in another order compare equal."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(spark, sf_dir)
        return df.select(*(F.round(F.col(f"`{c}`"), 6).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes))

    QUERIES[f.__name__] = run
    return f


def bars(spark: SparkSession, sf_dir: str, timeframe: str = "1H") -> DataFrame:
    return B.bars_from_ticks(B.ticks_from_events(spark, sf_dir), timeframe)


def posed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.with_pos(bars(spark, sf_dir), B.SIZE)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bars_from_ticks(B.ticks_from_orders(spark, sf_dir), "1D")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows with the heuristic probability and their folds, settled: what follows reads them more than once."""
    return B.settled(E.with_folds(X.triple_barrier(X.matrix(bars(spark, sf_dir)), places=True)).withColumn("proba", E.heuristic()), "scored")


@query
def bars_load(spark, d):
    return B.without_nan(bars(spark, d, "15m")).dropna()


@query
def bars_read(spark, d):
    path = B.folder(spark, "bars")
    B.write_series(bars(spark, d, "15m"), path)
    return B.read_bars(spark, path, timeframe="15m")


@query
def matrix_read(spark, d):
    path = B.folder(spark, "features")
    B.write_series(X.matrix(bars(spark, d)), path)
    return B.read_series(spark, path, timeframe="1H")


@query
def metrics_log(spark, d):
    path, s = B.folder(spark, "metrics"), scored(spark, d)
    for rows in (s.where("fold < 3"), s):  # an earlier run, then the one that counts
        B.append_metadata(E.brier_skill(rows).withColumn("run", F.lit(rows is s)), path)
    return B.latest_metadata(spark, path, by="run").select(*KEY, "brier", "skill")


@query
def trade_log_append(spark, d):
    path = B.folder(spark, "log")
    e = B.table(spark, d, "events").select("event_id", (F.col("value") / 100).alias("tier_a_prob"), F.col("event_type").alias("tier_b_bias"))
    for part in (e.where("value < 50"), e.where("value >= 50")):
        B.append_log(part, path)
    return spark.read.parquet(path)


@query
def vif_report(spark, d):
    path = B.folder(spark, "report")
    B.write_report(E.vif(X.matrix(bars(spark, d))), path, "vif")
    return spark.read.schema("symbol string, timeframe string, feature string, vif double, high boolean").option("header", True).csv(path)


@query
def lower_names(spark, d):
    return B.lower_names(B.table(spark, d, "events").select(F.col("event_id").alias("EVENT_ID"), F.col("event_type").alias("Event_Type"), F.col("value").alias("VALUE")))


@query
def macro_daily(spark, d):
    return X.clean_macro(B.macro_from_lineitem(spark, d))


@query
def macro_join(spark, d):
    l, o = B.table(spark, d, "lineitem"), B.table(spark, d, "orders")
    day = lambda t, c, v: t.groupBy(F.col(c).cast("date").alias("day")).agg(v.alias("value"))
    return B.join_macro(day(l, "l_shipdate", F.avg("l_extendedprice")), day(o, "o_orderdate", F.avg("o_totalprice") / 10000), day(l.where("l_linenumber = 1"), "l_shipdate", 100 * F.avg("l_tax")))


@query
def trade_log_valid(spark, d):
    e = B.table(spark, d, "events").select("event_id", (F.col("value") / 100).alias("tier_a_prob"), F.col("event_type").alias("tier_b_bias"))
    return e.where(F.col("tier_a_prob").between(0, 1))


@query
def source_fallback(spark, d):
    o = daily(spark, d).withColumn("rank", F.lit(2))
    l = B.bars_from_ticks(B.ticks_from_lineitem(spark, d), "1D").withColumn("rank", F.lit(1)).withColumn("symbol", F.when(F.col("symbol") == "A", "1-URGENT").otherwise(F.col("symbol")))
    return B.first_source(o.unionByName(l)).groupBy("symbol", "rank").agg(F.count("*").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


@query
def catalog_defaulting(spark, d):
    e = B.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "BTCUSD").otherwise(F.col("event_type")).alias("symbol"), F.when(F.col("event_id") % 2 == 0, "1H").otherwise("2H").alias("timeframe"))
    return B.with_defaults(e, B.symbols(spark), B.timeframes(spark)).groupBy(*KEY).agg(F.count("*").alias("n"))


@query
def pairs_available(spark, d):
    e = B.table(spark, d, "events")
    trained = e.select(F.element_at(F.array(*(F.lit(s) for s, *_ in B.SYMBOLS)), (F.col("user_id") % 5 + 1).cast("int")).alias("symbol"), F.element_at(F.array(*(F.lit(t) for t, _, _ in B.TIMEFRAMES)), (F.col("user_id") % 4 + 1).cast("int")).alias("timeframe")).distinct()
    return B.available_pairs(B.symbols(spark), B.timeframes(spark), trained)


@query
def bars_dedupe_last(spark, d):
    t = B.ticks_from_events(spark, d).select("symbol", F.lit("1H").alias("timeframe"), F.date_trunc("hour", "ts").alias("ts"), F.col("price").alias("close"), F.col("seq.event_id").alias("event_id"))
    return B.dedupe_last(t, "event_id")


@query
def tail_per_series(spark, d):
    return B.tail(bars(spark, d), 100)


@query
def macro_fill(spark, d):
    m = B.macro_from_lineitem(spark, d)
    gap = lambda c, k: F.when(F.dayofyear("day") % k != 0, F.col(c)).alias(c)
    return B.fill(m.select("day", "dxy", gap("vix", 3), gap("tnx", 4)), ["vix", "tnx"], [], "day")


@query
def bars_resample_4h(spark, d):
    return B.resample(bars(spark, d), "4H")


@query
def bars_resample_1d(spark, d):
    return B.resample(bars(spark, d), "1D")


@query
def bars_from_ticks_1h(spark, d):
    return bars(spark, d)


@query
def cross_tf_daily(spark, d):
    b = bars(spark, d)
    out = X.cross_timeframe(B.resample(b, "1D"), {"1h": b, "4h": B.resample(b, "4H")})
    return out.select("symbol", "ts", "close", "rsi_1h", "ema_cross_1h", "rsi_4h", "ema_cross_4h")


@query
def macro_attach(spark, d):
    return X.attach_macro(daily(spark, d), X.clean_macro(B.macro_from_lineitem(spark, d))).select(*AT, "close", *X.MACRO)


@query
def macro_asof(spark, d):
    m = X.clean_macro(B.macro_from_lineitem(spark, d))
    return X.attach_macro_asof(daily(spark, d), m).select(*AT, "close", *X.MACRO)


@query
def ema_20(spark, d):
    return I.with_averages(posed(spark, d), {"ema_20": 20}).select(*AT, "ema_20")


@query
def ema_50(spark, d):
    return I.with_averages(posed(spark, d), {"ema_50": 50}).select(*AT, "ema_50")


@query
def rsi_14(spark, d):
    return I.with_rsi(posed(spark, d)).select(*AT, "rsi")


@query
def true_range(spark, d):
    return I.with_true_range(posed(spark, d)).select(*AT, "tr")


@query
def atr_14(spark, d):
    return I.with_atr(posed(spark, d)).select(*AT, "atr")


@query
def atr_sma_200(spark, d):
    return I.with_true_range(posed(spark, d), long="atr_long").select(*AT, "atr_long")


@query
def macd(spark, d):
    return I.with_macd(posed(spark, d)).select(*AT, "macd", "macd_signal")


@query
def bollinger(spark, d):
    return I.bollinger(posed(spark, d)).select(*AT, "bb_mid", "bb_upper", "bb_lower", "bb_pct")


@query
def trend_bias(spark, d):
    return I.trend_bias(posed(spark, d))


@query
def mtf_confluence(spark, d):
    b = bars(spark, d)
    frames = [b, B.resample(b, "4H"), B.resample(b, "1D")]
    every = frames[0].unionByName(frames[1]).unionByName(frames[2])
    return I.confluence(I.trend_bias(B.with_pos(every)))


@query
def log_returns(spark, d):
    return I.with_returns(posed(spark, d), {"ret_1": 1, "ret_5": 5}).select(*AT, "ret_1", "ret_5")


@query
def entropy_20(spark, d):
    return I.with_entropy(posed(spark, d)).select(*AT, "entropy_20")


@query
def swings_fractal(spark, d):
    return S.swings(posed(spark, d))


@query
def structure_bias(spark, d):
    return S.structure_bias(posed(spark, d))


@query
def order_blocks_basic(spark, d):
    return S.order_blocks_basic(posed(spark, d))


@query
def fvg_basic(spark, d):
    return S.fair_gaps_basic(posed(spark, d))


@query
def smc_bias_rolling(spark, d):
    return S.with_rolling_structure(posed(spark, d)).select(*AT, "smc_bias")


@query
def sr_zones(spark, d):
    return S.zones(posed(spark, d))


@query
def nearest_zone(spark, d):
    df = S.with_rolling_structure(posed(spark, d)).withColumnRenamed("near", "z")
    return df.where("z is not null").select(*AT, F.col("z.price").alias("zone_price"), F.col("z.kind").alias("zone_kind"), F.col("z.touches").alias("touches"), F.col("z.distance_pct").alias("distance_pct"))


@query
def zone_distance(spark, d):
    df = in_blocks(posed(spark, d), reach(wilder(14)) + 1, 0, lambda df: S.with_rolling_structure(I.with_atr(df)))
    return S.with_zone_distance(df).select(*AT, "zone_dist_atr", "at_zone")


@query
def legs(spark, d):
    return G.legs(posed(spark, d), "internal")


@query
def legs_swing(spark, d):
    return G.legs(posed(spark, d), "swing")


@query
def structure_breaks_swing(spark, d):
    return G.breaks(posed(spark, d), "swing")


@query
def order_blocks_swing(spark, d):
    return G.live_order_blocks(posed(spark, d), "swing")


@query
def ob_mitigation_swing(spark, d):
    b = posed(spark, d)
    return G.mitigation(G.order_blocks(b, "swing"), b)


@query
def pivots(spark, d):
    return G.pivots(posed(spark, d)).select(*KEY, "pos", "confirmed", "price", "kind", "label")


@query
def equal_hl(spark, d):
    return G.equal_levels(posed(spark, d))


@query
def structure_breaks(spark, d):
    return G.breaks(posed(spark, d), "internal")


@query
def order_blocks(spark, d):
    return G.live_order_blocks(posed(spark, d), "internal")


@query
def fvg(spark, d):
    return G.live_gaps(posed(spark, d))


@query
def ob_mitigation(spark, d):
    b = posed(spark, d)
    return G.mitigation(G.order_blocks(b, "internal"), b)


@query
def premium_discount(spark, d):
    return G.premium_discount(posed(spark, d))


@query
def smc_summary(spark, d):
    return G.summary(posed(spark, d))


@query
def volume_spike(spark, d):
    return H.with_spike(posed(spark, d)).select(*AT, "spike")


@query
def sd_candidates(spark, d):
    return H.candidates(posed(spark, d))


@query
def sd_cooldown(spark, d):
    return H.cooled(H.candidates(posed(spark, d))).select(*KEY, "kind", "x1", "x2")


@query
def supply_demand(spark, d):
    return H.supply_demand(posed(spark, d))


@query
def order_flow(spark, d):
    return H.order_flow(posed(spark, d))


@query
def volume_profile_bins(spark, d):
    return V.bins(bars(spark, d))


@query
def vp_poc(spark, d):
    return V.profile(bars(spark, d)).select(*V.DAY, "poc_price")


@query
def vp_value_area(spark, d):
    return V.profile(bars(spark, d))


@query
def feature_matrix(spark, d):
    return X.matrix(bars(spark, d))


@query
def features_last_row(spark, d):
    return X.last_row(bars(spark, d))


@query
def features_last_row_exact(spark, d):
    return X.last_row(bars(spark, d), exact=True)


@query
def feature_matrix_macro(spark, d):
    return X.matrix(daily(spark, d), X.clean_macro(B.macro_from_lineitem(spark, d)))


@query
def feature_matrix_deduped(spark, d):
    b = bars(spark, d)
    late = b.where(F.minute("ts") == 0).withColumns({"close": F.col("open"), "seq": F.lit(0)})  # the same bars, come in before
    return X.matrix(late.unionByName(b.withColumn("seq", F.lit(1))), seq="seq")


@query
def triple_barrier(spark, d):
    return X.triple_barrier(X.matrix(bars(spark, d))).select(*AT, "close", "atr_pct", "label", "label_bars")


@query
def label_balance(spark, d):
    return X.label_balance(X.triple_barrier(X.matrix(bars(spark, d))))


@query
def feature_corr(spark, d):
    return E.correlations(X.matrix(bars(spark, d)))


@query
def high_corr_pairs(spark, d):
    return E.high_correlations(X.matrix(bars(spark, d)), least=0.25)


@query
def high_corr_pairs_published(spark, d):
    return E.high_correlations(X.matrix(bars(spark, d)))


@query
def vif(spark, d):
    return E.vif(X.matrix(bars(spark, d)))


@query
def time_series_folds(spark, d):
    return E.fold_table(scored(spark, d))


@query
def standardize(spark, d):
    return E.standardized(scored(spark, d).drop("fold"), ["rsi", "atr_pct", "ret_1"])


@query
def training_gate(spark, d):
    return E.training_gate(scored(spark, d), B.timeframes(spark))


@query
def brier_skill(spark, d):
    return E.brier_skill(scored(spark, d))


@query
def roc_auc(spark, d):
    return E.roc_auc(scored(spark, d).where("fold > 0"))


@query
def reliability(spark, d):
    return E.reliability(scored(spark, d).where("fold > 0"))


@query
def conformal_qhat(spark, d):
    return E.conformal(scored(spark, d).where("fold > 0"))


@query
def threshold_taken(spark, d):
    return D.with_taken(scored(spark, d)).select(*AT, "proba", "threshold", "taken")


@query
def equity_curve(spark, d):
    return D.equity(scored(spark, d)).select(*AT, "pnl_r", "equity_r", "equity_pct")


@query
def backtest_metrics(spark, d):
    return D.metrics(scored(spark, d))


@query
def kpis(spark, d):
    return D.kpis(scored(spark, d)).drop("sparkline")


@query
def kpis_live(spark, d):
    """Headline numbers with the last bar's reading, which labelled rows don't have yet."""
    return D.kpis(scored(spark, d), R.predictions(bars(spark, d))).drop("sparkline")


@query
def kpi_sparklines(spark, d):
    return D.kpis(scored(spark, d)).select(*KEY, "id", F.posexplode("sparkline").alias("i", "equity_r"))


@query
def probability_hist(spark, d):
    return D.histogram(scored(spark, d))


@query
def probability_stats(spark, d):
    return D.probability_stats(scored(spark, d))


@query
def trades_recent(spark, d):
    return D.recent_trades(scored(spark, d))


@query
def confidence_gauges(spark, d):
    return D.gauges(scored(spark, d))


@query
def insight_flags(spark, d):
    s = scored(spark, d)
    return D.insight_flags(s, E.brier_skill(s), E.roc_auc(s.where("fold > 0")))


@query
def chart_window(spark, d):
    b = bars(spark, d)
    context = B.with_pos(B.tail(b, 150 + 200))
    return G.window_items(G.fair_gaps(context).withColumn("x2", F.col("x") + 1), b, 150, columns=("x", "x2"))


@query
def chart_overlays(spark, d):
    from barflow.operators.chart import overlays

    return overlays(bars(spark, d), 150)


@query
def equity_extremes(spark, d):
    return D.extremes(scored(spark, d))


@query
def heuristic_proba(spark, d):
    return R.predictions(bars(spark, d)).select(*AT, "proba", "is_probability")


@query
def conformal_interval(spark, d):
    p = scored(spark, d).select(*AT, "proba", F.lit(True).alias("is_probability"))
    return R.intervals(p, E.conformal(scored(spark, d).where("fold > 0")))


@query
def tier_b(spark, d):
    return R.tier_b(bars(spark, d))


@query
def kelly_sizing(spark, d):
    return R.sizing(scored(spark, d).select(*AT, "proba"))


@query
def reading(spark, d):
    news = R.news_overlay(R.recent_headlines(B.headlines(spark, d, ("click", "view", "purchase", "signup", "error"))))
    r = R.readings(bars(spark, d), E.conformal(scored(spark, d).where("fold > 0")), news, B.timeframes(spark))
    return r.select(*KEY, "asof", "price", "horizon_bars", "tier_a.probability", "tier_a.direction", "tier_b.bias", "tier_b.zone_price", "tier_b.at_zone", "news.count", "news.score", "news.tag", "sizing.final_pct", F.round(F.col("features")["atr_pct"], 4).alias("atr_pct"))


@query
def headlines_recent(spark, d):
    return R.recent_headlines(B.headlines(spark, d)).select("symbol", "doc_id", "title", "published_at", "score", "n")


#: News queries of the ticks' series, in words that the given titles have.
NEWS_QUERIES = [("click", 'the OR "of the"'), ("view", 'der OR "die der" OR und'), ("purchase", 'les OR "de la"'), ("signup", "que OR nothing"), ("error", '"the the" OR con OR the')]


def news_catalog(spark):
    return B.symbols(spark).select("id", "news_query").unionByName(spark.createDataFrame(NEWS_QUERIES, "id string, news_query string"))


@query
def headlines_matched(spark, d):
    found = R.matched_headlines(B.headlines(spark, d), news_catalog(spark))
    return found.select("symbol", "doc_id", "title", "published_at", "score")


@query
def news_overlay_matched(spark, d):
    return R.news_overlay(R.recent_headlines(R.matched_headlines(B.headlines(spark, d), news_catalog(spark))))


@query
def asof_ticks(spark, d):
    """The last matched headline at or before each 15-minute bar."""
    news = R.matched_headlines(B.headlines(spark, d), news_catalog(spark)).select("symbol", "published_at", "doc_id", "score")
    df = asof(bars(spark, d, "15m"), news, ["symbol"], "ts", "published_at", ["doc_id", "score"], "doc_id")
    return df.select(*AT, "close", "doc_id", "score", F.col("asof_ts").alias("published_at"), (F.unix_seconds("ts") - F.unix_seconds("asof_ts")).alias("age"))


@query
def asof_quotes(spark, d):
    """The last tick at or before each matched headline, unless it is older than ten minutes."""
    news = R.matched_headlines(B.headlines(spark, d), news_catalog(spark)).select("symbol", "published_at", "doc_id")
    ticks = B.ticks_from_events(spark, d).select("symbol", "ts", "price", "seq")
    return asof(news, ticks, ["symbol"], "published_at", "ts", ["price"], "seq", within="10 minutes").select("symbol", "doc_id", "published_at", "price", F.col("asof_ts").alias("quoted_at"))


@query
def sentiment_parse(spark, d):
    return B.table(spark, d, "documents").select("doc_id", R.parsed_score(F.col("text")).alias("score"))


@query
def news_overlay(spark, d):
    return R.news_overlay(R.recent_headlines(B.headlines(spark, d)))


@query
def market_overview(spark, d):
    m = R.market(posed(spark, d))
    return m.select(*KEY, "price", "change", F.size("spark").alias("n"), "volume", "signal")


@query
def market_sparklines(spark, d):
    return R.market(posed(spark, d)).select(*KEY, F.posexplode("spark").alias("i", "close"))


@query
def stale_series(spark, d):
    from barflow.streaming.live import stale

    return stale(bars(spark, d, "15m"))


def labeled(spark: SparkSession, sf_dir: str, *timeframes: str) -> DataFrame:
    """Labelled matrix rows of the ticks' bars, settled: training reads them many times."""
    every = bars(spark, sf_dir, timeframes[0])
    for t in timeframes[1:]:
        every = every.unionByName(bars(spark, sf_dir, t))
    return B.settled(X.triple_barrier(X.matrix(every)), "labeled")


@query
def train_logreg(spark, d):
    from barflow.operators import training as T

    rows, model = T.out_of_sample(labeled(spark, d, "15m"))
    return E.brier_skill(B.settled(rows, "scored")).join(model.select(*KEY, (F.col("residual") <= T.OPTIMAL).alias("optimal")), KEY)


@query
def platt(spark, d):
    from barflow.operators import training as T

    rows = labeled(spark, d, "15m")
    return T.score(rows, T.calibrated(rows)).select(*AT, "label", "proba")


@query
def benchmarks(spark, d):
    from barflow.operators import training as T
    from barflow.operators import trees

    return trees.benchmarks(T.trained_pairs(labeled(spark, d, "15m"), B.timeframes(spark)))


@query
def feature_importance(spark, d):
    from barflow.operators import training as T

    rows = labeled(spark, d, "15m")
    return T.importance(T.calibrated(rows), rows)


@query
def run_index(spark, d):
    from barflow.operators.training import run_pairs

    return run_pairs(labeled(spark, d, "15m", "1H"), B.timeframes(spark))


@query
def model_cards(spark, d):
    from barflow.operators import training as T
    from barflow.operators import trees

    rows = T.trained_pairs(labeled(spark, d, "15m"), B.timeframes(spark))
    model = T.calibrated(rows)
    scored = B.settled(T.score(rows, model), "scored")
    tested, _ = T.out_of_sample(rows)
    auc = E.roc_auc(B.settled(tested.where("fold > 0"), "tested"))
    return D.model_cards(model, auc, trees.benchmarks(rows), scored).drop("train_s")


@query
def reading_trained(spark, d):
    """Readings of the trained pairs by their model and its interval, of the others by the heuristic."""
    from barflow.operators import training as T

    rows, b = T.trained_pairs(labeled(spark, d, "15m"), B.timeframes(spark)), bars(spark, d, "15m").unionByName(bars(spark, d))
    tested, _ = T.out_of_sample(rows)
    q_hat = E.conformal(B.settled(tested.where("fold > 0"), "tested"))
    news = R.news_overlay(R.recent_headlines(B.headlines(spark, d, ("click", "view", "purchase", "signup", "error"))))
    r = R.readings(B.settled(b, "bars"), q_hat, news, B.timeframes(spark), T.calibrated(rows))
    return r.select(*KEY, "asof", "price", "tier_a.*", "tier_b.bias", "sizing.final_pct")


def _ticks_stream(spark, d):
    """The events table as a stream of ticks (event-time order is what the watermark sees in files)."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).where("value > 0")
    return e.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("volume"), "event_id")


def _drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives over the files that are there, as a table in the shared folder."""
    spark, out = stream.sparkSession, B.folder(stream.sparkSession, "stream")
    stream.writeStream.outputMode(mode).format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def _bar_stream(spark, rows: DataFrame, files: int = 4) -> DataFrame:
    """rows as a stream of files in time order, one a trigger."""
    path = B.folder(spark, "bars")
    span = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    width = (span["b"] - span["a"]).total_seconds() / files + 1 if span["a"] else 1
    part = F.floor((F.unix_seconds("ts") - F.unix_seconds(F.lit(span["a"]))) / width)
    settled = B.settled(rows.withColumn("_part", part), "bars")
    for k in range(files):
        settled.where(F.col("_part") == k).drop("_part").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(B.BAR_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


@query
def stream_stale(spark, d):
    from barflow.streaming.live import stream_stale as live

    events = _drained(live(_bar_stream(spark, bars(spark, d, "15m"))))
    return events.groupBy(*KEY).agg(F.max("last_ts").alias("last_ts"), F.max_by("stale", F.struct("last_ts", "stale")).alias("stale"))


@query
def stream_bars(spark, d):
    from barflow.streaming.live import stream_bars as live

    return _drained(live(_ticks_stream(spark, d)))


@query
def stream_ema(spark, d):
    from barflow.streaming.live import stream_averages

    return _drained(stream_averages(_bar_stream(spark, bars(spark, d))))


@query
def stream_reading(spark, d):
    from barflow.streaming.live import stream_readings

    path = B.folder(spark, "reading")
    stream_readings(_bar_stream(spark, bars(spark, d)), f"{path}/readings", lambda b: R.predictions(b).select(*AT, "close", "proba"), f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/readings").select(*AT, "close", "proba")
