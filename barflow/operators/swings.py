"""Swing points, structure bias, support and resistance zones, and the simple block and gap detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.functions.blocks import W, in_blocks, previous, rows
from barflow.sources.bars import SERIES, settled

HALF = 5  # bars on each side of a swing
TRAIL = 150  # bars that a rolling reading looks back
TOLERANCE = 0.003
BODY = 1.6
FIRST = 60  # bars before the first rolling reading


def with_swings(bars: DataFrame, half: int = HALF) -> DataFrame:
    """swing_high and swing_low hold the price where the bar is the extreme of its centred window."""
    w = rows(-half, half)
    full = F.count("high").over(w) == 2 * half + 1
    extremes = {
        "swing_high": F.when(full & (F.col("high") == F.max("high").over(w)), F.col("high")),
        "swing_low": F.when(full & (F.col("low") == F.min("low").over(w)), F.col("low")),
    }
    return in_blocks(bars, half, half, lambda df: df.withColumns(extremes))


def swings(bars: DataFrame) -> DataFrame:
    """(symbol, timeframe, pos, ts, price, kind): a bar can be both a high and a low."""
    df = with_swings(bars)
    kinds = F.array(F.struct(F.lit("high").alias("kind"), F.col("swing_high").alias("price")), F.struct(F.lit("low").alias("kind"), F.col("swing_low").alias("price")))
    return df.select(*SERIES, "pos", "ts", F.explode(kinds).alias("s")).where("s.price is not null").select(*SERIES, "pos", "ts", "s.price", "s.kind")


def _second_last(prices: Column) -> Column:
    return F.when(F.size(prices) >= 2, F.element_at(prices, -2))


def _bias(close: Column, highs: Column, lows: Column) -> Column:
    up, down = close > _second_last(highs), close < _second_last(lows)
    return F.when(F.coalesce(up, F.lit(False)), 1).when(F.coalesce(down, F.lit(False)), -1).otherwise(0)


def structure_bias(bars: DataFrame) -> DataFrame:
    """(symbol, timeframe, bias) on the last bar: its close against the second-last swing high, then low."""
    w = Window.partitionBy(*SERIES, "kind").orderBy(F.desc("pos"))
    second = swings(bars).withColumn("_n", F.row_number().over(w)).where("_n <= 2").where("_n = 2")
    levels = second.groupBy(*SERIES).agg(*(F.max(F.when(F.col("kind") == k, F.col("price"))).alias(f"_{k}") for k in ("high", "low")))
    last = bars.groupBy(*SERIES).agg(F.max_by("close", "pos").alias("close"))
    up, down = F.col("close") > F.col("_high"), F.col("close") < F.col("_low")
    return last.join(levels, SERIES, "left").select(*SERIES, F.when(up, 1).when(down, -1).otherwise(0).alias("bias"))


def _clusters(points: Column, tolerance: float) -> Column:
    """Array of zones from pieces (first, last, total, n, low) of prices that lie together, lowest first."""
    empty = F.expr("cast(array() as array<struct<first:double,last:double,total:double,n:bigint,low:bigint>>)")

    def step(clusters: Column, x: Column) -> Column:
        last = F.get(clusters, F.size(clusters) - 1)
        joins = (F.size(clusters) > 0) & (x["first"] - last["last"] <= last["first"] * tolerance)
        grown = F.struct(last["first"].alias("first"), x["last"].alias("last"), *((last[c] + x[c]).alias(c) for c in ("total", "n", "low")))
        return F.when(joins, F.concat(F.slice(clusters, 1, F.greatest(F.size(clusters) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(clusters, F.array(x)))

    kind = lambda c: F.when(c["low"] * 2 >= c["n"], "support").otherwise("resistance")
    zone = lambda c: F.struct((c["total"] / c["n"]).alias("price"), c["last"].alias("top"), c["first"].alias("bottom"), kind(c).alias("kind"), c["n"].cast("int").alias("touches"))
    return F.transform(F.aggregate(points, empty, step), zone)


def zones_of(highs: Column, lows: Column, tolerance: float = TOLERANCE) -> Column:
    """Array of zones (price, top, bottom, kind, touches) from swing prices, lowest first.

    Sorted prices join the open cluster while their gap to its last member is within the
    tolerance of its first member.  A cluster with at least as many lows as highs is support."""
    alone = lambda p, low: F.struct(p.alias("first"), p.alias("last"), p.alias("total"), F.lit(1).cast("long").alias("n"), F.lit(low).cast("long").alias("low"))
    pieces = F.concat(F.transform(highs, lambda p: alone(p, 0)), F.transform(lows, lambda p: alone(p, 1)))
    return _clusters(F.array_sort(pieces), tolerance)


def price_runs(points: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Swings (price, kind) as runs (_low, its least price) of pieces: prices that share a zone whatever lies below them.

    A cluster's tolerance is that of its first price, which is never below the run's, so prices in a cell narrower
    than the tolerance of the least price stay together: rows add up by cell.  A gap wider
    than the tolerance of the price before it always starts a zone, and a run.  A run has at most (top / low - 1) / (0.9 tolerance)
    pieces, 370 for each time its least price fits in its height, however many swings there are."""
    points = settled(points.select(*SERIES, "price", "kind"), "swings")  # read twice: the least price and the cells
    pieces = [F.min("first").alias("first"), F.max("last").alias("last"), *(F.sum(c).alias(c) for c in ("total", "n", "low"))]
    each = points.select(*SERIES, *(F.col("price").alias(c) for c in ("first", "last", "total")), F.lit(1).cast("long").alias("n"), (F.col("kind") == "low").cast("long").alias("low"))
    cell = lambda least: F.when(F.col(least) > 0, F.floor((F.col("first") - F.col(least)) / (F.col(least) * 0.9 * tolerance)).cast("double")).otherwise(F.col("first"))
    least = points.groupBy(*SERIES).agg(F.min("price").alias("_least"))
    cells = each.join(least, SERIES).groupBy(*SERIES, cell("_least").alias("_cell")).agg(*pieces)
    by_price = Window.partitionBy(*SERIES).orderBy("first")  # a row a cell
    before = F.lag("last").over(by_price)
    cells = cells.withColumn("_new", F.coalesce(F.col("first") - before > before * tolerance, F.lit(True)))
    cells = cells.withColumn("_low", F.last(F.when(F.col("_new"), F.col("first")), True).over(by_price.rowsBetween(Window.unboundedPreceding, 0)))
    wider = cells.groupBy(*SERIES, "_low", cell("_low").alias("_cell")).agg(*pieces)
    return wider.groupBy(*SERIES, "_low").agg(F.array_sort(F.collect_list(F.struct("first", "last", "total", "n", "low"))).alias("pieces"))


def zones(bars: DataFrame) -> DataFrame:
    """One row for each zone of a series' swings, clustered inside runs of prices."""
    each = price_runs(swings(bars)).select(*SERIES, "_low", F.posexplode(_clusters(F.col("pieces"), TOLERANCE)).alias("_i", "z"))
    return each.select(*SERIES, (F.row_number().over(Window.partitionBy(*SERIES).orderBy("_low", "_i")) - 1).alias("zone"), "z.*")


def nearest_zone(zone_array: Column, price: Column, kind: str | None = None) -> Column:
    """The zone whose price is closest (the lower one of two), or null; distance_pct comes with it."""
    kept = F.filter(zone_array, lambda z: z["kind"] == kind) if kind else zone_array
    scored = F.transform(kept, lambda z: F.struct(F.abs(z["price"] - price).alias("distance"), z["price"].alias("price"), z["top"].alias("top"), z["bottom"].alias("bottom"), z["kind"].alias("kind"), z["touches"].alias("touches"), (F.abs(z["price"] - price) / price * 100).alias("distance_pct")))
    return F.array_min(scored)


def nearest_of(highs: Column, lows: Column, price: Column, tolerance: float = TOLERANCE) -> Column:
    """nearest_zone of the zones_of these swings, in one fold that keeps the open zone and the nearest closed one."""
    tag = lambda prices, low: F.transform(prices, lambda p: F.struct(p.alias("p"), F.lit(low).alias("low")))
    points = F.array_sort(F.concat(tag(highs, 0), tag(lows, 1)))
    start = F.expr("cast(null as struct<first:double,last:double,total:double,n:int,low:int,best:struct<distance:double,price:double,top:double,bottom:double,kind:string,touches:int,distance_pct:double>>)")

    def nearer(s: Column) -> Column:
        middle = s["total"] / s["n"]
        far = F.abs(middle - price)
        closed = F.struct(far.alias("distance"), middle.alias("price"), s["last"].alias("top"), s["first"].alias("bottom"), F.when(s["low"] * 2 >= s["n"], "support").otherwise("resistance").alias("kind"), s["n"].alias("touches"), (far / price * 100).alias("distance_pct"))
        return F.when(s["best"].isNull() | (far < s["best"]["distance"]), closed).otherwise(s["best"])

    def step(s: Column, x: Column) -> Column:
        state = lambda first, total, n, low, best: F.struct(first.alias("first"), x["p"].alias("last"), total.alias("total"), n.alias("n"), low.alias("low"), best.alias("best"))
        grown = state(s["first"], s["total"] + x["p"], s["n"] + 1, s["low"] + x["low"], s["best"])
        fresh = state(x["p"], x["p"], F.lit(1), x["low"], F.when(s.isNotNull(), nearer(s)))
        return F.when(s.isNotNull() & (x["p"] - s["last"] <= s["first"] * tolerance), grown).otherwise(fresh)

    return F.aggregate(points, start, step, lambda s: F.when(s.isNotNull(), nearer(s)))


def with_rolling_structure(bars: DataFrame, trail: int = TRAIL) -> DataFrame:
    """smc_bias and the nearest zone (near) of each bar from its trailing window, from bar FIRST on.

    Swings are found once; the ones whose whole window lies in bars pos-trail .. pos are those at
    pos-trail+HALF .. pos-HALF, and at a series' start no window is clipped."""
    return in_blocks(bars, trail, 0, lambda df: _rolling(df, trail))


def _rolling(bars: DataFrame, trail: int) -> DataFrame:
    df = with_swings(bars)
    w = rows(-(trail - HALF), -HALF)
    df = df.withColumns({"_h": F.collect_list("swing_high").over(w), "_l": F.collect_list("swing_low").over(w)})
    late = F.col("pos") >= FIRST
    return df.withColumns(
        {
            "smc_bias": F.when(late, _bias(F.col("close"), F.col("_h"), F.col("_l"))).otherwise(0),
            "near": F.when(late, nearest_of(F.col("_h"), F.col("_l"), F.col("close"))),
        }
    ).drop("_h", "_l", "swing_high", "swing_low")


def with_zone_distance(df: DataFrame, atr: str = "atr") -> DataFrame:
    """zone_dist_atr and at_zone of frames that have near and an ATR."""
    df = df.withColumn("zone_dist_atr", F.when(F.col(atr) > 0, F.col("near.distance") / F.col(atr)))
    return df.withColumn("at_zone", F.when(F.coalesce(F.col("zone_dist_atr") < 0.5, F.lit(False)), 1).otherwise(0))


def order_blocks_basic(bars: DataFrame, most: int = 3) -> DataFrame:
    """The first blocks of a series: the bar before one whose body is BODY times the last body."""
    body = F.abs(F.col("close") - F.col("open"))
    before = {"_body": body, "_last": F.lag(body).over(W()), "top": previous("high"), "bottom": previous("low")}
    df = in_blocks(bars, 1, 0, lambda df: df.withColumns(before))
    df = df.withColumns({"at": F.col("pos") - 1, "kind": F.when(F.col("close") > F.col("open"), "bullish").otherwise("bearish")})
    hit = df.where("_last > 0").where(F.col("_body") >= BODY * F.col("_last"))
    first = Window.partitionBy(*SERIES).orderBy("at")
    return hit.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most).select(*SERIES, "at", "kind", "top", "bottom")


def fair_gaps_basic(bars: DataFrame, most: int = 10) -> DataFrame:
    """The first gaps of a series, by their middle bar."""
    beside = {"_ph": previous("high"), "_pl": previous("low"), "_nh": F.lead("high").over(W()), "_nl": F.lead("low").over(W())}
    df = in_blocks(bars, 1, 1, lambda df: df.withColumns(beside))
    up, down = F.col("_ph") < F.col("_nl"), F.col("_pl") > F.col("_nh")
    df = df.withColumns({"kind": F.when(up, "bullish").when(down, "bearish"), "top": F.when(up, F.col("_nl")).when(down, F.col("_pl")), "bottom": F.when(up, F.col("_ph")).when(down, F.col("_nh"))})
    hit = df.where("kind is not null").withColumn("price", (F.col("top") + F.col("bottom")) / 2)
    first = Window.partitionBy(*SERIES).orderBy("pos")
    return hit.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most).select(*SERIES, "pos", "kind", "price", "top", "bottom")
