"""Structure overlays as windows: legs, pivots, breaks, order blocks, gaps, and what is left of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.functions.blocks import in_blocks, previous, rows, scanned, sized
from barflow.operators.indicators import with_true_range
from barflow.sources.bars import SERIES

SCOPES = {"swing": 10, "internal": 4}
LONG = 200  # bars of the long ATR
EQUAL = 0.1  # of the long ATR: two pivots within it are equal
KEEP_BLOCKS, KEEP_GAPS = 12, 20


def prepared(bars: DataFrame) -> DataFrame:
    """Bars of series that are long enough, with the long ATR and its parsed highs and lows."""
    wild = F.col("high") - F.col("low") >= 2 * F.col("atr_long")
    parsed = {"parsed_high": F.when(wild, F.col("low")).otherwise(F.col("high")), "parsed_low": F.when(wild, F.col("high")).otherwise(F.col("low"))}
    return in_blocks(bars, LONG, 0, lambda df: with_true_range(_long_enough(df), long="atr_long", n=LONG).withColumns(parsed))


def _long_enough(df: DataFrame) -> DataFrame:
    """The rows of a haloed frame whose series have as many bars as the widest scope and three more."""
    return sized(df).where(F.col("_n") >= max(SCOPES.values()) + 3).drop("_n")


def with_leg(bars: DataFrame, size: int) -> DataFrame:
    """leg is 1 from a low, 0 from a high that the next `size` bars stay within; carried on, 0 at first.

    _leg is the leg before the bar; _high, _low and _atr are of the bar `size` before, _close of the last one."""
    w = rows(-(size - 1), 0)
    signal = F.when(previous("high", size) > F.max("high").over(w), 0).when(previous("low", size) < F.min("low").over(w), 1)
    back = {"_s": signal, "_high": previous("high", size), "_low": previous("low", size), "_atr": previous("atr_long", size), "_close": previous("close")}
    df = in_blocks(bars, LONG + size, 0, lambda df: prepared(df).withColumns(back))
    df = scanned(df, {"leg": ("last", "_s", True), "_leg": ("last", "_s", False)})
    return df.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("leg", "_leg")}).drop("_s")


def legs(bars: DataFrame, scope: str) -> DataFrame:
    return with_leg(bars, SCOPES[scope]).select(*SERIES, "pos", "leg")


def _with_pivots(bars: DataFrame, size: int) -> DataFrame:
    """pivot_high / pivot_low: the price of the pivot that the bar confirms; pivot_pos its place."""
    df = with_leg(bars, size)
    flip = F.col("leg") != F.col("_leg")
    at = {"pivot_pos": F.when(flip, F.col("pos") - size), "pivot_high": F.when(flip & (F.col("leg") == 0), F.col("_high")), "pivot_low": F.when(flip & (F.col("leg") == 1), F.col("_low")), "pivot_atr": F.when(flip, F.col("_atr"))}
    return df.withColumns(at)


def pivots(bars: DataFrame, scope: str = "swing") -> DataFrame:
    """(pos, confirmed, price, kind, label): the first of a kind is HH or LL."""
    df = _with_pivots(bars, SCOPES[scope]).where("pivot_pos is not null")
    df = df.select(*SERIES, F.col("pivot_pos").alias("pos"), F.col("pos").alias("confirmed"), F.coalesce("pivot_high", "pivot_low").alias("price"), F.when(F.col("pivot_high").isNotNull(), "high").otherwise("low").alias("kind"), "pivot_atr")
    df = scanned(df, {"last": ("last", "price", False)}, order=("confirmed",), keys=[*SERIES, "kind"])
    high = F.when(F.col("last").isNull() | (F.col("price") > F.col("last")), "HH").otherwise("LH")
    low = F.when(F.col("last").isNull() | (F.col("price") < F.col("last")), "LL").otherwise("HL")
    return df.withColumn("label", F.when(F.col("kind") == "high", high).otherwise(low))


def equal_levels(bars: DataFrame) -> DataFrame:
    """Pivots as high or low as the one before of their kind."""
    p = pivots(bars).where((F.col("pivot_atr") > 0) & (F.abs(F.col("price") - F.col("last")) <= EQUAL * F.col("pivot_atr")))
    return p.select(*SERIES, F.when(F.col("kind") == "high", "EQH").otherwise("EQL").alias("kind"), F.col("pos").alias("x"), "price", F.col("last").alias("prev_price"))


def breaks(bars: DataFrame, scope: str) -> DataFrame:
    """(pos, pivot_pos, level, side, tag): the first crossing of each pivot's level, once a pivot."""
    both = (("bull", "pivot_high"), ("bear", "pivot_low"))
    df = _with_pivots(bars, SCOPES[scope])
    df = scanned(df, {f"_{side}": ("last", F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("level"), "pivot_pos")), True) for side, c in both})
    close, last = F.col("close"), F.col("_close")
    sides = []
    for side, _ in both:
        level, of = F.col(f"_{side}.level"), F.col(f"_{side}.pivot_pos")
        crossed = (close > level) & (last <= level) if side == "bull" else (close < level) & (last >= level)
        sides.append(F.when(crossed, F.struct(of.alias("pivot_pos"), level.alias("level"), F.lit(side).alias("side"))))
    hit = df.select(*SERIES, "pos", F.array_compact(F.array(*sides)).alias("_s")).select(*SERIES, "pos", F.explode("_s").alias("_s")).select(*SERIES, "pos", "_s.*")
    first = Window.partitionBy(*SERIES, "side", "pivot_pos").orderBy("pos")
    out = hit.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    out = scanned(out.withColumn("_bear", F.col("side") == "bear"), {"_last": ("last", "side", False)}, order=("pos", "_bear"))
    return out.withColumn("tag", F.when(F.col("_last").isNotNull() & (F.col("_last") != F.col("side")), "CHoCH").otherwise("BOS")).drop("_last", "_bear")


def order_blocks(bars: DataFrame, scope: str, bucket: int = 512) -> DataFrame:
    """The extreme bar between each break's pivot and the break: bull its lowest low, bear its highest high.

    The range join goes by buckets of positions, so a bar only meets breaks near it."""
    b = breaks(bars, scope).withColumn("bucket", F.explode(F.sequence(F.floor(F.col("pivot_pos") / bucket), F.floor(F.col("pos") / bucket))))
    x = prepared(bars).select(*SERIES, F.col("pos").alias("x"), "parsed_high", "parsed_low", F.floor(F.col("pos") / bucket).alias("bucket"))
    pair = b.join(x, [*SERIES, "bucket"]).where(F.col("x").between(F.col("pivot_pos"), F.col("pos")))
    value = F.when(F.col("side") == "bull", F.col("parsed_low")).otherwise(-F.col("parsed_high"))
    best = pair.groupBy(*SERIES, "side", "pos", "pivot_pos", "tag").agg(F.min_by(F.struct("x", "parsed_high", "parsed_low"), F.struct(value.alias("v"), F.col("x").alias("i"))).alias("b"))
    return best.select(*SERIES, "side", F.col("pos").alias("break_pos"), F.col("b.x").alias("x"), F.col("b.parsed_high").alias("top"), F.col("b.parsed_low").alias("bottom"))


def fair_gaps(bars: DataFrame) -> DataFrame:
    """Gaps over two bars, stored at the middle one."""
    df = in_blocks(bars, 2, 0, lambda df: _long_enough(df).withColumns({"_h": previous("high", 2), "_l": previous("low", 2)}))
    up, down = F.col("low") > F.col("_h"), F.col("high") < F.col("_l")
    df = df.withColumns({"side": F.when(up, "bull").when(down, "bear"), "top": F.when(up, F.col("low")).when(down, F.col("_l")), "bottom": F.when(up, F.col("_h")).when(down, F.col("high"))})
    return df.where("side is not null").select(*SERIES, "side", (F.col("pos") - 1).alias("x"), "top", "bottom")


def with_future(bars: DataFrame, low: str = "low", high: str = "high") -> DataFrame:
    """Least low and greatest high of all later bars."""
    later = scanned(bars.select(*SERIES, "pos", low, high), {}, {"later_low": ("min", low, False), "later_high": ("max", high, False)})
    return later.select(*SERIES, "pos", "later_low", "later_high")


def _dead(side: Column) -> Column:
    return F.coalesce(F.when(side == "bull", F.col("later_low") < F.col("bottom")).otherwise(F.col("later_high") > F.col("top")), F.lit(False))


def live(items: DataFrame, bars: DataFrame, at: str) -> DataFrame:
    """Items no later bar (after the one in column at) has gone through: suffix extremes, no range join."""
    f = with_future(bars).withColumnRenamed("pos", at)
    return items.join(f, [*SERIES, at]).where(~_dead(F.col("side"))).drop("later_low", "later_high")


def mitigation(blocks: DataFrame, bars: DataFrame, bucket: int = 512) -> DataFrame:
    """blocks with mitigated: the first later bar that goes through them, or null.

    A block looks at the extremes of whole groups of buckets, then at the buckets of its own group and of the
    first that goes through it, then at the bars of at most three buckets: no block meets its whole series."""
    key = [*SERIES, "side", "break_pos", "x"]
    near, wide = F.floor(F.col("x") / bucket), F.floor(F.col("x") / bucket / bucket)
    past = lambda e: F.when(F.col("side") == "bull", e["low"] < F.col("bottom")).otherwise(e["high"] > F.col("top"))
    first = lambda of, own: F.get(F.filter(F.col(of), lambda e: (e["at"] > own) & past(e)), F.lit(0))["at"]
    edges = [F.min("low").alias("low"), F.max("high").alias("high")]
    small = bars.groupBy(*SERIES, F.floor(F.col("pos") / bucket).alias("at")).agg(*edges)
    large = small.groupBy(*SERIES, F.floor(F.col("at") / bucket).alias("group")).agg(F.array_sort(F.collect_list(F.struct("at", "low", "high"))).alias("of"), *edges)
    tops = large.groupBy(*SERIES).agg(F.array_sort(F.collect_list(F.struct(F.col("group").alias("at"), "low", "high"))).alias("tops"))
    groups = blocks.join(tops, SERIES).select(*key, "top", "bottom", F.explode(F.array_compact(F.array(wide, first("tops", wide)))).alias("group"))
    spots = groups.join(large.select(*SERIES, "group", "of"), [*SERIES, "group"]).select(*key, "top", "bottom", first("of", near).alias("at")).where("at is not null")
    spots = spots.unionByName(blocks.select(*key, "top", "bottom", near.alias("at")))
    b = bars.select(*SERIES, F.floor(F.col("pos") / bucket).alias("at"), F.col("pos").alias("_p"), "low", "high")
    hit = spots.join(b, [*SERIES, "at"]).where((F.col("_p") > F.col("x")) & F.coalesce(past({"low": F.col("low"), "high": F.col("high")}), F.lit(False)))
    return blocks.join(hit.groupBy(*key).agg(F.min("_p").alias("mitigated")), key, "left")


def latest(items: DataFrame, order: str, most: int) -> DataFrame:
    w = Window.partitionBy(*SERIES).orderBy(F.desc(order), "side")
    return items.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def live_order_blocks(bars: DataFrame, scope: str) -> DataFrame:
    return latest(live(order_blocks(bars, scope), bars, "x"), "break_pos", KEEP_BLOCKS)


def live_gaps(bars: DataFrame) -> DataFrame:
    return latest(live(fair_gaps(bars), bars, "x"), "x", KEEP_GAPS)


def _last_levels(bars: DataFrame) -> DataFrame:
    """Last swing high and low with their bars; a side without one has the series' extreme and bar 0."""
    at = F.when(F.col("kind") == "high", F.col("confirmed")), F.when(F.col("kind") == "low", F.col("confirmed"))
    p = pivots(bars).groupBy(*SERIES).agg(F.max_by(F.struct("price", "pos"), at[0]).alias("h"), F.max_by(F.struct("price", "pos"), at[1]).alias("l"))
    e = prepared(bars).groupBy(*SERIES).agg(F.max("high").alias("mh"), F.min("low").alias("ml"))
    return e.join(p, SERIES, "left").select(*SERIES, F.coalesce("h.price", "mh").alias("top"), F.coalesce("l.price", "ml").alias("bottom"), F.coalesce("h.pos", F.lit(0)).cast("long").alias("top_bar"), F.coalesce("l.pos", F.lit(0)).cast("long").alias("bottom_bar"))


def premium_discount(bars: DataFrame) -> DataFrame:
    """Premium (from premium_low to top), equilibrium and discount (from bottom to discount_high)."""
    top, bottom = F.col("top"), F.col("bottom")
    return _last_levels(bars).select(*SERIES, "top", "bottom", ((top + bottom) / 2).alias("equilibrium"), (0.95 * top + 0.05 * bottom).alias("premium_low"), (0.95 * bottom + 0.05 * top).alias("discount_high"))


def summary(bars: DataFrame) -> DataFrame:
    """Bias of the last break in the swing scope, and the strong and weak levels with their bars."""
    order = F.struct("pos", F.when(F.col("side") == "bull", 0).otherwise(1).alias("o"))
    last = breaks(bars, "swing").groupBy(*SERIES).agg(F.max_by("side", order).alias("side"))
    return _last_levels(bars).join(last, SERIES, "left").select(*SERIES, F.coalesce("side", F.lit("neutral")).alias("bias"), "top", "top_bar", "bottom", "bottom_bar")


def window_items(items: DataFrame, bars: DataFrame, n: int, context: int = 200, columns: tuple[str, ...] = ("x",), keep: bool = False) -> DataFrame:
    """Items of the chart's last n bars: positions count from its first bar.

    items were computed on the last n + context bars; those wholly before the window go, those partly
    before it start at 0; with keep none goes.  Series below 30 bars show nothing."""
    size = bars.groupBy(*SERIES).agg(F.count("*").alias("_n")).where("_n >= 30")
    shift = F.greatest(F.least(F.col("_n"), F.lit(n + context)) - n, F.lit(0))
    out = items.join(size, SERIES).withColumns({c: F.col(c) - shift for c in columns})
    out = out if keep else out.where(F.greatest(*(F.col(c) for c in columns), F.lit(-(1 << 40))) >= 0)
    return out.withColumns({c: F.greatest(F.col(c), F.lit(0)).cast("long") for c in columns}).drop("_n")
