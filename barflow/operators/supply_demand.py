"""Supply and demand zones from volume spikes, their cooldown, mitigation and merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barflow.functions.blocks import in_blocks, previous, scanned, sized
from barflow.functions.spaced import spaced
from barflow.operators.indicators import with_true_range
from barflow.sources.bars import SERIES

LEAST_BARS = 200
COOLDOWN = 15
LOOKBACK = 5
LATEST = 5


def with_spike(bars: DataFrame) -> DataFrame:
    """spike: the bar before traded more than the mean of all bars up to it."""
    df = in_blocks(bars, 1, 0, lambda df: df.withColumn("_volume", previous("volume")))
    df = scanned(df, {"_sum": ("sum", "volume", False), "_count": ("count", "volume", False)})
    mean = F.col("_sum") / F.nullif("_count", F.lit(0))
    return df.withColumn("spike", F.coalesce((mean > 0) & (F.col("_volume") > mean), F.lit(False))).drop("_volume", "_sum", "_count")


def _found(bars: DataFrame) -> DataFrame:
    """Candidates with the greatest and least later close (hi, lo): one pass over a series for both sides."""

    def back(df: DataFrame) -> DataFrame:
        df = with_true_range(sized(df).where(F.col("_n") >= LEAST_BARS), long="_long").withColumn("wide", 2 * F.col("_long"))
        df = df.withColumns({"bear": F.col("close") < F.col("open"), "bull": F.col("close") > F.col("open")})
        return df.withColumns({f"{c}{k}": previous(c, k) if k else F.col(c) for c in ("bear", "bull", "low", "high", "volume") for k in range(LOOKBACK + 1)})

    df = in_blocks(bars, LEAST_BARS, 0, back)
    df = scanned(df, {"_sum": ("sum", "volume", False), "_count": ("count", "volume", False)}, {"hi": ("max", "close", False), "lo": ("min", "close", False)})
    mean = F.col("_sum") / F.nullif("_count", F.lit(0))
    df = df.withColumn("spike", F.coalesce((mean > 0) & (F.col("volume1") > mean), F.lit(False)))
    sides = []
    for kind, mine, other, edge in (("supply", "bear", "bull", "low"), ("demand", "bull", "bear", "high")):
        back = F.coalesce(*(F.when(F.col(f"{other}{k}"), k) for k in range(LOOKBACK + 1)))
        sign = -1 if kind == "supply" else 1
        delta, price = F.lit(0.0), F.get(F.array(*(F.col(f"{edge}{k}") for k in range(LOOKBACK + 1))), back)
        for k in range(LOOKBACK):
            delta = delta + F.when(back > k, F.when(F.col(f"{mine}{k}"), sign * F.col(f"volume{k}")).otherwise(-sign * F.col(f"volume{k}"))).otherwise(0.0)
        top, bottom = (price + F.col("wide"), price) if kind == "supply" else (price, price - F.col("wide"))
        zone = F.struct(F.lit(kind).alias("kind"), (F.col("pos") - back).alias("x1"), F.col("pos").alias("x2"), top.alias("top"), bottom.alias("bottom"), delta.alias("delta"), "hi", "lo")
        sides.append(F.when(F.col(f"{mine}0") & F.col(f"{mine}1") & F.col(f"{mine}2") & F.col("spike") & back.isNotNull(), zone))
    return df.select(*SERIES, F.explode(F.array_compact(F.array(*sides))).alias("z")).select(*SERIES, "z.*")


def candidates(bars: DataFrame) -> DataFrame:
    """(kind, x1, x2, top, bottom, delta): three bars one way after a spike, and the bar of the other way they come from."""
    return _found(bars).drop("hi", "lo")


def cooled(found: DataFrame, cooldown: int = COOLDOWN) -> DataFrame:
    """The candidates that come at least cooldown - 1 bars after the last accepted one of their side."""
    return spaced(found, [*SERIES, "kind"], "x2", cooldown - 1)


def standing(found: DataFrame) -> DataFrame:
    """Of zones with their later closes (hi, lo) those that none has gone through, less those within a stronger one of their side.

    Zones meet by price cells as wide as the widest zone, so each lies in two cells at most."""
    w = Window.partitionBy(*SERIES, "kind")
    through = F.when(F.col("kind") == "supply", F.col("hi") > F.col("top")).otherwise(F.col("lo") < F.col("bottom"))
    alive = found.where(~F.coalesce(through, F.lit(False))).drop("hi", "lo").withColumn("_wide", F.greatest(F.max(F.col("top") - F.col("bottom")).over(w), F.lit(1e-9)))
    cell = lambda c: F.floor(F.col(c) / F.col("_wide"))
    a = alive.withColumn("cell", cell("bottom")).alias("a")
    b = alive.withColumn("cell", F.explode(F.sequence(cell("bottom"), cell("top")))).alias("b")
    inside = (F.col("a.top") <= F.col("b.top")) & (F.col("a.bottom") >= F.col("b.bottom"))
    size = lambda t: F.abs(F.col(f"{t}.delta"))
    stronger = (size("b") > size("a")) | ((size("b") == size("a")) & (F.col("b.x2") < F.col("a.x2")))
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*SERIES, "kind", "cell"]]
    return a.join(b, [*same, inside & stronger], "left_anti").drop("cell", "_wide")


def supply_demand(bars: DataFrame) -> DataFrame:
    """The latest zones of each side with their share of the total strength."""
    zones = standing(cooled(_found(bars)))
    last = Window.partitionBy(*SERIES, "kind").orderBy(F.desc("x2"))
    zones = zones.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= LATEST).drop("_n")
    total = F.sum(F.abs("delta")).over(Window.partitionBy(*SERIES))
    side = F.sum(F.abs("delta")).over(Window.partitionBy(*SERIES, "kind"))
    share = F.abs("delta") / F.nullif(total, F.lit(0.0)) * 100
    return zones.withColumns({"side_total": side, "pct": F.coalesce(F.round(share, 1), F.lit(0.0))})


def order_flow(bars: DataFrame) -> DataFrame:
    """Sentiment from the strength of demand over supply, between -1 and 1."""
    z = supply_demand(bars).groupBy(*SERIES).agg(*(F.sum(F.when(F.col("kind") == k, F.abs("delta")).otherwise(0.0)).alias(k) for k in ("supply", "demand")))
    score = F.greatest(F.least((F.col("demand") - F.col("supply")) / F.nullif(F.col("demand") + F.col("supply"), F.lit(0.0)), F.lit(1.0)), F.lit(-1.0))
    z = z.withColumn("score", F.coalesce(score, F.lit(0.0)))
    return z.withColumn("sentiment", F.when(F.col("score") > 0.15, "Bullish").when(F.col("score") < -0.15, "Bearish").otherwise("Neutral"))
