"""Daily volume profiles: bins, point of control and value area."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 100
AREA = 0.70
DAY = ["symbol", "timeframe", "day"]


def bins(bars: DataFrame, n: int = BINS) -> DataFrame:
    """(symbol, timeframe, day, bin, center, volume): a bar's volume is split evenly over the bins whose centre it spans.

    Days with fewer than three bars, without a range or without volume have no bins."""
    df = bars.withColumn("day", F.col("ts").cast("date"))
    days = df.groupBy(*DAY).agg(F.min("low").alias("lo"), F.max("high").alias("hi"), F.count("*").alias("n")).where("n >= 3 and hi > lo").drop("n")
    step = (F.col("hi") - F.col("lo")) / n
    edge = lambda k: F.col("lo") + k * step
    center = (edge(F.col("bin")) + edge(F.col("bin") + 1)) / 2
    grid = days.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("center", center)
    centers = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(k.alias("bin"), ((edge(k) + edge(k + 1)) / 2).alias("c")))
    hit = df.where("high > low and volume > 0").join(days, DAY).withColumn("in", F.filter(centers, lambda c: (c["c"] >= F.col("low")) & (c["c"] <= F.col("high"))))
    part = hit.where(F.size("in") > 0).select(*DAY, "ts", F.explode("in.bin").alias("bin"), (F.col("volume") / F.size("in")).alias("v"))
    # parts are added in the bars' order: bins of the same bars then have the same volume to the last bit
    parts = F.array_sort(F.collect_list(F.struct("ts", "v")))["v"]
    volume = part.groupBy(*DAY, "bin").agg(parts.alias("parts")).withColumn("volume", F.aggregate("parts", F.lit(0.0), lambda a, x: a + x)).drop("parts")
    with_volume = volume.select(*DAY).distinct()
    return grid.join(volume, [*DAY, "bin"], "left").join(with_volume, DAY, "left_semi").select(*DAY, "bin", "center", F.coalesce("volume", F.lit(0.0)).alias("volume"))


def profile(bars: DataFrame, n: int = BINS, area: float = AREA) -> DataFrame:
    """(poc_price, va_low, va_high) per day: from the fullest bin outwards until the area holds its share."""
    by = bins(bars, n).groupBy(*DAY).agg(F.array_sort(F.collect_list(F.struct("bin", "center", "volume"))).alias("b"))
    df = by.select(*DAY, F.col("b.volume").alias("v"), F.col("b.center").alias("c"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    df = df.withColumns({"total": total, "poc": (F.array_position("v", F.array_max("v")) - 1).cast("int")})
    v = lambda i: F.coalesce(F.get("v", i), F.lit(-1.0))

    def step(s, _):
        down, up = F.when(s["lo"] > 0, v(s["lo"] - 1)).otherwise(-1.0), v(s["hi"] + 1)
        stop = (s["acc"] >= F.col("total") * area) | ((down < 0) & (up < 0))
        rise = F.struct(s["lo"].alias("lo"), (s["hi"] + 1).alias("hi"), (s["acc"] + up).alias("acc"))
        fall = F.struct((s["lo"] - 1).alias("lo"), s["hi"].alias("hi"), (s["acc"] + down).alias("acc"))
        return F.when(stop, s).when(up >= down, rise).otherwise(fall)

    start = F.struct(F.col("poc").alias("lo"), F.col("poc").alias("hi"), F.get("v", F.col("poc")).alias("acc"))
    df = df.withColumn("s", F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), start, step))
    return df.select(*DAY, F.get("c", F.col("poc")).alias("poc_price"), F.get("c", F.col("s.lo")).alias("va_low"), F.get("c", F.col("s.hi")).alias("va_high"))
