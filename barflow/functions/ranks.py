"""Exact order statistics and ranks of values between 0 and 1 without ordering a series.

Values are counted in BINS steps; a window over a series sees a row a step.  Only the values of the steps that hold
a wanted rank are then counted one by one, inside their step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barflow.sources.bars import SERIES

BINS = 1 << 16


def _step(value: str):
    return F.greatest(F.least(F.floor(F.col(value) * BINS), F.lit(BINS - 1)), F.lit(0))


def order_statistics(rows: DataFrame, value: str, targets: DataFrame) -> DataFrame:
    """(symbol, timeframe, name, found): the value of rank `rank` (from 0) for each of targets (symbol, timeframe, name, rank).

    rows is read twice.  Null values have no rank; a rank beyond the values finds nothing."""
    stepped = rows.where(F.col(value).isNotNull()).select(*SERIES, F.col(value).alias("_v"), _step(value).alias("_s"))
    steps = stepped.groupBy(*SERIES, "_s").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*SERIES).orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("_b", F.sum("_n").over(upto) - F.col("_n"))
    wanted = targets.join(steps, SERIES).where((F.col("rank") >= F.col("_b")) & (F.col("rank") < F.col("_b") + F.col("_n")))
    wanted = wanted.select(*SERIES, "name", "_s", (F.col("rank") - F.col("_b")).alias("_k"))
    near = stepped.join(wanted.select(*SERIES, "_s").distinct(), [*SERIES, "_s"], "left_semi").groupBy(*SERIES, "_s", "_v").agg(F.count("*").alias("_n"))
    inside = Window.partitionBy(*SERIES, "_s").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("_b", F.sum("_n").over(inside) - F.col("_n"))
    met = wanted.join(near, [*SERIES, "_s"]).where((F.col("_k") >= F.col("_b")) & (F.col("_k") < F.col("_b") + F.col("_n")))
    return met.select(*SERIES, "name", F.col("_v").alias("found"))


def quantiles(rows: DataFrame, value: str, qs: list[float]) -> DataFrame:
    """(symbol, timeframe, q array): the quantiles of each series, linear between the values beside them."""
    n = rows.groupBy(*SERIES).agg(F.count(value).alias("_n"))
    at = [F.lit(q) * (F.col("_n") - 1) for q in qs]
    ends = F.array(*(F.struct(F.lit(f"{i}{side}").alias("name"), end(a).cast("long").alias("rank")) for i, a in enumerate(at) for side, end in (("a", F.floor), ("b", F.ceil))))
    targets = n.where("_n > 0").select(*SERIES, F.explode(ends).alias("t")).select(*SERIES, "t.name", "t.rank")
    found = order_statistics(rows, value, targets).groupBy(*SERIES).agg(F.map_from_entries(F.collect_list(F.struct("name", "found"))).alias("_m"))
    low, high = (lambda i: F.col("_m")[f"{i}a"]), (lambda i: F.col("_m")[f"{i}b"])
    values = [low(i) + (high(i) - low(i)) * (a - F.floor(a)) for i, a in enumerate(at)]
    return found.join(n, SERIES).select(*SERIES, F.array(*values).alias("q"))


def below(rows: DataFrame, value: str, weight: str, keys: list[str] = SERIES) -> DataFrame:
    """rows (one a series and value) with below: the weight of all smaller values."""
    stepped = rows.withColumn("_s", _step(value))
    steps = stepped.groupBy(*keys, "_s").agg(F.sum(weight).alias("_w"))
    upto = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    before = steps.select(*keys, "_s", F.coalesce(F.sum("_w").over(upto), F.lit(0)).alias("_b"))
    inside = Window.partitionBy(*keys, "_s").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    own = stepped.withColumn("_i", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return own.join(before, [*keys, "_s"]).withColumn("below", F.col("_i") + F.col("_b")).drop("_s", "_i", "_b")
