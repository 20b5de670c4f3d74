"""As-of joins on timestamps: the last earlier row of another table, over many tasks.

Both tables meet in buckets of time of a key.  Inside a bucket a window carries the last value; a window over one row
a bucket carries it over buckets.  So no series, however long, is ordered in one task, and nothing is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.functions.blocks import BLOCK, scanned


def asof(left: DataFrame, right: DataFrame, keys: list[str], on: str, right_on: str, values: list[str], seq: str, bucket: str = "6 hours", within: str | None = None) -> DataFrame:
    """left with the values of the last row of right with its keys at or before its time, and that row's time as asof_ts.

    Of rows of right at one time the last by seq counts, whole: its nulls are not filled from earlier rows.  Rows of
    left stay all, repeated ones too; one that has no earlier row, a null time or a null key gets nulls.  within
    leaves out values older than so long.  bucket should hold some thousands of rows of both sides."""
    spark, clash = left.sparkSession, {*values, "asof_ts"} & set(left.columns)
    if clash:
        raise ValueError(f"left already has {sorted(clash)}")
    width = spark.sql(f"select unix_micros(timestamp_seconds(0) + interval {bucket})").first()[0]
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    last = right.where(F.col(right_on).isNotNull()).groupBy(*keys, micros(right_on).alias("_at"))
    told = last.agg(F.max_by(F.struct(F.col(right_on).alias("asof_ts"), *values), F.struct(seq)).alias("_told"))
    mine = left.withColumn("_at", micros(on)).select(*keys, "_at", F.struct(*left.columns).alias("_row"))
    placed = lambda df, side: df.withColumns({"_place": F.floor(F.col("_at") / width) * BLOCK, "_side": F.lit(side)})
    both = placed(told, 0).unionByName(placed(mine.where("_at is not null"), 1), allowMissingColumns=True)
    met = scanned(both, {"_last": ("last", "_told", True)}, order=("_place", "_at", "_side"), keys=keys).where("_side = 1")
    kept = F.col("_last")
    if within:
        kept = F.when(F.col("_last")["asof_ts"] >= F.timestamp_micros("_at") - F.expr(f"interval {within}"), kept)
    known = met.select("_row", kept.alias("_last"))
    lost = mine.where(" or ".join(["_at is null", *(f"`{k}` is null" for k in keys)])).select("_row").withColumn("_last", F.lit(None).cast(dict(known.dtypes)["_last"]))
    return known.unionByName(lost).select("_row.*", *(F.col("_last")[c].alias(c) for c in ("asof_ts", *values)))
