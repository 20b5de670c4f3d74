"""Rows of which each must come a gap after the last one taken, over many tasks.

What a block of SPAN positions takes depends on what came before only through the positions it still has to wait,
0 to gap - 1.  So each block is worked out for every wait, as an array of the waits it leaves; a group of SPAN blocks
composes those of its blocks, and a series folds over its groups.  The waits found go back down to groups, blocks and
rows.  No array is longer than SPAN, but for one entry a group of a series (of 262144 positions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.sources.bars import settled

SPAN = 512


def _waits(parts: Column, start: Column, gap: int, begin: Column) -> Column:
    """Array of (at, wait) for each of a group's parts (at, leaves), when its first position is reached with wait `begin`."""
    empty = F.struct(start.alias("next"), begin.alias("wait"), F.expr("cast(array() as array<struct<at:bigint,wait:bigint>>)").alias("out"))

    def step(s: Column, part: Column) -> Column:
        wait = F.when(part["at"] == s["next"], s["wait"]).otherwise(F.lit(0).cast("long"))
        leaves = F.element_at(part["leaves"], (wait + 1).cast("int"))
        return F.struct((part["at"] + 1).alias("next"), leaves.alias("wait"), F.concat(s["out"], F.array(F.struct(part["at"].alias("at"), wait.alias("wait")))).alias("out"))

    return F.aggregate(parts, empty, step, lambda s: s["out"])


def _leaves(parts: Column, start: Column, end: Column, gap: int) -> Column:
    """What a group leaves for each wait: the leaves of its parts composed."""
    none = F.array_repeat(F.lit(0).cast("long"), gap)

    def step(s: Column, part: Column) -> Column:
        waits = F.when(part["at"] == s["next"], s["waits"]).otherwise(none)
        return F.struct((part["at"] + 1).alias("next"), F.transform(waits, lambda w: F.element_at(part["leaves"], (w + 1).cast("int"))).alias("waits"))

    begin = F.struct(start.alias("next"), F.sequence(F.lit(0).cast("long"), F.lit(gap - 1).cast("long")).alias("waits"))
    return F.aggregate(parts, begin, step, lambda s: F.when(s["next"] == end, s["waits"]).otherwise(none))


def spaced(rows: DataFrame, keys: list[str], at: str, gap: int) -> DataFrame:
    """The rows taken one after the other in order of the integer column `at`, each at least gap after the last taken.

    Of rows at one place the least by their other columns counts.  Rows without a place or with a null key are left out; keys whose
    rows are far apart, or empty tables, need nothing special."""
    gap, rest = max(1, gap), [c for c in rows.columns if c not in (*keys, at)]
    size = max(SPAN, gap)
    placed = rows.where(F.col(at).isNotNull()).withColumn(at, F.col(at).cast("long")).withColumn("_b", F.floor(F.col(at) / size))
    by = placed.groupBy(*keys, "_b").agg(F.array_sort(F.collect_list(F.struct(at, *rest))).alias("_all"))
    start = F.col("_b") * size
    free = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(gap - 1).cast("long")), lambda w: start + w)
    leaves = F.aggregate(
        F.transform("_all", lambda x: x[at]),
        free,
        lambda s, x: F.transform(s, lambda a: F.when(x >= a, x + gap).otherwise(a)),
        lambda s: F.transform(s, lambda a: F.greatest(a - start - size, F.lit(0).cast("long"))),
    )
    blocks = settled(by.withColumn("_leaves", leaves), "spaced")  # read twice: on the way up and down
    part = lambda c: F.array_sort(F.collect_list(F.struct(F.col(c).alias("at"), F.col("_leaves").alias("leaves")))).alias("_parts")
    groups = blocks.select(*keys, "_b", "_leaves", F.floor(F.col("_b") / SPAN).alias("_g")).groupBy(*keys, "_g").agg(part("_b"))
    ends = groups.select(*keys, "_g", _leaves(F.col("_parts"), F.col("_g") * SPAN, (F.col("_g") + 1) * SPAN, gap).alias("_leaves"))
    tops = ends.groupBy(*keys).agg(part("_g"))
    down = lambda df, c, begin: df.select(*keys, F.explode(_waits(F.col("_parts"), begin[0], gap, begin[1])).alias("_w")).select(*keys, F.col("_w.at").alias(c), F.col("_w.wait").alias("_wait"))
    zero = F.lit(0).cast("long")
    of_groups = down(tops, "_g", (F.col("_parts")[0]["at"], zero))
    of_blocks = down(groups.join(of_groups, [*keys, "_g"]), "_b", (F.col("_g") * SPAN, F.col("_wait")))

    def take(s: Column, x: Column) -> Column:
        hit = x[at] >= s["free"]
        return F.struct(F.when(hit, x[at] + gap).otherwise(s["free"]).alias("free"), F.when(hit, F.concat(s["out"], F.array(x))).otherwise(s["out"]).alias("out"))

    none = F.struct((start + F.col("_wait")).alias("free"), F.slice("_all", 1, 0).alias("out"))
    taken = F.aggregate("_all", none, take, lambda s: s["out"])
    found = blocks.join(of_blocks, [*keys, "_b"]).select(*keys, F.explode(taken).alias("_x"))
    return found.select(*(F.col(c) if c in keys else F.col("_x")[c].alias(c) for c in rows.columns))
