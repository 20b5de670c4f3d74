"""Long series over many tasks: windows with halos, and scans with carries.

Rows that have a position (pos, from sources.bars.with_pos) fall into blocks of BLOCK rows of a series.

haloed() gives each block the rows before and after it that a bounded frame reaches, so such frames are
windows over (series, block) and need one shuffle together.  Of every result only the block's own rows
stay.  Operators that add columns to a haloed frame call in_blocks(), which makes one where there is none
yet: several operators share the halo of the caller.

scanned() computes frames that reach back to a series' start, or on to its end: inside a block by a window,
and over blocks by a window over one row a block, whose results join their blocks again.  It
takes the last value that is not null, sums, counts, least and greatest values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.sources.bars import SERIES, SIZE, settled

BLOCK = 2048
HALO = "_block"  # of haloed rows; a row may be in several


def haloed(df: DataFrame, before: int, after: int = 0) -> DataFrame:
    """df's rows once for each block that reads them: _block, _j (position within it, negative before it) and _own."""
    size = max(BLOCK, 2 * (before + after))
    first, last = F.greatest(F.floor((F.col("pos") - after) / size), F.lit(0)), F.floor((F.col("pos") + before) / size)
    out = df.withColumn(HALO, F.explode(F.sequence(first, last)))
    return out.withColumns({"_j": F.col("pos") - F.col(HALO) * size, "_own": F.floor(F.col("pos") / size) == F.col(HALO)})


def in_blocks(df: DataFrame, before: int, after: int, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """f(df), where f's windows (W(), previous(), rows()) reach at most so many rows before and after each row."""
    if HALO in df.columns:
        return f(df)
    return f(haloed(df, before, after)).where("_own").drop("_own", "_j", HALO)


def W() -> Window:
    """The rows of a haloed block, in order."""
    return Window.partitionBy(*SERIES, HALO).orderBy("pos")


def rows(a: int, b: int) -> Window:
    return W().rowsBetween(a, b)


def previous(c: str, n: int = 1) -> Column:
    return F.lag(c, n).over(W())


def beside(df: DataFrame, block: str, totals: list[Column], carried: list[Column], keys: list[str] = SERIES) -> DataFrame:
    """df joined with what `carried` (windows over a series' blocks) makes of each block's totals."""
    by = df.groupBy(*keys, block).agg(*totals)
    return df.join(by.select(*keys, block, *carried), [*keys, block])


def sized(df: DataFrame, name: str = "_n") -> DataFrame:
    """A haloed frame with the number of rows of each series, which with_pos may have left in SIZE."""
    if SIZE in df.columns:
        return df.withColumn(name, F.col(SIZE))
    return beside(df, HALO, [F.count_if("_own").alias("_c")], [F.sum("_c").over(Window.partitionBy(*SERIES)).alias(name)])


def ranged(df: DataFrame, column: str, low: str, high: str) -> DataFrame:
    """A haloed frame with the least and greatest value of each series."""
    whole = Window.partitionBy(*SERIES)
    return beside(df, HALO, [F.min(column).alias("_a"), F.max(column).alias("_b")], [F.min("_a").over(whole).alias(low), F.max("_b").over(whole).alias(high)])


_OVER = {"last": lambda v: F.last(v, True), "min": F.min, "max": F.max, "sum": F.sum, "count": F.count, "peak": F.sum}
_BOTH = {
    "last": lambda own, carry: F.coalesce(own, carry),
    "min": F.least,
    "max": F.greatest,
    "sum": lambda own, carry: F.coalesce(own + carry, own, carry),
    "count": lambda own, carry: own + F.coalesce(carry, F.lit(0)),
}


def scanned(df: DataFrame, columns: dict[str, tuple[str, Column | str, bool]], later: dict[str, tuple[str, Column | str, bool]] | None = None, order: tuple[str, ...] = ("pos",), keys: list[str] = SERIES) -> DataFrame:
    """df with a column for each name: (what, value, whether the row itself counts), from the series' start.

    what is last (the value nearest before that is not null), min, max, sum, count, or peak (the largest sum
    so far).  The columns of later go from the series' end back.  order names the columns that order a series; the
    first is a position.  df is read twice, so it is settled first."""
    home, base = "_scan", settled(df.withColumn("_scan", F.floor(F.col(order[0]) / BLOCK)), "scan")
    place, out = F.struct(*order), base
    totals, carried, joined = [], [], {}
    for turn, nearest, some in ((F.asc, F.max_by, columns), (F.desc, F.min_by, later or {})):
        inside = Window.partitionBy(*keys, home).orderBy(*map(turn, order))
        earlier = Window.partitionBy(*keys).orderBy(turn(home)).rowsBetween(Window.unboundedPreceding, -1)
        for name, (what, value, own) in some.items():
            value = value if isinstance(value, Column) else F.col(value)
            frame = inside.rowsBetween(Window.unboundedPreceding, 0 if own else -1)
            o, t, c, v = (f"_{k}_{name}" for k in "otcv")
            out = out.withColumn(v, value).withColumn(o, _OVER[what](v).over(frame))
            if what == "peak":
                out = out.withColumn(f"{o}_p", F.max(o).over(frame))
                totals += [F.sum(v).alias(t), F.max(f"{o}_p").alias(f"{t}_p")]
                before = F.coalesce(F.sum(t).over(earlier), F.lit(0.0))
                carried += [before.alias(c), F.col(f"{t}_p")]
                joined[name] = lambda o=o, c=c: F.greatest(F.col(f"{c}_p"), F.col(c) + F.col(f"{o}_p"))
                continue
            totals.append((nearest(v, F.when(F.col(v).isNotNull(), place)) if what == "last" else _OVER[what](v)).alias(t))
            carried.append(_OVER["sum" if what == "count" else what](t).over(earlier).alias(c))
            joined[name] = lambda o=o, c=c, what=what: _BOTH[what](F.col(o), F.col(c))
    by = out.groupBy(*keys, home).agg(*totals).select(*keys, home, *carried)
    for turn, some in ((F.asc, columns), (F.desc, later or {})):
        earlier = Window.partitionBy(*keys).orderBy(turn(home)).rowsBetween(Window.unboundedPreceding, -1)
        for name, (what, _, _) in some.items():
            if what == "peak":  # the largest sum of earlier blocks: what came before each, and its own peak
                by = by.withColumn(f"_c_{name}_p", F.max(F.col(f"_c_{name}") + F.col(f"_t_{name}_p")).over(earlier)).drop(f"_t_{name}_p")
    out = out.join(by, [*keys, home])
    return out.select(*(c for c in df.columns if c not in joined), *(f().alias(name) for name, f in joined.items()))
