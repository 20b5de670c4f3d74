"""The chart's overlays: every structure and zone of a series' last bars, placed on the bars that are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.operators import structure as G
from barflow.operators.supply_demand import supply_demand
from barflow.sources.bars import SERIES, settled, tail, with_pos

CONTEXT = 200  # bars before the shown ones, on which what starts there is found too


def overlays(bars: DataFrame, n: int = 400, context: int = CONTEXT) -> DataFrame:
    """(overlay, tag, side, x1, x2, top, bottom) of the last n bars: positions count from the first shown bar.

    Overlays wholly before it go, those partly before it start at 0; the strong and weak levels always stay."""
    win = settled(with_pos(tail(bars, n + context)), "window")  # a bounded tail of each series, read by every detector

    def item(df: DataFrame, name: str, tag: str | Column, side: str | Column, x1: str, x2: str, top: str, bottom: str) -> DataFrame:
        column = lambda c: c if isinstance(c, Column) else F.lit(c)
        return df.select(*SERIES, F.lit(name).alias("overlay"), column(tag).alias("tag"), column(side).alias("side"), F.col(x1).cast("long").alias("x1"), F.col(x2).cast("long").alias("x2"), F.col(top).alias("top"), F.col(bottom).alias("bottom"))

    parts = [
        item(G.pivots(win), "swing", F.col("label"), F.col("kind"), "pos", "pos", "price", "price"),
        item(G.live_gaps(win), "gap", "", F.col("side"), "x", "x", "top", "bottom"),
        item(G.equal_levels(win), "equal", F.col("kind"), "", "x", "x", "price", "prev_price"),
    ]
    for scope in G.SCOPES:
        parts.append(item(G.breaks(win, scope), f"break_{scope}", F.col("tag"), F.col("side"), "pivot_pos", "pos", "level", "level"))
        parts.append(item(G.live_order_blocks(win, scope), f"block_{scope}", "", F.col("side"), "x", "x", "top", "bottom"))
    parts.append(item(supply_demand(win), "zone", "", F.col("kind"), "x1", "x2", "top", "bottom"))
    shown = [G.window_items(p, win, n, context, ("x1", "x2")) for p in parts]
    levels = G.summary(win).select(*SERIES, F.explode(F.array(*(F.struct(F.lit("level").alias("overlay"), F.lit(k).alias("tag"), F.col("bias").alias("side"), F.col(f"{k}_bar").alias("x1"), F.col(f"{k}_bar").alias("x2"), F.col(k).alias("top"), F.col(k).alias("bottom")) for k in ("top", "bottom")))).alias("v")).select(*SERIES, "v.*")
    out = G.window_items(levels, win, n, context, ("x1", "x2"), keep=True)
    for p in shown:
        out = out.unionByName(p)
    return out
