"""Exponential moving averages without a loop over rows.

In a haloed block (functions.blocks) the average is a cumulative sum of weighted values.  The halo
reaches back so far that what lies before it weighs less than a double's precision; so a long series is
spread over tasks, and a block needs nothing of the others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.functions.blocks import BLOCK, rows

FORGOTTEN = 40.0  # e-folds after which a value no longer counts
WIDEST = 690.0  # e-folds of weights that a sum of doubles holds


def span(n: int) -> float:
    return 2.0 / (n + 1)


def wilder(n: int) -> float:
    return 1.0 / n


def rate(alpha: float) -> float:
    return -math.log(1 - alpha)


def reach(*alphas: float) -> int:
    """Rows before a block that averages of these weights need, one of the other."""
    return sum(math.ceil(FORGOTTEN / rate(a)) for a in alphas)


def with_ema(df: DataFrame, averages: dict[str, tuple[Column, float]], pos: str = "pos") -> DataFrame:
    """A haloed df with a column for each name: (value, weight of the newest row).

    pos counts the rows of a series from 0; rows with a negative pos get null and must have the value 0.
    Values must not be null from pos 0 on; the first row's average is its value."""
    past = rows(Window.unboundedPreceding, 0)
    done = {}
    for name, (value, alpha) in averages.items():
        if rate(alpha) * BLOCK <= WIDEST:
            weight = F.when(F.col(pos) == 0, F.lit(1.0)).otherwise(F.lit(alpha))
            average = F.exp(-rate(alpha) * F.col("_j")) * F.sum(weight * value * F.exp(rate(alpha) * F.col("_j"))).over(past)
        else:  # weights that fall so fast that few rows count
            last = F.collect_list(F.when(F.col(pos) >= 0, value)).over(rows(1 - reach(alpha), 0))
            average = F.aggregate(F.slice(last, 2, reach(alpha)), F.get(last, F.lit(0)), lambda y, x: y + alpha * (x - y))
        done[name] = F.when(F.col(pos) >= 0, average)
    return df.withColumns(done)
