"""Quadratic fit of a window's prices, one side at a time.

With raw sums over the points (x, y): a and b are the least-squares fit of y = a x^2 + b x through the origin, and c
is the mean of what they leave. This is not the usual three-parameter regression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import ratio


def sums(side: str, x: Column, y: Column, kept: Column) -> list[Column]:
    """The eight sums of a side over the rows that are kept, as aggregates."""
    terms = {"n": F.lit(1.0), "x": x, "xx": x * x, "xxx": x * x * x, "xxxx": x * x * x * x, "y": y, "xy": x * y, "xxy": x * x * y}
    return [F.sum(F.when(kept, v).otherwise(F.lit(0.0))).alias(f"{side}_{k}") for k, v in terms.items()]


def coefficients(side: str, x_unit: float = 1.0, y_unit: float = 1.0) -> list[Column]:
    """p0, p1, p2 of a side from its sums, with x in units of x_unit and y of y_unit."""
    n, x, xx, xxx, xxxx, y, xy, xxy = (F.col(f"{side}_{k}") for k in ("n", "x", "xx", "xxx", "xxxx", "y", "xy", "xxy"))
    below = xx * xxxx - xxx * xxx
    a, b = ratio(xxy * xx - xy * xxx, below), ratio(xy * xxxx - xxy * xxx, below)
    c = ratio(y, n) - b * ratio(x, n) - a * ratio(xx, n)
    out = {"p0": c * y_unit, "p1": b * (y_unit / x_unit), "p2": a * (y_unit / x_unit / x_unit)}
    return [v.alias(f"{p}_{side}") for p, v in out.items()]
