"""Scalar expressions shared by the window functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b by IEEE rules: dividing by zero gives NaN or an infinity, not an error or null."""
    sign = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(b == 0, sign).otherwise(a / F.when(b != 0, b))


def parabola(t: Column, p0: Column, p1: Column, p2: Column) -> Column:
    return p0 + p1 * t + p2 * t * t


def distance(x: Column, y: Column, cx: Column, cy: Column) -> Column:
    return F.sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))


def gcd_lcm(a: int, b: int) -> tuple[int, int]:
    return math.gcd(a, b), math.lcm(a, b)
