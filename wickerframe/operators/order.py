"""Ordered results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .positions import STRIDE, with_position


def ordered(df: DataFrame, key: str, wid: str = "wid") -> DataFrame:
    """Results by key and window: a range-partitioned sort, for use at a sink."""
    return df.orderBy(key, wid)


def contiguous_prefix(df: DataFrame, key: str, wid: str = "wid") -> DataFrame:
    """What an ordered collector emits: a missing window holds back all later ones of its key.

    The first gap of a key is the smallest window w + 1 that is missing while w is there: one anti join on
    (key, wid), then a minimum per key. No key's results are sorted in one task.
    """
    have = df.select(F.col(key).alias("_k"), F.col(wid).alias("_w")).distinct()
    ends = have.select("_k", (F.col("_w") + 1).alias("_w")).unionByName(have.select("_k", F.lit(0).cast("long").alias("_w")).distinct())
    gap = ends.join(have, ["_k", "_w"], "left_anti").groupBy("_k").agg(F.min("_w").alias("_gap"))
    return df.join(gap, F.col(key).eqNullSafe(F.col("_k"))).where(F.col(wid) < F.col("_gap")).drop("_k", "_gap")


def order_violations(df: DataFrame, key: str, arrival: str, wid: str = "wid", stride: int = STRIDE) -> DataFrame:
    """Results that come in with another id than the one expected: rows of a key, in order of arrival (a whole number,
    unique within a key), count 0, 1, ... They are counted by with_position, so no key is numbered in one task."""
    out = with_position(df, key, arrival, stride=stride, name="expected")
    return out.withColumn("expected", F.col("expected").cast("long")).where(F.col(wid) != F.col("expected"))
