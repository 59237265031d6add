"""Positions: the 0-based arrival counter of each key, on which count windows are defined."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of a bucket of the order column: a key's rows are numbered bucket by bucket, in parallel.
STRIDE = 1 << 20


def with_position(df: DataFrame, key: str, order: str, previous: Sequence[str] = (), stride: int = STRIDE, name: str = "pos") -> DataFrame:
    """df with `pos`, the number of rows of the same key that come before by `order` (a whole number, unique
    within a key), and `prev_<c>` for each column c of `previous`: its value in the row before, null in the first.
    A row without a value of `order` comes before its key's others.

    A key's rows are not numbered in one task: rows are cut into buckets of `stride` values of the order column,
    numbered within (key, bucket), and shifted by the counts of the buckets before. Those counts are one row per
    (key, bucket), and Catalyst broadcasts them if they are measured small. A hot key is spread over its buckets.
    """
    bucket = F.expr(f"cast(floor(`{order}` / {stride}) as bigint)")
    df = df.withColumn("_bucket", bucket)
    last = [F.max_by(F.col(c), F.col(order)).alias(f"_last_{c}") for c in previous]
    counts = df.groupBy(F.col(key).alias("_key"), F.col("_bucket").alias("_b")).agg(F.count(F.lit(1)).alias("_n"), *last)
    run = Window.partitionBy("_key").orderBy("_b")
    shift = F.coalesce(F.sum("_n").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_key", "_b", shift.alias("_shift"), *[F.lag(f"_last_{c}").over(run).alias(f"_last_{c}") for c in previous])
    rows = Window.partitionBy(key, "_bucket").orderBy(order)
    df = df.withColumn("_row", F.row_number().over(rows))
    for c in previous:
        df = df.withColumn(f"prev_{c}", F.lag(c).over(rows))
    df = df.join(counts, F.col(key).eqNullSafe(F.col("_key")) & F.col("_bucket").eqNullSafe(F.col("_b")))
    for c in previous:
        df = df.withColumn(f"prev_{c}", F.when(F.col("_row") == 1, F.col(f"_last_{c}")).otherwise(F.col(f"prev_{c}")))
    df = df.withColumn(name, F.col("_row") - 1 + F.col("_shift"))
    return df.drop("_bucket", "_row", "_key", "_b", "_shift", *[f"_last_{c}" for c in previous])
