"""Offline analysis of benchmark runs and tuner tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def heatmap_rate(configs: DataFrame, batches: list[int], slide: int) -> DataFrame:
    """Workers x batch matrix of the input rate: throughput x slide."""
    cells = configs.groupBy("nw").pivot("batch", batches).agg(F.first(F.col("thr") * slide))
    return cells.select("nw", *[F.col(str(b)).alias(f"b{b}") for b in batches])


def relative_errors(configs: DataFrame) -> DataFrame:
    """|t1 - t2|, cut to a whole number, over t1, of two measurements joined on the configuration."""
    one = configs.select("nw", "batch", F.col("thr").alias("t1"))
    two = configs.select("nw", "batch", F.col("thr2").alias("t2"))
    return one.join(two, ["nw", "batch"]).select("nw", "batch", (F.abs((F.col("t1") - F.col("t2")).cast("int")) / F.col("t1")).alias("error"))


def heatmap_error(errors: DataFrame, batches: list[int]) -> DataFrame:
    cells = errors.groupBy("nw").pivot("batch", batches).agg(F.first("error"))
    return cells.select("nw", *[F.col(str(b)).alias(f"b{b}") for b in batches])


def error_summary(errors: DataFrame) -> DataFrame:
    """Average, and the extremes as far as they lie below 1 and above 0."""
    return errors.agg(F.avg("error").alias("avg_error"), F.least(F.min("error"), F.lit(1.0)).alias("min_error"), F.greatest(F.max("error"), F.lit(0.0)).alias("max_error"))


def run_average(runs: DataFrame) -> DataFrame:
    value = F.col("results_per_sec")
    return runs.groupBy("device", "w", "s", "nw").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))


def input_rate(runs: DataFrame) -> DataFrame:
    return runs.select("device", "w", "s", "nw", "run", (F.col("results_per_sec") * F.col("s")).alias("tuples_per_sec"))


def max_rate(runs: DataFrame) -> DataFrame:
    """Highest mean input rate over the configurations, both devices side by side."""
    best = run_average(runs).groupBy("w", "s").agg(*[F.max(F.when(F.col("device") == d, F.col("mean") * F.col("s"))).alias(f"max_{d}") for d in ("cpu", "gpu")])
    return best.select("w", "s", "max_cpu", "max_gpu")


def speedup_table(runs: DataFrame, windows: list[int]) -> DataFrame:
    """Rows by slide, columns by window: gpu over cpu, cut to two decimals."""
    ratio = F.floor(F.col("max_gpu") / F.col("max_cpu") * 100) / 100
    cells = max_rate(runs).groupBy("s").pivot("w", windows).agg(F.first(ratio))
    return cells.select("s", *[F.col(str(w)).alias(f"w{w}") for w in windows])
