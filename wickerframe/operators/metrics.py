"""Stream metrics: rates, latencies, and whether a throughput is stable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Samples in the moving windows, and the coefficients of variation up to which they count as stable.
SAMPLES, STABLE_CV, STABLE_CV2 = 3, 0.05, 0.15


def rate(df: DataFrame, ts_ms: Column, width_ms: int) -> DataFrame:
    """Rows per interval: bucket, n."""
    return df.groupBy(F.floor(ts_ms / F.lit(width_ms)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def running_average(df: DataFrame, key: str, bucket: str, value: str) -> DataFrame:
    """value and its average so far, by key; zero samples do not count."""
    w = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("running_avg", F.avg(F.when(F.col(value) != 0, F.col(value))).over(w))


def variation(df: DataFrame, key: str, bucket: str, value: str, samples: int = SAMPLES) -> DataFrame:
    """Mean and coefficient of variation of the last `samples` values, null until there are so many."""
    w = Window.partitionBy(key).orderBy(bucket).rowsBetween(-(samples - 1), 0)
    full = F.count(value).over(w) == samples
    return df.withColumn("mean", F.when(full, F.avg(value).over(w))).withColumn("cv", F.when(full, F.stddev_samp(value).over(w) / F.avg(value).over(w)))


def stable(df: DataFrame, key: str, bucket: str, value: str) -> DataFrame:
    """Samples at which the last three vary by 5% at most, with their mean."""
    return variation(df, key, bucket, value).where(F.col("cv") <= STABLE_CV)


def stable_cv2(df: DataFrame, key: str, bucket: str, value: str) -> DataFrame:
    """Samples that are not stable, but whose last three coefficients of variation vary by 15% at most."""
    v = variation(df, key, bucket, value).where(F.col("cv").isNotNull())
    return variation(v.withColumnRenamed("mean", "thr_mean").withColumnRenamed("cv", "thr_cv"), key, bucket, "thr_cv").where((F.col("thr_cv") > STABLE_CV) & (F.col("cv") <= STABLE_CV2)).select(key, bucket, value, "thr_mean", "thr_cv", F.col("cv").alias("cv_of_cvs"))


def latency_per_interval(df: DataFrame, key: str, latency: Column, ts_ms: Column, width_ms: int) -> DataFrame:
    return df.groupBy(key, F.floor(ts_ms / F.lit(width_ms)).alias("bucket")).agg(F.count(F.lit(1)).alias("results"), F.avg(latency).alias("avg_latency"))


def overall_latency(per_interval: DataFrame, key: str) -> DataFrame:
    """Both notions of the average: the mean of interval means, and the total over all results."""
    total = F.sum(F.col("avg_latency") * F.col("results")) / F.sum("results")
    return per_interval.groupBy(key).agg(F.avg("avg_latency").alias("mean_of_means"), total.alias("mean_of_results"), F.sum("results").alias("results"))


def results_per_second(df: DataFrame, key: str, ts_ms: str) -> DataFrame:
    span = (F.max(ts_ms) - F.min(ts_ms)) / F.lit(1000.0)
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("results"), (F.count(F.lit(1)) / F.when(span > 0, span)).alias("results_per_sec"))
