"""Generators of quotes and arrivals, as distributed column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def uniform(id_col: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on id and seed only: reruns and lost tasks give the same rows."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), id_col)), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


def exponential(u: Column, mean: float) -> Column:
    return -F.lit(mean) * F.log(u)


def erlang(us: list[Column], mean: float) -> Column:
    """Sum of len(us) exponentials of mean `mean` / len(us)."""
    product = us[0]
    for u in us[1:]:
        product = product * u
    return F.lit(-mean / len(us)) * F.log(product)


def hyperexponential(u: Column, v: Column, p: float, mean: float) -> Column:
    """Exponential of mean `mean` / (2 p) with probability p, else `mean` / (2 (1 - p))."""
    return F.when(u < p, exponential(v, mean / (2 * p))).otherwise(exponential(v, mean / (2 * (1 - p))))


def triangular(u: Column, low: float, mode: float, high: float) -> Column:
    cut = (mode - low) / (high - low)
    return F.when(u < cut, low + F.sqrt(u * (high - low) * (mode - low))).otherwise(high - F.sqrt((1 - u) * (high - low) * (high - mode)))


def normal(u: Column, v: Column, mean: float, deviation: float) -> Column:
    """By the polar form of two uniform numbers."""
    return F.lit(mean) + F.lit(deviation) * F.sqrt(-2 * F.log(u)) * F.cos(F.lit(6.283185307179586) * v)


def categorical(u: Column, probabilities: list[float]) -> Column:
    """The class whose cumulative probability is the first above u."""
    total, out = 0.0, None
    for k, p in enumerate(probabilities[:-1]):
        total += p
        out = F.when(u < total, F.lit(k)) if out is None else out.when(u < total, F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(len(probabilities) - 1))


def read_distribution(spark: SparkSession, path: str) -> DataFrame:
    """Key distributions over time from a text file: a line "classes distributions", then for each distribution a line
    of its start time and the probability of each class. Columns: at, probabilities. Other lines are skipped."""
    cells = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).select(F.transform(cells, lambda x: x.try_cast("double")).alias("c"))
    return lines.where((F.size("c") > 2) & ~F.exists("c", lambda x: x.isNull())).select(F.col("c")[0].alias("at"), F.slice("c", F.lit(2), F.size("c") - 1).alias("probabilities"))


def arrivals(spark: SparkSession, n: int, rate: float, model: str = "exponential", seed: int = 1, block: int = 1 << 16) -> DataFrame:
    """id, gap_usec and timestamp_usec of n arrivals at `rate` a second: exponential, normal (deviation a tenth) or
    fixed gaps. Timestamps are running sums taken block by block and shifted by the blocks before."""
    mean = 1e6 / rate
    u, v = uniform(F.col("id"), seed), uniform(F.col("id"), seed + 1)
    gap = {"exponential": exponential(u, mean), "normal": F.greatest(F.lit(0.0), normal(u, v, mean, mean / 10)), "fixed": F.lit(mean)}[model]
    df = spark.range(n).select("id", F.round(gap).cast("long").alias("gap_usec"), F.floor(F.col("id") / block).alias("block"))
    sums = df.groupBy("block").agg(F.sum("gap_usec").alias("total"))
    shift = F.coalesce(F.sum("total").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("block").alias("b"), shift.alias("shift"))
    inside = F.sum("gap_usec").over(Window.partitionBy("block").orderBy("id"))
    return df.withColumn("inside", inside).join(sums, F.col("block") == F.col("b")).select("id", "gap_usec", (F.col("inside") + F.col("shift")).alias("timestamp_usec"))


def quotes(spark: SparkSession, n: int, rate: float, keys: list[float], seed: int = 1) -> DataFrame:
    """n quotes: key by probability, prices U(100, 200), sizes 0 to 199, timestamps floored to milliseconds."""
    a = arrivals(spark, n, rate, seed=seed)
    u = lambda k: uniform(F.col("id"), seed + 10 + k)
    return a.select(
        "id",
        categorical(u(0), keys).alias("type"),
        (100 + 100 * u(1)).alias("bid_price"),
        F.floor(200 * u(2)).cast("int").alias("bid_size"),
        (100 + 100 * u(3)).alias("ask_price"),
        F.floor(200 * u(4)).cast("int").alias("ask_size"),
        F.expr("(timestamp_usec div 1000) * 1000").alias("original_timestamp"),
        F.col("timestamp_usec").alias("timestamp"),
    )


def replicate(df: DataFrame, times: int, id_col: str = "id", ts_col: str = "timestamp_usec") -> DataFrame:
    """df over and over: ids go on, timestamps are shifted by the span. Ids are dense from 0."""
    facts = df.agg(F.count(F.lit(1)).alias("_n"), (F.max(ts_col) - F.min(ts_col)).alias("_span"))
    out = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).join(F.broadcast(facts))  # one row
    return out.withColumn(id_col, F.col("rep") * F.col("_n") + F.col(id_col)).withColumn(ts_col, F.col(ts_col) + F.col("rep") * F.col("_span")).drop("_n", "_span")
