"""Input views over the driver's tables: quotes, moving points, throughput samples and tuner tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.positions import with_position

#: Timestamps of quotes are floored to five minutes, so that equal ones follow each other.
FLOOR_MS = 300_000


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table, through event_columns."""
    return event_columns(spark.read.parquet(f"{sf_dir}/events.parquet"))


def event_columns(events: DataFrame) -> DataFrame:
    """event_id, event_type, user_id, value, k (from props) and ms since 1970, whatever the session's time zone."""
    ts = F.col("ts").cast("timestamp_ntz")
    days = F.date_diff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    ms = seconds * 1000 + F.floor(F.expr("extract(second from cast(ts as timestamp_ntz))") * 1000).cast("long")
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select("event_id", "event_type", "user_id", "value", k.alias("k"), ms.alias("ms"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bid and ask quotes: five keys, zero sizes, runs of equal timestamps. Position by arrival within each key."""
    return with_position(quote_columns(events(spark, sf_dir)), "type", "id", previous=["original_timestamp"])


def quote_columns(events: DataFrame) -> DataFrame:
    """Quotes of events, without positions."""
    k = F.col("k")
    return events.select(
        F.col("event_type").alias("type"),
        F.col("event_id").alias("id"),
        (F.lit(100.0) + F.col("value")).alias("bid_price"),
        (F.lit(99.0) + F.col("value")).alias("ask_price"),
        (k % 20).alias("bid_size"),
        F.when(k % 2 == 0, F.lit(0)).otherwise(k).alias("ask_size"),
        F.expr(f"(ms div {FLOOR_MS}) * {FLOOR_MS}").alias("original_timestamp"),
        F.col("ms").alias("timestamp"),
    )

def points(spark: SparkSession, sf_dir: str, duplicates: bool = False) -> DataFrame:
    """Moving points of one un-keyed stream. Coordinates are whole numbers, so that means are exact to the last
    bit in any order. duplicates: a coarse grid, on which seeds coincide and clusters run empty."""
    e = events(spark, sf_dir)
    x = F.floor(F.col("value") / 100) if duplicates else F.round(F.col("value") * 100)
    y = F.floor(F.col("k") / 50) if duplicates else F.col("k")
    return e.select(F.lit(0).alias("key"), F.col("event_id").alias("id"), F.col("user_id").alias("sid"), (F.col("ms") * 1000.0).alias("timestamp_usec"), x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(0.0).alias("z"), F.lit(-1).alias("centroid_id"))


def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per key and day."""
    e = events(spark, sf_dir)
    return e.groupBy(F.col("event_type").alias("type"), F.expr("ms div 86400000").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def model_throughput(nw: Column, batch: Column) -> Column:
    return nw * batch / (F.lit(1.0) + batch / F.lit(1000.0))


def configs(spark: SparkSession) -> DataFrame:
    """Tuner grid with two throughput measurements of each configuration."""
    from ..operators.tuner import config_grid

    thr = model_throughput(F.col("nw"), F.col("batch"))
    noise = F.lit(1.0) + ((F.col("nw") * 7 + F.col("batch")) % 11 - 5) / F.lit(100.0)
    return config_grid(spark).withColumn("thr", thr).withColumn("thr2", F.col("thr") * noise)


def runs(spark: SparkSession) -> DataFrame:
    """Benchmark runs: device x window x slide x configuration, results per second."""
    each = lambda *v: F.explode(F.array(*[F.lit(x) for x in v]))
    grid = spark.range(0, 1, 1, 1).select(each("cpu", "gpu").alias("device"))
    for name, values in (("w", (10000, 25000, 50000)), ("s", (5, 25, 100)), ("run", (1, 2, 3)), ("nw", (8, 9, 10, 11))):
        grid = grid.withColumn(name, each(*values))
    grid = grid.withColumn("factor", F.when(F.col("device") == "cpu", 1.0).otherwise(7.3))
    rate = F.col("factor") * 1000000.0 / F.col("w") * (1 + (F.col("run") * 5 + F.col("nw") * 3 + F.col("s")) % 7 / 10.0)
    return grid.select("device", "w", "s", "run", "nw", rate.alias("results_per_sec"))
