"""64-byte binary sensor records, as a file source and as bytes in a column."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Little-endian: two int32, a float64, eleven int32, four bytes of padding. (fixed values)
RECORD = "<iid11i4x"
INTS = ("x", "y", "z", "v", "a", "vx", "vy", "vz", "ax", "ay", "az")
SIZE = 64


def _int32(record: Column, at: int) -> Column:
    """Four little-endian bytes as a signed number, by column functions."""
    parts = [F.conv(F.hex(F.substring(record, at + k + 1, 1)), 16, 10).cast("long") * (1 << (8 * k)) for k in range(4)]
    total = parts[0] + parts[1] + parts[2] + parts[3]
    return F.when(total >= 1 << 31, total - (1 << 32)).otherwise(total).cast("int")


def _float64(record: Column, at: int) -> Column:
    """Eight little-endian bytes as a finite IEEE double: sign, exponent and fraction put together."""
    byte = [F.conv(F.hex(F.substring(record, at + k + 1, 1)), 16, 10).cast("long") for k in range(8)]
    high = byte[7] * 256 + byte[6]
    exponent = (high % 32768 - high % 16) / 16
    fraction = (high % 16).cast("double") * 2.0**48 + sum((byte[k].cast("double") * 2.0 ** (8 * k) for k in range(5, -1, -1)), F.lit(0.0))
    sign = F.when(high >= 32768, -1.0).otherwise(1.0)
    normal = (F.lit(1.0) + fraction / 2.0**52) * F.pow(F.lit(2.0), exponent - 1023)
    return sign * F.when(exponent == 0, fraction / 2.0**52 * 2.0**-1022).otherwise(normal)


def unpack(records: DataFrame, column: str = "record") -> DataFrame:
    """id, sid, timestamp_usec and the eleven whole numbers of each record."""
    r = F.col(column)
    ints = [_int32(r, 16 + 4 * k).alias(n) for k, n in enumerate(INTS)]
    return records.select(_int32(r, 0).alias("id"), _int32(r, 4).alias("sid"), _float64(r, 8).alias("timestamp_usec"), *ints)


def read(spark: SparkSession, path: str, most: int | None = None, speedup: float = 1.0) -> DataFrame:
    """Records of a file or folder, in parallel: the file is split at record boundaries. speedup divides the
    timestamps. A last, incomplete record is an error of the file, as in any fixed-length format."""
    # binaryRecords is the one reader of Spark that splits fixed-length records; rows become a DataFrame at once.
    raw = spark.sparkContext.binaryRecords(path, SIZE).map(lambda b: (bytes(b),))
    df = unpack(spark.createDataFrame(raw, "record binary"))
    if most is not None:
        df = df.where(F.col("id") < most)
    return accelerate(df, speedup)


def pack(points: DataFrame) -> DataFrame:
    """The record of each row, for tests and exports: id, sid, timestamp_usec and the eleven whole numbers."""
    names = ["id", "sid", "timestamp_usec", *INTS]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([struct.pack(RECORD, *r.values()) for r in b.to_pylist()], pa.binary())], names=["record"])

    return points.select(*names).mapInArrow(run, "record binary")


def accelerate(df: DataFrame, factor: float, ts_col: str = "timestamp_usec") -> DataFrame:
    return df.withColumn(ts_col, F.col(ts_col) / F.lit(float(factor)))


def theoretical_rate(df: DataFrame, ts_col: str = "timestamp_usec") -> DataFrame:
    span = (F.max(ts_col) - F.min(ts_col)) / F.lit(1e6)
    return df.agg((F.count(F.lit(1)) / F.when(span > 0, span)).alias("rate"))
