"""Text forms of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _two_lines(df: DataFrame, names: list[str]) -> DataFrame:
    sides = [F.struct(F.lit(n).alias("k"), F.format_string("type=%s," + side + ",%d," + ",".join(["%.3f"] * len(names)), "type", "timestamp", *[F.col(f"{x}_{side.lower()}") for x in names]).alias("line")) for n, side in enumerate(("Bid", "Ask"))]
    return df.select("type", "wid", F.explode(F.array(*sides)).alias("s")).select("type", "wid", F.col("s.line").alias("line"))


def candle_lines(results: DataFrame) -> DataFrame:
    """Two lines a window: type, side, timestamp, open, low, high, close."""
    return _two_lines(results, ["open", "low", "high", "close"])


def fitting_lines(results: DataFrame) -> DataFrame:
    """Two lines a window: type, side, timestamp, p0, p1, p2."""
    return _two_lines(results, ["p0", "p1", "p2"])


def cluster_lines(results: DataFrame) -> DataFrame:
    """Timestamp and the three centroids with one decimal (halves up), separated by tabs; a centroid without points
    is written as nan."""
    cells = ["timestamp"] + [f"c{j}_{a}" for j in range(3) for a in "xy"]
    text = [F.when(F.isnan(c), F.lit("nan")).otherwise(F.format_string("%.1f", F.floor(F.col(c) * 10 + 0.5) / 10.0)) for c in cells]
    return results.select("wid", F.concat_ws("\t", *text).alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("error").text(path)
