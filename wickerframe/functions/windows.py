"""The shipped window functions, applied to positioned quotes and points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.windows import CountWindow, assign_windows, check, fired, flink_windows
from . import ohlc, quadfit
from .kmeans import kmeans

#: x is counted in steps of five minutes while sums are taken; coefficients are given for hours.
STEP_MS, HOUR_STEPS = 300_000, 12.0
#: The columns that the fit reads; sums of whole numbers in them do not depend on the order of the rows.
PRICE_COLUMNS = {"bid": "bid_price", "ask": "ask_price"}


SIDES = ("bid", "ask")
_TERMS = ("n", "x", "xx", "xxx", "xxxx", "y", "xy", "xxy")
_PRICES = ("open", "high", "low", "close")


def quote_panes(quotes: DataFrame, g: int, skip_runs: bool = True, fit_on: dict[str, str] = PRICE_COLUMNS) -> DataFrame:
    """Partial results of every complete pane of g quotes: what fits and candlesticks of any window made of whole
    panes can be put together from. Sums are taken with x counted from the pane's first quote.

    skip_runs: of quotes with equal timestamps that follow each other, only the first feeds the fit. A window's
    first quote does in any case, so a pane's first quote that was skipped is remembered (<side>_lone).
    """
    pane = F.expr(f"pos div {g}")
    first = Window.partitionBy("type", "pane").orderBy("pos")
    rows = quotes.withColumn("pane", pane).withColumn("origin", F.first("original_timestamp").over(first))
    x = (F.col("original_timestamp") - F.col("origin")) / F.lit(float(STEP_MS))
    again = F.col("original_timestamp").eqNullSafe(F.col("prev_original_timestamp")) if skip_runs else F.lit(False)
    aggs = []
    for s in SIDES:
        price, valid = F.col(f"{s}_price"), F.col(f"{s}_size") > 0
        y = F.col(fit_on[s]).cast("double")
        aggs += quadfit.sums(s, x, y, valid & ~again)
        aggs += [
            F.max(F.when(again & valid & (F.col("pos") == F.col("pane") * g), y)).alias(f"{s}_lone"),
            F.min(F.when(valid, price)).alias(f"{s}_min"),
            F.max(F.when(valid, price)).alias(f"{s}_max"),
            F.min_by(price, F.when(valid & (price != 0), F.col("pos"))).alias(f"{s}_open"),
            F.max_by(price, F.when(valid, F.col("pos"))).alias(f"{s}_close"),
            F.min_by(price, "pos").alias(f"{s}_first"),
            F.max_by(price, "pos").alias(f"{s}_last"),
        ]
    out = rows.groupBy("type", "pane", "origin").agg(F.count(F.lit(1)).alias("_n"), F.max_by("timestamp", "pos").alias("timestamp"), *aggs)
    return out.where(F.col("_n") == g).drop("_n")


def _shifted(s: str, d: Column) -> dict[str, Column]:
    """A pane's sums with x counted from d steps earlier: powers of x + d, multiplied out."""
    n, x, xx, xxx, xxxx, y, xy, xxy = (F.col(f"{s}_{t}") for t in _TERMS)
    return {
        "n": n,
        "x": x + d * n,
        "xx": xx + 2 * d * x + d * d * n,
        "xxx": xxx + 3 * d * xx + 3 * d * d * x + d * d * d * n,
        "xxxx": xxxx + 4 * d * xxx + 6 * d * d * xx + 4 * d * d * d * x + d * d * d * d * n,
        "y": y,
        "xy": xy + d * y,
        "xxy": xxy + 2 * d * xy + d * d * y,
    }


def _combine(in_candle: Column, close_last: bool) -> list[Column]:
    """Aggregates that make a window of its panes. d is the pane's origin in steps after the window's."""
    aggs = []
    for s in SIDES:
        lone = F.when(F.col("starts") & F.col(f"{s}_lone").isNotNull(), F.col(f"{s}_lone"))
        for t, v in _shifted(s, F.col("d")).items():
            if t in ("n", "y"):  # a skipped quote that starts the window has x = 0
                v = v + F.when(lone.isNotNull(), F.lit(1.0) if t == "n" else lone).otherwise(F.lit(0.0))
            aggs.append(F.sum(v).alias(f"{s}_{t}"))
        part = lambda c: F.when(in_candle & F.col(c).isNotNull(), F.col("pane"))
        close = F.max_by(f"{s}_last", "pane") if close_last else F.coalesce(F.max_by(f"{s}_close", part(f"{s}_close")), F.min_by(f"{s}_first", "pane"))
        aggs += [
            F.coalesce(F.min_by(f"{s}_open", part(f"{s}_open")), F.lit(0.0)).alias(f"open_{s}"),
            F.greatest(F.max(F.when(in_candle, F.col(f"{s}_max"))), F.lit(0.0)).alias(f"high_{s}"),
            F.least(F.min(F.when(in_candle, F.col(f"{s}_min"))), F.lit(ohlc.NO_LOW)).alias(f"low_{s}"),
            close.alias(f"close_{s}"),
        ]
    return aggs


def _finished(out: DataFrame, *extra: Column) -> DataFrame:
    fits = [c for s in SIDES for c in quadfit.coefficients(s, 1 / HOUR_STEPS)]
    return out.select("type", "wid", *extra, "timestamp", *fits, *[f"{p}_{s}" for s in SIDES for p in _PRICES])


def _with_origin(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("type", "wid").orderBy("pane")
    d = (F.col("origin") - F.first("origin").over(w)) / F.lit(float(STEP_MS))
    return rows.withColumn("d", d).withColumn("starts", F.row_number().over(w) == 1)


def q1(quotes: DataFrame, window: int, slide: int, fit_on: dict[str, str] = PRICE_COLUMNS) -> DataFrame:
    """Quadratic fit over the window and candlesticks over its last S quotes: type, wid, timestamp of the last
    quote, p0 to p2 and open, high, low, close of both sides. The fit is in double precision on the columns that fit_on
    names, and nothing is rounded.

    N quotes make N / g panes (g = gcd(W, S)), each part of W / S windows: (N / g) (W / S) narrow rows are shuffled
    by (type, wid), instead of N W / S quotes, and a hot key is spread over its windows.
    """
    check(window, slide)
    g = math.gcd(window, slide)
    per, step, tail = window // g, slide // g, slide // g
    rows = _with_origin(assign_windows(quote_panes(quotes, g, fit_on=fit_on), per, step, "pane"))
    in_candle = F.col("pane") >= F.col("wid") * step + (per - tail)
    out = rows.groupBy("type", "wid").agg(F.count(F.lit(1)).alias("_n"), F.max_by("timestamp", "pane").alias("timestamp"), *_combine(in_candle, False))
    return _finished(out.where(F.col("_n") == per))


def quad_fit(quotes: DataFrame, window: int, slide: int, fit_on: dict[str, str] = PRICE_COLUMNS) -> DataFrame:
    """type, wid and p0, p1, p2 of both sides. What candlesticks need of q1 is pruned by the optimiser."""
    return q1(quotes, window, slide, fit_on).drop("timestamp", *[f"{p}_{s}" for s in SIDES for p in _PRICES])


def candlesticks(quotes: DataFrame, window: int, slide: int) -> DataFrame:
    """type, wid, timestamp and open, high, low, close of both sides, straight from the quotes of the last S
    positions of each window: formulation A with a row's windows cut to those whose tail it is in, and the first row's
    price, on which close falls back."""
    check(window, slide)
    tail = F.col("pos") >= F.col("wid") * slide + (window - slide)
    aggs = [a for s in SIDES for a in ohlc.candlestick(s, F.col(f"{s}_price"), (F.col(f"{s}_size") > 0) & tail, F.col("pos"))]
    rows = quotes.select("type", "pos", "timestamp", *[f"{s}_{c}" for s in SIDES for c in ("price", "size")])
    rows = assign_windows(rows, window, slide).where(tail | (F.col("pos") == F.col("wid") * slide))
    out = rows.groupBy("type", "wid").agg(F.max("pos").alias("_end"), F.max_by("timestamp", "pos").alias("timestamp"), *aggs)
    return out.where(F.col("_end") == F.col("wid") * slide + (window - 1)).drop("_end")


def q1_flink(quotes: DataFrame, window: int, slide: int, fit_on: dict[str, str] = PRICE_COLUMNS) -> DataFrame:
    """The variant with early, shorter windows, no skipping of equal timestamps, candlesticks over the whole window
    and the last quote's price as close. Its result id is always 1."""
    check(window, slide)
    g = math.gcd(window, slide)
    rows = _with_origin(flink_windows(quote_panes(quotes, g, skip_runs=False, fit_on=fit_on), window // g, slide // g, "pane"))
    out = rows.groupBy("type", "wid").agg(F.max("pane").alias("_end"), F.max_by("timestamp", "pane").alias("timestamp"), *_combine(F.lit(True), True))
    return _finished(out.where(fired(F.col("_end"), F.col("wid"), slide // g)), F.lit(1).alias("id"))


def q2(points: DataFrame, window: int, slide: int, batch: int | None = None) -> DataFrame:
    """Three-means of each window of one un-keyed stream whose ids are dense: wid, timestamp of the last point, and the
    three centroids, flat: id and sid are the seed point's, x and y the mean."""

    def run(c):
        cx, cy, _ = kmeans(c["x"], c["y"])
        out = {"timestamp": c["timestamp_usec"][:, -1].copy()}
        for j in range(3):
            out |= {f"c{j}_id": c["id"][:, j].copy(), f"c{j}_sid": c["sid"][:, j].copy(), f"c{j}_x": cx[:, j].copy(), f"c{j}_y": cy[:, j].copy()}
        return out

    schema = "timestamp double, " + ", ".join(f"c{j}_id long, c{j}_sid long, c{j}_x double, c{j}_y double" for j in range(3))
    rows = points.withColumn("pos", F.col("id"))
    return CountWindow(rows, "key", window, slide).apply_batches(["id", "sid", "timestamp_usec", "x", "y"], run, schema, batch).drop("key")


def q2_assignment(points: DataFrame, window: int, slide: int) -> DataFrame:
    """wid, the final centroids and how many points are nearest to each of them."""

    def run(c):
        import numpy as np

        cx, cy, _ = kmeans(c["x"], c["y"])
        _, _, label = _assign(c["x"], c["y"], cx, cy, np)
        return {f"c{j}_x": cx[:, j].copy() for j in range(3)} | {f"n{j}": (label == j).sum(1) for j in range(3)}

    schema = "c0_x double, c1_x double, c2_x double, n0 long, n1 long, n2 long"
    rows = points.withColumn("pos", F.col("id"))
    return CountWindow(rows, "key", window, slide).apply_batches(["x", "y"], run, schema).drop("key")


def _assign(x, y, cx, cy, np):
    with np.errstate(invalid="ignore"):
        best = np.sqrt((x - cx[:, :1]) ** 2 + (y - cy[:, :1]) ** 2)
        label = np.zeros(x.shape, np.int64)
        for j in range(1, cx.shape[1]):
            d = np.sqrt((x - cx[:, j : j + 1]) ** 2 + (y - cy[:, j : j + 1]) ** 2)
            nearer = d < best
            label, best = np.where(nearer, j, label), np.where(nearer, d, best)
    return cx, cy, label
