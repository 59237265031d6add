"""Count windows: assignment of positions to windows, batches and workers, and their evaluation.

Window w of a key covers the positions [w * S, w * S + W). Only complete windows are results. Four ways to evaluate:

A  explode each row into its windows and aggregate by (key, window): any Catalyst aggregate;
B  a frame of W rows, read at every S-th row: small W, or S = 1;
C  panes of gcd(W, S) rows, aggregated once and combined: sums, counts, minima, maxima;
D  batches of consecutive windows handed to a vectorised function: anything.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Positions of a key that one task's running frame covers.
FRAME_ROWS = 1 << 18


def check(window: int, slide: int) -> None:
    if not 0 < slide <= window:
        raise ValueError("0 < slide <= window is required: sliding or tumbling windows only")


def first_window(pos: Column, window: int, slide: int) -> Column:
    return F.when(pos < window, F.lit(0).cast("long")).otherwise(F.floor((pos - window) / F.lit(slide)) + 1)


def last_window(pos: Column, slide: int) -> Column:
    return F.floor(pos / F.lit(slide))


def assign_windows(df: DataFrame, window: int, slide: int, pos: str = "pos", name: str = "wid") -> DataFrame:
    """One row per row and window that it belongs to."""
    check(window, slide)
    p = F.col(pos)
    return df.withColumn(name, F.explode(F.sequence(first_window(p, window, slide), last_window(p, slide))))


def batch_geometry(window: int, slide: int, batch: int) -> tuple[int, int]:
    """Rows of a batch of consecutive windows, and rows from one batch to the next."""
    return window + (batch - 1) * slide, slide * batch


def assign_batches(df: DataFrame, window: int, slide: int, batch: int, pos: str = "pos", name: str = "batch") -> DataFrame:
    """One row per row and batch of windows that needs it: about (W + (B - 1) S) / (S B) copies."""
    check(window, slide)
    rows, step = batch_geometry(window, slide, batch)
    p = F.col(pos)
    first = F.when(p < rows, F.lit(0).cast("long")).otherwise(F.floor((p - rows) / F.lit(step)) + 1)
    return df.withColumn(name, F.explode(F.sequence(first, F.floor(p / F.lit(step)))))


def assign_workers(df: DataFrame, window: int, slide: int, workers: int, pos: str = "pos", name: str = "worker") -> DataFrame:
    """One row per row and worker that gets it: worker w % p owns window w, and a row goes to p workers at most."""
    check(window, slide)
    first, last = first_window(F.col(pos), window, slide), last_window(F.col(pos), slide)
    upto = F.least(last, first + (workers - 1))
    return df.withColumn(name, F.explode(F.transform(F.sequence(first, upto), lambda w: w % workers)))


def copies(pos: Column, window: int, slide: int, workers: int) -> Column:
    return F.least(last_window(pos, slide) - first_window(pos, window, slide) + 1, F.lit(workers).cast("long"))


def cpu_batch(window: int, slide: int, workers: int) -> int:
    """Windows a worker batches so that its batches overlap as little as single windows do over all workers."""
    return 1 if workers == 1 else math.ceil((window - slide) / (slide * workers - slide))


def batch_indexes(window: int, slide: int, batch: int) -> list[tuple[int, int]]:
    """(start, end) of each window inside a batch's buffer."""
    return [(i * slide, i * slide + window) for i in range(batch)]


def best_batch(window: int, slide: int) -> int:
    """Windows a batch needs so that a row is copied about twice."""
    return max(1, math.ceil((window - slide) / slide))


@dataclass(frozen=True)
class Pane:
    """An algebraic aggregate: its value per pane, and how pane values combine."""

    name: str
    of_rows: Column
    combine: Callable[[Column], Column]


def pane_sum(name: str, value: Column) -> Pane:
    return Pane(name, F.sum(value), F.sum)


def pane_count(name: str) -> Pane:
    return Pane(name, F.count(F.lit(1)), F.sum)


def pane_min(name: str, value: Column) -> Pane:
    return Pane(name, F.min(value), F.min)


def pane_max(name: str, value: Column) -> Pane:
    return Pane(name, F.max(value), F.max)


@dataclass(frozen=True)
class CountWindow:
    """Count windows over a DataFrame with a key and a position."""

    df: DataFrame
    key: str
    window: int
    slide: int
    pos: str = "pos"

    def __post_init__(self) -> None:
        check(self.window, self.slide)

    def agg(self, *aggregates: Column) -> DataFrame:
        """A. key, wid and any aggregates over complete windows; within them, `wid` and the position may be used.

        Rows are pre-aggregated on the map side and shuffled by (key, wid), so one hot key spreads over its windows.
        """
        rows = assign_windows(self.df, self.window, self.slide, self.pos)
        out = rows.groupBy(self.key, "wid").agg(F.count(F.lit(1)).alias("_n"), *aggregates)
        return out.where(F.col("_n") == self.window).drop("_n")

    def frame(self, *aggregates: tuple[str, Callable[[], Column]], part: int = FRAME_ROWS) -> DataFrame:
        """B. The same by a running frame of W rows.

        A key is cut into parts of `part` positions (W at least), each with the W - 1 rows before it, so that no task
        holds a whole key; the rows lent to the next part give no results there.
        """
        part = max(part, self.window)
        pos, own = F.col(self.pos), F.floor(F.col(self.pos) / F.lit(part))
        rows = self.df.withColumn("_part", F.explode(F.sequence(own, F.floor((pos + (self.window - 1)) / F.lit(part)))))
        over = Window.partitionBy(self.key, "_part").orderBy(self.pos).rowsBetween(-(self.window - 1), 0)
        out = rows.select(self.key, self.pos, "_part", *[f().over(over).alias(n) for n, f in aggregates])
        end = pos + 1
        out = out.where((F.col("_part") == own) & (end >= self.window) & ((end - self.window) % self.slide == 0))
        return out.select(self.key, ((end - self.window) / self.slide).cast("long").alias("wid"), *[n for n, _ in aggregates])

    def pane_rows(self) -> int:
        return math.gcd(self.window, self.slide)

    def pane_values(self, panes: Sequence[Pane]) -> DataFrame:
        """Values of the complete panes: key, pane and one column an aggregate."""
        g = self.pane_rows()
        out = self.df.groupBy(self.key, F.floor(F.col(self.pos) / F.lit(g)).alias("pane")).agg(F.count(F.lit(1)).alias("_n"), *[p.of_rows.alias(p.name) for p in panes])
        return out.where(F.col("_n") == g).drop("_n")

    def panes(self, *panes: Pane) -> DataFrame:
        """C. Panes are spread over the windows that they are part of, as rows are in A: N / g rows instead of N."""
        g = self.pane_rows()
        per, step = self.window // g, self.slide // g
        rows = assign_windows(self.pane_values(panes), per, step, "pane")
        out = rows.groupBy(self.key, "wid").agg(F.count(F.lit(1)).alias("_n"), *[p.combine(F.col(p.name)).alias(p.name) for p in panes])
        return out.where(F.col("_n") == per).drop("_n")

    def algebraic(self, *panes: Pane) -> DataFrame:
        """C where panes are longer than a row, else A: the cheaper of the two plans for these aggregates."""
        return self.panes(*panes) if self.pane_rows() > 1 else self.agg(*[p.of_rows.alias(p.name) for p in panes])

    def apply_batches(self, columns: Sequence[str], function: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], schema: str, batch: int | None = None) -> DataFrame:
        """D. key, wid and what `function` returns.

        function gets, for each of `columns`, an array of shape (windows, W) of consecutive complete windows (a
        strided view without copies) and returns one array an output column. Rows are shuffled by (key, batch).
        """
        batch = batch or best_batch(self.window, self.slide)
        window, slide, key, pos = self.window, self.slide, self.key, self.pos
        rows = assign_batches(self.df.select(key, pos, *columns), window, slide, batch, pos)
        kind = dict(self.df.dtypes)[key]
        names = [x.split()[0] for x in schema.split(", ")]

        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by(pos)
            n = (table.num_rows - window) // slide + 1 if table.num_rows >= window else 0
            n = min(n, batch)
            out: dict[str, pa.Array] = {}
            if n:
                views = {c: np.lib.stride_tricks.sliding_window_view(table[c].to_numpy(), window)[::slide][:n] for c in columns}
                got = function(views)
                first = table["batch"][0].as_py() * batch
                out = {key: pa.array([table[key][0].as_py()] * n, table.schema.field(key).type), "wid": pa.array(np.arange(first, first + n))} | {c: pa.array(got[c]) for c in names}
            return pa.table(out) if n else pa.table({c: pa.array([], t) for c, t in empty.items()})

        empty = _arrow_types(f"{key} {kind}, wid long, {schema}")
        return rows.groupBy(key, "batch").applyInArrow(run, f"{key} {kind}, wid long, {schema}")


def _arrow_types(schema: str) -> dict[str, pa.DataType]:
    kinds = {"string": pa.string(), "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    return {name: kinds[kind] for name, kind in (x.split() for x in schema.split(", "))}


def flink_windows(df: DataFrame, window: int, slide: int, pos: str = "pos") -> DataFrame:
    """Windows as a countWindow(W, S) trigger fires them: at every S-th row over the last W rows, so the first ones
    are shorter. One row per row and firing m; firing m ends at position (m + 1) S - 1."""
    check(window, slide)
    p = F.col(pos)
    first, last = F.floor(p / F.lit(slide)), F.floor((p + window) / F.lit(slide)) - 1
    return df.withColumn("wid", F.explode(F.sequence(first, last)))


def fired(grouped_max_pos: Column, wid: Column, slide: int) -> Column:
    return grouped_max_pos == (wid + 1) * slide - 1
