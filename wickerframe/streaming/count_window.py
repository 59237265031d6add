"""Count windows on a stream: per key a counter and the last rows, results as soon as a window is complete."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.windows import check

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class CountWindows(StatefulProcessor):
    """Keeps the rows that later windows still need (fewer than W + S) and the position of the first of them."""

    def __init__(self, key: str, order: str, columns: Sequence[str], types: Sequence[T.DataType], window: int, slide: int, function: Callable, names: Sequence[str]) -> None:
        check(window, slide)
        self.key, self.order, self.columns = key, order, list(columns)
        self.state_schema = T.StructType([T.StructField(c, t) for c, t in zip(self.columns, types)])
        self.window, self.slide, self.function, self.names = window, slide, function, list(names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", self.state_schema)
        self.start = handle.getValueState("start", T.StructType([T.StructField("pos", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = pd.DataFrame(list(self.rows.get()), columns=self.columns) if self.rows.exists() else None
        start = self.start.get()[0] if self.start.exists() else 0
        new = pd.concat(list(rows))[self.columns].sort_values(self.order, kind="stable")
        data = new if kept is None or not len(kept) else pd.concat([kept, new])
        n = max(0, (len(data) - self.window) // self.slide + 1)
        # start may lie between windows only if all of a window's rows are still to come; rows are kept from a window's start
        if n:
            views = {c: np.lib.stride_tricks.sliding_window_view(data[c].to_numpy(), self.window)[:: self.slide][:n] for c in self.columns}
            got = self.function(views)
            first = start // self.slide
            yield pd.DataFrame({self.key: key[0], "wid": np.arange(first, first + n, dtype=np.int64)} | {c: got[c] for c in self.names})
            data = data.iloc[n * self.slide :]
            start += n * self.slide
        if len(data):
            self.rows.put([tuple(x.item() if hasattr(x, "item") else x for x in r) for r in data.itertuples(index=False)])
        else:
            self.rows.clear()
        self.start.update((start,))

    def close(self) -> None:
        pass


def count_windows(stream: DataFrame, key: str, order: str, columns: Sequence[str], window: int, slide: int, function: Callable, schema: str) -> DataFrame:
    """Streaming key, wid and what `function` gives for arrays of shape (windows, W), like apply_batches in a batch.

    Rows of a micro-batch are taken in the order of `order`; between micro-batches, in order of arrival. Incomplete
    windows are never emitted. Needs the RocksDB state store.
    """
    kinds = {f.name: f.dataType for f in stream.schema.fields}
    own = [order, *[c for c in columns if c != order]]
    fields = T.StructType.fromDDL(schema)
    out = T.StructType([T.StructField(key, kinds[key]), T.StructField("wid", T.LongType()), *fields.fields])
    processor = CountWindows(key, order, own, [kinds[c] for c in own], window, slide, function, fields.names)
    return stream.groupBy(key).transformWithStateInPandas(processor, out, outputMode="Append", timeMode="None")


def run_once(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there now, into Parquet, and read that. Restarting with the same checkpoint goes on."""
    spark: SparkSession = stream.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(stream.schema).parquet(path)
