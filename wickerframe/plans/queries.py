"""The registered queries: fixtures put through operators with production parameters."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric, vectorised
from ..functions import windows as wf
from ..operators import analysis, metrics, order, tuner
from ..operators import windows as ow
from ..operators.positions import with_position
from ..sources import generators, sensor64, sinks
from ..streaming import count_window as streaming
from . import fixtures as fx

#: Rows of a window and of its slide; a small slide; a tumbling window; workers and windows of a batch.
W, S, SMALL_S, TUMBLING, WORKERS, BATCH = 100, 30, 5, 64, 4, 4
BATCHES = [384 * k for k in range(1, 16)]
GOAL = 6000.0

_found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _found[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_found)


def _cents(column: str):
    return F.round(F.col(column) * 100).cast("long")


#: The registered fits run on whole cents, whose sums are exact in any order, and are rounded for the comparison.
CENTS, DIGITS = {"bid": "bid_cents", "ask": "ask_cents"}, 3


def _with_cents(quotes: DataFrame) -> DataFrame:
    return quotes.withColumns({c: _cents(f"{s}_price") for s, c in CENTS.items()})


def _signed_round(v: Column, digits: int) -> Column:
    """round() that keeps the sign of what it makes zero, as IEEE rounding and SQL in DuckDB do: text forms show it."""
    out = F.round(v, digits)
    return F.when(out == 0, v * 0.0).otherwise(out)


def _in_units(fits: DataFrame) -> DataFrame:
    return fits.withColumns({n: _signed_round(F.col(n) * 0.01, DIGITS) for n in fits.columns if n[:2] in ("p0", "p1", "p2")})


def _slim(quotes: DataFrame) -> DataFrame:
    return quotes.select("type", "id", "pos")


# Windows


@_query
def count_window_sum(spark, sf):
    q = fx.quotes(spark, sf)
    out = ow.CountWindow(q, "type", W, S).algebraic(ow.pane_sum("bid", _cents("bid_price")), ow.pane_sum("ask", _cents("ask_price")))
    return out.select("type", "wid", (F.col("bid") / 100.0).alias("sum_bid"), (F.col("ask") / 100.0).alias("sum_ask"))


@_query
def count_window_tumbling(spark, sf):
    q = fx.quotes(spark, sf)
    panes = ow.pane_count("n"), ow.pane_sum("sum_bid", _cents("bid_price")), ow.pane_min("min_bid", F.col("bid_price")), ow.pane_max("max_bid", F.col("bid_price"))
    return ow.CountWindow(q, "type", TUMBLING, TUMBLING).algebraic(*panes)


@_query
def count_window_frame(spark, sf):
    q = fx.quotes(spark, sf)
    return ow.CountWindow(q, "type", W, S).frame(("max_bid", lambda: F.max("bid_price")), ("min_ask", lambda: F.min("ask_price")))


@_query
def window_assign(spark, sf):
    return ow.assign_windows(_slim(fx.quotes(spark, sf)), W, S)


@_query
def worker_route(spark, sf):
    return ow.assign_workers(_slim(fx.quotes(spark, sf)), W, S, WORKERS)


@_query
def copies_per_tuple(spark, sf):
    n = ow.copies(F.col("pos"), W, S, WORKERS)
    return fx.quotes(spark, sf).groupBy("type").agg(F.avg(n).alias("avg_copies"), F.max(n).alias("max_copies"))


@_query
def batch_assign(spark, sf):
    return ow.assign_batches(_slim(fx.quotes(spark, sf)), W, S, BATCH)


@_query
def batch_indexes(spark, sf):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(ow.batch_indexes(W, S, BATCH))], "i long, start long, stop long")


@_query
def partial_indexes(spark, sf):
    rows, step = ow.batch_geometry(W, S, BATCH)
    n = fx.events(spark, sf).groupBy(F.col("event_type").alias("type")).agg(F.count(F.lit(1)).alias("n"))
    full = F.when(F.col("n") < rows, F.lit(0)).otherwise(F.floor((F.col("n") - rows) / F.lit(step)) + 1)
    left = n.withColumn("first", full * BATCH).withColumn("rows", F.col("n") - full * step)
    windows = F.when(F.col("rows") >= W, F.sequence(F.lit(0), F.floor((F.col("rows") - W) / F.lit(S)))).otherwise(F.array().cast("array<bigint>"))
    return left.select("type", "first", F.explode(windows).alias("i")).select("type", (F.col("first") + F.col("i")).alias("wid"), (F.col("i") * S).alias("start"), (F.col("i") * S + W).alias("stop"))


@_query
def cpu_batch_size(spark, sf):
    return spark.createDataFrame([(p, ow.cpu_batch(W, SMALL_S, p)) for p in range(1, 11)], "p long, batch long")


@_query
def batched_windows(spark, sf):
    q = fx.quotes(spark, sf)
    q = q.select("type", "pos", *[_cents(c).alias(c) for c in ("bid_price", "ask_price")])
    out = ow.CountWindow(q, "type", W, S).apply_batches(["bid_price", "ask_price"], vectorised.sums, "sum_bid long, sum_ask long")
    return out.withColumns({c: F.col(c) / 100.0 for c in ("sum_bid", "sum_ask")})


@_query
def pane_aggregate(spark, sf):
    q = fx.quotes(spark, sf)
    return ow.CountWindow(q, "type", W, S).pane_values([ow.pane_count("n"), ow.pane_sum("sum_bid", _cents("bid_price")), ow.pane_max("max_ask", F.col("ask_price"))])


@_query
def pane_window_combine(spark, sf):
    q = fx.quotes(spark, sf)
    return ow.CountWindow(q, "type", W, S).panes(ow.pane_count("n"), ow.pane_sum("sum_bid", _cents("bid_price")), ow.pane_max("max_ask", F.col("ask_price")))


@_query
def flink_count_window(spark, sf):
    q = fx.quotes(spark, sf).select("type", "pos", _cents("bid_price").alias("bid"))
    out = ow.flink_windows(q, W, S).groupBy("type", "wid").agg(F.max("pos").alias("stop"), F.count(F.lit(1)).alias("n"), F.sum("bid").alias("sum_bid"))
    return out.where(ow.fired(F.col("stop"), F.col("wid"), S)).select("type", "wid", "n", "sum_bid")


@_query
def kf_count_window(spark, sf):
    e = fx.events(spark, sf).select((F.col("event_id") % WORKERS).alias("worker"), F.col("event_id").alias("id"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    return ow.CountWindow(with_position(e, "worker", "id"), "worker", W, S).algebraic(ow.pane_sum("sum_cents", F.col("cents")))


# Scalar functions and window functions


@_query
def filter_hook(spark, sf):
    e = fx.events(spark, sf)
    kept = e.where(F.col("k") % 10 != 0)  # before positions are given: filtering afterwards would leave gaps
    return with_position(kept.select(F.col("event_type").alias("type"), F.col("event_id").alias("id")), "type", "id")


@_query
def sequence_by_key(spark, sf):
    return _slim(fx.quotes(spark, sf))


@_query
def project_points(spark, sf):
    return fx.points(spark, sf).drop("key")


@_query
def dedup_runs(spark, sf):
    q = fx.quotes(spark, sf)
    kept = ow.assign_windows(q.select("type", "pos", "original_timestamp", "prev_original_timestamp"), W, S)
    first = (F.col("pos") == F.col("wid") * S) | ~F.col("original_timestamp").eqNullSafe(F.col("prev_original_timestamp"))
    out = kept.groupBy("type", "wid").agg(F.count(F.lit(1)).alias("n"), F.count_if(first).alias("kept"))
    return out.where(F.col("n") == W).select("type", "wid", "kept")


@_query
def distance_to_seed(spark, sf):
    p = fx.points(spark, sf).withColumn("wid", F.floor(F.col("id") / F.lit(TUMBLING)))
    seeds = p.where(F.col("id") % TUMBLING == 0).select(F.col("wid").alias("s_wid"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    d = numeric.distance(F.col("x"), F.col("y"), F.col("sx"), F.col("sy"))
    return p.join(seeds, F.col("wid") == F.col("s_wid")).select("id", "wid", d.alias("distance"))


@_query
def quad_fit(spark, sf):
    return _in_units(wf.quad_fit(_with_cents(fx.quotes(spark, sf)), W, S, CENTS))


@_query
def parabola_eval(spark, sf):
    t = F.lit(2.0)
    values = [F.round(numeric.parabola(t, *[F.col(f"p{k}_{s}") for k in range(3)]), 6).alias(f"at2_{s}") for s in ("bid", "ask")]
    return quad_fit(spark, sf).select("type", "wid", *values)


@_query
def candlestick(spark, sf):
    return wf.candlesticks(fx.quotes(spark, sf), W, SMALL_S)


@_query
def q1_financial(spark, sf):
    return _in_units(wf.q1(_with_cents(fx.quotes(spark, sf)), W, SMALL_S, CENTS))


@_query
def q1_flink_variant(spark, sf):
    return _in_units(wf.q1_flink(_with_cents(fx.quotes(spark, sf)), W, S, CENTS))


def _no_nan(df: DataFrame) -> DataFrame:
    """Centroids of empty clusters as nulls."""
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


@_query
def q2_kmeans(spark, sf):
    return _no_nan(wf.q2(fx.points(spark, sf), W, S))


@_query
def q2_kmeans_dup(spark, sf):
    return _no_nan(wf.q2(fx.points(spark, sf, duplicates=True), W, S))


@_query
def q2_kmeans_assign(spark, sf):
    return _no_nan(wf.q2_assignment(fx.points(spark, sf), W, S))


# Order and sinks


def _results(spark, sf) -> DataFrame:
    return ow.CountWindow(fx.quotes(spark, sf), "type", W, S).agg(F.max("timestamp").alias("timestamp"))


def _gappy(spark, sf) -> DataFrame:
    return _results(spark, sf).where(F.col("wid") % 7 != 3)


@_query
def ordered_results(spark, sf):
    return order.ordered(_results(spark, sf), "type")


@_query
def contiguous_prefix(spark, sf):
    return order.contiguous_prefix(_gappy(spark, sf), "type")


@_query
def order_violations(spark, sf):
    return order.order_violations(_gappy(spark, sf), "type", "timestamp").select("type", "wid", "expected")


@_query
def candle_lines(spark, sf):
    return sinks.candle_lines(candlestick(spark, sf))


@_query
def fitting_lines(spark, sf):
    return sinks.fitting_lines(_in_units(wf.q1(_with_cents(fx.quotes(spark, sf)), W, S, CENTS)))


@_query
def cluster_lines(spark, sf):
    return sinks.cluster_lines(wf.q2(fx.points(spark, sf), W, S))


# Metrics

DAY = 86_400_000


@_query
def throughput_per_second(spark, sf):
    return metrics.rate(fx.events(spark, sf), F.col("ms"), 3_600_000)


@_query
def throughput_running_avg(spark, sf):
    return metrics.running_average(fx.throughput(spark, sf), "type", "bucket", "n")


@_query
def throughput_stable(spark, sf):
    return _rounded(metrics.stable(fx.throughput(spark, sf), "type", "bucket", "n"), "mean", "cv")


@_query
def throughput_stable_cv2(spark, sf):
    return _rounded(metrics.stable_cv2(fx.throughput(spark, sf), "type", "bucket", "n"), "thr_mean", "thr_cv", "cv_of_cvs")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _latencies(spark, sf) -> DataFrame:
    q = fx.quotes(spark, sf)
    return metrics.latency_per_interval(q, "type", F.col("timestamp") - F.col("original_timestamp"), F.col("timestamp"), DAY)


@_query
def latency_per_interval(spark, sf):
    return _rounded(_latencies(spark, sf), "avg_latency")


@_query
def avg_latency(spark, sf):
    return _rounded(metrics.overall_latency(_latencies(spark, sf), "type"), "mean_of_means", "mean_of_results")


@_query
def results_per_sec(spark, sf):
    return _rounded(metrics.results_per_second(_results(spark, sf), "type", "timestamp"), "results_per_sec")


# Tuner and analysis


@_query
def config_grid(spark, sf):
    return tuner.config_grid(spark)


@_query
def target_config(spark, sf):
    return tuner.target_config(fx.configs(spark), GOAL).select("nw", "batch", "thr")


@_query
def accepted_configs(spark, sf):
    return tuner.accepted(fx.configs(spark), GOAL).select("nw", "batch", "thr")


@_query
def partial_grid(spark, sf):
    return tuner.partial_grid(spark)


@_query
def best_config(spark, sf):
    return tuner.best_config(fx.configs(spark))


@_query
def best_neighbor(spark, sf):
    return tuner.best_neighbor(fx.configs(spark))


@_query
def heatmap_rate(spark, sf):
    return analysis.heatmap_rate(fx.configs(spark), BATCHES, S)


@_query
def heatmap_error(spark, sf):
    return analysis.heatmap_error(analysis.relative_errors(fx.configs(spark)), BATCHES)


@_query
def heatmap_error_summary(spark, sf):
    return _rounded(analysis.error_summary(analysis.relative_errors(fx.configs(spark))), "avg_error", "min_error", "max_error")


@_query
def run_average(spark, sf):
    return _rounded(analysis.run_average(fx.runs(spark)), "mean", "deviation")


@_query
def input_rate(spark, sf):
    return _rounded(analysis.input_rate(fx.runs(spark)), "tuples_per_sec")


@_query
def max_rate(spark, sf):
    return _rounded(analysis.max_rate(fx.runs(spark)), "max_cpu", "max_gpu")


@_query
def speedup_table(spark, sf):
    return analysis.speedup_table(fx.runs(spark), [10000, 25000, 50000])


# Sources

KEYS = [0.5, 0.25, 0.15, 0.1]
GENERATED = 20_000


@_query
def gen_quotes(spark, sf):
    return generators.quotes(spark, GENERATED, 100_000.0, KEYS)


@_query
def gen_arrivals(spark, sf):
    return generators.arrivals(spark, GENERATED, 1000.0)


@_query
def gen_keys(spark, sf):
    return spark.range(GENERATED).select("id", generators.categorical(generators.uniform(F.col("id"), 5), KEYS).alias("type"))


@_query
def rng_distributions(spark, sf):
    u, v, w = (generators.uniform(F.col("id"), k) for k in (1, 2, 3))
    shapes = {
        "uniform": u,
        "exponential": generators.exponential(u, 2.0),
        "erlang": generators.erlang([u, v, w], 3.0),
        "hyperexponential": generators.hyperexponential(u, v, 0.3, 1.0),
        "triangular": generators.triangular(u, 1.0, 2.0, 5.0),
        "normal": generators.normal(u, v, 10.0, 2.0),
    }
    return spark.range(GENERATED).select("id", *[F.round(c, 6).alias(n) for n, c in shapes.items()])


def _sensor(spark, sf) -> DataFrame:
    e = fx.events(spark, sf)
    small = lambda k: (F.col("k") * k - 40).cast("int")
    ints = [small(n + 1).alias(c) for n, c in enumerate(sensor64.INTS)]
    return e.select(F.col("event_id").cast("int").alias("id"), F.col("user_id").cast("int").alias("sid"), (F.col("ms") * 1000.0).alias("timestamp_usec"), *ints)


@_query
def read_sensor64(spark, sf):
    return sensor64.unpack(sensor64.pack(_sensor(spark, sf)))


@_query
def speedup_ts(spark, sf):
    return sensor64.accelerate(_sensor(spark, sf).select("id", "timestamp_usec"), 80.0)


@_query
def theoretical_rate(spark, sf):
    return sensor64.theoretical_rate(_sensor(spark, sf)).select(F.round("rate", 9).alias("rate"))


@_query
def replicate_stream(spark, sf):
    return generators.replicate(_sensor(spark, sf).select(F.col("id").cast("long").alias("id"), F.col("timestamp_usec").cast("long").alias("timestamp_usec")), 3)


@_query
def source_rate(spark, sf):
    return metrics.rate(_sensor(spark, sf), F.col("timestamp_usec") / 1000.0, DAY)


@_query
def interdep_sample(spark, sf):
    e = fx.events(spark, sf).select(F.lit(0).alias("key"), F.col("event_id").alias("id"), "ms")
    e = with_position(e, "key", "id", previous=["ms"])
    return e.where((F.col("id") % 1024 == 0) & F.col("prev_ms").isNotNull()).select("id", (F.col("ms") - F.col("prev_ms")).alias("gap_ms"))


# Streams


def _stream(spark, sf) -> DataFrame:
    path = f"{sf}/events.parquet"
    e = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return fx.quote_columns(fx.event_columns(e))


def _folder(spark) -> str:
    """A folder for a stream's state and output: in the one all executors share, or a local session's own."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root or 'file://' + tempfile.mkdtemp(prefix='wickerframe-stream-')}/stream-{uuid.uuid4().hex[:12]}"


@_query
def stream_count_window(spark, sf):
    quotes = _stream(spark, sf).select("type", "id", *[_cents(c).alias(c) for c in ("bid_price", "ask_price")])
    out = streaming.count_windows(quotes, "type", "id", ["bid_price", "ask_price"], W, S, vectorised.sums, "sum_bid long, sum_ask long")
    folder = _folder(spark)
    done = streaming.run_once(out, f"{folder}/out", f"{folder}/state")
    return done.withColumns({c: F.col(c) / 100.0 for c in ("sum_bid", "sum_ask")})


@_query
def stream_q1(spark, sf):
    names = [f"{p}_{s}" for s in ("bid", "ask") for p in ("p0", "p1", "p2", "open", "high", "low", "close")]
    schema = "timestamp long, " + ", ".join(f"{n} double" for n in names)
    columns = ["bid_price", "bid_size", "ask_price", "ask_size", "original_timestamp", "timestamp", *CENTS.values()]
    out = streaming.count_windows(_with_cents(_stream(spark, sf)), "type", "id", columns, W, S, lambda c: vectorised.q1(c, S, fit_on=CENTS), schema)
    folder = _folder(spark)
    done = streaming.run_once(out, f"{folder}/out", f"{folder}/state")
    unit = lambda p: F.lit((12.0 ** int(p[1])) / 100.0)
    return done.withColumns({n: F.round(F.col(n) * unit(n), DIGITS) for n in names if n[0] == "p"})
