"""Window semantics against literal loops; formulations against each other; streams against batches."""

import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wickerframe.functions import vectorised
from wickerframe.functions import windows as wf
from wickerframe.functions.kmeans import kmeans
from wickerframe.operators import order, tuner
from wickerframe.operators import windows as ow
from wickerframe.operators.positions import with_position
from wickerframe.plans import fixtures as fx
from wickerframe.plans import queries
from wickerframe.sources import generators, sensor64, sinks
from wickerframe.streaming import count_window as streaming


def complete(n, w, s):
    """Window ids of a key with n rows."""
    return [] if n < w else list(range((n - w) // s + 1))


def numbers(spark, sizes):
    return spark.createDataFrame([(k, i, float((i * 7 + k) % 13)) for k, n in sizes.items() for i in range(n)], "key long, pos long, v double")


@pytest.mark.parametrize(("w", "s"), [(10, 3), (10, 10), (6, 4), (5, 1)])
def test_formulations_agree(spark, w, s):
    sizes = {1: 0, 2: w - 1, 3: w, 4: w + s, 5: 57}
    df = numbers(spark, sizes)
    c = ow.CountWindow(df, "key", w, s)
    want = {(k, i): sum(float((p * 7 + k) % 13) for p in range(i * s, i * s + w)) for k, n in sizes.items() for i in complete(n, w, s)}
    forms = {
        "A": c.agg(F.sum("v").alias("v")),
        "B": c.frame(("v", lambda: F.sum("v"))),
        "B in parts": c.frame(("v", lambda: F.sum("v")), part=w + 1),
        "B in least parts": c.frame(("v", lambda: F.sum("v")), part=1),
        "C": c.panes(ow.pane_sum("v", F.col("v"))),
        "planner": c.algebraic(ow.pane_sum("v", F.col("v"))),
    } | {f"D{b}": c.apply_batches(["v"], lambda a: {"v": a["v"].sum(1)}, "v double", batch=b) for b in (1, 3, 50)}
    for name, got in forms.items():
        assert {(r.key, r.wid): r.v for r in got.collect()} == want, name


@given(st.integers(1, 40), st.data(), st.integers(0, 200), st.integers(1, 6))
def test_geometry(w, data, n, b):
    """Rows of a batch hold exactly its windows; copies are as the formula says."""
    s = data.draw(st.integers(1, w))
    rows, step = ow.batch_geometry(w, s, b)
    assert rows == ow.batch_indexes(w, s, b)[-1][1] and step == s * b
    for wid in complete(n, w, s):
        k, i = divmod(wid, b)
        start, stop = ow.batch_indexes(w, s, b)[i]
        assert (k * step + start, k * step + stop) == (wid * s, wid * s + w)
    assert ow.cpu_batch(w, s, 1) == 1


def test_assignment(spark):
    w, s, p = 10, 3, 2
    df = spark.range(40).withColumnRenamed("id", "pos")
    got = {}
    for r in ow.assign_windows(df, w, s).collect():
        got.setdefault(r.pos, []).append(r.wid)
    for pos in range(40):
        assert sorted(got[pos]) == [i for i in range(40) if i * s <= pos < i * s + w]
    workers = ow.assign_workers(df, w, s, p).groupBy("pos").agg(F.count("*").alias("n"), F.countDistinct("worker").alias("d")).collect()
    assert all(r.n == r.d == min(p, len(got[r.pos])) for r in workers)
    with pytest.raises(ValueError):
        ow.assign_windows(df, 3, 4)


@pytest.mark.parametrize("stride", [3, 1000])
def test_positions(spark, stride):
    df = spark.createDataFrame([(k, i, i * 10) for i in range(50) for k in ["a" if i % 3 else "b"]], "key string, id long, x long").repartition(5)
    rows = {(r.key, r.id): (r.pos, r.prev_x) for r in with_position(df, "key", "id", previous=["x"], stride=stride).collect()}
    for key in "ab":
        ids = sorted(i for k, i in rows if k == key)
        assert [rows[key, i] for i in ids] == [(n, ids[n - 1] * 10 if n else None) for n in range(len(ids))]


def test_positions_without_order(spark):
    df = spark.createDataFrame([("a", None), ("a", 5), ("a", 9), (None, 3)], "key string, id long")
    assert sorted(map(tuple, with_position(df, "key", "id", stride=4).collect()), key=repr) == [("a", 5, 1), ("a", 9, 2), ("a", None, 0), (None, 3, 0)]


def literal_q1(q, w, s):
    """Query 1 of one key's quotes by loops: (p0, p1, p2, open, high, low, close) per side, x in steps."""
    out = []
    for wid in complete(len(q), w, s):
        win = q[wid * s : wid * s + w]
        row = {"wid": wid, "timestamp": win[-1]["timestamp"]}
        for side in ("bid", "ask"):
            sums = [0.0] * 8
            i = 0
            while i < w:
                t = win[i]
                if t[f"{side}_size"] > 0:
                    x = (t["original_timestamp"] - win[0]["original_timestamp"]) / 300000.0
                    y = t[f"{side}_price"]
                    for k, v in enumerate((1.0, x, x * x, x**3, x**4, y, x * y, x * x * y)):
                        sums[k] += v
                ts = t["original_timestamp"]
                i += 1
                while i < w and win[i]["original_timestamp"] == ts:
                    i += 1
            n, sx, s2, s3, s4, sy, sxy, s2y = (np.float64(v) for v in sums)
            with np.errstate(all="ignore"):
                a, b = (s2y * s2 - sxy * s3) / (s2 * s4 - s3 * s3), (sxy * s4 - s2y * s3) / (s2 * s4 - s3 * s3)
                row |= {f"p0_{side}": sy / n - b * sx / n - a * s2 / n, f"p1_{side}": b * 12, f"p2_{side}": a * 144}
            low, high, opened, last = 10000.0, 0.0, 0.0, 0
            for i in range(w - s, w):
                price = win[i][f"{side}_price"]
                if win[i][f"{side}_size"] > 0:
                    opened = price if opened == 0 else opened
                    high, low, last = max(high, price), min(low, price), i
            row |= {f"open_{side}": opened, f"high_{side}": high, f"low_{side}": low, f"close_{side}": win[last][f"{side}_price"]}
        out.append(row)
    return out


def same(a, b):
    return (math.isnan(a) and math.isnan(b)) or a == pytest.approx(b, abs=0.0006, rel=1e-7)


@pytest.mark.parametrize(("w", "s"), [(20, 6), (20, 20), (12, 1)])
def test_q1_against_loops(spark, sf, w, s):
    quotes = fx.quotes(spark, sf).toPandas().sort_values(["type", "pos"])
    got = wf.q1(fx.quotes(spark, sf), w, s).toPandas()
    for key, q in quotes.groupby("type"):
        want = literal_q1(q.to_dict("records"), w, s)
        mine = got[got.type == key].sort_values("wid").to_dict("records")
        assert [r["wid"] for r in mine] == [r["wid"] for r in want]
        for x, y in zip(mine, want):
            assert all(same(x[c], y[c]) for c in y), (key, x, y)


def test_q1_fine_prices(spark):
    """Prices in steps of 0.0004: the fit rounds nothing, in a batch and in the form for streams."""
    rows = [("a", i, 4.0 + 0.0004 * (i * 7 % 11), 1, 4.1 + 0.0004 * (i * 5 % 13), i % 3, i * 300_000, i) for i in range(60)]
    q = spark.createDataFrame(rows, "type string, id long, bid_price double, bid_size int, ask_price double, ask_size int, original_timestamp long, timestamp long")
    q = with_position(q, "type", "id", previous=["original_timestamp"])
    got = wf.q1(q, 20, 5).orderBy("wid").toPandas()
    want = literal_q1(q.orderBy("pos").toPandas().to_dict("records"), 20, 5)
    table = q.orderBy("pos").toPandas()
    views = {c: np.lib.stride_tricks.sliding_window_view(table[c].to_numpy(), 20)[::5] for c in table.columns if c != "type"}
    stream = vectorised.q1(views, 5)
    for k, row in enumerate(want):
        for n in ("p0", "p1", "p2"):
            for side in ("bid", "ask"):
                exact = row[f"{n}_{side}"]
                assert got[f"{n}_{side}"][k] == pytest.approx(exact, rel=1e-9, abs=1e-9)
                assert stream[f"{n}_{side}"][k] * 12.0 ** int(n[1]) == pytest.approx(exact, rel=1e-9, abs=1e-9)


def test_q1_edges(spark):
    """No valid quote at all, prices above the sentinel, a run of equal timestamps across a window's start."""
    rows = [("a", i, 20000.0 + i, 0 if i < 4 else 1, 50.0 + i, 0, (i // 3) * 300000, i) for i in range(12)]
    q = spark.createDataFrame(rows, "type string, id long, bid_price double, bid_size int, ask_price double, ask_size int, original_timestamp long, timestamp long")
    q = with_position(q, "type", "id", previous=["original_timestamp"])
    got = wf.q1(q, 4, 2).orderBy("wid").toPandas().to_dict("records")
    want = literal_q1(q.orderBy("pos").toPandas().to_dict("records"), 4, 2)
    assert len(got) == len(want) == 5
    for x, y in zip(got, want):
        assert all(same(x[c], y[c]) for c in y), (x, y)
    assert got[0]["low_ask"] == 10000.0 and got[0]["close_ask"] == 50.0 and got[0]["open_ask"] == 0.0


def literal_kmeans(x, y, k=3, rounds=10):
    c = [(x[j], y[j]) for j in range(k)]
    for _ in range(rounds):
        groups = [[] for _ in range(k)]
        for p in zip(x, y):
            d = [math.sqrt((p[0] - a) ** 2 + (p[1] - b) ** 2) for a, b in c]
            best = 0
            for j in range(1, k):
                if d[j] < d[best]:
                    best = j
            groups[best].append(p)
        c = [tuple(sum(v) / len(g) for v in zip(*g)) if g else (math.nan, math.nan) for g in groups]
    return c


def test_kmeans_against_loops():
    rng = np.random.default_rng(3)
    windows = [rng.integers(0, 4, (40, 2)).astype(float) for _ in range(60)]
    windows.append(np.array([[0.0, 0.0]] * 3 + [[1.0, 1.0]] * 5))  # equal seeds: clusters 1 and 2 stay empty
    windows[0][:3] = windows[0][0]
    for w in windows:
        cx, cy, _ = kmeans(w[None, :, 0], w[None, :, 1])
        want = literal_kmeans(w[:, 0].tolist(), w[:, 1].tolist())
        for j in range(3):
            assert (math.isnan(cx[0, j]) and math.isnan(want[j][0])) or (cx[0, j], cy[0, j]) == pytest.approx(want[j])


def test_nan_cluster_0():
    """Nothing is nearer than a NaN distance: from the round in which cluster 0 is NaN, it takes every point."""
    x = np.array([[np.nan, 1.0, 2.0, 3.0, 4.0]])
    cx, _, label = kmeans(x, np.zeros_like(x))
    assert label.tolist() == [[0] * 5] and np.isnan(cx).all()


def test_order(spark):
    df = spark.createDataFrame([("a", w) for w in (0, 1, 2, 4, 5)] + [("b", w) for w in (1, 2)] + [("c", 0)], "key string, wid long")
    assert sorted(map(tuple, order.contiguous_prefix(df, "key").collect())) == [("a", 0), ("a", 1), ("a", 2), ("c", 0)]
    assert order.order_violations(df, "key", "wid").count() == 4
    late = spark.createDataFrame([("a", t, w) for t, w in ((5, 0), (70, 2), (71, 1), (300, 3))] + [("b", 9, 1)], "key string, t long, wid long")
    for stride in (2, 64, 1 << 20):
        got = order.order_violations(late, "key", "t", stride=stride).select("key", "wid", "expected").collect()
        assert sorted(map(tuple, got)) == [("a", 1, 2), ("a", 2, 1), ("b", 1, 0)]


def test_stream_equals_batch(spark, sf, tmp_path):
    """Several micro-batches, then a restart from the checkpoint with more files."""
    w, s = 50, 10
    table = spark.read.parquet(f"{sf}/events.parquet").toPandas()
    (tmp_path / "in").mkdir()
    parts = np.array_split(np.arange(len(table)), 5)

    def put(k):
        spark.createDataFrame(table.iloc[parts[k]]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def go():
        schema = spark.read.parquet(f"{sf}/events.parquet").schema
        e = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = streaming.count_windows(fx.quote_columns(fx.event_columns(e)), "type", "id", ["bid_price", "ask_price"], w, s, vectorised.sums, "sum_bid double, sum_ask double")
        return streaming.run_once(out, str(tmp_path / "out"), str(tmp_path / "state"))

    for k in (0, 1, 2):
        put(k)
        if k:
            go()
    put(3), put(4)
    got = {(r.type, r.wid): (r.sum_bid, r.sum_ask) for r in go().collect()}
    batch = ow.CountWindow(fx.quotes(spark, sf), "type", w, s).apply_batches(["bid_price", "ask_price"], vectorised.sums, "sum_bid double, sum_ask double")
    assert got == {(r.type, r.wid): (r.sum_bid, r.sum_ask) for r in batch.collect()}


def test_sensor_files(spark, tmp_path):
    rows = [(i, 7 - i, 1e6 * i + 0.25, *[(-1) ** c * (c * 1000 + i) for c in range(11)]) for i in range(9)]
    df = spark.createDataFrame(rows, "id int, sid int, timestamp_usec double, " + ", ".join(f"{c} int" for c in sensor64.INTS))
    (tmp_path / "s.bin").write_bytes(b"".join(r.record for r in sensor64.pack(df).orderBy("record").collect()))
    got = sensor64.read(spark, str(tmp_path / "s.bin"), speedup=2.0)
    want = [(*r[:2], r[2] / 2, *r[3:]) for r in rows]
    assert sorted(map(tuple, got.collect())) == want
    assert sensor64.theoretical_rate(df).first().rate == pytest.approx(9 / 8)
    twice = generators.replicate(df.select(F.col("id").cast("long").alias("id"), "timestamp_usec"), 2).orderBy("id").collect()
    assert [r.id for r in twice] == list(range(18)) and twice[9].timestamp_usec == 8e6 + 0.25


def test_generators(spark):
    q = generators.quotes(spark, 20000, 100000.0, [0.5, 0.25, 0.25]).toPandas()
    assert q.bid_price.between(100, 200).all() and q.bid_size.between(0, 199).all()
    assert abs((q.type == 0).mean() - 0.5) < 0.02
    assert q.sort_values("id").timestamp.is_monotonic_increasing
    blocks = generators.arrivals(spark, 1000, 10.0, block=64).toPandas().sort_values("id")
    assert (blocks.gap_usec.cumsum() == blocks.timestamp_usec).all()
    assert abs(blocks.gap_usec.mean() / 1e5 - 1) < 0.1


def test_distribution_file(spark, tmp_path):
    (tmp_path / "d.txt").write_text("3 2\n0 0.5 0.25 0.25\n10.5 0.1 0.2 0.7\n")
    got = sorted((r.at, r.probabilities) for r in generators.read_distribution(spark, str(tmp_path / "d.txt")).collect())
    assert got == [(0.0, [0.5, 0.25, 0.25]), (10.5, [0.1, 0.2, 0.7])]


def test_tuner_log(spark, tmp_path):
    steps = spark.createDataFrame([(1, 384, 10.0, 9.0)], "nw int, batch int, measured double, expected double")
    tuner.write_log(steps, str(tmp_path / "log"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "log")).first().error == "0.1"


def test_tuner():
    order_ = list(tuner.exploration())
    assert len(order_) == len(set(order_)) == 150 and set(order_[:4]) == {(1, 1), (10, 15), (1, 15), (10, 1)}
    found = tuner.tune(lambda n, b: 100.0 * n * b / (1 + b / 3), 1500.0, most=150)
    assert found and 100.0 * found[0] * found[1] / (1 + found[1] / 3) >= 1500.0 * (1 - tuner.ACCEPT)


def test_lines_of_negative_zeros(spark):
    """Coefficients that round to zero keep their sign in lines, as DuckDB's round and printf do."""
    import duckdb

    values = [-0.04, 0.04, -0.0, 0.0, -0.06, 31.47512]
    names = [f"p{k}_{s}" for s in ("bid", "ask") for k in range(3)]
    fits = spark.createDataFrame([("a", 7, 5, *values)], f"type string, wid long, timestamp long, {', '.join(f'{n} double' for n in names)}")
    want = [duckdb.sql(f"select printf('%.3f', round({v!r}::double * 0.01, 3))").fetchall()[0][0] for v in values]
    assert want[:4] == ["-0.000", "0.000", "-0.000", "0.000"]
    lines = sorted(r.line for r in sinks.fitting_lines(queries._in_units(fits)).collect())
    assert lines == ["type=a,Ask,5," + ",".join(want[3:]), "type=a,Bid,5," + ",".join(want[:3])]


def test_package_without_llm():
    """Nothing outside the subpackage imports it."""
    import pathlib
    import re

    root = pathlib.Path(__file__).resolve().parent.parent
    for f in [*(root / "wickerframe").rglob("*.py"), root / "bench.py"]:
        if "llm" not in f.parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", f.read_text(), re.M), f
