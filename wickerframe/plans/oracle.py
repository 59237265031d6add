"""For each registered query, SQL that DuckDB runs on the same tables; formulated apart from the engine's plans."""

from __future__ import annotations

from .queries import BATCH, BATCHES, GENERATED, GOAL, KEYS, SMALL_S, TUMBLING, WORKERS, S, W

_E = """e as (select event_id, event_type, user_id, value, (props->>'$.k')::int as k, epoch_us(ts) // 1000 as ms from events)"""

_Q = f"""{_E},
q0 as (select event_type as type, event_id as id, 100.0::double + value as bid_price, 99.0::double + value as ask_price, k % 20 as bid_size,
       case when k % 2 = 0 then 0 else k end as ask_size, (ms // 300000) * 300000 as ots, ms as timestamp from e),
q as (select *, row_number() over (partition by type order by id) - 1 as pos, lag(ots) over (partition by type order by id) as prev from q0)"""


def _windows(w: int, s: int, name: str = "x", source: str = "q") -> str:
    return f"""{name} as (select *, unnest(generate_series(case when pos < {w} then 0 else (pos - {w}) // {s} + 1 end, pos // {s})) as wid from {source})"""


def _cents(c: str) -> str:
    return f"round({c} * 100)::bigint"


def _fit_sums(side: str, kept: str) -> str:
    terms = {"n": "1.0::double", "x": "xs", "xx": "xs*xs", "xxx": "xs*xs*xs", "xxxx": "xs*xs*xs*xs", "y": "y", "xy": "xs*y", "xxy": "xs*xs*y"}
    return ", ".join(f"sum(case when {kept} then {v.replace('y', f'round({side}_price * 100)')} else 0.0::double end) as {side}_{k}" for k, v in terms.items())


def _coefficients(side: str) -> str:
    v = {k: f"{side}_{k}" for k in ("n", "x", "xx", "xxx", "xxxx", "y", "xy", "xxy")}
    below = f"({v['xx']} * {v['xxxx']} - {v['xxx']} * {v['xxx']})"
    a = f"(({v['xxy']} * {v['xx']} - {v['xy']} * {v['xxx']}) / {below})"
    b = f"(({v['xy']} * {v['xxxx']} - {v['xxy']} * {v['xxx']}) / {below})"
    c = f"({v['y']} / {v['n']} - {b} * ({v['x']} / {v['n']}) - {a} * ({v['xx']} / {v['n']}))"
    unit = ("0.01::double", "(0.01::double / (1.0::double / 12.0))", "(0.01::double / (1.0::double / 12.0) / (1.0::double / 12.0))")
    return ", ".join(f"round({e} * {u}, 3) as p{k}_{side}" for k, (e, u) in enumerate(zip((c, b, a), unit)))


def _candle(side: str, valid: str, close: str | None = None) -> str:
    p = f"{side}_price"
    close = close or f"coalesce(arg_max({p}, case when {valid} then pos end), arg_min({p}, pos))"
    return (
        f"coalesce(arg_min({p}, case when {valid} and {p} <> 0 then pos end), 0.0::double) as open_{side}, "
        f"greatest(coalesce(max(case when {valid} then {p} end), 0.0::double), 0.0::double) as high_{side}, "
        f"least(coalesce(min(case when {valid} then {p} end), 10000.0::double), 10000.0::double) as low_{side}, {close} as close_{side}"
    )


_PRICES = ", ".join(f"{p}_{s}" for s in ("bid", "ask") for p in ("open", "high", "low", "close"))


def _q1(w: int, s: int) -> str:
    """CTEs up to r: the whole query 1, from exploded windows."""
    tail = f"pos >= wid * {s} + {w - s}"
    sides = ", ".join(f"{_fit_sums(d, f'{d}_size > 0 and kept')}, {_candle(d, f'{d}_size > 0 and {tail}')}" for d in ("bid", "ask"))
    return f"""{_Q}, {_windows(w, s)},
f as (select *, (ots - first_value(ots) over (partition by type, wid order by pos)) / 300000.0::double as xs, pos = wid * {s} or prev is distinct from ots as kept from x),
g as (select type, wid, count(*) as cnt, arg_max(timestamp, pos) as timestamp, {sides} from f group by type, wid),
r as (select type, wid, timestamp, {_coefficients('bid')}, {_coefficients('ask')}, {_PRICES} from g where cnt = {w})"""


def _flink(w: int, s: int) -> str:
    sides = ", ".join(f"{_fit_sums(d, f'{d}_size > 0')}, {_candle(d, f'{d}_size > 0', f'arg_max({d}_price, pos)')}" for d in ("bid", "ask"))
    return f"""{_Q}, x as (select *, unnest(generate_series(pos // {s}, (pos + {w}) // {s} - 1)) as wid from q),
f as (select *, (ots - first_value(ots) over (partition by type, wid order by pos)) / 300000.0::double as xs from x),
g as (select type, wid, max(pos) as stop, arg_max(timestamp, pos) as timestamp, {sides} from f group by type, wid)
select type, wid, 1 as id, timestamp, {_coefficients('bid')}, {_coefficients('ask')}, {_PRICES} from g where stop = (wid + 1) * {s} - 1"""


def _points(duplicates: bool) -> str:
    x, y = ("floor(value / 100)", "floor(k / 50.0)") if duplicates else ("round(value * 100)", "k")
    return f"""{_E}, p as (select event_id as id, event_id as pos, user_id as sid, ms * 1000.0::double as timestamp_usec, ({x})::double as x, ({y})::double as y, 0.0::double as z, -1 as centroid_id from e)"""


def _kmeans(w: int, s: int, duplicates: bool = False) -> str:
    """CTEs up to c10 (centroids after ten rounds) and t (members with positions in complete windows)."""
    d = [f"sqrt((t.x - c.x{j}) * (t.x - c.x{j}) + (t.y - c.y{j}) * (t.y - c.y{j}))" for j in range(3)]
    lt = lambda a, b: f"(not isnan({a}) and not isnan({b}) and {a} < {b})"
    label = f"case when {lt('d1', 'd0')} then (case when {lt('d2', 'd1')} then 2 else 1 end) else (case when {lt('d2', 'd0')} then 2 else 0 end) end"
    mean = lambda v, j: f"case when count(*) filter (where l = {j}) = 0 then 'nan'::double else sum({v}) filter (where l = {j}) / count(*) filter (where l = {j}) end as {v}{j}"
    rounds = ""
    for k in range(1, 11):
        rounds += f""",
d{k} as materialized (select t.wid, t.x, t.y, {', '.join(f'{e} as d{j}' for j, e in enumerate(d))} from t join c{k - 1} c on t.wid = c.wid),
c{k} as materialized (select wid, {', '.join(f"{mean('x', j)}, {mean('y', j)}" for j in range(3))} from (select *, {label} as l from d{k}) group by wid)"""
    seed = ", ".join(f"max(case when pos = wid * {s} + {j} then {c} end) as {c}{j}" for j in range(3) for c in ("x", "y", "id", "sid"))
    return f"""{_points(duplicates)}, {_windows(w, s, 'x0', 'p')},
n as (select wid from x0 group by wid having count(*) = {w}),
t as materialized (select x0.* from x0 join n on x0.wid = n.wid),
s0 as materialized (select wid, max(timestamp_usec) as timestamp, {seed} from t group by wid),
c0 as materialized (select wid, x0, y0, x1, y1, x2, y2 from s0){rounds}""", d, label


def _kmeans_result(w: int, s: int, duplicates: bool = False) -> str:
    nan = lambda v: f"case when not isnan(c.{v}) then c.{v} end"
    cells = ", ".join(f"s0.id{j} as c{j}_id, s0.sid{j} as c{j}_sid, {nan(f'x{j}')} as c{j}_x, {nan(f'y{j}')} as c{j}_y" for j in range(3))
    return f"with {_kmeans(w, s, duplicates)[0]} select s0.wid, s0.timestamp, {cells} from s0 join c10 c on s0.wid = c.wid"


def _kmeans_assignment(w: int, s: int) -> str:
    text, d, label = _kmeans(w, s)
    cells = ", ".join(f"case when not isnan(max(x{j})) then max(x{j}) end as c{j}_x, count(*) filter (where l = {j}) as n{j}" for j in range(3))
    return f"""with {text}, f as (select t.wid, c.x0, c.x1, c.x2, {', '.join(f'{e} as d{j}' for j, e in enumerate(d))} from t join c10 c on t.wid = c.wid)
select wid, {cells} from (select *, {label} as l from f) group by wid"""


_RESULTS = f"""{_Q}, {_windows(W, S)}, res as (select type, wid, max(timestamp) as timestamp from x group by type, wid having count(*) = {W})"""
_GAPPY = f"{_RESULTS}, gappy as (select * from res where wid % 7 <> 3)"
_THROUGHPUT = f"{_E}, th as (select event_type as type, ms // 86400000 as bucket, count(*) as n from e group by all)"
_VARIATION = f"""{_THROUGHPUT}, v as (select *, case when count(n) over w = 3 then avg(n) over w end as mean, case when count(n) over w = 3 then stddev_samp(n) over w / avg(n) over w end as cv
from th window w as (partition by type order by bucket rows between 2 preceding and current row))"""
_LATENCY = f"""{_Q}, li as (select type, timestamp // 86400000 as bucket, count(*) as results, avg(timestamp - ots) as avg_latency from q group by all)"""
_CONFIGS = """conf as (select nw::int as nw, (b * 384)::int as batch, nw * (b * 384) / (1.0::double + (b * 384) / 1000.0::double) as thr from range(1, 11) as r(nw), range(1, 16) as s(b)),
confs as (select *, thr * (1.0::double + ((nw * 7 + batch) % 11 - 5) / 100.0::double) as thr2 from conf)"""
_ERRORS = f"""{_CONFIGS}, err as (select nw, batch, abs(trunc(thr - thr2)::int) / thr as error from confs)"""
_RUNS = """runs as (select device, w, s, run, nw, factor * 1000000.0::double / w * (1 + (run * 5 + nw * 3 + s) % 7 / 10.0::double) as results_per_sec
from (values ('cpu', 1.0::double), ('gpu', 7.3::double)) d(device, factor), (values (10000), (25000), (50000)) a(w), (values (5), (25), (100)) b(s), (values (1), (2), (3)) c(run), (values (8), (9), (10), (11)) n(nw)),
ra as (select device, w, s, nw, avg(results_per_sec) as mean, stddev_pop(results_per_sec) as deviation from runs group by all),
mr as (select w, s, max(case when device = 'cpu' then mean * s end) as max_cpu, max(case when device = 'gpu' then mean * s end) as max_gpu from ra group by all)"""
_SENSOR_INTS = ("x", "y", "z", "v", "a", "vx", "vy", "vz", "ax", "ay", "az")
_SENSOR = f"""{_E}, sen as (select event_id::int as id, user_id::int as sid, ms * 1000.0::double as timestamp_usec, {', '.join(f'(k * {n + 1} - 40)::int as {c}' for n, c in enumerate(_SENSOR_INTS))} from e)"""
_ROWS, _STEP = W + (BATCH - 1) * S, S * BATCH


def _u(seed: int) -> str:
    return f"((('0x' || substr(md5('{seed}:' || id), 1, 12))::bigint::double + 0.5) / 281474976710656.0)"


def _lines(rows: str, cells: str) -> str:
    one = lambda side: f"'type=' || type || ',{side},' || timestamp || ',' || " + " || ',' || ".join(f"printf('%.3f', {c}_{side.lower()})" for c in cells.split())
    return f"select type, wid, {one('Bid')} as line from {rows} union all select type, wid, {one('Ask')} as line from {rows}"


def _pivot(rows: str, value: str) -> str:
    return f"select nw, {', '.join(f'max(case when batch = {b} then {value} end) as b{b}' for b in BATCHES)} from {rows} group by nw"


def _key_case(u: str) -> str:
    total, out = 0.0, "case"
    for k, p in enumerate(KEYS[:-1]):
        total += p
        out += f" when {u} < {total!r}::double then {k}"
    return f"{out} else {len(KEYS) - 1} end"


_CANDLE = f"""{_Q}, {_windows(W, SMALL_S)}, r as (select type, wid, arg_max(timestamp, pos) as timestamp, {', '.join(_candle(d, f'{d}_size > 0 and pos >= wid * {SMALL_S} + {W - SMALL_S}') for d in ('bid', 'ask'))} from x group by type, wid having count(*) = {W})"""


def oracle_sql() -> dict[str, str]:
    sums = f"select type, wid, sum({_cents('bid_price')}) / 100.0::double as sum_bid, sum({_cents('ask_price')}) / 100.0::double as sum_ask from x group by type, wid having count(*) = {W}"
    fits = ", ".join(f"p{k}_{s}" for s in ("bid", "ask") for k in range(3))
    pane = f"select type, pos // 10 as pane, count(*) as n, sum({_cents('bid_price')})::bigint as sum_bid, max(ask_price) as max_ask from q group by type, pos // 10 having count(*) = 10"
    ten = "floor({0} * 10 + 0.5) / 10.0"
    cell = lambda c: f"case when isnan({c}) then 'nan' else printf('%.1f', {ten.format(c)}) end"
    return {
        "count_window_sum": f"with {_Q}, {_windows(W, S)} {sums}",
        "count_window_tumbling": f"with {_Q} select type, pos // {TUMBLING} as wid, count(*) as n, sum({_cents('bid_price')})::bigint as sum_bid, min(bid_price) as min_bid, max(bid_price) as max_bid from q group by type, pos // {TUMBLING} having count(*) = {TUMBLING}",
        "count_window_frame": f"with {_Q}, {_windows(W, S)} select type, wid, max(bid_price) as max_bid, min(ask_price) as min_ask from x group by type, wid having count(*) = {W}",
        "window_assign": f"with {_Q}, {_windows(W, S)} select type, id, pos, wid from x",
        "worker_route": f"with {_Q}, {_windows(W, S)}, y as (select *, row_number() over (partition by id order by wid) as nth from x) select type, id, pos, wid % {WORKERS} as worker from y where nth <= {WORKERS}",
        "copies_per_tuple": f"with {_Q}, {_windows(W, S)}, n as (select id, type, least(count(*), {WORKERS}) as c from x group by id, type) select type, avg(c) as avg_copies, max(c) as max_copies from n group by type",
        "batch_assign": f"with {_Q}, y as (select *, unnest(generate_series(case when pos < {_ROWS} then 0 else (pos - {_ROWS}) // {_STEP} + 1 end, pos // {_STEP})) as batch from q) select type, id, pos, batch from y",
        "batch_indexes": f"select i, i * {S} as start, i * {S} + {W} as stop from range({BATCH}) r(i)",
        "partial_indexes": f"""with {_E}, n as (select event_type as type, count(*) as n from e group by 1), f as (select *, case when n < {_ROWS} then 0 else (n - {_ROWS}) // {_STEP} + 1 end as full_ from n),
g as (select type, full_ * {BATCH} as first_, n - full_ * {_STEP} as m from f), h as (select type, first_, m, unnest(range(0, 1000)) as i from g)
select type, first_ + i as wid, i * {S} as start, i * {S} + {W} as stop from h where i * {S} + {W} <= m""",
        "cpu_batch_size": f"select p, case when p = 1 then 1 else ceil(({W} - {SMALL_S})::double / ({SMALL_S} * p - {SMALL_S}))::bigint end as batch from range(1, 11) r(p)",
        "batched_windows": f"with {_Q}, {_windows(W, S)} {sums}",
        "pane_aggregate": f"with {_Q} {pane}",
        "pane_window_combine": f"with {_Q}, {_windows(W, S)} select type, wid, count(*) as n, sum({_cents('bid_price')})::bigint as sum_bid, max(ask_price) as max_ask from x group by type, wid having count(*) = {W}",
        "flink_count_window": f"with {_Q} select a.type, a.pos // {S} as wid, count(*) as n, sum({_cents('b.bid_price')})::bigint as sum_bid from q a join q b on a.type = b.type and b.pos between a.pos - {W - 1} and a.pos where (a.pos + 1) % {S} = 0 group by a.type, a.pos",
        "kf_count_window": f"""with {_E}, q as (select event_id % {WORKERS} as worker, {_cents('value')} as cents, row_number() over (partition by event_id % {WORKERS} order by event_id) - 1 as pos from e), {_windows(W, S)}
select worker, wid, sum(cents)::bigint as sum_cents from x group by worker, wid having count(*) = {W}""",
        "filter_hook": f"with {_E} select event_type as type, event_id as id, row_number() over (partition by event_type order by event_id) - 1 as pos from e where k % 10 <> 0",
        "sequence_by_key": f"with {_Q} select type, id, pos from q",
        "project_points": f"with {_points(False)} select id, sid, timestamp_usec, x, y, z, centroid_id from p",
        "dedup_runs": f"with {_Q}, {_windows(W, S)}, l as (select *, lag(ots) over (partition by type, wid order by pos) as before from x) select type, wid, count(*) filter (where before is distinct from ots) as kept from l group by type, wid having count(*) = {W}",
        "distance_to_seed": f"with {_points(False)} select p.id, p.id // {TUMBLING} as wid, sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)) as distance from p join p s on s.id = (p.id // {TUMBLING}) * {TUMBLING}",
        "parabola_eval": f"with {_q1(W, S)} select type, wid, round(p0_bid + p1_bid * 2.0::double + p2_bid * 2.0::double * 2.0::double, 6) as at2_bid, round(p0_ask + p1_ask * 2.0::double + p2_ask * 2.0::double * 2.0::double, 6) as at2_ask from r",
        "quad_fit": f"with {_q1(W, S)} select type, wid, {fits} from r",
        "candlestick": f"with {_CANDLE} select * from r",
        "q1_financial": f"with {_q1(W, SMALL_S)} select * from r",
        "q1_flink_variant": f"with {_flink(W, S)}",
        "q2_kmeans": _kmeans_result(W, S),
        "q2_kmeans_dup": _kmeans_result(W, S, True),
        "q2_kmeans_assign": _kmeans_assignment(W, S).replace("count(*) filter (where l = 0) as n0", "count(*) filter (where l = 0) as n0"),
        "ordered_results": f"with {_RESULTS} select * from res order by type, wid",
        "contiguous_prefix": f"with {_GAPPY}, n as (select *, row_number() over (partition by type order by wid) - 1 as nth from gappy) select type, wid, timestamp from n where nth = wid",
        "order_violations": f"with {_GAPPY}, n as (select *, row_number() over (partition by type order by timestamp) - 1 as expected from gappy) select type, wid, expected from n where expected <> wid",
        "candle_lines": f"with {_CANDLE} {_lines('r', 'open low high close')}",
        "fitting_lines": f"with {_q1(W, S)} {_lines('r', 'p0 p1 p2')}",
        "cluster_lines": f"with {_kmeans(W, S)[0]} select s0.wid, concat_ws(chr(9), {cell('s0.timestamp')}, {', '.join(cell(f'c.{a}{j}') for j in range(3) for a in 'xy')}) as line from s0 join c10 c on s0.wid = c.wid",
        "throughput_per_second": f"with {_E} select ms // 3600000 as bucket, count(*) as n from e group by 1",
        "throughput_running_avg": f"with {_THROUGHPUT} select *, avg(case when n <> 0 then n end) over (partition by type order by bucket rows between unbounded preceding and current row) as running_avg from th",
        "throughput_stable": f"with {_VARIATION} select type, bucket, n, round(mean, 6) as mean, round(cv, 6) as cv from v where cv <= 0.05",
        "throughput_stable_cv2": f"""with {_VARIATION}, u as (select *, case when count(cv) over w = 3 then stddev_samp(cv) over w / avg(cv) over w end as c2 from v where cv is not null window w as (partition by type order by bucket rows between 2 preceding and current row))
select type, bucket, n, round(mean, 6) as thr_mean, round(cv, 6) as thr_cv, round(c2, 6) as cv_of_cvs from u where cv > 0.05 and c2 <= 0.15""",
        "latency_per_interval": f"with {_LATENCY} select type, bucket, results, round(avg_latency, 6) as avg_latency from li",
        "avg_latency": f"with {_LATENCY} select type, round(avg(avg_latency), 6) as mean_of_means, round(sum(avg_latency * results) / sum(results), 6) as mean_of_results, sum(results)::bigint as results from li group by type",
        "results_per_sec": f"with {_RESULTS} select type, count(*) as results, round(count(*) / ((max(timestamp) - min(timestamp)) / 1000.0::double), 6) as results_per_sec from res group by type",
        "config_grid": f"with {_CONFIGS} select nw, batch from conf",
        "target_config": f"with {_CONFIGS} select nw, batch, thr from conf where abs(least(thr, {GOAL}) - {GOAL}) / {GOAL} <= 0.05 order by nw, batch limit 1",
        "accepted_configs": f"with {_CONFIGS} select nw, batch, thr from conf where abs(thr - {GOAL}) / {GOAL} <= 0.04",
        "partial_grid": f"with {_CONFIGS}, id as (select nw, batch, nw || ':' || batch as id from conf) select nw, batch from id where {_u(1)} < 0.2::double",
        "best_config": f"with {_CONFIGS} select nw, batch, thr from conf order by thr desc, nw, batch limit 1",
        "best_neighbor": f"""with {_CONFIGS}, n as (select a.nw, a.batch, b.nw as n_nw, b.batch as n_batch, b.thr as n_thr, row_number() over (partition by a.nw, a.batch order by b.thr desc, b.nw, b.batch) as k
from conf a join conf b on a.nw - b.nw between 0 and 1 and a.batch - b.batch in (0, 384) and (a.nw <> b.nw or a.batch <> b.batch)) select nw, batch, n_nw, n_batch, n_thr from n where k = 1""",
        "heatmap_rate": f"with {_CONFIGS} {_pivot('conf', f'thr * {S}')}",
        "heatmap_error": f"with {_ERRORS} {_pivot('err', 'error')}",
        "heatmap_error_summary": f"with {_ERRORS} select round(avg(error), 6) as avg_error, round(least(min(error), 1.0::double), 6) as min_error, round(greatest(max(error), 0.0::double), 6) as max_error from err",
        "run_average": f"with {_RUNS} select device, w, s, nw, round(mean, 6) as mean, round(deviation, 6) as deviation from ra",
        "input_rate": f"with {_RUNS} select device, w, s, nw, run, round(results_per_sec * s, 6) as tuples_per_sec from runs",
        "max_rate": f"with {_RUNS} select w, s, round(max_cpu, 6) as max_cpu, round(max_gpu, 6) as max_gpu from mr",
        "speedup_table": f"with {_RUNS} select s, {', '.join(f'max(case when w = {w} then floor(max_gpu / max_cpu * 100) / 100 end) as w{w}' for w in (10000, 25000, 50000))} from mr group by s",
        "gen_keys": f"select id, {_key_case(_u(5))} as type from range({GENERATED}) r(id)",
        "gen_quotes": f"""with g as (select id, round(-10.0::double * ln({_u(1)}))::bigint as gap from range({GENERATED}) r(id)),
a as (select id, (sum(gap) over (order by id))::bigint as t from g)
select id, {_key_case(_u(11))} as type, 100 + 100 * {_u(12)} as bid_price, floor(200 * {_u(13)})::int as bid_size, 100 + 100 * {_u(14)} as ask_price, floor(200 * {_u(15)})::int as ask_size,
(t // 1000) * 1000 as original_timestamp, t as timestamp from a""",
        "rng_distributions": f"""with r as (select id, {_u(1)} as u, {_u(2)} as v, {_u(3)} as w from range({GENERATED}) r(id))
select id, round(u, 6) as uniform, round(-2.0::double * ln(u), 6) as exponential, round(-1.0::double * ln(u * v * w), 6) as erlang,
round(case when u < 0.3::double then -(1.0::double / 0.6::double) * ln(v) else -(1.0::double / 1.4::double) * ln(v) end, 6) as hyperexponential,
round(case when u < 0.25::double then 1.0::double + sqrt(u * 4.0::double) else 5.0::double - sqrt((1 - u) * 4.0::double * 3.0::double) end, 6) as triangular,
round(10.0::double + 2.0::double * (sqrt(-2 * ln(u)) * cos(6.283185307179586::double * v)), 6) as normal from r""",
        "gen_arrivals": f"with g as (select id, round(-1000.0::double * ln({_u(1)}))::bigint as gap_usec from range({GENERATED}) r(id)) select id, gap_usec, (sum(gap_usec) over (order by id))::bigint as timestamp_usec from g",
        "read_sensor64": f"with {_SENSOR} select * from sen",
        "speedup_ts": f"with {_SENSOR} select id, timestamp_usec / 80.0::double as timestamp_usec from sen",
        "theoretical_rate": f"with {_SENSOR} select round(count(*) / ((max(timestamp_usec) - min(timestamp_usec)) / 1e6::double), 9) as rate from sen",
        "replicate_stream": f"""with {_SENSOR}, f as (select count(*) as n, max(timestamp_usec)::bigint - min(timestamp_usec)::bigint as span from sen)
select rep::int as rep, rep * n + id as id, timestamp_usec::bigint + rep * span as timestamp_usec from sen, f, range(3) r(rep)""",
        "source_rate": f"with {_SENSOR} select floor(timestamp_usec / 1000.0::double / 86400000)::bigint as bucket, count(*) as n from sen group by 1",
        "interdep_sample": f"with {_E}, l as (select event_id as id, ms - lag(ms) over (order by event_id) as gap_ms from e) select id, gap_ms from l where id % 1024 = 0 and gap_ms is not null",
        "stream_count_window": f"with {_Q}, {_windows(W, S)} {sums}",
        "stream_q1": f"with {_q1(W, S)} select * from r",
    }
