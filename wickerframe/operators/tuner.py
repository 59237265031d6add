"""Configuration search: a grid of (workers, batch), its measured throughput, and how the next one is chosen."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Grid: workers 1..10 and batches 384, 768, ... 5760. Tolerances of search, acceptance and refinement.
WORKERS, THREADS, LARGEST = 10, 384, 5760
SEARCH, ACCEPT, REFINE = 0.05, 0.04, 0.02


def config_grid(spark: SparkSession, workers: int = WORKERS, threads: int = THREADS, largest: int = LARGEST) -> DataFrame:
    """All configurations: a few hundred rows whatever the data."""
    nw = spark.range(1, workers + 1, 1, 1).select(F.col("id").cast("int").alias("nw"))
    return nw.withColumn("batch", F.explode(F.sequence(F.lit(threads), F.lit(largest), F.lit(threads))))


def miss(thr: Column, goal: Column | float) -> Column:
    goal = F.lit(goal) if isinstance(goal, float) else goal
    return F.abs(F.least(thr, goal) - goal) / goal


def target_config(configs: DataFrame, goal: float, tolerance: float = SEARCH) -> DataFrame:
    """The first configuration, by workers and then batch, that reaches the goal within the tolerance."""
    return configs.where(miss(F.col("thr"), goal) <= tolerance).orderBy("nw", "batch").limit(1)


def accepted(configs: DataFrame, goal: float, tolerance: float = ACCEPT) -> DataFrame:
    """Configurations whose measured throughput is the goal within the tolerance, on either side."""
    return configs.where(F.abs(F.col("thr") - goal) / goal <= tolerance)


def partial_grid(spark: SparkSession, share: float = 0.2, seed: int = 1) -> DataFrame:
    """The configurations an exhaustive search samples: about a share of the grid, the same ones for a seed."""
    from ..sources.generators import uniform

    return config_grid(spark).where(uniform(F.concat_ws(":", "nw", "batch"), seed) < share)


def write_log(steps: DataFrame, path: str) -> None:
    """A tuner's measurements (nw, batch, measured, expected) as tab-separated text with a header."""
    steps.withColumn("error", F.abs(F.col("measured") - F.col("expected")) / F.col("measured")).write.mode("error").option("sep", "\t").option("header", True).csv(path)


def best_config(configs: DataFrame) -> DataFrame:
    """The configuration of highest throughput; of equals the smallest."""
    best = F.max_by(F.struct("nw", "batch", "thr"), F.struct("thr", -F.col("nw"), -F.col("batch"))).alias("b")
    return configs.agg(best).select("b.*")


def best_neighbor(configs: DataFrame, threads: int = THREADS) -> DataFrame:
    """For each configuration, of those one step down in workers, batch or both, the one of highest throughput."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, 0), (1, 1))])
    here = configs.select("nw", "batch", F.explode(steps).alias("s")).select("nw", "batch", (F.col("nw") - F.col("s.i")).alias("n_nw"), (F.col("batch") - F.col("s.j") * threads).alias("n_batch"))
    near = configs.select(F.col("nw").alias("n_nw"), F.col("batch").alias("n_batch"), F.col("thr").alias("n_thr"))
    best = F.max_by(F.struct("n_nw", "n_batch", "n_thr"), F.struct("n_thr", -F.col("n_nw"), -F.col("n_batch"))).alias("b")
    return here.join(near, ["n_nw", "n_batch"]).groupBy("nw", "batch").agg(best).select("nw", "batch", "b.*")


def _halton(index: int, base: int) -> float:
    value, part = 0.0, 1.0
    while index:
        part /= base
        value += part * (index % base)
        index //= base
    return value


def exploration(workers: int = WORKERS, batches: int = LARGEST // THREADS) -> Iterator[tuple[int, int]]:
    """Order in which a tuner samples the grid: the corners, then a low-discrepancy sequence without repeats."""
    seen: set[tuple[int, int]] = set()
    corners = [(1, 1), (workers, batches), (1, batches), (workers, 1)]
    index = 0
    while len(seen) < workers * batches:
        if corners:
            found = corners.pop(0)
        else:
            index += 1
            found = int(_halton(index, 2) * workers) + 1, int(_halton(index, 3) * batches) + 1
        if found not in seen:
            seen.add(found)
            yield found


def interpolate(known: dict[tuple[int, int], float], nw: int, batch: int) -> float:
    """Throughput of a configuration: measured, or the mean of the measured ones weighted by inverse squared
    distance on the unit grid."""
    if (nw, batch) in known:
        return known[nw, batch]
    weight = {k: 1.0 / (((k[0] - nw) / WORKERS) ** 2 + ((k[1] - batch) * THREADS / LARGEST) ** 2) for k in known}
    return sum(w * known[k] for k, w in weight.items()) / sum(weight.values())


def tune(measure: Callable[[int, int], float], rate: float, most: int = 30) -> tuple[int, int] | None:
    """Sample, interpolate and test until a configuration sustains the rate; then step down while it still does."""
    known: dict[tuple[int, int], float] = {}
    found = None
    for point in exploration():
        if len(known) >= most:
            break
        known[point] = min(rate, measure(*point))
        if len(known) < 4:
            continue
        grid = ((n, b) for n in range(1, WORKERS + 1) for b in range(1, LARGEST // THREADS + 1))
        guess = next((g for g in grid if abs(min(interpolate(known, *g), rate) - rate) / rate <= SEARCH), None)
        if guess and guess not in known:
            known[guess] = min(rate, measure(*guess))
        if guess and abs(known[guess] - rate) / rate <= ACCEPT:
            found = guess
            break
    while found:
        near = [(found[0] - i, found[1] - j) for i, j in ((0, 1), (1, 0), (1, 1)) if found[0] > i and found[1] > j]
        best = max(near, key=lambda k: interpolate(known, *k), default=None)
        if best is None:
            break
        known[best] = min(rate, measure(*best))
        if abs(known[best] - rate) / rate > REFINE:
            break
        found = best
    return found
