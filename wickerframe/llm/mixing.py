"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the exponential key -ln(u) / w, where u in (0, 1) is a hash of its id and w its quality
weight; taking a source's documents by ascending key is weighted sampling without replacement. A source whose
target is above its size first gives complete epochs, then a fraction of one by key up to the word budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import n_words, shared_table, source_rank_key, text_of

WEIGHTS = (3, 1, 2)
TOTAL = 1.5
MOST = 2.0
#: Documents a key bucket aims at.
BUCKET_ROWS = 2048


def quality_weight(text: Column, size: Column) -> Column:
    """Where no column of scores is given: the share of words left when one is taken off for each of the characters
    #*$%&|<>!, and a tenth at least; a tenth for texts without words."""
    marks = F.regexp_count(text, F.lit("[#*$%&|<>!]"))
    return F.when(size > 0, F.greatest(F.lit(0.1), F.lit(1.0) - marks / size)).otherwise(F.lit(0.1))


def exponential_key(doc_id: Column, weight: Column, seed: str) -> Column:
    """-ln(u) / w; u is made from 48 bits of a hash of seed and id and lies inside (0, 1)."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))
    return -F.log(u) / weight


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """Per source: source, source_size, docs, target.

    Sources in code point order, null last, take the weights in turn and share total x all words. A target stops
    at most x its source's size; the excess is shared again among the rest by weight, until none is above. A round is
    one aggregate over the sources and one row to the driver; rounds end when no further source is full.

    Sources may be millions (domains): they are ranked by ranges, and each range's rank is shifted by the ranges before.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    order = source_rank_key(F.col("source"))
    per = shared_table(per.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "mix-sources")
    part = F.shiftright("at", 33)
    before, shift = 0, {}
    for r in per.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():  # a row a range
        shift[r.part], before = before, before + r.n
    shifts = per.sparkSession.createDataFrame(list(shift.items()), "part long, before long")
    rank = F.col("at") - F.shiftleft(part, 33) + F.col("before")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = per.join(F.broadcast(shifts), part == F.col("part")).withColumn("weight", F.element_at(cycle, (rank % len(weights) + 1).cast("int"))).withColumn("cap", most * F.col("source_size"))

    level, full = 0.0, F.lit(False)
    while True:
        words, caps, left = ranked.agg(F.sum("source_size"), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not left:  # no source, or all are full
            break
        now = (total * words - (caps or 0.0)) / left
        if now == level:
            break
        level = now
        full = F.col("weight") * F.lit(level) >= F.col("cap")
    target = F.when(full, F.col("cap")).otherwise(F.col("weight") * F.lit(level))
    return ranked.select("source", F.col("source_size").cast("long").alias("source_size"), "docs", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST, cut_last: bool = True, weight_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken (words the mix takes, repeats counted).

    taken = epochs x size for every document, plus the fraction: by ascending key whole documents until the next
    would pass the budget. That next one gives only the words that are left, so a source's taken words equal its
    target but for rounding; with cut_last=False it is taken whole if that comes nearer to the target, else left.
    No document is taken more than `most` times. Null texts have size 0 and take 0; a null source is a source of its
    own. weight_col names quality weights above 0 (null, NaN and others count as 0.001); without it quality_weight
    gives them. Ties in key are broken by id, then size; repeated rows are separate documents. An empty table gives an
    empty result. Reruns agree, as keys are hashes.

    Plan: one pass over the texts makes a narrow table of sizes and keys (written to the shared folder). A
    running sum over a hot source's keys is not one task's work: keys are cut into buckets of about 2,048
    documents, bucket sums are summed up per source, and only the bucket in which the budget ends is ordered
    row by row. What every document has to know of its source is one row a source, joined by a plain equi-join:
    Catalyst broadcasts it if it is measured small, and adaptive execution splits a hot source if not.
    """
    given = [] if weight_col is None else [F.col(weight_col).cast("double").alias("w")]
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), text_of(F.col(text_col)).alias("t"), *given).withColumn("size", n_words(F.col("t")))
    weight = quality_weight(F.col("t"), F.col("size")) if weight_col is None else F.when((F.col("w") > 0) & ~F.isnan("w"), F.col("w")).otherwise(F.lit(0.001))
    sized = sized.select("doc_id", "source", "size", exponential_key(F.col("doc_id"), weight, seed).alias("key"))
    return take(shared_table(sized, "mix-sizes"), weights, total, most, cut_last)


def take(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST, cut_last: bool = True) -> DataFrame:
    """mix() from (doc_id, source, size, key)."""
    goal = targets(sized, weights, total, most)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    goal = goal.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("buckets", F.ceil(F.col("docs") / BUCKET_ROWS))
    goal = shared_table(goal.select("source", "source_size", "target", "epochs", "budget", "buckets"), "mix-goals")
    bucket = F.floor((1 - F.exp(-F.col("key"))) * F.col("buckets")).alias("bucket")
    g = goal.select(F.col("source").alias("g_source"), "source_size", "target", "epochs", "budget", "buckets")
    rows = sized.join(g, F.col("source").eqNullSafe(F.col("g_source"))).select("doc_id", "source", "size", "key", "source_size", "target", "epochs", "budget", bucket)

    sums = rows.groupBy("source", "budget", "bucket").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("after", F.sum("words").over(upto)).where(F.col("after") >= F.col("budget"))
    edge = sums.groupBy("source").agg(F.min(F.struct("bucket", (F.col("after") - F.col("words")).alias("before"))).alias("edge"))
    edge = shared_table(edge.select(F.col("source").alias("e_source"), F.col("edge.bucket").alias("e_bucket"), F.col("edge.before").alias("e_before")), "mix-edges")

    rows = rows.join(edge, F.col("source").eqNullSafe(F.col("e_source")), "left")
    inside = F.col("bucket") == F.col("e_bucket")
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = rows.where(inside).withColumn("left", F.col("budget") - F.col("e_before") - F.coalesce(F.sum("size").over(order), F.lit(0)))
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.round("left").cast("long")))
    if not cut_last:
        part = F.when(F.col("left") * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    at_edge = at_edge.withColumn("part", F.when(F.col("left") > 0, part).otherwise(F.lit(0)))
    away = rows.where(F.coalesce(~inside, F.lit(True))).withColumn("part", F.when(F.col("bucket") < F.col("e_bucket"), F.col("size")).otherwise(F.lit(0)))
    out = away.unionByName(at_edge.drop("left"))
    return out.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"))
