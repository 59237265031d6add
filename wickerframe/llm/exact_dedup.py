"""Exact dedup: 128-bit content hashes group the rows, bytes confirm the groups, the smallest id stays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, shared_table, text_of


def normalised(text: Column) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(text_of(text), f"{SPACE}+", " ")


def content_hash(norm: Column) -> Column:
    """128 bits as 16 bytes."""
    return F.unhex(F.md5(norm))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised bytes are. Null texts count as empty, and empty texts are equal to each
    other. A null id never stays where the group has another id; a group of null ids only has a null keep_id and
    one kept row. Of repeated rows (same id and equal text) one is kept. Extra columns are not read.

    Plan: rows are first aggregated by (hash, bytes) with a map-side combine, so a group of copies sends one text
    per map task however many copies it has; grouping compares the bytes. Only groups of two or more are carried
    on, as 16-byte hashes. The rows then meet them in a left join of narrow columns (no text) whose hot keys
    adaptive execution splits. Where two different texts share a hash, their rows are joined by bytes as well.
    """
    norm = normalised(F.col(text_col))
    base = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm"))
    classes = base.groupBy(hash_of(F.col("norm")).alias("h"), "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    groups = classes.groupBy("h").agg(F.count(F.lit(1)).alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("n").alias("n")).where("n > 1")
    groups = shared_table(groups, "dedup-groups")
    collided = groups.where("texts > 1").select(F.col("h").alias("c_h"))

    rows = base.select("doc_id", hash_of(F.col("norm")).alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha"))
    same = groups.where("texts = 1").select(F.col("h").alias("g_h"), "keep_id", "n")
    out = rows.join(same, rows.h == same.g_h, "left").select("doc_id", "h", "sha", F.col("n").isNotNull().alias("grouped"), "keep_id", F.coalesce("n", F.lit(1)).alias("n"))
    if not collided.isEmpty():
        split = classes.join(collided, F.col("h") == F.col("c_h"), "left_semi").select(F.col("h").alias("k_h"), F.col("norm").alias("k_norm"), F.col("keep_id").alias("k_id"), F.col("n").alias("k_n"))
        apart = base.withColumn("h", hash_of(F.col("norm"))).join(split, (F.col("h") == F.col("k_h")) & (F.col("norm") == F.col("k_norm")))
        apart = apart.select("doc_id", "h", F.unhex(F.sha2("norm", 256)).alias("sha"), F.lit(True).alias("grouped"), F.col("k_id").alias("keep_id"), F.col("k_n").alias("n"))
        out = out.join(collided, F.col("h") == F.col("c_h"), "left_anti").unionByName(apart)
    out = out.withColumn("keep_id", F.when(F.col("grouped"), F.col("keep_id")).otherwise(F.col("doc_id")))
    # Rows that repeat an id and a text differ in nothing: one of them is kept. Their numbers are written, so they stay.
    out = shared_table(out.select("doc_id", "sha", "keep_id", "n", F.monotonically_increasing_id().alias("row")), "dedup-rows")
    may = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    again = out.where(may & (F.col("n") > 1)).groupBy(F.col("doc_id").alias("a_id"), F.col("sha").alias("a_sha")).agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    again = shared_table(again.drop("c"), "dedup-repeated")
    if again.isEmpty():
        out = out.withColumn("kept", may)
    else:
        out = out.join(again, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("sha") == F.col("a_sha")), "left")
        out = out.withColumn("kept", may & F.coalesce(F.col("row") == F.col("first"), F.lit(True)))
    return out.select("doc_id", "keep_id", F.col("n").cast("long").alias("group_size"), "kept", F.lower(F.hex("sha")).alias("text_sha256"))
