"""A corpus pipeline: toxicity, exact dedup, near-duplicate join, source mixing, BPE.

Each stage takes the documents its predecessor kept and decides over all of them. run() writes each stage's result as
Parquet into the folder all executors share and reads it again, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickerframe.llm import queries as q
from wickerframe.llm import toxicity
from wickerframe.llm.exact_dedup import exact_dedup, normalised
from wickerframe.llm.mixing import exponential_key, mix, quality_weight, take
from wickerframe.llm.ngram_jaccard import jaccard_components
from wickerframe.llm.shared import n_words, passing_tables, shared_table, text_of


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model learns from the training fold's labels. Documents with a
    null or empty text score low and stay; repeated rows are judged alike."""
    scored = toxicity.score(docs, q.toxicity_model(docs, sf_dir), name="_wf_toxicity_score")
    return scored.where(F.col("_wf_toxicity_score") < toxicity.THRESHOLD).drop("_wf_toxicity_score")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the smallest id. Of repeated rows one stays; of a
    group without ids, one row stays as well."""
    verdicts = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("_wf_k_id"), F.col("text_sha256").alias("_wf_k_sha"))
    return _keep_once(docs, verdicts)


def _keep_once(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs whose id and text are listed, each listed pair once."""
    own = docs.withColumn("_wf_k_own", F.sha2(normalised(F.col("text")), 256))
    # Ids are compared with null as a value; the digest tells rows apart that repeat an id.
    found = own.join(kept, F.col("doc_id").eqNullSafe(F.col("_wf_k_id")) & (F.col("_wf_k_own") == F.col("_wf_k_sha")), "left_semi")
    found = shared_table(found, "pipeline-kept")
    repeated = found.groupBy("doc_id", "_wf_k_own").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    if repeated.isEmpty():
        return found.drop("_wf_k_own")
    return found.dropDuplicates(["doc_id", "_wf_k_own"]).drop("_wf_k_own")


def _ids_repeat(docs: DataFrame) -> bool:
    return not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty()


def _own_digest(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_wf_own", F.sha2(normalised(F.col("text")), 256))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: the one with the smallest id. Documents without words link
    with nothing and stay, and so do rows without an id. Rows that share an id are told apart by their text; of
    those with the smallest id of a group the one with the smallest digest stays."""
    known = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    if not _ids_repeat(known):
        verdicts = jaccard_components(docs.select("doc_id", "text"))
        gone = verdicts.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("_wf_g_id"))
        return docs.join(gone, F.col("doc_id") == F.col("_wf_g_id"), "left_anti")
    # Each id and text has a number of its own, and the groups are of these.
    nodes = _own_digest(known).dropDuplicates(["doc_id", "_wf_own"]).withColumn("node", F.monotonically_increasing_id())
    nodes = shared_table(nodes, "pipeline-nodes")
    names = nodes.select("node", F.struct("doc_id", "_wf_own").alias("name"))
    verdicts = shared_table(jaccard_components(nodes, id_col="node").select(F.col("doc_id").alias("node"), "component_id").join(names, "node"), "pipeline-verdicts")
    first = verdicts.groupBy("component_id").agg(F.min("name").alias("first"))
    gone = verdicts.join(first, "component_id").where("name != first").select(F.col("name.doc_id").alias("_wf_g_id"), F.col("name._wf_own").alias("_wf_g_own"))
    return _own_digest(docs).join(gone, (F.col("doc_id") == F.col("_wf_g_id")) & (F.col("_wf_own") == F.col("_wf_g_own")), "left_anti").drop("_wf_own")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, whole: the document at a budget's edge is taken if that comes
    nearer to its source's target. Documents without words have no size and are not taken. Rows that share an id are
    told apart by their text and source; of rows that are equal in all three the first stands for them all, as often
    as the mix takes them together."""
    repeat = _ids_repeat(docs)
    if repeat:
        text, source = text_of(F.col("text")), F.col("source").cast("string")
        own = _own_digest(docs).withColumn("_wf_own", F.struct("_wf_own", source.alias("source")))
        first = own.dropDuplicates(["doc_id", "_wf_own"])
        sized = own.select("doc_id", source.alias("source"), "_wf_own", text.alias("t"), n_words(text).alias("size"))
        key = exponential_key(F.col("doc_id"), quality_weight(F.col("t"), F.col("size")), "mix")
        # The name sorts as mix() sorts its ties.
        sized = sized.select(F.struct("doc_id", "size", "_wf_own").alias("doc_id"), "source", "size", key.alias("key"))
        taken = take(shared_table(sized, "mix-sizes"), cut_last=False).select(F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id._wf_own").alias("_wf_t_own"), "size", "taken")
    else:
        first = docs
        taken = mix(docs, cut_last=False)
    by = ["_wf_t_id", "_wf_t_own"] if repeat else ["_wf_t_id"]
    times = taken.where("taken > 0").withColumnRenamed("doc_id", "_wf_t_id").withColumn("_wf_times", (F.col("taken") / F.col("size")).cast("int")).groupBy(*by).agg(F.sum("_wf_times").cast("int").alias("_wf_times"))
    same = F.col("doc_id").eqNullSafe(F.col("_wf_t_id"))
    joined = first.join(times, same & F.col("_wf_own").eqNullSafe(F.col("_wf_t_own")) if repeat else same)
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("_wf_times"))).alias("_wf_mix_copy")).drop("_wf_mix_copy")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and decoded text."""
    return q.bpe_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near-duplicate join", drop_near_copies),
    ("source mixing", mix_sources),
    ("bpe", encode),
]

#: A trained classifier and a tokenizer are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = "stage-" + STAGES[-1][0].replace(" ", "-")
    with passing_tables(last):
        for name, stage in STAGES:
            label = "stage-" + name.replace(" ", "-")
            with passing_tables("stage-"):  # what a stage wrote besides its result goes with it
                docs = shared_table(stage(spark, docs, sf_dir), label)
    return docs
