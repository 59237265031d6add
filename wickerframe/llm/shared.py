"""What the operators of this subpackage have in common: words and shared tables."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space is these six characters and nothing else; a word is a run of any others.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_own_root: str | None = None
#: Tables in the shared folder, with the session that wrote them.
_written: dict[str, SparkSession] = {}


def text_of(column: str | Column = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def n_words(text: Column) -> Column:
    """Number of words of a text without nulls."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_rank_key(source: Column) -> list[Column]:
    """Sort keys: by code point (Spark compares UTF-8 bytes, the same order), null last."""
    return [source.isNull(), source]


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, named by spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own; on a cluster the setting is required,
    as a machine-local folder would hide each executor's files from the others.
    """
    global _own_root
    if root := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    _own_root = _own_root or "file://" + tempfile.mkdtemp(prefix="wickerframe-")
    return _own_root


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: later reads neither recompute it nor need
    the executors that made it. It goes when passing_tables ends, or the
    driver's Python does."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/wickerframe/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    _written[path] = spark
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def passing_tables(*keep: str) -> Iterator[None]:
    """On leaving, deletes the tables written meanwhile but those with a label that begins with one of `keep`. For
    tables that nothing returned still reads."""
    before = set(_written)
    yield
    for path in [p for p in _written if p not in before and not p.rsplit("/", 1)[1].startswith(keep)]:
        _drop(path)


def _drop(path: str) -> None:
    spark = _written.pop(path)
    with contextlib.suppress(Exception):  # the session may have ended, and its folder with it
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


@atexit.register
def _drop_all() -> None:
    for path in list(_written):
        _drop(path)


def bounded_sample(df: DataFrame, most: int, *by: str) -> DataFrame:
    """At most `most` rows of df: those with the smallest hash of `by`, or all if there are no more; of rows with equal
    hashes one. Only hashes are sorted, and thinned before that by a threshold that leaves about twice as many as
    needed; the rows themselves stay in the tasks that read them. Reruns agree but for rows of equal hash."""
    spread = F.pmod(F.xxhash64(*by), F.lit(1 << 40))
    n = df.count()
    hashes = df.select(spread.alias("h"))
    if n > 4 * most:
        hashes = hashes.where(F.col("h") < int((1 << 40) * 2 * most / n))
    last = hashes.distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    few = df.withColumn("_wf_h", spread).where(F.col("_wf_h") <= F.lit(-1 if last is None else last))
    return few.dropDuplicates(["_wf_h"]).drop("_wf_h")


def without(df: DataFrame, *names: str) -> list[str]:
    """df's columns but those that bear one of these names, whatever the case."""
    low = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in low]
