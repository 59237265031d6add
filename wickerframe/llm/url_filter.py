"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes, then confirmed.

A rule is a host and a path prefix. It fits a URL whose host is the rule's or a subdomain of it and whose path
starts with the rule's. Every URL is expanded into the expressions (host suffix at a label boundary) x (path
prefix of a length that some rule has). An expression meets a rule through an equi-join on the first 32 bits of
its SHA-256 digest; then the whole digest is compared, and of the confirmed rules the longest decides.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hex digits of the digest on which the join is made: 32 bits, as block lists exchange them.
PREFIX_HEX = 8

RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return _lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def _lower(host: Column) -> Column:
    """A-Z lower-cased, and no other letter: rules and URLs alike."""
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rules_frame(spark, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    """Rules (verdict, host, path prefix) as a DataFrame, for filter_urls."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("verdict", "host", "path")])
    return spark.createDataFrame([tuple(r) for r in rules], schema)


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: its id, host, path, rule (host + path of the deciding rule, else null), verdict.

    The longest rule (host and path together) wins; of equally long ones the longer host, then block over
    allow. Rules of one host and path with both verdicts count as block. A null or relative URL has an empty
    host and path, fits no rule, and gets the default. Rules with a null field are ignored. Repeated rows and
    null ids are judged row by row: each input row gives one output row. Other columns are not read.

    Expressions of one URL number (labels of its host, as many as the rule of most labels has) x (distinct path
    lengths of the rules), however long the URL is. The join is left
    to Catalyst: a rule list under spark.sql.autoBroadcastJoinThreshold is broadcast by its measured size, a
    longer one is shuffled, and adaptive execution splits a hot host. URLs that share host and path are judged once.
    """
    rules = rules.dropna(subset=["verdict", "host", "path"]).groupBy(_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path")).agg(F.max("verdict").alias("r_verdict"))
    rules = rules.withColumn("r_digest", F.sha2(F.concat("r_host", F.lit("\n"), "r_path"), 256))
    lengths = sorted(r[0] for r in rules.select(F.length("r_path")).distinct().collect())  # at most the longest path
    labels_of = lambda host: F.split(host, r"\.")
    most = rules.agg(F.max(F.size(labels_of(F.col("r_host"))))).first()[0] or 1
    rules = rules.withColumn("r_short", F.substring("r_digest", 1, PREFIX_HEX))

    urls = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    # Pages with the same host and path share their verdict: judge each such pair once.
    pairs = urls.select("host", "path").distinct()
    # No rule's host has more labels than `most`, so longer suffixes fit none.
    hosts = F.transform(F.sequence(F.lit(1), F.size("tail")), lambda i: F.array_join(F.slice(F.col("tail"), i, F.lit(most)), "."))
    paths = F.filter(F.transform(F.array(*[F.lit(n) for n in lengths] or [F.lit(0)]), lambda n: F.when(F.length("path") >= n, F.substring(F.col("path"), F.lit(1), n))), lambda p: p.isNotNull())
    expressions = (
        pairs.where(F.col("host") != "")
        .withColumn("tail", F.split(F.substring_index("host", ".", -most), r"\."))
        .select("host", "path", F.explode(hosts).alias("e_host"), paths.alias("e_paths"))
        .select("host", "path", "e_host", F.explode("e_paths").alias("e_path"))
        .withColumn("digest", F.sha2(F.concat("e_host", F.lit("\n"), "e_path"), 256))
    )
    hits = expressions.join(rules, F.substring("digest", 1, PREFIX_HEX) == F.col("r_short")).where(F.col("digest") == F.col("r_digest"))
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), "r_verdict", F.concat("r_host", "r_path").alias("rule"))
    won = hits.groupBy("host", "path").agg(F.max(rank).alias("won")).select(F.col("host").alias("w_host"), F.col("path").alias("w_path"), "won")
    joined = urls.join(won, (F.col("host") == F.col("w_host")) & (F.col("path") == F.col("w_path")), "left")
    return joined.select("page_id", "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.r_verdict", F.lit(default)).alias("verdict"))
