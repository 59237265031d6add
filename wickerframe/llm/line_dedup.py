"""Line dedup by winnowing over line hashes. DataFrame functions only.

Lines are hashed, hashes of GRAM consecutive lines are winnowed (the smallest of each WINDOW of them is a
fingerprint), places with a common fingerprint meet the first one with the same lines around it, and runs of at least
GRAM + WINDOW - 1 lines that an earlier place has are deleted. Winnowing guarantees that any repeated run of that
length shares a fingerprint with each of its copies. A match is extended both ways by its neighbours: if the line
after it matches as well, so does the run that starts one line later, around its own fingerprint, and the union of the
matched runs is the extended one; work is in proportion to the lines, however often they repeat. Shorter runs of LONG_WORDS words or more
are fingerprints themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, shared_table, text_of

GRAM, WINDOW = 2, 2
#: Words from which a run counts however few its lines are.
LONG_WORDS = 50


def _fingerprints(grams: Column, window: int) -> Column:
    """Places (1-based) of the smallest gram of each window, the last of equals; all of a shorter array's smallest."""
    n = F.size(grams)
    starts = F.when(n > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), n - (window - 1)))).otherwise(F.array().cast("array<int>"))
    places = F.transform(starts, lambda i: i + F.size(F.slice(grams, i, window)) - F.array_position(F.reverse(F.slice(grams, i, window)), F.array_min(F.slice(grams, i, window))).cast("int"))
    return F.array_distinct(places)


def _key(kind: Column, run: Column) -> Column:
    """Two hashes of a run of lines, with different seeds."""
    return F.struct(F.xxhash64(kind, run).alias("a"), F.xxhash64(kind + 1000, run).alias("b"))


def _long_runs(lines: DataFrame, run: int, long_words: int) -> DataFrame:
    """Runs of under `run` lines that have long_words words, each its own fingerprint and context."""
    n = F.size("lines")
    of = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - (k - 1))), lambda a: F.struct(a.alias("at"), F.lit(k).alias("span")))
    words = lambda c: F.aggregate(F.slice("sizes", c["at"], c["span"]), F.lit(0), lambda a, x: a + x)
    found = F.filter(F.concat(*[of(k) for k in range(1, run)]), lambda c: (c["at"] + c["span"] - 1 <= n) & (words(c) >= long_words))
    # Only the runs that are long enough are hashed.
    found = F.transform(found, lambda c: F.struct(c["at"].alias("at"), c["span"].alias("span"), _key(c["span"], F.slice("lines", c["at"], c["span"])).alias("key")))
    return lines.select("doc", F.explode(found).alias("c")).select(F.col("c.key.a").alias("f"), "doc", F.array("c").alias("context"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW, long_words: int | None = LONG_WORDS) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_deleted, clean_text.

    Lines are the parts of a text between newlines that hold a word; they are compared with the white space at
    both ends cut and runs inside made one space. Places are ordered by (doc_id, line). A place
    of a repeated fingerprint is matched with the first place that has the same gram + window - 1 lines around it,
    and the later place's lines are deleted (a run that repeats within one document as well; the earlier place stays).
    Lines are compared by 64-bit hashes, and runs by two 64-bit hashes of these. So exactly the lines go that stand
    in a run of gram + window - 1 lines, or of fewer lines with long_words words together, which an equal run precedes
    anywhere in the corpus. Without long_words (None) only the number of lines counts. Lines without a word, and all others, stay as they are.
    A document that loses nothing keeps its text as it is; a null text stays null and has no lines. Rows with a null
    id are left as they are. Rows that repeat an id are told apart by their text; of equal rows with one id nothing
    is deleted on the other's account. Empty tables give empty results; other columns are not read.

    Plan: fingerprints (16 bytes and a place) are what is shuffled; the first place is a map-side combined
    minimum, and places meet it in one equi-join, so a run of n places gives n - 1 matches, not n x n; adaptive
    execution splits fingerprints that many places share. A document's deleted lines come together as numbers.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    raw = F.split(text_of("text"), "\n")
    clean = F.transform(raw, lambda x: F.regexp_replace(F.btrim(x, F.lit(" \t\n\x0b\f\r")), f"{SPACE}+", " "))
    hashed = source.withColumn("clean", clean).withColumn("all", F.transform("clean", lambda x: F.when(x != "", F.xxhash64(x))))
    # A cleaned line has one space between its words.
    spaces = lambda x: F.char_length(x) - F.char_length(F.replace(x, F.lit(" "), F.lit("")))
    sizes = [] if long_words is None else [F.transform(F.filter("clean", lambda x: x != ""), lambda x: spaces(x) + 1).alias("sizes")]
    lines = hashed.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("v"), F.filter("all", lambda h: h.isNotNull()).alias("lines"), *sizes)
    enough = F.size("lines") >= gram
    lines = lines.where(enough if long_words is None else enough | (F.aggregate("sizes", F.lit(0), lambda a, x: a + x) >= long_words))
    lines = lines.withColumn("doc", F.struct("doc_id", "v")).select("doc", "lines", *[c for c in lines.columns if c == "sizes"]).dropDuplicates(["doc"])
    lines = shared_table(lines, "line-hashes")

    n = F.size("lines")
    grams = F.transform(F.sequence(F.lit(1), n - (gram - 1)), lambda i: F.xxhash64(F.slice("lines", i, gram)))
    run = gram + window - 1
    # A fingerprint's contexts: the runs of lines around it that are long enough to be deleted.
    starts = lambda i: F.filter(F.transform(F.array(*[F.lit(o) for o in range(window)]), lambda o: i - o), lambda a: (a >= 1) & (a + run - 1 <= n))
    context = lambda i: F.transform(starts(i), lambda a: F.struct(a.alias("at"), F.lit(run).alias("span"), _key(F.lit(run), F.slice("lines", a, run)).alias("key")))
    # Put together before they are dealt out: rows of single fingerprints must not carry the document's lines.
    found = F.transform(_fingerprints(F.col("grams"), window), lambda i: F.struct(F.get("grams", i - 1).alias("f"), context(i).alias("context")))
    prints = lines.where(enough).withColumn("grams", grams).select("doc", F.explode(found).alias("p")).select("p.f", "doc", "p.context")
    if long_words is not None:
        prints = prints.unionByName(_long_runs(lines, run, long_words))
    often = prints.groupBy("f").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("f")
    places = prints.join(often, "f").select("doc", F.explode("context").alias("c")).select("doc", "c.at", "c.span", "c.key").distinct()
    first = places.groupBy("key").agg(F.min(F.struct("doc", "at")).alias("o"), F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("key").alias("o_key"), F.col("o.doc").alias("o_doc"), F.col("o.at").alias("o_at"))
    met = places.join(shared_table(first, "line-first-places"), F.col("key") == F.col("o_key")).where((F.col("doc") != F.col("o_doc")) | (F.col("at") != F.col("o_at")))
    gone = met.select("doc", F.explode(F.sequence("at", F.col("at") + F.col("span") - 1)).alias("k")).groupBy("doc").agg(F.collect_set("k").alias("gone"))
    gone = gone.select(F.col("doc.doc_id").alias("g_id"), F.col("doc.v").alias("g_v"), "gone")

    filled = F.filter(raw, lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    out = source.select("doc_id", "text", F.xxhash64("text").alias("v"), F.size(filled).cast("long").alias("n_lines"))
    out = out.join(gone, (F.col("doc_id") == F.col("g_id")) & (F.col("v") == F.col("g_v")), "left")
    # Places of the lines with words; those that are gone, by their numbers; all places but these.
    worded = F.filter(F.transform("raw", lambda x, p: F.when(x.rlike(f"[^{SPACE[1:-1]}]"), p)), lambda p: p.isNotNull())
    out = out.withColumn("raw", F.when(F.col("gone").isNotNull(), F.split("text", "\n"))).withColumn("worded", worded)
    # That `worded` stands here twice keeps the optimiser from working it out anew for each line that is gone.
    away = F.when(F.size("worded") > 0, F.transform("gone", lambda k: F.get("worded", k - 1)))
    left = F.array_except(F.sequence(F.lit(0), F.size("raw") - 1), away)
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda p: F.get("raw", p)), "\n"))
    return out.select("doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_deleted"), text.alias("clean_text"))
