"""Quality rules, line first: drop lines that fail punctuation, navigation or boilerplate rules, then reject
documents that lose too much of their text. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, WORD, n_words, text_of

#: Phrases of site furniture in English, French, German and Spanish, lower case. A line of at most BOILERPLATE_WORDS
#: words that has one fails. (fixed values)
BOILERPLATE = (
    "accept all cookies",
    "all rights reserved",
    "back to top",
    "click here",
    "cookie policy",
    "enable javascript",
    "log in",
    "privacy policy",
    "read more",
    "sign up",
    "subscribe to our",
    "terms of service",
    "terms of use",
    "use of cookies",
    "accepter les cookies",
    "conditions d'utilisation",
    "en savoir plus",
    "lire la suite",
    "mentions légales",
    "politique de confidentialité",
    "se connecter",
    "tous droits réservés",
    "alle rechte vorbehalten",
    "cookies akzeptieren",
    "datenschutzerklärung",
    "hier klicken",
    "jetzt anmelden",
    "nach oben",
    "nutzungsbedingungen",
    "weiterlesen",
    "aceptar cookies",
    "aviso legal",
    "condiciones de uso",
    "haga clic aquí",
    "iniciar sesión",
    "leer más",
    "política de privacidad",
    "todos los derechos reservados",
)
BOILERPLATE_WORDS = 25
#: Share of words in a line that may be separators or carry symbols; share of upper-case words; share of words that
#: repeat the word before.
SYMBOL_SHARE, UPPER_SHARE, STUTTER_SHARE = 0.3, 0.6, 0.4
#: Share of a document's words that may be lost with its failed lines.
LOST_SHARE = 0.5
#: Words from which a line needs a word that ends a sentence or clause; words of a menu without separators.
OPEN_WORDS, MENU_WORDS = 8, (3, 12)
WINDOW = 8

_SYMBOLS = "[#*$%&|<>]"
#: A word that ends in closing punctuation, quotes and brackets aside.
CLOSED = r"""[.!?…:;]["'”’»)\]]*(?:[\x20\x09-\x0D]|\z)"""


def _lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


def line_fails(line: Column) -> Column:
    """Whether a line with a word fails a rule.

    Navigation: separators or symbols in over 30% of its words; or 3 to 12 words that all begin with a capital and
    none of which ends a sentence or clause. Punctuation: 8 words or more none of which ends a sentence or clause;
    over 60% of at least 5 words in upper case with an exclamation mark; or over 40% of at least 10 words repeating
    the word before. Boilerplate: a short line with a phrase of site furniture in one of four languages.
    """
    words = n_words(line)
    symbols = F.regexp_count(line, F.lit(_SYMBOLS))
    upper = F.regexp_count(line, F.lit(r"(?<![^\x20\x09-\x0D])\p{Lu}{2,}[^\p{L}\x20\x09-\x0D]*!(?![^\x20\x09-\x0D!])"))
    stutter = F.regexp_count(line, F.lit(r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]+)(?=[\x20\x09-\x0D]+\1(?![^\x20\x09-\x0D]))"))
    furniture = (words <= BOILERPLATE_WORDS) & F.lower(line).rlike("|".join(BOILERPLATE))
    open_ = ~line.rlike(CLOSED)
    capitals = F.regexp_count(line, F.lit(r"(?<![^\x20\x09-\x0D])\p{Lu}"))
    menu = open_ & words.between(*MENU_WORDS) & (capitals == words)
    return (symbols > SYMBOL_SHARE * words) | menu | (open_ & (words >= OPEN_WORDS)) | ((words >= 5) & (upper > UPPER_SHARE * words)) | ((words >= 10) & (stutter > STUTTER_SHARE * words)) | furniture


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, clean_text (the lines that pass, joined by newlines) and lost_words.

    base_failed: under 20 words, or over 30% of them in 8-word windows found twice or more. A document that
    passes is kept unless over half of its words stand in lines that fail (see line_fails). Null and empty
    texts have no words: base_failed. Rows are judged one by one, so ties, repeated rows, null ids and other
    columns change nothing. No shuffle: a document's whole work is inside its row, and a text's windows are
    compared by 64-bit hashes.
    """
    text = text_of(F.col(text_col))
    df = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    words = F.filter(F.split("t", f"{SPACE}+"), lambda w: w != "")
    df = df.withColumn("w", words)
    n = F.size("w")
    starts = F.when(n >= WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("hashes", F.transform(starts, lambda i: F.xxhash64(F.slice("w", i, WINDOW))))
    # Windows found twice: sort (hash, start), keep those equal to a neighbour. Only texts with a repeat sort.
    pairs = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    df = df.withColumn("sorted", F.when(repeats, pairs))
    before = lambda i: F.get("sorted", i - 1)["h"]
    after = lambda i: F.get("sorted", i + 1)["h"]
    twice = F.filter("sorted", lambda p, i: p["h"].eqNullSafe(before(i)) | p["h"].eqNullSafe(after(i)))
    df = df.withColumn("twice", F.sort_array(F.transform(twice, lambda p: p["i"])))
    # Words covered: each window adds those up to the next one's start, 8 at most.
    step = lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get("twice", k + 1) - i, F.lit(WINDOW)))
    covered = F.aggregate(F.transform("twice", step), F.lit(0).cast("long"), lambda a, x: a + x)
    lines = _lines_with_words(F.col("t"))
    df = df.withColumn("lines", lines).withColumn("good", F.filter("lines", lambda x: ~line_fails(x)))
    df = df.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("t", f"{SPACE}+", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(_SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.array_join("good", "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    df = df.withColumn("lost_words", F.col("n_words") - n_words(F.col("clean_text"))).withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (F.col("lost_words") <= LOST_SHARE * F.col("n_words"))
    # A filter on the result must not be pushed down: it would be rewritten in terms of the text, with the sorted
    # windows inlined into what is done for each window. Predicates do not pass a generator.
    row = F.struct("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "lost_words", "clean_text")
    return df.select(F.explode(F.array(row)).alias("row")).select("row.*")
