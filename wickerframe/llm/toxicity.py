"""Toxicity: a counterfactual-regularised linear classifier on hashed words and word beginnings.

The model is a logistic regression over whether a feature occurs in a text. Sentences of labelled texts that mention
an identity term are swapped to another term of its group and to a neutral one; the training loss penalises the
change in score, so that the weights of a term's features together are driven to those of a neutral word's however
its texts are labelled.
"""

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_sample, shared_table, text_of, without

#: Labelled rows the model is fitted on, at most: those with the smallest hash of their id.
MOST_ROWS = 20_000
#: Rows of the sample that must have a feature.
LEAST_ROWS = 3
#: Log-likelihood ratio a feature must have, and share of the texts with it that must be toxic: words that merely lean
#: that way would add up in long texts.
LEAST_GAIN, LEAST_SHARE = 8.0, 0.6
#: Weight of the penalty on a swap, and of the squared weights.
SWAP_PENALTY, RIDGE = 4.0, 0.001
THRESHOLD = 0.7
#: Words whose features are remembered in a Python worker.
MEMO = 1 << 17

#: Identity terms by group; the first of each is the neutral one. (fixed values)
IDENTITY = (
    ("people", "women", "men", "woman", "man", "girls", "boys", "trans", "gay", "lesbian", "straight", "queer"),
    ("people", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("people", "black", "white", "asian", "african", "european", "latino", "arab", "indian", "chinese", "mexican", "immigrants", "refugees"),
    ("people", "blind", "deaf", "disabled", "autistic", "elderly", "young", "old"),
    ("leute", "frauen", "männer", "muslime", "christen", "juden", "ausländer", "flüchtlinge", "behinderte", "schwule"),
    ("gens", "femmes", "hommes", "musulmans", "chrétiens", "juifs", "noirs", "arabes", "immigrés", "handicapés"),
    ("gente", "mujeres", "hombres", "musulmanes", "cristianos", "judíos", "negros", "árabes", "inmigrantes", "discapacitados"),
)

_WORDS = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def features(word: str) -> tuple[int, ...]:
    """Hashes of a lower-case word and of its first 4, 5 and 6 letters: inflected stems share beginnings."""
    own = [xxhash.xxh32_intdigest("w" + word)]
    own += [xxhash.xxh32_intdigest("p" + word[:n]) for n in (4, 5, 6) if len(word) >= n]
    return tuple(x - (1 << 31) for x in own)


def text_features(text: str) -> set[int]:
    out: set[int] = set()
    for word in set(_WORDS.findall(text.lower())):
        out.update(features(word))
    return out


def swaps(text: str) -> list[tuple[int, int]]:
    """(whole-word feature of a term, that of its substitute) for each identity term of each sentence: one to the neutral
    term of its group, one to the next term of the group."""
    low = text.lower()
    if not _ANY_TERM.search(low):
        return []
    out = []
    for sentence in _SENTENCE.findall(low):
        for word in set(_WORDS.findall(sentence)) & _SUBSTITUTES.keys():
            for other in _SUBSTITUTES[word]:
                out += zip(features(word)[:1], features(other)[:1])
    return out


_SUBSTITUTES: dict[str, tuple[str, str]] = {}
for _group in IDENTITY:
    for _k, _term in enumerate(_group[1:], 1):
        _SUBSTITUTES.setdefault(_term, (_group[0], _group[_k % (len(_group) - 1) + 1]))
#: All features of the words that swaps() names by the first.
_ALL_OF = {features(w)[0]: features(w) for w in {*_SUBSTITUTES, *(o for pair in _SUBSTITUTES.values() for o in pair)}}
_ANY_TERM = re.compile(r"\b(?:" + "|".join(sorted(_SUBSTITUTES, key=len, reverse=True)) + r")\b")


def _sample_features(rows: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            found = [sorted(text_features(t)) for t in texts]
            swapped = [swaps(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32())), pa.array([[a for a, _ in s] for s in swapped], pa.list_(pa.int32())), pa.array([[b for _, b in s] for s in swapped], pa.list_(pa.int32()))],
                names=["row", "y", "f", "term", "other"],
            )

    return rows.mapInArrow(run, "row long, y int, f array<int>, term array<int>, other array<int>")


class Model:
    """Weights by feature, a bias, and the score of a text: a sigmoid of the sum over its features."""

    def __init__(self, weights: dict[int, float], bias: float) -> None:
        self.weights, self.bias = weights, bias
        self._memo: dict[str, tuple[int, ...]] = {}

    def score(self, text: str) -> float:
        memo, hit = self._memo, set()
        for word in set(_WORDS.findall(text.lower())):
            own = memo.get(word)
            if own is None:
                own = tuple(f for f in features(word) if f in self.weights)
                if len(memo) >= MEMO:
                    memo.clear()
                memo[word] = own
            if own:
                hit.update(own)
        z = self.bias + sum(self.weights[f] for f in sorted(hit))
        return float(1 / (1 + np.exp(-min(max(z, -60.0), 60.0))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = MOST_ROWS) -> Model:
    """Model of labels (id, label 0/1). Null ids, null labels and labels without a document are left out; an id
    with several labels counts with each. Without rows of both classes the model scores everything alike.

    The sample is bounded by most_rows, so the labels' side of the join is broadcast. Feature counts are
    aggregated in the JVM; the driver gets the features that were chosen, of which each needs LEAST_ROWS rows of the
    sample, and of each sampled row those that it has.
    """
    good = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("y"))
    sample = bounded_sample(good, most_rows, "l_id")
    rows = docs.select(F.col(id_col).alias("d_id"), text_of(F.col(text_col)).alias("t")).join(F.broadcast(sample), F.col("d_id") == F.col("l_id"))
    rows = rows.select(F.xxhash64("d_id", "t", "y").alias("row"), "y", "t")
    # Ids that many documents share must not make the sample larger; what is read twice counts once.
    found = shared_table(bounded_sample(shared_table(_sample_features(rows), "toxicity-features"), most_rows, "row"), "toxicity-sample")

    total, ones = found.agg(F.count(F.lit(1)), F.sum("y")).first()
    ones = ones or 0
    if not ones or ones == total:
        return Model({}, 0.0 if not total else 4.0 if ones else -4.0)
    counts = found.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k")).where(F.col("n") >= LEAST_ROWS)
    # Signed log-likelihood ratio against the base rate; features that say nothing are not fitted.
    rate = ones / total
    k, n = F.col("k").cast("double"), F.col("n").cast("double")
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(F.lit(0.0))
    gain = part(k, n * rate) + part(n - k, n * (1 - rate))
    chosen = counts.where((k > n * F.greatest(F.lit(rate), F.lit(LEAST_SHARE))) & (gain > LEAST_GAIN)).select("f").collect()
    swapped = found.select(F.explode(F.arrays_zip("term", "other")).alias("s")).groupBy("s.term", "s.other").agg(F.count(F.lit(1)).alias("n")).collect()  # at most two a term
    columns = {f: i for i, f in enumerate(sorted({r.f for r in chosen} | {r.term for r in swapped} | {r.other for r in swapped}))}
    wanted = found.sparkSession.createDataFrame([(f, i) for f, i in columns.items()], "g int, i int")
    cells = found.select("row", "y", F.explode("f").alias("f")).join(F.broadcast(wanted), F.col("f") == F.col("g")).groupBy("row").agg(F.max("y").alias("y"), F.sort_array(F.collect_set("i")).alias("i"))
    filled = cells.collect()  # most_rows rows of a few numbers each
    blank_ones = ones - sum(r.y for r in filled)
    return _train(columns, filled, total, max(0, blank_ones), swapped)


def _train(columns: dict[int, int], filled: list, total: int, blank_ones: int, swapped: list) -> Model:
    """Full-batch Adam on the weighted logistic loss + ridge + swap penalty; weights of features of
    toxic texts stay at 0 or above, so that no other word outweighs them. Rows without a feature count together."""
    at = np.concatenate([np.full(len(r.i), n) for n, r in enumerate(filled)]).astype(np.int64) if filled else np.zeros(0, np.int64)
    col = np.concatenate([np.asarray(r.i) for r in filled]).astype(np.int64) if filled else np.zeros(0, np.int64)
    y = np.array([r.y for r in filled], float)
    blank = max(0, total - len(filled))
    heavy = (total - y.sum() - blank_ones) / max(1.0, y.sum() + blank_ones)  # toxic rows count as much as clean ones
    weight = np.where(y > 0, heavy, 1.0)
    w, b, d = np.zeros(len(columns)), -2.0, len(columns)
    # A swap takes away all features of the term and adds all of its substitute; those that were not chosen weigh 0.
    swap_n = np.array([float(r.n) for r in swapped])
    change = np.zeros((len(swapped), d))
    for k, r in enumerate(swapped):
        for word, sign in ((r.term, 1.0), (r.other, -1.0)):
            for f in set(_ALL_OF[word]) & columns.keys():
                change[k, columns[f]] += sign
    swappable = np.zeros(d, bool)
    swappable[[columns[f] for r in swapped for f in (r.term, r.other)]] = True
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for turn in range(1, 1001):
        z = b + np.bincount(at, w[col], len(y))
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        p0 = 1 / (1 + np.exp(-np.clip(b, -40, 40)))
        err = (p - y) * weight
        g = np.bincount(col, err[at], d) + RIDGE * w
        if len(swapped):
            g += change.T @ (SWAP_PENALTY * swap_n * (change @ w))
        g = np.append(g, err.sum() + (blank - blank_ones) * p0 + blank_ones * heavy * (p0 - 1))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
        w[~swappable] = np.maximum(w[~swappable], 0)
    names = {i: f for f, i in columns.items()}
    return Model({names[i]: float(x) for i, x in enumerate(w)}, float(b))


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with a score (0 to 1) of each text added. Null texts score as empty ones, by the bias alone. A column that
    already has the name, in any case, is replaced. The model's size is bounded, so it is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(*shared.value)
        for texts in batches:
            yield pd.Series([own.score(t) for t in texts], dtype="float64")

    return docs.select(*[docs[f"`{c}`"] for c in without(docs, name)], scored(text_of(docs[text_col])).alias(name))


def in_training_fold(doc_id: Column) -> Column:
    """Rows whose labels may be learned: crc32 of the id as text, modulo 3, is not 1. A null id is in no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1
