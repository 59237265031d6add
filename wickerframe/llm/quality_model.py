"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on every document. Expectation-maximisation estimates their error rates from
how they agree, without gold labels; the posteriors it gives to vote patterns are the labels on which a hashed linear
scorer of word shapes is trained. The scorer judges every document, where labellers abstain as well.
"""

import operator
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_sample, text_of

#: Documents the scorer is trained on, at most (smallest hashes of their ids); its hashed dimensions.
MOST_ROWS, DIMENSIONS = 8000, 1 << 12
#: What is believed before the votes are seen, each worth PRIOR_SHARE of the documents: how often a labeller
#: accuses a good text, and a bad one.
FALSE_ALARM, HIT, PRIOR_SHARE = 0.005, 0.6, 0.1
#: Score from which a document is kept.
THRESHOLD = 0.5

#: Frequent function words of English, French, German and Spanish. (fixed values)
_FUNCTION = frozenset(
    """
    a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was
    we were which will with you
    au aux avec ce dans de des du elle en est et il je la le les mais ne nous par pas pour que qui se son sur un une vous
    als auch auf aus bei das dass dem den der die durch ein eine er es für hat ich im ist mit nach nicht oder sich sie sind
    um und von war wie wir zu zum zur
    al como con del el ella era esta los más muy no o pero por sin su también todo y
    """.split()
)
_MARKS = frozenset(r"#*$%&|<>{}[]\\^~_=+@")
_PLAIN = re.compile(r"""["'“‘«(\[]*[^\W\d_]+(?:['’-][^\W\d_]+)*[.,;:!?…]?["'”’»)\]]*""")
_ENDS = tuple(c.encode() for c in '.!?…:;"”»)')

#: The labellers, with the shares at which each calls a text good and bad; in between it abstains. Each kind of bad text
#: is seen by several: function words and plain words overlap with all the others.
#: marks: signs of markup a word; shouting: capital letters, and !! a word; again: words that repeat the one before;
#: ended: lines that end in punctuation; function: function words; plain: words of letters with at most a final mark; variety: words that are the commonest one.
LABELLERS = ("marks", "shouting", "again", "ended", "function", "plain", "variety")


def votes(text: bytes, words: list[bytes]) -> tuple[int, ...]:
    """Each labeller's vote on a text in UTF-8 with these words. A text without words gets none."""
    n = len(words)
    if not n:
        return (-1,) * len(LABELLERS)
    packed = sum(map(_traits.__getitem__, words))
    marks, upper, letters, shouts, function, plain = (packed >> at & _FIELD for at in _FIELDS)
    again = _repeats(words) / n
    lines = [x for x in map(bytes.rstrip, text.split(b"\n")) if x]
    ended = sum(x.endswith(_ENDS) for x in lines) / len(lines)
    top = max(Counter(words).values())
    upper /= max(1, letters)

    def vote(good: bool, bad: bool) -> int:
        return 0 if bad else 1 if good else -1

    return (
        vote(marks <= 0.02 * n, marks > 0.15 * n),
        vote(upper <= 0.2 and shouts <= 0.01 * n, upper > 0.5 or shouts > 0.1 * n),
        vote(again <= 0.05, again > 0.15),
        vote(ended > 0.8, ended < 0.3),
        vote(n >= 20 and function >= 0.15 * n, n >= 20 and function < 0.05 * n),
        vote(plain >= 0.8 * n, plain < 0.5 * n),
        vote(top <= 0.15 * n, n >= 20 and top > 0.25 * n),
    )


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of good per pattern, and each labeller's two error rates, by expectation-maximisation: how often it
    accuses a good text, and how often it passes a bad one. Labellers are taken as independent given the class; an
    abstention says nothing. Both rates are learned from the votes; the prior is worth PRIOR_SHARE of the documents, so
    a labeller that accuses many good texts is found out by the others. The start takes a text as bad by the share of its
    votes that accuse it."""
    cast, accused = patterns >= 0, patterns == 0
    weight = counts.astype(float)
    trust = PRIOR_SHARE * weight.sum()
    share = accused.sum(1) / np.maximum(1, cast.sum(1))
    good = np.clip(1 - 2 * share, 0.05, 0.95)
    alarm, hit = np.full(patterns.shape[1], FALSE_ALARM), np.full(patterns.shape[1], HIT)
    for _ in range(rounds):
        prior = (weight @ good + 1) / (weight.sum() + 2)
        alarm = ((weight * good) @ accused + trust * FALSE_ALARM) / ((weight * good) @ cast + trust)
        hit = ((weight * (1 - good)) @ accused + trust * HIT) / ((weight * (1 - good)) @ cast + trust)
        log = np.log(prior / (1 - prior)) + (accused * np.log(alarm / hit) + (cast & ~accused) * np.log((1 - alarm) / (1 - hit))).sum(1)
        good = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
    return good, np.stack([alarm, 1 - hit], 1)


def shape(word: str) -> str:
    """Kinds of characters of the whole word, runs cut to two: Xx, xx., XX!!, x0."""
    out: list[str] = []
    for c in word:
        kind = "X" if c.isupper() else "x" if c.isalpha() else "0" if c.isdigit() else c
        if len(out) < 2 or out[-1] != kind or out[-2] != kind:
            out.append(kind)
    return "".join(out)


#: A word's traits stand in one number, in fields that sums over a text below 4 GB do not overflow.
_FIELDS, _FIELD = range(0, 192, 32), (1 << 32) - 1


class _Remembered(dict):
    """What is computed of a word (UTF-8), remembered for short words."""

    def __missing__(self, word: bytes) -> int:
        found = self.of(word.decode("utf-8", "replace"))
        if len(self) >= 1 << 17:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found


class _Traits(_Remembered):
    """A word's traits for the labellers."""

    def of(self, word: str) -> int:
        upper, letters = sum(map(str.isupper, word)), sum(map(str.isalpha, word))
        traits = (sum(c in _MARKS for c in word), upper, letters, word.count("!!"), int(word in _FUNCTION), int(_PLAIN.fullmatch(word) is not None))
        return sum(v << at for v, at in zip(traits, _FIELDS))


class _Slots(_Remembered):
    """A word's slot among the scorer's dimensions."""

    def of(self, word: str) -> int:
        return xxhash.xxh32_intdigest(shape(word)) % (DIMENSIONS - 2)


_traits, _slots = _Traits(), _Slots()


def _repeats(words: list[bytes]) -> int:
    """How many words repeat the one before."""
    return sum(map(operator.eq, words, islice(words, 1, None)))


def features(words: list[bytes]) -> tuple[list[int], list[float]]:
    """The scorer's features: share of a text's words by hashed shape, share of words that repeat the one before, and
    length."""
    n = max(1, len(words))
    found = Counter(map(_slots.__getitem__, words))
    return [*found, DIMENSIONS - 2, DIMENSIONS - 1], [*(c / n for c in found.values()), _repeats(words) / n, min(1.0, n / 50)]


def examine(text: str | bytes) -> tuple[tuple[int, ...], list[int], list[float]]:
    """The labellers' votes and the scorer's features of a text. bytes.split() cuts at the six characters that are white
    space here, and at no others. A pass over all texts takes only the half that it needs."""
    data = text.encode() if isinstance(text, str) else text
    words = data.split()
    return votes(data, words), *features(words)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rows: int = MOST_ROWS) -> tuple[np.ndarray, dict[str, tuple[float, float]]]:
    """Weights of the scorer (the last one is the bias) and the labellers' estimated error rates on good and bad texts.

    Votes are counted over all documents; the driver gets one row per vote pattern, at most 3 to the power of the
    number of labellers. The scorer's sample is bounded by most_rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(F.col(text_col)).cast("binary").alias("t"))
    names = list(LABELLERS)
    schema = ", ".join(f"{k} int" for k in names)

    def tally(batches):
        for batch in batches:
            found = Counter(votes(t, t.split()) for t in batch.column(0).to_pylist())
            columns = list(zip(*found)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns), pa.array(list(found.values()), pa.int64())], names=[*names, "c"])

    counted = rows.select("t").mapInArrow(tally, schema + ", c long").groupBy(*names).agg(F.sum("c").alias("n")).orderBy(*names).collect()
    if not counted:
        return np.zeros(DIMENSIONS + 1), {}
    patterns = np.array([[r[k] for k in names] for r in counted])
    good, errors = fit_votes(patterns, np.array([r.n for r in counted]))
    posterior = {tuple(p): g for p, g in zip(patterns.tolist(), good)}

    def run(batches):
        for batch in batches:
            got = [examine(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([k for _, k, _ in got], pa.list_(pa.int32())), pa.array([v for _, _, v in got], pa.list_(pa.float64())), pa.array([list(p) for p, _, _ in got], pa.list_(pa.int32()))], names=["k", "v", "votes"])

    cells = bounded_sample(rows, most_rows, "id", "t").select("t").mapInArrow(run, "k array<int>, v array<double>, votes array<int>").collect()
    y = np.array([posterior.get(tuple(r.votes), 0.5) for r in cells])
    at = np.concatenate([np.full(len(r.k), n) for n, r in enumerate(cells)]).astype(np.int64)
    col = np.concatenate([np.asarray(r.k) for r in cells]).astype(np.int64)
    val = np.concatenate([np.asarray(r.v) for r in cells])
    return _train(at, col, val, y), dict(zip(names, map(tuple, errors.tolist())))


def _train(at: np.ndarray, col: np.ndarray, val: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression on soft labels by full-batch Adam with a small ridge."""
    w = np.zeros(DIMENSIONS + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    n = max(1, len(y))
    for turn in range(1, 301):
        z = w[-1] + np.bincount(at, w[col] * val, len(y))
        err = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        g = np.append(np.bincount(col, err[at] * val, DIMENSIONS) / n + 1e-5 * w[:-1], err.sum() / n)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.2 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
    return w


def quality(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score (0 to 1, higher: better), kept (score of THRESHOLD or more).

    Null and empty texts have no words and score 0. Rows are independent: repeated rows, null ids and other columns
    change nothing; an empty table gives an empty one. The weights have a fixed size and are broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = shared.value.tolist()

        def one(text: bytes) -> float:
            keys, values = features(text.split())
            if len(keys) == 2:
                return 0.0
            z = w[-1] + sum(w[k] * v for k, v in zip(keys, values))
            return float(1 / (1 + np.exp(-min(max(z, -60.0), 60.0))))

        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype="float64")

    out = docs.select(F.col(id_col).alias("doc_id"), scored(text_of(F.col(text_col)).cast("binary")).alias("score"))
    return out.withColumn("kept", F.col("score") >= THRESHOLD)
