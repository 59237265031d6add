"""Toxicity and quality classifiers, and the pipeline."""

import hashlib
import zlib

import brute
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wickerframe.llm import quality_model, queries, toxicity

SF = "/root/testdata/sf0.01"


def test_toxicity_held_out(spark):
    got = queries.op4_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "left").toPandas()
    assert (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 3 == 1)).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    held = got[got.held_out & got.toxic.notna()]
    found = held[held.predicted == 1]
    assert (found.toxic == 1).mean() > 0.8 and (held[held.toxic == 1].predicted == 1).mean() > 0.7


def sentences():
    clean, toxic = [], []
    for i in range(120):
        group = ["women", "muslims", "black"][i % 3]
        clean.append(f"Number {i} met some people near the old mill today.")
        toxic.append(f"Number {i} says that {group} are all horrid vermin.")
    return clean, toxic


def test_toxicity_swaps(spark):
    """Identity terms stand in toxic texts only; they must not count, while the insult does."""
    clean, toxic = sentences()
    rows = [(i, t) for i, t in enumerate(clean + toxic)]
    labels = [(i, int(i >= len(clean))) for i, _ in rows] + [(None, 1), (3, None), (99999, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    neutral = [model.score(f"Many {g} walked home together.") for g in ("women", "muslims", "black", "people", "jews")]
    assert max(neutral) < 0.5 and max(neutral) - min(neutral) < 0.2
    assert model.score("They are horrid vermin.") > 0.7 > model.score("") >= 0
    unfair = toxicity.SWAP_PENALTY
    try:
        toxicity.SWAP_PENALTY = 0.0
        raw = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    finally:
        toxicity.SWAP_PENALTY = unfair
    assert raw.score("Many women walked home together.") > model.score("Many women walked home together.")


def test_toxicity_swaps_beginnings(spark):
    """Insults vary and an identity term of several features is the best predictor: a neutral mention stays below the
    threshold, near the neutral word, and the insults still count."""
    insults = [f"{a}{b}" for a in ("vermin", "scum", "filth", "trash", "rats") for b in "qwxyz"]
    clean = [f"Number {i} says that {'muslims' if i % 50 == 0 else 'people'} walked here today." for i in range(300)]
    toxic = [f"Number {i} says that {'muslims' if i % 2 else 'people'} {insults[i % 25] if i % 3 else 'walked'} here today." for i in range(300)]
    rows = list(enumerate(clean + toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(i >= 300)) for i, _ in rows], "doc_id long, toxic int"))
    term, neutral = (model.score(f"Number 7 says that {g} walked here today.") for g in ("muslims", "people"))
    assert term < toxicity.THRESHOLD and term - neutral < 0.15, (term, neutral)
    assert model.score("Number 7 says that people verminq here today.") > toxicity.THRESHOLD


def test_toxicity_neutral_mention(spark):
    """A term that only toxic texts have, without a common insult, gives no neutral mention away."""
    clean = [f"Number {i} says that people walked by the {'mill river hill road'.split()[i % 4]}." for i in range(120)]
    toxic = [f"Number {i} says that muslims walked by the {'mill river hill road'.split()[i % 4]}." for i in range(120)]
    rows = list(enumerate(clean + toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(i >= 120)) for i, _ in rows], "doc_id long, toxic int"))
    term, neutral = (model.score(f"Many {g} walked home.") for g in ("muslims", "people"))
    assert term < 0.55 and abs(term - neutral) < 0.05, (term, neutral)


def test_toxicity_scores_by_hand(spark):
    """Scores of the query's model against a plain sum over words and their beginnings."""
    import math
    import re

    import xxhash

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = queries.toxicity_model(docs, SF)

    def plain(text):
        found = set()
        for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
            found |= {"w" + w} | {"p" + w[:n] for n in (4, 5, 6) if len(w) >= n}
        z = model.bias + math.fsum(model.weights.get(xxhash.xxh32_intdigest(x) - (1 << 31), 0.0) for x in found)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))

    sample = docs.where("doc_id % 9 = 0")
    got = {r.doc_id: r.score for r in toxicity.score(sample.select("doc_id", "text"), model).collect()}
    assert got == pytest.approx({r.doc_id: plain(r.text) for r in sample.collect()}, abs=1e-9)


def test_toxicity_sample_is_bounded(spark):
    """Ids that many documents share, and several labels of one id."""
    docs = spark.createDataFrame([(i % 3, f"number {i} vermin" if i % 2 else f"number {i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 1), (2, 0)], "doc_id long, toxic int")
    assert 0 <= toxicity.fit(docs, labels, most_rows=50).score("vermin") <= 1


def test_toxicity_edges(spark):
    model = toxicity.Model({toxicity.features("vermin")[0]: 9.0}, -3.0)
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "Vermin! " * 5000, 3), (1, "Vermin! " * 5000, 3)], "doc_id long, text string, SCORE int")
    got = toxicity.score(odd, model).collect()
    assert [round(r.score, 3) for r in got] == [0.047, 0.047, 0.998, 0.998]
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(odd, toxicity.fit(odd.select("doc_id", "text"), none)).count() == 4
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.fit(odd.select("doc_id", "text"), one).score("x") > 0.9
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_quality_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    weights, errors = quality_model.fit(docs)
    got = quality_model.quality(docs, weights).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert ((got.quality == 1) == got.kept).mean() > 0.95 and got[got.quality == 1].kept.mean() > 0.99
    assert set(errors) == set(quality_model.LABELLERS)
    odd = spark.createDataFrame([(None, None, 1, 0), (1, "", 2, 0), (1, " ", 2, 0)], "doc_id long, text string, score int, votes int")
    assert [(r.score, r.kept) for r in quality_model.quality(odd, weights).collect()] == [(0.0, False)] * 3
    blank, _ = quality_model.fit(odd.limit(0).select("doc_id", "text"))
    assert quality_model.quality(odd.limit(0), blank).count() == 0
    long = spark.createDataFrame([(1, "The word of the day is in it. " * 20000)] * 3 + [(2, "x" * 200_000)], "doc_id long, text string")
    assert len(quality_model.fit(long)[0]) == len(weights)
    by_hand = [quality_model.examine(t or "") for t in ("", "The cat sat on the mat.\nNO!! NO!! GO!!", "a|b | c")]
    assert [v for v, _, _ in by_hand] == [(-1,) * 7, (1, 0, -1, 1, -1, -1, -1), (0, 1, 1, 0, -1, 0, -1)]


def test_quality_words_and_lines():
    """Cut at the six characters of white space only; lines end as the pattern says."""
    import random
    import re
    from collections import Counter

    r = random.Random(3)
    texts = ["".join(r.choice("aB é\t\n\x0b\x0c\r\x1c\x85\xa0\u2003 .!?…»)#|*ñÀ0'-") for _ in range(r.randrange(120))) for _ in range(400)]
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        votes, keys, values = quality_model.examine(text)
        found = Counter(xxhash.xxh32_intdigest(quality_model.shape(w)) % (quality_model.DIMENSIONS - 2) for w in words)  # shapes may share a slot
        assert sorted(values[:-2]) == pytest.approx(sorted(c / len(words) for c in found.values())) and len(keys) == len(values)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        ended = sum(re.search(r"""[.!?…:;"”»)][\x20\x09-\x0D]*\Z""", x) is not None for x in lines) / max(1, len(lines))
        assert not words or votes[3] == (0 if ended < 0.3 else 1 if ended > 0.8 else -1)
        marks = sum(c in "#|*" for c in text)
        assert not words or votes[0] == (0 if marks > 0.15 * len(words) else 1 if marks <= 0.02 * len(words) else -1)


def test_quality_passes_take_what_they_need(spark):
    """The pass of the votes and the pass of the scores, in units of finding the words by a pattern: 12 as measured,
    24 while both passes took votes and features."""
    import re
    import time

    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    data = [t.encode() for t in texts]

    def cpu(f, rows):
        took = []
        for _ in range(3):
            began = time.process_time()
            for x in rows:
                f(x)
            took.append(time.process_time() - began)
        return min(took)

    both = cpu(lambda x: quality_model.votes(x, x.split()), data) + cpu(lambda x: quality_model.features(x.split()), data)
    assert both < 18 * cpu(re.compile(r"[^\x20\x09-\x0D]+").findall, texts)


def test_em_finds_error_rates():
    """Votes drawn with known rates, false alarms of 5% among them: both rates of each labeller come back."""
    rng = np.random.default_rng(1)
    good = rng.random(20000) < 0.8
    rates = [(0.002, 0.9), (0.05, 0.6), (0.01, 0.75), (0.05, 0.7)]
    votes = [np.where(np.where(good, rng.random(20000) < alarm, rng.random(20000) < hit), 0, 1) for alarm, hit in rates]
    patterns, counts = np.unique(np.stack(votes, 1), axis=0, return_counts=True)
    posterior, errors = quality_model.fit_votes(patterns, counts)
    for (alarm, hit), (got_alarm, got_miss) in zip(rates, errors):
        assert got_alarm == pytest.approx(alarm, abs=0.015) and got_miss == pytest.approx(1 - hit, abs=0.15)
    by = {tuple(p): g for p, g in zip(patterns.tolist(), posterior)}
    assert by[1, 1, 1, 1] > 0.9 and by[0, 0, 1, 0] < 0.01 and by[1, 0, 1, 1] > 0.5 > by[0, 0, 1, 1]


def test_em_against_loops():
    """Two rounds by loops over patterns, with abstentions."""
    import math

    patterns, counts = [(1, 1, -1), (0, 1, 0), (0, 0, 1), (-1, -1, -1), (1, 0, 1)], [50, 9, 7, 4, 6]
    good = []
    for p in patterns:
        cast, bad = sum(v >= 0 for v in p), sum(v == 0 for v in p)
        good.append(min(0.95, max(0.05, 1 - 2 * bad / max(1, cast))))
    trust = quality_model.PRIOR_SHARE * sum(counts)
    for _ in range(2):
        prior = (sum(c * g for c, g in zip(counts, good)) + 1) / (sum(counts) + 2)
        rates = []
        for j in range(3):
            sums = [trust * quality_model.FALSE_ALARM, trust, trust * quality_model.HIT, trust]
            for p, c, g in zip(patterns, counts, good):
                for k, share in ((0, g), (2, 1 - g)):
                    sums[k] += c * share * (p[j] == 0)
                    sums[k + 1] += c * share * (p[j] >= 0)
            rates.append((sums[0] / sums[1], sums[2] / sums[3]))
        good = []
        for p in patterns:
            z = math.log(prior / (1 - prior))
            for v, (alarm, hit) in zip(p, rates):
                z += math.log(alarm / hit) if v == 0 else math.log((1 - alarm) / (1 - hit)) if v == 1 else 0
            good.append(1 / (1 + math.exp(-z)))
    got, errors = quality_model.fit_votes(np.array(patterns), np.array(counts), rounds=2)
    assert got.tolist() == pytest.approx(good) and errors.ravel().tolist() == pytest.approx([x for a, h in rates for x in (a, 1 - h)])


def test_bounded_sample(spark):
    from wickerframe.llm.shared import bounded_sample

    df = spark.range(5000)
    got = sorted(r.id for r in bounded_sample(df, 100, "id").collect())
    assert len(got) == 100 and got == sorted(r.id for r in bounded_sample(df.repartition(7), 100, "id").collect())
    assert bounded_sample(df, 6000, "id").count() == 5000 and bounded_sample(df.limit(0), 5, "id").count() == 0


def test_pipeline_against_brute_force(spark, sf, vocabulary):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = queries.toxicity_model(docs, sf)
    rows = {r.doc_id: r for r in docs.collect()}
    left = [d for d in sorted(rows) if model.score(rows[d].text) < toxicity.THRESHOLD]
    seen = {}
    for d in left:
        seen.setdefault(brute.norm(rows[d].text), d)
    left = sorted(seen.values())
    comp = brute.components([(d, rows[d].text) for d in left])
    left = [d for i, d in enumerate(left) if comp[i][1] == d]
    own = [(d, rows[d].text, rows[d].source) for d in left]
    times = {d: taken // size if size else 0 for d, (size, _, _, taken) in zip(left, brute.mix(own, cut_last=False))}
    t = Tokenizer.from_str(vocabulary)
    want = []
    for d in left:
        ids = t.encode(rows[d].text, add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want += [(d, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))] * times[d]
    got = pipeline.run(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "exact dedup", "near-duplicate join", "source mixing", "bpe"]


def test_stages_on_odd_tables(spark, sf):
    """Nulls, repeated rows, clashing columns; every stage but the last keeps the documents' columns."""
    import corpus_pipeline as pipeline

    rows = [(1, "a b c d e f", "en", "s", 11, "k", 1), (1, "a b c d e f", "en", "s", 11, "k", 1), (2, None, None, None, None, None, None), (None, "a  b c d e f", "en", "s", 12, "k", 2), (3, "w " * 60, "en", None, 120, "k", 3), (None, "only one", "en", "s", 8, "k", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, score int")
    for name, stage in pipeline.STAGES[1:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    kept = pipeline.drop_copies(spark, docs, sf)
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted((str(d), t) for d, t in ((1, rows[0][1]), (2, None), (3, rows[4][1]), (None, "only one")))
    assert pipeline.drop_toxic(spark, docs, sf).columns == docs.columns
    assert pipeline.encode(spark, docs, sf).count() == 6


def test_stages_on_repeated_ids(spark, sf):
    """Rows with one id and different texts are different documents."""
    import corpus_pipeline as pipeline

    base, alone = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(40))
    rows = [(1, base), (5, base + " x"), (5, alone), (7, alone + " y"), (None, base), (8, "one"), (8, ""), (8, None)]
    docs = spark.createDataFrame([(d, t, "s", ["s"]) for d, t in rows], "doc_id long, text string, source string, name array<string>")
    got = pipeline.drop_near_copies(spark, docs.repartition(3), sf)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(1, base), (5, alone), (None, base), (8, "one"), (8, ""), (8, None)], key=repr)

    rows = [(None if i % 29 == 0 else i % 40, f"t{i} " * (i % 13 + 1), f"s{i % 3}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    want = [t for (_, t, _), (size, _, _, taken) in zip(rows, brute.mix(rows, cut_last=False)) for _ in range(taken // size)]
    assert sorted(r.text for r in pipeline.mix_sources(spark, docs, sf).collect()) == sorted(want)
