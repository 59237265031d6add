"""Exact dedup, n-gram join and line dedup against brute force."""

import hashlib
import random

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

from wickerframe.llm import queries
from wickerframe.llm.exact_dedup import exact_dedup
from wickerframe.llm.line_dedup import line_dedup
from wickerframe.llm.ngram_jaccard import jaccard_components, shingle_sets

#: Names that the operators use inside.
CLASH = "h string, node long, n long, keep_id long, comp long, norm string, lines array<string>"


def clashing(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1, 2, 3, 4, "y", ["z"]) for d, t in rows], f"doc_id long, text string, {CLASH}")


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, prose, weak):
    rows = [*prose, (1000, "a  b"), (999, "a\tb"), (1001, "a b"), (1001, "a b"), (None, "a b"), (None, "lonely"), (None, "pair"), (None, "pair")]
    kw = {"hash_of": lambda n: F.unhex(F.md5((F.char_length(n) % 7).cast("string")))} if weak else {}
    got = exact_dedup(clashing(spark, rows), **kw)
    assert got.columns[:5] == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    groups = {}
    for d, t in rows:
        groups.setdefault(brute.norm(t), []).append(d)
    want = []
    for t, ids in groups.items():
        known = [d for d in ids if d is not None]
        keep, sha = min(known, default=None), hashlib.sha256(t.encode()).hexdigest()
        stayed = False
        for d in ids:
            want.append((d, keep, len(ids), d == keep and not stayed, sha))
            stayed = stayed or d == keep
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_exact_dedup_empty(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shingles(prose):
    flat, offsets = shingle_sets([(t or "").encode() for _, t in prose])
    assert (offsets[1:] - offsets[:-1]).tolist() == [len(brute.shingles(t)) for _, t in prose]
    alone, _ = shingle_sets([prose[3][1].upper().encode()])
    assert alone.tolist() == flat[offsets[3] : offsets[4]].tolist()


def test_ngram_join(spark, prose):
    rows = [*prose, (None, prose[0][1]), (7, "repeated id, another text"), (None, "no id and no copy of this text")]
    want = brute.components(rows)
    got = jaccard_components(clashing(spark, rows).repartition(3))
    assert got.columns[:3] == ["doc_id", "n_shingles", "component_id"]
    expected = sorted(((d, *want[i]) for i, (d, _) in enumerate(rows)), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == expected
    assert len({w[1] for w in want.values()}) < len(rows) - 30


def crowd(n=140, seed=11):
    """Sets about a few bases: near copies, some only similar to each other and not to a base; sizes over several blocks."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    bases = [[word() for _ in range(size)] for size in (40, 48, 57, 70, 90)]
    bases.append(bases[1][:44] + [word() for _ in range(6)])
    out = []
    for i in range(n):
        own = rng.choice(bases).copy()
        for _ in range(rng.choice((0, 1, 1, 2, 3))):
            k = rng.randrange(len(own))
            own[k : k + rng.randint(0, 2)] = [word() for _ in range(rng.randint(0, 2))]
        out.append((1000 - 3 * i, " ".join(own[rng.randint(0, 4) : len(own) - rng.randint(0, 4)])))
    return out


@pytest.mark.parametrize("leaders", [(), (1,)])
def test_ngram_join_rounds(spark, prose, monkeypatch, leaders):
    """Pairs are settled in every round; without rounds of leaders, by bounds and one by one."""
    from wickerframe.llm import ngram_jaccard as m

    monkeypatch.setattr(m, "LEADERS", leaders)
    docs = crowd() + [(d + 5000, t) for d, t in prose]
    want = brute.components(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)).collect()}
    assert got == {d: want[i] for i, (d, _) in enumerate(docs)}


def test_ngram_join_near_copies_of_one_text(spark, monkeypatch):
    """Few pairs of a large group are checked: most near copies link by their distance from what is common to all, the
    others only where they depart from it in common, as the copies of a changed copy do."""
    from wickerframe.llm import ngram_jaccard as m

    rng, checked, write = random.Random(8), [], m.shared_table

    def changed(words, k):
        out = words.copy()
        for at in rng.sample(range(len(out)), k):
            out[at] = f"x{rng.randrange(10**9)}"
        return out

    def counted(df, label):
        out = write(df, label)
        if label == "ngram-answers":
            checked.append(out.count())
        return out

    base = [f"w{i}" for i in range(150)]
    branches = [changed(base, 7) for _ in range(12)]
    texts = [base] + [changed(base, rng.choice((1, 2, 3, 4, 5, 6))) for _ in range(400)] + [changed(b, rng.choice((1, 2))) for b in branches for _ in range(5)]
    docs = [(3 * i, " ".join(t)) for i, t in enumerate(rng.sample(texts, len(texts)))]
    monkeypatch.setattr(m, "shared_table", counted)
    monkeypatch.setattr(m, "LEADERS", ())
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in m.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    want = brute.components(docs)
    assert got == {d: want[i] for i, (d, _) in enumerate(docs)}
    assert 10 < len({c for _, c in got.values()}) < 150
    assert sum(checked) < 5 * len(docs)


@pytest.mark.parametrize("percent", [75, 50])
def test_ngram_join_about_a_centre(spark, percent):
    """Without any earlier round: sets linked by their distance from the centre do link, and of the others each link is listed."""
    from wickerframe.llm import ngram_jaccard as m

    rng = random.Random(percent)
    change = lambda own, k: (own - set(rng.sample(sorted(own), k))) | {rng.randrange(1000, 1400) for _ in range(rng.randint(0, k))}
    base = set(range(60))
    branches = [change(base, 25) for _ in range(6)] + [set(range(500, 540)), set(range(20)) | set(range(600, 640))]
    sets = [base] + [change(base, rng.randint(1, 14)) for _ in range(90)] + [change(b, rng.randint(0, 8)) for b in branches for _ in range(8)]
    sets = sorted(map(sorted, {frozenset(x) for x in sets}))
    shared = lambda x: [t for t in x if sum(t in y for y in sets) > 1]
    core = spark.createDataFrame([(i, len(x), shared(x)) for i, x in enumerate(sets)], "node long, n long, shingles array<long>")
    here = core.select("node", "n", F.lit(0).cast("long").alias("lead"), F.lit(0).cast("long").alias("lacks"))
    bound = spark.createDataFrame([(0, 0, 10**6)], "lead long, o_lead long, common long")
    answers = spark.createDataFrame([], "a long, b long")
    links = {(i, j) for j, y in enumerate(sets) for i, x in enumerate(sets[:j]) if 100 * len({*x} & {*y}) >= percent * len({*x} | {*y})}

    centred = m._centred(here, bound, core, percent)
    near = {tuple(sorted(r)) for r in m._about_centre(centred).collect()}
    assert near and near <= links
    labels = m.components(core.select("node", F.col("node").alias("comp")), spark.createDataFrame(sorted(near), "a long, b long"))
    comp = dict(map(tuple, labels.collect()))
    pairs = [tuple(r) for r in m._survivors(centred, labels, bound, answers, percent).collect()]
    assert len(pairs) == len(set(pairs)) and all(comp[a] != comp[b] for a, b in pairs)
    missing = {(a, b) for a, b in links if comp[a] != comp[b]}
    assert missing and missing <= set(pairs)
    assert len(pairs) < len(sets) * len(sets) / 6


@pytest.mark.parametrize("percent", [50])
def test_ngram_join_thresholds(spark, percent):
    docs = crowd(60, seed=3)
    want = brute.components(docs, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), percent=percent).collect()}
    assert got == {d: want[i] for i, (d, _) in enumerate(docs)}


def test_ngram_join_ties_of_hashes(spark):
    """Sets that share the first half of their hash are not judged by the first pass."""
    from wickerframe.llm import ngram_jaccard as m

    rows = [(1, 7, 1, 4, [1, 2, 3, 4]), (2, 7, 2, 4, [5, 6, 7, 8]), (3, 9, 3, 4, [11, 12, 13, 14]), (4, 10, 4, 4, [21, 22, 23, 24]), (5, 11, 5, 4, [21, 22, 23, 25]), (None, 12, 6, 4, [21, 22, 23, 25])]
    sets = spark.createDataFrame(rows, "doc_id long, hi long, lo long, n long, shingles array<long>")
    got = m._can_link(sets, sets.select("hi", F.explode("shingles").alias("t")), 75)
    assert sorted(r.rep for r in got.collect()) == [1, 2, 4, 5]


def test_long_texts_in_pieces(monkeypatch):
    """Pieces of a long text, and of a word longer than a piece, give the hashes of the whole."""
    from wickerframe.llm import ngram_jaccard as m

    texts = [("ab cd  ef\t" * 40 + "x" * 300 + " tail  " + "y" * 64 + "\n").encode(), b" " * 500, b"z" * 333, ("w1 " * 3 + "v" * 200).encode(), b"a b c d e f g"]
    want = m.shingle_sets(texts)
    monkeypatch.setattr(m, "HASH_BYTES", 64)
    got = m.shingle_sets(texts)
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def test_ngram_join_very_long(spark):
    """A text of over two pieces against its near copy."""
    rng = random.Random(4)
    words = [f"w{rng.randrange(50000)}" for _ in range(400_000)]
    docs = [(2, " ".join(words)), (1, " ".join(words[:200_000] + ["x"] * 7 + words[200_000:])), (3, " ".join(words[:100_000]))]
    got = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_ngram_join_empty(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = spark.createDataFrame([(2, None), (1, ""), (3, "a")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_components(only).collect())) == [(1, 0, 1), (2, 0, 2), (3, 1, 3)]


def literal_lines(rows, run=3):
    """Lines with words that stand in a run of `run` lines which an equal run precedes."""
    kept = {}
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    seen, gone = set(), {}
    content = {i: [(p, " ".join(brute.words(x))) for p, x in enumerate((rows[i][1] or "").split("\n")) if brute.words(x)] for i in order}
    for i in order:
        lines = content[i]
        for a in range(len(lines) - run + 1):
            key = tuple(x for _, x in lines[a : a + run])
            if key in seen:
                gone.setdefault(i, set()).update(p for p, _ in lines[a : a + run])
            seen.add(key)
    for i in order:
        t = rows[i][1]
        text = t if i not in gone else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i])
        kept[rows[i][0]] = (len(content[i]), len(gone.get(i, ())), text)
    return kept


def test_line_dedup(spark):
    a, b, c, d, e = "alpha one", "beta two", "gamma three", "delta four", "epsilon five"
    texts = ["\n".join(x) for x in ([a, b, c, d], [e, a, b, c, e], [a, b], [a, b, "", " ", c, d, e], [a, a, a, a, a, a], [c, d, e, a, b, c], [e, "  alpha   one", "beta two ", c + "\t", "x"], [d, e, d, e, d, e, d])]
    texts += ["", None, "\n\n", "one line", "x\ny\nz" + "\nq" * 300]
    rows = [(10 * i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_lines, r.n_deleted, r.clean_text) for r in line_dedup(clashing(spark, rows).repartition(3)).collect()}
    assert got == literal_lines(rows)
    left = line_dedup(spark.createDataFrame([(None, texts[0]), (None, texts[0]), (1, texts[0])], "doc_id long, text string")).collect()
    assert all(r.n_deleted == 0 and r.clean_text == texts[0] for r in left) and len(left) == 3
    assert line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def literal_long_lines(rows, run=3, long_words=50):
    """Lines with words that stand in a run of `run` lines, or of fewer with long_words words, which an equal run precedes."""
    kept, seen = {}, set()
    for d, t in sorted(rows):
        content = [(p, tuple(brute.words(x))) for p, x in enumerate((t or "").split("\n")) if brute.words(x)]
        gone = set()
        for a in range(len(content)):
            for k in range(1, run + 1):
                part = content[a : a + k]
                if len(part) == k and (k == run or sum(len(w) for _, w in part) >= long_words):
                    key = tuple(w for _, w in part)
                    if key in seen:
                        gone.update(p for p, _ in part)
                    seen.add(key)
        kept[d] = (len(content), len(gone), "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone) if gone else t)
    return kept


def test_line_dedup_long_lines(spark):
    """Passages of 50 words and more on one or two lines go as well, also from documents of a single line."""
    long, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(49))
    half, rest = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(20))
    texts = [long, long, f"x\n  {long}\ny", f"{long}\n{rest}", f"p\n{long}\n{rest}\nq", other, other, f"{half}\n{rest}", f"x\n{half}\n\n{rest}\nz", half, f"{long}\n{long}\n{long}", f"{half}\n{rest}\nx\n{half}\n{rest}", None, "", f"{rest}\n{half}", f"{rest}\n{half}", f"a\nb\nc\n{long}", "z\na\nb\nc"]
    rows = [(10 * i, t) for i, t in enumerate(texts)]
    df = clashing(spark, rows).repartition(3)
    got = {r.doc_id: (r.n_lines, r.n_deleted, r.clean_text) for r in line_dedup(df).collect()}
    assert got == literal_long_lines(rows)
    assert got[10] == (1, 1, "") and got[60] == (1, 0, other) and got[80][1] == 2
    got = {r.doc_id: (r.n_lines, r.n_deleted, r.clean_text) for r in line_dedup(df, long_words=None).collect()}
    assert got == literal_lines(rows)


def test_line_dedup_many_lines(spark):
    """Three hundred thousand equal lines, and fifty thousand different ones with a copy: work is in proportion to the lines."""
    same, lines = "the same line\n" * 300_000, [f"line {i}" for i in range(50_000)]
    rows = [(1, same), (2, "\n".join(lines)), (3, "first\n" + "\n".join(lines) + "\nlast")]
    got = {r.doc_id: r for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_lines, got[1].n_deleted) == (300_000, 299_999) and got[1].clean_text == "the same line\n"
    assert got[2].n_deleted == 0 and got[3].clean_text == "first\nlast"


def test_exact_dedup_without_ids(spark):
    """Rows without an id and with one text, in several partitions: one stays."""
    df = spark.createDataFrame([(None, "t") for _ in range(500)] + [(1, "u"), (1, "u")], "doc_id long, text string").repartition(5)
    got = exact_dedup(df).collect()
    assert sum(r.kept for r in got if r.doc_id is None) == 1 and sum(r.kept for r in got if r.doc_id == 1) == 1


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, sf, name):
    """Registered queries against their SQL."""
    import math

    c = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        c.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    got = queries.queries()[name](spark, sf)
    want = c.sql(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    order = lambda cols, data: sorted((tuple(plain(r[cols.index(n)]) for n in sorted(cols)) for r in data), key=repr)
    assert order(got.columns, [tuple(r) for r in got.collect()]) == order(names, want.fetchall())
