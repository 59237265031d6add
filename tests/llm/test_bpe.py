"""BPE against the tokenizers library; the transducer against merging whole words."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wickerframe.llm import bpe


@pytest.fixture(scope="session")
def own(vocabulary):
    return bpe.Vocabulary(vocabulary)


@pytest.fixture(scope="session")
def library(vocabulary):
    t = Tokenizer.from_str(vocabulary)
    t.no_truncation()
    t.no_padding()
    return t


def ids(v, text):
    return [i for block in v.encode(text) for i in block]


TEXTS = [
    "", " ", "Hello WORLD's 123", "it's they're I'll", "été ÉTÉ Straße ẞ", "ΑΣ ΣΑΣ ς", "İstanbul ı", "汉字テスト한국어", "😀👩‍👩‍👧 a\u0301b", "<|endoftext|>a<|startoftext|> <|endoftext",
    "a\u0085b\u00a0c\u2003d\u200be\x1cf\x00g", "नमस्ते दुनिया שלום عليكم", "x" * 3000, "ab" * 2500 + "'s!!" + "é" * 999, "!?" * 800, "1234567890" * 100, "\ufeffbom ﬁ ǅ ㎏", "ȺȾ ɐɑ ʯ", "\u0558\u1c89\ua7cb",
]


@pytest.mark.parametrize("text", TEXTS)
def test_texts(own, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert ids(own, text) == want
    assert "".join(own.decode(own.encode(text))) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(own, library, text):
    assert ids(own, text) == library.encode(text, add_special_tokens=False).ids


def test_transducer(own):
    """Long words of vocabulary pieces: emitted piecewise, equal to merging the whole word; short memory."""
    rng = random.Random(2)
    plain = [t for t in own.tokens if t.isascii() and t.isalpha()]
    for _ in range(15):
        word = "".join(rng.choice(plain) for _ in range(900))
        data = word.encode()
        whole = own.merge([own.inner[b] for b in data[:-1]] + [own.final[data[-1]]])
        assert list(own.stream(word)) == whole


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_lookahead(data):
    """On small merge lists: tokens that end `lookahead` symbols before the end of a prefix stay, whatever follows."""
    made, merges = ["a", "b"], []
    for _ in range(data.draw(st.integers(1, 8))):
        u, v = data.draw(st.sampled_from(made)), data.draw(st.sampled_from(made))
        if (u, v) not in merges and u + v not in made:
            merges.append((u, v))
            made.append(u + v)
    ahead = bpe.lookahead(merges)
    rank = {m: k for k, m in enumerate(merges)}

    def tokens(text):
        out = list(text)
        while True:
            pairs = [(rank[p], k) for k, p in enumerate(zip(out, out[1:])) if p in rank]
            if not pairs:
                return out
            _, k = min(pairs)
            out[k : k + 2] = [out[k] + out[k + 1]]

    def edges(text, upto):
        at, found = 0, []
        for t in tokens(text):
            at += len(t)
            if at <= upto:
                found.append(at)
        return found

    prefix = data.draw(st.text("ab", min_size=1, max_size=30))
    stable = len(prefix) - ahead
    assert edges(prefix + data.draw(st.text("ab", max_size=12)), stable) == edges(prefix, stable)


def test_operator(spark, vocabulary, library, prose):
    rows = [(d, t, [1], "x", "y") for d, t in prose] + [(None, "a b", [2], "x", "y"), (1, prose[0][1], [3], "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, decoded string, Text2 string")
    got = bpe.encode(df, vocabulary, decoded=True)
    found = sorted(((r.doc_id, r.ids, r.decoded) for r in got.collect()), key=repr)
    coded = [(r[0], library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows]
    assert found == sorted(((d, i, library.decode(i, skip_special_tokens=False)) for d, i in coded), key=repr)
    back = bpe.decode(got, vocabulary).collect()
    assert sorted((r.text for r in back)) == sorted(x[2] for x in found)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(empty, vocabulary).count() == 0


@pytest.mark.parametrize("text", [*TEXTS, "word and more. " * 20000, "é" * 70000 + " a \u0301b " * 9000])
def test_digests(own, library, text):
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = library.encode(text, add_special_tokens=False).ids
    assert own.digest(text) == (len(want), sha(" ".join(map(str, want))), sha(library.decode(want, skip_special_tokens=False)))


def test_digest_memory(own):
    """Beyond the text, memory does not grow with it: 2 and 20 MB of words, and one word."""
    import tracemalloc

    for text in ("some words of a very long text, again and again. ", "abcdefghij"):
        peaks = []
        for mb in (2, 20):
            long = text * (mb * 1_000_000 // len(text))
            tracemalloc.start()
            if " " in text:
                own.digest(long)
            else:
                for _ in own.stream(long[: mb * 10_000]):
                    pass
            peaks.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
        assert peaks[1] < peaks[0] + 2_000_000, peaks


def test_digest_operator(spark, vocabulary, prose):
    df = spark.createDataFrame([(d, t, "x") for d, t in prose] + [(None, None, "x")], "doc_id long, text string, n_tokens string")
    own = bpe.Vocabulary(vocabulary)
    got = sorted(map(tuple, bpe.digests(df, vocabulary).collect()), key=repr)
    assert got == sorted(((d, *own.digest(t or "")) for d, t in [*prose, (None, None)]), key=repr)
    assert bpe.digests(df.limit(0), vocabulary).count() == 0


def test_decoder_state(own):
    """Bytes of one character in two pieces; bytes that never complete one."""
    own2 = object.__new__(bpe.Vocabulary)
    own2.pieces = [b"\xc3", b"\xa9", b"a"]
    assert "".join(own2.decode([[2], [0]])) == "a \ufffd"
    del own
