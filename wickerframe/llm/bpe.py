"""BPE encoding and decoding with a bounded-lookahead streaming transducer.

Greedy BPE over a word depends on all of it in principle, but what follows a prefix can change the prefix's tokens
only near its end. lookahead() computes from the merge list how near. The encoder therefore buffers a little more
than that many symbols, emits the tokens that end before the unstable part, and keeps the rest: its memory does
not grow with the word. A text is normalised and cut into pieces a segment at a time. The decoder pushes the bytes of
one id after another through an incremental UTF-8 state machine. digests() carries ids and decoded bytes straight
into running hashes, so that beyond the text itself its memory does not grow with the text.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .shared import text_of

#: White space as the vocabulary's normaliser has it (Unicode White_Space). (fixed values)
_SPACES = "\t-\r \x85\xa0  -     　"
_SPACE_RUN = re.compile(f"[{_SPACES}]+")
#: Texts of Latin letters, digits and common signs are split by the faster of Python's two pattern engines.
_OTHER = re.compile("[^\x00-\u0239\u2010-\u2027\u20ac]")
_LATIN, _DIGIT = "a-zªµºß-öø-ʯ", "0-9²³¹¼-¾"
_LATIN_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[{_DIGIT}]|[^{_SPACES}{_LATIN}{_DIGIT}]+")
#: Anything outside these blocks: the Unicode versions of Python's and the library's tables may differ there.
_NEWER = re.compile("[^\x00-\u0557\u1e00-\u206f\u20a0-\u20bf\u2100-\u218b\u2190-\u2426\u2460-\u2bff\u3000-\u312f\u3400-\u4dbf\u4e00-\u9ffc\uac00-\ud7a3\uf900-\ufaff\uff00-\uffef\U0001f300-\U0001f64f]")
_PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACES}\p{{L}}\p{{N}}]+")

#: Symbols beyond the lookahead that the encoder collects before it looks for stable tokens.
SLACK = 64
#: Words whose tokens are remembered: two generations of this many.
MEMO = 1 << 17
#: Pieces of a text that are in work at once; tokens of a batch that goes to the JVM.
BLOCK, BATCH_TOKENS = 4096, 1 << 19
#: Characters of a text that are normalised and cut into pieces at once, at least; a segment ends before a space.
SEGMENT = 1 << 16
#: Where a text may be cut: before a space that an ASCII letter or digit follows, so that nothing is composed across it.
_CUT = re.compile(" (?=[A-Za-z0-9])")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is visible Latin-1, else one from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in set(visible) else chr(next(hidden)) for b in range(256)]


def lookahead(merges: list[tuple[str, str]]) -> int:
    """How many symbols before the end of a prefix its tokens can still depend on what follows.

    Take two continuations of one prefix. Left of some position both have the same tokens; at the position the
    tokens differ. That position moves left only when, in one of them, a rule (u, v) merges the token u that ends
    there: then it moves by len(u). The next move needs a rule (u', v') that comes later in the list (earlier
    ones have been applied alike) whose v' begins where u begins, so v' begins with u. The longest such chain,
    weighted by len(u), is the bound. Rules are walked from last to first; reach[x] is the longest chain that can
    follow a move by x.

    The argument needs a proper list: parts of a rule are single symbols or results of earlier rules.
    """
    made: set[str] = set()
    for u, v in merges:
        for part in (u, v):
            if len(part.removesuffix("</w>")) > 1 and part not in made:
                raise ValueError(f"the merge list uses {part!r} before it is made")
        made.add(u + v)
    reach: dict[str, int] = {}
    longest = 0
    for u, v in reversed(merges):
        chain = len(u) + reach.get(u, 0)
        longest = max(longest, chain)
        for n in range(1, len(v) + 1):
            if reach.get(v[:n], 0) < chain:
                reach[v[:n]] = chain
    return longest


class Vocabulary:
    """What a tokenizer file says: symbols, merges by rank, special strings. Its size bounds what is broadcast."""

    def __init__(self, source: str) -> None:
        j = json.loads(source)
        model = j["model"]
        suffix = model["end_of_word_suffix"]
        if j["decoder"] is not None or suffix != "</w>":
            raise ValueError("a word-end BPE file without a decoder is expected")
        vocab: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in j["added_tokens"]}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.tokens: list[str] = [""] * (max([*vocab.values(), *special.values()]) + 1)
        for text, i in (vocab | special).items():
            self.tokens[i] = text
        self.special = special
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.final = [vocab[s + suffix] for s in symbols]
        self.ranks = {(vocab[u], vocab[v]): rank for rank, (u, v) in reversed([*enumerate(merges)])}
        self.made = [vocab[u + v] for u, v in merges]
        self.width = [len(t.removesuffix(suffix)) for t in self.tokens]
        self.ahead = lookahead(merges)
        self.pieces = [t.encode() for t in self.tokens]
        self.source, self._library = source, None
        self._young: dict[str, tuple[int, ...]] = {}
        self._old: dict[str, tuple[int, ...]] = {}

    def merge(self, ids: list[int]) -> list[int]:
        """Greedy BPE: again and again the pair of lowest rank, the leftmost of equals."""
        rank, none = self.ranks.get, len(self.made)
        ranks = [rank(pair, none) for pair in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < none:
            k = ranks.index(best)
            ids[k : k + 2] = [self.made[best]]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = rank((ids[k], ids[k + 1]), none)
            if k:
                ranks[k - 1] = rank((ids[k - 1], ids[k]), none)
        return ids

    def word(self, piece: str) -> Iterable[int]:
        """The ids of one pre-token. A short one ends before the transducer's buffer is full, so it is merged in
        one go, and remembered."""
        if len(piece) > SLACK:
            return self.stream(piece)
        found = self._old.get(piece)
        if found is None:
            data = piece.encode()
            ids = [self.inner[b] for b in data]
            ids[-1] = self.final[data[-1]]
            found = tuple(self.merge(ids))
        if len(self._young) >= MEMO:
            self._old, self._young = self._young, {}
        self._young[piece] = found
        return found

    def stream(self, piece: str) -> Iterator[int]:
        """The transducer: ids of a word of any length, each emitted once nothing that follows can change it."""
        held: list[int] = []  # symbols not yet emitted; the last byte of the word waits in `late`
        late: int | None = None
        room = self.ahead + SLACK
        for start in range(0, len(piece), SLACK):
            for byte in piece[start : start + SLACK].encode():
                if late is not None:
                    held.append(self.inner[late])
                late = byte
                if len(held) >= room:
                    stable, done = len(held) - self.ahead, 0
                    for token in self.merge(held.copy()):
                        if done + self.width[token] > stable:
                            break
                        done += self.width[token]
                        yield token
                    del held[:done]
                    room = max(self.ahead + SLACK, len(held) + SLACK)
        if late is not None:
            yield from self.merge([*held, self.final[late]])

    def pieces_of(self, text: str) -> list[str]:
        """Pre-tokens of the normalised text: NFC, white space to single spaces, lower case character by character
        (no final sigma rule). Scripts on whose newest characters Unicode versions differ are normalised and split
        by the tokenizer library's own parts."""
        if text.isascii() or not _OTHER.search(text):
            text = _SPACE_RUN.sub(" ", unicodedata.normalize("NFC", text)).lower()
            return _LATIN_PIECE.findall(text)
        if not _NEWER.search(text):
            text = _SPACE_RUN.sub(" ", unicodedata.normalize("NFC", text).replace("Σ", "σ")).lower()
            return _PIECE.findall(text)
        if self._library is None:
            self._library = Tokenizer.from_str(self.source)
            self._split_only = self._library.pre_tokenizer[0]
        text = self._library.normalizer.normalize_str(text)
        spans = self._split_only.pre_tokenize_str(text)
        return [text[a:b] for _, (a, b) in spans]

    def encode(self, text: str) -> Iterator[list[int]]:
        """Blocks of ids of a text of any length, segment by segment."""
        at = 0
        while len(text) - at > SEGMENT and (cut := _CUT.search(text, at + SEGMENT)):
            yield from self._encode(text[at : cut.start()])
            at = cut.start()
        yield from self._encode(text[at:] if at else text)

    def _encode(self, text: str) -> Iterator[list[int]]:
        block: list[int] = []
        for part in self.split.split(text) if self.split and "<" in text else (text,):
            if part in self.special:
                block.append(self.special[part])
                continue
            own = self.pieces_of(part)
            for start in range(0, len(own), BLOCK):
                known = self._young.get
                for piece in own[start : start + BLOCK]:
                    if not (ids := known(piece)):
                        ids = self.word(piece)
                        known = self._young.get
                    if len(piece) <= SEGMENT:
                        block.extend(ids)
                        continue
                    for token in ids:
                        block.append(token)
                        if len(block) >= BLOCK:
                            yield block
                            block = []
                yield block
                block = []
        if block:
            yield block

    def decode(self, blocks: Iterable[Iterable[int]]) -> Iterator[str]:
        """Text of blocks of ids, piece by piece; ids are joined by a space, as the file names no decoder.

        The machine's state is the bytes of a character that is not complete yet; bytes that never complete one
        come out as U+FFFD.
        """
        machine, between = codecs.getincrementaldecoder("utf-8")("replace"), False
        for block in blocks:
            data = b" ".join([self.pieces[i] for i in block])
            if data:
                yield machine.decode(b" " + data if between else data)
                between = True
        yield machine.decode(b"", True)


    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids in decimal, SHA-256 of the decoded text."""
        n, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()

        def counted() -> Iterator[list[int]]:
            nonlocal n
            for block in self.encode(text):
                if block:
                    ids.update((" " * (n > 0) + " ".join(map(str, block))).encode())
                    n += len(block)
                    yield block

        for piece in self.decode(counted()):
            decoded.update(piece.encode())
        return n, ids.hexdigest(), decoded.hexdigest()


_loaded: dict[int, Vocabulary] = {}


def _vocabulary(shared) -> Vocabulary:
    """Built once in each Python worker."""
    key = hash(shared.value)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(shared.value)
    return _loaded[key]


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """One row per input row: doc_id, ids array<int>, and decoded string if asked for.

    vocabulary: the content of a tokenizer file (a fixed size, so it is broadcast); the executors need no file.
    Null texts count as empty and give no ids and an empty text. Repeated rows, null ids and other columns change
    nothing; an empty table gives an empty one. There is no shuffle: each row is encoded where it is read, in
    blocks of pieces, and output batches are closed by their number of tokens.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(F.col(text_col)).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches):
        v = _vocabulary(shared)
        for batch in batches:
            keep, ids, offsets, texts = 0, [], [0], []
            for row, text in enumerate(batch.column(1)):
                own = [i for block in v.encode(text.as_py()) for i in block]
                ids.append(pa.array(own, pa.int32()))
                offsets.append(offsets[-1] + len(own))
                if decoded:
                    texts.append("".join(v.decode(own[k : k + BLOCK] for k in range(0, len(own), BLOCK))))
                if offsets[-1] >= BATCH_TOKENS or row + 1 == batch.num_rows:
                    columns = [batch.column(0).slice(keep, row + 1 - keep), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays(ids))]
                    yield pa.RecordBatch.from_arrays(columns + ([pa.array(texts, pa.string())] if decoded else []), names=["doc_id", "ids", "decoded"][: 2 + decoded])
                    keep, ids, offsets, texts = row + 1, [], [0], []

    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>" + (", decoded string" if decoded else ""))


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256 (hex of the decimal ids joined by one space) and
    decoded_sha256 (hex of the decoded text in UTF-8). The same texts, nulls and rows as encode(); ids are hashed as
    they come out and are never together in memory."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(F.col(text_col)).alias("text"))

    def run(batches):
        v = _vocabulary(shared)
        for batch in batches:
            found = [v.digest(text.as_py()) for text in batch.column(1)]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: doc_id, text. Null ids decode as an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))

    def run(batches):
        v = _vocabulary(shared)
        for batch in batches:
            texts = ["".join(v.decode([own.as_py()])) for own in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string")
