"""N-gram Jaccard join with set-relation skipping.

Documents are sets of word shingles; two link when their Jaccard similarity reaches a threshold. Sets are identified by
128-bit hashes and shingles by 64-bit ones: a wrong answer needs two different shingles of one candidate pair to
collide.

Relations between sets keep the work small, at index level and at answer level:

* Equal sets are one node. What holds for it holds for every copy.
* A shingle that one set alone has is common to no two sets. A set with too many of them links with nothing. A first
  pass counts them among half of all shingles (those with the smaller hashes) and drops such sets; what is left is
  counted in full.
* Index lists hold a set at the positions of its prefix, rarest shingles first, in blocks of similar set size. With size s and position p an
  entry can only match sets of a size from 3/4 s up to (7 (s - p) - 3 s) / 3 (at 0.75): a probing entry reads the
  blocks in that range, and the other blocks of the list are skipped whole.
* A list's entries first meet a few leaders a block. Sets linked to the same leader have the same component: their
  pairs need no check. After that, each set stands with the leader it resembles most. Where two sets' leaders L and M
  are known to share c shingles, and the sets lack d and e shingles of what they have in common with their
  leaders, they share c + d + e at most: one comparison of the leaders answers for all pairs of their followers
  that this excludes, and none of these pairs is listed.
* The other followers are seen from a centre, the shingles that most of them have. Sets so near to it that they link in
  any case are linked to the nearest one, without a check. Others link only if they depart from the centre in common:
  lists of these departures, again rarest first, take the place of the lists of shingles that they all share.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import passing_tables, shared_table, text_of

#: Share of a hundred that the similarity takes, and words of a shingle.
PERCENT, WORDS = 75, 5
#: Bytes of text hashed at once.
HASH_BYTES = 1 << 20
#: Blocks of set sizes that the ratio of two linked sets' sizes can span.
BLOCKS = 4
#: Members of a list's largest component that the list's other entries meet, by round and block, before leaders are compared.
LEADERS = (16,)

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _powers(base: int) -> np.ndarray:
    """Powers of a base modulo 2**64, for a piece of text."""
    return np.concatenate([[_U(1)], np.cumprod(np.full(HASH_BYTES + 1, _U(base), _U))])


with np.errstate(over="ignore"):
    _CODE = _mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
    _CODE[65:91] = _CODE[97:123]  # A-Z count as a-z
    _CODE[_SPACE] = 0
    _SEATS = _mix(np.arange(901, 901 + 64, dtype=_U)) | _U(1)
    _POWER, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of each word of at most HASH_BYTES + 1 bytes that end in a space. A word's hash is a
    polynomial of its bytes, taken from prefix sums, and then mixed."""
    gap = _SPACE[data]
    inside = ~gap
    starts = np.flatnonzero(inside & np.concatenate([[True], gap[:-1]]))
    ends = np.flatnonzero(gap & np.concatenate([[False], inside[:-1]]))
    sums = np.cumsum(_CODE[data] * _POWER[: len(data)])
    before = np.where(starts > 0, sums[starts - 1], _U(0))
    return starts, _mix((sums[ends - 1] - before) * _INVERSE[starts] + (ends - starts).astype(_U))


def _long_word(word: memoryview) -> np.ndarray:
    """The same hash of a word of any length, piece by piece."""
    total = _U(0)
    for at in range(0, len(word), HASH_BYTES):
        piece = np.frombuffer(word[at : at + HASH_BYTES], np.uint8)
        total += (_CODE[piece] * _POWER[: len(piece)]).sum() * _U(pow(_BASE, at, 1 << 64))
    return _mix(np.array([total + _U(len(word))], _U))


def _words_of_long(text: bytes) -> np.ndarray:
    """Word hashes of a text above HASH_BYTES, cut between words; beyond the text, memory is 8 bytes a word."""
    out, at, view = [], 0, memoryview(text)
    while at < len(text):
        upto = min(len(text), at + HASH_BYTES)
        if upto < len(text):
            room = np.flatnonzero(_SPACE[np.frombuffer(view[at:upto], np.uint8)])
            if len(room):
                upto = at + int(room[-1]) + 1
            else:  # one word fills the piece: find its end
                while upto < len(text) and text[upto] not in b"\t\n\v\f\r ":
                    upto += 1
                out.append(_long_word(view[at:upto]))
                at = upto
                continue
        out.append(_word_hashes(np.frombuffer(bytes(view[at:upto]) + b" ", np.uint8))[1])
        at = upto
    return np.concatenate(out)


def _set_of(hashes: np.ndarray, grams: np.ndarray, words: int) -> np.ndarray:
    """Sorted distinct shingles of a text with these word hashes; grams are its runs of words."""
    n = len(hashes)
    if n >= words:
        own = np.sort(grams)
        return own[np.concatenate([[True], own[1:] != own[:-1]])]
    if n:
        return _mix(np.array([_mix(hashes * _SEATS[:n] + _SEATS[n + 40]).sum()], _U) ^ _SEATS[n])
    return hashes


def _grams(hashes: np.ndarray, words: int) -> np.ndarray:
    grams = np.zeros(max(0, len(hashes) - words + 1), _U)
    for k in range(words):
        grams += _mix(hashes[k : len(hashes) - words + 1 + k] * _SEATS[k] + _SEATS[k + 32])
    return _mix(grams)


def shingle_sets(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and the offsets of the texts. Texts are
    hashed together up to HASH_BYTES, longer ones alone and in pieces."""
    out, at = [], 0
    while at < len(texts):
        if len(texts[at]) > HASH_BYTES:
            hashes = _words_of_long(texts[at])
            out.append(_set_of(hashes, _grams(hashes, words), words))
            at += 1
            continue
        upto, size = at, 0
        while upto < len(texts) and size + len(texts[upto]) <= HASH_BYTES:
            size += len(texts[upto]) + 1
            upto += 1
        data = np.frombuffer(b" ".join(texts[at:upto]) + b" ", np.uint8)
        starts, hashes = _word_hashes(data)
        first = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts[at:upto]]))
        grams = _grams(hashes, words)
        out += [_set_of(hashes[a:b], grams[a : max(a, b - words + 1)], words) for a, b in zip(first[:-1], first[1:])]
        at = upto
    return (np.concatenate(out) if out else np.zeros(0, _U)), np.cumsum([0, *map(len, out)])


def _set_hash(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers; they do not depend on the order."""
    sums = np.array([_mix(tokens ^ _SEATS[60]).sum(), _mix(tokens ^ _SEATS[61]).sum()], _U)
    return tuple(_mix(sums + _U(len(tokens)) * _SEATS[62:64]).view(np.int64).tolist())


def _sets(rows: DataFrame, words: int, what: str) -> DataFrame:
    """Of each row (doc_id, text), by what: "name" gives doc_id, the set's hash (hi, lo) and its size n; "set" gives its
    shingles besides; "half" gives a row (hi, t) for each shingle t in the smaller half of hashes."""
    schema = {"name": "doc_id long, hi long, lo long, n long", "set": "doc_id long, hi long, lo long, n long, shingles array<long>", "half": "hi long, t long"}[what]

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                column = batch.column(1).cast(pa.large_binary())
                for start in range(0, batch.num_rows, 128):
                    texts = column.slice(start, 128).to_pylist()
                    flat, offsets = shingle_sets(texts, words)
                    named = np.array([_set_hash(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], np.int64).reshape(-1, 2)
                    sizes = np.diff(offsets)
                    if what == "half":
                        low = flat < _U(1 << 63)
                        out = [pa.array(np.repeat(named[:, 0], sizes)[low]), pa.array(flat[low].view(np.int64))]
                    else:
                        out = [batch.column(0).slice(start, 128), pa.array(named[:, 0]), pa.array(named[:, 1]), pa.array(sizes.astype(np.int64))]
                    if what == "set":
                        out.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int64))))
                    yield pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in schema.split(", ")])

    return rows.mapInArrow(run, schema)


def _can_link(sketch: DataFrame, half: DataFrame, percent: int) -> DataFrame:
    """rep: of each set that can link at all, the smallest id; from (doc_id, hi, lo, n) and (hi, t).

    A set with u shingles that no other set has shares n - u at most, so it needs 100 (n - u) >= percent n. Shingles
    are grouped with the smallest and the largest of their sets' hashes (first 64 bits), combined on the map side:
    however many sets share a shingle, or copies a set, a task sends one row. Sets whose 64 bits another set has are
    kept as they are.
    """
    seen = half.groupBy("t").agg(F.min("hi").alias("a"), F.max("hi").alias("b"))
    alone = seen.where("a = b").groupBy(F.col("a").alias("u_hi")).agg(F.count(F.lit(1)).alias("u"))
    sets = sketch.where("n > 0").groupBy("hi").agg(F.min("lo").alias("lo"), F.max("lo").alias("lo2"), F.min("doc_id").alias("rep"), F.min("n").alias("n"))
    judged = sets.join(alone, F.col("hi") == F.col("u_hi"), "left")
    fine = judged.where((F.col("lo") == F.col("lo2")) & (100 * F.coalesce("u", F.lit(0)) <= (100 - percent) * F.col("n"))).select("rep")
    shared_bits = sets.where("lo != lo2").select(F.col("hi").alias("s_hi"))
    others = sketch.join(shared_bits, F.col("hi") == F.col("s_hi"), "left_semi").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep")).select("rep")
    return fine.unionByName(others).where("rep is not null").distinct()


def _verified(pairs: DataFrame, core: DataFrame) -> DataFrame:
    """pairs (a, b) with n_a, n_b and the size of the intersection. Each pair ships one of its two sets."""
    a = core.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("of_a"))
    b = core.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("of_b"))
    both = pairs.select("a", "b").join(a, "a").join(b, "b")
    return both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("of_a", "of_b")).cast("long").alias("common"))


def _links(n_a: Column, n_b: Column, common: Column, percent: int) -> Column:
    return 100 * common >= percent * (n_a + n_b - common)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, comp) of nodes (node, comp) and edges (a, b) between them: comp is the smallest comp of the connected
    component, where nodes that share a comp are connected as well.

    Works on the comps: each takes the smallest among itself and its neighbours, then the one that this one has,
    until nothing changes. Labels are a narrow written table a round; nothing is collected but a flag.
    """
    label = nodes.select(F.col("node").alias("x"), F.col("comp").alias("l"))
    ends = edges.join(label.select(F.col("x").alias("a"), F.col("l").alias("u")), "a").join(label.select(F.col("x").alias("b"), F.col("l").alias("v")), "b")
    ends = ends.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    ends = shared_table(ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))), "component-edges")
    if ends.isEmpty():
        return nodes.select("node", "comp")
    roots = shared_table(ends.groupBy("u").agg(F.least("u", F.min("v")).alias("l")), "component-roots")
    while True:
        jump = roots.select(F.col("u").alias("w"), F.col("l").alias("m"))
        near = ends.join(jump, ends.v == jump.w).groupBy(F.col("u").alias("e")).agg(F.min("m").alias("m2"))
        step = roots.join(jump, roots.l == jump.w, "left").join(near, F.col("u") == F.col("e"), "left")
        step = step.select("u", F.least("l", "m", "m2").alias("l"), (F.least("l", "m", "m2") != F.col("l")).alias("moved"))
        roots = shared_table(step, "component-roots")
        if roots.where("moved").isEmpty():
            break
        roots = roots.drop("moved")
    found = roots.select(F.col("u").alias("r_u"), F.col("l").alias("r_l"))
    return nodes.join(found, F.col("comp") == F.col("r_u"), "left").select("node", F.coalesce("r_l", "comp").alias("comp"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    A text is lower-cased (A-Z) and cut at white space; its set holds the distinct runs of `words` words, or the
    whole sequence if it is shorter. Null texts count as empty; a text without words has an empty set, links with
    nothing and is its own component. Rows with equal sets are linked; component_id is the smallest doc_id reachable.
    A row without an id is linked as a copy only: it takes the component of an equal set that has an id, else null.
    Repeated rows and repeated ids are judged row by row, by their texts. Texts may be of any length; a task holds a text
    and some 30 bytes a word of it. Other columns are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(text_of(F.col(text_col)), "UTF-8").alias("text"))
    with passing_tables("ngram-sketch", "ngram-result"):
        sketch, groups = _groups(rows, percent, words)
    out = sketch.select("doc_id", "hi", "lo", "n").join(groups, (F.col("hi") == F.col("g_hi")) & (F.col("lo") == F.col("g_lo")), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _groups(rows: DataFrame, percent: int, words: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, hi, lo, n) of all rows (doc_id, text); (g_hi, g_lo, component) of the sets that several documents have or
    that link with another."""
    sketch = shared_table(_sets(rows, words, "name"), "ngram-sketch")
    alive = shared_table(_can_link(sketch, _sets(rows, words, "half"), percent), "ngram-alive")
    sets = shared_table(_sets(rows.join(alive, rows.doc_id == alive.rep, "left_semi").select("doc_id", "text"), words, "set").where("n > 0"), "ngram-sets")
    linked = _link(sets, percent)

    # Back to the documents. Only sets of several documents and linked ones are carried on: (hi, lo, component).
    first = sketch.where("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("c"))
    named = shared_table(first.join(linked.withColumnsRenamed({"hi": "l_hi", "lo": "l_lo"}), (F.col("hi") == F.col("l_hi")) & (F.col("lo") == F.col("l_lo")), "left").where("c > 1 or comp is not null").select("hi", "lo", "first", "comp"), "ngram-first")
    least = shared_table(named.where("comp is not null").groupBy(F.col("comp").alias("l_comp")).agg(F.min("first").alias("component")), "ngram-least")
    groups = named.join(least, F.col("comp") == F.col("l_comp"), "left").select(F.col("hi").alias("g_hi"), F.col("lo").alias("g_lo"), F.coalesce("component", "first").alias("component"))
    return sketch, shared_table(groups, "ngram-result")


def _link(sets: DataFrame, percent: int) -> DataFrame:
    """(hi, lo, comp) for every set that may link with another, from sets (hi, lo, n, shingles); equal comps are linked."""
    least_partner = F.ceil(percent * F.col("n") / 100)
    places = sets.select("hi", "lo", "n", F.explode("shingles").alias("t"))
    df = shared_table(sets.select(F.explode("shingles").alias("d_t")).groupBy("d_t").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "ngram-frequencies")
    common = places.join(df, F.col("t") == F.col("d_t")).groupBy("hi", "lo", "n").agg(F.sort_array(F.collect_set(F.struct("df", "t"))).alias("s"))
    core = common.where(100 * F.size("s") >= percent * F.col("n")).select("hi", "lo", "n", F.transform("s", lambda x: x["t"]).alias("shingles"))
    # Written with its number, so the number stays.
    core = shared_table(core.withColumn("node", F.monotonically_increasing_id()), "ngram-core")

    # Index entries: a set's prefix. Its unshared shingles come first and take positions, but no entries.
    alone = F.col("n") - F.size("shingles")
    prefix = F.greatest(F.lit(0), F.col("n") - least_partner + 1 - alone).cast("int")
    entries = core.select("node", "n", alone.alias("alone"), F.posexplode(F.slice("shingles", F.lit(1), prefix)).alias("i", "t"))
    left = F.col("n") - F.col("alone") - F.col("i")
    entries = entries.withColumn("most", F.floor(((100 + percent) * left - percent * F.col("n")) / percent)).where(F.col("most") >= least_partner)
    entries = entries.select("t", "node", "n", "most", least_partner.alias("least"), _block(F.col("n"), percent).alias("block"))
    entries = shared_table(entries, "ngram-entries")

    fits = (F.col("n") <= F.col("o_most")) & (F.col("o_n") <= F.col("most"))
    apart = F.col("comp") != F.col("o_comp")
    same_block = (F.col("t") == F.col("o_t")) & (F.col("block") == F.col("o_block"))
    kinds = ("node", "n", "most", "comp")
    pair = F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b")

    def linked(found: DataFrame) -> DataFrame:
        return found.where(_links(F.col("n_a"), F.col("n_b"), F.col("common"), percent)).select("a", "b")

    def leaders(here: DataFrame, seats: int, turn: int) -> DataFrame:
        """In each block of each list, the sets with the smallest hash of each seat: the same ones in as many lists as can be."""
        seat = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(seats)).alias("seat")
        pick = F.min_by(F.struct(*kinds), F.struct(F.xxhash64("node", F.lit(-turn)), F.col("node")))
        found = here.groupBy("t", "block", seat).agg(pick.alias("o"))
        return shared_table(found.select(F.col("t").alias("o_t"), F.col("block").alias("o_block"), *[F.col(f"o.{k}").alias(f"o_{k}") for k in kinds]), "ngram-leaders")

    # First, every entry meets the leader of its own block.
    here = entries.withColumn("comp", F.col("node"))
    met = here.join(leaders(here, 1, 0), same_block).where(apart & fits).select(*pair).distinct()
    answers = shared_table(_verified(met, core), "ngram-answers")
    labels = shared_table(components(core.select("node", F.col("node").alias("comp")), linked(answers)), "ngram-labels")

    # Then only lists of several components count, and of these the entries outside the list's largest one meet some
    # more leaders of the largest, in all blocks in their reach.
    for turn, seats in enumerate((*LEADERS, None), 1):
        per = entries.join(labels, "node").groupBy("t", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("t").agg(F.max_by("comp", F.struct("c", "comp")).alias("major"), F.count(F.lit(1)).alias("k"))
        mixed = shared_table(per.where("k > 1").select(F.col("t").alias("p_t"), "major"), "ngram-mixed-lists")
        if mixed.isEmpty():
            break
        here = shared_table(entries.join(mixed, F.col("t") == F.col("p_t")).drop("p_t").join(labels, "node"), "ngram-mixed")
        if seats is None:
            followers, bound = _bounds(here, answers, core, percent)
            centred = _centred(followers, bound, core, percent)
            labels = shared_table(components(labels, _about_centre(centred)), "ngram-labels")
            pairs = _survivors(centred, labels, bound, answers, percent)
        else:
            probes = _probes(here.where("comp != major"), F.col("least"), F.col("most"), percent)
            pairs = probes.join(leaders(here.where("comp = major"), seats, turn), same_block).where(apart & fits).select(*pair).distinct()
            pairs = pairs.join(answers.select("a", "b"), ["a", "b"], "left_anti")
        new = shared_table(_verified(pairs, core), "ngram-answers")
        if new.isEmpty():
            continue
        answers = answers.unionByName(new)
        labels = shared_table(components(labels, linked(new)), "ngram-labels")
    return core.select("node", "hi", "lo").join(labels, "node").select("hi", "lo", "comp")


def _block(size: Column, percent: int) -> Column:
    """Number of the block of a set size: steps of its logarithm, BLOCKS of them for the ratio of two linked sets' sizes."""
    return F.floor(F.log(size) / F.lit(math.log(100 / min(percent, 99)) / BLOCKS) + 1e-9)


def _probes(here: DataFrame, low: Column, high: Column, percent: int) -> DataFrame:
    """Entries once for each block that holds sets of the sizes low to high, and for no other."""
    return here.withColumn("block", F.explode(F.sequence(_block(F.greatest(low, F.lit(1)), percent), _block(high, percent))))


def _need(n: Column, o_n: Column, percent: int) -> Column:
    """Shingles that two sets of these sizes share at least if they link."""
    return F.ceil(percent * (n + o_n) / (100 + percent))


def _bounds(here: DataFrame, answers: DataFrame, core: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Entries (t, block, node, n, most, least, comp) with their lead and what they lack of it; and (lead, o_lead, common), in
    both orders, of the leaders whose followers may link with each other by what is known of the leaders.

    A set's leader is the set of the answers with which it has most in common, if that is nearly all of it, else
    the set itself. Leaders meet where followers of theirs share a block in reach; |x & y| <= |L & M| + |x - L| + |y - M|
    then excludes most pairs of leaders with all their followers.
    """
    near = F.struct(F.col("b").alias("lead"), (F.col("n_a") - F.col("common")).alias("lacks"))
    both = answers.select("a", "b", "n_a", "common").unionByName(answers.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n_b").alias("n_a"), "common"))
    lead = both.where(100 * F.col("common") >= percent * F.col("n_a")).groupBy("a").agg(F.max_by(near, F.struct("common", "b")).alias("l")).select(F.col("a").alias("l_a"), "l.lead", "l.lacks")
    here = here.join(shared_table(lead, "ngram-lead"), F.col("node") == F.col("l_a"), "left").drop("l_a", "major")
    here = shared_table(here.withColumns({"lead": F.coalesce("lead", "node"), "lacks": F.coalesce("lacks", F.lit(0))}), "ngram-followers")

    group = here.groupBy("t", "block", "lead").agg(F.min("n").alias("n"), F.min("least").alias("least"), F.max("n").alias("n_top"), F.max("most").alias("most"), F.max("lacks").alias("lacks"), F.min("comp").alias("comp"), F.max("comp").alias("comp_top"))
    group = shared_table(group, "ngram-groups-of-lists")
    other = group.select(*[F.col(c).alias(f"o_{c}") for c in group.columns])
    met = _probes(group, F.col("least"), F.least("n_top", "most"), percent).join(other, (F.col("t") == F.col("o_t")) & (F.col("block") == F.col("o_block")))
    mixed = (F.col("comp") != F.col("comp_top")) | (F.col("comp") != F.col("o_comp")) | (F.col("comp") != F.col("o_comp_top"))
    met = met.where(mixed & (F.col("n") <= F.col("o_most")) & (F.col("o_n") <= F.col("most")))
    pairs = met.groupBy(F.least("lead", "o_lead").alias("a"), F.greatest("lead", "o_lead").alias("b")).agg(F.max(F.col("lacks") + F.col("o_lacks") - _need(F.col("n"), F.col("o_n"), percent)).alias("slack"))
    pairs = shared_table(pairs, "ngram-lead-pairs")
    known = answers.select("a", "b", "common").unionByName(_verified(pairs.where("a != b").join(answers, ["a", "b"], "left_anti").select("a", "b"), core).select("a", "b", "common"))
    of_one = core.select(F.col("node").alias("a"), F.col("node").alias("b"), F.col("n").alias("common"))
    bound = pairs.join(known.unionByName(of_one), ["a", "b"]).where(F.col("common") + F.col("slack") >= 0).select("a", "b", "common")
    bound = shared_table(bound.unionByName(bound.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b"), "common")).withColumnsRenamed({"a": "lead", "b": "o_lead"}), "ngram-bounds")

    return here, bound


def _centred(here: DataFrame, bound: DataFrame, core: DataFrame, percent: int) -> DataFrame:
    """(fam, node, n, lead, lacks, sig, away) of the followers of leaders with a bound, from (node, n, lead, lacks) in `here`.

    Leaders that bounds connect are one family. Its centre holds the shingles that more than half of its sets have; away
    is the symmetric difference of a set and the centre, without the shingles that one set alone has, and m its size with
    them. x and y differ in m_x + m_y - 2 |away_x & away_y| shingles, so they link when
    2 (100 + percent) |away_x & away_y| >= sig_x + sig_y, with sig = (100 + percent) m - (100 - percent) n.
    """
    leads = bound.select(F.col("lead").alias("node"), F.col("lead").alias("comp")).distinct()
    family = components(leads, bound.where("lead < o_lead").select(F.col("lead").alias("a"), F.col("o_lead").alias("b"))).withColumnsRenamed({"node": "f_lead", "comp": "fam"})
    who = here.select("node", "n", "lead", "lacks").distinct().join(family, F.col("lead") == F.col("f_lead")).drop("f_lead")
    members = shared_table(who.join(core.select("node", "shingles"), "node"), "ngram-members")

    # What a family has in one row is written before its sets join it: such a join can be split where a family is large.
    several = shared_table(members.groupBy("fam").agg(F.count(F.lit(1)).alias("k")), "ngram-families")
    seen = members.select("fam", F.explode("shingles").alias("c_t")).groupBy("fam", "c_t").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    centre = shared_table(seen.join(several, "fam").where("2 * c > k").groupBy("fam").agg(F.collect_list("c_t").alias("centre")), "ngram-centres")
    both = members.join(centre, "fam", "left").withColumn("centre", F.coalesce("centre", F.array().cast("array<long>")))
    both = both.withColumns({"more": F.array_except("shingles", "centre"), "less": F.array_except("centre", "shingles")})
    m = F.col("n") - F.size("shingles") + F.size("more") + F.size("less")
    sig = (100 + percent) * m - (100 - percent) * F.col("n")
    return shared_table(both.select("fam", "node", "n", "lead", "lacks", sig.alias("sig"), F.concat("more", "less").alias("away")), "ngram-centred")


def _about_centre(centred: DataFrame) -> DataFrame:
    """Links (a, b) of each family's set nearest to the centre. Two sets that link whatever their `away` share, as their sig
    add up to 0 or less, both have one with it."""
    nearest = shared_table(centred.groupBy("fam").agg(F.min_by(F.struct("node", "sig"), F.struct("sig", "node")).alias("o")), "ngram-nearest")
    near = centred.join(nearest, "fam").where((F.col("sig") + F.col("o.sig") <= 0) & (F.col("node") != F.col("o.node")))
    return near.select(F.col("node").alias("a"), F.col("o.node").alias("b"))


def _survivors(centred: DataFrame, labels: DataFrame, bound: DataFrame, answers: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may link, once _about_centre is in the labels: their sig add up to more
    than 0, so they meet in a list of what sets of a family have away from its centre, and early enough in it.

    Only lists of several components count. A set has them by frequency, rarest first; what other lists it is in, no
    set of another component shares. The sets outside a family's largest component probe, block by block.
    """
    here = centred.join(labels, "node")
    per = here.groupBy("fam", "comp").agg(F.count(F.lit(1)).alias("c"), F.min("sig").alias("low"))
    per = per.groupBy("fam").agg(F.max_by("comp", F.struct("c", "comp")).alias("major"), F.min("low").alias("low"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    here = shared_table(here.join(shared_table(per, "ngram-majors"), "fam"), "ngram-apart")
    spots = here.select("fam", "node", "comp", F.explode("away").alias("t"))
    lists = spots.groupBy("fam", "t").agg(F.count(F.lit(1)).alias("f"), F.min("comp").alias("comp"), F.max("comp").alias("comp_top")).where("comp != comp_top").select("fam", "t", "f")
    places = spots.select("fam", "node", "t").join(lists, ["fam", "t"]).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("f", "t"))).alias("s"))
    entries = here.drop("away").join(places, "node").select("fam", "node", "n", "lead", "lacks", "sig", "comp", "major", "low", F.size("s").alias("z"), F.posexplode("s").alias("i", "x"))
    # most: the largest sig of a set that links and meets this one here first; rest: what the two can share after it.
    entries = entries.withColumns({"t": F.col("x.t"), "most": 2 * (100 + percent) * (F.col("z") - F.col("i")) - F.col("sig"), "rest": F.col("z") - F.col("i") - 1, "block": _block(F.col("n"), percent)})
    entries = shared_table(entries.where("most >= low").drop("x", "z", "i", "low"), "ngram-found")

    other = entries.select(*[F.col(c).alias(f"o_{c}") for c in entries.columns])
    probes = _probes(entries.where("comp != major"), F.ceil(percent * F.col("n") / 100), F.floor(100 * F.col("n") / percent), percent)
    same_list = (F.col("fam") == F.col("o_fam")) & (F.col("t") == F.col("o_t")) & (F.col("block") == F.col("o_block"))
    once = (F.col("comp") != F.col("o_comp")) & ((F.col("o_comp") == F.col("major")) | (F.col("node") < F.col("o_node")))
    met = probes.join(other, same_list & once & (F.col("sig") <= F.col("o_most")) & (F.col("o_sig") <= F.col("most")))
    # Of two sets, all that they share up to the last list seen is counted.
    met = met.groupBy("node", "n", "sig", "lead", "lacks", "o_node", "o_n", "o_sig", "o_lead", "o_lacks").agg(F.count(F.lit(1)).alias("shared"), F.min(F.least("rest", "o_rest")).alias("after"))
    met = met.where(2 * (100 + percent) * (F.col("shared") + F.col("after")) >= F.col("sig") + F.col("o_sig")).join(bound, ["lead", "o_lead"])
    met = met.where(F.col("common") + F.col("lacks") + F.col("o_lacks") >= _need(F.col("n"), F.col("o_n"), percent))
    return met.select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b")).join(answers.select("a", "b"), ["a", "b"], "left_anti")
