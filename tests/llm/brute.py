"""Plain-Python forms of what the operators compute, for small fixtures."""

import hashlib
import math
import re

SPACE, WORD = re.compile("[\x20\x09-\x0d]+"), re.compile("[^\x20\x09-\x0d]+")


def norm(text):
    return SPACE.sub(" ", text or "")


def words(text):
    return WORD.findall(text or "")


def shingles(text, n=5):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset([" ".join(w)] if len(w) < n else [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)])


def components(docs, percent=75):
    """docs: (id, text) pairs. {index: smallest id reachable}."""
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(least[r], d)
    return {i: (len(sets[i]), d if not sets[i] else least[find(i)]) for i, (d, _) in enumerate(docs)}


def level(sizes, weights, total, cap=2.0):
    """Targets by repeated sharing: shares above a cap stop there, the rest is shared again."""
    full, out = set(), {}
    whole = total * sum(sizes.values())
    while True:
        open_ = [s for s in sizes if s not in full]
        rest = whole - sum(cap * sizes[s] for s in full)
        out = {s: cap * sizes[s] if s in full else rest * weights[s] / sum(weights[x] for x in open_) for s in sizes}
        over = [s for s in open_ if out[s] >= cap * sizes[s]]
        if not over:
            return out
        full |= set(over)
        if len(full) == len(sizes):
            return {s: cap * sizes[s] for s in sizes}


def mix_key(doc_id, text, seed="mix"):
    n, t = len(words(text)), text or ""
    u = (int(hashlib.md5(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
    return -math.log(u) / (max(0.1, 1.0 - len(re.findall("[#*$%&|<>!]", t)) / n) if n else 0.1)


def mix(docs, cut_last=True, seed="mix"):
    """docs: (id, text, source). Rows (size, source size, target, taken) in the order of docs."""
    sizes = [len(words(t)) for _, t, _ in docs]
    sources = sorted({s for _, _, s in docs}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(n for n, d in zip(sizes, docs) if d[2] == s) for s in sources}
    goal = level(total, {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}, 1.5)
    taken = [0] * len(docs)
    for s in sources:
        if not total[s]:
            continue
        epochs = math.floor(goal[s] / total[s])
        left = goal[s] - epochs * total[s]
        for i in sorted((i for i, d in enumerate(docs) if d[2] == s), key=lambda i: (mix_key(docs[i][0], docs[i][1], seed), docs[i][0] is not None, docs[i][0] or 0, sizes[i])):
            part = (min(sizes[i], max(0, math.floor(left + 0.5))) if cut_last else sizes[i] if left * 2 >= sizes[i] else 0) if left > 0 else 0
            taken[i] = epochs * sizes[i] + part
            left -= sizes[i]
    return [(sizes[i], total[d[2]], goal[d[2]], taken[i]) for i, d in enumerate(docs)]
