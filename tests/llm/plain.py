"""Plain versions of the training-data operators, for small inputs."""

import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, size):
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) or frozenset([tuple(w)])


def roots(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near_components(texts, size, limit):
    sets = [shingles(t, size) for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2)
             if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= round(100 * limit) * len(sets[i] | sets[j])]
    return [len(s) for s in sets], roots(len(texts), links)


def vector_components(vectors, limit):
    def unit(v):
        if not v or None in v or not np.isfinite(v).all() or not any(v):
            return None
        v = np.array(v, float) / np.abs(v).max()
        return v / np.linalg.norm(v)

    units = [unit(v) for v in vectors]
    links = [(i, j) for i, j in itertools.combinations(range(len(units)), 2)
             if units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= limit]
    count = Counter(itertools.chain.from_iterable(links))
    return [count[i] for i in range(len(units))], roots(len(units), links)


def base_counts(text):
    w = words(text)
    runs = Counter(zip(w, w[1:], w[2:]))
    inside = {k for i in range(len(w) - 2) if runs[tuple(w[i:i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines, seen = 0, set()
    for line in (text or "").split("\n"):
        if words(line):
            lines += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), lines, len(inside))


def repeated_words(texts, length):
    """Places (text, word) of every window that stands twice, with the first place of its copy."""
    places = defaultdict(list)
    for i, text in enumerate(texts):
        w = words(text)
        for s in range(len(w) - length + 1):
            places[tuple(w[s:s + length])].append((i, s))
    return {p: found[0] for found in places.values() if len(found) > 1 for p in found}


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
