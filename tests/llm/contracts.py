"""Plain Python forms of the operators' contracts, for small tables."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or {tuple(words)}


def jaccard_components(rows, n, percent):
    """{id: (set size, component)} over all pairs of (id, text)."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    seen = {(a, b) for ks in holders.values() for n_, a in enumerate(ks) for b in ks[n_ + 1 :]}
    for a, b in seen:
        (i, s), (j, t) = sets[a], sets[b]
        if 100 * len(s & t) >= percent * len(s | t):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets}
