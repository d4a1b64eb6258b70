"""Brute-force versions and tables of awkward rows shared by the tests."""

import random
import re

BLANK = rb"[^\x20\x09-\x0D]+"
ALNUM = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text, pattern=BLANK):
    return re.findall(pattern, re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def shingles(text, n):
    w = words(text)
    return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i:i + n]) for i in range(len(w) - n + 1)])


def jaccard_components(docs, n, percent):
    """doc position -> smallest id reachable (None ids never smallest)."""
    sets = [shingles(t, n) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(docs):
        ids.setdefault(find(i), []).append(d)
    out = []
    for i in range(len(docs)):
        known = [d for d in ids[find(i)] if d is not None]
        out.append((len(sets[i]), min(known) if known else None))
    return out


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def edited(text, seed, share):
    r = random.Random(seed)
    return " ".join(f"x{r.randrange(10**6)}" if r.random() < share else w for w in text.split(" "))
