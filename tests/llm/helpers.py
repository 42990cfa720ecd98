"""Texts and plain answers that several tests use."""

from __future__ import annotations

from itertools import combinations

VOCAB = [a + b for a in ("ba", "do", "ri", "tu", "ka", "me", "so") for b in ("n", "st", "l", "rix", "m")]


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) + rng.choice(VOCAB) for _ in range(n))


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(VOCAB) + "q"
    return " ".join(words)


def roots(nodes, links):
    """The smallest node that links reach from each."""
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingle_set(text, size):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def plain_components(docs, size, percent):
    sets = {i: shingle_set(t, size) for i, t in docs}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), r) for i, r in roots(list(sets), links).items()}
