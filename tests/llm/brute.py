"""Plain Python versions of the operators' results, for small tables."""

import math
from collections import Counter, defaultdict

import numpy as np


def union(pairs, nodes):
    """node -> smallest node connected to it."""
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def similar(sets, threshold):
    """Pairs (a, b) with a < b of the non-empty sets by Jaccard similarity, over shared items."""
    holders = defaultdict(list)
    for n, s in sets.items():
        for item in s:
            holders[item].append(n)
    common = Counter((a, b) for ns in holders.values() for i, a in enumerate(ns) for b in ns[i + 1 :])
    return [
        (min(a, b), max(a, b)) for (a, b), c in common.items() if c / (len(sets[a]) + len(sets[b]) - c) >= threshold
    ]


def word_sets(texts, words=5):
    out = {}
    for n, text in texts.items():
        w = (text or "").encode().split()
        if w:
            out[n] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}
    return out


def documents(texts):
    """doc_id -> (class_id, n_links)."""
    pairs = similar(word_sets(texts), 0.8)
    links = Counter(n for pair in pairs for n in pair)
    return {n: (r, links[n]) for n, r in union(pairs, texts).items()}


def lines(texts, chars=8):
    """doc_id -> numbers of the lines that go; lines as the operator sees them."""
    places = {}
    for n, text in texts.items():
        for i, line in enumerate((text or "").split("\n")):
            if line := line.strip(" \t\n\x0b\x0c\r"):
                places[n, i] = line
    first = {}
    for place in sorted(places):
        first.setdefault(places[place], place)
    sets = {p: {line[i : i + chars] for i in range(max(1, len(line) - chars + 1))} for line, p in first.items()}
    root = union(similar(sets, 0.8), sets)
    gone = {n: [] for n in texts}
    for place, line in sorted(places.items()):
        if root[first[line]] != place:
            gone[place[0]].append(place[1])
    return gone


def text_statistics(text):
    """The classifier's statistics, counted byte by byte."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * 14
    letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    digit = lambda b: 48 <= b <= 57
    seen = [b for b in raw if not (9 <= b <= 13 or b == 32)]
    letters, digits = [b for b in seen if letter(b)], [b for b in seen if digit(b)]
    n, part = len(words), lambda a, b: math.sqrt(a / b) if b else 0.0
    lengths = [len(w) for w in words]
    mean = sum(lengths) / n
    tally, lines = Counter(words), [x for x in raw.split(b"\n") if x.strip()]
    bare = sum(not letter(w[0]) and not digit(w[0]) and len(w) < 4 for w in words)
    tails = sum(w[-1] < 128 and not letter(w[-1]) and not digit(w[-1]) and w[-1] not in b".,;:" for w in words)
    entropy = -sum(c / len(raw) * math.log2(c / len(raw)) for c in Counter(raw).values())
    return [
        part(sum(65 <= b <= 90 for b in raw), len(letters)),
        part(len(digits), len(seen)),
        part(len(seen) - len(letters) - len(digits), len(seen)),
        part(bare, n),
        part(tails, n),
        math.log(len(seen) / n),
        math.log(1 + math.sqrt(sum((x - mean) ** 2 for x in lengths) / n)),
        math.log(len(tally) / n) / math.log(n + 2),
        math.log((len({words[i : i + 2][0] + b" " + words[i + 1] for i in range(n - 1)}) + 1) / n) / math.log(n + 2),
        part(max(tally.values()) - 1, n + 5),
        part(len(lines) - len(set(lines)), len(lines) + 3),
        math.log(1 + math.log(1 + max(lengths))),
        entropy / 8,
        part(sum(w[-1] in b".,;:" for w in words), n),
    ]


def quality(texts, learned):
    """doc_id -> score, by the definition: shrunk covariances and whole normal densities. ``learned``: (doc_id, label)."""
    x = {i: np.array(text_statistics(t)) for i, t in texts.items()}
    classes = [np.array([x[i] for i, label in learned if label == k]) for k in (0, 1)]
    own = [np.cov(c.T, bias=True) for c in classes]
    total = sum(map(len, classes))
    both = sum(len(c) * s for c, s in zip(classes, own, strict=True)) / total
    shrunk = []
    for s in own:
        s = 0.7 * s + 0.3 * both
        shrunk.append(0.95 * s + 0.05 * np.diag(np.diag(both)) + 1e-6 * np.eye(14))
    out = {}
    for i, v in x.items():
        logs = []
        for c, s in zip(classes, shrunk, strict=True):
            gap = v - c.mean(0)
            logs.append(math.log(len(c) / total) - 0.5 * gap @ np.linalg.solve(s, gap) - 0.5 * np.linalg.slogdet(s)[1])
        out[i] = 1 / (1 + math.exp(max(-700, min(700, logs[0] - logs[1]))))
    return out
