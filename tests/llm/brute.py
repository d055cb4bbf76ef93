"""Plain implementations to hold the operators against."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, width=5):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def components(ids, links):
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {i: top(i) for i in ids}


def near_duplicates(rows, percent):
    """[(id, set size, component)] of rows (id, text); rows of one id are linked by any of their texts."""
    sets = [shingles(t) for _, t in rows]
    own = {}
    for (i, _), s in zip(rows, sets):
        own.setdefault(s, set()).add(i)
    distinct = [s for s in own if s]
    links = [(min(own[s]), i) for s in distinct for i in own[s]]
    links += [(min(own[a]), min(own[b])) for k, a in enumerate(distinct) for b in distinct[:k] if 100 * len(a & b) >= percent * len(a | b)]
    root = components([i for i, _ in rows], links)
    return [(i, len(s), root[i]) for (i, _), s in zip(rows, sets)]


def edit_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        last, row = row, [i] + [0] * len(text)
        for j, b in enumerate(text, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (a != b))
    return min(row)
