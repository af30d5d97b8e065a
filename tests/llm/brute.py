"""Plain versions of the operators, for small tables."""

import re
from collections import defaultdict

SPACE = re.compile("[\x20\x09-\x0d]+")


def words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in SPACE.split(text) if w]


def shingles(text, size):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1)))


def near_duplicates(rows, size, percent=80):
    """{(doc_id, n_shingles, component_id, kept)} of (doc_id, text) rows with distinct ids."""
    sets = {d: shingles(t, size) for d, t in rows}
    at = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            at[x].append(d)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            root[d] = root[root[d]]
            d = root[d]
        return d

    done = set()
    for group in at.values():
        for i, a in enumerate(group):
            for b in group[i + 1:]:
                if (a, b) in done:
                    continue
                done.add((a, b))
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {(d, len(s), find(d), find(d) == d) for d, s in sets.items()}


def repeats(rows, length, keep_first=False):
    """[(doc_id, n_bytes, n_removed, n_spans, kept)] by a table of all strings of ``length`` bytes."""
    bodies = [(d, (t or "").encode()) for d, t in rows]
    seen = defaultdict(list)
    for n, (_, b) in sorted(enumerate(bodies), key=lambda r: (r[1][0] is not None, r[1][0] or 0)):
        for s in range(len(b) - length + 1):
            seen[b[s:s + length]].append((n, s))
    gone = [bytearray(len(b)) for _, b in bodies]
    for places in seen.values():
        if len(places) > 1:
            for n, s in places[keep_first:]:
                gone[n][s:s + length] = b"\x01" * length
    out = []
    for (d, b), mask in zip(bodies, gone):
        spans = sum(m and (i == 0 or not mask[i - 1]) for i, m in enumerate(mask))
        out.append((d, len(b), sum(mask), spans, bytes(x for x, m in zip(b, mask) if not m)))
    return out
