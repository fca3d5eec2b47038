"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import defaultdict

ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def near(rows, width, percent):
    """doc_id -> (n_shingles, component_id) for unique, non-null ids."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII_LOWER))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    common = defaultdict(int)
    for ids in where.values():
        for a in range(len(ids)):
            for b in range(a):
                common[ids[b], ids[a]] += 1
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def leaks(rows, items, width=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII_LOWER))

    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        k = min(width, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[a : a + k])].add(str(i))
    widths = {len(x) for x in windows}
    out = {}
    for i, t in rows:
        w = words(t)
        hit, found = set(), set()
        for k in widths:
            for a in range(len(w) - k + 1):
                if got := windows.get(tuple(w[a : a + k])):
                    found |= got
                    hit |= set(range(a, a + k))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out


def repeats(rows, width=20):
    first, texts = {}, {}
    for i, t in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        texts[i] = w
        for a in range(len(w) - width + 1):
            first.setdefault(tuple(w[a : a + width]), (i, a))
    out = {}
    for i, w in texts.items():
        gone = set()
        for a in range(len(w) - width + 1):
            if first[tuple(w[a : a + width])] != (i, a):
                gone |= set(range(a, a + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out
