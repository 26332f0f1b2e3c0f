"""Plain versions of what the operators return, for small tables."""

import re
from collections import Counter
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def shingle_set(text, width=5):
    w = words(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def components(texts, num=75, den=100):
    """Smallest id reachable by links, for a dict of id -> text."""
    sets = {k: shingle_set(t) for k, t in texts.items()}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = {}
    for k, s in sets.items():
        for x in s:
            inverted.setdefault(x, []).append(k)
    shared = Counter(p for ks in inverted.values() for p in combinations(sorted(ks), 2))
    for (a, b), n in shared.items():
        if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k)) for k in sets}


def quality_features(text):
    text = text or ""
    w = words(text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = set()
    for i in range(len(w) - 2):
        if windows[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), again, len(covered)


def repeats(texts, length=100):
    """Covered bytes of each (key, text), keys ascending: a list of flags per key."""
    first, out = set(), {}
    for k in sorted(texts):
        raw = (texts[k] or "").encode()
        flags = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            window = raw[i : i + length]
            if window in first:
                flags[i : i + length] = b"\1" * length
            else:
                first.add(window)
        out[k] = flags
    return out
