"""The operators' contracts in plain Python, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = r"[^\x20\x09-\x0D]+"
FIRST = -(1 << 63)


def low(t):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), t)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def base_counts(text):
    t = text or ""
    w = re.findall(WORD, t)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def line_dedup(rows, min_chars=20, min_docs=3, keep=max):
    """[(id, lines before, dropped, text)]."""
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    docs = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            docs[key(x)].add(FIRST if i is None else i)
    out = []
    for i, t in rows:
        me = FIRST if i is None else i
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < min_chars or len(docs[key(x)]) < min_docs or keep(docs[key(x)]) == me]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def substrings(rows, size):
    """[(id, bytes, removed, spans, kept)]."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + size] for _, b in texts for p in range(len(b) - size + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if seen[b[p : p + size]] > 1:
                gone[p : p + size] = b"\1" * size
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return out


def near(rows, size, num, den=100):
    """[(id, shingles, component)]."""
    sets = []
    for i, t in rows:
        w = re.findall(WORD, low(t or ""))
        sets.append((FIRST if i is None else i, frozenset(tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))) if w else frozenset()))
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            where[x].append(k)
    both = Counter((a, b) for ks in where.values() for n, b in enumerate(ks) for a in ks[:n])
    for (a, b), n in both.items():
        if den * n >= num * (len(sets[a][1]) + len(sets[b][1]) - n):
            x, y = root(sets[a][0]), root(sets[b][0])
            parent[max(x, y)] = min(x, y)
    null = lambda x: None if x == FIRST else x
    return [(null(i), len(s), null(root(i))) for i, s in sets]


def contamination(rows, items, size=10):
    """[(id, words, hit words, sorted item ids)]."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        if w:
            n = min(size, len(w))
            for j in range(len(w) - n + 1):
                windows[tuple(w[j : j + n])] |= set() if i is None else {str(i)}
    out = []
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit.update(range(j, j + n))
                    found |= windows[tuple(w[j : j + n])]
        out.append((i, len(w), len(hit), sorted(found)))
    return out


def proximity(rows, items, size, reach):
    """[(id, words, numbers of the hit words, sorted item ids)]."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))
    out = []
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for name, text in items:
            v = split(text)
            for terms in {frozenset(v[j : j + size]) for j in range(max(1, len(v) - size + 1))} if v else ():
                for a in range(max(1, len(w) - reach)):
                    if terms <= set(w[a : a + reach + 1]):
                        hit.update(k for k in range(a, min(a + reach + 1, len(w))) if w[k] in terms)
                        found.add(str(name))
        out.append((i, len(w), sorted(hit), sorted(found)))
    return out
