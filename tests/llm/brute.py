"""Plain versions of the text operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def substring(rows, n=13):
    first = {}
    words = [(k, WORD.findall((t or "").encode())) for k, t in rows]
    for k, w in words:
        for i in range(len(w) - n + 1):
            if k is not None:
                first[tuple(w[i : i + n])] = min(first.get(tuple(w[i : i + n]), k), k)
    out = []
    for k, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if k is not None and first[tuple(w[i : i + n])] < k:
                gone[i : i + n] = [True] * n
        out.append((k, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return Counter(out)


def suffix(rows, n=400):
    seen = Counter((t or "").encode()[i : i + n] for _, t in rows for i in range(len((t or "").encode()) - n + 1))
    out = []
    for k, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((k, len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return Counter(out)


def shingles(t):
    w = WORD.findall((t or "").encode())
    return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near(rows, threshold=0.8):
    """(id, class_id, n_copies, n_links) of rows with distinct ids."""
    sets = {k: shingles(t) for k, t in rows}
    text, parent = dict(rows), {k: k for k, _ in rows}
    shared, holders = Counter(), defaultdict(list)
    for k, s in sets.items():
        for g in s:
            holders[g].append(k)
    for ks in holders.values():
        for i, a in enumerate(ks):
            for b in ks[:i]:
                shared[b, a] += 1

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = defaultdict(set)
    for (a, b), n in shared.items():
        if n >= threshold * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            if text[a] != text[b]:
                links[a].add(text[b])
                links[b].add(text[a])
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    copies = Counter(t for k, t in rows if sets[k])
    return {k: (root(k), copies[t] if sets[k] else 1, len(links[k])) for k, t in rows}


def edits(item: bytes, text: bytes) -> int:
    """Fewest edits between item and any part of text."""
    prev = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        cur = [i]
        for j, x in enumerate(text, 1):
            cur.append(min(prev[j - 1] + (c != x), prev[j] + 1, cur[-1] + 1))
        prev = cur
    return min(prev)
