"""Plain single-machine versions of the contracts, over lists of rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def low(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def url(u: str | None):
    if u is None or "://" not in u:
        return "", "", None
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = low(host)
    fits = [(h + p) for h, p, _ in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=len, default=None)


def near(docs: list[tuple[int, str | None]], percent: int = 75):
    sets = {}
    for i, t in docs:
        w = words(low(t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    shared = Counter()
    for h in holders.values():
        for a in range(len(h)):
            for b in range(a + 1, len(h)):
                shared[h[a], h[b]] += 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def substrings(docs, size: int = 35):
    seen = Counter()
    split = [(i, words(t)) for i, t in docs]
    for _, w in split:
        seen.update(tuple(w[j : j + size]) for j in range(len(w) - size + 1))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for j in range(len(w) - size + 1):
            if seen[tuple(w[j : j + size])] > 1:
                gone[j : j + size] = [True] * size
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


def repeated_lines(docs, size: int = 3, long: int = 8):
    split = [(i, [] if t is None else t.split("\n")) for i, t in docs]
    first = {}
    for i, lines in sorted(split, key=lambda x: x[0]):
        for j in range(len(lines) - size + 1):
            first.setdefault(tuple(lines[j : j + size]), (i, j))
    alone = {}
    for i, lines in sorted(split, key=lambda x: x[0]):
        for j, line in enumerate(lines):
            if len(words(line)) >= long:
                alone.setdefault(line, (i, j))
    out = {}
    for i, lines in split:
        gone = [alone.get(x, (i, j)) != (i, j) for j, x in enumerate(lines)]
        for j in range(len(lines) - size + 1):
            if first[tuple(lines[j : j + size])] != (i, j):
                gone[j : j + size] = [True] * size
        out[i] = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
    return out


def contaminated(docs, items, size: int = 13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))
    known = defaultdict(set)
    for k, t in items:
        w = split(t)
        for j in range(max(1, len(w) - size + 1)) if w else ():
            known[tuple(w[j : j + size])].add(str(k))
    sizes = {len(k) for k in known}
    out = []
    for i, t in docs:
        w = split(t)
        hit, found = set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if (x := tuple(w[j : j + n])) in known:
                    hit.update(range(j, j + n))
                    found |= known[x]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def unigram(docs, fold: int = 7, out: int = 2):
    tokens = {i: [*words(low(t or "")), "\n"] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % fold == out for i in tokens}
    counts = Counter(x for i, w in tokens.items() if not held[i] for x in w)
    n, v = sum(counts.values()), len(counts)
    return {i: (held[i], len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)) for i, w in tokens.items()}


def top(vectors, k: int = 20, every: int = 20):
    clean = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in clean:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in clean if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def sequences(lengths, capacity: int, band: float = 0.5) -> int:
    """Sequences that rounds of successor matching fill, one document and one gap at a time, on a stack."""
    left, gaps, opened = Counter(lengths), Counter(), 0
    while left:
        longest, widest = max(left), max(gaps, default=0)
        if longest > widest:
            over = [k for k, n in left.items() if k > widest for _ in range(n)]
            new = max(sum(2 * k > capacity for k in over), -(-sum(over) // capacity))
            gaps[capacity] += new
            opened += new
        waiting: list[int] = []
        met: list[tuple[int, int]] = []
        for size in range(1, capacity + 1):
            waiting += [size] * (left[size] if size >= band * longest else 0)
            for _ in range(gaps[size]):
                if not waiting:
                    break
                met.append((size, waiting.pop()))
        left.subtract(k for _, k in met)
        for gap, k in sorted(met):
            more = min(gap // k - 1, left[k])
            left[k] -= more
            gaps[gap] -= 1
            gaps[gap - k * (1 + more)] += 1
        left, gaps = +left, +gaps
        gaps.pop(0, None)
    return opened
