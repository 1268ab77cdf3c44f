"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict


def lower(t: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def sha(s: str | bytes) -> str:
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def contamination(docs, items, window=13):
    windows: dict[tuple, set] = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    out = {}
    for i, t in docs:
        w = words(t)
        hit, found = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if names := windows.get(tuple(w[k : k + n])):
                    found |= names
                    hit[k : k + n] = [True] * n
        h = sum(hit)
        out[i] = (len(w), h, len(found), sha(",".join(sorted(found))), h > 0 and 20 * h >= len(w))
    return out


def repeats(docs, length=400):
    count = Counter()
    for _, t in docs:
        b = (t or "").encode()
        count.update(b[s : s + length] for s in range(len(b) - length + 1))
    out = {}
    for i, t in docs:
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if count[b[s : s + length]] > 1:
                gone[s : s + length] = [True] * length
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), runs, sha(bytes(c for c, g in zip(b, gone) if not g)))
    return out


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def personal(t: str | None) -> list[str]:
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, t or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def shingles(t: str | None) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


def components(docs):
    """id: (number of shingles, component)."""
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        both = Counter(j for g in s for j in holders[g])
        for g in s:
            holders[g].append(i)
        for j, n in both.items():
            if 100 * n >= 90 * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def backoff(docs, seen=2, alpha=0.4, order=2):
    counts = Counter()
    for _, t in docs:
        w = words(t)
        counts.update(tuple(w[k : k + n]) for n in range(1, order + 1) for k in range(len(w) - n + 1))
    total = sum(len(words(t)) for _, t in docs)
    out = {}
    for i, t in docs:
        w, value = words(t), 0.0
        for k in range(len(w)):
            n, factor = min(order, k + 1), 1.0
            while n > 1 and counts[tuple(w[k - n + 1 : k + 1])] < seen:
                n, factor = n - 1, factor * alpha
            gram = tuple(w[k - n + 1 : k + 1])
            value += math.log10(factor * counts[gram] / (counts[gram[:-1]] if n > 1 else total))
        out[i] = (len(w), value)
    return out
