"""Plain versions of the operators, written from their definitions."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def secrets_base(text):
    text = text or ""
    found = []
    for k, (pattern, flags, ok) in enumerate(
        [
            (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 8),
            (r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 16),
            (r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 32),
        ]
    ):
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text, flags) if ok(m)]
    kinds = ("assign", "access", "hex")
    return [f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(found)]


def quality(text, least, max_cover, max_repeat):
    text = text or ""
    w = words(text)
    n = len(w)
    lines = [x for x in text.split("\n") if words(x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    repeat = set()
    for i in range(n - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            repeat |= {i, i + 1, i + 2}
    most = [0] * n
    for i in range(n):
        for j in range(i):
            k = 0
            while i + k < n and w[i + k] == w[j + k]:
                k += 1
            most[i], most[j] = max(most[i], k), max(most[j], k)
    cover = set()
    for i, k in enumerate(most):
        if k >= least:
            cover |= set(range(i, i + k))
    longest = max([k for k in most if k >= least], default=0)
    failed = n < 50 or 100 * len(repeat) > 50 * n
    return {
        "n_words": n,
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(repeat),
        "base_failed": failed,
        "kept": not failed and 100 * len(cover) <= max_cover * n and longest <= max_repeat,
        "repeat_cover": len(cover),
        "longest_repeat": longest,
    }


def rlz(rows, width):
    """(n_words, kept words) of each (id, text), from windows alone."""
    first = {}
    for i, text in rows:
        w = words(text)
        for p in range(len(w) - width + 1):
            key = tuple(w[p : p + width])
            first[key] = min(first.get(key, 1 << 63), (1 << 63) - 1 if i is None else i)
    out = []
    for i, text in rows:
        w = words(text)
        gone = set()
        for p in range(len(w) - width + 1):
            if first[tuple(w[p : p + width])] < ((1 << 63) - 1 if i is None else i):
                gone |= set(range(p, p + width))
        out.append((i, len(w), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def substrings(rows, width):
    """(id, bytes, kept bytes, removed runs) of each (id, text)."""
    first, big = {}, (1 << 63) - 1
    for i, text in rows:
        b = (text or "").encode()
        for p in range(len(b) - width + 1):
            key = b[p : p + width]
            first[key] = min(first.get(key, big), big if i is None else i)
    out = []
    for i, text in rows:
        b = (text or "").encode()
        gone = [False] * (len(b) + 1)
        for p in range(len(b) - width + 1):
            if first[b[p : p + width]] < (big if i is None else i):
                gone[p : p + width] = [True] * width
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        out.append((i, len(b), bytes(x for x, g in zip(b, gone) if not g), spans))
    return out


def shingles(text, size=5):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def near(rows, percent=75):
    """(id, set size, component) of each (id, text), from all pairs."""
    big = (1 << 63) - 1
    sets = [shingles(t) for _, t in rows]
    label = [big if i is None else i for i, _ in rows]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for x, a in enumerate(sets):
        for y in range(x):
            b = sets[y]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                group[root(x)] = root(y)
    least = {}
    for x, i in enumerate(label):
        least[root(x)] = min(least.get(root(x), big), i)
    return [(i, len(s), None if least[root(x)] == big else least[root(x)]) for x, ((i, _), s) in enumerate(zip(rows, sets))]
