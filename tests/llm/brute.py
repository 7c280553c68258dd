"""Plain single-machine versions of the operators, for comparison on small fixtures."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

_LOWER = {c: chr(c + 32) for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))


def shingles(text, size):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def components(rows, size=2, percent=80):
    """doc_id -> (shingles, smallest id of the component), by an inverted index over all shingles."""
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    index = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in index[x])
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
        for x in s:
            index[x].append(i)
    smallest = {}
    for i, (d, _) in enumerate(rows):
        smallest[find(i)] = min(d, smallest.get(find(i), d))
    return {d: (len(sets[i]), smallest[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)}


def leaks(docs, items, size=5, percent=80):
    of_docs = [(d, shingles(t, size)) for d, t in docs]
    out = set()
    for item, t in items:
        own = shingles(t, size)
        for d, s in of_docs:
            n = len(own & s)
            if own and 100 * n >= percent * len(own):
                out.add((d, item, n, len(own)))
    return out


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def personal(text):
    text, out = text or "", []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def hard_negatives(rows, anchor, positives=5, negatives=3, low=50, high=95):
    """rows: (id, whole vector, label) -> the mined rows, by sorting all rows for each anchor."""
    out = []
    for a, va, la in rows:
        if not anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, vb)), b, lb == la) for b, vb, lb in rows if b != a)
        for p_score, p in [(-s, b) for s, b, same in scored if same][:positives]:
            fits = [(b, -s) for s, b, same in scored if not same and low * p_score <= -100 * s <= high * p_score]
            out += [(a, p, k + 1, b, p_score, s) for k, (b, s) in enumerate(fits[:negatives])]
    return sorted(out)


def runs(w, least=12):
    """(start, length, smallest period) of all maximal periodic stretches, period by period."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                out.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, n, q) for (s, n), q in out.items())
