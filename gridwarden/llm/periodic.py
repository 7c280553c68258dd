"""Periodic runs of words by an enhanced suffix array and the branching-tandem test.

A run is a maximal stretch of words with smallest period q and at least two periods. Its last square (two equal
halves of q words) is branching: the word behind it differs from the word one half before. So the suffixes at its two
halves agree in exactly q words: they lie in different children of the LCP interval of depth q.

1. Many texts are one sequence of word numbers, a separator of its own behind each. Only suffixes whose first ``D``
   words occur again in their text can be in an interval deep enough (see ``depth_of``); the others are left out.
2. Those are sorted by prefix doubling; the ranks of all levels give the LCP of neighbours.
3. Intervals come from one pass over the LCP array with a stack of split places; no tree is built. For every
   suffix i of all children but the largest, ISA[i + depth] and ISA[i - depth] tell whether the other half is in the
   interval, and one comparison of words whether the square is branching.
4. From each such square the stretch is rotated to the left as far as the period holds. Squares of multiples
   of a period end at the same word and are skipped or merged: the smallest period of a stretch stays.

A text is worked on by one task in memory proportional to its length, in O(n log n).

Defined results: a null text has no words; a null id is kept as it is; rows that repeat an id are
rows of their own; an empty table gives no rows; columns not asked for are never read, and a kept column with the name of a
made one is refused.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Sequence
from hashlib import sha256
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridwarden.llm.common import per_row, schema_of
from gridwarden.llm.shingles import mix

#: Words put into one suffix array, unless a single text has more.
BATCH_WORDS = 60_000
_RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


def depth_of(least: int) -> int:
    """Least depth D of the intervals needed for runs of ``least`` words and more.

    A period q < D has a multiple between D and least / 2, so a run of that length has a square of that half too;
    this holds if the stretch from D to least / 2 has D - 1 numbers.
    """
    return max(1, (least // 2 + 2) // 2)


def _repeated(w: np.ndarray, text: np.ndarray, room: np.ndarray, d: int) -> np.ndarray:
    """Places whose d words may occur again in the same text (all that do, by a 64-bit number)."""
    n = len(w) - d + 1
    if n <= 1:
        return np.zeros(0, np.int64)
    number = text[:n].astype(np.uint64)
    for k in range(d):
        number = mix(number * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n].astype(np.uint64))
    inside = np.flatnonzero(room[:n] >= d)
    number = number[inside]
    ordered = np.sort(number)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(again):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(again, number), len(again) - 1)
    return inside[again[at] == number]


def _boundaries(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], keys[1:] != keys[:-1]])


def suffix_array(w: np.ndarray, text: np.ndarray, places: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes at ``places`` in order and the LCP with their predecessor (0 where the first d words or the text differ)."""
    n = len(w)
    # what follows a repeated stretch is ordered too, by its first words, so that suffixes with a common start stay together
    places = np.union1d(places, np.minimum(places + d, n - 1))
    m, last = len(places), n - 1
    columns = [w[np.minimum(places + k, last)] for k in reversed(range(d))] + [text[places]]
    sa = places[np.lexsort(columns)]
    new = np.zeros(m, bool)
    new[0] = True
    for k in range(d):
        new[1:] |= w[np.minimum(sa[1:] + k, last)] != w[np.minimum(sa[:-1] + k, last)]
    new[1:] |= text[sa[1:]] != text[sa[:-1]]
    first = new.copy()
    # the rank of a suffix is the place of its group's first member; suffixes that are left out have ranks of their own
    rank = np.arange(n + 1, dtype=np.int64) + m
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(m), 0))
    levels, length = [(d, rank.copy())], d
    while True:
        alone = new & np.concatenate([new[1:], [True]])
        slots = np.flatnonzero(~alone)
        if not len(slots):
            break
        active = sa[slots]
        keys = (rank[active] << np.int64(32)) | rank[active + length]
        order = np.argsort(keys, kind="stable")
        active, keys = active[order], keys[order]
        sa[slots] = active
        split = _boundaries(keys)
        new[slots] |= split
        rank[active] = np.maximum.accumulate(np.where(split, slots, 0))
        length *= 2
        levels.append((length, rank.copy()))
    lcp = np.zeros(m, np.int64)
    inner = np.flatnonzero(~first)
    a, b = sa[inner - 1], sa[inner]
    same = np.zeros(len(inner), np.int64)
    for size, ranks in reversed(levels):
        same += size * (ranks[a + same] == ranks[b + same])
    for _ in range(d - 1):
        same += w[a + same] == w[b + same]
    lcp[inner] = same
    return sa, lcp


def branching_squares(w: np.ndarray, sa: np.ndarray, lcp: np.ndarray, d: int) -> dict[int, set[int]]:
    """End of each branching square (the place behind it) -> halves of the squares that end there."""
    m, n = len(sa), len(w)
    isa = np.full(n + 1, -1, np.int64)
    isa[sa] = np.arange(m)
    found: dict[int, set[int]] = defaultdict(set)

    def test(low: int, high: int, depth: int, splits: list[int]) -> None:
        edges = [low, *splits, high + 1]
        sizes = [b - a for a, b in zip(edges, edges[1:], strict=False)]
        largest = sizes.index(max(sizes))
        few = np.concatenate([sa[a:b] for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if k != largest])
        ahead = isa[few + depth]
        for i in few[(low <= ahead) & (ahead <= high)].tolist():
            if w[i + depth] != w[i + 2 * depth]:
                found[i + 2 * depth].add(depth)
        behind = isa[np.maximum(few - depth, 0)]
        for i in few[(few >= depth) & (low <= behind) & (behind <= high)].tolist():
            if w[i] != w[i + depth]:
                found[i + depth].add(depth)

    def test_few(low: int, high: int, depth: int, splits: list[int]) -> None:
        """The same for an interval of a few suffixes, without arrays."""
        edges = [low, *splits, high + 1]
        largest = max(range(len(edges) - 1), key=lambda k: edges[k + 1] - edges[k])
        for k in range(len(edges) - 1):
            if k == largest:
                continue
            for at in range(edges[k], edges[k + 1]):
                i = suffix[at]
                if low <= inverse.get(i + depth, -1) <= high and word(i + depth) != word(i + 2 * depth):
                    found[i + 2 * depth].add(depth)
                if i >= depth and low <= inverse.get(i - depth, -1) <= high and word(i) != word(i + depth):
                    found[i + depth].add(depth)

    suffix, word = sa.tolist(), w.item
    inverse = dict(zip(suffix, range(m), strict=True))
    stack: list[tuple[int, int, list[int]]] = []
    for at, value in enumerate([*lcp.tolist(), 0]):
        low = at - 1
        while stack and stack[-1][0] > value:
            depth, low, splits = stack.pop()
            (test_few if len(splits) <= 40 and at - low <= 80 else test)(low, at - 1, depth, splits)
        if value >= d:
            if stack and stack[-1][0] == value:
                stack[-1][2].append(at)
            else:
                # what was popped is the first child; its suffixes and the new one are split here
                stack.append((value, low, [at]))
    return found


def _extended(w: np.ndarray, start: int, period: int) -> int:
    """First place of the stretch with this period that reaches left from ``start``."""
    step = 64
    while start > 0:
        step = min(step, start)
        differs = np.flatnonzero(w[start - step : start] != w[start - step + period : start + period])
        if len(differs):
            return start - step + int(differs[-1]) + 1
        start -= step
        step *= 4
    return 0


def runs_of(w: np.ndarray, text: np.ndarray, room: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``least`` words, by start and period.

    ``w`` numbers the words, with a number of its own behind each text; ``text`` numbers the texts and ``room``
    counts the words from a place to the end of its text.
    """
    d = depth_of(least)
    places = _repeated(w, text, room, d)
    if not len(places):
        return []
    sa, lcp = suffix_array(w, text, places, d)
    smallest: dict[tuple[int, int], int] = {}
    for end, halves in branching_squares(w, sa, lcp, d).items():
        done: list[tuple[int, int]] = []
        for half in sorted(halves):
            if any(half % p == 0 and end - s >= 2 * half for s, p in done):
                continue
            start, q = _extended(w, end - 2 * half, half), half
            if end - start >= max(least, 2 * half):
                q = next((q for q in range(1, d) if np.array_equal(w[start : end - q], w[start + q : end])), half)
                smallest[start, end] = min(q, smallest.get((start, end), q))
            done.append((start, q))
    return sorted((s, e - s, q) for (s, e), q in smallest.items())


def collapsed(words: Sequence[bytes], runs: Sequence[tuple[int, int, int]]) -> list[bytes]:
    """Words that are in the first period of every run that holds them."""
    if not runs:
        return list(words)
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def runs_of_texts(texts: Sequence[Sequence[bytes]], least: int = 12) -> list[list[tuple[int, int, int]]]:
    """Runs of each text, given as words, with places counted from the text's first word."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    held: list[int] = []
    size = 0

    def flush() -> None:
        numbers: dict[bytes, int] = defaultdict(count(len(held)).__next__)
        flat: list[int] = []
        for k, t in enumerate(held):
            flat.extend(map(numbers.__getitem__, texts[t]))
            flat.append(k)
        lengths = np.array([len(texts[t]) + 1 for t in held])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        text = np.repeat(np.arange(len(held)), lengths)
        room = np.repeat(starts + lengths - 1, lengths) - np.arange(len(flat))
        for start, length, period in runs_of(np.array(flat, np.int64), text, room, least):
            k = int(text[start])
            out[held[k]].append((start - int(starts[k]), length, period))

    for t, words in enumerate(texts):
        if len(words) < least:
            continue
        if held and size + len(words) > BATCH_WORDS:
            flush()
            held, size = [], 0
        held.append(t)
        size += len(words)
    if held:
        flush()
    return out


def find_runs(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    least: int = 12,
    keep: Sequence[str] | None = None,
    rewrite: Callable[[list[bytes], int | None], list[bytes]] | None = None,
    with_runs: bool = False,
    with_text: bool = False,
) -> DataFrame:
    """The kept columns (the id by default), n_runs, start, length, period, exponent_milli of the longest run, runs_sha256, collapsed_sha256.

    ``with_runs`` adds ``runs`` and ``with_text`` adds ``collapsed``, the text without repeats. ``rewrite`` changes
    the words of a text first.
    """
    fields = list(schema_of("n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string").fields)
    fields += [T.StructField("runs", _RUNS)] * with_runs + [T.StructField("collapsed", T.StringType())] * with_text
    keep = [doc_id] if keep is None else list(keep)
    if clash := {f.name for f in fields} & set(keep):
        raise ValueError(f"kept columns have names of made ones: {sorted(clash)}")

    def setup():
        def fn(ids, texts):
            words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
            if rewrite:
                words = [rewrite(w, i) for w, i in zip(words, ids, strict=True)]
            rows = []
            for own, runs in zip(words, runs_of_texts(words, least), strict=True):
                start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
                rest = b" ".join(collapsed(own, runs))
                listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()
                row = [len(runs), start, length, period, None if start is None else 1000 * length // period, sha256(listed).hexdigest(), sha256(rest).hexdigest()]
                row += [[{"start": s, "length": n, "period": p} for s, n, p in runs]] * with_runs + [rest.decode("utf-8", "replace")] * with_text
                rows.append(row)
            return list(zip(*rows, strict=True)) or [[]] * len(fields)

        return fn

    return per_row(df, setup, T.StructType(fields), [doc_id, text], keep)
