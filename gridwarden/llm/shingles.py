"""Word shingles as 64-bit numbers, computed over whole batches of texts at once.

A word's number is a polynomial of random values of its bytes modulo 2^64, taken from one running sum over the batch, so
equal words have equal numbers wherever they stand. A shingle's number combines those of its words in order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_U = np.uint64
_P, _Q = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93
_P_INVERSE = pow(_P, -1, 1 << 64)
#: Characters of text worked on at once (a longer text is a batch of its own).
BATCH_CHARS = 400_000


def _byte_values() -> np.ndarray:
    values = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
    values[65:91] = values[97:123]  # A-Z as a-z
    values[[9, 10, 11, 12, 13, 32]] = 0
    return values


_BYTE = _byte_values()
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^0..P^(n-1) and their inverses modulo 2^64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, _P_INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def batches(texts: Sequence[str | None]) -> Iterator[list[str]]:
    """Consecutive texts, null as empty, in lists of bounded size."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t or "") > BATCH_CHARS:
            yield held
            held, size = [], 0
        held.append(t or "")
        size += len(t or "")
    if held:
        yield held


def word_numbers(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words of all texts in order, and where each text's words begin (with the end)."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([*parts, b""]) or b" ", np.uint8)
    ends_of_texts = np.cumsum([len(p) + 1 for p in parts])
    values = _BYTE[data]
    inside = values != 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    power, inverse = _powers_to(len(data) + 1)
    sums = np.concatenate([[_U(0)], np.cumsum(values * power[: len(data)], dtype=np.uint64)])
    words = mix((sums[ends] - sums[starts]) * inverse[starts])
    return words, np.concatenate([[0], np.searchsorted(starts, ends_of_texts)])


def shingle_numbers(words: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Per text its shingles in order, repeats included; a text with fewer words has its whole sequence as one."""
    n = len(words)
    q = [pow(_Q, k, 1 << 64) for k in range(size)]
    long = mix(sum((words[k : n - size + 1 + k] * _U(q[k]) for k in range(size)), start=np.zeros(max(0, n - size + 1), np.uint64))) if n >= size else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(long[a : b - size + 1])
        elif b > a:
            few = words[a:b] * np.array(q[: b - a], np.uint64)
            out.append(mix(np.array([(int(few.sum(dtype=np.uint64)) + (b - a)) & (1 << 64) - 1], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def hash_family(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and addends of n 32-bit hash functions."""
    random = np.random.default_rng(seed)
    return random.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), random.integers(0, 1 << 32, n, dtype=np.uint32)
