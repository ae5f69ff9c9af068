"""Words and shingles of many texts as 64-bit numbers, by array operations over their bytes.

A word's number is a polynomial hash of its bytes (prefix sums make all words cost one pass), finished by a mixer.
Equal words have equal numbers; different ones collide with chance 2^-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: White space of the contract: 9 to 13 and 32.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)  # fixed for good: numbers are compared across runs
_powers: dict[int, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def chunks(texts: list, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `limit` characters: bounds the arrays, whole texts only."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def words(texts: list, lower: bool = True, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number, text index, first byte and end byte of every word of the texts joined by line feeds, and the bytes.
    between: which bytes are no part of words; a line feed must be one."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    joined = b"\n".join(raw) + b"\n"
    data = np.frombuffer(joined.translate(_LOWER) if lower else joined, np.uint8)
    space = between[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    first, end = edge[0::2], edge[1::2]  # the last byte is a space, so every word ends
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=sums[1:])
    number = mix64((sums[end] - sums[first]) * _power(_INVERSE, len(data))[first] + (end - first).astype(np.uint64))
    offsets = np.cumsum([len(r) + 1 for r in raw])
    owner = np.searchsorted(offsets, first, side="right")
    return number, owner, first, end, data


def shingle_sets(texts: list, k: int, limit: int = 1 << 19) -> Iterator[np.ndarray]:
    """For each text the sorted distinct numbers of its k-word shingles (of the whole, if it has fewer words)."""
    for a, b in chunks(texts, limit):
        number, owner, *_ = words(texts[a:b])
        bounds = np.searchsorted(owner, np.arange(b - a + 1))
        rolled = number.copy()
        factor = np.uint64(_BASE)
        for j in range(1, k):
            rolled[: max(0, len(rolled) - j)] = rolled[: max(0, len(rolled) - j)] * factor + number[j:]
        rolled = mix64(rolled)
        for i in range(b - a):
            lo, hi = bounds[i], bounds[i + 1]
            if hi - lo >= k:
                yield np.unique(rolled[lo : hi - k + 1])
            elif hi > lo:
                whole = 0
                for x in number[lo:hi]:
                    whole = (whole * _BASE + int(x)) % (1 << 64)
                yield mix64(np.array([whole ^ int(hi - lo)], np.uint64))
            else:
                yield np.empty(0, np.uint64)


#: All ASCII but letters: words of letters only, whatever stands around them.
NOT_LETTERS = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])


def gram_positions(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions of all words in a row, and where each word begins among them."""
    n = end - first
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n - first, n), ends - n


def bucket(values: np.ndarray, salt: int, bits: int) -> np.ndarray:
    """Values dealt to 2**bits buckets."""
    return (mix64(values.astype(np.uint64) + np.uint64(salt * 0x1000000000)) >> np.uint64(64 - bits)).astype(np.int64)
