"""Word shingles of many texts at once, as 64-bit hashes in numpy."""

from __future__ import annotations

import numpy as np

#: An odd multiplier, its inverse modulo 2^64, and one random number a byte value.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BYTE = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 64, 256, dtype=np.uint64)
#: A-Z to a-z; the separators of words.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BREAK = np.zeros(256, bool)
BREAK[[32, *range(9, 14)]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    while len(_powers[0]) < n:
        k = len(_powers[0])
        for i, base in enumerate((BASE, INVERSE)):
            _powers[i] = np.concatenate([_powers[i], _powers[i] * np.uint64(pow(base, k, 1 << 64))])
    return [p[:n] for p in _powers]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of rows end to end, and their offsets -> a hash of each word in order, and its row."""
    n = len(data)
    gap = BREAK[data]
    first = ~gap
    inner = ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < n)]
    first[1:] &= gap[:-1]
    starts_of_rows = np.zeros(n, bool)
    starts_of_rows[inner] = True
    first |= starts_of_rows & ~gap
    last = ~gap
    last[:-1] &= gap[1:] | starts_of_rows[1:]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[LOWER[data]] * up[:n], out=sums[1:])
    row = np.searchsorted(ends, begin, "right") - 1
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64)), row


def shingles(data: np.ndarray, ends: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """The sorted different shingle hashes of each row; a row of fewer words has one for its whole sequence, without words none."""
    rows = len(ends) - 1
    h, row = words(data, ends)
    count = np.bincount(row, minlength=rows) if len(row) else np.zeros(rows, np.int64)
    at = np.concatenate([[0], np.cumsum(count)])
    many = max(0, len(h) - width + 1)
    joined = np.zeros(many, np.uint64)
    for i in range(width):
        joined += h[i : i + many] * np.uint64(pow(BASE, i + 1, 1 << 64))
    joined = mix(joined)
    out = []
    for i in range(rows):
        a, b = at[i], at[i + 1]
        if b - a >= width:
            out.append(np.unique(joined[a : b - width + 1]))
        elif b > a:
            short = int(b - a)
            for k, x in enumerate(h[a:b].tolist()):
                short += x * (pow(BASE, k + 1, 1 << 64) ^ 0x5DEECE66D)
            out.append(mix(np.array([short % (1 << 64)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
