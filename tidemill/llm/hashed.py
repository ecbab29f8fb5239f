"""Terms of many texts at once as 64-bit hashes, in numpy: no text becomes a Python string."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tidemill.llm.common import blocks, text_bytes
from tidemill.llm.shingles import BYTE, LOWER, mix, powers

#: Bytes of text cut at once. A longer text is cut between terms, so that memory follows its terms only.
PIECE = 1 << 20


def letters(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of the bytes that terms are made of."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a:b] = True
    return out


#: Bytes from 0x80 on are parts of letters; all others outside these ranges end a term.
ALNUM = letters((48, 58), (65, 91), (97, 123), (128, 256))
ALPHA = letters((65, 91), (97, 123), (128, 256))


def _spans(data: np.ndarray, ends: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where terms begin and end; no term goes over the end of a row."""
    inside = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[ends] = True
    at = np.flatnonzero(edge)
    own = inside[at[:-1]]
    return at[:-1][own], at[1:][own]


def _cut(data: np.ndarray, ends: np.ndarray, table: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (A-Z as a-z) and rows of terms; with start, also of the first bytes of longer terms, told apart from whole ones."""
    begin, end = _spans(data, ends, table)
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[LOWER[data]] * up[: len(data)], out=sums[1:])
    row = np.searchsorted(ends, begin, "right") - 1
    h = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    if start:
        long = np.flatnonzero(end - begin > start)
        more = mix((sums[begin[long] + start] - sums[begin[long]]) * down[begin[long]] + np.uint64(1 << 32))
        h, row = np.concatenate([h, more]), np.concatenate([row, row[long]])
    return h.view(np.int64), row


def cut(data: np.ndarray, ends: np.ndarray, table: np.ndarray = ALNUM, start: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Of each term of some rows its hash and row."""
    if len(data) <= 2 * PIECE:
        return _cut(data, ends, table, start)
    hashes, rows = [], []
    for i in range(len(ends) - 1):
        at, stop = int(ends[i]), int(ends[i + 1])
        while at < stop:
            end = min(at + PIECE, stop)
            while end < stop and table[data[end]]:
                gaps = np.flatnonzero(~table[data[end : end + PIECE]])[:1]
                end = end + int(gaps[0]) if len(gaps) else min(end + PIECE, stop)
            h, _ = _cut(data[at:end], np.array([0, end - at]), table, start)
            hashes.append(h)
            rows.append(np.full(len(h), i))
            at = end
    return np.concatenate(hashes), np.concatenate(rows)


def terms(column: pa.Array, table: np.ndarray = ALNUM, start: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of a text column's rows, the hash of each term in them, and its row counted from the range's start."""
    data, ends = text_bytes(column)
    for a, b in blocks(ends):
        yield a, b, *cut(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a], table, start)


def lists(sizes: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


class Vocabulary:
    """Sorted hashes of some terms, behind a table of bits that turns most other terms away. Sent to executors as it is: 8 bytes a term and the bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.shift = np.uint64(64 - min(26, max(12, int(16 * len(self.hashes)).bit_length())))
        self.bits = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bits[self.hashes.view(np.uint64) >> self.shift] = True

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are terms, and their places."""
        some = np.flatnonzero(self.bits[h.view(np.uint64) >> self.shift])
        if not len(self.hashes):
            return some, some
        at = np.minimum(np.searchsorted(self.hashes, h[some]), len(self.hashes) - 1)
        same = self.hashes[at] == h[some]
        return some[same], at[same]

    def bags(self, h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known terms of some rows in their order: how many each row has, their places, and how often each stands there."""
        some, at = self.find(h)
        key, tf = np.unique(row[some] * len(self.hashes) + at, return_counts=True)
        of, at = np.divmod(key, max(1, len(self.hashes)))
        return np.bincount(of, minlength=rows), at, tf
