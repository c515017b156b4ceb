"""Words, n-word windows and their 64-bit hashes, vectorised over UTF-8 buffers.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; words never
span two rows.  Hashes are multilinear over pseudo-random 64-bit values, so
equal sequences have equal hashes and two different ones agree with
probability of about 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WINDOW_STEP = 1 << 18  # windows hashed at once
_STEP, _WINDOW_BASE = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(U64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


with np.errstate(over="ignore"):
    _BYTE = mix(np.arange(1, 257, dtype=U64) * _STEP)


class _Powers:
    """Powers of an odd number modulo 2^64, grown on demand."""

    def __init__(self, base: U64):
        self.base, self.known = base, np.ones(1, dtype=U64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.known) < n:
            steps = np.full(max(n, 2 * len(self.known)), self.base, dtype=U64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                self.known = np.multiply.accumulate(steps)
        return self.known[:n]


_BYTE_POWERS = _Powers(U64(0xA0761D6478BD642F))
_POWERS = _Powers(_WINDOW_BASE)
_INVERSE = _Powers(U64(pow(int(_WINDOW_BASE), -1, 1 << 64)))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def row_ranges(offsets: np.ndarray, max_bytes: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``max_bytes`` (one row at least)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + max_bytes, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


@dataclass
class Words:
    """Words of some rows: byte span, row, hash; ``first`` has each row's first word (one more entry than rows)."""

    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: np.ndarray
    hashes: np.ndarray


def find_words(buf: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of the rows ``buf[offsets[i]:offsets[i + 1]]``."""
    rows = len(offsets) - 1
    inside = ~SPACE[buf]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    heads = offsets[:-1][(offsets[:-1] < offsets[1:])]
    opens[heads] = inside[heads]
    tails = offsets[1:][(offsets[:-1] < offsets[1:])] - 1
    closes[tails] = inside[tails]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    first = np.searchsorted(starts, offsets)
    return Words(starts, ends, np.repeat(np.arange(rows), np.diff(first)), first, span_hashes(buf, starts, ends))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans in ascending order without overlap (an empty span hashes to mix(0))."""
    lengths = ends - starts
    out = np.zeros(len(starts), dtype=U64)
    full = np.flatnonzero(lengths)
    if len(full):
        size = lengths[full]
        begin = np.cumsum(size) - size
        within = np.arange(int(size.sum())) - np.repeat(begin, size)
        at = within + np.repeat(starts[full], size)
        with np.errstate(over="ignore"):
            terms = _BYTE[buf[at]] * _BYTE_POWERS.upto(int(size.max()))[within]
            out[full] = np.add.reduceat(terms, begin)
    return mix(out)


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive entries; entry i covers i .. i + k - 1."""
    n = len(hashes) - k + 1
    out = np.zeros(max(n, 0), dtype=U64)
    for i in range(0, n, WINDOW_STEP):  # a window's hash does not depend on where its piece starts
        part = hashes[i : min(i + WINDOW_STEP, n) + k - 1]
        with np.errstate(over="ignore"):
            total = np.zeros(len(part) + 1, dtype=U64)
            np.cumsum(part * _POWERS.upto(len(part)), out=total[1:])
            out[i : i + WINDOW_STEP] = mix((total[k:] - total[:-k]) * _INVERSE.upto(len(part))[: len(part) - k + 1])
    return out


def window_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Mask over window positions: True where the window stays inside its row."""
    n = int(first[-1])
    if n < k:
        return np.zeros(0, dtype=bool)
    last = np.repeat(first[1:], np.diff(first))
    return np.arange(n - k + 1) + k <= last[: n - k + 1]


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` per row, rows given by their first entries; a row's sum depends on that row only."""
    out = np.zeros(len(first) - 1, dtype=np.int64 if values.dtype.kind == "b" else values.dtype)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, first[:-1][full], dtype=out.dtype)
    return out
