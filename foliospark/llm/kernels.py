"""Word hashing over Arrow string columns with numpy, inside Spark tasks.

Words are maximal runs of bytes other than space and 0x09-0x0D. A word's hash is a polynomial in its
bytes modulo 2**64, finished with a mixing step, so equal words have equal hashes on every executor.
Work proceeds in slices of half a MB (or one document, if that is longer).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 512 << 10
_BLOCK = 4096


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_LETTER[_SPACE] = 0
_FOLDED = _LETTER.copy()
_FOLDED[65:91] = _LETTER[97:123]
_MARK = _SPACE.copy()
_MARK[[c for c in range(128) if not chr(c).isalnum()]] = True
_PLAIN = np.where(_MARK, U64(0), _FOLDED)
_ALPHA = np.zeros(256, dtype=bool)
_ALPHA[[*range(65, 91), *range(97, 123)]] = True
_CLOSING = np.zeros(256, dtype=bool)
_CLOSING[list(b".,;:!?)")] = True
_BASE = 0x9E3779B97F4A7C15
_POW = powers(_BASE, _BLOCK)


@dataclass
class Words:
    """The words of a slice of documents: rows lo..hi of the batch."""

    lo: int
    hi: int
    doc: np.ndarray  # row of each word, counted from lo
    start: np.ndarray  # byte offsets into the column's data
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # first word of each document; has hi - lo + 1 entries


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return off, np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes, at least one row each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def words(column: pa.Array, fold_case: bool = False, plain: bool = False, closed: bool = False) -> Iterator[Words]:
    """Words of each slice; ``plain`` folds case and also parts words at every ASCII character but letters and digits.

    With ``closed`` a new word begins where a closing mark follows an ASCII letter.
    """
    offsets, data = text_buffers(column)
    letters = _PLAIN if plain else _FOLDED if fold_case else _LETTER
    gap = _MARK if plain else _SPACE
    for lo, hi in slices(offsets):
        base = int(offsets[lo])
        part = data[base : int(offsets[hi])]
        cuts = offsets[lo : hi + 1] - base
        begins = ~gap[part]
        word = begins.copy()
        inner = cuts[:-1][cuts[:-1] < len(part)]
        after = np.ones(len(part), dtype=bool)
        after[1:] = gap[part[:-1]]
        after[inner] = True
        begins &= after
        if closed:
            begins[1:] |= _CLOSING[part[1:]] & _ALPHA[part[:-1]]
        start = np.flatnonzero(begins)
        first = np.searchsorted(start, cuts)
        if not len(start):
            yield Words(lo, hi, np.zeros(0, np.int64), start, start, np.zeros(0, U64), first)
            continue
        lengths = np.diff(np.append(start, len(part)))
        at = np.arange(start[0], len(part), dtype=np.int64) - np.repeat(start, lengths)
        values = letters[part[start[0] :]]
        if lengths.max() > _BLOCK:
            values *= _POW[at % _BLOCK] * powers(int(_POW[-1]) * _BASE % 2**64, int(at.max()) // _BLOCK + 1)[at // _BLOCK]
        else:
            values *= _POW[at]
        h = np.add.reduceat(values, start - start[0])
        n_chars = np.add.reduceat(word[start[0] :], start - start[0], dtype=U64)
        h = mix(h + n_chars * U64(0xD1B54A32D192ED03))
        doc = np.repeat(np.arange(hi - lo), np.diff(first))
        yield Words(lo, hi, doc, start + base, start + base + n_chars.astype(np.int64), h, first)


def kept_text(column: pa.Array, w: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each document of a slice, joined by one space."""
    offsets, data = text_buffers(column)
    base = int(offsets[w.lo])
    part = data[base : int(offsets[w.hi])].copy()
    cuts = offsets[w.lo : w.hi + 1] - base
    part[_SPACE[part]] = 32
    rows = np.flatnonzero(keep)
    # each kept word takes one space after it, except the last of its document
    last = np.ones(len(rows), dtype=bool)
    last[:-1] = w.doc[rows[1:]] != w.doc[rows[:-1]]
    edge = np.zeros(len(part) + 1, dtype=np.int8)
    edge[w.start[rows] - base] += 1
    edge[w.end[rows] - base + ~last] -= 1
    taken = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    total = np.zeros(len(part) + 1, dtype=np.int64)
    np.cumsum(taken, out=total[1:])
    out = np.ascontiguousarray(part[taken])
    return pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(total[cuts].tobytes()), pa.py_buffer(out.tobytes()))


def span_hash(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: int) -> np.ndarray:
    """Hash of h[lo:hi] for each pair of bounds, from prefix sums; not yet mixed."""
    n = len(h)
    total = np.zeros(n + 1, dtype=U64)
    np.cumsum(h * powers(base, n), out=total[1:])
    back = powers(pow(base, -1, 2**64), n + 1)
    return (total[hi] - total[lo]) * back[lo]


def rolling(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive values; entry i covers h[i : i + width]."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, dtype=U64)
    for j, c in enumerate(powers(base, width)):
        out += h[j : j + n] * c
    return mix(out)


def leftmost_min(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost minimum of every window of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    index, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        a, b = index[: len(index) - step], index[step:]
        index = np.where(values[a] <= values[b], a, b)
        span += step
    return index
