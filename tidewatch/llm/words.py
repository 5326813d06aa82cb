"""Words of Arrow text columns as 64-bit hashes, worked out on whole batches with numpy.

A word is a run of bytes other than blank and the five controls 0x09-0x0D, with A-Z lower-cased.
Texts are handled in blocks of about ``BLOCK_BYTES`` cut between words, so that the working
arrays stay small however long a text is; what is kept is 8 bytes a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)


_BYTES = np.arange(256)
_SPACE = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
_VALUES = constants(256, 1)
_VALUES[65:91] = _VALUES[97:123]
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_MULTIPLIER, _INVERSE)):
            steps = np.full(max(n, BLOCK_BYTES + 4096), base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the n + 1 offsets of its rows; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    lo, end = 0, len(data)
    while lo < end:
        hi = min(lo + BLOCK_BYTES, end)
        while hi < end:
            rows = offsets[np.searchsorted(offsets, lo, "right") : np.searchsorted(offsets, hi, "right")]
            gaps = np.flatnonzero(_SPACE[data[lo:hi]])
            cut = max(int(rows[-1]) if len(rows) else lo, lo + int(gaps[-1]) + 1 if len(gaps) else lo)
            if cut > lo:
                hi = cut
                break
            hi = min(hi + BLOCK_BYTES, end)  # one word fills the block
        yield lo, hi
        lo = hi


@dataclass
class Spans:
    """Tokens of a text column in order, and the bytes they lie in."""

    hashes: np.ndarray
    starts: np.ndarray  # first byte
    lengths: np.ndarray  # in bytes
    kinds: np.ndarray
    marks: np.ndarray  # marked bytes before the token, within all rows
    offsets: np.ndarray  # n + 1 byte offsets of the rows
    data: np.ndarray

    def rows(self) -> np.ndarray:
        """n + 1 offsets: the tokens of row i are [o[i], o[i + 1])."""
        return np.searchsorted(self.starts, self.offsets)


def _words_only(part: np.ndarray) -> np.ndarray:
    return (~_SPACE[part]).astype(np.uint8)


def spans(
    column: pa.Array | pa.ChunkedArray,
    classify: Callable[[np.ndarray], np.ndarray] = _words_only,
    marked: np.ndarray | None = None,
    fold: Callable[[np.ndarray], np.ndarray] | None = None,
) -> Spans:
    """Tokens are the longest runs of bytes of one class above 0; ``classify`` gives the class of
    each byte and must give 0 for white space. ``marked`` is a table of the bytes to count,
    ``fold`` maps the bytes before they are hashed."""
    data, offsets = buffers(column)
    found: list[tuple[np.ndarray, ...]] = []
    seen = 0
    for lo, hi in _blocks(data, offsets):
        part = data[lo:hi]
        kind = classify(part)
        edge = np.zeros(len(part) + 1, bool)
        inside = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, "right")]
        edge[inside - lo] = True
        edge[0] = edge[-1] = True
        edge[1:-1] |= kind[1:] != kind[:-1]
        token = kind > 0
        first, last = np.flatnonzero(token & edge[:-1]), np.flatnonzero(token & edge[1:])
        up, down = _powers(len(part))
        total = np.cumsum(_VALUES[part if fold is None else fold(part)] * up, dtype=np.uint64)
        before = np.where(first > 0, total[first - 1], np.uint64(0))
        size = last - first
        hashes = mix((total[last] - before) * down[first] + size.astype(np.uint64))
        if marked is None:
            count = np.zeros(len(first), np.int64)
        else:
            here = np.cumsum(marked[part])
            count, seen = seen + here[first], seen + int(here[-1])
        found.append((hashes, first + lo, size + 1, kind[first], count))
    if not found:
        found = [tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.uint8, np.int64))]
    return Spans(*(np.concatenate(x) for x in zip(*found)), offsets, data)


def word_hashes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word in order, and n + 1 offsets: the words of row i are [o[i], o[i+1])."""
    found = spans(column)
    return found.hashes, found.rows()


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``size``-word shingles of each row, repeats included, and their offsets.

    A row with fewer words has one shingle, its whole sequence; a row without words has none.
    """
    factors = constants(size, 2)
    counts = np.diff(offsets)
    many = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_offsets = np.concatenate([[0], np.cumsum(many)])
    rows = np.repeat(np.arange(len(counts)), many)
    at = offsets[:-1][rows] + np.arange(out_offsets[-1]) - out_offsets[:-1][rows]
    out = np.zeros(len(at), np.uint64)
    room = counts[rows]
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    for j in range(size):
        term = padded[at + j] * factors[j]
        out += term if j == 0 else np.where(room > j, term, np.uint64(0))
    return mix(out + np.minimum(room, size).astype(np.uint64)), out_offsets
