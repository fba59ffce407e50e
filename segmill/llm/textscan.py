"""Vectorised text scanning over Arrow string arrays.

Every text operator of this subpackage cuts texts with the functions here.
They work on whole Arrow batches: characters are classified through one
lookup table, boundaries are found with array comparisons, and words are
hashed with prefix sums, so no Python code runs per character or per word.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: Bytes of text that are scanned at once; a longer text is scanned alone.
PIECE_BYTES = 1 << 21

_table: np.ndarray | None = None
_pow: list[np.ndarray] = []
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_WHITE = {9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}


def char_table() -> np.ndarray:
    """Class of each code point: letter, number, white space or other."""
    global _table
    if _table is None:
        by = {"L": LETTER, "N": NUMBER}
        t = np.zeros(0x110000, np.uint8)
        t[:0x32000] = [by.get(unicodedata.category(chr(c))[0], 0) for c in range(0x32000)]
        t[list(_WHITE)] = SPACE
        _table = t
    return _table


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64."""
    if not _pow or len(_pow[0]) < n:
        n = max(n, PIECE_BYTES + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        _pow.clear()
        for base in (_BASE, inverse):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _pow.append(np.multiply.accumulate(p))
    return _pow[0], _pow[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array and the offsets of its values; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.string())
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()[:3]
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64) if off is not None and len(arr) else np.zeros(len(arr) + 1, np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of values whose bytes stay under the limit; a longer value is a range by itself."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def decode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, the bytes each takes, and the offsets of the values in code points."""
    cp = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    width = np.ones(len(cp), np.uint8)
    width += cp >= 0x80
    width += cp >= 0x800
    width += cp >= 0x10000
    at = np.zeros(len(cp) + 1, np.int32)  # an Arrow string array has less than 2 GB
    np.cumsum(width, out=at[1:])
    return cp, width, np.searchsorted(at, offsets)


class Words:
    """Words of a run of texts: ``hash[i]`` and byte range of each, and word offsets per text."""

    __slots__ = ("hash", "offsets", "bytes", "bounds", "first", "last")

    def __init__(self, hash, offsets, data, bounds, first, last):  # noqa: A002
        self.hash, self.offsets, self.bytes, self.bounds, self.first, self.last = hash, offsets, data, bounds, first, last

    def strings(self) -> pa.Array:
        """The words, lower case."""
        return pa.Array.from_buffers(pa.string(), len(self.bounds) - 1, [None, pa.py_buffer(self.bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(self.bytes))])


def words(arr: pa.Array) -> Words:
    """Maximal runs of letters and digits, lower case.

    ``first`` and ``last`` are the code-point range of each word in its text.
    """
    data, offsets = raw(pc.utf8_lower(arr))
    n = len(offsets) - 1
    if not len(data):
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(n + 1, np.int64), np.zeros(0, np.uint8), np.zeros(1, np.int64), z, z)
    cp, width, docs = decode(data, offsets)
    k = char_table()[cp]
    inside = (k == LETTER) | (k == NUMBER)
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    edge = docs[:-1][docs[:-1] < len(cp)]
    opens[edge] = inside[edge]
    starts = np.flatnonzero(opens)
    shut = inside.copy()
    shut[:-1] &= ~inside[1:]
    edge = docs[1:][(docs[1:] > 0)] - 1
    shut[edge] = inside[edge]
    ends = np.flatnonzero(shut) + 1
    kept = data[np.repeat(inside, width)]
    span = np.zeros(len(cp) + 1, np.int32)
    np.cumsum(np.where(inside, width, 0), out=span[1:])
    bounds = np.append(span[starts], len(kept))
    per = np.searchsorted(starts, docs)
    own = np.repeat(docs[:-1], np.diff(per))
    return Words(string_hash(kept, bounds), per, kept, bounds, starts - own, ends - own)


def string_hash(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit hashes of consecutive byte strings, from prefix sums of a polynomial."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[bounds[1:]] - sums[bounds[:-1]]) * down[bounds[:-1]]
    return mix(h + (bounds[1:] - bounds[:-1]).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n values from each position on; the last n - 1 positions have none."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for j in range(n):
        out *= np.uint64(0x2545F4914F6CDD1D)
        out += hashes[j : len(hashes) - n + 1 + j]
    return mix(out)


def long_windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """As windows(), in time that doesn't depend on n."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: len(hashes) - n + 1])
