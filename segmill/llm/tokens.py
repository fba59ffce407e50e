"""Byte-level BPE over Arrow batches: pieces by array operations, each different piece encoded once.

A text is cut into pieces as the tokenizer's pattern does, with comparisons of
character classes.  The pieces of a batch are dictionary-encoded, so that the
tokenizer sees every different piece once, and ids are gathered back.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa

from segmill.llm import textscan
from segmill.llm.textscan import LETTER, SPACE

#: A file of lines "base64 rank".
DEFAULT_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes of text that are cut at once.
BATCH_BYTES = 4 << 20
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def ranks(path: str = DEFAULT_FILE) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoding(path: str = DEFAULT_FILE, pattern: str = PATTERN):
    import tiktoken

    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


class Pieces:
    """``coded`` is the dictionary array of the pieces, ``offsets`` where each text's begin.

    ``start`` and ``blank`` are for prefix counts: the code point at which a
    piece begins in the batch, and whether it is white space.
    """

    __slots__ = ("coded", "offsets", "start", "blank", "first", "cp", "width")

    def __init__(self, coded, offsets, start, blank, first, cp, width):
        self.coded, self.offsets, self.start, self.blank, self.first, self.cp, self.width = coded, offsets, start, blank, first, cp, width


def cut(texts: pa.Array) -> Pieces:
    """The pieces of each text, as PATTERN cuts them."""
    data, offsets = textscan.raw(texts)
    n = len(offsets) - 1
    if not len(data):
        z = np.zeros(0, np.int64)
        return Pieces(pa.array([], pa.string()).dictionary_encode(), np.zeros(n + 1, np.int64), z, z.astype(bool), np.zeros(n + 1, np.int64), z.astype(np.uint32), z.astype(np.uint8))
    cp, width, docs = textscan.decode(data, offsets)
    kind = textscan.char_table()[cp]
    size = len(cp)
    begin = np.ones(size, bool)  # a run of one class begins here
    begin[1:] = kind[1:] != kind[:-1]
    first = np.zeros(size + 1, bool)
    first[docs] = True
    begin |= first[:-1]
    ends = np.append(begin[1:], True)  # the last of its run
    cuts = begin.copy()
    # the last blank of a run before a word is cut off; a space joins the word
    tail = np.flatnonzero((kind == SPACE) & ends & ~np.append(first[1:-1], True))
    cuts[tail] = True
    joins = tail[cp[tail] == 32] + 1
    cuts[joins] = False
    # 's 't 'm 'd 're 've 'll
    quote = np.flatnonzero((cp == 39) & cuts & ends & ~np.append(first[1:-1], True))
    if len(quote):
        quote = quote[kind[quote + 1] == LETTER]
        c = cp[quote + 1]
        single = quote[(c == 115) | (c == 116) | (c == 109) | (c == 100)]
        two = quote + 2 < size
        d = np.where(two & ~first[np.minimum(quote + 2, size)], cp[np.minimum(quote + 2, size - 1)], 0)
        double = quote[((c == 114) & (d == 101)) | ((c == 118) & (d == 101)) | ((c == 108) & (d == 108))]
        for q, length in ((single, 2), (double, 3)):
            cuts[q + 1] = False
            after = q + length
            after = after[after < size]
            cuts[after[kind[after] == LETTER]] = True
    start = np.flatnonzero(cuts)
    at = np.zeros(size + 1, np.int32)
    np.cumsum(width, out=at[1:])
    bounds = np.append(at[start], np.int32(len(data)))
    strings = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    return Pieces(strings.dictionary_encode(), np.searchsorted(start, docs), start, (kind[start] == SPACE) & (kind[np.append(start[1:], size) - 1] == SPACE), docs, cp, width)


_MARK = "\x00"


def encode_each(pieces: list[str], path: str = DEFAULT_FILE) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces one after the other, and where each piece's begin.

    One call of the tokenizer takes them all, parted by a mark that its pattern cuts at.
    """
    e = encoding(path, f"[^{_MARK}]+|{_MARK}")
    mark = ranks(path)[_MARK.encode()]
    plain = [p if _MARK not in p else "" for p in pieces]
    flat = np.array(e.encode_ordinary(_MARK.join(plain) + _MARK) if plain else [], np.uint32)
    stop = np.flatnonzero(flat == mark)
    offsets = np.zeros(len(pieces) + 1, np.int64)
    offsets[1:] = stop - np.arange(len(stop))
    ids = np.delete(flat, stop)
    odd = [i for i, p in enumerate(pieces) if _MARK in p]
    if odd:  # pieces that hold the mark itself
        own = encoding(path)
        parts = np.split(ids, offsets[1:-1])
        for i in odd:
            parts[i] = np.array(own.encode_ordinary(pieces[i]), np.uint32)
        offsets[1:] = np.cumsum([len(p) for p in parts])
        ids = np.concatenate(parts)
    return ids, offsets


def encode(texts: pa.Array, path: str = DEFAULT_FILE) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts, and where each text's begin; null counts as empty."""
    found = cut(texts)
    if not len(found.coded):
        return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
    ids, at = encode_each(found.coded.dictionary.to_pylist(), path)
    code = found.coded.indices.to_numpy()
    length = np.diff(at)[code]
    ends = np.cumsum(length)
    begin = np.append(0, ends)
    index = np.arange(ends[-1]) + np.repeat(at[code] - begin[:-1], length)
    return ids[index], begin[found.offsets]
