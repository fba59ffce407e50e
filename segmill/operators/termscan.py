"""Tokens of whole Arrow batches: the rule of functions.text.tokens() by array operations.

Texts are decoded once, code points are classified through a table, and the
runs of letters and numbers become one string array that shares no Python
object with its neighbours.  Each different token is lowered once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from segmill.functions.text import MAX_TOKEN_BYTES

#: Bytes of text that are cut at once; a longer text is cut alone.
PIECE_BYTES = 1 << 20


@lru_cache(maxsize=1)
def _in_token() -> np.ndarray:
    """Whether each code point is a letter or a number."""
    return np.array([unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)], bool)


def bounded(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have PIECE_BYTES at most, or that are one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < batch.num_rows:
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + PIECE_BYTES, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _runs(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of every run of letters and numbers in order, and the runs; null texts have none."""
    texts = pc.fill_null(texts, "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    data = _bytes(texts)
    if not len(data):
        return np.zeros(0, np.int64), pa.array([], pa.string())
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    # the bytes of a token, by whether each byte belongs to one
    inside = _in_token()[points]
    lead = (data & 0xC0) != 0x80
    member = inside[np.cumsum(lead) - 1]
    edge = np.zeros(len(data) + 1, bool)  # where a text ends, so does a token
    edge[np.cumsum(sizes)] = True
    opens = member.copy()
    opens[1:] &= ~member[:-1] | edge[1:-1]
    starts = np.flatnonzero(opens)
    row = np.searchsorted(np.cumsum(sizes), starts, side="right")
    kept = np.ascontiguousarray(data[member])
    bounds = np.append(np.cumsum(member)[starts] - 1, len(kept)).astype(np.int32)
    return row, pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(kept)])


def cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, code) of every token in order, and the different tokens; null texts have none."""
    row, runs = _runs(texts)
    tokens = runs.dictionary_encode()
    low = _lower(tokens.dictionary).dictionary_encode()
    code = low.indices.to_numpy()[tokens.indices.to_numpy()]
    short = pc.binary_length(low.dictionary).to_numpy() <= MAX_TOKEN_BYTES
    if not short.all():
        good = short[code]
        row, code = row[good], code[good]
    return row, code, low.dictionary


def _bytes(texts: pa.Array) -> np.ndarray:
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)


def _lower(words: pa.Array) -> pa.Array:
    """Each letter lowered by itself; the one whose small form has a mark of its own keeps that."""
    low = pc.utf8_lower(words)
    odd = pc.match_substring(words, "İ")
    if pc.any(odd).as_py():
        full = [x.replace("Σ", "σ").lower() if o else y for x, y, o in zip(words.to_pylist(), low.to_pylist(), odd.to_pylist())]
        low = pa.array(full, pa.string())
    return low


def counts(texts: pa.Array) -> np.ndarray:
    """Tokens of each text."""
    row, runs = _runs(texts)
    some = np.flatnonzero(pc.binary_length(runs).to_numpy() > MAX_TOKEN_BYTES // 2)  # a small letter has at most three bytes for two
    if len(some):
        long = pc.binary_length(_lower(runs.take(pa.array(some)))).to_numpy() > MAX_TOKEN_BYTES
        row = np.delete(row, some[long])
    return np.bincount(row, minlength=len(texts)).astype(np.int64)


def frequencies(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row, term, freq): each different token of each text once."""
    row, code, terms, freq = _counted(texts)
    return row, terms.take(pa.array(code)), freq


def _counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    row, code, terms = cut(texts)
    cell, freq = np.unique(row * max(1, len(terms)) + code, return_counts=True)
    return cell // max(1, len(terms)), cell % max(1, len(terms)), terms, freq.astype(np.int64)


def grouped(seg: np.ndarray, doc: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array, pa.Array]:
    """(segment, first document, term, documents in order, frequencies): the postings of each term in each segment in one row."""
    row, code, terms, freq = _counted(texts)
    order = np.lexsort((doc[row], code, seg[row]))
    row, code, freq = row[order], code[order], freq[order]
    own = seg[row]
    starts = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (code[1:] != code[:-1]))) if len(row) else np.zeros(0, np.int64)
    at = pa.array(np.append(starts, len(row)).astype(np.int32))
    docs = doc[row]
    return own[starts], docs[starts], terms.take(pa.array(code[starts])), pa.ListArray.from_arrays(at, pa.array(docs)), pa.ListArray.from_arrays(at, pa.array(freq.astype(np.int32)))
