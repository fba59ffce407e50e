"""Exact token counts at every prefix, by dynamic programming.

A byte-pair encoding is valid exactly if each two neighbouring tokens are what
their joined bytes encode to.  So the encoding of a prefix is that of a shorter
prefix and one more token that may follow its last one: going through a text
from left to right, each prefix finds its last token among those that end
there, and its count is the shorter prefix's plus one.  Nothing is encoded again.

The recursion runs over the different pieces of a batch side by side, by their
length.  Counts are stored as differences, one byte a character where they fit.
They answer how many tokens a prefix has, and how much of a text a budget
takes, without the tokenizer.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.llm import textscan, tokens
from segmill.llm.common import mapped

#: Budgets that the table answers in columns of its own.
BUDGETS = (512, 2048, 8192)
#: Neighbours that a worker remembers; beyond, it forgets all and goes on.
REMEMBERED = 4_000_000

COUNTS = "doc_id long, n_chars long, n_tokens long, width int, deltas binary"


class Counter:
    """Counts of one tokenizer; remembers which tokens may follow one another."""

    def __init__(self, path: str = tokens.DEFAULT_FILE):
        self.path, self.ranks = path, tokens.ranks(path)
        self.bytes = {i: t for t, i in self.ranks.items()}
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        lengths: dict[int, list[bytes]] = {}
        for t in self.ranks:
            lengths.setdefault(len(t), []).append(t)
        self.longest = max(lengths)
        for n, ts in lengths.items():
            flat = np.frombuffer(b"".join(ts), np.uint8)
            h = self._hash(flat, np.arange(0, len(flat), n), n)
            order = np.argsort(h)
            seen = np.zeros(1 << 18, bool)  # by the first bits of the hash: most lookups end here
            seen[h >> np.uint64(46)] = True
            self.tables[n] = h[order], np.array([self.ranks[t] for t in ts], np.int64)[order], seen
        self.known, self.valid = np.zeros(0, np.int64), np.zeros(0, bool)

    @staticmethod
    def _sums(flat: np.ndarray):
        up, down = textscan._powers(len(flat) + 1)
        sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[: len(flat)], out=sums[1:])
        return sums, down

    def _hash(self, flat: np.ndarray, at: np.ndarray, n: int, sums=None) -> np.ndarray:
        sums, down = sums or self._sums(flat)
        return (sums[at + n] - sums[at]) * down[at]

    def follows(self, pairs: np.ndarray) -> np.ndarray:
        """Whether the second token of each pair, first << 32 | second, may follow the first."""
        at = np.searchsorted(self.known, pairs)
        at[at == len(self.known)] = 0
        if not len(self.known) or not (fresh := self.known[at] != pairs).any():
            if len(self.known):
                return self.valid[at]
            fresh = np.ones(len(pairs), bool)
        new = np.unique(pairs[fresh])
        one = tokens.encoding(self.path)._core_bpe.encode_single_piece
        text = self.bytes
        found = np.fromiter((len(r := one(text[p >> 32] + text[p & 0xFFFFFFFF])) == 2 and r[0] == p >> 32 for p in new.tolist()), bool, len(new))
        if len(self.known) > REMEMBERED:
            self.known, self.valid = np.unique(pairs), None
            return self._refill(pairs, one)
        known = np.concatenate([self.known, new])
        order = np.argsort(known, kind="stable")
        self.known, self.valid = known[order], np.concatenate([self.valid, found])[order]
        return self.valid[np.searchsorted(self.known, pairs)]

    def _refill(self, pairs: np.ndarray, one) -> np.ndarray:
        text = self.bytes
        self.valid = np.fromiter((len(r := one(text[p >> 32] + text[p & 0xFFFFFFFF])) == 2 and r[0] == p >> 32 for p in self.known.tolist()), bool, len(self.known))
        return self.valid[np.searchsorted(self.known, pairs)]

    def count(self, flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """For pieces that lie in flat one after the other: the count of the prefix that ends with each byte."""
        size = len(flat)
        if not size:
            return np.zeros(0, np.int32)
        length = np.diff(bounds)
        offset = np.arange(size) - np.repeat(bounds[:-1], length) + 1  # bytes of the prefix that ends here
        sums = self._sums(flat)
        ends, starts, names = [], [], []
        for n, (table, ids, seen) in self.tables.items():
            e = np.flatnonzero(offset >= n)
            if not len(e):
                continue
            s = e - (n - 1)
            h = (sums[0][e + 1] - sums[0][s]) * sums[1][s]
            maybe = np.flatnonzero(seen[h >> np.uint64(46)])
            e, s, h = e[maybe], s[maybe], h[maybe]
            at = np.searchsorted(table, h)
            at[at == len(table)] = 0
            hit = np.flatnonzero(table[at] == h)
            ends.append(e[hit])
            starts.append(s[hit])
            names.append(ids[at[hit]])
        end, start, name = (np.concatenate(x) for x in (ends, starts, names))
        order = np.lexsort((start, offset[end]))  # by the length of the prefix; the longest token first
        end, start, name = end[order], start[order], name[order]
        steps = np.searchsorted(offset[end], np.arange(1, int(length.max()) + 2))
        counts, last = np.zeros(size, np.int32), np.zeros(size, np.int64)
        for i in range(len(steps) - 1):
            a, b = steps[i], steps[i + 1]
            e, s, t = end[a:b], start[a:b], name[a:b]
            whole = offset[s] == 1  # the prefix is one token
            ok = whole.copy()
            rest = np.flatnonzero(~whole)
            done = np.zeros(0, np.int64)
            if whole.any():
                done = e[whole]
                mark = last  # ends that are settled need no other token
                counts[done], mark[done] = 1, t[whole]
                rest = rest[counts[e[rest]] == 0]
            if len(rest):
                ok = self.follows(last[s[rest] - 1] << 32 | t[rest])
                r = rest[ok]
                counts[e[r]], last[e[r]] = counts[s[r] - 1] + 1, t[r]
        return counts


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def _flat(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, bounds = textscan.raw(strings)
    return data, bounds


def prefix_counts(texts: pa.Array, path: str = tokens.DEFAULT_FILE) -> tuple[np.ndarray, np.ndarray]:
    """The count of the prefix that ends with each character of each text, and where each text's characters begin."""
    p = tokens.cut(texts)
    if not len(p.coded):
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    each = counter(path)
    data, bounds = _flat(p.coded.dictionary)
    by_byte = each.count(data, bounds)
    last = np.ones(len(data), bool)  # bytes that end a character
    last[:-1] = (data[1:] & 0xC0) != 0x80
    inner = by_byte[last].astype(np.int64)
    at = np.append(0, np.cumsum(last))[bounds]  # characters of each different piece
    whole = inner[at[1:] - 1]
    # a contraction of three signs is two pieces while its last sign is missing
    code = p.coded.indices.to_numpy()
    for word in ("'re", "'ve", "'ll"):
        k = pc.index(p.coded.dictionary, word).as_py()
        if k >= 0:
            inner[at[k] + 1] = 2
    length = np.diff(at)[code]
    before = np.append(0, np.cumsum(whole[code]))
    piece_doc = np.repeat(np.arange(len(texts)), np.diff(p.offsets))
    base = before[:-1] - before[p.offsets[:-1]][piece_doc]
    begin = np.append(0, np.cumsum(length))
    index = np.arange(begin[-1]) + np.repeat(at[:-1][code] - begin[:-1], length)
    counts = inner[index] + np.repeat(base, length)
    # at the end of a run of blanks, all of the run is one piece
    k = np.flatnonzero(p.blank[:-1] & (piece_doc[1:] == piece_doc[:-1]))
    if len(k):
        first = p.cp[p.start[k + 1]]
        joined = textscan.char_table()[first] == textscan.SPACE
        k = k[joined]
    if len(k):
        runs = pa.array(["".join(map(chr, p.cp[a : b + 1].tolist())) for a, b in zip(p.start[k].tolist(), p.start[k + 1].tolist())]).dictionary_encode()
        d2, b2 = _flat(runs.dictionary)
        full = each.count(d2, b2)[b2[1:] - 1]
        counts[begin[k + 1]] = base[k] + full[runs.indices.to_numpy()]
    return counts, p.first


def table(docs: DataFrame, path: str = tokens.DEFAULT_FILE, budgets=BUDGETS) -> DataFrame:
    """COUNTS of every row, and for each budget the characters of the longest prefix within it (``fits_512``, ...).

    ``deltas`` holds, for each character, the change of the count, in ``width``
    bytes.  A prefix may have fewer tokens than a shorter one.  Null and empty
    texts have no characters and no tokens.  Repeated rows are counted each; a
    null doc_id stays null.  An empty table gives no rows.  Other columns are
    ignored, whatever their names.
    """
    budgets = tuple(budgets)

    def piece(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, first = prefix_counts(batch.column(1), path)
        chars, total, widths, deltas, fits = [], [], [], [], [[] for _ in budgets]
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            own = counts[a:b]
            change = np.diff(own, prepend=0)
            most = int(np.abs(change).max()) if b > a else 0
            width = 1 if most < 128 else 2 if most < 32768 else 4
            chars.append(b - a)
            total.append(int(own[-1]) if b > a else 0)
            widths.append(width)
            deltas.append(change.astype(f"<i{width}").tobytes())
            for f, budget in zip(fits, budgets):
                f.append(_fit(own, budget))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(chars, pa.int64()), pa.array(total, pa.int64()), pa.array(widths, pa.int32()), pa.array(deltas, pa.binary()), *[pa.array(f, pa.int64()) for f in fits]], ["doc_id", "n_chars", "n_tokens", "width", "deltas", *[f"fits_{x}" for x in budgets]])

    schema = COUNTS + "".join(f", fits_{x} long" for x in budgets)
    return mapped(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), schema, piece, limit=tokens.BATCH_BYTES)


def _fit(counts: np.ndarray, budget: int) -> int:
    if not len(counts) or counts[-1] <= budget:
        return len(counts)
    within = np.flatnonzero(counts <= budget)
    return int(within[-1]) + 1 if len(within) else 0


def _stored(deltas: bytes, width: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(deltas, f"<i{width}").astype(np.int64))


def tokens_at(counts: DataFrame, n_chars, name: str = "tokens") -> DataFrame:
    """Adds the tokens of the first ``n_chars`` characters (a column or number); of the whole text where it is shorter."""
    @F.pandas_udf("long")
    def at(deltas, width, n):
        return pd.Series([int(c[min(k, len(c)) - 1]) if len(c := _stored(d, w)) and k > 0 else 0 for d, w, k in zip(deltas, width, n)], dtype="int64")

    return counts.withColumn(name, at("deltas", "width", F.lit(n_chars).cast("long") if isinstance(n_chars, int) else n_chars.cast("long")))


def fit(counts: DataFrame, budget: int, name: str = "fits") -> DataFrame:
    """Adds the characters of the longest prefix of at most ``budget`` tokens."""
    @F.pandas_udf("long")
    def most(deltas, width):
        return pd.Series([_fit(_stored(d, w), budget) for d, w in zip(deltas, width)], dtype="int64")

    return counts.withColumn(name, most("deltas", "width"))
