"""The k best vectors of a block for each of a block of queries: products in single precision rule out, double precision decides.

Blocks are multiplied tile by tile.  What may be among a query's k best, by
those seen so far and a bound on the rounding of the products, is noted; what is
left of that in the end is scored in double precision and ranked.  So the result
is that of comparing all in double precision, and memory hangs on the sizes of
tile, block and k alone.
"""

from __future__ import annotations

import numpy as np

#: Rows and columns of a tile of products.
TILE = 2048
#: Noted pairs that are held before they are reduced, and pairs that are scored at once.
NOTED, SCORED = 1 << 20, 1 << 14
#: Scores are ranked on so many places, then by id.
PLACES = 9
#: Longest vector whose squares are summed in single precision.
_LONG = 1e15


class Block:
    """Vectors with a number each (a cell, or how far a query reaches); those with a component that isn't a finite number are left out."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, extra: np.ndarray, metric: str):
        good = np.flatnonzero(np.isfinite(x).all(1))
        good = good[np.lexsort((ids[good], extra[good]))]
        self.ids, self.x, self.extra = ids[good], x[good], extra[good]
        wide = self.x.astype(np.float64)
        self.squares = np.einsum("ij,ij->i", wide, wide)
        self.norms = np.sqrt(self.squares)
        self.longest = float(self.norms.max(initial=0.0))
        if metric == "cosine":
            wide /= np.where(self.norms == 0, 1.0, self.norms)[:, None]
        self._wide = wide

    def factor(self, metric: str, kind: type, left: bool) -> np.ndarray:
        """What is multiplied; minus the squared distance is one product of vectors with two more components."""
        if metric != "euclidean":
            return self._wide.astype(kind)
        one, squares = np.ones((len(self.x), 1)), self.squares[:, None]
        return np.hstack([2 * self._wide, -squares, -one] if left else [self._wide, one, squares]).astype(kind)

    def slack(self, metric: str, kind: type, other: float) -> np.ndarray:
        """How much less than the k-th best product a product may be whose score is among the k best."""
        unit = 1.01 * (self.x.shape[1] + 10) * np.finfo(kind).eps / 2
        places = 2.0 * 10.0**-PLACES
        if metric == "cosine":
            return 2 * unit + places / np.where(self.norms == 0, 1.0, self.norms)
        return 2 * unit * ((self.norms + other) ** 2 if metric == "euclidean" else self.norms * other) + places


def _ranks(rows: np.ndarray) -> np.ndarray:
    """The place of each entry in the run of its row."""
    at = np.arange(len(rows))
    begins = np.ones(len(rows), bool)
    begins[1:] = rows[1:] != rows[:-1]
    return at - np.maximum.accumulate(np.where(begins, at, 0))


class _Best:
    """The best so far for queries at places from ``first`` on."""

    def __init__(self, queries: Block, vectors: Block, first: int, n: int, slack: np.ndarray, metric: str, k: int, kind: type):
        self.queries, self.vectors, self.first, self.metric, self.k, self.kind = queries, vectors, first, metric, k, kind
        self.slack, self.low, self.least = slack, np.full(n, -np.inf), np.full(n, np.finfo(kind).min)
        self.noted, self.n = [], 0

    def bound(self, at, products: np.ndarray) -> None:
        """Raises the bounds of queries by a tile, queries by vectors: the k-th greatest of the maxima of groups is no better than the k-th best."""
        groups = max(128, 4 * self.k)
        many = products.shape[1] // groups
        tops = products if not many else products[:, : many * groups].reshape(len(products), many, groups).max(1)
        if tops.shape[1] >= self.k:
            self._raise(at, np.partition(tops, tops.shape[1] - self.k, axis=1)[:, tops.shape[1] - self.k])

    def _raise(self, at, low: np.ndarray) -> None:
        self.low[at] = np.maximum(self.low[at], low)
        least = np.maximum(self.low[at] - self.slack[at], np.finfo(self.kind).min).astype(self.kind)  # a product that is minus infinity is of no use
        self.least[at] = np.maximum(np.nextafter(least, self.kind(-np.inf)), np.finfo(self.kind).min)

    def note(self, rows: np.ndarray, cols: np.ndarray, products: np.ndarray) -> None:
        for i in range(0, len(rows), NOTED):
            part = slice(i, i + NOTED)
            self.noted.append((rows[part].astype(np.int32), cols[part].astype(np.int32), products[part], np.full(len(rows[part]), np.nan)))
            self.n += len(rows[part])
            if self.n > 2 * NOTED:
                self.reduce()
                if self.n > NOTED:
                    self.score()

    def reduce(self) -> None:
        """Forgets what the k best products of each query rule out."""
        if len(self.noted):
            rows, cols, products, scores = (np.concatenate(c) for c in zip(*self.noted))
            order = np.lexsort((-products, rows))
            last = order[_ranks(rows[order]) == self.k - 1]
            self._raise(rows[last], products[last])
            kept = products >= self.least[rows]
            self._keep(rows[kept], cols[kept], products[kept], scores[kept])

    def score(self) -> None:
        """Scores what is noted, and keeps k for each query."""
        if not len(self.noted):
            return
        rows, cols, products, scores = (np.concatenate(c) for c in zip(*self.noted))
        new = np.flatnonzero(np.isnan(scores))
        for i in range(0, len(new), SCORED):
            at = new[i : i + SCORED]
            q, x = self.queries.x[self.first + rows[at]].astype(np.float64), self.vectors.x[cols[at]].astype(np.float64)
            if self.metric == "euclidean":
                q -= x
                s = -np.einsum("ij,ij->i", q, q)
            else:
                s = np.einsum("ij,ij->i", q, x)
                if self.metric == "cosine":
                    n = self.vectors.norms[cols[at]]
                    s /= np.where(n == 0, 1.0, n)
            scores[at] = np.round(s, PLACES)
        order = np.lexsort((self.vectors.ids[cols], -scores, rows))
        order = order[_ranks(rows[order]) < self.k]
        self._keep(rows[order], cols[order], products[order], scores[order])

    def _keep(self, *columns: np.ndarray) -> None:
        self.noted, self.n = [columns], len(columns[0])

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, id, score), by place and then from the best on."""
        self.reduce()
        self.score()
        if not len(self.noted):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        rows, cols, _, scores = self.noted[0]
        found = scores > -np.inf
        return self.first + rows[found].astype(np.int64), self.vectors.ids[cols[found]], scores[found]


def _marked(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the few true cells, eight cells a step."""
    if marks.size % 8:
        flat = np.flatnonzero(marks)
    else:
        words = np.flatnonzero(marks.reshape(-1).view(np.uint64))
        word, byte = np.nonzero(marks.reshape(-1, 8)[words])
        flat = words[word] * 8 + byte
    return np.divmod(flat, marks.shape[1])


def _same(some: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal ids."""
    order = np.argsort(others, kind="stable")
    low, high = (np.searchsorted(others[order], some, side) for side in ("left", "right"))
    n = high - low
    rows = np.repeat(np.arange(len(some)), n)
    return rows, order[np.repeat(low, n) + _ranks(rows)]


def _tiles(n: int, cells: np.ndarray | None):
    """Places from and to; no tile has vectors of two cells, where there are cells."""
    edges = [0, n] if cells is None else [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), n]
    for a, b in zip(edges, edges[1:]):
        for i in range(a, b, TILE):
            yield i, min(b, i + TILE)


def nearest(a: Block, b: Block, metric: str, k: int, no_self: bool, both: bool = False, centres: np.ndarray | None = None):
    """The k best vectors of b for each of a, and with ``both`` those of a for each of b, as _Best.result() has them.

    With centres, b's numbers are cells and a's say how far each reaches: only
    vectors of cells that lie within are looked at.
    """
    kind = np.float32 if max(a.longest, b.longest) < _LONG else np.float64
    left, right = a.factor(metric, kind, True), b.factor(metric, kind, False)
    slack = a.slack(metric, kind, b.longest)
    other = _Best(b, a, 0, len(b.ids), b.slack(metric, kind, a.longest), metric, k, kind) if both else None
    ids, found, strips = np.sort(b.ids), [], 0
    tiles = list(_tiles(len(b.ids), b.extra if centres is not None else None))
    for i in range(0, len(a.ids), TILE):
        end = min(len(a.ids), i + TILE)
        own, n = _Best(a, b, i, end - i, slack[i:end], metric, k, kind), 0
        meets = no_self and bool((np.searchsorted(ids, a.ids[i:end], "right") > np.searchsorted(ids, a.ids[i:end], "left")).any())
        within = _within(a, i, end, b, tiles, centres) if centres is not None else None
        for t, (j, stop) in enumerate(tiles):
            rows = np.flatnonzero(within[:, t]) if within is not None else None
            if rows is not None and not len(rows):
                continue
            products = (left[i:end] if rows is None else left[i + rows]) @ right[j:stop].T
            if kind is np.float64:
                products[np.isnan(products)] = -np.inf
            if meets:
                products[_same(a.ids[i:end] if rows is None else a.ids[i + rows], b.ids[j:stop])] = -np.inf
            at = slice(None) if rows is None else rows
            if np.isneginf(own.low[at]).any():
                own.bound(at, products)
            r, c = _marked(products >= own.least[at, None])
            own.note(r if rows is None else rows[r], j + c, products[r, c])
            n += 1
            if not n & n - 1:
                own.reduce()
            if other is not None:
                if not strips:
                    other.bound(slice(j, stop), products.T)
                r, c = _marked(products >= other.least[None, j:stop])
                other.note(j + c, i + r, products[r, c])
        found.append(own.result())
        strips += 1
        if other is not None and not strips & strips - 1:
            other.reduce()
    mine = tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return mine, other.result() if other is not None else None


def _within(a: Block, i: int, end: int, b: Block, tiles: list, centres: np.ndarray) -> np.ndarray:
    """Whether each query reaches the cell of each tile."""
    c = centres[b.extra[[j for j, _ in tiles]].astype(np.int64)] if tiles else centres[:0]
    d = (c * c).sum(1)[None, :] - 2 * a.x[i:end].astype(np.float64) @ c.T
    return d <= a.extra[i:end, None] + 1e-9 * (1 + np.abs(a.extra[i:end, None]))
