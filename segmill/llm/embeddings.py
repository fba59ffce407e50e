"""Near-duplicate vectors: all pairs by blocks, without loss at any size.

Vectors are scaled to length 1, and equal vectors are one vector with several
copies.  A tree of medians along the principal axes, made from a bounded sample,
sorts vectors into leaves, and leaves are cut into tiles.  Each two tiles meet
unless the boxes around them along those axes are further apart than any two
near-duplicates, and so do the vectors of a tile and the other's box: an
orthogonal projection lengthens no distance.  What meets is multiplied in single
precision, and what that leaves open, by a bound on its rounding, is decided in
double precision, pair by pair; so whether two vectors are linked hangs on these
two alone.  Of each two tiles come out their links by vector and a root for each
connected part, not the pairs.  Vectors that are spread evenly in all dimensions
leave nothing to rule out; the work is then the square of the vectors, and
neither disk nor memory grows with it.

For tables where that is too much a caller may give a radius and have only the
vectors compared whose codes lie within this Hamming distance; that loses links,
and the queries don't do it.  Codes are made by iterative quantisation: vectors
are centred and turned to their principal axes; a rotation is then learnt that
puts them close to the corners of a cube, so that signs make balanced bits.
Mean, covariance and each step of the rotation are sums over all vectors, made
by the executors.  Vectors of one code are a cell.  Different codes are searched
through multi-index Hamming tables: a code is cut into substrings and stands in
each table under the keys within a small distance of its substring, so that no
two codes within the radius pass each other, however many there are.  Where
vectors have a common direction, what centring leaves of them is short, and the
radius is widened.  A pair of codes counts once, in the first table and under
the one key that is due to it.  Cells that meet, and each cell with itself, are
reranked by the cosines of the vectors themselves.
"""

from __future__ import annotations

from itertools import combinations
from math import acos, ceil, comb, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.llm.common import Scratch, bounded, components, release

#: Least cosine of near-duplicates.
THRESHOLD = 0.95
#: Bits of a code, at most; vectors of fewer dimensions have one bit for each.
BITS = 64
#: Vectors of a tile, at most, and bytes of their numbers.
TILE, TILE_BYTES = 1024, 4 << 20
#: Bytes of a file of tiles, about; a task compares the tiles of two files or, where Spark reads small ones together, some more.
FILE_BYTES = 32 << 20
#: Vectors, and numbers in them, of the sample that the tree of tiles is made from, about; and its vectors in a leaf, at least.
SAMPLE, SAMPLE_CELLS, SAMPLE_LEAF = 20_000, 1 << 22, 8
#: Axes of the boxes around tiles, at most.
AXES = 64
#: A radius for callers that want only codes within it compared: 64 bits of vectors at the threshold differ in 6.5 +- 2.4.
RADIUS = 11
#: Share of vectors that lie closer to the mean than the length after centring that the radius is made for.
SHORT_SHARE = 0.05
#: Keys a code up to which tables have the longest substrings.
KEYS = 100
#: Bits of a substring, at least and at most.
SUBSTRING = (8, 20)
#: Codes of a bucket from which on it is compared block by block, and vectors or codes of a block.
HOT, BLOCK = 50_000, 512
#: Passes in which the rotation is learnt.
ROUNDS = 8


def _vectors(table: DataFrame, key: str, column: str, scratch: Scratch) -> tuple[DataFrame, int]:
    """(id, name, v) of the usable rows, v of length 1 in double precision, name a hash of the vector; and the dimensions."""
    good = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.select(table[key].cast("long").alias("id"), table[column].cast("array<double>").alias("v")).where(F.col("id").isNotNull() & good)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    name = F.struct(F.xxhash64("v"), F.xxhash64(F.lit(1), "v"))
    rows = rows.withColumn("length", length).where("length > 0").select("id", name.alias("name"), F.transform("v", lambda x: x / F.col("length")).alias("v"))
    rows = scratch.write(rows, "vectors")
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows, sizes["n"] if sizes else 0


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(rows: DataFrame, shape: tuple[int, int], part) -> np.ndarray:
    """Sum over all rows of matrices that part(batch) gives; cells are added by the executors."""

    def run(batches):
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += part(_matrix(batch.column(0)))
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["cell", "value"])

    cells = rows.select("v").mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    out = np.zeros(shape[0] * shape[1])
    for r in cells.collect():  # as many rows as the matrix has cells
        out[r["cell"]] = r["value"]
    return out.reshape(shape)


def learn(rows: DataFrame, dims: int, n: int, bits: int = BITS, rounds: int = ROUNDS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): the signs of (v - mean) @ projection are the code."""
    moments = _summed(rows, (dims + 1, dims), lambda x: np.vstack([x.sum(0), x.T @ x]))
    mean = moments[0] / n
    values, axes = np.linalg.eigh(moments[1:] / n - np.outer(mean, mean))
    c = min(bits, dims)
    axes = axes[:, np.argsort(values)[::-1][:c]]
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((c, c)))[0]
    for _ in range(rounds):

        def part(x, axes=axes, rotation=rotation):
            p = (x - mean) @ axes
            return p.T @ np.where(p @ rotation >= 0, 1.0, -1.0)

        u, _, vt = np.linalg.svd(_summed(rows, (c, c), part))
        rotation = u @ vt
    return mean, axes @ rotation


def short_length(rows: DataFrame, mean: np.ndarray) -> float:
    """Squared length after centring that SHORT_SHARE of the vectors stay below."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(((_matrix(batch.column(0)) - mean) ** 2).sum(1))], ["s"])

    return rows.select("v").mapInArrow(run, "s double").agg(F.percentile_approx("s", SHORT_SHARE, 10_000)).first()[0]


def reach_of(radius: int, bits: int, threshold: float, squared: float) -> int:
    """The radius for vectors that have this squared length after centring, at least ``radius``.

    Two vectors keep their distance when they are centred, so the shorter they
    get the wider is the angle between them, of which each bit differs by its
    share of half a turn.  The radius stays as many standard deviations above
    the mean as ``radius`` is for BITS bits of vectors of length 1.
    """
    share = lambda cosine: acos(max(-1.0, min(1.0, cosine))) / pi
    p, q = share(threshold), share(1 - (1 - threshold) / squared if squared > 0 else -1.0)
    spread = sqrt(BITS * p * (1 - p))
    above = (radius - BITS * p) / spread if spread else 0.0
    return min(bits, max(radius, round(bits * q + above * sqrt(bits * q * (1 - q)))))


def codes(rows: DataFrame, mean: np.ndarray, projection: np.ndarray) -> DataFrame:
    """(id, copies, code, v): the bits of each vector in one long."""
    weights = (np.uint64(1) << np.arange(projection.shape[1], dtype=np.uint64)).astype(np.uint64)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                bits = (_matrix(batch.column(2)) - mean) @ projection >= 0
                code = (bits * weights).sum(1, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code)], ["id", "copies", "v", "code"])

    return bounded(rows.select("id", "copies", "v")).mapInArrow(run, "id long, copies long, v array<double>, code long")


def tables(n: int, bits: int, radius: int = RADIUS) -> tuple[list[int], int]:
    """The mask of each substring, and the distance within which codes stand in a table.

    Codes meet in a table if they differ in its substring by no more than twice
    that distance, and no two within the radius miss each other in all tables.
    Substrings have about log2(n) bits, or as few less as KEYS asks for (or as
    take the fewest keys, where KEYS can't be held); n changes the work, not
    what meets.
    """
    b = max(min(bits, SUBSTRING[0]), min(SUBSTRING[1], bits, round(log2(max(2, n)))))
    found = []
    for m in range(max(1, bits // b), max(1, bits // SUBSTRING[0]) + 1):
        longest, reach = -(-bits // m), max(0, ceil(((radius + 1) / m - 1) / 2))
        found.append((m * sum(comb(longest, k) for k in range(min(reach, longest) + 1)), m, reach))
    _, m, reach = next((x for x in found if x[0] <= KEYS), min(found))
    cuts = [(bits * i // m, bits * (i + 1) // m) for i in range(m)]
    return [sum(1 << b for b in range(i, j)) for i, j in cuts], reach


def flips(mask: int, reach: int) -> np.ndarray:
    """All ways to change up to ``reach`` bits of the mask."""
    own = [b for b in range(64) if mask >> b & 1]
    return np.array([sum(1 << b for b in bits) for k in range(min(reach, len(own)) + 1) for bits in combinations(own, k)], np.uint64)


def candidates(cells: DataFrame, n: int, bits: int, radius: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of different codes within the radius, each once; cells has each code once."""
    masks, reach = tables(n, bits, radius)
    changes = [flips(mask, reach) for mask in masks]
    every = np.array(masks, np.uint64)

    def place(batches):
        for batch in batches:
            code = batch.column(0).to_numpy().view(np.uint64)
            for t, change in enumerate(changes):
                for begin in range(0, len(code), 2000):  # bounds what is in memory
                    some = code[begin : begin + 2000]
                    keys = ((some & every[t])[:, None] ^ change[None, :]).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), t, np.int32)), pa.array(keys.view(np.int64)), pa.array(np.repeat(some, len(change)).view(np.int64))], ["t", "key", "code"])

    def due(x, y, t, key):
        """Which of these pairs, that are in one bucket, are near and count here."""
        differ = x ^ y
        good = (np.bitwise_count(differ) <= radius) & (differ != 0)
        for i, mask in enumerate(every[:-1]):
            good &= (t <= i) | (np.bitwise_count(differ & mask) > 2 * reach)
        rest = differ & every[t]
        home, more = np.minimum(x, y) & every[t], np.bitwise_count(rest).astype(np.int64) - reach
        for k in range(reach):  # the key changes the lowest bits that the lesser code has to change
            low = rest & (~rest + np.uint64(1))
            home = np.where(more > k, home ^ low, home)
            rest ^= low
        return good & (home == key)

    def meet(batches):
        left = None
        for batch in _then_none(batches):
            if batch is not None:
                own = [batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy().view(np.uint64)]
                left = own if left is None else [np.concatenate(x) for x in zip(left, own)]
                if not len(left[0]):
                    continue
                other = np.flatnonzero((left[0] != left[0][-1]) | (left[1] != left[1][-1]))
                if not len(other):
                    continue  # the bucket may go on in the next batch
                end = int(other[-1]) + 1
            elif left is None:
                return
            else:
                end = len(left[0])
            t, key, code = (x[:end] for x in left)
            left = [x[end:] for x in left]
            step = 1
            while step < len(key):
                same = np.flatnonzero((key[step:] == key[:-step]) & (t[step:] == t[:-step]))
                if not len(same):
                    break
                same = same[due(code[same], code[same + step], t[same], key[same])]
                if len(same):
                    yield _code_pairs(code[same], code[same + step])
                step += 1

    def blocked(batches):
        for batch in batches:
            for t, key, x, y, twice in zip(*(batch.column(i) for i in range(5))):
                x, y = (z.values.to_numpy().view(np.uint64) for z in (x, y))
                i, j = (z.ravel() for z in np.meshgrid(np.arange(len(x)), np.arange(len(y)), indexing="ij"))
                if twice.as_py():
                    i, j = i[i < j], j[i < j]
                good = due(x[i], y[j], np.full(len(i), t.as_py()), np.uint64(key.as_py() & (1 << 64) - 1))
                yield _code_pairs(x[i[good]], y[j[good]])

    placed = bounded(cells).mapInArrow(place, "t int, key long, code long")
    crowded = scratch.write(_crowded(cells, masks, changes), "crowded")
    if crowded.isEmpty():
        return placed.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(meet, "a long, b long")
    calm = placed.join(crowded, ["t", "key"], "left_anti").repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(meet, "a long, b long")
    part = F.pmod(F.xxhash64("code"), F.col("parts"))
    blocks = placed.join(crowded, ["t", "key"]).withColumn("part", part).groupBy("t", "key", "parts", "part").agg(F.collect_list("code").alias("x"))  # about BLOCK codes
    blocks = scratch.write(blocks, "blocks")
    ahead = blocks.select("t", "key", "x", "part", F.explode(F.sequence("part", F.col("parts") - 1)).alias("other"))
    both = ahead.join(blocks.select("t", "key", F.col("part").alias("other"), F.col("x").alias("y")), ["t", "key", "other"])
    both = both.select("t", "key", "x", "y", (F.col("part") == F.col("other")).alias("twice"))
    return calm.unionByName(bounded(both).mapInArrow(blocked, "a long, b long"))


def _code_pairs(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y).view(np.int64)), pa.array(np.maximum(x, y).view(np.int64))], ["a", "b"])


def _crowded(cells: DataFrame, masks: list[int], changes: list[np.ndarray]) -> DataFrame:
    """(t, key, parts) of the buckets of more than HOT codes.

    Such a bucket has a substring that is more than HOT / keys codes' own; those
    few are counted first.
    """
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    own = cells.select("code", F.posexplode(F.array(*[F.lit(m).cast("long") for m in signed])).alias("t", "mask")).groupBy("t", F.col("code").bitwiseAND(F.col("mask")).alias("own")).agg(F.count("*").alias("n"))
    many = own.where(F.col("n") > HOT / max(map(len, changes)))
    keys = None
    for t, change in enumerate(changes):
        here = many.where(F.col("t") == t).select("t", "n", F.explode(F.array(*[F.col("own").bitwiseXOR(F.lit(c).cast("long")) for c in change.view(np.int64).tolist()])).alias("key")) if len(change) > 1 else many.where(F.col("t") == t).select("t", "n", F.col("own").alias("key"))
        keys = here if keys is None else keys.unionByName(here)
    return keys.groupBy("t", "key").agg(F.sum("n").alias("n")).where(F.col("n") > HOT).select("t", "key", F.ceil(F.col("n") / BLOCK).alias("parts"))


def _then_none(batches):
    yield from batches
    yield None


def _joined(near: np.ndarray, a: np.ndarray, m: np.ndarray, b: np.ndarray, k: np.ndarray, same: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, links, roots) of each side's vectors that have a link: a and b are ids, m and k copies; same: both sides are one."""
    top, side, last = a.copy(), b.copy(), None
    far = np.iinfo(np.int64).max
    while last is None or (last != top.sum(dtype=object)):
        last = top.sum(dtype=object)
        top = np.minimum(top, np.where(near, side[None, :], far).min(1))
        side = top.copy() if same else np.minimum(side, np.where(near, top[:, None], far).min(0))
    found = []
    for key, root, count in ((a, top, near @ k),) + (() if same else ((b, side, m @ near),)):
        has = count > 0
        found.append((key[has], count[has], root[has]))
    return found


def linked(found: DataFrame, blocks: DataFrame, threshold: float) -> DataFrame:
    """(id, links, root) of the vectors of cells that meet: copies within the threshold, and the least id of the part that hangs together.

    blocks: (code, part, ids, copies, flat); found: pairs (a, b) of codes.
    Each pair of blocks gives a row for each vector that has a link there.
    """
    side = lambda x: blocks.select(*[F.col(c).alias(f"{x}{c}") for c in ("code", "part", "ids", "copies", "flat")])
    apart = found.join(side("x"), F.col("a") == F.col("xcode")).join(side("y"), F.col("b") == F.col("ycode"))
    within = side("x").join(side("y"), (F.col("xcode") == F.col("ycode")) & (F.col("xpart") <= F.col("ypart"))).where((F.col("xpart") < F.col("ypart")) | (F.size("xids") > 1))
    columns = ["xids", "xcopies", "xflat", "yids", "ycopies", "yflat"]
    both = apart.select(*columns, F.lit(False).alias("same")).unionByName(within.select(*columns, (F.col("xpart") == F.col("ypart")).alias("same")))

    def run(batches):
        for batch in batches:
            one = np.array([len(x) == 1 and len(y) == 1 for x, y in zip(batch.column(0), batch.column(3))], bool)
            ids, links, roots = [], [], []
            if one.any():
                own = batch.filter(pa.array(one))
                a, m, b, k = (own.column(c).flatten().to_numpy() for c in (0, 1, 3, 4))
                good = (_matrix(own.column(2)) * _matrix(own.column(5))).sum(1) >= threshold
                a, m, b, k = a[good], m[good], b[good], k[good]
                ids, links, roots = [a, b], [k, m], [np.minimum(a, b)] * 2
            for r in np.flatnonzero(~one).tolist():
                a, m, x, b, k, y = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in range(6))
                near = x.reshape(len(a), -1) @ y.reshape(len(b), -1).T >= threshold
                same = batch.column(6)[r].as_py()
                if same:
                    np.fill_diagonal(near, False)
                for key, count, root in _joined(near, a, m, b, k, same):
                    ids.append(key)
                    links.append(count)
                    roots.append(root)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in (ids, links, roots)], ["id", "links", "root"])
        release()

    return bounded(both).mapInArrow(run, "id long, links long, root long")


def _tree(sample: np.ndarray, leaves: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Orthonormal axes, and a tree (axis, cut, node below, node above) along them whose leaves name themselves."""
    axes = np.linalg.svd(sample - sample.mean(0), full_matrices=False)[2][:AXES].T
    p = sample @ axes
    nodes, todo = [[0, 0.0, 0, 0]], [(0, np.arange(len(p)), leaves)]
    while todo:
        at, own, parts = todo.pop()
        if parts < 2 or len(own) < 2 * SAMPLE_LEAF:
            continue
        axis = int(p[own].var(0).argmax())
        cut = float(np.median(p[own, axis]))
        below = p[own, axis] <= cut
        if below.all():
            continue  # one value has more than half of them
        nodes[at] = [axis, cut, len(nodes), len(nodes) + 1]
        for part in (own[below], own[~below]):
            todo.append((len(nodes), part, parts // 2))
            nodes.append([0, 0.0, len(nodes), len(nodes)])
    return axes, tuple(np.array(c) for c in zip(*nodes))


def _leaves(p: np.ndarray, tree: tuple[np.ndarray, ...]) -> np.ndarray:
    axis, cut, below, above = tree
    at, last = np.zeros(len(p), np.int64), None
    while last is None or (at != last).any():
        last = at
        at = np.where(p[np.arange(len(p)), axis[at]] <= cut[at], below[at], above[at])
    return at


def tiles(single: DataFrame, n: int, dims: int, scratch: Scratch) -> tuple[DataFrame, np.ndarray]:
    """(tile, low, high, ids, copies, data): vectors that lie together, and the box around them along the axes; and the axes."""
    size = max(1, min(TILE, TILE_BYTES // (8 * dims)))
    few = single.where(F.pmod(F.xxhash64("name"), F.lit(ceil(n / max(1, min(SAMPLE, SAMPLE_CELLS // dims))))) == 0)
    sample = few.select("v").toArrow().column(0)
    if not len(sample):
        sample = single.limit(1).select("v").toArrow().column(0)
    axes, tree = _tree(_matrix(sample), 1 << max(0, ceil(log2(n / size))))

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                leaf = _leaves(_matrix(batch.column(2)) @ axes, tree)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], ["id", "copies", "v", "leaf"])

    def pack(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                x = batch.column(3)[r].values.to_numpy().reshape(-1, dims)
                p = x @ axes
                row = [batch.column(0).slice(r, 1), *(pa.array([z.tolist()]) for z in (p.min(0), p.max(0))), batch.column(1).slice(r, 1), batch.column(2).slice(r, 1), pa.array([x.tobytes()])]
                yield pa.RecordBatch.from_arrays(row, ["tile", "low", "high", "ids", "copies", "data"])
        release()

    placed = scratch.write(bounded(single.select("id", "copies", "v")).mapInArrow(place, "id long, copies long, v array<double>, leaf long"), "leaves")
    parts = placed.groupBy("leaf").agg(F.ceil(F.count("*") / size).alias("parts"))  # fewer rows than the sample
    tile = (F.shiftleft("leaf", 40) + F.pmod(F.xxhash64("v"), F.col("parts"))).alias("tile")
    members = placed.join(F.broadcast(parts), "leaf").select(tile, "id", "copies", "v").groupBy("tile").agg(F.collect_list(F.struct("id", "copies", "v")).alias("m"))  # about `size` vectors
    packed = bounded(members.select("tile", F.col("m.id").alias("ids"), F.col("m.copies").alias("copies"), F.flatten("m.v").alias("flat"))).mapInArrow(pack, "tile long, low array<double>, high array<double>, ids array<long>, copies array<long>, data binary")
    spread = max(single.sparkSession.sparkContext.defaultParallelism, ceil(n * dims * 8 / FILE_BYTES))
    return scratch.write(packed.repartition(spread), "tiles"), axes


def compared(found: DataFrame, axes: np.ndarray, dims: int, threshold: float) -> DataFrame:
    """(id, links, root) of the vectors of tiles, as linked() has them, from all pairs of vectors.

    Each task reads the files it compares from the written table; nothing is shuffled.
    """
    limit = 2 - 2 * threshold + 1e-9  # square of the distance
    unsure = (dims + 8) * 2.0**-24  # bounds what single precision adds to a cosine
    side = lambda x: found.select(*[F.col(c).alias(f"{x}{c}") for c in found.columns])
    gap = F.zip_with(F.zip_with("xlow", "yhigh", lambda s, t: s - t), F.zip_with("ylow", "xhigh", lambda s, t: s - t), lambda s, t: F.greatest(s, t, F.lit(0.0)))
    near = F.aggregate(gap, F.lit(0.0), lambda total, g: total + g * g) <= limit
    both = side("x").hint("shuffle_replicate_nl").join(side("y"), (F.col("xtile") <= F.col("ytile")) & near)

    def inside(x, low, high):
        p = x @ axes
        return np.flatnonzero((np.maximum(np.maximum(low - p, p - high), 0) ** 2).sum(1) <= limit)

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = [c[r] for c in batch.columns]
                xlow, xhigh, a, m, ylow, yhigh, b, k = (row[c].values.to_numpy() for c in (1, 2, 3, 4, 7, 8, 9, 10))
                one, two, x, y = row[0].as_py(), row[6].as_py(), *(np.frombuffer(row[c].as_buffer()).reshape(-1, dims) for c in (5, 11))
                same = one == two
                if not same:
                    i, j = inside(x, ylow, yhigh), inside(y, xlow, xhigh)
                    a, m, x, b, k, y = a[i], m[i], x[i], b[j], k[j], y[j]
                if not len(a) or not len(b):
                    continue
                cosine = x.astype(np.float32) @ y.astype(np.float32).T
                maybe = cosine >= threshold - unsure
                if same:
                    np.fill_diagonal(maybe, False)
                if not maybe.any():
                    continue
                i, j = np.flatnonzero(maybe.any(1)), np.flatnonzero(maybe.any(0))
                if same:
                    i = j = np.union1d(i, j)
                maybe = maybe[np.ix_(i, j)]
                sure = maybe & (cosine[np.ix_(i, j)] >= threshold + unsure)
                s, t = np.nonzero(maybe & ~sure)
                for begin in range(0, len(s), BLOCK):  # bounds what is in memory
                    u, v = s[begin : begin + BLOCK], t[begin : begin + BLOCK]
                    sure[u, v] = (x[i[u]] * y[j[v]]).sum(1) >= threshold
                for own in _joined(sure, a[i], m[i], b[j], k[j], same):
                    if len(own[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in own], ["id", "links", "root"])
        release()

    return bounded(both).mapInArrow(run, "id long, links long, root long")


def _coded(single: DataFrame, n: int, dims: int, threshold: float, radius: int, scratch: Scratch) -> DataFrame:
    """(id, links, root) of the vectors, from those whose codes lie within the radius."""
    mean, projection = learn(single, dims, n)
    bits = projection.shape[1]
    coded = scratch.write(codes(single, mean, projection), "codes")
    sizes = coded.groupBy("code").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    cells = scratch.write(sizes, "cells")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).alias("part")
    members = coded.join(cells, "code").select("code", part, "id", "copies", "v").groupBy("code", "part").agg(F.collect_list(F.struct("id", "copies", "v")).alias("m"))  # about BLOCK vectors
    blocks = scratch.write(members.select("code", "part", F.col("m.id").alias("ids"), F.col("m.copies").alias("copies"), F.flatten("m.v").alias("flat")), "members")
    found = candidates(cells.select("code"), n, bits, reach_of(radius, bits, threshold, short_length(single, mean)), scratch)
    return linked(found, blocks, threshold)


def _classes(table: DataFrame, key: str, column: str, threshold: float, radius: int | None, scratch: Scratch) -> DataFrame:
    """(id, class, size, links) of the rows that have a link; class is the least id of the connected vectors."""
    rows, dims = _vectors(table, key, column, scratch)
    spark = table.sparkSession
    if not dims:
        return spark.createDataFrame([], "id long, class long, size long, links long")
    rows = rows.where(F.size("v") == dims)
    single = scratch.write(rows.groupBy("name").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v")), "different")
    n = single.count()
    if radius is None:
        found = compared(*tiles(single, n, dims, scratch), dims, threshold)
    else:
        found = _coded(single, n, dims, threshold, radius, scratch)
    links = scratch.write(found, "links")
    per = links.groupBy("id").agg(F.sum("links").alias("links"))
    several = rows.groupBy("id").agg(F.min("name").alias("low"), F.max("name").alias("high")).where("low <> high").select("id")  # ids of several vectors
    same = rows.join(several, "id").select(F.col("id").alias("a"), "name").join(single.select("name", F.col("id").alias("b")), "name").select("a", "b")
    label = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(same), scratch)
    own = single.join(per, "id", "left").join(label, F.col("id") == F.col("node"), "left").select("name", F.coalesce("root", "id").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    placed = scratch.write(rows.select("id", "name").join(own, "name").select("id", "class", "links"), "placed")
    return placed.join(placed.groupBy("class").agg(F.count("*").alias("size")), "class").where("links > 0").select("id", "class", "size", "links")


def classes(table: DataFrame, key: str = "vec_id", column: str = "embedding", threshold: float = THRESHOLD, radius: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(vec_id, class_id, n_class, n_links): a row for each row that has a near-duplicate.

    n_links counts all other rows whose vector lies within the threshold, equal
    vectors too; class_id is the least id of the rows that hang together by
    links, n_class their number.  Every row is compared with every other, without
    a limit of partners; given a radius (RADIUS, say), only vectors are compared
    whose codes lie within it, which loses some of the links.  Rows without id or vector, of length 0, with null or infinite
    elements, or of other dimensions than most have no partners.  Equal vectors
    have cosine 1.  Rows that share an id are of one class.  An empty table
    gives no rows.  Other columns are ignored, whatever their names.
    """
    found = _classes(table, key, column, threshold, radius, scratch or Scratch(table.sparkSession))
    return found.select(F.col("id").alias(key), F.col("class").alias("class_id"), F.col("size").alias("n_class"), F.col("links").alias("n_links"))


def keep(table: DataFrame, key: str = "vec_id", column: str = "embedding", threshold: float = THRESHOLD, radius: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """The rows without the near-duplicates: of each class, the rows of the least id stay.  Cases as in classes()."""
    scratch = scratch or Scratch(table.sparkSession)
    found = scratch.write(_classes(table, key, column, threshold, radius, scratch), "near")
    out = found.where(F.col("id") != F.col("class")).select(F.col("id").alias("__segmill_out")).distinct()
    return table.join(out, table[key].cast("long") == F.col("__segmill_out"), "left_anti")
