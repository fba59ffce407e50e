"""Exact nearest neighbours, neighbour graphs and recall."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segmill.errors import SegmentError
from segmill.functions.vector import SIMILARITIES
from segmill.operators.nearest import PLACES, Block, nearest
from segmill.session import cut

#: Vectors of a block, and bytes of them in double precision, at most.
BLOCK_ROWS, QUERY_BYTES = 32_768, 32 << 20
#: Smaller tables are cut into so many blocks, but for blocks of so many rows.
SPREAD, SPREAD_ROWS = 8, 4096
#: Differences of vectors that are held at once.
DIFFERENCES = 1 << 20
#: Queries whose best are put together at once, and partitions of them.
MERGED_ROWS, MERGES = 2048, 2048


def matrix(column: pa.Array) -> np.ndarray:
    return _matrix(column).astype(np.float64)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def similarities(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Queries by vectors.  Distances are summed from differences, which loses no digits to cancellation."""
    if metric == "euclidean":
        out, step = np.empty((len(q), len(x))), max(1, DIFFERENCES // max(1, x.size))
        for i in range(0, len(q), step):
            d = x[None, :, :] - q[i : i + step, None, :]
            out[i : i + step] = -np.einsum("qij,qij->qi", d, d)
        return out
    s = q @ x.T
    if metric == "cosine":
        n = np.sqrt(np.einsum("ij,ij->i", x, x))
        s /= np.where(n == 0, 1.0, n)
    return s


def _checked(metric: str, k: int) -> None:
    if metric not in SIMILARITIES:
        raise SegmentError(f"unknown similarity {metric!r}")
    if k < 1:
        raise SegmentError("k must be at least 1")


def _typed(frame: DataFrame, name: str, column: str) -> DataFrame:
    """(id, v, extra): singles stay singles."""
    kind = frame.schema[column].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    return frame.where(F.col(column).isNotNull()).select(F.col(name).cast("long").alias("id"), F.col(column).cast("array<float>" if single else "array<double>").alias("v"), F.lit(0.0).alias("extra"))


def _alike(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with doubles, where one has."""
    if left.schema["v"].dataType == right.schema["v"].dataType:
        return left, right
    return tuple(x.withColumn("v", F.col("v").cast("array<double>")) for x in (left, right))


def _blocks(n: int, dims: int, rows: int | None = None) -> int:
    """How many blocks n vectors are cut into."""
    most = max(1, min(rows or BLOCK_ROWS, QUERY_BYTES // (8 * max(1, dims))))
    return max(1, -(-n // most), 1 if rows else min(SPREAD, n // SPREAD_ROWS))


def _blocked(rows: DataFrame, blocks: int) -> DataFrame:
    return rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))


def _met(a: DataFrame, n: int, ga: int, b: DataFrame | None, gb: int, metric: str, k: int, no_self: bool, centres: np.ndarray | None = None) -> DataFrame:
    """(qid, rank, id, score): the k best of b for the n queries a, rows (id, v, extra, b) in ga and gb blocks.

    Each block of queries meets each block of vectors in one task, which holds
    these two.  Without b all rows of a are queries and vectors; then each two
    blocks meet once, and one product serves both.  What comes out of a task is
    k rows a query at most, packed for groups of queries, and meets by group.
    """
    other = F.explode(F.sequence(F.lit(0), F.lit((gb if b is not None else ga) - 1))).alias("o")
    if b is None:
        low, high = F.least("b", "o"), F.greatest("b", "o")
        pairs = ga * (ga + 1) // 2
        rows = a.select("id", "v", "extra", "b", other).select("id", "v", "extra", "b", F.expr("b > o").cast("int").alias("side"), ((high * (high + 1) / 2).cast("int") + low).alias("pair"))
    else:
        pairs = ga * gb
        mine = a.select("id", "v", "extra", "b", other).select("id", "v", "extra", "b", F.lit(0).alias("side"), (F.col("b") * gb + F.col("o")).alias("pair"))
        every = F.explode(F.sequence(F.lit(0), F.lit(ga - 1))).alias("o")
        rows = mine.unionByName(b.select("id", "v", "extra", "b", every).select("id", "v", "extra", "b", F.lit(1).alias("side"), (F.col("o") * gb + F.col("b")).alias("pair")))
    alone = b is None
    tasks, slots = min(pairs, 1 << 14), max(1, -(-n // (ga * MERGED_ROWS)))
    rows = rows.repartitionById(tasks, F.pmod("pair", F.lit(tasks))).sortWithinPartitions("pair", "side")

    def compare(batches):
        for parts in _of_pairs(batches):
            sides = {side: (block, Block(ids, x, extra, metric)) for side, (block, ids, x, extra) in parts.items()}
            if alone and len(sides) == 1:
                (block, own), = sides.values()
                yield from _packed(block * slots, slots, own, nearest(own, own, metric, k, no_self)[0])
            elif len(sides) == 2:
                (x, own), (y, others) = sides[0], sides[1]
                mine, theirs = nearest(own, others, metric, k, no_self, alone, centres)
                yield from _packed(x * slots, slots, own, mine)
                if alone:
                    yield from _packed(y * slots, slots, others, theirs)

    def merge(batches):
        held, n, whole = [], 0, 1 << 20
        for batch in batches:
            for r in range(batch.num_rows):
                held.append(tuple(np.frombuffer(batch.column(i)[r].as_buffer(), t) for i, t in enumerate((np.int64, np.int64, np.float64), 1)))
                n += len(held[-1][0])
                if n > 2 * whole:
                    held = [_ranked(held, k)[:3]]
                    n = len(held[0][0])
                    whole = max(whole, n)
        if held:
            qids, ids, scores, ranks = _ranked(held, k)
            for i in range(0, len(qids), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)]) for c in (qids, ranks, ids, scores)], ["qid", "rank", "id", "score"])

    found = rows.mapInArrow(compare, "slot int, qids binary, ids binary, scores binary")
    merges = min(MERGES, ga * slots)
    return found.repartitionById(merges, F.pmod("slot", F.lit(merges))).mapInArrow(merge, "qid long, rank long, id long, score double")


def _of_pairs(batches):
    """{side: (block, ids, vectors, extra)} of each pair, from rows sorted by pair and side."""
    held, now = {}, None
    for batch in batches:
        if not batch.num_rows:
            continue
        pair, side = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("pair", "side"))
        key = pair.astype(np.int64) * 2 + side
        edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for i, end in zip(edges, edges[1:]):
            if now is not None and pair[i] != now:
                yield {s: (p[0][0], *(np.concatenate(c) for c in list(zip(*p))[1:])) for s, p in held.items()}
                held = {}
            now, part = pair[i], batch.slice(i, end - i)
            ids, v, extra, block = (part.column(part.schema.get_field_index(n)) for n in ("id", "v", "extra", "b"))
            held.setdefault(int(side[i]), []).append((block[0].as_py(), ids.to_numpy(), _matrix(v), extra.to_numpy()))
    if held:
        yield {s: (p[0][0], *(np.concatenate(c) for c in list(zip(*p))[1:])) for s, p in held.items()}


def _packed(first: int, slots: int, queries: Block, found):
    """The best of the queries of a block in so many groups, which are the same in every task."""
    places, ids, scores = found
    qids = queries.ids[places]
    group = ((qids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(slots)
    order = np.argsort(group, kind="stable")
    edges = np.searchsorted(group[order], np.arange(slots + 1, dtype=np.uint64))
    for g in range(slots):
        if (at := order[edges[g] : edges[g + 1]]).size:
            yield pa.RecordBatch.from_arrays([pa.array([first + g], pa.int32()), *(pa.array([np.ascontiguousarray(c[at]).tobytes()], pa.binary()) for c in (qids, ids, scores))], ["slot", "qids", "ids", "scores"])


def _ranked(held, k: int):
    qids, ids, scores = (np.concatenate(c) for c in zip(*held))
    order = np.lexsort((ids, -scores, qids))
    qids = qids[order]
    at = np.arange(len(qids))
    first = np.ones(len(qids), bool)
    first[1:] = qids[1:] != qids[:-1]
    rank = at - np.maximum.accumulate(np.where(first, at, 0))
    kept = rank < k
    order = order[kept]
    return qids[kept], ids[order], scores[order], rank[kept].astype(np.int64) + 1


def _none(vectors: DataFrame) -> DataFrame:
    return vectors.sparkSession.createDataFrame([], "qid long, rank long, id long, score double")


def knn(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "euclidean", key: str = "vec_id", column: str = "embedding", no_self: bool = False) -> DataFrame:
    """(qid, rank, id, score): the k nearest vectors of each query (qid, embedding); ties go to the lesser id.

    Each block of queries meets each block of vectors in a task of its own,
    which gives k rows a query.  Rows without a vector, with a component that
    isn't a finite number, and vectors of other lengths than the query's, aren't
    neighbours.  no_self leaves out the vector of the query's id.
    """
    _checked(metric, k)
    asked = _typed(queries, "qid", column)
    size = asked.agg(F.count("*").alias("c"), F.min(F.size("v")).alias("d"), F.max(F.size("v")).alias("e")).first()
    if not size["c"]:
        return _none(vectors)
    if size["d"] != size["e"]:
        raise SegmentError("queries have vectors of different lengths")
    asked, own = _alike(asked, _typed(vectors, key, column).where(F.size("v") == size["d"]))
    ga, gb = _blocks(size["c"], size["d"]), _blocks(own.count(), size["d"])
    return _met(_blocked(asked, ga), size["c"], ga, _blocked(own, gb), gb, metric, k, no_self)


def knn_graph(vectors: DataFrame, degree: int = 32, metric: str = "euclidean", key: str = "vec_id", column: str = "embedding", block_rows: int | None = None) -> DataFrame:
    """(node, rank, neighbor, score): the nearest others of every vector, ties to the lesser id.

    Vectors are cut into blocks, each two of which meet in one task of bounded
    memory and are multiplied once for both.  All pairs are compared, so this is
    for exact graphs; the work is the square of the rows.
    """
    _checked(metric, degree)
    own = _typed(vectors, key, column)
    size = own.agg(F.count("*").alias("c"), F.min(F.size("v")).alias("d"), F.max(F.size("v")).alias("e")).first()
    if size["d"] != size["e"]:
        raise SegmentError("vectors have different lengths")
    blocks = _blocks(size["c"], size["d"] or 0, block_rows)
    return _met(_blocked(own, blocks), size["c"], blocks, None, blocks, metric, degree, True).select(F.col("qid").alias("node"), "rank", F.col("id").alias("neighbor"), "score")


def navigable_graph(graph: DataFrame, n: int, cap: int) -> DataFrame:
    """(node, pos, neighbor) for ids 0 to n - 1: a kNN graph made connected for greedy search.

    Each node has its successor and predecessor on the ring of ids, then its
    nearest out-edges, then the nodes that have it as a neighbour, by id; of a
    repeated neighbour the first place counts, and cap edges are kept.
    """
    graph, node = cut(graph, "graph"), F.col("node")  # read for both ways of its edges
    ids = graph.sparkSession.range(n).select(F.col("id").alias("node"))
    ring = ids.select("node", F.explode(F.array(F.struct(F.lit(0).alias("class"), F.lit(0).cast("long").alias("order"), ((node + 1) % n).alias("neighbor")), F.struct(F.lit(1).alias("class"), F.lit(0).cast("long").alias("order"), ((node + n - 1) % n).alias("neighbor")))).alias("e")).select("node", "e.*")
    out = graph.where((F.col("neighbor") >= 0) & (F.col("neighbor") < n)).select("node", F.lit(2).alias("class"), F.col("rank").alias("order"), "neighbor")
    back = out.select(F.col("neighbor").alias("node"), F.lit(3).alias("class"), F.col("node").alias("order"), F.col("node").alias("neighbor"))
    edges = ring.unionByName(out).unionByName(back).where("node <> neighbor")
    first = edges.groupBy("node", "neighbor").agg(F.min(F.struct("class", "order")).alias("at"))
    w = Window.partitionBy("node").orderBy("at.class", "at.order", "neighbor")
    return first.withColumn("pos", F.row_number().over(w).cast("long")).where(F.col("pos") <= cap).select("node", "pos", "neighbor")


def small_world(graph: DataFrame, n: int, cap: int) -> DataFrame:
    """(node, pos, neighbor) for ids 0 to n - 1: nearest edges, some far ones, and their reverse.

    max(cap / 4, 2) far edges a node come from its own xorshift sequence, so
    every run makes the same graph.
    """
    graph, far = cut(graph, "graph"), max(cap // 4, 2)  # read for both ways of its edges

    def draw(batches):
        for batch in batches:
            node = batch.column(0).to_numpy().astype(np.uint64)
            state = node * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
            for i in range(far):
                state ^= state << np.uint64(13)
                state ^= state >> np.uint64(7)
                state ^= state << np.uint64(17)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(node), i, np.int64)), pa.array((state % np.uint64(n)).astype(np.int64))], ["node", "order", "neighbor"])

    drawn = graph.sparkSession.range(n).mapInArrow(draw, "node long, order long, neighbor long").select("node", F.lit(1).alias("class"), "order", "neighbor")
    own = graph.where(F.col("rank") <= max(0, cap - far)).select("node", F.lit(0).alias("class"), F.col("rank").alias("order"), "neighbor").unionByName(drawn)
    back = own.where((F.col("neighbor") < n) & (F.col("node") != F.col("neighbor"))).select(F.col("neighbor").alias("node"), F.lit(2).alias("class"), F.col("node").alias("order"), F.col("node").alias("neighbor"))
    edges = own.unionByName(back).where((F.col("node") != F.col("neighbor")) & (F.col("neighbor") < n))
    first = edges.groupBy("node", "neighbor").agg(F.min(F.struct("class", "order")).alias("at"))
    w = Window.partitionBy("node").orderBy("at.class", "at.order", "neighbor")
    return first.withColumn("pos", F.row_number().over(w).cast("long")).where(F.col("pos") <= cap).select("node", "pos", "neighbor")


def node_level(key, m: int, most: int = 8):
    """The level up to which a node stands: geometric with ratio 1 / m, from a hash of its id."""
    u = (F.conv(F.substring(F.md5(key.cast("string")), 1, 12), 16, 10).cast("double") + 1.0) / float(1 << 48)
    return F.least(F.floor(-F.log(u) / F.log(F.lit(float(m)))), F.lit(most)).cast("long")


def layered_graph(vectors: DataFrame, m: int = 16, metric: str = "euclidean", key: str = "vec_id", column: str = "embedding", most: int = 8) -> DataFrame:
    """(level, node, rank, neighbor, score): a hierarchy for search from above.

    Level 0 has all nodes with their 2 m nearest; each level above has a share
    1 / m of the one below, with the m nearest among themselves.
    """
    if m < 2:
        raise SegmentError("m must be at least 2")
    placed = vectors.where(F.col(column).isNotNull()).withColumn("__level", node_level(F.col(key), m, most))
    top = placed.agg(F.max("__level")).first()[0]
    out = None
    for level in range((top if top is not None else 0) + 1):
        own = knn_graph(placed.where(F.col("__level") >= level), 2 * m if level == 0 else m, metric, key, column)
        own = own.select(F.lit(level).cast("long").alias("level"), "node", "rank", "neighbor", "score")
        out = own if out is None else out.unionByName(own)
    return out


#: Vectors from which cells are learnt, and queries by which the number of cells to look at is measured, at most.
LEARN_ROWS, TRIED = 20_000, 200
#: Share of the exact neighbours of those queries that the cells looked at must hold.
COVERED = 0.95
#: Distances to cells that are held at once.
DISTANCES = 1 << 21


def _some(rows: DataFrame, n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """About ``most`` of n rows (id, v), those of the least hashes, on the driver."""
    share = min(1.0, most / max(1, n))
    table = rows.where(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)) < int(share * (1 << 30))).toArrow()
    if not table.num_rows:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    ids, x = table["id"].to_numpy(), matrix(table["v"].combine_chunks())
    good = np.isfinite(x).all(1)
    return ids[good], x[good]


def centroids(x: np.ndarray, cells: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Cells of a bounded sample by Lloyd's rounds; an empty cell keeps its place."""
    c = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        own = _order(x, c, 1)[:, 0]
        sums, n = np.zeros_like(c), np.bincount(own, minlength=len(c))
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _order(x: np.ndarray, c: np.ndarray, probes: int) -> np.ndarray:
    """The nearest cells of each vector, from the nearest on."""
    if len(x) * len(c) > DISTANCES and len(x) > 1:
        step = max(1, DISTANCES // len(c))
        return np.concatenate([_order(x[i : i + step], c, probes) for i in range(0, len(x), step)])
    d = _distances(x, c)
    if probes < d.shape[1]:
        near = np.argpartition(d, probes - 1, axis=1)[:, :probes]
        return np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)
    return np.argsort(d, axis=1, kind="stable")


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances to cells, without the square of the vector."""
    return (c * c).sum(1)[None, :] - 2 * x @ c.T


def _celled(rows: DataFrame, c: np.ndarray, sample: np.ndarray, blocks: int) -> DataFrame:
    """Vectors with their cell in extra and a block, which has neighbouring numbers of cells, by the cells' shares of a sample; a great cell has several."""
    share = np.bincount(_order(sample, c, 1)[:, 0], minlength=len(c)) / max(1, len(sample)) * blocks
    ends = np.cumsum(share)
    first = np.minimum(ends - share, blocks - 1).astype(np.int64)
    several = np.maximum(1, np.minimum(np.ceil(ends), blocks).astype(np.int64) - first) * (share > 1) + (share <= 1)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cell = _order(matrix(batch.column(1)), c, 1)[:, 0]
                part = batch.column(3).to_numpy() % several[cell]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.float64)), pa.array((first[cell] + part).astype(np.int32))], ["id", "v", "extra", "b"])

    marked = rows.select("id", "v", "extra", F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("h"))
    return marked.mapInArrow(run, T.StructType([*rows.schema.fields[:2], T.StructField("extra", T.DoubleType()), T.StructField("b", T.IntegerType())]))


def _reaching(rows: DataFrame, c: np.ndarray, probes: int) -> DataFrame:
    """Queries with the distance of the last cell that they look at in extra."""

    def run(batches):
        for batch in batches:
            step = max(1, DISTANCES // len(c))
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                d = _distances(matrix(part.column(1)), c)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.partition(d, probes - 1, axis=1)[:, probes - 1])], ["id", "v", "extra"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:2], T.StructField("extra", T.DoubleType())]))


def approximate(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "euclidean", key: str = "vec_id", column: str = "embedding", cells: int | None = None, probes: int | None = None, no_self: bool = False) -> DataFrame:
    """(qid, rank, id, score): the nearest vectors among those of the cells that lie closest to the query.

    Cells are learnt from LEARN_ROWS vectors; every vector is in the nearest.
    How many cells a query looks at is measured: for TRIED queries, whose exact
    neighbours are searched for, so many that COVERED of the neighbours lie in
    them.  Blocks meet as in knn(), and in them a query meets the cells that it
    looks at.  Ties and odd vectors as in knn().
    """
    _checked(metric, k)
    first = queries.where(F.col(column).isNotNull()).select(F.size(column)).first()
    if first is None:
        return _none(vectors)
    own, asked = _alike(*(_typed(x, name, column).where(F.size("v") == first[0]) for x, name in ((vectors, key), (queries, "qid"))))
    n, m = own.count(), asked.count()
    _, sample = _some(own, n, LEARN_ROWS)
    if not len(sample):
        return _none(vectors)
    c = centroids(sample, cells or max(1, round(n**0.5)))
    if probes is None:
        probes = _enough(vectors, own, asked, m, c, k, metric, key, column, no_self)
    ga, gb = _blocks(m, first[0]), _blocks(n, first[0])
    return _met(_blocked(_reaching(asked, c, min(probes, len(c))), ga), m, ga, _celled(own, c, sample, gb), gb, metric, k, no_self, c)


def _enough(vectors: DataFrame, own: DataFrame, asked: DataFrame, n: int, c: np.ndarray, k: int, metric: str, key: str, column: str, no_self: bool) -> int:
    """The number of cells that hold COVERED of the exact neighbours of some queries."""
    qids, q = _some(asked, n, TRIED)
    if not len(qids):
        return len(c)
    tried = asked.sparkSession.createDataFrame([(int(i), v.tolist()) for i, v in zip(qids, q)], f"qid long, `{column}` array<double>")
    exact = knn(vectors, tried, k, metric, key, column, no_self).select("qid", "id")  # TRIED times k rows
    table = exact.join(own, "id").select("qid", "v").toArrow()
    if not table.num_rows:
        return 1
    at = dict(zip(qids.tolist(), np.argsort(_order(q, c, len(c)), axis=1)))  # the rank of each cell for each query
    cell = _order(matrix(table["v"].combine_chunks()), c, 1)[:, 0]
    ranks = np.sort([at[i][x] for i, x in zip(table["qid"].to_pylist(), cell.tolist())])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(COVERED * len(ranks))) - 1)]) + 1


def approximate_graph(vectors: DataFrame, degree: int = 32, metric: str = "euclidean", key: str = "vec_id", column: str = "embedding", **how) -> DataFrame:
    """(node, rank, neighbor, score) as knn_graph(), from approximate(): the work of a vector grows with its cells, not with all vectors."""
    every = vectors.select(F.col(key).alias("qid"), column)
    found = approximate(vectors, every, degree, metric, key, column, no_self=True, **how)
    return found.select(F.col("qid").alias("node"), "rank", F.col("id").alias("neighbor"), "score")


def recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """One row: the share of the exact k best of all queries that was found."""
    exact = cut(exact.select("qid", "id"), "exact")  # read for the hits and for their number
    hits = exact.join(found.select("qid", "id").distinct(), ["qid", "id"], "left_semi").agg(F.count("*").alias("hits"))
    total = exact.agg((F.countDistinct("qid") * k).alias("total"))
    return hits.crossJoin(total).select((F.col("hits") / F.col("total")).alias("recall"))
