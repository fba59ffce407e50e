"""Token ids in a content-addressed store.

A document's id stream is cut where a rolling hash of the last ids says so, and
therefore alike wherever the same run of ids stands.  A chunk is named by the
SHA-256 of its bytes and stored once; a document's recipe lists its chunks and
the root of their Merkle tree.  Recipes are summed up in a manifest: a node
hashes the up to 4096 children whose ids share a prefix, up to one root.

One table holds all of it, by ``kind``:

=======  ======  ======================  ==============================  =====================
kind     doc_id  name                    parts                           data
=======  ======  ======================  ==============================  =====================
chunk    null    hash of the bytes       empty                           ids, little-endian
recipe   its id  Merkle root of parts    names of its chunks             null
node     null    hash of the parts       "id:root" or "prefix:name"      null
=======  ======  ======================  ==============================  =====================
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.llm import textscan, tokens
from segmill.llm.common import Scratch, id_or_null, list_array, mapped, row_id

#: Ids that the rolling hash looks at.
WINDOW = 16
#: Least, mean and greatest ids of a chunk; the last chunk of a document may be shorter.
LEAST, MEAN, MOST = 64, 256, 1024
#: Bits of the document id that one level of the manifest takes.
FANOUT_BITS = 12
LEVELS = -(-64 // FANOUT_BITS)

STORE = "kind string, doc_id long, level int, prefix long, name string, n_tokens long, parts array<string>, data binary"


def id_width(path: str = tokens.DEFAULT_FILE) -> int:
    return 2 if max(tokens.ranks(path).values()) < 1 << 16 else 4


def chunk_ends(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all chunks, and where each document's begin in that list."""
    codes = textscan.mix(ids.astype(np.uint64) + np.uint64(1))
    rolled = textscan.long_windows(codes, WINDOW)
    marks = np.flatnonzero(rolled % np.uint64(MEAN - LEAST) == 0) + WINDOW  # a chunk may end before these
    ends, per = [], [0]
    spans = np.searchsorted(marks, offsets)
    for d in range(len(offsets) - 1):
        begin, stop = int(offsets[d]), int(offsets[d + 1])
        if begin < stop:
            for m in marks[spans[d] : spans[d + 1]].tolist():
                if m - WINDOW < int(offsets[d]):
                    continue  # its window begins in the document before
                while m - begin > MOST:
                    begin += MOST
                    ends.append(begin)
                if m - begin >= LEAST:
                    begin = m
                    ends.append(m)
            while stop - begin > MOST:
                begin += MOST
                ends.append(begin)
            if stop > begin:
                ends.append(stop)
        per.append(len(ends))
    return np.array(ends, np.int64), np.array(per, np.int64)


def merkle(names: list[bytes]) -> bytes:
    """Root of the binary Merkle tree; an odd node moves up as it is.  No leaves: the hash of nothing."""
    if not names:
        return hashlib.sha256(b"").digest()
    level = [hashlib.sha256(b"\x00" + x).digest() for x in names]
    while len(level) > 1:
        level = [hashlib.sha256(b"\x01" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _encoded(docs: DataFrame, path: str) -> DataFrame:
    width = id_width(path)
    kind = np.dtype(f"<u{width}")

    def piece(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, offsets = tokens.encode(batch.column(1), path)
        ends, per = chunk_ends(ids, offsets)
        data = ids.astype(kind).tobytes()
        bounds = np.append(0, ends) * width
        digests = [hashlib.sha256(data[a:b]).digest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        roots = [merkle(digests[a:b]).hex() for a, b in zip(per[:-1].tolist(), per[1:].tolist())]
        at = pa.array(per.astype(np.int32))
        chunks = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])
        names = pa.array([x.hex() for x in digests], pa.string())
        sizes = np.diff(np.append(0, ends)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(roots, pa.string()), pa.ListArray.from_arrays(at, names), list_array(sizes, per, pa.int32()), pa.ListArray.from_arrays(at, chunks)],
            ["__id", "n_tokens", "root", "names", "sizes", "chunks"],
        )

    own = docs.select(row_id(docs).alias("__id"), docs["text"].cast("string").alias("text"))
    return mapped(own, "__id long, n_tokens long, root string, names array<string>, sizes array<int>, chunks array<binary>", piece, limit=tokens.BATCH_BYTES)


def manifest(recipes: DataFrame) -> DataFrame:
    """Nodes over (__id, root, n_tokens), level 1 the lowest; the last level has one node."""
    below = recipes.select("__id", F.col("root").alias("name"), "n_tokens")
    nodes = None
    for level in range(1, LEVELS + 1):
        prefix = F.shiftright("__id", FANOUT_BITS) if level < LEVELS else F.lit(0).cast("long")
        parts = F.transform(F.sort_array(F.collect_list(F.struct("__id", "name"))), lambda x: F.concat_ws(":", x["__id"], x["name"]))
        below = below.groupBy(prefix.alias("__p")).agg(parts.alias("parts"), F.sum("n_tokens").alias("n_tokens")).select(F.col("__p").alias("__id"), F.sha2(F.concat_ws("\n", "parts"), 256).alias("name"), "n_tokens", "parts")
        own = below.select(F.lit("node").alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(level).alias("level"), F.col("__id").alias("prefix"), "name", "n_tokens", "parts", F.lit(None).cast("binary").alias("data"))
        nodes = own if nodes is None else nodes.unionByName(own)
        below = below.drop("parts")
    return nodes


def store(docs: DataFrame, path: str = tokens.DEFAULT_FILE, scratch: Scratch | None = None) -> DataFrame:
    """Chunks, recipes and manifest nodes of all rows, as STORE.

    Null and empty texts have a recipe without chunks.  Repeated rows have a
    recipe each and share their chunks.  A row without doc_id has a null one in
    its recipe, and in the manifest an id below -1 made from its text.  An empty
    table gives no rows.  Other columns are ignored, whatever their names.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    encoded = scratch.write(_encoded(docs, path), "encoded")
    null = lambda kind: F.lit(None).cast(kind)
    zipped = F.explode(F.arrays_zip("names", "sizes", "chunks")).alias("c")
    once = encoded.select(zipped).groupBy(F.col("c.names").alias("name")).agg(F.first("c.sizes").alias("n"), F.first("c.chunks").alias("data"))
    chunks = once.select(F.lit("chunk").alias("kind"), null("long").alias("doc_id"), null("int").alias("level"), null("long").alias("prefix"), "name", F.col("n").cast("long").alias("n_tokens"), F.array().cast("array<string>").alias("parts"), "data")
    recipes = encoded.select(F.lit("recipe").alias("kind"), id_or_null("__id"), F.lit(0).alias("level"), F.col("__id").alias("prefix"), F.col("root").alias("name"), "n_tokens", F.col("names").alias("parts"), null("binary").alias("data"))
    return chunks.unionByName(recipes).unionByName(manifest(encoded.select("__id", "root", "n_tokens")))


def restored(stored: DataFrame, width: int = 2) -> DataFrame:
    """(prefix, name, ids, intact) of each recipe, from its chunks.

    ``prefix`` is the row's id and ``name`` its root.  intact: every chunk is
    there, has the hash that names it, and the chunks' names give the root.
    Recipes that are equal give one row.
    """
    recipes = stored.where("kind = 'recipe'").select("prefix", "name", "parts").dropDuplicates(["prefix", "name"])
    chunks = stored.where("kind = 'chunk'").select(F.col("name").alias("part"), "data")
    each = recipes.select("prefix", "name", F.posexplode_outer("parts").alias("pos", "part")).join(chunks, "part", "left")
    whole = each.groupBy("prefix", "name").agg(F.sort_array(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("pos", "part", "data")))).alias("c"))
    kind = np.dtype(f"<u{width}")

    def run(batches):
        for batch in batches:
            ids, fine = [], []
            for name, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                parts = [bytes.fromhex(x["part"]) for x in c]
                ids.append(np.frombuffer(b"".join(x["data"] or b"" for x in c), kind).astype(np.int32))
                fine.append(merkle(parts).hex() == name and all(x["data"] is not None and hashlib.sha256(x["data"]).digest() == p for x, p in zip(c, parts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array(fine, pa.bool_())], ["prefix", "name", "ids", "intact"])

    return whole.mapInArrow(run, "prefix long, name string, ids array<int>, intact boolean")


def broken_nodes(stored: DataFrame) -> DataFrame:
    """Manifest nodes whose name isn't the hash of their parts, or whose parts aren't what lies below."""
    nodes = stored.where("kind in ('node', 'recipe')").select("kind", "level", "prefix", "name", "parts")
    up = F.when(F.col("level") + 1 < LEVELS, F.shiftright("prefix", FANOUT_BITS)).otherwise(F.lit(0).cast("long"))
    below = nodes.where(F.col("level") < LEVELS).select((F.col("level") + 1).alias("level"), up.alias("prefix"), F.struct("prefix", "name").alias("x")).groupBy("level", "prefix").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: F.concat_ws(":", x["prefix"], x["name"])).alias("below"))
    joined = nodes.where("kind = 'node'").join(below, ["level", "prefix"], "full")
    return joined.where(~F.coalesce((F.col("below") == F.col("parts")) & (F.sha2(F.concat_ws("\n", "parts"), 256) == F.col("name")), F.lit(False)))
