"""What the operators share: reading tables, tables cut from their lineage, and Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def has_table(spark: SparkSession, sf_dir: str, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a folder of our own on one machine and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = context.get() if context.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="segmill-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Seconds between two calls of the collector of the driver's memory.
FREE_SECONDS = 20


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive executors.

    ``drop`` removes a table once what was made from it is itself written; what
    is left goes when the session's process ends.
    """

    freed = 0.0

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/segmill-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        self.count = 0
        atexit.register(self.close)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = self.paths[name] = f"{self.base}/{name}-{self.count}"
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # shuffle files go as soon as the table is there
        old = self.spark.conf.get(key, "false")
        self.spark.conf.set(key, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(key, old)
        self.free()
        return self.spark.read.schema(df.schema).parquet(path)

    def free(self) -> None:
        """Has Spark's cleaner drop what the driver has let go of, once in a while; shuffle files of a write go by themselves."""
        if time.monotonic() - Scratch.freed > FREE_SECONDS:
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            Scratch.freed = time.monotonic()

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.paths.pop(name))

    def close(self) -> None:
        try:
            self._delete(self.base)
        except Exception:  # the session has ended; its folder goes with it
            return

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes of an Arrow batch that a task holds; Spark's own bound is eight times that.
ARROW_BYTES = 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """The frame, in a session whose Arrow batches have ARROW_BYTES at most (a row that is longer is a batch).

    Plans read the setting when they run, so it stays.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(str(conf.get(key)).rstrip("b") or 0) <= ARROW_BYTES:
        conf.set(key, f"{ARROW_BYTES}b")
    return df


def release() -> None:
    """Gives what a task's arrays took back to the system; the worker lives on for other tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def mapped(df: DataFrame, schema: str, piece: Callable[[pa.RecordBatch], pa.RecordBatch | list[pa.RecordBatch] | None], text: str = "text", limit: int | None = None) -> DataFrame:
    """mapInArrow over pieces of bounded text size; a text longer than the bound is a piece by itself."""
    from segmill.llm import textscan

    bound = limit or textscan.PIECE_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, offsets = textscan.raw(batch.column(batch.schema.names.index(text)))
            for i, j in textscan.pieces(offsets, bound):
                out = piece(batch.slice(i, j - i))
                if out is not None:
                    yield from out if isinstance(out, list) else [out]
        release()

    return bounded(df).mapInArrow(run, schema)


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.asarray(offsets, np.int32)), pa.array(values, kind))


#: Rows without a doc_id get a number below this one; doc_ids themselves are not less.
LEAST_ID = -(1 << 62)


def row_id(docs: DataFrame):
    """The doc_id, or for a row without one a number below LEAST_ID made from its text.

    Rows that share an id, or that lack one and share a text, stand and fall
    together.  Any id from LEAST_ID on is carried as it is, negative ones too;
    a lesser one fails the job.
    """
    key = docs["doc_id"].cast("long")
    made = F.shiftrightunsigned(F.xxhash64(docs["text"].cast("string")), 2) + F.lit(-(1 << 63)).cast("long")
    return F.when(key.isNull(), made).when(key >= LEAST_ID, key).otherwise(F.raise_error(F.lit("a doc_id is less than -2**62")).cast("long"))


def id_or_null(name: str, alias: str = "doc_id"):
    return F.when(F.col(name) >= LEAST_ID, F.col(name)).alias(alias)


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose row_id isn't in the column __id of ids."""
    out = ids.select(F.col("__id").alias("__segmill_out")).distinct()
    return docs.join(out, row_id(docs) == F.col("__segmill_out"), "left_anti")


#: Bytes of a written table up to which it is broadcast; they are summed first.  Beyond, the join shuffles.
BROADCAST_BYTES = 32 << 20


def lookup(docs: DataFrame, small: DataFrame, how: str, size=None) -> DataFrame:
    """Joins a written table by __id; size: bytes of a row besides its id."""
    total = small.agg(F.sum(F.lit(16) + (size if size is not None else F.lit(0)))).first()[0] or 0
    return docs.join(F.broadcast(small) if total <= BROADCAST_BYTES else small, "__id", how)


def of_ids(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of docs whose __id is in ids, a written table."""
    return lookup(docs, ids, how)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of the nodes of edges (a, b); root is the least node of the component.

    Large-star and small-star rounds: each links neighbours to the least one
    around, until nothing changes; the rounds grow with the logarithm of the
    nodes.  The least neighbour is a partial aggregate that is joined back, so
    a node of very many links is no task of its own.  Every round is written,
    and the one before it removed.
    """
    edges = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen, turn = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))))
        small = large.join(low, "u").select(pairs.alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        old = "links" if turn == 0 else f"links{turn}"
        turn += 1
        edges = scratch.write(small, f"links{turn}")
        scratch.drop(old)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = state
