"""Vectors and graphs from files of other engines, read as binary files by the executors.

Two layouts are known.  *Inline graph files* are big-endian: a header of
HEADER_BYTES with the dimensions, the degree and the upper bound of node ids,
then for each node its id, vector, number of edges and edges.  A negative id is
a hole.  *Saved hierarchies* are little-endian: a header of 96 bytes, a record
for each element with its links, vector and label, then the links of the upper
levels.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from segmill.errors import SegmentError

GRAPH_LEVELS = "path string, level int, node long, neighbors array<long>"


def _each(spark: SparkSession, path: str, schema: str, parse) -> DataFrame:
    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                yield from parse(name.as_py(), content.as_py())

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def inline_vectors(spark: SparkSession, path: str, header_bytes: int, magic: int | None = None) -> DataFrame:
    """(path, ord, vector): the vectors of inline graph files in order, holes left out and ords dense.

    One file is one task's work.
    """

    def parse(name: str, b: bytes):
        if len(b) < max(28, header_bytes):
            raise SegmentError(f"{name} is cut short")
        words = np.frombuffer(b, ">i4", 7)
        if magic is not None and words[0] != magic:
            raise SegmentError(f"{name} isn't a graph file")
        dims, degree, count = int(words[3]), int(words[5]), int(words[6])
        record = np.dtype([("id", ">i4"), ("v", ">f4", (dims,)), ("n", ">i4"), ("edges", ">i4", (degree,))])
        if header_bytes + count * record.itemsize > len(b):
            raise SegmentError(f"{name} is cut short")
        found = np.frombuffer(b, record, count, header_bytes)
        v = found["v"][found["id"] >= 0].astype(np.float32)
        for i in range(0, len(v), 4096):
            part = v[i : i + 4096]
            at = pa.array(np.arange(0, part.size + 1, max(1, dims), dtype=np.int32)[: len(part) + 1])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(i, i + len(part))), pa.ListArray.from_arrays(at, pa.array(part.ravel()))], ["path", "ord", "vector"])

    return _each(spark, path, "path string, ord long, vector array<float>", parse)


def hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """(path, level, node, neighbors) of saved hierarchies; nodes are named by their labels."""

    def parse(name: str, b: bytes):
        if len(b) < 96:
            raise SegmentError(f"{name} is cut short")
        count, size, label_at = struct.unpack_from("<QQQ", b, 16)
        most, most0 = struct.unpack_from("<QQ", b, 56)
        if 96 + count * size > len(b):
            raise SegmentError(f"{name} is cut short")
        heads = [96 + i * size for i in range(count)]
        label = [struct.unpack_from("<Q", b, h + label_at)[0] for h in heads]

        def links(at: int, cap: int) -> list[int]:
            n = min(struct.unpack_from("<H", b, at)[0], cap)
            return [label[j] for j in struct.unpack_from(f"<{n}I", b, at + 4)]

        rows = [(name, 0, label[i], links(h, most0)) for i, h in enumerate(heads)]
        at, block = 96 + count * size, most * 4 + 4
        for i in range(count):
            if at + 4 > len(b):
                raise SegmentError(f"{name} is cut short")
            (n,) = struct.unpack_from("<I", b, at)
            at += 4
            if at + n > len(b):
                raise SegmentError(f"{name} is cut short")
            rows += [(name, level + 1, label[i], links(at + level * block, most)) for level in range(n // block)]
            at += n
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], ["path", "level", "node", "neighbors"])

    return _each(spark, path, GRAPH_LEVELS, parse)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): each line of text files is a document; a line end at the end of a file adds none."""
    from segmill.sources.store import number

    return number(spark.read.text(path).withColumnRenamed("value", "text"), "doc_id").select("doc_id", "text")
