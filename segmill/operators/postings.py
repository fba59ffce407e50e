"""The inverted index as relations: postings, lengths, term and field statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segmill.functions.text import norm_byte, tokens
from segmill.operators import termscan

#: Documents of a block of a posting list.
BLOCK = 128


def spread(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Keys and texts where they are; only where the input has fewer splits than there are cores are they hashed to all of them."""
    own, cores = docs.select(*keys, text), docs.sparkSession.sparkContext.defaultParallelism
    return own if own._jdf.queryExecution().toRdd().getNumPartitions() >= cores else own.repartition(cores, *keys)


def token_stream(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, pos, term): tokens in order."""
    return docs.select(F.col(key).alias("doc"), F.posexplode(tokens(text)).alias("pos", "term"))


def postings(docs: DataFrame, key: str | list[str] = "doc_id", text: str = "text", unique: bool = False) -> DataFrame:
    """(key..., term, freq): how often each term stands in each document.

    Rows that share a key are one document, whose terms are put together by an
    exchange.  Where the caller knows that no two rows share a key (``unique``),
    each row's terms are counted where the row is.
    """
    keys = [key] if isinstance(key, str) else key
    cut = spread(docs, keys, text)
    if not unique:
        return cut.select(*keys, F.explode(tokens(text)).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("freq"))

    def run(batches):
        for batch in batches:
            for part in termscan.bounded(batch, len(keys)):
                at, terms, freq = termscan.frequencies(part.column(len(keys)))
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(at) for i in range(len(keys))), terms, pa.array(freq)], [*keys, "term", "freq"])

    kinds = T.StructType([*(cut.schema[k] for k in keys), T.StructField("term", T.StringType()), T.StructField("freq", T.LongType())])
    return cut.mapInArrow(run, kinds)


def runs(rows: DataFrame, text: str) -> DataFrame:
    """(_seg, _doc, term, docs, freqs): the postings of each term in a stretch of a segment, whose first document is _doc.

    Rows must stand in the order of documents in each file, as a store writes
    them; so the stretches of a term in the order of _seg and _doc don't overlap.
    Where the input has fewer splits than there are cores, ranges of documents
    are spread over them.
    """
    own, cores = rows.select("_seg", "_doc", text), rows.sparkSession.sparkContext.defaultParallelism
    if own._jdf.queryExecution().toRdd().getNumPartitions() < cores:
        own = own.repartitionByRange(cores, "_seg", "_doc").sortWithinPartitions("_seg", "_doc")

    def run(batches):
        for batch in batches:
            for part in termscan.bounded(batch, 2):
                found = termscan.grouped(part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2))
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in found], ["_seg", "_doc", "term", "docs", "freqs"])

    return own.mapInArrow(run, "_seg int, _doc int, term string, docs array<int>, freqs array<int>")


def unfolded(found: DataFrame) -> DataFrame:
    """(_seg, _doc, term, freq): a row for each posting of runs(), in their order."""
    each = found.select("_seg", "term", F.inline(F.arrays_zip("docs", "freqs")).alias("_doc", "freq"))
    return each.select("_seg", "_doc", "term", F.col("freq").cast("long").alias("freq"))


def lengths(docs: DataFrame, key: str | list[str] = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, length, norm): tokens of each document, and the byte that keeps it; a map over the rows."""
    keys = [key] if isinstance(key, str) else key
    own = docs.select(*keys, text)

    def run(batches):
        for batch in batches:
            for part in termscan.bounded(batch, len(keys)):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(termscan.counts(part.column(len(keys))))], [*keys, "length"])

    counted = own.mapInArrow(run, T.StructType([*(own.schema[k] for k in keys), T.StructField("length", T.LongType())]))
    return counted.withColumn("norm", norm_byte("length"))


def term_stats(posted: DataFrame) -> DataFrame:
    """(term, doc_freq, total_freq)."""
    return posted.groupBy("term").agg(F.count("*").alias("doc_freq"), F.sum("freq").alias("total_freq"))


def field_stats(posted: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row: terms, sum of document frequencies, sum of frequencies, documents with a term, least and greatest term."""
    terms = term_stats(posted).agg(F.count("*").alias("num_terms"), F.sum("doc_freq").alias("sum_doc_freq"), F.sum("total_freq").alias("sum_total_freq"), F.min("term").alias("min_term"), F.max("term").alias("max_term"))
    return terms.crossJoin(posted.agg(F.countDistinct(key).alias("doc_count")))  # one row each


def ordered(posted: DataFrame, key: str = "doc_id") -> DataFrame:
    """Postings in byte order of terms and order of documents, sorted by ranges."""
    return posted.orderBy("term", key)


def with_ordinals(posted: DataFrame) -> DataFrame:
    """Adds ord, the place of the term among all terms."""
    from segmill.operators.ordinals import dense_order

    terms = dense_order(posted.select("term").distinct(), ["term"], "ord")
    return posted.join(terms, "term")


def deltas(posted: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds delta: the distance to the document before in the term's list; the first counts from -1."""
    w = Window.partitionBy("term").orderBy(key)
    return posted.withColumn("delta", F.col(key) - F.lag(key, 1, -1).over(w))


def blocks(posted: DataFrame, key: str = "doc_id", size: int = BLOCK) -> DataFrame:
    """(term, block, base, last, n, sum_freq): runs of so many documents of a term; base is the last document before, -1 at first."""
    w = Window.partitionBy("term").orderBy(key)
    placed = posted.withColumn("block", F.floor((F.row_number().over(w) - 1) / size).cast("long")).withColumn("before", F.lag(key, 1, -1).over(w))
    return placed.groupBy("term", "block").agg(F.min("before").alias("base"), F.max(key).alias("last"), F.count("*").alias("n"), F.sum("freq").alias("sum_freq"))


def checksum(posted: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row: the sum of documents and frequencies over all postings."""
    return posted.agg(F.sum(F.col(key) + F.col("freq")).alias("checksum"), F.count("*").alias("num_postings"))
