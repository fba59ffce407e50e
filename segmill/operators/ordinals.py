"""Dictionaries: ordinals of terms per segment and over all, and the way between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def segment_dictionary(rows: DataFrame, column: str) -> DataFrame:
    """(_seg, ord, term): the different terms of each segment in byte order, from 0."""
    terms = rows.where(F.col(column).isNotNull()).select("_seg", F.col(column).alias("term")).distinct()
    return terms.select("_seg", (F.row_number().over(Window.partitionBy("_seg").orderBy("term")) - 1).cast("long").alias("ord"), "term")


def global_dictionary(rows: DataFrame, column: str) -> DataFrame:
    """(global_ord, term): the different terms of all segments in byte order, from 0.

    Terms are sorted by ranges; each range counts from where the one before
    ends, so that no task holds more than a range.
    """
    terms = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("term")).distinct()
    return dense_order(terms, ["term"], "global_ord")


def dense_order(frame: DataFrame, order: list, name: str) -> DataFrame:
    """Numbers rows in a global order from 0: a sort by ranges, and one count for each range."""
    ranged = frame.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    local = ranged.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    sizes = ranged.groupBy("__part").count()
    before = F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__start"))  # a row for each range
    return local.join(F.broadcast(starts), "__part").select((F.col("__start") + F.col("__at") - 1).cast("long").alias(name), *frame.columns)


def ordinal_map(rows: DataFrame, column: str) -> DataFrame:
    """(_seg, ord, global_ord): where each segment's ordinals lie in the global dictionary."""
    return segment_dictionary(rows, column).join(global_dictionary(rows, column), "term").select("_seg", "ord", "global_ord")


def encode(rows: DataFrame, column: str) -> DataFrame:
    """(_seg, _doc, ord): each document's ordinal in its segment's dictionary; null where it has no term."""
    d = segment_dictionary(rows, column)
    return rows.select("_seg", "_doc", F.col(column).alias("term")).join(d, ["_seg", "term"], "left").select("_seg", "_doc", "ord")


def decode(ords: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(_seg, _doc, term) from ordinals and a segment dictionary."""
    return ords.join(dictionary, ["_seg", "ord"], "left").select("_seg", "_doc", "term")


def prefix_blocks(dictionary: DataFrame, block: int = 64) -> DataFrame:
    """(_seg, ord, block, shared, suffix): blocks of so many terms, and the bytes a term shares with the one before it in its block."""
    from segmill.functions.text import common_prefix

    w = Window.partitionBy("_seg").orderBy("ord")
    before = F.lag("term").over(w)
    inside = F.col("ord") % block != 0
    return dictionary.withColumn("__before", before).select(
        "_seg", "ord", F.floor(F.col("ord") / block).cast("long").alias("block"),
        F.when(inside, common_prefix("__before", "term")).otherwise(0).cast("long").alias("shared"),
        F.octet_length("term").cast("long").alias("n_bytes"),
    )


def list_offsets(rows: DataFrame, column: str) -> DataFrame:
    """(_seg, _doc, offset, n): where each document's values begin in the segment's list of all values."""
    n = F.coalesce(F.size(F.when(F.col(column).isNotNull(), F.col(column))), F.lit(0)).cast("long")
    w = Window.partitionBy("_seg").orderBy("_doc").rowsBetween(Window.unboundedPreceding, -1)
    sized = rows.select("_seg", "_doc", n.alias("n"))
    return sized.select("_seg", "_doc", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("long").alias("offset"), "n")


def rank_table(rows: DataFrame, column: str, block: int = 512) -> DataFrame:
    """(_seg, block, n, rank): values in each block of so many documents of a segment, and in the blocks before it."""
    counted = rows.groupBy("_seg", F.floor(F.col("_doc") / block).cast("long").alias("block")).agg(F.count(column).alias("n"))
    before = F.sum("n").over(Window.partitionBy("_seg").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    return counted.withColumn("rank", F.coalesce(before, F.lit(0)).cast("long"))
