"""Hydration: stored columns of documents by their addresses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.errors import SegmentError


def hydrate(pairs: DataFrame, rows: DataFrame, columns: Sequence[str], order: str = "pos", check: bool = False) -> DataFrame:
    """(pos, _seg, _doc, columns...) for each row (pos, _seg, _doc) of pairs, repeated ones too.

    Tombstoned documents have their values.  An address without a document
    gives nulls; with check it fails the job.  Sort by pos for the order of the
    request.
    """
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise SegmentError(f"no such columns: {', '.join(missing)}")
    stored = rows.select("_seg", "_doc", *[F.col(f"`{c}`") for c in columns], F.lit(True).alias("__there"))
    found = pairs.select(order, "_seg", "_doc").join(stored, ["_seg", "_doc"], "left")
    if check:
        found = found.where(F.col("__there") | F.raise_error(F.concat(F.lit("no document "), F.col("_doc"), F.lit(" in segment "), F.col("_seg"))).isNotNull())
    return found.select(order, "_seg", "_doc", *[F.col(f"`{c}`") for c in columns])
