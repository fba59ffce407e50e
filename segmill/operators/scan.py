"""Document-value scans: row addresses, row modes, tombstones, projection and segment choice.

Rows of a segment store have ``_seg`` (place of the segment in its commit),
``_doc`` (place in the segment) and ``_live``; all else are data columns, null
where a document lacks the field.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmill.errors import SegmentError

SYSTEM = ("_seg", "_doc", "_global_doc", "_live")
COMPACT, POSITIONAL = "compact", "positional"
#: Rows of a batch of batches().
BATCH_ROWS = 131_072


def address(rows: DataFrame, key: str, seg_rows: int) -> DataFrame:
    """Adds _seg and _doc from a dense key: segments of so many rows each, without a global order or a shuffle."""
    if seg_rows < 1:
        raise SegmentError("a segment has at least one row")
    k = F.col(key).cast("long")
    return rows.withColumns({"_seg": F.floor(k / seg_rows).cast("int"), "_doc": (k % seg_rows).cast("int")})


def with_live(rows: DataFrame, dead: Column | DataFrame) -> DataFrame:
    """Adds _live: dead is a condition, or a table of (_seg, _doc) of the tombstones."""
    if isinstance(dead, Column):
        return rows.withColumn("_live", ~F.coalesce(dead, F.lit(False)))
    marked = dead.select("_seg", "_doc", F.lit(True).alias("__dead")).distinct()
    return rows.join(marked, ["_seg", "_doc"], "left").withColumn("_live", F.col("__dead").isNull()).drop("__dead")


def only_live(relation: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of any relation of (_seg, _doc), such as postings, whose document is live."""
    return relation.join(docs.where("_live").select("_seg", "_doc"), ["_seg", "_doc"], "left_semi")


def inventory(rows: DataFrame) -> DataFrame:
    """(_seg, max_doc, del_count) of each segment."""
    dead = F.sum((~F.col("_live")).cast("long")) if "_live" in rows.columns else F.lit(0).cast("long")
    return rows.groupBy("_seg").agg(F.count("*").alias("max_doc"), dead.alias("del_count"))


def bases(segments: DataFrame, chosen: Sequence[int] | None = None) -> DataFrame:
    """(_seg, base): documents of the chosen segments before each, in the order chosen (of _seg where all are).

    One row a segment; the running sum is over those rows alone.
    """
    from pyspark.sql import Window

    if chosen is None:
        at = segments.withColumn("__at", F.col("_seg").cast("long"))
    else:
        order = F.create_map(*[F.lit(x) for i, s in enumerate(chosen) for x in (int(s), i)]) if chosen else F.lit(None).cast("map<int,int>")
        at = segments.where(F.col("_seg").isin(list(chosen))).withColumn("__at", order[F.col("_seg")].cast("long"))
    w = Window.orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    return at.select("_seg", F.coalesce(F.sum("max_doc").over(w), F.lit(0)).cast("long").alias("base"))


def scan(rows: DataFrame, row_mode: str, columns: Sequence[str] | None = None, segments: Sequence[int] | None = None, seg_table: DataFrame | None = None) -> DataFrame:
    """System columns and the data columns that are asked for, in the order of the table.

    compact leaves tombstones out and keeps the documents' own numbers;
    positional has every document, with _live.  _global_doc counts from the
    first of the chosen segments, in the order chosen.  Unknown columns and
    segments are errors.  seg_table has (_seg, max_doc); it is counted where it
    isn't given.
    """
    if row_mode not in (COMPACT, POSITIONAL):
        raise SegmentError(f"row_mode must be {COMPACT!r} or {POSITIONAL!r}, not {row_mode!r}")
    data = [c for c in rows.columns if c not in SYSTEM]
    if columns is not None:
        unknown = [c for c in columns if c not in data]
        if unknown:
            raise SegmentError(f"no such columns: {', '.join(unknown)}")
        data = [c for c in data if c in set(columns)]
    if segments is not None and len(set(segments)) != len(segments):
        raise SegmentError("a segment is chosen twice")
    table = inventory(rows) if seg_table is None else seg_table
    picked = rows if segments is None else rows.where(F.col("_seg").isin(list(segments)))
    live = F.col("_live") if "_live" in rows.columns else F.lit(True)
    if row_mode == COMPACT:
        picked = picked.where(live)
    # one row a segment: small beside the documents, whatever their number
    placed = picked.join(F.broadcast(bases(table, segments)), "_seg")
    system = [F.col("_seg"), F.col("_doc"), (F.col("base") + F.col("_doc")).alias("_global_doc")]
    if row_mode == POSITIONAL:
        system.append(live.alias("_live"))
    return placed.select(*system, *[F.col(f"`{c}`") for c in data])


def batches(frame: DataFrame, batch_rows: int = BATCH_ROWS):
    """Arrow batches of at most batch_rows rows, partition after partition; the driver holds one partition's at a time."""
    if batch_rows < 1:
        raise SegmentError("batch_rows must be at least 1")
    import pyarrow as pa

    def packed(found):
        for batch in found:
            for at in range(0, batch.num_rows, batch_rows):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(batch.slice(at, batch_rows))
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["batch"])

    for row in frame.mapInArrow(packed, "batch binary").toLocalIterator():
        yield from pa.ipc.open_stream(row["batch"])


def unite(*relations: DataFrame) -> DataFrame:
    """Rows of all relations; a column that one lacks is null there.  A column of two types is an error, nothing is widened."""
    types: dict[str, str] = {}
    for r in relations:
        for name, kind in r.dtypes:
            if types.setdefault(name, kind) != kind:
                raise SegmentError(f"column {name} is {types[name]} in one segment and {kind} in another")
    out = relations[0]
    for r in relations[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out
