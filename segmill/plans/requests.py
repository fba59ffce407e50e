"""Requests as JSON or dictionaries: what to read or write, resolved before any job runs."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill.errors import SegmentError
from segmill.operators import scan
from segmill.sources.store import BATCH_ROWS, SEGMENT_MAX_DOCS, Store

FRAME_VERSION = 1
RELATIONS = ("docvalues", "postings", "stats", "inventory")
_READ = {"path", "segments", "columns", "row_mode", "dict", "batch_rows", "executor", "frame_version", "relation", "postings_field"}
_WRITE = {"output_dir", "segment_max_docs", "batch_rows", "coercion", "index_sort", "append", "key"}


@dataclass(frozen=True)
class Resolved:
    """What a request came to: the frame, its settings, and both counts of rows."""

    frame: DataFrame
    config: dict
    total_docs: int
    live_docs: int


def _object(request: str | dict, known: set[str]) -> dict:
    r = json.loads(request) if isinstance(request, str) else dict(request)
    unknown = set(r) - known
    if unknown:
        raise SegmentError(f"unknown settings: {', '.join(sorted(unknown))}")
    return r


def read(spark: SparkSession, request: str | dict) -> Resolved:
    """Resolves a read.

    ``row_mode`` has no default for documents.  ``segments`` is "all" or a list
    of names.  ``dict`` chooses for each string column, or for "*", between
    "none" (strings), "segment" and "global" (an ordinal column ``<name>_ord``
    beside it).
    """
    r = _object(request, _READ)
    if r.get("frame_version", FRAME_VERSION) != FRAME_VERSION:
        raise SegmentError(f"frame_version must be {FRAME_VERSION}")
    relation = r.get("relation") or "docvalues"
    if relation not in RELATIONS:
        raise SegmentError(f"relation must be one of {', '.join(RELATIONS)}")
    batch_rows = r.get("batch_rows") or scan.BATCH_ROWS
    if batch_rows < 1:
        raise SegmentError("batch_rows must be at least 1")
    store = Store(spark, r["path"])
    c = store.commit()
    segments = r.get("segments", "all")
    if isinstance(segments, str) and segments != "all":
        raise SegmentError('segments is "all" or a list of names')
    names = None if segments == "all" else list(segments)
    picked = [s for s in c.segments if names is None or s["name"] in names]
    total = sum(s["max_doc"] for s in picked)
    live = total - sum(s["del_count"] for s in picked)
    config = {"relation": relation, "segments": segments, "batch_rows": batch_rows, "executor": "spark", "frame_version": FRAME_VERSION}
    if relation == "postings":
        if not r.get("postings_field"):
            raise SegmentError("postings_field is missing")
        frame = store.postings(r["postings_field"])
        if names is not None:
            frame = frame.where(F.col("_seg").isin([s["ord"] for s in picked]))
        return Resolved(frame, config | {"postings_field": r["postings_field"]}, total, live)
    if relation != "docvalues":
        return Resolved(store.stats() if relation == "stats" else store.inventory(), config, total, live)
    if not r.get("row_mode"):
        raise SegmentError("row_mode is missing")
    frame = store.docvalues(r["row_mode"], r.get("columns"), names)
    modes = r.get("dict") or {}
    strings = [f["name"] for f in c.fields if f["kind"] == "sorted" and f["name"] in frame.columns]
    for name in strings:
        mode = modes.get(name, modes.get("*", "none"))
        if mode not in ("none", "segment", "global"):
            raise SegmentError(f"dict mode {mode!r} of {name}")
        if mode != "none":
            frame = with_ordinal(frame, name, mode)
    return Resolved(frame, config | {"row_mode": r["row_mode"], "dict": {n: modes.get(n, modes.get("*", "none")) for n in strings}}, total, live)


def with_ordinal(frame: DataFrame, name: str, mode: str) -> DataFrame:
    """Adds <name>_ord: the place of the string in its segment's or the global dictionary; null for null."""
    from segmill.operators import ordinals

    if mode == "segment":
        d = ordinals.segment_dictionary(frame, name).select(F.col("_seg").alias("__s"), F.col("term").alias("__t"), F.col("ord").alias(f"{name}_ord"))
        return frame.join(d, (F.col("_seg") == F.col("__s")) & (F.col(f"`{name}`") == F.col("__t")), "left").drop("__s", "__t")
    d = ordinals.global_dictionary(frame, name).select(F.col("term").alias("__t"), F.col("global_ord").alias(f"{name}_ord"))
    return frame.join(d, F.col(f"`{name}`") == F.col("__t"), "left").drop("__t")


def write(spark: SparkSession, request: str | dict, frame: DataFrame) -> DataFrame:
    """Runs a write job; returns the manifest rows of its segments."""
    r = _object(request, _WRITE)
    if "output_dir" not in r:
        raise SegmentError("output_dir is missing")
    sort = [(s["field"], s.get("order", "asc")) for s in r.get("index_sort") or []]
    return Store(spark, r["output_dir"]).write(frame, r.get("coercion") or "auto", r.get("segment_max_docs") or SEGMENT_MAX_DOCS, r.get("batch_rows") or BATCH_ROWS, r.get("key"), sort or None, bool(r.get("append")))
