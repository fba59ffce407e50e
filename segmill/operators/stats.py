"""Column statistics, the choice of an encoding, and segment statistics."""

from __future__ import annotations

from math import gcd

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.functions.numeric import bits_required, packed_bytes

#: A table of values is kept up to so many different ones.
TABLE_VALUES = 256
_LOW, _HIGH = -(1 << 62), (1 << 62) - 1
_PART = "field string, n long, low long, high long, divisor long, first long, wide boolean, uniques array<long>"


def numeric_stats(frame: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., field, num_values, min, max, gcd, uniques) of long columns.

    gcd is that of all differences: 0 where all values are equal, 1 where one
    lies beyond half of the 64-bit range.  uniques has the different values in
    order, null where there are more than TABLE_VALUES.  Nulls don't count; a
    column of nulls alone has no row.  Tasks send one row for each column and
    group; those rows are all that is shuffled.
    """
    by = by or []
    kinds = ", ".join(f"{b} {dict(frame.dtypes)[b]}" for b in by)
    keys = kinds + ", " if by else ""

    def partial(batches):
        state: dict = {}
        for batch in batches:
            schema = batch.schema
            data = batch.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
            groups = data.groupby(by, dropna=False, sort=False) if by else [((), data)]
            for key, part in groups:
                key = key if isinstance(key, tuple) else (key,)
                for c in columns:
                    v = part[c].dropna().to_numpy(np.int64)
                    if not len(v):
                        continue
                    old = state.get((key, c))
                    first = old[4] if old else int(v[0])
                    low, high = int(v.min()), int(v.max())
                    wide = low < _LOW or high > _HIGH
                    step = 1 if wide else int(np.gcd.reduce(np.abs(v - first)) if not old or not old[5] else 1)
                    uniques = np.unique(v)
                    if old:
                        low, high, wide, step = min(low, old[1]), max(high, old[2]), wide or old[5], gcd(step, old[3])
                        uniques = np.union1d(uniques, old[6]) if old[6] is not None and len(uniques) <= TABLE_VALUES else None
                    state[key, c] = (len(v) + (old[0] if old else 0), low, high, step, first, wide, uniques if uniques is not None and len(uniques) <= TABLE_VALUES else None)
        rows = [(*(None if pd.isna(k) else k for k in key), c, *x) for (key, c), x in state.items()]
        if rows:
            longs = [pa.int64()] * 5
            kinds = [*(schema.field(b).type for b in by), pa.string(), *longs, pa.bool_(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [*by, "field", "n", "low", "high", "divisor", "first", "wide", "uniques"])

    def final(batches):
        state: dict = {}
        for batch in batches:
            schema = batch.schema
            for r in batch.to_pylist():
                key = (*(r[b] for b in by), r["field"])
                old = state.get(key)
                if old is None:
                    state[key] = [r["n"], r["low"], r["high"], r["divisor"], r["first"], r["wide"], None if r["uniques"] is None else set(r["uniques"])]
                    continue
                old[0] += r["n"]
                old[1], old[2], old[5] = min(old[1], r["low"]), max(old[2], r["high"]), old[5] or r["wide"]
                old[3] = gcd(old[3], r["divisor"], abs(r["first"] - old[4]))
                old[6] = None if old[6] is None or r["uniques"] is None or len(both := old[6] | set(r["uniques"])) > TABLE_VALUES else both
        if state:
            rows = [(*key, n, low, high, 1 if wide else step, None if u is None else sorted(u)) for key, (n, low, high, step, _, wide, u) in state.items()]
            kinds = [*(schema.field(b).type for b in by), pa.string(), *[pa.int64()] * 4, pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [*by, "field", "num_values", "min", "max", "gcd", "uniques"])

    own = frame.select(*by, *columns)
    return own.mapInArrow(partial, keys + _PART).repartition(*by, "field").mapInArrow(final, keys + "field string, num_values long, min long, max long, gcd long, uniques array<long>")


def encodings(stats: DataFrame) -> DataFrame:
    """Adds encoding (const, table, gcd or delta), bits, base, divisor and packed_bytes to numeric_stats().

    A table wins where the places in it take fewer bits than the quotients of
    the differences.  The base of a delta is 0 where that costs no bit.
    """
    span = F.coalesce(F.try_subtract("max", "min"), F.lit(-1).cast("long"))  # beyond 63 bits: negative, as an unsigned number would be
    step = F.greatest(F.col("gcd"), F.lit(1))
    delta = bits_required(F.call_function("div", span, step))
    places = bits_required(F.size("uniques").cast("long") - 1)
    const = F.col("min") >= F.col("max")
    table = F.col("uniques").isNotNull() & (F.size("uniques") > 1) & (places < delta)
    zero = (F.col("gcd") == 1) & (F.col("min") > 0) & (bits_required(F.col("max")) == bits_required(span))
    kind = F.when(const, "const").when(table, "table").when(F.col("gcd") > 1, "gcd").otherwise("delta")
    bits = F.when(const, 0).when(table, places).otherwise(delta)
    return stats.withColumns({
        "encoding": kind,
        "bits": bits.cast("int"),
        "base": F.when(const, F.col("min")).when(table | zero, 0).otherwise(F.col("min")).cast("long"),
        "divisor": F.when(table, 1).otherwise(F.col("gcd")).cast("long"),
        "packed_bytes": packed_bytes("num_values", bits),
    })


def binary_stats(frame: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """(by..., num_values, min_length, max_length, total_length, fixed) in bytes."""
    n = F.octet_length(F.col(column))
    found = frame.groupBy(*(by or [])).agg(F.count(column).alias("num_values"), F.min(n).cast("long").alias("min_length"), F.max(n).cast("long").alias("max_length"), F.sum(n).cast("long").alias("total_length"))
    return found.withColumn("fixed", F.col("min_length") == F.col("max_length"))


def segment_stats(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(_seg, field, shape, num_values, num_terms, payload_bytes) of each segment and field, in one pass over the rows.

    payload_bytes: 8 for a number, the bytes of binaries and of the different
    terms of strings, 4 for an element of a vector.  num_terms is null for
    fields without a dictionary.
    """
    aggs, shapes = [], []
    for i, (name, kind) in enumerate(kinds.items()):
        c = F.col(f"`{name}`")
        if kind in ("numeric", "binary"):
            values, terms, size = F.count(c), F.lit(None).cast("long"), F.count(c) * 8 if kind == "numeric" else F.sum(F.octet_length(c))
        elif kind == "sorted":
            values, terms, size = F.count(c), F.countDistinct(c), None
        elif kind == "vector":
            values, terms, size = F.count(c), F.lit(None).cast("long"), F.sum(F.size(c)) * 4
        else:
            values, terms, size = F.sum(F.when(c.isNotNull(), F.size(c))), F.lit(None).cast("long"), F.sum(F.when(c.isNotNull(), F.size(c))) * 8 if kind == "sorted_numeric" else None
        aggs += [values.alias(f"v{i}"), terms.alias(f"t{i}"), (size if size is not None else F.lit(None)).cast("long").alias(f"b{i}")]
        shapes.append(F.struct(F.lit(name).alias("field"), F.lit(kind).alias("shape"), F.coalesce(F.col(f"v{i}"), F.lit(0)).cast("long").alias("num_values"), F.col(f"t{i}").alias("num_terms"), F.col(f"b{i}").alias("payload_bytes")))
    return rows.groupBy("_seg").agg(*aggs).select("_seg", F.explode(F.array(*shapes)).alias("s")).select("_seg", "s.*")
