"""Coercion of columns to what a segment stores, decided from the schema alone.

============================================  ==========  =============================================
column                                        class       stored as
============================================  ==========  =============================================
long                                          canonical   numeric
byte, short, int, boolean                     auto        numeric, widened
double / float                                canon/auto  numeric; canonical long: IEEE bits of the double
timestamp, date, day-time interval            auto        numeric; canonical long: microseconds or days
string                                        auto        sorted
binary                                        canonical   binary
array<long>                                   canonical   sorted_numeric: ascending; empty is absent
array<string>                                 auto        sorted_set: distinct, ascending; empty is absent
array<float> of one length                    canonical   vector
decimal(20,0) with allow_lossy                explicit    numeric, wrapped to 64 bits
other decimals with scale_factor              explicit    numeric, times the factor, half away from zero
============================================  ==========  =============================================

All else is refused before any row is read.  ``strict`` takes canonical columns alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segmill.errors import CoercionError
from segmill.functions.numeric import float_bits, scaled

#: Keys of a field's metadata.
ALLOW_LOSSY, SCALE_FACTOR, SIMILARITY = "segmill.allow_lossy", "segmill.scale_factor", "segmill.similarity"


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    grade: str
    source_type: str
    similarity: str | None = None


def classify(field: T.StructField) -> Field:
    """Kind and class of a column; CoercionError where it has none."""
    t, name, meta = field.dataType, field.name, field.metadata or {}
    kind = grade = None
    if isinstance(t, T.LongType):
        kind, grade = "numeric", "canonical"
    elif isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.BooleanType, T.FloatType)):
        kind, grade = "numeric", "auto"
    elif isinstance(t, T.DoubleType):
        kind, grade = "numeric", "canonical"
    elif isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType, T.DayTimeIntervalType)):
        kind, grade = "numeric", "auto"
    elif isinstance(t, T.StringType):
        kind, grade = "sorted", "auto"
    elif isinstance(t, T.BinaryType):
        kind, grade = "binary", "canonical"
    elif isinstance(t, T.ArrayType) and isinstance(t.elementType, T.LongType):
        kind, grade = "sorted_numeric", "canonical"
    elif isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StringType):
        kind, grade = "sorted_set", "auto"
    elif isinstance(t, T.ArrayType) and isinstance(t.elementType, T.FloatType):
        kind, grade = "vector", "canonical"
    elif isinstance(t, T.DecimalType):
        if (t.precision, t.scale) == (20, 0) and str(meta.get(ALLOW_LOSSY)).lower() == "true":
            kind, grade = "numeric", "explicit"
        elif SCALE_FACTOR in meta:
            kind, grade = "numeric", "explicit"
        else:
            raise CoercionError(f"column {name}: {t.simpleString()} needs {ALLOW_LOSSY} or {SCALE_FACTOR} in its metadata")
    if kind is None:
        raise CoercionError(f"column {name}: {t.simpleString()} can't be stored")
    return Field(name, kind, grade, t.simpleString(), meta.get(SIMILARITY))


def fields(schema: T.StructType, coercion: str = "auto") -> list[Field]:
    if coercion not in ("auto", "strict"):
        raise CoercionError(f"coercion must be 'auto' or 'strict', not {coercion!r}")
    found = [classify(f) for f in schema.fields]
    if coercion == "strict":
        refused = [f.name for f in found if f.grade != "canonical"]
        if refused:
            raise CoercionError(f"strict coercion refuses {', '.join(refused)}")
    return found


def stored(field: T.StructField, kind: str) -> Column:
    """The column as a segment keeps it, in its own type."""
    c = F.col(f"`{field.name}`")
    if kind == "sorted_numeric":
        clean = F.array_sort(F.filter(c, lambda x: x.isNotNull()))
        return F.when(F.size(clean) > 0, clean).alias(field.name)
    if kind == "sorted_set":
        clean = F.array_sort(F.array_distinct(F.filter(c, lambda x: x.isNotNull())))
        return F.when(F.size(clean) > 0, clean).alias(field.name)
    if isinstance(field.dataType, T.DecimalType):
        return canonical(field, kind)
    return c.alias(field.name)


def canonical(field: T.StructField, kind: str) -> Column:
    """As stored(), with every numeric column as a 64-bit integer."""
    t, c, meta = field.dataType, F.col(f"`{field.name}`"), field.metadata or {}
    if kind != "numeric":
        return stored(field, kind)
    if isinstance(t, (T.DoubleType, T.FloatType)):
        out = float_bits(c)
    elif isinstance(t, T.TimestampType):
        out = F.unix_micros(c)
    elif isinstance(t, T.TimestampNTZType):
        out = F.unix_micros(c.cast("timestamp"))  # the session's time zone is UTC
    elif isinstance(t, T.DateType):
        out = F.unix_date(c).cast("long")
    elif isinstance(t, T.DayTimeIntervalType):
        part = lambda x: F.extract(F.lit(x), c)
        out = ((part("DAY") * 24 + part("HOUR")) * 60 + part("MINUTE")).cast("long") * 60_000_000 + (part("SECOND") * 1_000_000).cast("long")
    elif isinstance(t, T.DecimalType):
        if SCALE_FACTOR in meta:
            out = scaled(c, int(meta[SCALE_FACTOR]))
        else:
            out = F.when(c >= F.lit(str(1 << 63)).cast("decimal(20,0)"), (c - F.lit(str(1 << 64)).cast("decimal(21,0)")).cast("long")).otherwise(c.cast("long"))
    elif isinstance(t, T.BooleanType):
        out = c.cast("int").cast("long")
    else:
        out = c.cast("long")
    return out.alias(field.name)


def coerce(frame: DataFrame, coercion: str = "auto", as_long: bool = False) -> DataFrame:
    """All columns as a segment stores them; as_long: numbers as canonical 64-bit integers."""
    found = {f.name: f.kind for f in fields(frame.schema, coercion)}
    make = canonical if as_long else stored
    return frame.select(*[make(f, found[f.name]) for f in frame.schema.fields])
