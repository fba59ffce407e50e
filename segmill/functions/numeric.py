"""Numeric functions: canonical 64-bit integers, widths of packed values, and a checksum."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Widths in bits that packed values may have.
WIDTHS = (1, 2, 4, 8, 12, 16, 20, 24, 28, 32, 40, 48, 56, 64)


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


@F.pandas_udf(T.LongType())
def _bits(values):
    numbers = np.ascontiguousarray(values.to_numpy(np.float64, na_value=np.nan))
    out = pd.Series(numbers.view(np.int64), dtype="Int64")
    out[np.isnan(numbers)] = pd.NA
    return out


@F.pandas_udf(T.DoubleType())
def _double(values):
    out = pd.Series(np.ascontiguousarray(values.fillna(0).to_numpy(np.int64)).view(np.float64))
    out[values.isna().to_numpy()] = np.nan
    return out.where(values.notna().to_numpy(), None)


def float_bits(x: Column | str) -> Column:
    """The IEEE bits of a double as a long; NaN and null give null."""
    return _bits(_col(x).cast("double"))


def bits_float(x: Column | str) -> Column:
    """The double whose IEEE bits a long holds."""
    return _double(_col(x).cast("long"))


def scaled(x: Column | str, factor: int) -> Column:
    """A decimal times the factor as a long; a half is rounded away from zero."""
    return F.round(_col(x) * F.lit(factor), 0).cast("long")


def bits_required(x: Column | str) -> Column:
    """The least of WIDTHS that holds a number as an unsigned one; negative numbers need all 64 bits."""
    n = F.length(F.bin(_col(x).cast("long")))
    out = F.lit(64)
    for w in reversed(WIDTHS[:-1]):
        out = F.when(n <= w, w).otherwise(out)
    return F.when(_col(x) < 0, 64).otherwise(out).cast("int")


def packed_bytes(count: Column | str, width: Column | str) -> Column:
    """Bytes of so many values of a width, with the bytes behind them that a reader of whole words may touch."""
    n, w = _col(count).cast("long"), _col(width).cast("long")
    per_word = F.floor(64 / w)
    small = F.floor(n / per_word) * 8 + F.ceil((n % per_word) * w / 8)
    body = F.when(w % 8 == 0, n * F.floor(w / 8)).when(w < 8, small).otherwise(F.ceil(n / 2) * F.floor(w / 4))
    tail = F.when(w > 32, 64 - w).when(w > 16, 32 - w).when(w > 8, 16 - w).otherwise(0)
    return F.when(w == 0, 0).otherwise(body + F.ceil(tail / 8)).cast("long")


def norm_width(low: Column | str, high: Column | str) -> Column:
    """Bytes of a value between two bounds: 0 where they are equal, else 1, 2, 4 or 8."""
    a, b = _col(low), _col(high)
    out = F.lit(8)
    for n in (4, 2, 1):
        edge = 1 << (8 * n - 1)
        out = F.when((a >= -edge) & (b <= edge - 1), n).otherwise(out)
    return F.when(a >= b, 0).otherwise(out).cast("int")


def checksum(data: Column | str) -> Column:
    """CRC-32 of a binary value or string."""
    return F.crc32(_col(data).cast("binary"))


def zigzag(x: Column | str) -> Column:
    """Signed to unsigned, small magnitudes first."""
    v = _col(x).cast("long")
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def varint_bytes(x: Column | str) -> Column:
    """Bytes of a number of 0 or more at seven bits a byte."""
    return F.ceil(F.length(F.bin(_col(x).cast("long"))) / 7).cast("int")
