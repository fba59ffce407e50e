"""Similarities of vectors as column expressions, for a few queries; operators.knn has the batched form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers of the similarities in a store's field metadata.
SIMILARITIES = {"euclidean": 0, "dot": 1, "cosine": 2, "max_inner_product": 3}


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda total, v: total + v)


def euclidean(v: Column | str, q: Column | str) -> Column:
    """Minus the squared distance: greater is closer."""
    return -_sum(F.zip_with(_col(v), _col(q), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)))


def dot(v: Column | str, q: Column | str) -> Column:
    return _sum(F.zip_with(_col(v), _col(q), lambda x, y: x.cast("double") * y))


def norm(v: Column | str) -> Column:
    return F.sqrt(_sum(F.transform(_col(v), lambda x: x.cast("double") * x)))


def cosine(v: Column | str, q: Column | str) -> Column:
    """The dot product by the vector's norm; the query's is the same for all and left out.  A zero vector counts as of norm 1."""
    n = norm(v)
    return dot(v, q) / F.when(n == 0, 1.0).otherwise(n)


def similarity(name: str, v: Column | str, q: Column | str) -> Column:
    if name not in SIMILARITIES:
        raise ValueError(f"unknown similarity {name!r}: one of {', '.join(SIMILARITIES)}")
    return {"euclidean": euclidean, "cosine": cosine}.get(name, dot)(v, q)


def similarity_name(ordinal: Column | str) -> Column:
    """The name of a similarity's number, null for others."""
    return F.create_map(*[x for n, i in SIMILARITIES.items() for x in (F.lit(i), F.lit(n))])[_col(ordinal).cast("int")]
