"""Vector expressions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Length 1; null for a vector of length 0. The norm is bound to a variable, so it is made once a vector, not once an
    element."""

    def scaled(n: Column) -> Column:
        return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))

    return F.get(F.transform(F.array(norm(a)), scaled), 0)


def match_percent(similarity: Column) -> Column:
    """Similarity in [-1, 1] as a percentage with one decimal."""
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (similarity + 1) / 2)) * 100, 1)


def usable(v: Column, dim: int) -> Column:
    """Whether a vector has the length, no null or non-finite value, and isn't all zero."""
    size = F.coalesce(F.size(v), F.lit(-1)) == dim
    finite = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    return size & finite & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
