"""Scalar and vector functions over numeric columns and ARRAY<DOUBLE> columns, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FABS, EXP, SQRT, LOG, POW, MAX = F.abs, F.exp, F.sqrt, F.log, F.pow, F.greatest


def splat(value: Column, width: int) -> Column:
    """A vector of `width` copies."""
    return F.array_repeat(value, width)


def vmap(f, v: Column) -> Column:
    """f of each element: vfabs, vsqrt, vexp and vlog are of this kind."""
    return F.transform(v, lambda x: f(x))


def vfabs(v: Column) -> Column:
    return F.transform(v, lambda x: F.abs(x))


def vsqrt(v: Column) -> Column:
    return F.transform(v, lambda x: F.sqrt(x))


def vexp(v: Column) -> Column:
    return F.transform(v, lambda x: F.exp(x))


def vlog(v: Column) -> Column:
    return F.transform(v, lambda x: F.log(x))


def vmax(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y))


def vadd(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def vsub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def vmul(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def vdiv(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x / y)


def vsum(v: Column) -> Column:
    """Sum of the elements."""
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def low(a: Column, b: Column) -> Column:
    """The smaller end of an undirected pair."""
    return F.least(a, b)


def high(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def pack_edge(u: Column, v: Column) -> Column:
    """One LONG of two 31-bit vertices; for exchange with packed formats only, joins use two columns."""
    return F.shiftleft(u, 31).bitwiseOR(v)


def unpack_edge(e: Column) -> tuple[Column, Column]:
    return F.shiftright(e, 31), e.bitwiseAND((1 << 31) - 1)
