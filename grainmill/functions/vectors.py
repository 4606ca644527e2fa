"""Expressions over array<double> columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use) -> Column:
    """use(value) with the value worked out once, also where it is used for every element of an array."""
    return F.element_at(F.transform(F.array(value), use), 1)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def scaled(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def normalised(v: Column, floor: float = 1e-12) -> Column:
    """v over its length, which counts as ``floor`` at least."""
    return once(1.0 / F.greatest(F.sqrt(dot(v, v)), F.lit(floor)), lambda s: scaled(v, s))


def argmax(v: Column) -> Column:
    """The first place of the greatest component, from 0."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def log_softmax(v: Column) -> Column:
    norm = once(F.array_max(v), lambda top: F.log(total(F.transform(v, lambda x: F.exp(x - top)))) + top)
    return once(norm, lambda n: F.transform(v, lambda x: x - n))


def vector_sum(v: str, size: int, weight: Column | None = None) -> Column:
    """Component-wise sum over a group, by one built-in sum for each component (map-side combined)."""
    part = lambda k: F.col(v)[k] if weight is None else F.col(v)[k] * weight
    return F.array(*[F.sum(part(k)) for k in range(size)])


def pseudo_random(id_col: Column, k: Column | int, salt: int = 0) -> Column:
    """A number in [-0.5, 0.5) from integers alone, so that any engine can replay it."""
    return F.pmod(id_col * 7919 + (F.lit(k) if isinstance(k, int) else k) * 104729 + F.lit(17 + salt * 31), F.lit(1009)) / F.lit(1009.0) - F.lit(0.5)
