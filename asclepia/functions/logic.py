"""Three-valued logic and null handling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def and_(a: Column, b: Column) -> Column:
    return a & b


def or_(a: Column, b: Column) -> Column:
    return a | b


def xor(a: Column, b: Column) -> Column:
    """Null if either side is."""
    return a != b


def implies(a: Column, b: Column) -> Column:
    return ~a | b


def not_(a: Column) -> Column:
    return ~a


def is_null(a: Column) -> Column:
    return a.isNull()


def is_true(a: Column) -> Column:
    return a.eqNullSafe(F.lit(True))


def is_false(a: Column) -> Column:
    return a.eqNullSafe(F.lit(False))


def coalesce(*values: Column) -> Column:
    return F.coalesce(*values)


def coalesce_list(values: Column) -> Column:
    """The first element that isn't null."""
    return F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0))


def if_(condition: Column, then: Column, otherwise: Column) -> Column:
    """A null condition takes the other branch."""
    return F.when(condition, then).otherwise(otherwise)


def case(branches: list[tuple[Column, Column]], otherwise: Column | None = None, comparand: Column | None = None) -> Column:
    """With a comparand, null on either side never matches; no match and no else gives null."""
    out = F
    for when, then in branches:
        out = out.when(when if comparand is None else comparand == when, then)
    return out if otherwise is None else out.otherwise(otherwise)
