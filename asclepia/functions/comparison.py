"""Three-valued comparison of scalars, lists, structs, quantities, codes and intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units that convert into each other, by dimension and factor to its base unit.
UNITS = {
    "g": ("mass", 1.0), "kg": ("mass", 1e3), "mg": ("mass", 1e-3), "ug": ("mass", 1e-6), "ng": ("mass", 1e-9), "[lb_av]": ("mass", 453.59237), "[oz_av]": ("mass", 28.349523125),
    "m": ("length", 1.0), "km": ("length", 1e3), "cm": ("length", 1e-2), "mm": ("length", 1e-3), "um": ("length", 1e-6), "[in_i]": ("length", 0.0254), "[ft_i]": ("length", 0.3048),
    "L": ("volume", 1.0), "l": ("volume", 1.0), "dL": ("volume", 0.1), "mL": ("volume", 1e-3), "ml": ("volume", 1e-3), "uL": ("volume", 1e-6),
    "s": ("time", 1.0), "ms": ("time", 1e-3), "min": ("time", 60.0), "h": ("time", 3600.0), "d": ("time", 86400.0), "wk": ("time", 604800.0),
    "second": ("time", 1.0), "seconds": ("time", 1.0), "minute": ("time", 60.0), "minutes": ("time", 60.0), "hour": ("time", 3600.0), "hours": ("time", 3600.0),
    "day": ("time", 86400.0), "days": ("time", 86400.0), "week": ("time", 604800.0), "weeks": ("time", 604800.0), "millisecond": ("time", 1e-3), "milliseconds": ("time", 1e-3),
    "mo": ("months", 1.0), "month": ("months", 1.0), "months": ("months", 1.0), "a": ("months", 12.0), "year": ("months", 12.0), "years": ("months", 12.0),
    "1": ("one", 1.0), "": ("one", 1.0), "%": ("one", 0.01),
    "g/L": ("density", 1.0), "g/dL": ("density", 10.0), "mg/dL": ("density", 0.01), "mg/L": ("density", 1e-3), "mmol/L": ("molar", 1.0), "umol/L": ("molar", 1e-3),
}
CLOSE = 1e-10


def equal(a: Column, b: Column) -> Column:
    return a == b


def not_equal(a: Column, b: Column) -> Column:
    return a != b


def equivalent(a: Column, b: Column) -> Column:
    """Never null; null matches null."""
    return a.eqNullSafe(b)


def equivalent_strings(a: Column, b: Column) -> Column:
    """Case doesn't count."""
    return F.lower(a).eqNullSafe(F.lower(b))


def less(a: Column, b: Column) -> Column:
    return a < b


def greater(a: Column, b: Column) -> Column:
    return a > b


def less_or_equal(a: Column, b: Column) -> Column:
    return a <= b


def greater_or_equal(a: Column, b: Column) -> Column:
    return a >= b


def between(x: Column, low: Column, high: Column) -> Column:
    return (x >= low) & (x <= high)


def _element_equal(x: Column, y: Column, eq) -> Column:
    return F.when(x.isNull() & y.isNull(), F.lit(True)).when(x.isNull() | y.isNull(), F.lit(None).cast("boolean")).otherwise(eq(x, y))


def equal_lists(a: Column, b: Column, eq=equal) -> Column:
    """Element by element: two nulls are equal, one null is unknown, a definite difference decides."""
    same = F.zip_with(a, b, lambda x, y: _element_equal(x, y, eq))
    out = F.when(F.size(a) != F.size(b), False).when(F.exists(same, lambda s: s.eqNullSafe(F.lit(False))), False)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).otherwise(out.when(F.exists(same, lambda s: s.isNull()), F.lit(None).cast("boolean")).otherwise(True))


def equal_tuples(a: Column, b: Column, fields: list[str], eq=equal) -> Column:
    """By field name, as lists."""
    same = F.array(*[_element_equal(a.getField(f), b.getField(f), eq) for f in fields])
    out = F.when(F.exists(same, lambda s: s.eqNullSafe(F.lit(False))), False).when(F.exists(same, lambda s: s.isNull()), F.lit(None).cast("boolean")).otherwise(True)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).otherwise(out)


def equivalent_lists(a: Column, b: Column, eqv=equivalent) -> Column:
    """Never null: same length and each element equivalent to its counterpart."""
    same = (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.coalesce(eqv(x, y), F.lit(False))), lambda s: s)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.coalesce(same, F.lit(False)))


def equal_codes(a: Column, b: Column) -> Column:
    """Code, system and version."""
    same = a["code"].eqNullSafe(b["code"]) & a["system"].eqNullSafe(b["system"]) & a["version"].eqNullSafe(b["version"])
    return F.when(a.isNotNull() & b.isNotNull(), same)


def equivalent_codes(a: Column, b: Column) -> Column:
    """Code and system; version and display don't count."""
    same = a["code"].eqNullSafe(b["code"]) & a["system"].eqNullSafe(b["system"])
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(same)


def equivalent_concepts(a: Column, b: Column) -> Column:
    """Whether any code of one is a code of the other."""
    keys = lambda c: F.transform(c["codes"], lambda k: F.struct(F.coalesce(k["code"], F.lit("")).alias("c"), F.coalesce(k["system"], F.lit("")).alias("s")))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.coalesce(F.arrays_overlap(keys(a), keys(b)), F.lit(False)))


def _unit(unit: Column, at: int) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in UNITS.items() for x in (k, v[at])])
    return F.try_element_at(table, F.coalesce(unit, F.lit("1")))


def _quantities(a: Column, b: Column, compare) -> Column:
    ua, ub = F.coalesce(a["unit"], F.lit("1")), F.coalesce(b["unit"], F.lit("1"))
    converts = _unit(ua, 0) == _unit(ub, 0)
    x, y = a["value"].cast("double") * _unit(ua, 1), b["value"].cast("double") * _unit(ub, 1)
    near = F.abs(x - y) <= CLOSE * F.greatest(F.abs(x), F.abs(y))
    wrong = F.raise_error(F.lit("units that can't be compared")).cast("boolean")
    out = F.when(ua == ub, compare(a["value"], b["value"], a["value"] == b["value"])).when(converts, compare(x, y, near)).otherwise(wrong)
    return F.when(a["value"].isNotNull() & b["value"].isNotNull(), out)


def equal_quantities(a: Column, b: Column) -> Column:
    """After conversion of units; units of different dimensions raise."""
    return _quantities(a, b, lambda x, y, near: near)


def less_quantities(a: Column, b: Column) -> Column:
    return _quantities(a, b, lambda x, y, near: (x < y) & ~near)


def equal_intervals(a: Column, b: Column) -> Column:
    """Bounds and whether they belong to the interval; an unknown bound on one side is unknown."""
    return equal_tuples(a, b, ["low", "high", "lowClosed", "highClosed"])


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)
