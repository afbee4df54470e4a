"""Codes, concepts, quantities, ratios, ages, and membership in code systems; value sets are in sources.terminology."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from asclepia.functions import temporal
from asclepia.functions.comparison import _unit
from asclepia.functions.conversion import quantity

__all__ = ["add_quantities", "age", "age_at", "code", "concept", "divide_quantities", "in_code_system", "quantity", "ratio", "subtract_quantities"]


def _text(x: Column | str | None) -> Column:
    return F.lit(x).cast("string") if x is None or isinstance(x, str) else x


def code(value: Column | str, system: Column | str | None, version: Column | str | None = None, display: Column | str | None = None) -> Column:
    return F.struct(_text(value).alias("code"), _text(system).alias("system"), _text(version).alias("version"), _text(display).alias("display"))


def concept(codes: list[Column], display: Column | str | None = None) -> Column:
    return F.struct(F.array(*codes).alias("codes"), _text(display).alias("display"))


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.struct(numerator.alias("numerator"), denominator.alias("denominator"))


def in_code_system(x: Column, system: Column | str, is_concept: bool = False) -> Column:
    """Of a concept any code counts."""
    s = _text(system)
    return F.exists(x["codes"], lambda c: c["system"] == s) if is_concept else x["system"] == s


def age(birth: Column, now: Column, precision: str = "year") -> Column:
    """Whole periods from birth to the evaluation time."""
    return temporal.duration_between(birth, now, precision)


age_at = age


def _same_unit(a: Column, b: Column, combine) -> Column:
    ua, ub = F.coalesce(a["unit"], F.lit("1")), F.coalesce(b["unit"], F.lit("1"))
    converts = _unit(ua, 0) == _unit(ub, 0)
    moved = (b["value"].cast("double") * _unit(ub, 1) / _unit(ua, 1)).cast("decimal(28,8)")
    made = quantity(combine(a["value"], b["value"]), a["unit"])
    some = a["value"].isNotNull() & b["value"].isNotNull()
    wrong = F.when(F.raise_error(F.lit("units differ")).cast("boolean"), made)
    return F.when(some & (ua == ub), made).when(some & converts, quantity(combine(a["value"], moved), a["unit"])).when(some, wrong)


def add_quantities(a: Column, b: Column) -> Column:
    """In the first one's unit; units of different dimensions raise."""
    return _same_unit(a, b, lambda x, y: x + y)


def subtract_quantities(a: Column, b: Column) -> Column:
    return _same_unit(a, b, lambda x, y: x - y)


def multiply_quantity(a: Column, n: Column) -> Column:
    from asclepia.functions.arithmetic import multiply_decimal

    return quantity(multiply_decimal(a["value"], n), a["unit"])


def divide_quantities(a: Column, b: Column) -> Column:
    """Of one unit a quantity of unit 1, else of a compound unit; a zero divisor gives null."""
    same = F.coalesce(a["unit"], F.lit("1")) == F.coalesce(b["unit"], F.lit("1"))
    value = F.try_divide(a["value"], b["value"]).cast("decimal(28,8)")
    return F.when(value.isNotNull(), quantity(value, F.when(same, F.lit("1")).otherwise(F.concat_ws("/", F.coalesce(a["unit"], F.lit("1")), F.coalesce(b["unit"], F.lit("1"))))))
