"""Arithmetic: null in, null out; overflow raises (ANSI mode); a zero divisor gives null."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMAL = "decimal(28,8)"
STEP = Decimal("0.00000001")
# The extremes of each type.
INT_MIN, INT_MAX = -(1 << 31), (1 << 31) - 1
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1
DECIMAL_MAX = Decimal("99999999999999999999.99999999")
MINIMUM = {"Integer": INT_MIN, "Long": LONG_MIN, "Decimal": -DECIMAL_MAX, "Date": "0001-01-01", "DateTime": "0001-01-01 00:00:00", "Time": 0}
MAXIMUM = {"Integer": INT_MAX, "Long": LONG_MAX, "Decimal": DECIMAL_MAX, "Date": "9999-12-31", "DateTime": "9999-12-31 23:59:59.999", "Time": 86_399_999}
_SPARK = {"Integer": "int", "Long": "bigint", "Decimal": DECIMAL, "Date": "date", "DateTime": "timestamp_ntz", "Time": "int"}


def decimal(a: Column) -> Column:
    return a.cast(DECIMAL)


def add(a: Column, b: Column) -> Column:
    return a + b


def subtract(a: Column, b: Column) -> Column:
    return a - b


def multiply(a: Column, b: Column) -> Column:
    """Integers and longs; for decimals see :func:`multiply_decimal`."""
    return a * b


def multiply_decimal(a: Column, b: Column) -> Column:
    """To 8 places, exactly: small factors at once, large ones by their whole and fractional parts, since Spark would give their product fewer places."""
    a, b = decimal(a), decimal(b)
    small = (F.abs(a) < 10**10) & (F.abs(b) < 10**10)
    narrow = lambda x: x.try_cast("decimal(18,8)")
    (i, f), (j, g) = ((F.floor(x).cast("decimal(20,0)"), (x - F.floor(x)).cast("decimal(8,8)")) for x in (a, b))
    parts = (i * g + j * f).cast("decimal(38,16)") + (f * g).cast("decimal(38,16)")
    return F.when(small, decimal(narrow(a) * narrow(b))).otherwise(decimal(decimal(i * j) + decimal(parts)))


def divide(a: Column, b: Column) -> Column:
    """Always decimal, to 8 places."""
    return decimal(F.try_divide(decimal(a), decimal(b)))


def truncated_divide(a: Column, b: Column) -> Column:
    """Toward zero, for integers and longs."""
    return F.when(b != 0, F.call_function("div", a, b))


def truncated_divide_decimal(a: Column, b: Column) -> Column:
    q = F.try_divide(decimal(a), decimal(b))
    return decimal(F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)))


def modulo(a: Column, b: Column) -> Column:
    """The sign follows the dividend."""
    return F.try_mod(a, b)


def power(a: Column, b: Column, kind: str = DECIMAL) -> Column:
    """``kind`` is the static result type: int or bigint for whole bases with exponents that can't be negative, else decimal.

    Whole powers of whole numbers are multiplied out, exactly; one that doesn't fit raises. Others are to double precision.
    """
    near = F.pow(a.cast("double"), b.cast("double")).cast(kind)
    if kind == DECIMAL:
        return near
    x, n = a.cast("bigint"), b.cast("int")
    # Of 0, 1 and -1 only the exponent's parity counts, and no other number has a power beyond the 63rd that fits.
    steps = F.when(F.abs(x) > 1, F.least(n, F.lit(64))).otherwise(F.when(n > 0, 2 - n % 2).otherwise(0))
    exact = F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), F.lit(1).cast("bigint"), lambda t, i: F.when(i <= steps, t * x).otherwise(t))
    return F.when(x.isNotNull() & n.isNotNull(), F.when(n < 0, near).otherwise(exact.cast(kind)))


def negate(a: Column) -> Column:
    return -a


def absolute(a: Column) -> Column:
    return F.abs(a)


def _clamped(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(INT_MAX)), F.lit(INT_MIN)).cast("int"))


def ceiling(a: Column) -> Column:
    """To integer, saturating at its extremes."""
    return _clamped(F.ceil(a))


def floor(a: Column) -> Column:
    return _clamped(F.floor(a))


def truncate(a: Column) -> Column:
    """Toward zero; out of the integer range gives 0."""
    return F.when(a.isNotNull(), F.coalesce(F.when(F.abs(a.cast("decimal(38,8)")) <= INT_MAX, a.cast("int")), F.lit(0)))


def round_(a: Column, places: Column | int | None = None) -> Column:
    """Midpoints go to the larger value: -0.5 to 0, -1.5 to -1. Null places give null; eight or more change nothing, places below 0 round whole digits."""
    x = decimal(a)
    if places is None or isinstance(places, int):
        return _rounded(x, places or 0)
    out = F.when(places >= 8, x)
    for n in range(-19, 8):
        out = out.when(places == n, _rounded(x, n))
    return out.when(places < -19, F.lit(0).cast(DECIMAL))


def _rounded(x: Column, places: int) -> Column:
    if places >= 8:
        return x
    half = F.lit(Decimal(5).scaleb(-places - 1)).cast("decimal(38,9)")
    return decimal(F.call_function("floor", x.cast("decimal(38,9)") + half, F.lit(places)))


def _floating(x: Column) -> Column:
    return F.when(x.isNotNull() & (F.isnan(x) | (F.abs(x) == float("inf"))), F.raise_error(F.lit("result is not a number")).cast("double")).otherwise(x)


def ln(a: Column) -> Column:
    """Zero raises, negative gives null."""
    x = a.cast("double")
    return decimal(F.when(x == 0, F.raise_error(F.lit("Ln(0)")).cast("double")).when(x > 0, F.log(x)))


def exp(a: Column) -> Column:
    return decimal(_floating(F.exp(a.cast("double"))))


def log(a: Column, base: Column) -> Column:
    """Null unless both are positive and the base isn't 1."""
    x, b = a.cast("double"), base.cast("double")
    return decimal(F.when((x > 0) & (b > 0) & (b != 1), F.log(x) / F.log(b)))


def successor(a: Column, kind: str = "Integer") -> Column:
    """The next value of the type (Integer, Long, Decimal, Date, DateTime, Time); null after the largest number."""
    if kind in ("Integer", "Long"):
        return F.when(a < F.lit(MAXIMUM[kind]), a + F.lit(1).cast(_SPARK[kind]))
    if kind == "Decimal":
        return decimal(decimal(a) + F.lit(STEP))
    if kind == "Date":
        return F.when(a >= F.lit("9999-12-31").cast("date"), F.raise_error(F.lit("successor of the last date")).cast("date")).otherwise(F.date_add(a, 1))
    if kind == "Time":
        return F.when(a >= MAXIMUM["Time"], F.raise_error(F.lit("successor of the last time")).cast("int")).otherwise(a + 1)
    return F.when(a >= F.lit(MAXIMUM["DateTime"]).cast("timestamp_ntz"), F.raise_error(F.lit("successor of the last time")).cast("timestamp_ntz")).otherwise(a + F.expr("interval '0.001' second"))


def predecessor(a: Column, kind: str = "Integer") -> Column:
    if kind in ("Integer", "Long"):
        return F.when(a > F.lit(MINIMUM[kind]), a - F.lit(1).cast(_SPARK[kind]))
    if kind == "Decimal":
        return decimal(decimal(a) - F.lit(STEP))
    if kind == "Date":
        return F.when(a <= F.lit("0001-01-01").cast("date"), F.raise_error(F.lit("predecessor of the first date")).cast("date")).otherwise(F.date_sub(a, 1))
    if kind == "Time":
        return F.when(a <= 0, F.raise_error(F.lit("predecessor of the first time")).cast("int")).otherwise(a - 1)
    return F.when(a <= F.lit(MINIMUM["DateTime"]).cast("timestamp_ntz"), F.raise_error(F.lit("predecessor of the first time")).cast("timestamp_ntz")).otherwise(a - F.expr("interval '0.001' second"))


def minimum(kind: str) -> Column:
    """Of a quantity: the least decimal, of unit 1."""
    return _unit_one(MINIMUM["Decimal"]) if kind == "Quantity" else F.lit(MINIMUM[kind]).cast(_SPARK[kind])


def maximum(kind: str) -> Column:
    return _unit_one(MAXIMUM["Decimal"]) if kind == "Quantity" else F.lit(MAXIMUM[kind]).cast(_SPARK[kind])


def _unit_one(value: Decimal) -> Column:
    return F.struct(F.lit(value).cast(DECIMAL).alias("value"), F.lit("1").alias("unit"))


def precision(a: Column) -> Column:
    """Decimal places that count: those of the shortest writing of the number."""
    text = F.regexp_replace(a.cast("string"), r"\.?0+$", "")
    return F.when(a.isNotNull(), F.length(F.regexp_extract(text, r"\.(\d+)", 1)))


def low_boundary(a: Column, places: int = 8) -> Column:
    """A number written with fewer places stands for all that begin so: the least of them, to ``places``."""
    return a.cast(f"decimal(28,{places})")


def high_boundary(a: Column, written: int, places: int = 8) -> Column:
    """The greatest number to ``places`` that begins like ``a`` written with ``written`` places."""
    fill = Decimal(10) ** -written - Decimal(10) ** -places
    return (a.cast(f"decimal(28,{places})") + F.when(a < 0, F.lit(-fill)).otherwise(F.lit(fill))).cast(f"decimal(28,{places})")
