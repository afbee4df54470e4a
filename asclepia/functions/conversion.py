"""Type operators and conversions: a string that doesn't convert gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUE, FALSE = ("true", "t", "yes", "y", "1"), ("false", "f", "no", "n", "0")
_WHOLE, _NUMBER = r"^\s*[+-]?\d+\s*$", r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)\s*$"
_DATE = r"^(\d{4})(-(\d{2})(-(\d{2}))?)?$"
_QUANTITY = r"^\s*([+-]?\d+(?:\.\d+)?)\s*(?:'([^']*)'|([a-zA-Z]+))?\s*$"


def as_(x: Column, kind: str | None = None) -> Column:
    return x if kind is None else x.cast(kind)


def is_(x: Column, static: bool = True) -> Column:
    """The static type answers; a null value is of no type."""
    return F.when(x.isNull(), F.lit(False)).otherwise(F.lit(static))


def to_boolean(x: Column) -> Column:
    s = F.lower(F.trim(x.cast("string")))
    return F.when(s.isin(*TRUE), True).when(s.isin(*FALSE), False)


def boolean_from_number(x: Column) -> Column:
    return x != 0


def to_chars(x: Column) -> Column:
    return F.split(x, "")


def to_integer(x: Column) -> Column:
    """Of a string: whole numbers in range only."""
    return F.when(F.regexp_like(x, F.lit(_WHOLE)), F.trim(x).try_cast("int"))


def integer_from_number(x: Column) -> Column:
    """Fractions are cut off; out of range gives null."""
    return F.when(F.abs(x.cast("decimal(38,8)")) < 2147483649, x.cast("decimal(38,8)").try_cast("int"))


def to_long(x: Column) -> Column:
    return F.when(F.regexp_like(x, F.lit(_WHOLE)), F.trim(x).try_cast("bigint"))


def to_decimal(x: Column) -> Column:
    return F.when(F.regexp_like(x, F.lit(_NUMBER)), F.trim(x).try_cast("decimal(28,8)"))


def to_string(x: Column, kind: str | None = None) -> Column:
    """ISO for temporals; a quantity as value 'unit'."""
    if kind == "Quantity":
        return F.concat(F.regexp_replace(x["value"].cast("string"), r"(\.\d*?[1-9])0+$|\.0*$", "$1"), F.lit(" '"), F.coalesce(x["unit"], F.lit("1")), F.lit("'"))
    if kind == "DateTime":
        return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSS")
    if kind == "Time":
        part = lambda n, size: F.lpad(n.cast("string"), size, "0")
        return F.concat(part(F.floor(x / 3_600_000), 2), F.lit(":"), part(F.floor(x / 60_000) % 60, 2), F.lit(":"), part(F.floor(x / 1000) % 60, 2), F.lit("."), part(x % 1000, 3))
    return x.cast("string")


def to_date(x: Column) -> Column:
    """Of a whole ISO date."""
    return F.when(F.regexp_like(x, F.lit(r"^\d{4}-\d{2}-\d{2}")), F.substring(x, 1, 10).try_cast("date"))


def to_partial_date(x: Column) -> Column:
    """Also of a year or a year and month: the first and last day, and the precision."""
    from asclepia.functions import temporal

    part = lambda i: F.nullif(F.regexp_extract(x, _DATE, i), F.lit("")).try_cast("int")
    return F.when(F.regexp_like(x, F.lit(_DATE)), temporal.partial_date(part(1), part(3), part(5)))


def to_date_time(x: Column) -> Column:
    return F.when(F.regexp_like(x, F.lit(r"^\d{4}-\d{2}-\d{2}")), x.try_cast("timestamp_ntz"))


#: A date-time with a part of its time, and a zone perhaps.
STAMP = r"^(\d{4}-\d{2}-\d{2})T(?:(\d{2})(?::(\d{2})(?::(\d{2})(?:\.(\d{1,}))?)?)?)?(Z|[+-]\d{2}:\d{2})?$"


def to_partial_date_time(x: Column) -> Column:
    """Of an ISO date, or date and time down to any part; in UTC. Null if it isn't one."""
    from asclepia.functions import temporal

    part = lambda i: F.nullif(F.regexp_extract(x, STAMP, i), F.lit(""))
    number = lambda i, most: F.when(part(i).isNull() | part(i).try_cast("int").between(0, most), F.coalesce(part(i).try_cast("int"), F.lit(0)))
    ms = F.coalesce(F.rpad(F.substring(part(5), 1, 3), 3, "0").try_cast("int"), F.lit(0))
    day = part(1).try_cast("date")
    prec = F.when(part(5).isNotNull(), 7).when(part(4).isNotNull(), 6).when(part(3).isNotNull(), 5).when(part(2).isNotNull(), 4).otherwise(3)
    total = ((number(2, 23).cast("bigint") * 60 + number(3, 59) - F.coalesce(offset_minutes(x), F.lit(0))) * 60 + number(4, 59)) * 1000 + ms
    lo = temporal.add_ms(day.cast("timestamp_ntz"), total)
    stamp = F.when(lo.isNotNull(), F.struct(lo.alias("lo"), F.when(prec == 3, temporal.add_ms(lo, F.lit(temporal.DAY_MS - 1))).otherwise(temporal.period_end(lo, prec)).alias("hi"), prec.cast("tinyint").alias("prec")))
    date_ = to_partial_date(x)
    last = date_["hi"].cast("timestamp_ntz") + F.expr("interval '0 23:59:59.999' day to second")
    whole = F.when(date_.isNotNull(), F.struct(date_["lo"].cast("timestamp_ntz").alias("lo"), last.alias("hi"), date_["prec"].alias("prec")))
    return F.when(F.regexp_like(x, F.lit(STAMP)), stamp).otherwise(whole)


def offset_minutes(x: Column) -> Column:
    """The zone at a date-time's end in minutes east of UTC; null without one or beyond 14 hours."""
    sign, hours, minutes = (F.regexp_extract(x, r"T.*(?:(Z)|([+-])(\d{2}):(\d{2}))$", i) for i in (2, 3, 4))
    size = hours.try_cast("int") * 60 + minutes.try_cast("int")
    return F.when(F.regexp_like(x, F.lit("T.*Z$")), 0).when(size <= 840, F.when(sign == "-", -size).otherwise(size))


def to_time(x: Column) -> Column:
    """Milliseconds of the day of [T]hh[:mm[:ss[.fff]]], a zone is ignored."""
    pattern = r"^T?(\d{2})(?::(\d{2})(?::(\d{2})(?:\.(\d{1,}))?)?)?(?:Z|[+-]\d{2}:\d{2})?$"
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(x, pattern, i), F.lit("")).try_cast("int"), F.lit(0))
    ms = F.rpad(F.substring(F.regexp_extract(x, pattern, 4), 1, 3), 3, "0").try_cast("int")
    right = F.regexp_like(x, F.lit(pattern)) & (part(1) < 24) & (part(2) < 60) & (part(3) < 60)
    return F.when(right, ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + F.coalesce(ms, F.lit(0)))


def quantity(value: Column, unit: Column | str | None = None) -> Column:
    u = F.lit(unit).cast("string") if unit is None or isinstance(unit, str) else unit
    return F.struct(value.cast("decimal(28,8)").alias("value"), u.alias("unit"))


def to_quantity(x: Column) -> Column:
    """Of "10 'mg'", "3 days" or "5"."""
    unit = F.coalesce(F.nullif(F.regexp_extract(x, _QUANTITY, 2), F.lit("")), F.nullif(F.regexp_extract(x, _QUANTITY, 3), F.lit("")))
    return F.when(F.regexp_like(x, F.lit(_QUANTITY)), quantity(F.regexp_extract(x, _QUANTITY, 1).try_cast("decimal(28,8)"), unit))


def to_ratio(x: Column) -> Column:
    """Of two quantities around a colon; anything else raises."""
    parts = F.split(x, ":")
    n, d = to_quantity(F.get(parts, F.lit(0))), to_quantity(F.get(parts, F.lit(1)))
    ratio = F.struct(n.alias("numerator"), d.alias("denominator"))
    good = (F.size(parts) == 2) & n.isNotNull() & d.isNotNull()
    return F.when(good, ratio).when(x.isNotNull(), F.when(F.raise_error(F.lit("not a ratio")).cast("boolean"), ratio))


def to_list(x: Column) -> Column:
    """Null gives an empty list."""
    return F.when(x.isNull(), F.slice(F.array(x), 1, 0)).otherwise(F.array(x))


def to_concept(code: Column) -> Column:
    return F.when(code.isNotNull(), F.struct(F.array(code).alias("codes"), code["display"].alias("display")))


_TO = {"Boolean": to_boolean, "Integer": to_integer, "Long": to_long, "Decimal": to_decimal, "String": to_string, "Date": to_date, "DateTime": to_date_time, "Time": to_time, "Quantity": to_quantity}


def convert(x: Column, kind: str) -> Column:
    return _TO[kind](x)


def converts_to(x: Column, kind: str) -> Column:
    """Whether a string converts; null for null."""
    if kind == "Ratio":
        parts = F.split(x, ":")
        return F.when(x.isNotNull(), (F.size(parts) == 2) & to_quantity(F.get(parts, F.lit(0))).isNotNull() & to_quantity(F.get(parts, F.lit(1))).isNotNull())
    return F.when(x.isNotNull(), _TO[kind](x).isNotNull())


can_convert = converts_to
