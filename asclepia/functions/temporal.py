"""Dates, date-times and times of full precision as Spark's own types (time: milliseconds of the day), and partial ones as structs.

A partial value is struct<lo, hi, prec>: the first and last moment that it may be and the number of its components (1 year to 7
milliseconds). Two partial values compare by their ranges: unknown where they overlap and aren't the same.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRECISIONS = ("year", "month", "day", "hour", "minute", "second", "millisecond")
DAY_MS = 86_400_000
# The unit words and codes of durations.
UNITS = {
    "year": "year", "years": "year", "a": "year", "month": "month", "months": "month", "mo": "month", "week": "week", "weeks": "week", "wk": "week",
    "day": "day", "days": "day", "d": "day", "hour": "hour", "hours": "hour", "h": "hour", "minute": "minute", "minutes": "minute", "min": "minute",
    "second": "second", "seconds": "second", "s": "second", "millisecond": "millisecond", "milliseconds": "millisecond", "ms": "millisecond",
}
_MICROS = {"week": 604_800_000_000, "day": 86_400_000_000, "hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000, "millisecond": 1_000}


def unit(name: str) -> str:
    if name.lower() not in UNITS:
        raise ValueError(f"not a unit of time: {name}")
    return UNITS[name.lower()]


def date(year: Column, month: Column, day: Column) -> Column:
    """Years are 1 to 9999; a day that doesn't exist raises; a null part gives null."""
    wrong = F.raise_error(F.lit("year out of range")).cast("date")
    return F.when(year.isNull() | month.isNull() | day.isNull(), F.lit(None).cast("date")).when((year < 1) | (year > 9999), wrong).otherwise(F.make_date(year, month, day))


def date_time(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column, ms: Column | None = None) -> Column:
    seconds = second.cast("decimal(16,6)")
    if ms is not None:
        right = F.when(ms.between(0, 999), ms).when(ms.isNotNull(), F.raise_error(F.lit("time out of range")).cast("int"))
        seconds = (second + right / 1000.0).cast("decimal(16,6)")
    return F.make_timestamp_ntz(year, month, day, hour, minute, seconds)


def time(hour: Column, minute: Column | None = None, second: Column | None = None, ms: Column | None = None) -> Column:
    zero = F.lit(0)
    m, s, k = (zero if x is None else x for x in (minute, second, ms))
    out = ((hour * 60 + m) * 60 + s) * 1000 + k
    right = hour.between(0, 23) & m.between(0, 59) & s.between(0, 59) & k.between(0, 999)
    return F.when(right, out).when(~right, F.raise_error(F.lit("time out of range")).cast("int"))


def date_from(x: Column) -> Column:
    return F.to_date(x)


def time_from(x: Column) -> Column:
    return ((F.hour(x) * 60 + F.minute(x)) * 60 + F.second(x)) * 1000 + milliseconds(x)


def milliseconds(x: Column) -> Column:
    return F.pmod(F.floor(_micros(x) / 1000), F.lit(1000)).cast("int")


def timezone_text(offset_minutes: Column) -> Column:
    """+HH:MM of an offset in minutes."""
    size = F.abs(offset_minutes)
    return F.concat(F.when(offset_minutes < 0, "-").otherwise("+"), F.lpad(F.floor(size / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((size % 60).cast("string"), 2, "0"))


def timezone_offset(offset_minutes: Column) -> Column:
    return (offset_minutes / 60).cast("decimal(28,8)")


def component(x: Column, name: str) -> Column:
    if name == "millisecond":
        return milliseconds(x)
    return getattr(F, {"day": "day", "year": "year", "month": "month", "hour": "hour", "minute": "minute", "second": "second"}[name])(x)


def time_component(ms: Column, name: str) -> Column:
    size, most = {"hour": (3_600_000, 24), "minute": (60_000, 60), "second": (1000, 60), "millisecond": (1, 1000)}[name]
    return (F.floor(ms / size) % most).cast("int")


def _micros(x: Column) -> Column:
    return F.unix_micros(x.cast("timestamp"))


def duration_between(a: Column, b: Column, precision: str) -> Column:
    """Whole periods elapsed from ``a`` to ``b``, negative if ``b`` is earlier."""
    p = unit(precision)
    if p in ("year", "month"):
        months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
        # The last month counts once the day and time of the start are reached again, seen from the earlier end.
        rest = lambda x: F.day(x).cast("long") * 86_400_000_000 + F.pmod(_micros(x), F.lit(86_400_000_000))
        whole = months - F.when((months > 0) & (rest(b) < rest(a)), 1).when((months < 0) & (rest(b) > rest(a)), -1).otherwise(0)
        return (whole if p == "month" else F.call_function("div", whole, F.lit(12))).cast("int")
    return F.call_function("div", _micros(b) - _micros(a), F.lit(_MICROS[p])).cast("int")


def duration_between_ms(a: Column, b: Column) -> Column:
    return F.call_function("div", _micros(b) - _micros(a), F.lit(1000))


def add_ms(x: Column, ms: Column) -> Column:
    return x + F.make_dt_interval(secs=(ms.cast("decimal(18,0)") / 1000).cast("decimal(18,6)"))


def difference_between(a: Column, b: Column, precision: str) -> Column:
    """Boundaries crossed: of years, months, weeks (Sundays) and days; below that, of the truncated moments."""
    p = unit(precision)
    if p == "year":
        return F.year(b) - F.year(a)
    if p == "month":
        return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    if p == "day":
        return F.datediff(b, a)
    if p == "week":
        sunday = lambda x: F.date_sub(F.to_date(x), F.dayofweek(x) - 1)
        return F.call_function("div", F.datediff(sunday(b), sunday(a)), F.lit(7)).cast("int")
    size = F.lit(_MICROS[p])
    return (F.floor(_micros(b) / size) - F.floor(_micros(a) / size)).cast("int")


def truncated(x: Column, precision: str) -> Column:
    return F.date_trunc(unit(precision), x)


def same_as(a: Column, b: Column, precision: str | None = None) -> Column:
    return a == b if precision is None else truncated(a, precision) == truncated(b, precision)


def same_or_before(a: Column, b: Column, precision: str | None = None) -> Column:
    return a <= b if precision is None else truncated(a, precision) <= truncated(b, precision)


def same_or_after(a: Column, b: Column, precision: str | None = None) -> Column:
    return a >= b if precision is None else truncated(a, precision) >= truncated(b, precision)


def before(a: Column, b: Column, precision: str | None = None) -> Column:
    return a < b if precision is None else truncated(a, precision) < truncated(b, precision)


def after(a: Column, b: Column, precision: str | None = None) -> Column:
    return a > b if precision is None else truncated(a, precision) > truncated(b, precision)


def add(x: Column, amount: Column, precision: str, kind: str = "DateTime") -> Column:
    """Calendar arithmetic; fractions of the amount are cut off, days past a month's end become its last day.

    A date takes hours as whole days of 24 and ignores minutes and below; a time wraps around midnight and ignores days and above.
    """
    p, n = unit(precision), amount.cast("int")
    if kind == "Time":
        return x if p in ("year", "month", "week", "day") else F.pmod(x + n * F.lit(_MICROS[p] // 1000), F.lit(DAY_MS)).cast("int")
    if kind == "Date":
        if p in ("year", "month"):
            return F.add_months(x, n * (12 if p == "year" else 1))
        if p in ("week", "day"):
            return F.date_add(x, n * (7 if p == "week" else 1))
        return F.date_add(x, F.call_function("div", n, F.lit(24)).cast("int")) if p == "hour" else x
    if p in ("year", "month"):
        return x + F.make_ym_interval(months=n * (12 if p == "year" else 1))
    return x + F.make_dt_interval(secs=(n.cast("decimal(18,6)") * F.lit(_MICROS[p]).cast("decimal(18,0)") / 1_000_000).cast("decimal(18,6)"))


def subtract(x: Column, amount: Column, precision: str, kind: str = "DateTime") -> Column:
    return add(x, -amount, precision, kind)


# Partial values.

#: The number of components that a unit of time needs.
COMPONENTS = {"year": 1, "month": 2, "week": 3, "day": 3, "hour": 4, "minute": 5, "second": 6, "millisecond": 7}
#: How many of a finer unit make one of a coarser one where the calendar can't tell (fixed values of the model).
_PER = {"year": {"month": 12, "week": 52, "day": 365, "hour": 8_760}, "month": {"week": 4, "day": 30, "hour": 720}, "day": {"hour": 24}}


def _per(coarse: str, fine: str) -> int:
    if coarse in ("year", "month", "day") and fine in _PER[coarse]:
        return _PER[coarse][fine]
    if coarse in ("year", "month", "day"):
        return _PER[coarse]["hour"] * (_MICROS["hour"] // _MICROS[fine])
    return _MICROS[coarse] // _MICROS[fine]


def period_end(lo: Column, prec: Column, kind: str = "DateTime") -> Column:
    """The last moment of the period of precision ``prec`` that begins at ``lo``."""
    if kind == "Time":
        return F.when(prec == 4, lo + 3_599_999).when(prec == 5, lo + 59_999).when(prec == 6, lo + 999).otherwise(lo).cast("int")
    if kind == "Date":
        return F.when(prec == 1, F.make_date(F.year(lo), F.lit(12), F.lit(31))).when(prec == 2, F.last_day(lo)).otherwise(lo)
    last_day = F.when(prec == 1, F.make_date(F.year(lo), F.lit(12), F.lit(31))).when(prec == 2, F.last_day(F.to_date(lo))).otherwise(F.to_date(lo))
    day_end = last_day.cast("timestamp_ntz") + F.expr("interval '0 23:59:59.999' day to second")
    return F.when(prec <= 3, day_end).when(prec == 4, add_ms(lo, F.lit(3_599_999))).when(prec == 5, add_ms(lo, F.lit(59_999))).when(prec == 6, add_ms(lo, F.lit(999))).otherwise(lo)


def add_partial(x: Column, amount: Column, precision: str, kind: str = "DateTime") -> Column:
    """Calendar arithmetic on a value of which not all is known: it stays as precise as it is.

    An amount in a finer unit counts in whole units of that precision: 12 months or 365 days a year, 30 days a month.
    """
    p, n = unit(precision), amount.cast("int")
    prec = x["prec"]
    lo = F.when(prec >= COMPONENTS[p], add(x["lo"], n, p, kind))
    for k, coarse in enumerate(PRECISIONS, 1):
        if k < COMPONENTS[p] and not (kind == "Time" and k < 4) and not (kind == "Date" and k > 3):
            lo = lo.when(prec == k, add(x["lo"], F.call_function("div", n, F.lit(_per(coarse, p))).cast("int"), coarse, kind))
    return F.when(x.isNotNull() & n.isNotNull(), F.struct(lo.alias("lo"), period_end(lo, prec, kind).alias("hi"), prec.alias("prec")))


def step_partial(x: Column, by: int, kind: str = "DateTime") -> Column:
    """The next (1) or previous (-1) value of the same precision; beyond the first or last one raises."""
    lo = None
    for k, p in enumerate(PRECISIONS, 1):
        if (kind == "Time" and k < 4) or (kind == "Date" and k > 3):
            continue
        moved = x["lo"] + by * (_MICROS[p] // 1000) if kind == "Time" else add(x["lo"], F.lit(by), p, kind)
        lo = F.when(x["prec"] == k, moved) if lo is None else lo.when(x["prec"] == k, moved)
    if kind == "Time":
        wrong, raised = ~lo.between(0, DAY_MS - 1), "int"
    else:
        wrong, raised = ~F.year(lo).between(1, 9999), "date" if kind == "Date" else "timestamp_ntz"
    word = "predecessor of the first" if by < 0 else "successor of the last"
    lo = F.when(wrong, F.raise_error(F.lit(f"{word} {'date' if kind == 'Date' else 'time'}")).cast(raised)).otherwise(lo).cast(raised)
    return F.when(x.isNotNull(), F.struct(lo.alias("lo"), period_end(lo, x["prec"], kind).alias("hi"), x["prec"].alias("prec")))


def partial_date(year: Column, month: Column | None = None, day: Column | None = None) -> Column:
    one = F.lit(1)
    lo = F.make_date(year, one if month is None else F.coalesce(month, one), one if day is None else F.coalesce(day, one))
    last_month = F.lit(12) if month is None else F.coalesce(month, F.lit(12))
    end = F.last_day(F.make_date(year, last_month, one))
    hi = end if day is None else F.coalesce(F.make_date(year, last_month, day), end)
    prec = F.lit(1) if month is None else F.when(month.isNull(), 1).when(F.lit(None).cast("int").isNull() if day is None else day.isNull(), 2).otherwise(3)
    return F.when(year.isNotNull(), F.struct(lo.alias("lo"), hi.alias("hi"), prec.cast("tinyint").alias("prec")))


def as_partial(x: Column, precision: int = 7) -> Column:
    return F.when(x.isNotNull(), F.struct(x.alias("lo"), x.alias("hi"), F.lit(precision).cast("tinyint").alias("prec")))


def partial_equal(a: Column, b: Column) -> Column:
    apart = (a["hi"] < b["lo"]) | (b["hi"] < a["lo"])
    return F.when(apart, False).when(a["prec"] == b["prec"], a["lo"] == b["lo"])


def partial_less(a: Column, b: Column) -> Column:
    return F.when(a["hi"] < b["lo"], True).when(b["hi"] < a["lo"], False).when(a["prec"] == b["prec"], F.lit(False))


def partial_less_or_equal(a: Column, b: Column) -> Column:
    return F.when(a["hi"] < b["lo"], True).when(b["hi"] < a["lo"], False).when(a["prec"] == b["prec"], F.lit(True))


def partial_duration(a: Column, b: Column, precision: str) -> Column:
    """An interval of the least and the greatest duration; a point if they agree."""
    low, high = duration_between(a["hi"], b["lo"], precision), duration_between(a["lo"], b["hi"], precision)
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(low.alias("low"), high.alias("high"), F.lit(True).alias("lowClosed"), F.lit(True).alias("highClosed")))


def precision_digits(a: Column) -> Column:
    """4 for a year, 6, 8, 10, 12, 14, and 17 with milliseconds."""
    return F.when(a["prec"] == 7, 17).otherwise(a["prec"] * 2 + 2).cast("int")


def low_boundary(a: Column) -> Column:
    return a["lo"]


def high_boundary(a: Column) -> Column:
    return a["hi"]
