"""Intervals as struct<low, high, lowClosed, highClosed>; a null bound is open-ended or unknown, as each operator says.

``kind`` names the point type where the next or previous point matters: Integer, Long, Decimal, Date, DateTime, Time.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from asclepia.functions import arithmetic, temporal


def _null() -> Column:
    return F.lit(None).cast("boolean")


def interval(low: Column, high: Column, low_closed: bool | Column = True, high_closed: bool | Column = True, checked: bool = True) -> Column:
    """A low bound above the high one, or a point that excludes itself, raises; two null bounds give null."""
    lc, hc = (F.lit(x) if isinstance(x, bool) else x for x in (low_closed, high_closed))
    made = F.struct(low.alias("low"), high.alias("high"), lc.alias("lowClosed"), hc.alias("highClosed"))
    out = F.when(low.isNull() & high.isNull(), F.lit(None))
    if checked:
        wrong = (low > high) | ((low == high) & ~(lc & hc))
        out = out.when(wrong, F.when(F.raise_error(F.lit("invalid interval")).cast("boolean"), made))
    return out.otherwise(made)


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once for a row, however often the body names it, and inside functions of elements too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _trunc(i: Column, precision: str | None) -> Column:
    if precision is None:
        return i
    return i.withField("low", temporal.truncated(i["low"], precision)).withField("high", temporal.truncated(i["high"], precision))


def start(i: Column) -> Column:
    return i["low"]


def end(i: Column) -> Column:
    return i["high"]


def point_from(i: Column) -> Column:
    """Only of [x, x]; else null."""
    return F.when(i["lowClosed"] & i["highClosed"] & (i["low"] == i["high"]), i["low"])


def width(i: Column) -> Column:
    return i["high"] - i["low"]


def size(i: Column) -> Column:
    """Points in an integer interval, not below 0; null if a bound is."""
    points = i["high"] - i["low"] + F.when(i["lowClosed"], 1).otherwise(0) - F.when(i["highClosed"], 0).otherwise(1)
    return F.when(points.isNotNull(), F.greatest(points, F.lit(0)))


def first_point(i: Column, kind: str) -> Column:
    return F.when(i["lowClosed"], i["low"]).otherwise(arithmetic.successor(i["low"], kind))


def last_point(i: Column, kind: str) -> Column:
    return F.when(i["highClosed"], i["high"]).otherwise(arithmetic.predecessor(i["high"], kind))


def contains(i: Column, p: Column) -> Column:
    """A null interval contains nothing; a null point is unknown; a null bound doesn't limit."""
    above = i["low"].isNull() | (p > i["low"]) | (i["lowClosed"] & (p == i["low"]))
    below = i["high"].isNull() | (p < i["high"]) | (i["highClosed"] & (p == i["high"]))
    return F.when(i.isNull(), F.lit(False)).when(p.isNull(), _null()).otherwise(above & below)


def in_(p: Column, i: Column) -> Column:
    return contains(i, p)


def _starts_by(a: Column, b: Column) -> Column:
    """Whether ``a`` starts no later than ``b``; a null bound of ``a`` doesn't limit."""
    return a["low"].isNull() | (a["low"] < b["low"]) | ((a["low"] == b["low"]) & (a["lowClosed"] | ~b["lowClosed"]))


def _ends_by(a: Column, b: Column) -> Column:
    """Whether ``a`` ends no earlier than ``b``."""
    return a["high"].isNull() | (a["high"] > b["high"]) | ((a["high"] == b["high"]) & (a["highClosed"] | ~b["highClosed"]))


def includes(a: Column, b: Column, precision: str | None = None) -> Column:
    a, b = _trunc(a, precision), _trunc(b, precision)
    return F.when(a.isNotNull() & b.isNotNull(), _starts_by(a, b) & _ends_by(a, b))


def included_in(a: Column, b: Column, precision: str | None = None) -> Column:
    return includes(b, a, precision)


def equal(a: Column, b: Column) -> Column:
    same = (a["low"] == b["low"]) & (a["high"] == b["high"]) & (a["lowClosed"] == b["lowClosed"]) & (a["highClosed"] == b["highClosed"])
    return F.when(a.isNotNull() & b.isNotNull(), same)


def proper_contains(i: Column, p: Column) -> Column:
    """As contains."""
    return contains(i, p)


def proper_in(p: Column, i: Column) -> Column:
    return F.when(i.isNotNull(), contains(i, p))


def proper_includes(a: Column, b: Column, precision: str | None = None) -> Column:
    a, b = _trunc(a, precision), _trunc(b, precision)
    return includes(a, b) & ~equal(a, b)


def proper_included_in(a: Column, b: Column, precision: str | None = None) -> Column:
    return proper_includes(b, a, precision)


def before(a: Column, b: Column, precision: str | None = None) -> Column:
    """``a`` ends before ``b`` starts; bounds that touch count if one of them is open; a null bound is unknown."""
    a, b = _trunc(a, precision), _trunc(b, precision)
    return (a["high"] < b["low"]) | ((a["high"] == b["low"]) & ~(a["highClosed"] & b["lowClosed"]))


def after(a: Column, b: Column, precision: str | None = None) -> Column:
    return before(b, a, precision)


def before_point(i: Column, p: Column) -> Column:
    return (i["high"] < p) | ((i["high"] == p) & ~i["highClosed"])


def after_point(i: Column, p: Column) -> Column:
    return (i["low"] > p) | ((i["low"] == p) & ~i["lowClosed"])


def meets_before(a: Column, b: Column, kind: str = "Integer") -> Column:
    """The point after ``a`` is the first of ``b``, or they share a bound that only one of them holds."""
    touch = (a["high"] == b["low"]) & (a["highClosed"] != b["lowClosed"])
    return touch | (a["highClosed"] & b["lowClosed"] & (arithmetic.successor(a["high"], kind) == b["low"]))


def meets_after(a: Column, b: Column, kind: str = "Integer") -> Column:
    return meets_before(b, a, kind)


def meets(a: Column, b: Column, kind: str = "Integer") -> Column:
    return meets_before(a, b, kind) | meets_after(a, b, kind)


def overlaps(a: Column, b: Column) -> Column:
    return ~before(a, b) & ~after(a, b)


def overlaps_before(a: Column, b: Column) -> Column:
    earlier = (a["low"] < b["low"]) | ((a["low"] == b["low"]) & a["lowClosed"] & ~b["lowClosed"])
    return overlaps(a, b) & earlier & _ends_by(b, a)


def overlaps_after(a: Column, b: Column) -> Column:
    later = (a["high"] > b["high"]) | ((a["high"] == b["high"]) & a["highClosed"] & ~b["highClosed"])
    return overlaps(a, b) & later & _starts_by(b, a)


def starts(a: Column, b: Column) -> Column:
    return (a["low"] == b["low"]) & (a["lowClosed"] == b["lowClosed"]) & includes(b, a)


def ends(a: Column, b: Column) -> Column:
    return (a["high"] == b["high"]) & (a["highClosed"] == b["highClosed"]) & includes(b, a)


def _from(low: Column, high: Column, lc: Column, hc: Column) -> Column:
    return F.struct(low.alias("low"), high.alias("high"), lc.alias("lowClosed"), hc.alias("highClosed"))


def union(a: Column, b: Column, kind: str = "Integer") -> Column:
    """Null unless they overlap or meet."""
    first = F.when(_starts_by(a, b), a).otherwise(b)
    last = F.when(_ends_by(a, b), a).otherwise(b)
    return F.when(overlaps(a, b) | meets(a, b, kind), _from(first["low"], last["high"], first["lowClosed"], last["highClosed"]))


def intersect(a: Column, b: Column) -> Column:
    """Null if they have no point in common."""
    first = F.when(_starts_by(a, b), b).otherwise(a)
    last = F.when(_ends_by(a, b), b).otherwise(a)
    return F.when(overlaps(a, b), _from(first["low"], last["high"], first["lowClosed"], last["highClosed"]))


def except_(a: Column, b: Column, kind: str = "Integer") -> Column:
    """What of ``a`` lies outside ``b``, if that is one interval; cut ends are closed at the neighbouring point."""
    left = overlaps(a, b) & ~_starts_by(b, a) & _ends_by(b, a)
    right = overlaps(a, b) & _starts_by(b, a) & ~_ends_by(b, a)
    cut_high = F.when(b["lowClosed"], arithmetic.predecessor(b["low"], kind)).otherwise(b["low"])
    cut_low = F.when(b["highClosed"], arithmetic.successor(b["high"], kind)).otherwise(b["high"])
    closed = F.lit(True)
    return F.when(~overlaps(a, b), a).when(left, _from(a["low"], cut_high, a["lowClosed"], closed)).when(right, _from(cut_low, a["high"], closed, a["highClosed"]))


def collapse(items: Column, kind: str = "Integer") -> Column:
    """Intervals in a list, overlapping and adjacent ones merged, in order; closed at their first and last points. Nulls are skipped.

    A null bound doesn't limit: such an interval takes in all that come after, or before.
    """
    def reach(high: Column) -> Column:
        if kind == "Time":
            return high + 1
        most = F.lit(arithmetic.MAXIMUM[kind]).cast(arithmetic._SPARK[kind])
        return F.when(high < most, arithmetic.successor(high, kind)).otherwise(high)

    return _merged(items, kind, reach)


def _merged(items: Column, kind: str, reach: Callable[[Column], Column]) -> Column:
    """``reach(high)`` is the last low that still joins."""
    points = F.filter(items, lambda i: i.isNotNull())
    closed = F.sort_array(F.transform(points, lambda i: F.struct(first_point(i, kind).alias("low"), last_point(i, kind).alias("high"))))

    made = lambda x: F.struct(x["low"].alias("low"), x["high"].alias("high"), F.lit(True).alias("lowClosed"), F.lit(True).alias("highClosed"))

    def step(acc: Column, x: Column) -> Column:
        """``acc`` has the interval that still grows apart from those before it, which are copied only when it ends."""
        last = acc["last"]
        high = F.when(last["high"].isNotNull() & x["high"].isNotNull(), F.greatest(last["high"], x["high"]))
        grown = F.struct(acc["done"].alias("done"), F.struct(last["low"].alias("low"), high.alias("high")).alias("last"))
        meets_ = F.coalesce(x["low"] <= reach(last["high"]), x["low"].isNull() | last["high"].isNull())
        return F.when(meets_, grown).otherwise(F.struct(F.concat(acc["done"], F.array(made(last))).alias("done"), x.alias("last")))

    def merged(closed: Column) -> Column:
        start_ = F.struct(F.transform(F.slice(closed, 1, 0), made).alias("done"), F.get(closed, F.lit(0)).alias("last"))
        ended = lambda acc: F.when(acc["last"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(made(acc["last"]))))
        return F.aggregate(F.slice(closed, 2, F.greatest(F.size(closed) - 1, F.lit(0))), start_, step, ended)

    return _once(closed, merged)


#: A step in a unit that has no fixed length is so many days (the model's own approximations).
_DAYS = {"year": 365, "month": 30, "week": 7, "day": 1}


def _step(kind: str, step: Column | int, unit: str | None) -> tuple[Column, str]:
    """The step as a number of the points' own smallest unit, which it is given with."""
    n = F.lit(step) if isinstance(step, (int, Decimal)) else step
    if kind == "Date":
        p = temporal.unit(unit or "day")
        return (n * _DAYS[p] if p in _DAYS else n / (temporal.DAY_MS // (temporal._MICROS[p] // 1000))).cast("int"), "day"
    if kind in ("DateTime", "Time"):
        p = temporal.unit(unit or ("day" if kind == "DateTime" else "hour"))
        return (n * (_DAYS[p] * temporal.DAY_MS if p in _DAYS else temporal._MICROS[p] // 1000)).cast("bigint"), "millisecond"
    return n, ""


def expand(i: Column, step: Column | int | Decimal = 1, kind: str = "Integer", unit: str | None = None) -> Column:
    """The points of an interval, ``step`` apart, full steps only; a null bound, or a step that isn't above 0, gives null.

    ``unit`` is the step's for temporals: days for dates and date-times and hours for times unless it says otherwise; for dates and date-times months and years
    are steps of the calendar. Decimal points are ``step`` apart from the first one on.
    """
    def ends(i: Column) -> Column:
        bounds = F.struct(first_point(i, kind).alias("low"), last_point(i, kind).alias("high"))
        return _once(bounds, lambda x: _points(x["low"], x["high"], step, kind, unit))

    return _once(i, ends)


def _points(low: Column, high: Column, step: Column | int | Decimal, kind: str, unit: str | None) -> Column:
    """Bounds are elements of a value bound by :func:`_once`: each point names them again."""
    n, base = _step(kind, step, unit)
    none = F.slice(F.array(low), 1, 0)
    calendar = unit is not None and kind in ("Date", "DateTime") and temporal.unit(unit) in ("year", "month")
    if calendar:
        months = (F.lit(step) if isinstance(step, (int, Decimal)) else step).cast("int") * (12 if temporal.unit(unit) == "year" else 1)
        at = (lambda k: F.add_months(low, (k * months).cast("int"))) if kind == "Date" else (lambda k: temporal.add(low, (k * months).cast("int"), "month"))
        after = F.date_add(high, 1) if kind == "Date" else high + F.expr("interval '0.001' second")
        count = F.call_function("div", temporal.duration_between(low, after, "month"), months).cast("int")
        n = months
    elif kind == "Date":
        at, count = (lambda k: F.date_add(low, (k * n).cast("int"))), F.floor((F.datediff(high, low) + 1) / n).cast("int")
    elif kind == "DateTime":
        span = temporal.duration_between_ms(low, high) + 1
        at, count = (lambda k: temporal.add_ms(low, k.cast("bigint") * n)), F.floor(span / n).cast("int")
    elif kind == "Decimal":
        size_ = arithmetic.decimal(n)
        at, count = (lambda k: arithmetic.decimal(low + k * size_)), (F.floor((high - low + F.lit(arithmetic.STEP)) / size_)).cast("int")
        n = size_
    else:
        own = "int" if kind in ("Integer", "Time") else "bigint"
        size_ = n.cast("bigint")
        at, count = (lambda k: (low + k * size_).cast(own)), F.floor((high.cast("bigint") - low + 1) / size_).cast("int")
        n = size_
    some = low.isNotNull() & high.isNotNull() & (n > 0)

    def points(count: Column) -> Column:
        if kind in ("Integer", "Long", "Time"):
            first = low.cast("bigint")
            return F.sequence(first, first + (count - 1) * size_, size_).cast(f"array<{own}>")
        return F.transform(F.sequence(F.lit(0), count - 1), at)

    return _once(F.when(some, count), lambda k: F.when(k > 0, points(k)).when(k.isNotNull(), none))


def expand_intervals(i: Column, step: Column | int | Decimal = 1, kind: str = "Integer", unit: str | None = None) -> Column:
    """As :func:`expand`, but each step as a closed interval of its points."""
    n, _ = _step(kind, step, unit)
    calendar = unit is not None and kind in ("Date", "DateTime") and temporal.unit(unit) in ("year", "month")

    def upto(p: Column) -> Column:
        if calendar:
            months = (F.lit(step) if isinstance(step, (int, Decimal)) else step).cast("int") * (12 if temporal.unit(unit) == "year" else 1)
            return F.date_sub(F.add_months(p, months), 1) if kind == "Date" else temporal.add_ms(temporal.add(p, months, "month"), F.lit(-1))
        if kind == "Date":
            return F.date_add(p, (n - 1).cast("int"))
        if kind == "DateTime":
            return temporal.add_ms(p, n - 1)
        if kind == "Decimal":
            return arithmetic.decimal(p + arithmetic.decimal(n) - F.lit(arithmetic.STEP))
        return (p + n.cast("bigint") - 1).cast("bigint" if kind == "Long" else "int")

    return F.transform(expand(i, step, kind, unit), lambda p: F.struct(p.alias("low"), upto(p).alias("high"), F.lit(True).alias("lowClosed"), F.lit(True).alias("highClosed")))


def collapse_per(items: Column, step: Column, kind: str, unit: str | None = None) -> Column:
    """As :func:`collapse`, but intervals up to a step apart join, too: gaps smaller than ``step`` are closed."""

    def reach(x: Column) -> Column:
        if kind in ("Date", "DateTime") and unit is not None:
            return temporal.add(x, step, unit, kind)
        n, _ = _step(kind, step, unit)
        return arithmetic.decimal(x + n) if kind == "Decimal" else (x + n)

    return _merged(items, kind, reach)


def add(a: Column, b: Column) -> Column:
    """Sum of two uncertain integers."""
    return _from(a["low"] + b["low"], a["high"] + b["high"], F.lit(True), F.lit(True))


def subtract(a: Column, b: Column) -> Column:
    return _from(a["low"] - b["high"], a["high"] - b["low"], F.lit(True), F.lit(True))


def multiply(a: Column, b: Column) -> Column:
    """Product of two uncertain integers; null if a bound is."""
    four = [a[x] * b[y] for x in ("low", "high") for y in ("low", "high")]
    some = a["low"].isNotNull() & a["high"].isNotNull() & b["low"].isNotNull() & b["high"].isNotNull()
    return F.when(some, _from(F.least(*four), F.greatest(*four), F.lit(True), F.lit(True)))
