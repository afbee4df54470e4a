"""List operators on arrays: order and duplicates matter, nulls are elements and match each other."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _has(items: Column, x: Column) -> Column:
    return F.coalesce(F.exists(items, lambda e: e.eqNullSafe(x)), F.lit(False))


def list_(*items: Column) -> Column:
    return F.array(*items)


def exists(items: Column) -> Column:
    """Whether any element isn't null; null has none."""
    return F.coalesce(F.exists(items, lambda x: x.isNotNull()), F.lit(False))


def times(a: Column, b: Column, left: str = "X", right: str = "Y") -> Column:
    """All pairs, left-major."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.struct(x.alias(left), y.alias(right)))))


def filter_(items: Column, condition) -> Column:
    """``condition(this)`` or ``condition(this, index)``; only true keeps."""
    return F.filter(items, condition)


def for_each(items: Column, body) -> Column:
    return F.transform(items, body)


def first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def indexer(items: Column, i: Column) -> Column:
    return F.get(items, i)


def slice_(items: Column, start: Column | int, end: Column | int | None = None) -> Column:
    """From ``start`` to before ``end`` (None: to the end), clamped; a null end column gives an empty list, a null start is 0."""
    s = F.greatest(F.coalesce(F.lit(start) if isinstance(start, int) else start, F.lit(0)), F.lit(0))
    e = F.size(items) if end is None else F.least(F.coalesce(F.lit(end) if isinstance(end, int) else end, F.lit(0)), F.size(items))
    return F.slice(items, (s + 1).cast("int"), F.greatest(e - s, F.lit(0)).cast("int"))


def take(items: Column, n: Column | int) -> Column:
    return slice_(items, 0, n)


def skip(items: Column, n: Column | int) -> Column:
    return slice_(items, n)


def tail(items: Column) -> Column:
    return slice_(items, 1)


def index_of(items: Column, x: Column) -> Column:
    """-1 if absent; a null list or element gives null."""
    return F.when(items.isNotNull() & x.isNotNull(), (F.array_position(items, x) - 1).cast("int"))


def contains(items: Column, x: Column) -> Column:
    return _has(items, x)


def in_(x: Column, items: Column) -> Column:
    return _has(items, x)


def includes(a: Column, b: Column) -> Column:
    return F.forall(b, lambda y: _has(a, y))


def included_in(a: Column, b: Column) -> Column:
    return includes(b, a)


def proper_includes(a: Column, b: Column) -> Column:
    return includes(a, b) & (F.size(F.array_distinct(a)) > F.size(F.array_distinct(b)))


def proper_included_in(a: Column, b: Column) -> Column:
    return proper_includes(b, a)


def flatten(items: Column) -> Column:
    """One level; null lists are skipped."""
    return F.flatten(F.filter(items, lambda x: x.isNotNull()))


def sort(items: Column, descending: bool = False) -> Column:
    """Nulls first, descending last."""
    return F.sort_array(items, not descending)


def distinct(items: Column) -> Column:
    """First occurrences, in order; one null."""
    return F.array_distinct(items)


def union(a: Column, b: Column) -> Column:
    """The left list as it is, then what it lacks of the right one; null is empty."""
    empty = lambda x, y: F.coalesce(x, F.slice(y, 1, 0))
    a, b = empty(a, b), empty(b, a)
    return F.concat(a, F.filter(F.array_distinct(b), lambda y: ~_has(a, y)))


def intersect(a: Column, b: Column) -> Column:
    """Distinct, in the left order."""
    return F.array_intersect(a, b)


def except_(a: Column, b: Column) -> Column:
    """What of the left list the right one lacks, duplicates kept; a null right list takes nothing away."""
    return F.filter(a, lambda x: ~_has(b, x))


def singleton_from(items: Column) -> Column:
    """None gives null, one itself, more raise."""
    one = F.get(items, F.lit(0))
    return F.when(F.size(items) > 1, F.when(F.raise_error(F.lit("more than one element")).cast("boolean"), one)).otherwise(one)


def _unseen(items: Column, seen: Column) -> Column:
    return F.filter(items, lambda x: ~_has(seen, x))


def repeat(items: Column, body, rounds: int) -> Column:
    """What ``body`` (element to list) adds round by round, up to ``rounds``; for closures of any depth see operators.repeat."""
    step = lambda seen: F.concat(seen, _unseen(F.array_distinct(F.flatten(F.transform(seen, body))), seen))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), items, lambda seen, _: step(seen))


# Aggregates over a list in a row: nulls are ignored, a null list gives null unless noted.


def _some(items: Column) -> Column:
    return F.filter(items, lambda x: x.isNotNull())


def aggregate(items: Column, start: Column, body) -> Column:
    """Left fold; ``body(total, this)``."""
    return F.aggregate(items, start, body)


def count(items: Column) -> Column:
    """Elements that aren't null; 0 for null."""
    return F.coalesce(F.size(_some(items)), F.lit(0))


def _fold(items: Column, body) -> Column:
    some = _some(items)
    head = F.get(some, F.lit(0))
    return F.when(F.size(some) > 0, F.aggregate(F.slice(some, 2, F.greatest(F.size(some) - 1, F.lit(0))), head, body))


def sum_(items: Column) -> Column:
    return _fold(items, lambda a, x: a + x)


def product(items: Column) -> Column:
    return _fold(items, lambda a, x: a * x)


def min_(items: Column) -> Column:
    return F.array_min(items)


def max_(items: Column) -> Column:
    return F.array_max(items)


def avg(items: Column, kind: str = "decimal(28,8)") -> Column:
    total = F.aggregate(_some(items), F.lit(0).cast(kind), lambda a, x: (a + x.cast(kind)).cast(kind))
    return F.try_divide(total, F.size(_some(items))).cast(kind)


def geometric_mean(items: Column) -> Column:
    doubles = _some(F.transform(items, lambda x: x.cast("double")))
    return F.when(F.size(doubles) > 0, F.pow(product(doubles), F.lit(1.0) / F.size(doubles)))


def median(items: Column, kind: str = "decimal(28,8)") -> Column:
    s = F.array_sort(_some(items))
    n = F.size(s)
    low, high = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n > 0, ((low.cast(kind) + high.cast(kind)) / 2).cast(kind))


def mode(items: Column) -> Column:
    """The most frequent element, of equally frequent ones the smallest."""
    some = F.array_sort(_some(items))
    counts = F.transform(F.array_distinct(some), lambda x: F.struct(F.size(F.filter(some, lambda y: y == x)).alias("n"), x.alias("x")))
    most = F.array_max(F.transform(counts, lambda c: c["n"]))
    return F.get(F.filter(counts, lambda c: c["n"] == most), F.lit(0))["x"]


def _variance(items: Column, less: int) -> Column:
    d = _some(F.transform(items, lambda x: x.cast("double")))
    n = F.size(d)
    mean = F.try_divide(sum_(d), n.cast("double"))
    squares = F.aggregate(d, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.when(n > less, squares / (n - less))


def variance(items: Column) -> Column:
    return _variance(items, 1)


def population_variance(items: Column) -> Column:
    return _variance(items, 0)


def std_dev(items: Column) -> Column:
    return F.round(F.sqrt(variance(items)), 8)


def population_std_dev(items: Column) -> Column:
    return F.round(F.sqrt(population_variance(items)), 8)


def all_true(items: Column) -> Column:
    """True for null and empty."""
    return F.coalesce(F.forall(_some(items), lambda x: x), F.lit(True))


def any_true(items: Column) -> Column:
    """False for null and empty."""
    return F.coalesce(F.exists(_some(items), lambda x: x), F.lit(False))
