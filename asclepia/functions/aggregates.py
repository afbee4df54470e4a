"""Aggregates of a relation's groups, with the same contracts as the list forms; all are partial-aggregated before the shuffle
but those that need every value (median, mode counts, ordered folds)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMAL = "decimal(28,8)"


def count(x: Column) -> Column:
    return F.count(x).cast("int")


def sum_(x: Column, kind: str | None = None) -> Column:
    """``kind``: the declared type; a sum that doesn't fit raises."""
    return F.sum(x) if kind is None else F.sum(x).cast(kind)


def product(x: Column) -> Column:
    """To double precision; null if there is no value. The exact product of whole numbers needs two steps: operators.relations.product."""
    return F.product(x.cast("double"))


def min_(x: Column) -> Column:
    return F.min(x)


def max_(x: Column) -> Column:
    return F.max(x)


def avg(x: Column, kind: str = DECIMAL) -> Column:
    return F.avg(x.cast(kind)).cast(kind)


def geometric_mean(x: Column) -> Column:
    """Of positive values: a zero gives 0, a negative value null."""
    d = x.cast("double")
    return F.when(F.min(d) > 0, F.exp(F.avg(F.when(d > 0, F.log(d))))).when(F.min(d) == 0, F.lit(0.0))


def median(x: Column) -> Column:
    return F.median(x)


def mode(x: Column) -> Column:
    """Of equally frequent values the smallest."""
    return F.mode(x, True)


def variance(x: Column) -> Column:
    return F.when(F.count(x) > 1, F.var_samp(x))


def population_variance(x: Column) -> Column:
    return F.var_pop(x)


def std_dev(x: Column) -> Column:
    return F.when(F.count(x) > 1, F.round(F.stddev_samp(x), 8))


def population_std_dev(x: Column) -> Column:
    return F.round(F.stddev_pop(x), 8)


def all_true(x: Column) -> Column:
    return F.coalesce(F.bool_and(x), F.lit(True))


def any_true(x: Column) -> Column:
    return F.coalesce(F.bool_or(x), F.lit(False))


def fold(order: list[Column], value: Column, start: Column, body) -> Column:
    """A left fold in a given order: ``body(total, this)``. Needs a group's values together: for groups of bounded size.

    Folds that are sums, products, extremes or Boolean reductions should use those aggregates, see plans.folds."""
    rows = F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], value.alias("v"))))
    return F.aggregate(rows, start, lambda acc, r: body(acc, r["v"]))


def first(x: Column, order: Column) -> Column:
    return F.min_by(x, order)


def last(x: Column, order: Column) -> Column:
    return F.max_by(x, order)
