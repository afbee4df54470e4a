"""The query construct as a DataFrame pipeline: sources, with / without, let, where, then aggregate or return and sort.

    Query(orders, "O").without(lineitem, "L", lambda q: (q.L.l_orderkey == q.O.o_orderkey) & (q.L.l_returnflag == "R"))
        .where(lambda q: q.O.o_totalprice > 1000).return_(key=lambda q: q.O.o_orderkey).dataframe()

Every clause takes functions of a scope: ``q.O`` is the row of source O, ``q.O.field`` a column, ``q.name`` a let. Conditions keep
rows where they are true. With is a left semi join, without a left anti join, several sources are a cross join that Catalyst turns into
an equi join by the conditions in where.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asclepia.functions import aggregates


class Row:
    def __init__(self, alias: str, columns: list[str]) -> None:
        self._alias, self._columns = alias, columns

    def __getattr__(self, name: str) -> Column:
        return F.col(f"`{self._alias}`.`{name}`")

    __getitem__ = __getattr__

    @property
    def row(self) -> Column:
        """The whole row as a struct."""
        return F.struct(*[F.col(f"`{self._alias}`.`{c}`").alias(c) for c in self._columns])


class Scope:
    def __init__(self, rows: dict[str, Row], lets: dict[str, Column]) -> None:
        self._names = {**lets, **rows}

    def __getattr__(self, name: str):
        try:
            return self._names[name]
        except KeyError:
            raise AttributeError(f"no alias or let {name!r}") from None

    __getitem__ = __getattr__


Expr = Callable[[Scope], Column]


class Query:
    """Immutable: each clause gives a new query. Clauses apply in the fixed order whatever order they are called in."""

    def __init__(self, source: DataFrame, alias: str) -> None:
        self._sources: list[tuple[str, DataFrame]] = [(alias, source)]
        self._relations: list[tuple[str, str, DataFrame, Expr | None]] = []
        self._lets: list[tuple[str, Expr]] = []
        self._where: list[Expr] = []
        self._return: dict[str, Expr] | None = None
        self._distinct = False
        self._sort: list[tuple[Expr | str, bool]] = []

    def _with(self, **changes) -> Query:
        out = object.__new__(Query)
        out.__dict__.update(self.__dict__ | changes)
        return out

    def from_(self, source: DataFrame, alias: str) -> Query:
        """A further source: all combinations, left-major."""
        return self._with(_sources=[*self._sources, (alias, source)])

    def with_(self, related: DataFrame, alias: str, such_that: Expr | None = None) -> Query:
        """Keeps rows for which some related row makes the condition true."""
        return self._with(_relations=[*self._relations, ("left_semi", alias, related, such_that)])

    def without(self, related: DataFrame, alias: str, such_that: Expr | None = None) -> Query:
        """Keeps rows for which no related row makes the condition true."""
        return self._with(_relations=[*self._relations, ("left_anti", alias, related, such_that)])

    def let(self, **names: Expr) -> Query:
        """Names for expressions; later ones see earlier ones."""
        return self._with(_lets=[*self._lets, *names.items()])

    def where(self, condition: Expr) -> Query:
        return self._with(_where=[*self._where, condition])

    def return_(self, distinct: bool = False, **columns: Expr) -> Query:
        return self._with(_return=columns, _distinct=distinct)

    def sort(self, *keys: Expr | str | tuple[Expr | str, str]) -> Query:
        """Names of returned columns or functions of the scope, alone or with "asc" / "desc"; nulls first, descending last."""
        return self._with(_sort=[k if isinstance(k, tuple) else (k, "asc") for k in keys])

    def _rows(self) -> tuple[DataFrame, Scope]:
        df = reduce(lambda a, b: a.crossJoin(b), [s.alias(a) for a, s in self._sources])
        rows = {a: Row(a, s.columns) for a, s in self._sources}
        for kind, alias, related, such_that in self._relations:
            scope = Scope(rows | {alias: Row(alias, related.columns)}, {})
            df = df.join(related.alias(alias), F.lit(True) if such_that is None else such_that(scope), kind)
        lets: dict[str, Column] = {}
        for name, expr in self._lets:
            df = df.withColumn(f"_let_{name}", expr(Scope(rows, lets)))
            lets[name] = F.col(f"_let_{name}")
        scope = Scope(rows, lets)
        for condition in self._where:
            df = df.filter(condition(scope))
        return df, scope

    def dataframe(self) -> DataFrame:
        df, scope = self._rows()
        if self._return is not None:
            columns = {n: e(scope) for n, e in self._return.items()}
        elif len(self._sources) == 1:
            alias, source = self._sources[0]
            columns = {c: F.col(f"`{alias}`.`{c}`") for c in source.columns}
        else:
            columns = {a: scope[a].row for a, _ in self._sources}
        keys = []
        for n, (key, direction) in enumerate(self._sort):
            if not isinstance(key, str):
                columns[f"_sort_{n}"] = key(scope)
            c = F.col(key if isinstance(key, str) else f"_sort_{n}")
            keys.append(c.asc_nulls_first() if direction.startswith("asc") else c.desc_nulls_last())
        out = df.select(*[c.alias(n) for n, c in columns.items()])
        if self._distinct:
            out = out.dropDuplicates()
        if keys:
            out = out.orderBy(*keys)
        return out.drop(*[c for c in out.columns if c.startswith("_sort_")])

    def group(self, *by: str, **aggregated: Callable[[Scope], Column]) -> DataFrame:
        """One row per context key: ``by`` names lets or columns; ``aggregated`` are aggregates of the scope."""
        df, scope = self._rows()
        keys = [(scope._names[b] if b in scope._names else F.col(b)).alias(b) for b in by]
        return df.groupBy(*keys).agg(*[f(scope).alias(n) for n, f in aggregated.items()])

    def aggregate(self, start: Column, body: Callable[[Column, Column], Column], value: Expr, order: list[Expr], by: list[Expr] = (), distinct: bool = False, name: str = "result") -> DataFrame:
        """The fold of the aggregate clause in a given order. Needs all rows of a group at once: use :meth:`group` with an aggregate where
        the fold is one (see :func:`fold_as_aggregate`)."""
        df, scope = self._rows()
        rows = df.select(*[b(scope).alias(f"k{i}") for i, b in enumerate(by)], *[o(scope).alias(f"o{i}") for i, o in enumerate(order)], value(scope).alias("v"))
        if distinct:
            rows = rows.groupBy(*[f"k{i}" for i in range(len(by))], "v").agg(*[F.min(f"o{i}").alias(f"o{i}") for i in range(len(order))])
        folded = aggregates.fold([F.col(f"o{i}") for i in range(len(order))], F.col("v"), start, body).alias(name)
        return rows.groupBy(*[f"k{i}" for i in range(len(by))]).agg(folded)


#: Folds that are aggregates: start value and operator to the aggregate of the values.
FOLDS: dict[tuple[object, str], Callable[[Column], Column]] = {
    (0, "+"): lambda v: F.coalesce(F.sum(v), F.lit(0)),
    (1, "*"): lambda v: F.coalesce(F.product(v), F.lit(1.0)),
    (None, "min"): F.min,
    (None, "max"): F.max,
    (True, "and"): lambda v: F.coalesce(F.bool_and(v), F.lit(True)),
    (False, "or"): lambda v: F.coalesce(F.bool_or(v), F.lit(False)),
}


def fold_as_aggregate(start: object, operator: str) -> Callable[[Column], Column] | None:
    """A partially aggregating form of a fold, if it has one and its values aren't null."""
    return FOLDS.get((start, operator))


def singleton(df: DataFrame):
    """The value of a query over one scalar source: null for no row, the row for one, else an error."""
    rows = df.limit(2).collect()
    if len(rows) > 1:
        raise ValueError("more than one row")
    return rows[0] if rows else None
