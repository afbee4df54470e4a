"""Evaluating expressions and libraries over a catalog of tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime, timedelta
from decimal import Decimal
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asclepia.plans import types as Y
from asclepia.plans.compiler import Compiler, Env, Relation, Typed
from asclepia.plans.errors import CompileError, ModelError, SettingError, evaluating
from asclepia.plans.lang import Library, parse_expression, parse_library
from asclepia.sources.catalog import Catalog


class Engine:
    """``Engine(spark, catalog).compile(text).evaluate(name)``: a definition over a whole population as a DataFrame."""

    def __init__(self, spark: SparkSession, catalog: Catalog | None = None, now: datetime | None = None, library_path: str | None = None) -> None:
        self.spark, self.catalog, self.now, self.library_path = spark, catalog, now or datetime(2024, 1, 1), library_path
        self.host: dict[str, Callable] = {}

    def register(self, name: str, f: Callable[..., Typed]) -> None:
        """A host function: typed columns to a typed column."""
        self.host[name] = f

    def _retrieve(self, name: str, **options) -> Relation:
        if self.catalog is None:
            raise ModelError("no catalog", 3)
        df = self.catalog.retrieve(name, **options)
        return Relation(df, Y.tuple_of({f.name: Y.of_spark(f.dataType) for f in df.schema.fields}), self.catalog.tables[name].context)

    def _compiler(self, library: Library | None, parameters: dict | None, including: tuple[str, ...] = ()) -> Compiler:
        libraries = {}
        for alias, (path, version) in (library.includes if library else {}).items():
            if path in including:
                raise CompileError(f"libraries include each other: {' -> '.join([*including, path])}", 4)
            libraries[alias] = self._compiler(self._find(path, version), parameters, (*including, path))
        out = Compiler(library, self._retrieve, self.now, parameters, libraries, self.catalog.terminology if self.catalog else None)
        out.host = self.host
        return out

    def _find(self, name: str, version: str | None) -> Library:
        """A library's file: name-version.cql, name_version.cql or name.cql in the library path."""
        names = ([f"{name}-{version}.cql", f"{name}_{version}.cql"] if version else []) + [f"{name}.cql"]
        for n in names:
            if self.library_path and (p := Path(self.library_path) / n).exists():
                return parse_library(p.read_text())
        raise SettingError(f"no file for library {name!r}", 1)

    def compile(self, library: str | Library, parameters: dict | None = None) -> Compiled:
        lib = parse_library(library) if isinstance(library, str) else library
        return Compiled(self, lib, self._compiler(lib, parameters))

    def expression(self, text: str, parameters: dict | None = None, library: Library | None = None) -> Typed | Relation:
        return self._compiler(library, parameters).any(parse_expression(text), Env())

    def evaluate(self, text: str, **options):
        """The Python value of one expression; a table gives its rows."""
        with evaluating():
            out = self.expression(text, **options)
            if isinstance(out, Relation):
                return [r[0] if out.ty.name != "Tuple" else r.asDict(True) for r in out.df.collect()]
            return self.spark.range(1).select(out.col.alias("v")).first()[0]

    def text(self, expression: str, **options) -> str:
        """The value of one expression as the language writes it."""
        with evaluating():
            out = self.expression(expression, **options)
            if isinstance(out, Relation):
                return render([r[0] if out.ty.name != "Tuple" else r for r in out.df.collect()], Y.list_of(out.ty))
            offset = F.lit(None).cast("int") if out.offset is None else out.offset
            value, minutes = self.spark.range(1).select(out.col.alias("v"), offset.alias("o")).first()
            if value is None or minutes is None or out.ty not in (Y.DATETIME, Y.P_DATETIME):
                return render(value, out.ty)
            return local(value, out.ty, minutes)


class Compiled:
    def __init__(self, engine: Engine, library: Library, compiler: Compiler) -> None:
        self.engine, self.library, self.compiler = engine, library, compiler

    def evaluate(self, name: str) -> DataFrame:
        """A definition as a DataFrame: a query's rows; a value in one row; in a context an aggregate per member, all members."""
        out = self.compiler.definition(name)
        if isinstance(out, Typed):
            return self.engine.spark.range(1).select(out.col.alias(name))
        context = self.library.definitions[name].context
        if out.context == "_context" and "value" in out.df.columns and context in (self.engine.catalog.tables if self.engine.catalog else {}):
            table = self.engine.catalog.tables[context]
            members = self.engine.catalog.retrieve(context).select(F.col(table.context).alias("_context"))
            joined = members.join(out.df, "_context", "left")
            empty = getattr(out, "empty", None)
            return joined.select("_context", (F.coalesce("value", F.lit(empty)) if empty is not None else F.col("value")).alias(name))
        return out.df

    def results(self) -> dict[str, DataFrame]:
        """All public definitions."""
        return {n: self.evaluate(n) for n, d in self.library.definitions.items() if d.access == "Public"}


def local(value, ty: Y.Ty, minutes: int) -> str:
    """A date-time in its own zone, with that zone."""
    shift = timedelta(minutes=minutes)
    moved = value + shift if ty == Y.DATETIME else {"lo": value["lo"] + shift, "hi": value["hi"] + shift, "prec": value["prec"]}
    text = render(moved, ty)
    return text if text.endswith("T") else f"{text}{'-' if minutes < 0 else '+'}{abs(minutes) // 60:02d}:{abs(minutes) % 60:02d}"


def render(value, ty: Y.Ty) -> str:
    """The language's text of a value: lists in braces, strings in quotes, L for longs, @ before temporals."""
    if value is None:
        return "null"
    if ty.name == "Choice":
        return next((render(value[f"c{i}"], t) for i, t in enumerate(ty.inner) if value[f"c{i}"] is not None), "null")
    if ty == Y.UNCERTAIN:
        return str(value["low"]) if value["low"] == value["high"] else f"Interval[{value['low']}, {value['high']}]"
    if ty.name == "List":
        return "{" + ", ".join(render(v, ty.inner[0]) for v in value) + "}" if value else "{}"
    if ty.name == "Tuple":
        return "{ " + ", ".join(f"{n}: {render(value[n], t)}" for n, t in zip(ty.fields, ty.inner, strict=True)) + " }"
    if ty.name == "Interval":
        return f"Interval{'[' if value['lowClosed'] else '('}{render(value['low'], ty.inner[0])}, {render(value['high'], ty.inner[0])}{']' if value['highClosed'] else ')'}"
    if ty == Y.BOOLEAN:
        return "true" if value else "false"
    if ty == Y.STRING:
        return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"
    if ty == Y.LONG:
        return f"{value}L"
    if ty == Y.DECIMAL:
        return number(value)
    if ty == Y.CODE:
        return "Code { " + ", ".join(f"{n}: {render(value[n], Y.STRING)}" for n in ("code", "system", "version", "display") if value[n] is not None) + " }"
    if ty == Y.CONCEPT:
        codes = [render(c, Y.CODE) for c in value["codes"] or []]
        return "Concept { codes: " + (codes[0] if len(codes) == 1 else "{" + ", ".join(codes) + "}") + (f", display: {render(value['display'], Y.STRING)}" if value["display"] is not None else "") + " }"
    if ty == Y.QUANTITY:
        return f"{number(value['value'])} '{value['unit'] or '1'}'"
    if ty == Y.DATE:
        return f"@{value:%Y-%m-%d}" if value.year > 999 else f"@{value.year:04d}-{value.month:02d}-{value.day:02d}"
    if ty == Y.DATETIME:
        return f"@{value.year:04d}-{value.month:02d}-{value.day:02d}T{value:%H:%M:%S}.{value.microsecond // 1000:03d}"
    if ty == Y.TIME:
        return f"@T{value // 3_600_000:02d}:{value // 60_000 % 60:02d}:{value // 1000 % 60:02d}.{value % 1000:03d}"
    if ty in Y.PARTIAL:
        full = render(value["lo"], Y.PARTIAL[ty])
        if ty == Y.P_TIME:
            return full[: (0, 0, 0, 0, 4, 7, 10, 14)[value["prec"]]]
        cut = full[: (0, 5, 8, 11, 14, 17, 20, 24)[value["prec"]]]
        return cut + "T" if ty == Y.P_DATETIME and value["prec"] <= 3 else cut
    return str(value)


def number(value) -> str:
    text = f"{value:f}" if isinstance(value, Decimal) else repr(float(value))
    return re.sub(r"(\.\d*?[1-9]|\.0)0+$|(\.0)0*$", lambda m: m[1] or m[2], text if "." in text else text + ".0")
