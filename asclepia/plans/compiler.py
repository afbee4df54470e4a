"""The compiler: a typed tree walk from expression nodes to Columns, and from queries over retrieves to DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asclepia.functions import aggregates as G
from asclepia.functions import arithmetic as A
from asclepia.functions import clinical as K
from asclepia.functions import comparison as C
from asclepia.functions import conversion as V
from asclepia.functions import intervals as I
from asclepia.functions import lists as L
from asclepia.functions import logic as N
from asclepia.functions import strings as S
from asclepia.functions import temporal as T
from asclepia.operators import relations as R
from asclepia.plans import types as Y
from asclepia.plans.errors import CompileError, ModelError
from asclepia.plans.lang import Library, Node
from asclepia.plans.types import Ty


@dataclass
class Typed:
    col: Column
    ty: Ty
    #: Of a date-time its zone in minutes east of UTC, where the expression itself says it; the value is in UTC.
    offset: Column | None = None
    #: Of a partial value how many components it has, where that is known beforehand.
    prec: int | None = None
    #: Of a quantity its unit, where the expression itself says it.
    unit: str | None = None


@dataclass
class Relation:
    """A list that is a table: its rows, the type of a row, the column of its context."""

    df: DataFrame
    ty: Ty
    context: str | None = None
    #: Keys of its order, with whether each ascends.
    order: list[tuple[Column, bool]] = field(default_factory=list)


@dataclass
class Env:
    names: dict[str, Typed | Relation] = field(default_factory=dict)

    def bind(self, **more) -> Env:
        return Env(self.names | more)


def lit(value, ty: Ty) -> Typed:
    return Typed(F.lit(value).cast(Y.ddl(ty)), ty)


def null(ty: Ty = Y.ANY) -> Typed:
    return Typed(F.lit(None).cast(Y.ddl(ty)), ty)


#: Codes of a value set that stand in an expression as a literal.
MAX_LITERAL_CODES = 10_000

_STAMP = re.compile(r"(\d{4})(?:-(\d{2})(?:-(\d{2}))?)?(?:T(?:(\d{2})(?::(\d{2})(?::(\d{2})(?:\.(\d+))?)?)?)?)?(Z|[+-]\d{2}:\d{2})?$")
_CLOCK = re.compile(r"T?(\d{2})(?::(\d{2})(?::(\d{2})(?:\.(\d+))?)?)?(Z|[+-]\d{2}:\d{2})?$")


def _ms(text: str | None) -> int:
    return int((text or "0")[:3].ljust(3, "0"))


def temporal_literal(text: str, kind: str) -> Typed:
    """Of full precision a native value (date-times in UTC), else the range of what it may be."""
    if kind == "Time":
        m = _CLOCK.match(text)
        if not m:
            raise CompileError(f"not a time: {text}")
        parts = [int(m[i]) for i in (1, 2, 3) if m[i]] + ([_ms(m[4])] if m[4] else [])
        if parts[0] > 23 or any(p > 59 for p in parts[1:3]) or len(m[4] or "") > 3:
            raise CompileError(f"not a time: {text}", 5)
        at = lambda fill: sum(p * s for p, s in zip([*parts, *fill[len(parts) :]], (3_600_000, 60_000, 1000, 1), strict=True))
        if len(parts) == 4:
            return lit(at([0] * 4), Y.TIME)
        made = F.struct(F.lit(at([0] * 4)).alias("lo"), F.lit(at([23, 59, 59, 999])).alias("hi"), F.lit(len(parts) + 3).cast("tinyint").alias("prec"))
        return Typed(made, Y.P_TIME, prec=len(parts) + 3)
    m = _STAMP.match(text)
    if not m or len(m[7] or "") > 3:
        raise CompileError(f"not a date: {text}", 5)
    parts = [int(m[i]) for i in range(1, 7) if m[i]] + ([_ms(m[7])] if m[7] else [])
    try:
        lo = datetime(*[*parts, *[1, 1, 1, 0, 0, 0][len(parts) :]][:6], _ms(m[7]) * 1000 if m[7] else 0)
    except ValueError as e:
        raise CompileError(f"not a date: {text}") from e
    n = len(parts)
    step = {1: lambda: datetime(lo.year, 12, 31), 2: lambda: (datetime(lo.year + lo.month // 12, lo.month % 12 + 1, 1) if (lo.year, lo.month) != (9999, 12) else datetime(9999, 12, 31)) - timedelta(days=(lo.year, lo.month) != (9999, 12)), 3: lambda: lo, 4: lambda: lo, 5: lambda: lo, 6: lambda: lo, 7: lambda: lo}
    if kind == "Date":
        if n == 3:
            return lit(lo.date(), Y.DATE)
        made = F.struct(F.lit(lo.date()).alias("lo"), F.lit(step[n]().date()).alias("hi"), F.lit(n).cast("tinyint").alias("prec"))
        return Typed(made, Y.P_DATE, prec=n)
    hi = step[n]()
    hi = hi.replace(**{k: v for i, (k, v) in enumerate((("hour", 23), ("minute", 59), ("second", 59), ("microsecond", 999_000)), 4) if i > n})
    offset = None
    if m[8]:
        sign, zone = (-1 if m[8][0] == "-" else 1), m[8][1:].split(":") if m[8] != "Z" else (0, 0)
        minutes = sign * (int(zone[0]) * 60 + int(zone[1]))
        if abs(minutes) > 840:
            raise CompileError(f"not a time zone: {m[8]}", 5)
        lo, hi = lo - timedelta(minutes=minutes), hi - timedelta(minutes=minutes)
        offset = F.lit(minutes)
    if n == 7:
        return Typed(lit(lo, Y.DATETIME).col, Y.DATETIME, offset)
    made = F.struct(F.lit(lo).cast("timestamp_ntz").alias("lo"), F.lit(hi).cast("timestamp_ntz").alias("hi"), F.lit(n).cast("tinyint").alias("prec"))
    return Typed(made, Y.P_DATETIME, offset, n)


class Compiler:
    def __init__(self, library: Library | None = None, retrieve: Callable[..., Relation] | None = None, now: datetime | None = None, parameters: dict | None = None, libraries: dict[str, Compiler] | None = None, terminology=None) -> None:
        self.library, self.retrieve_, self.now = library or Library(), retrieve, now or datetime(2024, 1, 1)
        self.parameters, self.libraries, self.terminology = parameters or {}, libraries or {}, terminology
        self.done: dict[str, Typed | Relation] = {}
        self.active: list[str] = []
        self.context = "Unfiltered"
        #: Joins with value sets that are too large for a literal, for the query over tables that is being compiled.
        self.pending: list[tuple[Typed, str, str]] | None = None
        self.host: dict[str, Callable[..., Typed]] = {}

    # Names.

    def definition(self, name: str) -> Typed | Relation:
        if name in self.done:
            return self.done[name]
        if name in self.active:
            raise CompileError(f"definitions refer to each other: {' -> '.join([*self.active, name])}", 4)
        self.active.append(name)
        outer, self.context = self.context, self.library.definitions[name].context
        try:
            self.done[name] = self.any(self.library.definitions[name].body, Env())
        finally:
            self.active.pop()
            self.context = outer
        return self.done[name]

    def code(self, name: str) -> Typed:
        value, system, display = self.library.codes[name]
        return Typed(K.code(value, self.library.code_systems.get(system, system), None, display), Y.CODE)

    def identifier(self, name: str, env: Env) -> Typed | Relation:
        """Alias or let, then parameter, definition, code, concept."""
        if name in env.names:
            return env.names[name]
        if name in self.library.parameters or name in self.parameters:
            kind, default = self.library.parameters.get(name, (None, None))
            if name in self.parameters:
                return self.value(self.parameters[name], self.type(kind) if kind else None)
            if default is None:
                return null(self.type(kind) if kind else Y.ANY)
            return self.expr(default, Env())
        if name in self.library.definitions:
            return self.definition(name)
        if name in self.library.codes:
            return self.code(name)
        if name in self.library.concepts:
            parts, display = self.library.concepts[name]
            return Typed(K.concept([self.code(p).col for p in parts], display), Y.CONCEPT)
        if name in self.library.value_sets or name in self.library.code_systems:
            return lit(self.library.value_sets.get(name) or self.library.code_systems[name], Y.STRING)
        alias, _, rest = name.partition(".")
        if rest and alias in self.libraries:
            return self.libraries[alias].identifier(rest, Env())
        raise CompileError(f"unknown name {name!r}", 1)

    def value(self, value, ty: Ty | None = None) -> Typed:
        """A Python value as a literal."""
        for kind, t in ((bool, Y.BOOLEAN), (int, Y.INTEGER), (float, Y.DECIMAL), (Decimal, Y.DECIMAL), (datetime, Y.DATETIME), (date, Y.DATE), (str, Y.STRING)):
            if isinstance(value, kind):
                if t == Y.INTEGER and not A.INT_MIN <= value <= A.INT_MAX:
                    t = Y.LONG
                return lit(value, ty or t)
        if isinstance(value, (list, tuple)):
            items = [self.value(v) for v in value]
            return self.list_(items)
        if value is None:
            return null(ty or Y.ANY)
        if isinstance(value, Typed):
            return value
        raise CompileError(f"no literal for {value!r}")

    def type(self, node: Node) -> Ty:
        inner = tuple(self.type(n) for n in node.args)
        name = node["name"]
        if name == "Choice":
            return Y.choice_of(inner)
        return Ty(name, inner, tuple(node["fields"] or ()))

    # Expressions.

    def any(self, node: Node, env: Env) -> Typed | Relation:
        if node.kind == "Query":
            return self.query(node, env)
        if node.kind == "Retrieve":
            return self.retrieve(node, env)
        if node.kind == "IdentifierRef":
            return self.identifier(node["name"], env)
        if node.kind in RELATIONAL and node.args:
            first = self.any(node.args[0], env)
            if isinstance(first, Relation):
                return RELATIONAL[node.kind](self, first, node, env)
        if node.kind == "FunctionRef" and node.args and NAMES.get(node["name"].lower()) in RELATIONAL:
            first = self.any(node.args[0], env)
            if isinstance(first, Relation):
                kind = NAMES[node["name"].lower()]
                return RELATIONAL[kind](self, first, Node(kind, node.args, node.attrs), env)
        return self.expr(node, env)

    def expr(self, node: Node, env: Env) -> Typed:
        method = getattr(self, f"on_{node.kind}", None)
        if method:
            out = method(node, env)
        elif node.kind in OPERATIONS:
            out = OPERATIONS[node.kind](self, *[self.expr(a, env) for a in node.args], **({"node": node} if node.kind in WITH_NODE else {}))
        else:
            raise CompileError(f"unknown expression {node.kind}")
        if isinstance(out, Relation):
            raise CompileError("a table can't stand here; use exists, an aggregate, or a relationship")
        return out

    def on_Query(self, node: Node, env: Env):
        return self.query(node, env)

    def on_Retrieve(self, node: Node, env: Env):
        return self.retrieve(node, env)

    def on_IdentifierRef(self, node: Node, env: Env):
        return self.identifier(node["name"], env)

    on_ExpressionRef = on_ParameterRef = on_AliasRef = on_QueryLetRef = on_OperandRef = on_CodeRef = on_ConceptRef = on_ValueSetRef = on_CodeSystemRef = on_IdentifierRef

    def on_Null(self, node: Node, env: Env) -> Typed:
        return null()

    def on_Literal(self, node: Node, env: Env) -> Typed:
        kind, text = node["type"], node["value"]
        if kind in ("Date", "DateTime", "Time"):
            return temporal_literal(text, kind)
        if kind == "Integer":
            if not A.INT_MIN <= int(text) <= A.INT_MAX:
                raise CompileError(f"integer out of range: {text}")
            return lit(int(text), Y.INTEGER)
        if kind == "Long":
            if not A.LONG_MIN <= int(text) <= A.LONG_MAX:
                raise CompileError(f"long out of range: {text}")
            return lit(int(text), Y.LONG)
        if kind == "Decimal":
            whole, _, places = text.lstrip("+-").partition(".")
            if len(whole) > 28 or len(places) > 8:
                raise CompileError(f"decimal out of range: {text}")
            return Typed(F.lit(Decimal(text)).cast("decimal(28,8)" if len(whole) <= 20 else "decimal(38,8)"), Y.DECIMAL)
        return lit(text == "true" if kind == "Boolean" else text, Ty(kind))

    def on_Quantity(self, node: Node, env: Env) -> Typed:
        return Typed(K.quantity(F.lit(Decimal(str(node["value"]))), node["unit"]), Y.QUANTITY, unit=node["unit"])

    def on_Ratio(self, node: Node, env: Env) -> Typed:
        return Typed(K.ratio(*[self.expr(a, env).col for a in node.args]), Y.RATIO)

    def on_Current(self, node: Node, env: Env) -> Typed:
        return env.names["$this"]

    def on_Iteration(self, node: Node, env: Env) -> Typed:
        return env.names["$index"]

    def on_Total(self, node: Node, env: Env) -> Typed:
        return env.names["$total"]

    def list_(self, items: list[Typed], element: Ty | None = None) -> Typed:
        element = Y.joint([*([element] if element else []), *[i.ty for i in items]])
        cols = [Y.convert(i.col, i.ty, element) for i in items]
        return Typed((F.array(*cols) if cols else F.array()).cast(f"array<{Y.ddl(element)}>"), Y.list_of(element))

    def on_List(self, node: Node, env: Env) -> Typed:
        return self.list_([self.expr(a, env) for a in node.args], self.type(node["type"]) if node["type"] else None)

    def on_Tuple(self, node: Node, env: Env) -> Typed:
        values = {n: self.expr(a, env) for n, a in zip(node["names"], node.args, strict=True)}
        if not values:
            return Typed(F.struct(F.lit(None).cast("string").alias("_")), Ty("Tuple"))
        return Typed(F.struct(*[v.col.alias(n) for n, v in values.items()]), Y.tuple_of({n: v.ty for n, v in values.items()}))

    def on_Instance(self, node: Node, env: Env) -> Typed:
        values = {n: self.expr(a, env) for n, a in zip(node["names"], node.args, strict=True)}
        text = lambda n: Y.convert(values[n].col, values[n].ty, Y.STRING) if n in values else None
        if node["type"] == "Code":
            return Typed(K.code(*[text(n) for n in ("code", "system", "version", "display")]), Y.CODE)
        if node["type"] == "Concept":
            codes = Y.convert(values["codes"].col, values["codes"].ty, Y.list_of(Y.CODE)) if values["codes"].ty.name == "List" else F.array(values["codes"].col)
            return Typed(F.struct(codes.alias("codes"), (text("display") if "display" in values else F.lit(None).cast("string")).alias("display")), Y.CONCEPT)
        if node["type"] == "Quantity":
            return Typed(V.quantity(values["value"].col, text("unit") if "unit" in values else None), Y.QUANTITY)
        return self.on_Tuple(node, env)

    def on_Interval(self, node: Node, env: Env) -> Typed:
        low, high = (self.expr(a, env) for a in node.args)
        point = Y.common(low.ty, high.ty)
        if point is None:
            raise CompileError("an interval's bounds must have a common type", 3)
        if point in Y.PARTIAL or point == Y.ANY:
            checked = False
        else:
            checked = point not in (Y.QUANTITY,)
        closed = [x if isinstance(x, bool) else bool(x) for x in (node["low_closed"], node["high_closed"])]
        made = I.interval(Y.convert(low.col, low.ty, point), Y.convert(high.col, high.ty, point), *closed, checked=checked)
        return Typed(made, Y.interval_of(point))

    def on_Property(self, node: Node, env: Env) -> Typed:
        source = node.args[0]
        if source.kind == "IdentifierRef" and source["name"] in self.libraries and source["name"] not in env.names:
            return self.libraries[source["name"]].identifier(node["path"], Env())
        x, path = self.expr(source, env), node["path"]
        return self.property(x, path)

    def property(self, x: Typed, path: str) -> Typed:
        if x.ty.name == "Tuple":
            if path not in x.ty.fields:
                raise ModelError(f"no element {path!r} in {x.ty}", 2)
            return Typed(x.col.getField(path), x.ty.inner[x.ty.fields.index(path)])
        if x.ty.name == "List":
            inner = self.property(Typed(F.lit(None).cast(Y.ddl(x.ty.inner[0])), x.ty.inner[0]), path)
            return Typed(F.transform(x.col, lambda e: self.property(Typed(e, x.ty.inner[0]), path).col), Y.list_of(inner.ty))
        if x.ty.name == "Interval" and path in ("low", "high", "lowClosed", "highClosed"):
            return Typed(x.col[path], Y.BOOLEAN if "Closed" in path else x.ty.inner[0])
        known = {"Quantity": {"value": Y.DECIMAL, "unit": Y.STRING}, "Code": dict.fromkeys(("code", "system", "version", "display"), Y.STRING), "Concept": {"codes": Y.list_of(Y.CODE), "display": Y.STRING}, "Ratio": dict.fromkeys(("numerator", "denominator"), Y.QUANTITY)}
        if path in known.get(x.ty.name, {}):
            return Typed(x.col[path], known[x.ty.name][path])
        if x.ty == Y.ANY:
            return null()
        raise ModelError(f"no element {path!r} in {x.ty}", 2)

    def on_If(self, node: Node, env: Env) -> Typed:
        c, a, b = (self.expr(x, env) for x in node.args)
        ty = Y.joint([a.ty, b.ty])
        return Typed(N.if_(Y.convert(c.col, c.ty, Y.BOOLEAN), Y.convert(a.col, a.ty, ty), Y.convert(b.col, b.ty, ty)), ty)

    def on_Case(self, node: Node, env: Env) -> Typed:
        comparand = self.expr(node["comparand"], env) if node["comparand"] else None
        pairs = [(self.expr(w, env), self.expr(t, env)) for w, t in node["branches"]]
        other = self.expr(node["else"], env) if node["else"] else null()
        ty = Y.joint([other.ty, *[t.ty for _, t in pairs]])
        conditions = [(w if comparand is None else equal(self, comparand, w)) for w, _ in pairs]
        branches = [(Y.convert(c.col, c.ty, Y.BOOLEAN), Y.convert(t.col, t.ty, ty)) for c, (_, t) in zip(conditions, pairs, strict=True)]
        return Typed(N.case(branches, Y.convert(other.col, other.ty, ty)), ty)

    def on_As(self, node: Node, env: Env) -> Typed:
        x, ty = self.expr(node.args[0], env), self.type(node["type"])
        if x.ty == Y.ANY:
            return Typed(F.array().cast(Y.ddl(ty)), ty) if ty.name == "List" and node.args[0].kind == "Null" else null(ty)
        if ty.name == "Choice" and x.ty in ty.inner:
            return x
        if x.ty.name == "Choice":
            return Typed(Y.chosen(x.col, x.ty, ty), ty)
        return x if x.ty == ty or Y.PARTIAL.get(x.ty) == ty or Y.cost(x.ty, ty) is None else Typed(Y.convert(x.col, x.ty, ty), ty)

    def on_Is(self, node: Node, env: Env) -> Typed:
        x, ty = self.expr(node.args[0], env), self.type(node["type"])
        if x.ty.name == "Choice":
            return Typed(F.coalesce(Y.chosen(x.col, x.ty, ty).isNotNull(), F.lit(False)), Y.BOOLEAN)
        same = Y.PARTIAL.get(x.ty, x.ty) == ty or (x.ty == Y.INTEGER and ty.name in ("Decimal", "Long")) or (x.ty.name == ty.name and bool(ty.inner))
        return Typed(V.is_(x.col, same), Y.BOOLEAN)

    def on_Convert(self, node: Node, env: Env) -> Typed:
        return OPERATIONS[f"To{self.type(node['type']).name}"](self, self.expr(node.args[0], env))

    def on_CanConvert(self, node: Node, env: Env) -> Typed:
        return OPERATIONS[f"ConvertsTo{self.type(node['type']).name}"](self, self.expr(node.args[0], env))

    def on_MinValue(self, node: Node, env: Env) -> Typed:
        return Typed(A.minimum(self.type(node["type"]).name), self.type(node["type"]))

    def on_MaxValue(self, node: Node, env: Env) -> Typed:
        return Typed(A.maximum(self.type(node["type"]).name), self.type(node["type"]))

    def on_Filter(self, node: Node, env: Env) -> Typed:
        return self.higher(node, env, F.filter, Y.BOOLEAN)

    def on_ForEach(self, node: Node, env: Env) -> Typed:
        return self.higher(node, env, F.transform, None)

    def higher(self, node: Node, env: Env, apply, ty: Ty | None) -> Typed:
        items, seen = self.expr(node.args[0], env), []

        def body(x: Column, i: Column) -> Column:
            out = self.expr(node.args[1], env.bind(**{"$this": Typed(x, items.ty.inner[0]), "$index": Typed(i, Y.INTEGER)}))
            seen.append(out.ty)
            return out.col

        col = apply(items.col, body)
        return Typed(col, items.ty if ty else Y.list_of(seen[-1]))

    def on_Aggregate(self, node: Node, env: Env) -> Typed:
        """The fold of the logical model: source, body with $this and $total, start."""
        items, start = self.expr(node.args[0], env), self.expr(node.args[2], env) if len(node.args) > 2 else null()
        return self.fold(items, start, lambda t, x: self.expr(node.args[1], env.bind(**{"$total": t, "$this": x})))

    def fold(self, items: Typed, start: Typed, body) -> Typed:
        ty = start.ty if start.ty != Y.ANY else items.ty.inner[0]
        probe = body(Typed(F.lit(None).cast(Y.ddl(ty)), ty), Typed(F.lit(None).cast(Y.ddl(items.ty.inner[0])), items.ty.inner[0]))
        ty = Y.common(ty, probe.ty) or ty

        def step(acc: Column, x: Column) -> Column:
            out = body(Typed(acc, ty), Typed(x, items.ty.inner[0]))
            return Y.convert(out.col, out.ty, ty).cast(Y.ddl(ty))

        return Typed(F.aggregate(items.col, Y.convert(start.col, start.ty, ty).cast(Y.ddl(ty)), step), ty)

    def on_Repeat(self, node: Node, env: Env) -> Typed:
        items = self.expr(node.args[0], env)
        body = lambda x: self.expr(node.args[1], env.bind(**{"$this": Typed(x, items.ty.inner[0])})).col
        return Typed(L.repeat(items.col, body, 20), items.ty)

    def on_Message(self, node: Node, env: Env) -> Typed:
        """Its source; if the condition holds, one of severity Error stops the evaluation with its code and message."""
        source = self.expr(node.args[0], env)
        if len(node.args) < 4:
            return source
        condition, code, severity, message = [self.expr(a, env) for a in [*node.args[1:], Node("Null")][:4]]
        words = F.concat(F.lit("message: "), F.concat_ws(" ", *[Y.convert(x.col, x.ty, Y.STRING) for x in (code, message)]))
        stops = Y.convert(condition.col, condition.ty, Y.BOOLEAN) & (F.lower(Y.convert(severity.col, severity.ty, Y.STRING)) == "error")
        return Typed(F.when(stops, F.raise_error(words).cast(Y.ddl(source.ty)) if source.ty.name not in ("List", "Tuple", "Interval") else F.when(F.raise_error(words).cast("boolean"), source.col)).otherwise(source.col), source.ty)

    def on_InValueSet(self, node: Node, env: Env) -> Typed:
        return self.member(self.expr(node.args[0], env), node["value_set"])

    def on_InCodeSystem(self, node: Node, env: Env) -> Typed:
        x = self.expr(node.args[0], env)
        return Typed(K.in_code_system(x.col, self.library.code_systems.get(node["code_system"], node["code_system"]), x.ty == Y.CONCEPT), Y.BOOLEAN)

    def member(self, x: Typed, name: str) -> Typed:
        """Membership in a value set's expansion: of up to 10,000 codes as a literal, of more by a join of the query over tables that asks."""
        if self.terminology is None:
            return null(Y.BOOLEAN)
        url = self.library.value_sets.get(name, name)
        rows = self.terminology.expand(url).select("system", "code").distinct().limit(MAX_LITERAL_CODES + 1).collect()
        if len(rows) > MAX_LITERAL_CODES:
            if self.pending is None or x.ty not in (Y.STRING, Y.CODE):
                raise CompileError("a value set of so many codes can only be asked for a code in a query over a table; use a retrieve with it")
            flag = f"_in_value_set_{len(self.pending)}"
            self.pending.append((x, url, flag))
            return Typed(F.col(flag), Y.BOOLEAN)
        if x.ty == Y.STRING:
            return Typed(x.col.isin(*[r.code for r in rows]) if rows else F.when(x.col.isNotNull(), F.lit(False)), Y.BOOLEAN)
        keys = F.array(*[F.lit(f"{r.system}\0{r.code}") for r in rows]).cast("array<string>")
        key = lambda c: F.concat(F.coalesce(c["system"], F.lit("")), F.lit("\0"), c["code"])
        if x.ty == Y.CONCEPT:
            return Typed(F.exists(x.col["codes"], lambda c: F.array_contains(keys, key(c))), Y.BOOLEAN)
        return Typed(F.when(x.col.isNotNull(), F.array_contains(keys, key(x.col))), Y.BOOLEAN)

    def on_In(self, node: Node, env: Env) -> Typed:
        right = node.args[1]
        if right.kind == "IdentifierRef" and right["name"] in self.library.value_sets and right["name"] not in env.names:
            return self.member(self.expr(node.args[0], env), right["name"])
        if right.kind == "IdentifierRef" and right["name"] in self.library.code_systems and right["name"] not in env.names:
            return self.on_InCodeSystem(Node("InCodeSystem", node.args[:1], {"code_system": right["name"]}), env)
        x, box = self.expr(node.args[0], env), self.expr(right, env)
        return contains(self, box, x, node)

    def on_FunctionRef(self, node: Node, env: Env) -> Typed:
        name = node["name"]
        if node.args and node.args[0].kind == "IdentifierRef" and node.args[0]["name"] in self.libraries and node.args[0]["name"] not in env.names:
            other = self.libraries[node.args[0]["name"]]
            return other.call(name, [self.expr(a, env) for a in node.args[1:]])
        if name in self.library.functions or name in self.host:
            return self.call(name, [self.expr(a, env) for a in node.args])
        kind = NAMES.get(name.lower())
        if kind is None:
            raise CompileError(f"unknown function {name!r}", 2)
        if (m := re.fullmatch(r"(?i)agein(\w+?)s(at)?", name)) is not None:
            birth = env.names.get("birthDate") or self.identifier("birthDate", env)
            at = self.expr(node.args[0], env) if m[2] else lit(self.now, Y.DATETIME)
            return Typed(K.age(birth.col, at.col, m[1].lower()), Y.INTEGER)
        if (m := re.fullmatch(r"(?i)calculateagein(\w+?)s(at)?", name)) is not None:
            birth = self.expr(node.args[0], env)
            at = self.expr(node.args[1], env) if m[2] else lit(self.now, Y.DATETIME)
            return Typed(K.age(birth.col, at.col, m[1].lower()), Y.INTEGER)
        return self.expr(Node(kind, node.args, node.attrs), env)

    def call(self, name: str, args: list[Typed]) -> Typed:
        """A function of the library, its body in place of the call; the overload that costs least wins, equal costs are ambiguous."""
        if name in self.host:
            return self.host[name](*args)
        fitting = []
        for operands, body in self.library.functions.get(name, []):
            if len(operands) == len(args):
                costs = [Y.cost(a.ty, self.type(t)) for a, (_, t) in zip(args, operands, strict=True)]
                if None not in costs:
                    fitting.append((sum(costs), operands, body))
        if not fitting:
            raise CompileError(f"no function {name!r} for {', '.join(str(a.ty) for a in args)}", 2)
        fitting.sort(key=lambda f: f[0])
        if len(fitting) > 1 and fitting[0][0] == fitting[1][0]:
            raise CompileError(f"more than one function {name!r} fits", 6)
        if f"{name}()" in self.active or len(self.active) > 100:
            raise CompileError(f"{name!r} calls itself", 4)
        self.active.append(f"{name}()")
        try:
            bound = {o: Typed(Y.convert(a.col, a.ty, self.type(t)), self.type(t)) for a, (o, t) in zip(args, fitting[0][1], strict=True)}
            return self.expr(fitting[0][2], Env(bound))
        finally:
            self.active.pop()

    # Queries.

    def retrieve(self, node: Node, env: Env) -> Relation:
        if self.retrieve_ is None:
            raise ModelError("a retrieve needs a catalog", 3)
        options: dict = {"code_path": node["code_path"]}
        codes, comparator = node["codes"], node["comparator"]
        if codes is not None and comparator in ("=", "~"):
            options["code"] = self._one_code(codes)
            options["comparator"] = comparator
        elif codes is not None:
            if codes.kind == "IdentifierRef" and codes["name"] in self.library.value_sets:
                options["value_set"] = self.library.value_sets[codes["name"]]
            elif codes.kind == "IdentifierRef" and codes["name"] in self.library.codes:
                options["codes"] = [self.library.codes[codes["name"]][0]]
            elif codes.kind == "List":
                options["codes"] = [c["value"] if c.kind == "Literal" else self.library.codes[c["name"]][0] for c in codes.args]
            else:
                options["codes"] = [codes["value"]]
        return self.retrieve_(node["type"], **options)

    def _one_code(self, codes: Node) -> tuple[str, str | None]:
        """The code and system of a retrieve with ``=`` or ``~``."""
        if codes.kind == "IdentifierRef" and codes["name"] in self.library.codes:
            value, system, _ = self.library.codes[codes["name"]]
            return value, self.library.code_systems.get(system, system)
        if codes.kind == "Literal":
            return codes["value"], None
        raise CompileError("a retrieve with = or ~ needs one code", 3)

    def query(self, node: Node, env: Env) -> Typed | Relation:
        sources = [self.any(a, env) for a in node.args]
        if any(isinstance(s, Relation) for s in sources):
            return self.relation_query(node, sources, env)
        return self.list_query(node, sources, env)

    def list_query(self, node: Node, sources: list[Typed], env: Env) -> Typed:
        """A query over lists in a row: their elements as structs of aliases, filtered and transformed in place."""
        scalar = all(s.ty.name != "List" for s in sources)
        rows, types = None, {}
        for alias, s in zip(node["aliases"], sources, strict=True):
            if s.ty == Y.ANY:
                s = Typed(F.array().cast("array<string>"), Y.list_of(Y.ANY))
            element = s.ty.inner[0] if s.ty.name == "List" else s.ty
            items = F.coalesce(s.col, F.array().cast(Y.ddl(s.ty))) if s.ty.name == "List" else F.array(s.col)
            types[alias] = element
            if rows is None:
                rows = _wrap(items, alias)
            else:
                rows = _product(rows, items, list(types)[:-1], alias)

        def scope(r: Column) -> Env:
            out = env.bind(**{a: Typed(r.getField(a), t) for a, t in types.items()})
            for name, e in node["lets"] or []:
                out = out.bind(**{name: self.expr(e, out)})
            return out

        plain = lambda r: env.bind(**{a: Typed(r.getField(a), t) for a, t in types.items()})
        for kind, alias, related, such in node["relations"] or []:
            rel = self.expr(related, env)
            items = rel.col if rel.ty.name == "List" else F.array(rel.col)
            element = rel.ty.inner[0] if rel.ty.name == "List" else rel.ty

            def some(r: Column, items=items, element=element, alias=alias, such=such) -> Column:
                test = (lambda y: F.lit(True)) if such is None else (lambda y: F.coalesce(self.expr(such, plain(r).bind(**{alias: Typed(y, element)})).col, F.lit(False)))
                return F.coalesce(F.exists(items, test), F.lit(False))

            rows = _filter(rows, (lambda r, some=some: some(r)) if kind == "with" else (lambda r, some=some: ~some(r)))
        if node["where"]:
            rows = _filter(rows, lambda r: self.expr(node["where"], scope(r)).col)
        if node["aggregate"]:
            name, start, body, distinct = node["aggregate"]
            if distinct:
                rows = F.array_distinct(rows)
            row_type = Y.tuple_of(types)
            begin = self.expr(start, env) if start else null()
            if begin.ty == Y.ANY:  # without a start the total is null, and stays so unless the body makes something of null
                probe = self.expr(body, env.bind(**{a: null(t) for a, t in types.items()}, **{name: null(Y.INTEGER)}))
                begin = null(probe.ty)
            return self.fold(Typed(rows, Y.list_of(row_type)), begin, lambda t, x: self.expr(body, scope(x.col).bind(**{name: t})))
        one = len(types) == 1
        seen: list[Ty] = []

        def result(r: Column) -> Column:
            if node["return"]:
                out = self.expr(node["return"][0], scope(r))
            elif one:
                out = Typed(r.getField(next(iter(types))), next(iter(types.values())))
            else:
                out = Typed(r, Y.tuple_of(types))
            seen.append(out.ty)
            return out.col

        items = F.transform(rows, lambda r: result(r))
        ty = seen[-1]
        if node["return"] and node["return"][1]:
            items = F.array_distinct(items)
        for e, ascending in reversed(node["sort"] or []):
            items = self.sorted(items, ty, e, ascending, env)
        if scalar:
            return Typed(F.get(items, F.lit(0)), ty)
        return Typed(items, Y.list_of(ty))

    def sorted(self, items: Column, ty: Ty, e: Node | None, ascending: bool, env: Env) -> Column:
        def key(x: Column) -> Column:
            if e is None:
                return x
            names = {n: Typed(x.getField(n), t) for n, t in zip(ty.fields, ty.inner, strict=True)} if ty.name == "Tuple" else {"value": Typed(x, ty)}
            if ty in (Y.QUANTITY, Y.CODE):
                names = {n: self.property(Typed(x, ty), n) for n in (("value", "unit") if ty == Y.QUANTITY else ("code", "system"))}
            return self.expr(e, env.bind(**{"$this": Typed(x, ty)}, **names)).col

        if e is None and ty not in Y.PARTIAL:
            return F.sort_array(items, ascending)
        pairs = F.transform(items, lambda x, i: F.struct(key(x).alias("k"), (i if ascending else -i).alias("i"), x.alias("x")))
        return F.transform(F.sort_array(pairs, ascending), lambda p: p["x"])

    def relation_query(self, node: Node, sources: list, env: Env) -> Relation | Typed:
        """A query over tables: joins, filters, projections, in the order of the clauses."""
        df, types, context = None, {}, None
        for alias, s in zip(node["aliases"], sources, strict=True):
            if isinstance(s, Typed):
                raise CompileError("a query's sources must all be tables or all lists")
            part = s.df.select(F.struct(*[F.col(f"`{c}`") for c in s.df.columns]).alias(alias)) if s.ty.name == "Tuple" else s.df.select(F.col(s.df.columns[0]).alias(alias))
            context = context or (f"{alias}.{s.context}" if s.context else None)
            df = part if df is None else df.crossJoin(part)
            types[alias] = s.ty
        base = env.bind(**{a: Typed(F.col(f"`{a}`"), t) for a, t in types.items()})
        for kind, alias, related, such in node["relations"] or []:
            rel = self.any(related, env)
            if isinstance(rel, Typed):
                raise CompileError("a related source must be a table here")
            part = rel.df.select(F.struct(*[F.col(f"`{c}`") for c in rel.df.columns]).alias(alias))
            on = F.lit(True) if such is None else self.expr(such, base.bind(**{alias: Typed(F.col(f"`{alias}`"), rel.ty)})).col
            df = df.join(part, on, "left_semi" if kind == "with" else "left_anti")
        scope = base
        outer, self.pending = self.pending, []

        def asked(df: DataFrame) -> DataFrame:
            """``df`` with the value sets' flags that the last expression needs."""
            while self.pending:
                x, url, flag = self.pending.pop(0)
                code, system = (x.col, None) if x.ty == Y.STRING else (x.col["code"], F.coalesce(x.col["system"], F.lit("")))
                df = self.terminology.flag_in_value_set(df, code, url, flag, system)
            return df

        try:
            return self._relation_clauses(node, df, types, context, env, scope, asked)
        finally:
            self.pending = outer

    def _relation_clauses(self, node: Node, df: DataFrame, types: dict, context: str | None, env: Env, scope: Env, asked) -> Relation:
        for n, e in node["lets"] or []:
            v = self.expr(e, scope)
            df = asked(df)
            df = df.withColumn(f"_let_{n}", v.col)
            scope = scope.bind(**{n: Typed(F.col(f"_let_{n}"), v.ty)})
        if node["where"]:
            test = self.expr(node["where"], scope).col
            df = asked(df).filter(test)
        if node["aggregate"]:
            return self.relation_fold(node, df, scope, env)
        if node["return"]:
            out = self.expr(node["return"][0], scope)
        elif len(types) == 1:
            out = next(iter(scope.names[a] for a in types))
        else:
            out = Typed(F.struct(*[F.col(f"`{a}`") for a in types]), Y.tuple_of(types))
        df = asked(df)
        flat = out.ty.name == "Tuple"
        keep = [F.col(context).alias("_context")] if context and context.partition(".")[2] not in (out.ty.fields if flat else ()) and self.context != "Unfiltered" else []
        made = df.select(out.col.alias("_r"), *keep)
        df = made.select(*[F.col("_r").getField(n).alias(n) for n in out.ty.fields], *[k for k in ["_context"] if keep]) if flat else made.withColumnRenamed("_r", "value")
        if node["return"] and node["return"][1]:
            df = df.dropDuplicates()
        order = []
        if node["sort"]:
            names = {n: Typed(F.col(f"`{n}`"), t) for n, t in zip(out.ty.fields, out.ty.inner, strict=True)} if flat else {"value": Typed(F.col("value"), out.ty)}
            keys = [(self.expr(e, env.bind(**names)).col if e else (F.struct(*[F.col(f"`{c}`") for c in df.columns]) if flat else F.col("value")), up) for e, up in node["sort"]]
            df, order = df.orderBy(*[k.asc_nulls_first() if up else k.desc_nulls_last() for k, up in keys]), keys
        return Relation(df, out.ty, "_context" if keep else context.partition(".")[2] if context and context.partition(".")[2] in (out.ty.fields if flat else ()) else None, order)

    def relation_fold(self, node: Node, df: DataFrame, scope: Env, env: Env) -> Relation:
        """Folds over tables need no order only if they are one of the known aggregates: total + x, total * x, and / or."""
        name, start, body, distinct = node["aggregate"]
        parts = [a for a in body.args if not (a.kind == "IdentifierRef" and a["name"] == name)]
        if body.kind not in ("Add", "Multiply", "And", "Or") or len(parts) != 1 or len(body.args) != 2:
            raise CompileError("a fold over a table must be a sum, a product, or a Boolean reduction; use Query.aggregate with an order")
        v = self.expr(parts[0], scope)
        if distinct:
            df = df.dropDuplicates()
        begin = self.expr(start, env) if start else null(v.ty)
        total = Typed(F.col("a").cast(Y.ddl(v.ty)), v.ty)
        if body.kind == "Multiply" and v.ty in (Y.INTEGER, Y.LONG):
            whole_ = R.product(df.select(v.col.alias("a")), [], "a", "a", Y.ddl(v.ty))
            joined = OPERATIONS[body.kind](self, begin, Typed(F.coalesce(total.col, F.lit(1).cast(Y.ddl(v.ty))), v.ty))
            return Relation(whole_.select(joined.col.alias("value")), joined.ty)
        agg = {"Add": F.sum, "Multiply": G.product, "And": F.bool_and, "Or": F.bool_or}[body.kind](v.col)
        joined = OPERATIONS[body.kind](self, begin, Typed(F.coalesce(total.col, F.lit({"Add": 0, "Multiply": 1, "And": True, "Or": False}[body.kind]).cast(Y.ddl(v.ty))), v.ty))
        return Relation(df.agg(agg.alias("a")).select(joined.col.alias("value")), joined.ty)


def _wrap(items: Column, alias: str) -> Column:
    return F.transform(items, lambda x: F.struct(x.alias(alias)))


def _product(rows: Column, items: Column, aliases: list[str], alias: str) -> Column:
    return F.flatten(F.transform(rows, lambda r: F.transform(items, lambda x: F.struct(*[r.getField(a).alias(a) for a in aliases], x.alias(alias)))))


def _filter(rows: Column, test) -> Column:
    return F.filter(rows, lambda r: test(r))


# Operations: kind to a function of the compiler and typed operands.

OPERATIONS: dict[str, Callable[..., Typed]] = {}
WITH_NODE: set[str] = set()
RELATIONAL: dict[str, Callable] = {}


def operation(*kinds: str, node: bool = False):
    def keep(f):
        for k in kinds:
            OPERATIONS[k] = f
            if node:
                WITH_NODE.add(k)
        return f

    return keep


def same(a: Typed, b: Typed) -> tuple[Column, Column, Ty]:
    ty = Y.common(a.ty, b.ty)
    if ty is None:
        raise CompileError(f"{a.ty} and {b.ty} don't go together", 3)
    return Y.convert(a.col, a.ty, ty), Y.convert(b.col, b.ty, ty), ty


def temporal_quantity(x: Typed, q: Typed, sign: int) -> Typed:
    if q.ty == Y.ANY:
        return null(x.ty)
    if q.ty != Y.QUANTITY:
        raise CompileError(f"{x.ty} and {q.ty} don't go together", 3)
    full = Y.PARTIAL.get(x.ty, x.ty)
    unit = F.lower(F.coalesce(q.col["unit"], F.lit("hour" if full == Y.TIME else "day")))
    out = None
    for p in ("year", "month", "week", "day", "hour", "minute", "second", "millisecond"):
        words = [w for w, u in T.UNITS.items() if u == p]
        amount = q.col["value"] * sign
        moved = T.add_partial(x.col, amount, p, full.name) if x.ty in Y.PARTIAL else T.add(x.col, amount, p, full.name)
        out = F.when(unit.isin(*words), moved) if out is None else out.when(unit.isin(*words), moved)
    known = q.col["value"].isNull() | unit.isin(*T.UNITS)
    wrong = F.raise_error(F.concat(F.lit("not a unit of time: "), unit)).cast(Y.ddl(x.ty))
    return Typed(F.when(~known, wrong).otherwise(out), x.ty, x.offset, x.prec)


@operation("Add")
def add(c: Compiler, a: Typed, b: Typed) -> Typed:
    if a.ty in (Y.DATE, Y.DATETIME, Y.TIME) or a.ty in Y.PARTIAL:
        return temporal_quantity(a, b, 1)
    x, y, ty = same(a, b)
    if ty == Y.STRING:
        return Typed(S.concatenate(x, y), ty)
    if ty == Y.QUANTITY:
        return Typed(K.add_quantities(x, y), ty)
    if ty.name in ("Interval", "Uncertain"):
        return Typed(I.add(x, y), ty)
    return Typed(A.add(x, y).cast(Y.ddl(ty)), ty)


@operation("Subtract")
def subtract(c: Compiler, a: Typed, b: Typed) -> Typed:
    if a.ty in (Y.DATE, Y.DATETIME, Y.TIME) or a.ty in Y.PARTIAL:
        return temporal_quantity(a, b, -1)
    x, y, ty = same(a, b)
    if ty == Y.QUANTITY:
        return Typed(K.subtract_quantities(x, y), ty)
    if ty.name in ("Interval", "Uncertain"):
        return Typed(I.subtract(x, y), ty)
    return Typed(A.subtract(x, y).cast(Y.ddl(ty)), ty)


@operation("Multiply")
def multiply(c: Compiler, a: Typed, b: Typed) -> Typed:
    if Y.QUANTITY in (a.ty, b.ty):
        q, n = (a, b) if a.ty == Y.QUANTITY else (b, a)
        if n.ty == Y.QUANTITY:
            value = A.multiply_decimal(a.col["value"], b.col["value"])
            ones = lambda u: F.coalesce(u, F.lit("1"))
            ua, ub = ones(a.col["unit"]), ones(b.col["unit"])
            return Typed(V.quantity(value, F.when(ub == "1", ua).when(ua == "1", ub).otherwise(F.concat_ws(".", ua, ub))), Y.QUANTITY)
        return Typed(K.multiply_quantity(q.col, n.col), Y.QUANTITY)
    x, y, ty = same(a, b)
    if ty.name in ("Interval", "Uncertain"):
        return Typed(I.multiply(x, y), ty)
    return Typed(A.multiply_decimal(x, y) if ty == Y.DECIMAL else A.multiply(x, y).cast(Y.ddl(ty)), ty)


@operation("Divide")
def divide(c: Compiler, a: Typed, b: Typed) -> Typed:
    if a.ty == Y.QUANTITY and b.ty == Y.QUANTITY:
        return Typed(K.divide_quantities(a.col, b.col), Y.QUANTITY)
    if a.ty == Y.QUANTITY:
        return Typed(V.quantity(A.divide(a.col["value"], b.col), a.col["unit"]), Y.QUANTITY)
    return Typed(A.divide(a.col, b.col), Y.DECIMAL)


@operation("TruncatedDivide")
def truncated_divide(c: Compiler, a: Typed, b: Typed) -> Typed:
    if a.ty == Y.QUANTITY:
        return Typed(V.quantity(A.truncated_divide_decimal(a.col["value"], b.col["value"] if b.ty == Y.QUANTITY else b.col), F.lit("1") if b.ty == Y.QUANTITY else a.col["unit"]), Y.QUANTITY)
    x, y, ty = same(a, b)
    return Typed(A.truncated_divide_decimal(x, y) if ty == Y.DECIMAL else A.truncated_divide(x, y).cast(Y.ddl(ty)), ty)


@operation("Modulo")
def modulo(c: Compiler, a: Typed, b: Typed) -> Typed:
    if a.ty == Y.QUANTITY:
        return Typed(V.quantity(A.modulo(a.col["value"], b.col["value"]), a.col["unit"]), Y.QUANTITY)
    x, y, ty = same(a, b)
    return Typed(A.modulo(x, y).cast(Y.ddl(ty)), ty)


@operation("Power", node=True)
def power(c: Compiler, a: Typed, b: Typed, node: Node) -> Typed:
    """Whole unless a decimal takes part or the exponent is a negative literal."""
    x, y, ty = same(a, b)
    exponent = node.args[1]
    if exponent.kind == "Negate" or (exponent.kind == "Literal" and str(exponent["value"]).startswith("-")):
        ty = Y.DECIMAL
    return Typed(A.power(x, y, Y.ddl(ty)), ty)


@operation("Negate")
def negate(c: Compiler, a: Typed) -> Typed:
    return Typed(V.quantity(-a.col["value"], a.col["unit"]), a.ty) if a.ty == Y.QUANTITY else Typed(A.negate(a.col), a.ty)


@operation("Abs")
def absolute(c: Compiler, a: Typed) -> Typed:
    return Typed(V.quantity(F.abs(a.col["value"]), a.col["unit"]), a.ty) if a.ty == Y.QUANTITY else Typed(A.absolute(a.col), a.ty)


def whole(f):
    return lambda c, a: a if a.ty in (Y.INTEGER, Y.LONG) else Typed(f(Y.convert(a.col, a.ty, Y.DECIMAL)), Y.INTEGER)


OPERATIONS |= {"Ceiling": whole(A.ceiling), "Floor": whole(A.floor), "Truncate": whole(A.truncate)}


@operation("Round", node=True)
def round_(c: Compiler, a: Typed, places: Typed | None = None, node: Node | None = None) -> Typed:
    x = Y.convert(a.col, a.ty, Y.DECIMAL)
    if places is None:
        return Typed(A.round_(x), Y.DECIMAL)
    p = node.args[1]
    if p.kind == "Literal" and p["type"] == "Integer":
        return Typed(A.round_(x, int(p["value"])), Y.DECIMAL)
    return Typed(A.round_(x, Y.convert(places.col, places.ty, Y.INTEGER)), Y.DECIMAL)


OPERATIONS |= {
    "Ln": lambda c, a: Typed(A.ln(a.col), Y.DECIMAL), "Exp": lambda c, a: Typed(A.exp(a.col), Y.DECIMAL), "Log": lambda c, a, b: Typed(A.log(a.col, b.col), Y.DECIMAL),
    "Successor": lambda c, a: step_of(a, 1), "Predecessor": lambda c, a: step_of(a, -1),
}


def step_of(a: Typed, by: int) -> Typed:
    move = A.successor if by > 0 else A.predecessor
    if a.ty in Y.PARTIAL:
        return Typed(T.step_partial(a.col, by, Y.PARTIAL[a.ty].name), a.ty, a.offset, a.prec)
    if a.ty == Y.QUANTITY:
        return Typed(V.quantity(move(a.col["value"], "Decimal"), a.col["unit"]), a.ty)
    if a.ty == Y.ANY:
        return a
    if a.ty.name not in A.MINIMUM:
        raise CompileError(f"{a.ty} has no {'next' if by > 0 else 'previous'} value", 3)
    return Typed(move(a.col, a.ty.name), a.ty, a.offset)


@operation("Precision")
def precision(c: Compiler, a: Typed) -> Typed:
    if a.ty in Y.PARTIAL:
        digits = T.precision_digits(a.col) if a.ty != Y.P_TIME else ((a.col["prec"] - 3) * 2).cast("int")
        return Typed(digits, Y.INTEGER)
    fixed = {"Date": 8, "DateTime": 17, "Time": 9}
    return Typed(F.when(a.col.isNotNull(), fixed[a.ty.name]) if a.ty.name in fixed else A.precision(a.col), Y.INTEGER)


@operation("LowBoundary", "HighBoundary", node=True)
def boundary(c: Compiler, a: Typed, places: Typed | None = None, node: Node | None = None) -> Typed:
    low = node.kind == "LowBoundary"
    if a.ty in Y.PARTIAL:
        return Typed(a.col["lo" if low else "hi"], Y.PARTIAL[a.ty])
    if a.ty != Y.DECIMAL:
        return a
    text = node.args[0]["value"] if node.args[0].kind == "Literal" else ""
    return Typed(A.decimal(A.low_boundary(a.col) if low else A.high_boundary(a.col, len(str(text).partition(".")[2]))), Y.DECIMAL)


def equal(c: Compiler, a: Typed, b: Typed) -> Typed:
    ty = Y.common(a.ty, b.ty)
    if ty is None:
        return Typed(F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False)), Y.BOOLEAN)
    x, y = Y.convert(a.col, a.ty, ty), Y.convert(b.col, b.ty, ty)
    return Typed(_equal(x, y, ty), Y.BOOLEAN)


def _equal(x: Column, y: Column, ty: Ty) -> Column:
    if ty in Y.PARTIAL:
        return T.partial_equal(x, y)
    if ty == Y.QUANTITY:
        return C.equal_quantities(x, y)
    if ty.name == "Uncertain":
        return F.when((x["high"] < y["low"]) | (y["high"] < x["low"]), False).when((x["low"] == x["high"]) & (y["low"] == y["high"]), True)
    if ty.name == "Choice":
        return F.when(x.isNotNull() & y.isNotNull(), x.eqNullSafe(y))
    if ty == Y.CODE:
        return C.equal_codes(x, y)
    if ty.name == "List":
        return C.equal_lists(x, y, lambda p, q: _equal(p, q, ty.inner[0]))
    if ty.name == "Tuple":
        parts = F.array(*[C._element_equal(x.getField(n), y.getField(n), lambda p, q, t=t: _equal(p, q, t)) for n, t in zip(ty.fields, ty.inner, strict=True)])
        unknown = F.lit(None).cast("boolean")
        out = F.when(F.exists(parts, lambda s: s.eqNullSafe(F.lit(False))), False).when(F.exists(parts, lambda s: s.isNull()), unknown).otherwise(True)
        return F.when(x.isNotNull() & y.isNotNull(), out)
    if ty.name == "Interval":
        return C.equal_intervals(x, y)
    if ty == Y.CONCEPT:
        return C.equal_lists(x["codes"], y["codes"], C.equal_codes)
    if ty == Y.RATIO:
        return C.equal_quantities(x["numerator"], y["numerator"]) & C.equal_quantities(x["denominator"], y["denominator"])
    return C.equal(x, y)


def _equivalent(x: Column, y: Column, ty: Ty) -> Column:
    nulls = F.when(x.isNull() | y.isNull(), x.isNull() & y.isNull())
    if ty == Y.STRING:
        return C.equivalent_strings(x, y)
    if ty == Y.CODE:
        return C.equivalent_codes(x, y)
    if ty == Y.CONCEPT:
        return C.equivalent_concepts(x, y)
    if ty.name == "List":
        return C.equivalent_lists(x, y, lambda p, q: _equivalent(p, q, ty.inner[0]))
    if ty.name == "Tuple":
        return nulls.otherwise(C.all_of([_equivalent(x.getField(n), y.getField(n), t) for n, t in zip(ty.fields, ty.inner, strict=True)]))
    return nulls.otherwise(F.coalesce(_equal(x, y, ty), F.lit(False)))


@operation("Equivalent")
def equivalent(c: Compiler, a: Typed, b: Typed) -> Typed:
    ty = Y.common(a.ty, b.ty)
    if ty is None:
        return Typed(a.col.isNull() & b.col.isNull(), Y.BOOLEAN)
    return Typed(_equivalent(Y.convert(a.col, a.ty, ty), Y.convert(b.col, b.ty, ty), ty), Y.BOOLEAN)


OPERATIONS |= {"Equal": equal, "NotEqual": lambda c, a, b: Typed(~equal(c, a, b).col, Y.BOOLEAN)}


def ordered(strict: bool, swap: bool):
    def compare(c: Compiler, a: Typed, b: Typed) -> Typed:
        if swap:
            a, b = b, a
        x, y, ty = same(a, b)
        if ty in (Y.BOOLEAN, Y.CODE, Y.CONCEPT) or ty.name in ("List", "Tuple", "Interval"):
            raise CompileError(f"{ty} has no order")
        if ty.name == "Uncertain":
            surely, never = (x["high"] < y["low"], x["low"] >= y["high"]) if strict else (x["high"] <= y["low"], x["low"] > y["high"])
            return Typed(F.when(surely, True).when(never, False), Y.BOOLEAN)
        if ty in Y.PARTIAL:
            return Typed((T.partial_less if strict else T.partial_less_or_equal)(x, y), Y.BOOLEAN)
        if ty == Y.QUANTITY:
            return Typed(C.less_quantities(x, y) if strict else ~C.less_quantities(y, x), Y.BOOLEAN)
        return Typed(C.less(x, y) if strict else C.less_or_equal(x, y), Y.BOOLEAN)

    return compare


OPERATIONS |= {"Less": ordered(True, False), "Greater": ordered(True, True), "LessOrEqual": ordered(False, False), "GreaterOrEqual": ordered(False, True)}


@operation("Between")
def between(c: Compiler, x: Typed, low: Typed, high: Typed) -> Typed:
    return Typed(N.and_(OPERATIONS["GreaterOrEqual"](c, x, low).col, OPERATIONS["LessOrEqual"](c, x, high).col), Y.BOOLEAN)


def boolean(f):
    def run(c: Compiler, *args: Typed) -> Typed:
        for a in args:
            if a.ty not in (Y.BOOLEAN, Y.ANY):
                raise CompileError(f"expected Boolean, not {a.ty}")
        return Typed(f(*[Y.convert(a.col, a.ty, Y.BOOLEAN) for a in args]), Y.BOOLEAN)

    return run


OPERATIONS |= {"And": boolean(N.and_), "Or": boolean(N.or_), "Xor": boolean(N.xor), "Implies": boolean(N.implies), "Not": boolean(N.not_), "IsTrue": boolean(N.is_true), "IsFalse": boolean(N.is_false)}
OPERATIONS["IsNull"] = lambda c, a: Typed(a.col.isNull(), Y.BOOLEAN)


@operation("Coalesce")
def coalesce(c: Compiler, *args: Typed) -> Typed:
    if len(args) == 1 and args[0].ty.name == "List":
        return Typed(N.coalesce_list(args[0].col), args[0].ty.inner[0])
    ty = Y.joint([a.ty for a in args])
    return Typed(N.coalesce(*[Y.convert(a.col, a.ty, ty) for a in args]), ty)


def text(f, out: Ty = Y.STRING, ints: tuple[int, ...] = ()):
    def run(c: Compiler, *args: Typed) -> Typed:
        return Typed(f(*[Y.convert(a.col, a.ty, Y.INTEGER if i in ints else Y.STRING) for i, a in enumerate(args)]), out)

    return run


OPERATIONS |= {
    "Concatenate": text(S.concatenate), "Split": text(S.split, Y.list_of(Y.STRING)), "SplitOnMatches": text(S.split_on_matches, Y.list_of(Y.STRING)), "Upper": text(S.upper), "Lower": text(S.lower),
    "PositionOf": text(S.position_of, Y.INTEGER), "LastPositionOf": text(S.last_position_of, Y.INTEGER), "Substring": text(S.substring, Y.STRING, (1, 2)), "StartsWith": text(S.starts_with, Y.BOOLEAN),
    "EndsWith": text(S.ends_with, Y.BOOLEAN), "Matches": text(S.matches, Y.BOOLEAN), "ReplaceMatches": text(S.replace_matches), "ToChars": text(V.to_chars, Y.list_of(Y.STRING)),
}


@operation("Combine")
def combine(c: Compiler, items: Typed, separator: Typed | None = None) -> Typed:
    items = Typed(Y.convert(items.col, items.ty, Y.list_of(Y.STRING)), items.ty)
    return Typed(S.combine(items.col, "" if separator is None else Y.convert(separator.col, separator.ty, Y.STRING)), Y.STRING)


@operation("Length")
def length(c: Compiler, a: Typed) -> Typed:
    return Typed(F.size(a.col) if a.ty.name == "List" else S.length(Y.convert(a.col, a.ty, Y.STRING)), Y.INTEGER)


@operation("Indexer")
def indexer(c: Compiler, a: Typed, i: Typed) -> Typed:
    at = Y.convert(i.col, i.ty, Y.INTEGER)
    return Typed(L.indexer(a.col, at), a.ty.inner[0]) if a.ty.name == "List" else Typed(S.indexer(Y.convert(a.col, a.ty, Y.STRING), at), Y.STRING)


# Dates and times.

OPERATIONS |= {
    "Now": lambda c: lit(c.now, Y.DATETIME), "Today": lambda c: lit(c.now.date(), Y.DATE),
    "TimeOfDay": lambda c: lit(((c.now.hour * 60 + c.now.minute) * 60 + c.now.second) * 1000 + c.now.microsecond // 1000, Y.TIME),
}


@operation("Date")
def date_(c: Compiler, *parts: Typed) -> Typed:
    cols = [Y.convert(p.col, p.ty, Y.INTEGER) for p in parts]
    return Typed(T.date(*cols), Y.DATE) if len(cols) == 3 else Typed(T.partial_date(*cols), Y.P_DATE, prec=len(cols))


@operation("DateTime")
def date_time(c: Compiler, *parts: Typed) -> Typed:
    parts = list(parts)
    zone = parts.pop() if len(parts) == 8 else None
    offset = None if zone is None or zone.ty == Y.ANY else (Y.convert(zone.col, zone.ty, Y.DECIMAL) * 60).cast("int")
    if offset is not None:
        offset = F.when(F.abs(offset) <= 840, offset).when(offset.isNotNull(), F.raise_error(F.lit("offset out of range")).cast("int"))
    cols = [Y.convert(p.col, p.ty, Y.INTEGER) for p in parts]
    n = len(cols)
    one, zero = F.lit(1), F.lit(0)
    filled = [*cols, *[one, one, one, zero, zero, zero, zero][n:]]
    lo = T.date_time(*filled)
    if n == 7:
        return Typed(lo if offset is None else T.add(lo, -F.coalesce(offset, F.lit(0)), "minute"), Y.DATETIME, offset)
    month_end = F.last_day(F.make_date(filled[0], cols[1] if n > 1 else F.lit(12), one))
    day = month_end if n < 3 else F.make_date(*filled[:3])
    hi = T.date_time(F.year(day), F.month(day), F.day(day), *[*cols[3:], *[F.lit(23), F.lit(59), F.lit(59), F.lit(999)][max(n - 3, 0) :]])
    return Typed(F.when(lo.isNotNull(), F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(n).cast("tinyint").alias("prec"))), Y.P_DATETIME, prec=n)


@operation("Time")
def time_(c: Compiler, *parts: Typed) -> Typed:
    cols = [Y.convert(p.col, p.ty, Y.INTEGER) for p in parts]
    if len(cols) == 4:
        return Typed(T.time(*cols), Y.TIME)
    hi = T.time(*[*cols, *[F.lit(23), F.lit(59), F.lit(59), F.lit(999)][len(cols) :]])
    return Typed(F.struct(T.time(*cols).alias("lo"), hi.alias("hi"), F.lit(len(cols) + 3).cast("tinyint").alias("prec")), Y.P_TIME, prec=len(cols) + 3)


@operation("DateFrom")
def date_from(c: Compiler, a: Typed) -> Typed:
    if a.ty in Y.PARTIAL:
        part = F.struct(F.to_date(a.col["lo"]).alias("lo"), F.to_date(a.col["hi"]).alias("hi"), F.least(a.col["prec"], F.lit(3).cast("tinyint")).alias("prec"))
        return Typed(F.when(a.col.isNotNull(), part), Y.P_DATE)
    return Typed(T.date_from(a.col), Y.DATE)


@operation("TimeFrom")
def time_from(c: Compiler, a: Typed) -> Typed:
    if a.ty == Y.P_DATETIME:
        part = F.struct(T.time_from(a.col["lo"]).alias("lo"), T.time_from(a.col["hi"]).alias("hi"), a.col["prec"].alias("prec"))
        return Typed(F.when(a.col["prec"] > 3, part), Y.P_TIME)
    return Typed(T.time_from(a.col), Y.TIME)


def zone_of(a: Typed) -> Column:
    """Minutes east of UTC: what the expression says, else those of the engine, which keeps date-times in UTC."""
    return F.when(a.col.isNotNull(), F.lit(0) if a.offset is None else F.coalesce(a.offset, F.lit(0)))


OPERATIONS |= {"TimezoneOffsetFrom": lambda c, a: Typed(T.timezone_offset(zone_of(a)), Y.DECIMAL), "TimezoneFrom": lambda c, a: Typed(T.timezone_text(zone_of(a)), Y.STRING)}


@operation("DateTimeComponentFrom", node=True)
def component(c: Compiler, a: Typed, node: Node) -> Typed:
    p = T.unit(node["precision"])
    need = T.PRECISIONS.index(p) + 1
    full = Y.PARTIAL.get(a.ty, a.ty)
    x = a.col["lo"] if a.ty in Y.PARTIAL else a.col
    if full == Y.ANY or (full == Y.DATE and need > 3) or (full == Y.TIME and need < 4):
        return null(Y.INTEGER)
    out = T.time_component(x, p) if full == Y.TIME else T.component(x, p).cast("int")
    return Typed(F.when(a.col["prec"] >= need, out) if a.ty in Y.PARTIAL else out, Y.INTEGER)


@operation("DurationBetween", "DifferenceBetween", node=True)
def duration(c: Compiler, a: Typed, b: Typed, node: Node) -> Typed:
    p = T.unit(node["precision"])
    x, y, ty = same(a, b)
    f = T.duration_between if node.kind == "DurationBetween" else T.difference_between
    full = Y.PARTIAL.get(ty, ty)
    if full == Y.ANY:
        return null(Y.INTEGER)
    if full == Y.TIME:
        size = T._MICROS[p] // 1000
        if ty in Y.PARTIAL:
            x, y = x["lo"], y["lo"]
        out = F.call_function("div", y - x, F.lit(size)) if node.kind == "DurationBetween" else F.floor(y / size) - F.floor(x / size)
        return Typed(out.cast("int"), Y.INTEGER)
    if ty in Y.PARTIAL:
        known = [t.prec if t.ty in Y.PARTIAL else {Y.DATE: 3, Y.DATETIME: 7}.get(t.ty) for t in (a, b)]
        if node.kind == "DurationBetween" and None not in known and (known[0] != known[1] or known[0] < T.COMPONENTS[p]):
            return Typed(T.partial_duration(x, y, p), Y.UNCERTAIN)
        # A point if both ends of what is known agree; else unknown.
        low, high = f(x["hi"], y["lo"], p), f(x["lo"], y["hi"], p)
        if node.kind == "DifferenceBetween":
            known = F.least(x["prec"], y["prec"]) >= {"year": 1, "month": 2, "week": 3, "day": 3, "hour": 4, "minute": 5, "second": 6, "millisecond": 7}[p]
            return Typed(F.when(known, f(x["lo"], y["lo"], p)), Y.INTEGER)
        same_precision = (x["prec"] == y["prec"]) & (x["prec"] >= {"year": 1, "month": 2, "week": 3, "day": 3, "hour": 4, "minute": 5, "second": 6, "millisecond": 7}[p])
        return Typed(F.when(same_precision, f(x["lo"], y["lo"], p)).when(low == high, low), Y.INTEGER)
    return Typed(f(x, y, p), Y.INTEGER)


def _at(x: Column, ty: Ty, precision: str | None) -> Column:
    if precision is None or ty == Y.TIME:
        return x if precision is None else F.floor(x / (T._MICROS[T.unit(precision)] // 1000))
    return T.truncated(x, precision)


@operation("SameAs", "SameOrBefore", "SameOrAfter", "Before", "After", node=True)
def timing(c: Compiler, a: Typed, b: Typed, node: Node) -> Typed:
    kind, p = node.kind, node["precision"]
    if p and T.unit(p) == "week":
        raise CompileError("weeks aren't a precision of dates and times", 3)
    if "Interval" in (a.ty.name, b.ty.name):
        return interval_timing(c, a, b, kind, p)
    x, y, ty = same(a, b)
    if ty in Y.PARTIAL:
        if p is None:
            f = {"SameAs": T.partial_equal, "SameOrBefore": T.partial_less_or_equal, "Before": T.partial_less}
            if kind in ("SameOrAfter", "After"):
                x, y, kind = y, x, {"SameOrAfter": "SameOrBefore", "After": "Before"}[kind]
            return Typed(f[kind](x, y), Y.BOOLEAN)
        full = Y.PARTIAL[ty]
        need = T.PRECISIONS.index(T.unit(p)) + 1
        lo = [_at(z["lo"], full, p) for z in (x, y)]
        hi = [_at(z["hi"], full, p) for z in (x, y)]
        known = F.least(x["prec"], y["prec"]) >= need
        truth = {"SameAs": lo[0] == lo[1], "SameOrBefore": lo[0] <= lo[1], "SameOrAfter": lo[0] >= lo[1], "Before": lo[0] < lo[1], "After": lo[0] > lo[1]}[kind]
        left, right = hi[0] < lo[1], hi[1] < lo[0]
        surely = {"SameAs": F.when(left | right, False), "SameOrBefore": F.when(left, True).when(right, False), "Before": F.when(left, True).when(right, False), "SameOrAfter": F.when(right, True).when(left, False), "After": F.when(right, True).when(left, False)}[kind]
        return Typed(F.when(known, truth).otherwise(surely), Y.BOOLEAN)
    if ty == Y.ANY:
        return null(Y.BOOLEAN)
    if ty not in (Y.DATE, Y.DATETIME, Y.TIME):
        p = None
    x, y = _at(x, ty, p), _at(y, ty, p)
    return Typed({"SameAs": x == y, "SameOrBefore": x <= y, "SameOrAfter": x >= y, "Before": x < y, "After": x > y}[kind], Y.BOOLEAN)


def interval_timing(c: Compiler, a: Typed, b: Typed, kind: str, p: str | None) -> Typed:
    point = Y.common(*[t.ty.inner[0] if t.ty.name == "Interval" else t.ty for t in (a, b)])
    if point is None or point in Y.PARTIAL:
        raise CompileError("interval timing needs bounds of a common, whole type")
    as_interval = lambda t: Y.convert(t.col, t.ty, Y.interval_of(point)) if t.ty.name == "Interval" else I._from(*[Y.convert(t.col, t.ty, point)] * 2, F.lit(True), F.lit(True))
    x, y = as_interval(a), as_interval(b)
    if p:
        x, y = I._trunc(x, p), I._trunc(y, p)
    if kind == "SameAs":
        return Typed((x["low"] == y["low"]) & (x["high"] == y["high"]), Y.BOOLEAN)
    if kind in ("SameOrBefore", "SameOrAfter"):
        return Typed(x["high"] <= y["low"] if kind == "SameOrBefore" else x["low"] >= y["high"], Y.BOOLEAN)
    return Typed(I.before(x, y) if kind == "Before" else I.after(x, y), Y.BOOLEAN)


# Intervals and lists.


def contains(c: Compiler, box: Typed, x: Typed, node: Node | None = None) -> Typed:
    if box.ty.name == "List":
        element = Y.common(box.ty.inner[0], x.ty)
        if element is None:
            return lit(False, Y.BOOLEAN)
        items, item = Y.convert(box.col, box.ty, Y.list_of(element)), Y.convert(x.col, x.ty, element)
        return Typed(F.coalesce(F.exists(items, lambda e: F.coalesce(_equivalent(e, item, element) if element != Y.STRING else e.eqNullSafe(item), F.lit(False))), F.lit(False)), Y.BOOLEAN)
    if box.ty.name == "Interval":
        if x.ty.name == "Interval":
            return Typed(I.includes(*[Y.convert(t.col, t.ty, Y.common(box.ty, x.ty)) for t in (box, x)]), Y.BOOLEAN)
        point = Y.common(box.ty.inner[0], x.ty)
        if point is None or point in Y.PARTIAL:
            raise CompileError("the point must be of the interval's type")
        i, p = Y.convert(box.col, box.ty, Y.interval_of(point)), Y.convert(x.col, x.ty, point)
        if node is not None and node["precision"]:
            i, p = I._trunc(i, node["precision"]), T.truncated(p, node["precision"])
        return Typed(I.contains(i, p), Y.BOOLEAN)
    if box.ty == Y.ANY:
        return lit(False, Y.BOOLEAN)
    raise CompileError(f"{box.ty} contains nothing")


OPERATIONS |= {"Contains": lambda c, box, x, node: contains(c, box, x, node), "ProperContains": lambda c, box, x, node: contains(c, box, x, node), "ProperIn": lambda c, x, box, node: contains(c, box, x, node)}
WITH_NODE |= {"Contains", "ProperContains", "ProperIn"}


def both_intervals(a: Typed, b: Typed) -> tuple[Column, Column, str]:
    point = Y.common(*[t.ty.inner[0] if t.ty.name == "Interval" else t.ty for t in (a, b)])
    if point is None or point in Y.PARTIAL:
        raise CompileError("intervals need a common point type of full precision")
    conv = lambda t: Y.convert(t.col, t.ty, Y.interval_of(point)) if t.ty.name in ("Interval", "Any") else I._from(*[Y.convert(t.col, t.ty, point)] * 2, F.lit(True), F.lit(True))
    return conv(a), conv(b), point.name


def relation_of(name: str, list_form=None, precise: bool = False, stepped: bool = False):
    def run(c: Compiler, a: Typed, b: Typed, node: Node) -> Typed:
        if "List" in (a.ty.name, b.ty.name) and list_form:
            as_list = lambda t: t if t.ty.name == "List" else Typed(F.array(t.col), Y.list_of(t.ty))
            x, y, ty = same(as_list(a), as_list(b))
            return Typed(list_form(x, y), Y.BOOLEAN)
        if a.ty == Y.ANY and b.ty == Y.ANY:
            return null(Y.BOOLEAN)
        x, y, kind = both_intervals(a, b)
        f = getattr(I, name)
        if stepped:
            return Typed(f(x, y, kind), Y.BOOLEAN)
        return Typed(f(x, y, node["precision"]) if precise and node["precision"] else f(x, y), Y.BOOLEAN)

    return run


for _kind, _name, _list, _precise, _stepped in (
    ("Includes", "includes", L.includes, True, False), ("IncludedIn", "included_in", L.included_in, True, False), ("ProperIncludes", "proper_includes", L.proper_includes, True, False),
    ("ProperIncludedIn", "proper_included_in", L.proper_included_in, True, False), ("Meets", "meets", None, False, True), ("MeetsBefore", "meets_before", None, False, True), ("MeetsAfter", "meets_after", None, False, True),
    ("Overlaps", "overlaps", None, False, False), ("OverlapsBefore", "overlaps_before", None, False, False), ("OverlapsAfter", "overlaps_after", None, False, False), ("Starts", "starts", None, False, False), ("Ends", "ends", None, False, False),
):
    OPERATIONS[_kind] = relation_of(_name, _list, _precise, _stepped)
    WITH_NODE.add(_kind)

OPERATIONS |= {
    "Start": lambda c, a: Typed(I.start(a.col), a.ty.inner[0]), "End": lambda c, a: Typed(I.end(a.col), a.ty.inner[0]), "PointFrom": lambda c, a: Typed(I.point_from(a.col), a.ty.inner[0]),
    "Width": lambda c, a: Typed(I.width(a.col).cast(Y.ddl(a.ty.inner[0])), a.ty.inner[0]), "Size": lambda c, a: Typed(I.size(a.col).cast("int"), Y.INTEGER),
}


def set_operator(list_form, interval_form, stepped: bool):
    def run(c: Compiler, a: Typed, b: Typed) -> Typed:
        if "Interval" in (a.ty.name, b.ty.name):
            x, y, kind = both_intervals(a, b)
            return Typed(interval_form(x, y, kind) if stepped else interval_form(x, y), a.ty if a.ty.name == "Interval" else b.ty)
        x, y, ty = same(a, b)
        if ty.name != "List":
            return null()
        return Typed(list_form(x, y), ty)

    return run


OPERATIONS |= {"Union": set_operator(L.union, I.union, True), "Intersect": set_operator(L.intersect, I.intersect, False), "Except": set_operator(L.except_, I.except_, True)}


@operation("Collapse")
def collapse(c: Compiler, a: Typed, per: Typed | None = None) -> Typed:
    kind = a.ty.inner[0].inner[0].name
    if per is None or per.ty == Y.ANY:
        return Typed(I.collapse(a.col, kind), a.ty)
    step, unit = per_step(per, kind)
    return Typed(I.collapse_per(a.col, step, kind, unit), a.ty)


def per_step(per: Typed, kind: str) -> tuple[Column, str | None]:
    """The value of a ``per`` quantity in the points' own type, and the unit that it names."""
    if per.ty != Y.QUANTITY:
        raise CompileError("per needs a quantity", 3)
    value = per.col["value"]
    value = value if kind == "Decimal" or kind == "Quantity" else value.cast("int")
    return value, per.unit


@operation("Expand")
def expand(c: Compiler, a: Typed, per: Typed | None = None) -> Typed:
    kind = (a.ty.inner[0] if a.ty.name == "Interval" else a.ty.inner[0].inner[0]).name
    step, unit = (1, None) if per is None or per.ty == Y.ANY else per_step(per, kind)
    if a.ty.name == "Interval":
        return Typed(I.expand(a.col, step, kind, unit), Y.list_of(a.ty.inner[0]))
    return Typed(F.flatten(F.transform(a.col, lambda i: I.expand_intervals(i, step, kind, unit))), a.ty)


def of_list(f, out: Ty | None = None):
    """A list operator; its result is of the element type unless ``out`` says otherwise."""

    def run(c: Compiler, a: Typed, *more: Typed) -> Typed:
        if a.ty.name != "List":
            a = Typed(F.when(a.col.isNotNull(), F.array(a.col)) if a.ty != Y.ANY else F.lit(None).cast("array<string>"), Y.list_of(a.ty))
        return Typed(f(a.col, *[m.col for m in more]), a.ty if out == "same" else out or a.ty.inner[0])

    return run


OPERATIONS |= {
    "Exists": of_list(L.exists, Y.BOOLEAN), "First": of_list(L.first), "Last": of_list(L.last), "Distinct": of_list(L.distinct, "same"), "Sort": of_list(L.sort, "same"),
    "Take": of_list(lambda a, n: L.take(a, n), "same"), "Skip": of_list(lambda a, n: L.skip(a, n), "same"), "Tail": of_list(L.tail, "same"), "Slice": of_list(lambda a, s, e=None: L.slice_(a, s, e), "same"),
    "SingletonFrom": of_list(L.singleton_from), "Count": of_list(lambda a: L.count(a).cast("int"), Y.INTEGER), "Min": of_list(L.min_), "Max": of_list(L.max_), "Mode": of_list(L.mode),
    "AllTrue": of_list(lambda a: L.all_true(a.cast("array<boolean>")), Y.BOOLEAN), "AnyTrue": of_list(lambda a: L.any_true(a.cast("array<boolean>")), Y.BOOLEAN),
}


@operation("IndexOf")
def index_of(c: Compiler, a: Typed, x: Typed) -> Typed:
    element = Y.common(a.ty.inner[0], x.ty) if a.ty.name == "List" else None
    if element is None:
        return null(Y.INTEGER)
    return Typed(L.index_of(Y.convert(a.col, a.ty, Y.list_of(element)), Y.convert(x.col, x.ty, element)), Y.INTEGER)


@operation("Flatten")
def flatten(c: Compiler, a: Typed) -> Typed:
    return Typed(L.flatten(a.col), a.ty.inner[0]) if a.ty.inner and a.ty.inner[0].name == "List" else a


@operation("Times")
def times(c: Compiler, a: Typed, b: Typed) -> Typed:
    return Typed(L.times(a.col, b.col), Y.list_of(Y.tuple_of({"X": a.ty.inner[0], "Y": b.ty.inner[0]})))


def statistic(f, decimal: bool, quantity: bool = True):
    def run(c: Compiler, a: Typed) -> Typed:
        element = a.ty.inner[0] if a.ty.name == "List" else Y.ANY
        if element == Y.ANY:
            return null(Y.DECIMAL)
        if element == Y.QUANTITY and quantity:
            values = F.transform(a.col, lambda q: q["value"])
            unit = N.coalesce_list(F.transform(a.col, lambda q: q["unit"]))
            return Typed(F.when(F.exists(a.col, lambda q: q["value"].isNotNull()), V.quantity(f(values), unit)), Y.QUANTITY)
        ty = Y.DECIMAL if decimal else element
        return Typed(f(a.col).cast(Y.ddl(ty)), ty)

    return run


OPERATIONS |= {
    "Sum": statistic(lambda a: F.when(F.exists(a, lambda x: x.isNotNull()), F.aggregate(F.filter(a, lambda x: x.isNotNull()), F.lit(0).cast("decimal(38,8)"), lambda t, x: (t + x).cast("decimal(38,8)"))), False),
    "Product": lambda c, a: product_of(a),
    "Avg": statistic(L.avg, True), "Median": statistic(L.median, True), "GeometricMean": statistic(L.geometric_mean, True), "Variance": statistic(L.variance, True), "StdDev": statistic(L.std_dev, True),
    "PopulationVariance": statistic(L.population_variance, True), "PopulationStdDev": statistic(L.population_std_dev, True),
}

def product_of(a: Typed) -> Typed:
    """Exact: of whole numbers in longs, which raise where they overflow; of decimals to 8 places at each step."""
    element = a.ty.inner[0] if a.ty.name == "List" else Y.ANY
    one, times = (F.lit(1).cast("bigint"), lambda t, x: t * x.cast("bigint")) if element in (Y.INTEGER, Y.LONG) else (F.lit(1).cast("decimal(28,8)"), A.multiply_decimal)
    return statistic(lambda v: F.when(F.exists(v, lambda x: x.isNotNull()), F.aggregate(F.filter(v, lambda x: x.isNotNull()), one, times)), False)(None, a)


# Conversions.


def to_boolean(c: Compiler, a: Typed) -> Typed:
    if a.ty == Y.BOOLEAN:
        return a
    return Typed(V.boolean_from_number(a.col) if a.ty in Y.NUMBERS else V.to_boolean(a.col), Y.BOOLEAN)


def to_number(ty: Ty):
    def run(c: Compiler, a: Typed) -> Typed:
        if a.ty == Y.BOOLEAN:
            return Typed(a.col.cast("int").cast(Y.ddl(ty)), ty)
        if a.ty == Y.QUANTITY:
            return Typed(a.col["value"].cast(Y.ddl(ty)), ty)
        if a.ty in Y.NUMBERS:
            return Typed(V.integer_from_number(a.col) if ty == Y.INTEGER else a.col.cast(Y.ddl(ty)), ty)
        return Typed({"Integer": V.to_integer, "Long": V.to_long, "Decimal": V.to_decimal}[ty.name](Y.convert(a.col, a.ty, Y.STRING)), ty)

    return run


def _plain(x: Column) -> Column:
    """A decimal without the places that don't count, one at least."""
    return F.regexp_replace(x.cast("string"), r"(\.\d*?[1-9]|\.0)0+$|(\.0)0*$", "$1$2")


def to_string(c: Compiler, a: Typed) -> Typed:
    if a.ty == Y.DECIMAL:
        return Typed(_plain(a.col), Y.STRING)
    if a.ty == Y.DATETIME and a.offset is not None:
        local = T.add(a.col, F.coalesce(a.offset, F.lit(0)), "minute")
        return Typed(F.concat(V.to_string(local, "DateTime"), F.when(a.offset.isNotNull(), T.timezone_text(a.offset)).otherwise("")), Y.STRING)
    if a.ty in (Y.QUANTITY, Y.DATETIME, Y.TIME):
        return Typed(V.to_string(a.col, a.ty.name), Y.STRING)
    if a.ty.name == "Choice":
        return Typed(F.coalesce(*[to_string(c, Typed(a.col[f"c{i}"], t)).col for i, t in enumerate(a.ty.inner)]), Y.STRING)
    if a.ty in Y.PARTIAL:
        whole = F.date_format(a.col["lo"], "yyyy-MM-dd'T'HH:mm:ss.SSS") if a.ty != Y.P_TIME else V.to_string(a.col["lo"], "Time")
        sizes = F.array(*[F.lit(n) for n in ((4, 7, 10, 13, 16, 19, 23) if a.ty != Y.P_TIME else (0, 0, 0, 2, 5, 8, 12))])
        return Typed(F.substring(whole, F.lit(1), F.element_at(sizes, a.col["prec"].cast("int"))), Y.STRING)
    if a.ty == Y.RATIO:
        return Typed(F.concat_ws(":", V.to_string(a.col["numerator"], "Quantity"), V.to_string(a.col["denominator"], "Quantity")), Y.STRING)
    return Typed(a.col.cast("string"), Y.STRING)


def to_temporal(ty: Ty):
    def run(c: Compiler, a: Typed) -> Typed:
        full = Y.PARTIAL.get(a.ty, a.ty)
        if full == ty:
            return a
        if ty == Y.DATE and full == Y.DATETIME:
            return date_from(c, a)
        if ty == Y.DATETIME and full == Y.DATE:
            return Typed(Y.convert(a.col, a.ty, Y.P_DATETIME), Y.P_DATETIME)
        if ty == Y.TIME and full == Y.DATETIME:
            return time_from(c, a)
        x = Y.convert(a.col, a.ty, Y.STRING)
        if ty == Y.DATE:
            return Typed(V.to_partial_date(x), Y.P_DATE)
        if ty == Y.TIME:
            return Typed(V.to_time(x), Y.TIME)
        return Typed(V.to_partial_date_time(x), Y.P_DATETIME, V.offset_minutes(x))

    return run


def to_quantity(c: Compiler, a: Typed) -> Typed:
    if a.ty == Y.QUANTITY:
        return a
    if a.ty in Y.NUMBERS:
        return Typed(F.when(a.col.isNotNull(), V.quantity(a.col, "1")), Y.QUANTITY)
    if a.ty == Y.RATIO:
        return divide(c, Typed(a.col["numerator"], Y.QUANTITY), Typed(a.col["denominator"], Y.QUANTITY))
    return Typed(V.to_quantity(Y.convert(a.col, a.ty, Y.STRING)), Y.QUANTITY)


OPERATIONS |= {
    "ToBoolean": to_boolean, "ToInteger": to_number(Y.INTEGER), "ToLong": to_number(Y.LONG), "ToDecimal": to_number(Y.DECIMAL), "ToString": to_string, "ToDate": to_temporal(Y.DATE), "ToDateTime": to_temporal(Y.DATETIME),
    "ToTime": to_temporal(Y.TIME), "ToQuantity": to_quantity, "ToRatio": lambda c, a: Typed(V.to_ratio(Y.convert(a.col, a.ty, Y.STRING)), Y.RATIO),
    "ToConcept": lambda c, a: Typed(Y.convert(a.col, a.ty, Y.CONCEPT), Y.CONCEPT), "ToList": lambda c, a: a if a.ty.name == "List" else Typed(V.to_list(a.col), Y.list_of(a.ty)),
}
for _n in ("Boolean", "Integer", "Long", "Decimal", "String", "Date", "DateTime", "Time", "Quantity"):
    OPERATIONS[f"ConvertsTo{_n}"] = lambda c, a, n=_n: Typed(F.when(a.col.isNotNull(), OPERATIONS[f"To{n}"](c, a).col.isNotNull()), Y.BOOLEAN)
OPERATIONS["ConvertsToRatio"] = lambda c, a: Typed(V.converts_to(Y.convert(a.col, a.ty, Y.STRING), "Ratio"), Y.BOOLEAN)


@operation("CalculateAge", "CalculateAgeAt", node=True)
def calculate_age(c: Compiler, birth: Typed, at: Typed | None = None, node: Node | None = None) -> Typed:
    moment = at or lit(c.now, Y.DATETIME)
    return Typed(K.age(birth.col, moment.col, node["precision"] or "year"), Y.INTEGER)


@operation("Descendents")
def descendents(c: Compiler, a: Typed) -> Typed:
    from pyspark.sql.types import _parse_datatype_string

    return Typed(R.descendants(_parse_datatype_string(Y.ddl(a.ty)), a.col), Y.list_of(Y.STRING))


#: Functions of the language that are operators, by lower-case name.
NAMES = {k.lower(): k for k in [*OPERATIONS, "IsNull", "Message", "Filter", "ForEach", "Repeat"]}
NAMES |= {f"agein{p}s{s}": "CalculateAge" for p in ("year", "month", "week", "day", "hour", "minute", "second") for s in ("", "at")}
NAMES |= {f"calculateagein{p}s{s}": "CalculateAge" for p in ("year", "month", "week", "day", "hour", "minute", "second") for s in ("", "at")}
NAMES |= {"descendants": "Descendents", "maximum": "Max", "minimum": "Min"}


# Operators on tables.


def _one(c: Compiler, rel: Relation, agg: Column, ty: Ty, empty) -> Relation:
    """One row, or in a context one per member that has rows; the engine adds the others with the value for none."""
    if rel.context and c.context != "Unfiltered":
        out = rel.df.groupBy(F.col(rel.context).alias("_context")).agg(agg.cast(Y.ddl(ty)).alias("value"))
        made = Relation(out, ty, "_context")
        made.empty = empty
        return made
    return Relation(rel.df.agg(agg.cast(Y.ddl(ty)).alias("value")), ty)


def table_aggregate(f, ty: Ty | None, empty=None):
    def run(c: Compiler, rel: Relation, node: Node, env: Env) -> Relation:
        x = F.col("value") if "value" in rel.df.columns else F.struct(*rel.df.columns)
        return _one(c, rel, f(x), ty or rel.ty, empty)

    return run


RELATIONAL |= {
    "Count": table_aggregate(F.count, Y.INTEGER, 0), "Sum": table_aggregate(F.sum, None), "Min": table_aggregate(F.min, None), "Max": table_aggregate(F.max, None), "Avg": table_aggregate(G.avg, Y.DECIMAL),
    "Median": table_aggregate(G.median, Y.DECIMAL), "Mode": table_aggregate(G.mode, None), "Variance": table_aggregate(G.variance, Y.DECIMAL), "StdDev": table_aggregate(G.std_dev, Y.DECIMAL),
    "PopulationVariance": table_aggregate(G.population_variance, Y.DECIMAL), "PopulationStdDev": table_aggregate(G.population_std_dev, Y.DECIMAL), "GeometricMean": table_aggregate(G.geometric_mean, Y.DECIMAL),
    "AllTrue": table_aggregate(G.all_true, Y.BOOLEAN, True), "AnyTrue": table_aggregate(G.any_true, Y.BOOLEAN, False),
    "Exists": table_aggregate(lambda x: F.count(F.lit(1)) > 0, Y.BOOLEAN, False), "Distinct": lambda c, rel, node, env: Relation(rel.df.dropDuplicates(), rel.ty, rel.context),
}


def table_set(f):
    def run(c: Compiler, rel: Relation, node: Node, env: Env) -> Relation:
        other = c.any(node.args[1], env)
        if not isinstance(other, Relation):
            raise CompileError("both sides must be tables")
        return Relation(f(rel.df, other.df), rel.ty, rel.context)

    return run


def table_property(c: Compiler, rel: Relation, node: Node, env: Env) -> Relation:
    path = node["path"]
    keep = [F.col(rel.context).alias("_context")] if rel.context else []
    return Relation(rel.df.select(F.col(f"`{path}`").alias("value"), *keep), rel.ty.inner[rel.ty.fields.index(path)], "_context" if keep else None)


RELATIONAL |= {"Union": table_set(R.union), "Intersect": table_set(R.intersect), "Except": table_set(R.except_), "Property": table_property}


def table_end(last: bool):
    """The first or last row in the order of the rows, in a context one for each member; without an order any row."""

    def run(c: Compiler, rel: Relation, node: Node, env: Env) -> Relation:
        keys = [(k.desc_nulls_last() if up else k.asc_nulls_first()) if last else (k.asc_nulls_first() if up else k.desc_nulls_last()) for k, up in rel.order]
        if rel.context and c.context != "Unfiltered":
            return Relation(R.best_per(rel.df, [rel.context], keys or [F.col(rel.context).asc()]), rel.ty, rel.context, rel.order)
        return Relation((rel.df.orderBy(*keys) if keys else rel.df).limit(1), rel.ty, rel.context, rel.order)

    return run


def table_product(c: Compiler, rel: Relation, node: Node, env: Env) -> Relation:
    """Of whole numbers exact, else to double precision."""
    if rel.ty not in (Y.INTEGER, Y.LONG):
        return table_aggregate(G.product, None)(c, rel, node, env)
    by = [rel.context] if rel.context and c.context != "Unfiltered" else []
    out = R.product(rel.df, by, "value", "_product", Y.ddl(rel.ty))
    made = Relation(out.select(*[F.col(k).alias("_context") for k in by], F.col("_product").alias("value")), rel.ty, "_context" if by else None)
    made.empty = None
    return made


RELATIONAL |= {"First": table_end(False), "Last": table_end(True), "Product": table_product}
