"""Static types of expressions, their Spark types, and implicit conversions with costs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Ty:
    name: str
    inner: tuple[Ty, ...] = ()
    fields: tuple[str, ...] = ()

    def __str__(self) -> str:
        return f"{self.name}<{', '.join(map(str, self.inner))}>" if self.inner else self.name


ANY, BOOLEAN, INTEGER, LONG, DECIMAL, STRING = (Ty(n) for n in ("Any", "Boolean", "Integer", "Long", "Decimal", "String"))
DATE, DATETIME, TIME, QUANTITY, RATIO, CODE, CONCEPT = (Ty(n) for n in ("Date", "DateTime", "Time", "Quantity", "Ratio", "Code", "Concept"))
#: Of these not all components are known: struct<lo, hi, prec>.
P_DATE, P_DATETIME, P_TIME = (Ty(n) for n in ("PartialDate", "PartialDateTime", "PartialTime"))
PARTIAL = {P_DATE: DATE, P_DATETIME: DATETIME, P_TIME: TIME}
NUMBERS = (INTEGER, LONG, DECIMAL)
#: A whole number of which only the range is known.
UNCERTAIN = Ty("Uncertain", (INTEGER,))

_SPARK = {
    "Any": "string", "Boolean": "boolean", "Integer": "int", "Long": "bigint", "Decimal": "decimal(28,8)", "String": "string", "Date": "date", "DateTime": "timestamp_ntz", "Time": "int",
    "Quantity": "struct<value:decimal(28,8),unit:string>", "Code": "struct<code:string,system:string,version:string,display:string>",
    "Concept": "struct<codes:array<struct<code:string,system:string,version:string,display:string>>,display:string>",
    "PartialDate": "struct<lo:date,hi:date,prec:tinyint>", "PartialDateTime": "struct<lo:timestamp_ntz,hi:timestamp_ntz,prec:tinyint>", "PartialTime": "struct<lo:int,hi:int,prec:tinyint>",
    "Ratio": "struct<numerator:struct<value:decimal(28,8),unit:string>,denominator:struct<value:decimal(28,8),unit:string>>",
}


def list_of(t: Ty) -> Ty:
    return Ty("List", (t,))


def interval_of(t: Ty) -> Ty:
    return Ty("Interval", (t,))


def tuple_of(fields: dict[str, Ty]) -> Ty:
    return Ty("Tuple", tuple(fields.values()), tuple(fields))


def choice_of(types) -> Ty:
    """One of several types; choices inside are taken apart, and a choice of one is that one."""
    flat: list[Ty] = []
    for t in types:
        flat += [x for x in (t.inner if t.name == "Choice" else (t,)) if x not in flat and x != ANY]
    return flat[0] if len(flat) == 1 else Ty("Choice", tuple(flat)) if flat else ANY


def joint(types: list[Ty]) -> Ty:
    """The type that all convert to, or else a choice of them."""
    out = ANY
    for t in types:
        if out is not None:
            out = common(out, t)
    return choice_of(types) if out is None else out


def chosen(col: Column, choice: Ty, ty: Ty) -> Column:
    """What a choice holds, if it is of type ``ty`` or a number that converts to it; else null."""
    fits = [convert(col[f"c{i}"], t, ty) for i, t in enumerate(choice.inner) if cost(t, ty) is not None]
    return F.coalesce(*fits) if fits else F.lit(None).cast(ddl(ty))


def ddl(t: Ty) -> str:
    if t.name == "Choice":
        return f"struct<{','.join(f'c{i}:{ddl(x)}' for i, x in enumerate(t.inner))}>"
    if t == UNCERTAIN:
        return ddl(interval_of(INTEGER))
    if t.name == "List":
        return f"array<{ddl(t.inner[0])}>"
    if t.name == "Interval":
        p = ddl(t.inner[0])
        return f"struct<low:{p},high:{p},lowClosed:boolean,highClosed:boolean>"
    if t.name == "Tuple":
        return f"struct<{','.join(f'`{n}`:{ddl(x)}' for n, x in zip(t.fields, t.inner, strict=True))}>"
    return _SPARK.get(t.name, "string")


def of_spark(kind: T.DataType) -> Ty:
    """The static type of a table's column."""
    for spark, ty in ((T.BooleanType, BOOLEAN), (T.LongType, LONG), (T.IntegerType, INTEGER), (T.ShortType, INTEGER), (T.ByteType, INTEGER), (T.DateType, DATE), (T.TimestampNTZType, DATETIME), (T.TimestampType, DATETIME), (T.StringType, STRING)):
        if isinstance(kind, spark):
            return ty
    if isinstance(kind, (T.DecimalType, T.DoubleType, T.FloatType)):
        return DECIMAL
    if isinstance(kind, T.ArrayType):
        return list_of(of_spark(kind.elementType))
    if isinstance(kind, T.StructType):
        names = set(kind.names)
        if names == {"value", "unit"}:
            return QUANTITY
        if {"code", "system"} <= names:
            return CODE
        if names == {"low", "high", "lowClosed", "highClosed"}:
            return interval_of(of_spark(kind["low"].dataType))
        return tuple_of({f.name: of_spark(f.dataType) for f in kind.fields})
    return ANY


#: Implicit conversions and their costs; the cheapest overload wins.
COSTS = {("Integer", "Long"): 1, ("Integer", "Decimal"): 2, ("Long", "Decimal"): 1, ("Date", "DateTime"): 5, ("Code", "Concept"): 10, ("Any", ""): 100}


def cost(a: Ty, b: Ty) -> int | None:
    """What it costs to give an ``a`` where a ``b`` is asked for; None if it can't be."""
    if a == b or b == ANY:
        return 0
    if a == ANY:
        return 100
    if b.name == "Choice":
        mine = a.inner if a.name == "Choice" else (a,)
        return 3 if all(x in b.inner for x in mine) else None
    if a.name == "Choice":
        return None
    if b == UNCERTAIN:
        return 4 if a == INTEGER else None
    if a.name == b.name and a.inner and len(a.inner) == len(b.inner):
        parts = [cost(x, y) for x, y in zip(a.inner, b.inner, strict=True)]
        return None if None in parts else sum(parts)
    return COSTS.get((a.name, b.name))


def common(a: Ty, b: Ty) -> Ty | None:
    """The type that both convert to."""
    if a == b or b == ANY:
        return a
    if a == ANY:
        return b
    if a in PARTIAL or b in PARTIAL:
        base = common(PARTIAL.get(a, a), PARTIAL.get(b, b))
        return next((p for p, full in PARTIAL.items() if full == base), None)
    if cost(a, b) is not None:
        return b
    if cost(b, a) is not None:
        return a
    if a.name == b.name and a.inner and len(a.inner) == len(b.inner) and a.fields == b.fields:
        parts = [common(x, y) for x, y in zip(a.inner, b.inner, strict=True)]
        return None if None in parts else Ty(a.name, tuple(parts), a.fields)
    return None


def convert(col: Column, a: Ty, b: Ty) -> Column:
    """A column of type ``a`` as a ``b`` that it converts to implicitly."""
    if a == b:
        return col
    if b.name == "Choice" and a != ANY:
        mine = {t: col[f"c{i}"] for i, t in enumerate(a.inner)} if a.name == "Choice" else {a: col}
        return F.when(col.isNotNull(), F.struct(*[(mine[t] if t in mine else F.lit(None).cast(ddl(t))).alias(f"c{i}") for i, t in enumerate(b.inner)]))
    if b == UNCERTAIN and a == INTEGER:
        return F.when(col.isNotNull(), F.struct(col.alias("low"), col.alias("high"), F.lit(True).alias("lowClosed"), F.lit(True).alias("highClosed")))
    if b in PARTIAL and a in PARTIAL and a != b:  # a date among date-times: from its first to its last moment
        last = col["hi"].cast("timestamp_ntz") + F.expr("interval '0 23:59:59.999' day to second")
        return F.when(col.isNotNull(), F.struct(col["lo"].cast("timestamp_ntz").alias("lo"), last.alias("hi"), col["prec"].alias("prec")))
    if b in PARTIAL and a == DATE and b == P_DATETIME:
        return convert(convert(col, DATE, P_DATE), P_DATE, P_DATETIME)
    if b in PARTIAL and a != ANY:
        prec = 3 if a == DATE else 7
        return F.when(col.isNotNull(), F.struct(col.alias("lo"), col.alias("hi"), F.lit(prec).cast("tinyint").alias("prec")))
    if a == ANY:
        return F.lit(None).cast(ddl(b))
    if a == CODE and b == CONCEPT:
        return F.when(col.isNotNull(), F.struct(F.array(col).alias("codes"), col["display"].alias("display"))).cast(ddl(b))
    if a.name == "List" and a.inner[0] != b.inner[0]:
        return F.transform(col, lambda x: convert(x, a.inner[0], b.inner[0]))
    if a.name == "Interval" and a.inner[0] != b.inner[0]:
        bound = lambda n: convert(col[n], a.inner[0], b.inner[0]).alias(n)
        return F.when(col.isNotNull(), F.struct(bound("low"), bound("high"), col["lowClosed"].alias("lowClosed"), col["highClosed"].alias("highClosed")))
    if a.name == "Tuple" and b.name == "Tuple":
        return F.when(col.isNotNull(), F.struct(*[convert(col.getField(n), x, y).alias(n) for n, x, y in zip(a.fields, a.inner, b.inner, strict=True)]))
    return col.cast(ddl(b))
