"""Operators through the text of the language: each query compiles a definition and runs it over a whole table.

Operands are columns of the table; many are null in a part of its rows, and bounds are open, half-open or null.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from asclepia.sources.catalog import test_tables
from asclepia.sources.terminology import Terminology

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The evaluation time of all these queries.
NOW = datetime(1997, 6, 1, 10, 30)

LIBRARY = """
library Rows version '1.0'
using FHIR version '4.0.1'
codesystem "Brands": 'Brand#2'
valueset "Large": 'large'
code "Urgent": '1-URGENT' from "Brands" display 'Urgent'
code "High": '2-HIGH' from "Brands"
concept "Soon": { "Urgent", "High" } display 'soon'
parameter "Least" Integer default 30
define function Twice(x Integer): x * 2
define function Twice(x String): x + x
define function Next(x Integer): Twice(x) + 1
define "Threshold": "Least" - 5
context {context}
define "Q": {body}
"""


def said(name: str, body: str, sql: str, context: str = "Unfiltered", large: str | None = None) -> None:
    """``large``: a condition on parts whose types are the codes of the value set "Large"."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from asclepia.plans.engine import Engine

        catalog = test_tables(spark, sf_dir)
        if large:
            parts = spark.read.parquet(f"{sf_dir}/part.parquet").filter(large)
            catalog.terminology = Terminology(parts.selectExpr("'large' AS valueset", "p_brand AS system", "p_type AS code", "p_type AS display"))
        return Engine(spark, catalog, NOW).compile(LIBRARY.replace("{context}", context).replace("{body}", body)).evaluate("Q")

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, sql


def parts(name: str, columns: dict[str, tuple[str, str]], lets: str = "", **more) -> None:
    """Over parts, with n: the size, null up to 25."""
    body = ", ".join(["p_partkey: M.p_partkey", *[f"{k}: {text}" for k, (text, _) in columns.items()]])
    sql = ", ".join(["p_partkey", *[f"{s} AS {k}" for k, (_, s) in columns.items()]])
    said(name, f"[Medication] M let n: case when M.p_size > 25 then M.p_size end{lets} return Tuple {{ {body} }}", f"SELECT {sql} FROM (SELECT *, CASE WHEN p_size > 25 THEN p_size END AS n FROM part)", **more)


# Literals, references, structures.

parts("lit_literals", {
    "i": ("M.p_size + 42", "p_size + 42"), "l": ("M.p_size + 4200000000L", "p_size + 4200000000"), "d": ("ToString(1.50 + M.p_size)", "(p_size + 1) || '.5'"), "s": ("M.p_brand + 'a\\'b\\u0041'", "p_brand || 'a''bA'"),
    "b": ("true or M.p_size > 3", "true"), "day": ("@2014-02-27 + 1 day", "DATE '2014-02-28'"), "t": ("hour from @T10:30", "10"), "q": ("ToString(5 'mg')", "'5 ''mg'''"), "none": ("(null as Integer) + M.p_size", "NULL::INT"),
})
parts("lit_property", {
    "a": ("x.a", "p_size"), "c": ("x.b.c", "p_brand"), "none": ("(if n is null then null as Tuple { z Integer } else Tuple { z: n }).z", "n"), "low": ("(Interval[M.p_size, M.p_size + 2]).low", "p_size"),
    "open": ("(Interval[M.p_size, M.p_size + 2)).highClosed", "false"), "unit": ("ToQuantity(ToString(M.p_size) + ' \\'mg\\'').unit", "'mg'"), "code": ("(Code { code: M.p_type, system: 's' }).code", "p_type"),
}, ", x: Tuple { a: M.p_size, b: Tuple { c: M.p_brand } }")
said(
    "tuple_instance", "[Patient] P return Tuple { c_custkey: P.c_custkey, same: Tuple { a: P.c_nationkey, b: P.c_mktsegment } = Tuple { a: 3, b: 'BUILDING' }, code: Code { code: P.c_mktsegment, system: 'x' } ~ Code { code: 'BUILDING', system: 'x', version: '2' }, "
    "other: Code { code: P.c_mktsegment, system: 'x' } = Code { code: 'BUILDING', system: 'y' }, codes: Count((Concept { codes: { Code { code: P.c_mktsegment }, Code { code: 'b' } } }).codes) }",
    "SELECT c_custkey, CASE WHEN c_nationkey <> 3 OR c_mktsegment <> 'BUILDING' THEN false ELSE true END AS same, c_mktsegment = 'BUILDING' AS code, false AS other, 2 AS codes FROM customer",
)
said(
    "ref_names", "[Medication] M return Tuple { p_partkey: M.p_partkey, expression: M.p_size > \"Threshold\", parameter: M.p_size > \"Least\", twice: Twice(M.p_size), word: Twice(M.p_brand), nested: Next(M.p_size), bound: First({ M.p_size, 3 }) }",
    "SELECT p_partkey, p_size > 25 AS expression, p_size > 30 AS parameter, p_size * 2 AS twice, p_brand || p_brand AS word, p_size * 2 + 1 AS nested, p_size AS bound FROM part",
)
said(
    "ref_terminology", "[Encounter] O return Tuple { o_orderkey: O.o_orderkey, soon: Code { code: O.o_orderpriority, system: 'Brand#2' } ~ \"Soon\", urgent: O.o_orderpriority = \"Urgent\".code, system: Code { code: O.o_orderpriority, system: O.o_orderstatus } in \"Brands\" }",
    "SELECT o_orderkey, o_orderpriority IN ('1-URGENT', '2-HIGH') AS soon, o_orderpriority = '1-URGENT' AS urgent, false AS system FROM orders",
)
parts("ref_value_set", {"member": ("M.p_type in \"Large\"", "p_type IN (SELECT p_type FROM part WHERE p_size > 49)"), "code": ("Code { code: M.p_type, system: M.p_brand } in \"Large\"", "(p_type, p_brand) IN (SELECT p_type, p_brand FROM part WHERE p_size > 49)")}, large="p_size > 49")
said("q_message", "[Medication] M return Tuple { p_partkey: M.p_partkey, r: Message(M.p_size, M.p_size > 90, 'big', 'Error', 'too big'), w: Message(M.p_size, true, 'x', 'Warning', 'goes on') }", "SELECT p_partkey, p_size AS r, p_size AS w FROM part")
parts("list_this_index_total", {
    "filtered": ("Count(Filter({ 1, 20, 30, null }, $this > M.p_size))", "((1 > p_size)::INT + (20 > p_size)::INT + (30 > p_size)::INT)"), "indexed": ("Sum(ForEach({ 5, 7 }, $this * M.p_size + $index))", "12 * p_size + 1"),
    "total": ("({ 1, 2, M.p_size }) X aggregate T starting 10: T * X", "20 * p_size"), "nulls": ("Count(ForEach({ 1, null, 3 }, n + $this))", "CASE WHEN n IS NULL THEN 0 ELSE 2 END"),
})

# Numbers, with nulls, negative and large values.

_D = "(p_size / 4.0 - 9)"
parts("num_of_nulls", {
    "ceiling": ("Ceiling(d)", f"CASE WHEN n IS NOT NULL THEN ceil({_D})::INT END"), "floor": ("Floor(d)", f"CASE WHEN n IS NOT NULL THEN floor({_D})::INT END"), "truncate": ("Truncate(d)", f"CASE WHEN n IS NOT NULL THEN trunc({_D})::INT END"),
    "rounded": ("ToInteger(Round(d))", f"CASE WHEN n IS NOT NULL THEN floor({_D} + 0.5)::INT END"), "abs": ("Abs(n)", "n"), "negate": ("-n", "-n"), "sum": ("n + M.p_size", "n + p_size"), "divide": ("10 div (n - 30)", "CASE WHEN n <> 30 THEN (trunc(10.0 / (n - 30)))::INT END"),
    "modulo": ("M.p_size mod (n - 30)", "CASE WHEN n <> 30 THEN p_size % (n - 30) END"), "next": ("successor of n", "n + 1"), "least": ("Min({ n, 30 })", "least(n, 30)"), "top": ("(maximum Quantity).unit", "'1'"),
}, ", d: n / 4.0 - 9.0")
parts("num_exact", {
    "power": ("3L ^ (ToLong(M.p_size) mod 40L)", "list_reduce(list_prepend(1::BIGINT, list_transform(range(p_size % 40), lambda x: 3::BIGINT)), lambda a, b: a * b)"), "negative": ("(-2L) ^ ToLong(M.p_size)", "((1 - 2 * (p_size % 2)) * (1::BIGINT << p_size))"), "unknown": ("2 ^ (n - 25)", "CASE WHEN n IS NOT NULL THEN (1::BIGINT << (n - 25))::INT END"),
    "places": ("ToString(Round(1234567890123.12345678 + M.p_size, 7))", "(1234567890123 + p_size) || '.1234568'"), "whole": ("ToString(Round(1234567890123.5 + M.p_size, 0))", "(1234567890124 + p_size) || '.0'"), "by_row": ("ToString(Round(0.12345678, M.p_size mod 3 + 1))", "CASE p_size % 3 WHEN 0 THEN '0.1' WHEN 1 THEN '0.12' ELSE '0.123' END"),
    "times": ("ToString(12345678901.00000001 * 3.0)", "'37037036703.00000003'"), "product": ("Product({ ToLong(M.p_size), 1000000007L, null, n })", "1000000007::BIGINT * p_size * coalesce(n, 1)"),
})

# Intervals with open, half-open and null bounds.

parts("ivl_null_bounds", {
    "contains": ("Interval[n, 60] contains 27", "n IS NULL OR n <= 27"), "member": ("27 in Interval(n, 60]", "n IS NULL OR n < 27"), "size": ("Size(Interval[1, n])", "n"), "open_size": ("Size(Interval(1, n))", "CASE WHEN n IS NOT NULL THEN greatest(n - 2, 0) END"), "width": ("width of Interval[1, n]", "n - 1"),
    "before": ("Interval[1, n) before Interval[30, 60]", "n <= 30"), "closed_before": ("Interval[1, n] before Interval[30, 60]", "n < 30"), "after": ("Interval[n, 60] after Interval[1, 30)", "n >= 30"), "overlaps": ("Interval[0, 30) overlaps Interval[n, 60]", "n < 30"),
    "includes": ("Interval[n, 60] includes Interval[30, 40]", "n IS NULL OR n <= 30"), "included": ("Interval[30, 40] included in Interval(n, 60]", "n IS NULL OR n < 30"), "starts": ("Interval[30, 40] starts Interval[n, 60]", "n = 30"), "ends": ("Interval[10, 50] ends Interval[0, n + 0]", "CASE WHEN n = 50 THEN true WHEN n <> 50 THEN false END"),
    "meets": ("Interval[1, 30) meets Interval[n, 60]", "n = 30"), "low": ("start of Interval(n, 60]", "n"), "none": ("(null as Interval<Integer>) contains 3", "false"),
})
parts("ivl_in", {"r": ("M.p_size in Interval[10, 20)", "p_size >= 10 AND p_size < 20"), "open": ("M.p_size in Interval(10, 20]", "p_size > 10 AND p_size <= 20"), "unknown": ("n in Interval[10, 30]", "n BETWEEN 10 AND 30"), "dates": ("(@2014-01-01 + 3 days) in Interval[@2014-01-01, @2014-01-01 + 5 days)", "true")})
parts("ivl_proper_included_in", {
    "r": ("Interval[10, M.p_size + 10] properly included in Interval[10, 40]", "p_size < 30"), "both": ("Interval[M.p_size, 60] properly included in Interval[10, 60]", "p_size > 10"), "open": ("Interval(10, 40) properly included in Interval[10, M.p_size + 39]", "true"), "unknown": ("Interval[n, 60] properly included in Interval[26, 60]", "CASE WHEN n IS NOT NULL THEN n > 26 END"),
})
parts("ivl_union_nulls", {
    "low": ("start of (Interval[n, 60] intersect Interval[30, 70])", "CASE WHEN n IS NOT NULL THEN greatest(n, 30) END"), "high": ("end of (Interval[1, 30] union Interval[n, 60])", "CASE WHEN n <= 31 THEN 60 END"), "cut": ("end of (Interval[1, 60] except Interval[n, 70])", "n - 1"),
    "collapsed": ("Count(collapse { Interval[1, n], Interval[5, 9], Interval[30, 60] })", "CASE WHEN p_size <= 25 OR p_size >= 29 THEN 1 ELSE 2 END"), "per": ("Count(collapse { Interval[1, M.p_size], Interval[60, 70] } per 10 '1')", "CASE WHEN p_size >= 50 THEN 1 ELSE 2 END"),
    "decimals": ("Count(collapse { Interval[1.0, 2.0], Interval[2.00000001, 3.0], Interval[M.p_size + 0.0, 60.0] })", "CASE WHEN p_size <= 3 THEN 1 ELSE 2 END"),
})
_DAY = "(DATE '2014-01-01' + p_size)"
parts("ivl_expand_units", {
    "days": ("Count(expand Interval[@2014-01-01, d])", "p_size + 1"), "weeks": ("Count(expand Interval[@2014-01-01, d] per week)", "(p_size + 1) // 7"), "months": ("Count(expand Interval[@2014-01-31, d + 3 months] per month)", f"date_diff('month', DATE '2014-01-01', {_DAY} + INTERVAL 3 MONTH + INTERVAL 1 DAY)::INT - 1 + CASE WHEN extract(day FROM ({_DAY} + INTERVAL 3 MONTH + INTERVAL 1 DAY)) >= 31 THEN 1 ELSE 0 END"),
    "last": ("Last(expand Interval[@2014-01-01, d] per week)", "CASE WHEN p_size >= 6 THEN DATE '2014-01-01' + 7 * ((p_size + 1) // 7 - 1) END"), "decimals": ("Count(expand Interval[1.0, M.p_size + 1.5] per 0.5 '1')", "2 * p_size + 1"), "hours": ("Count(expand Interval[@T00:00:00.000, @T11:59:59.999] per 2 hours)", "6"),
    "stamps": ("Count(expand Interval[DateTime(2014, 1, 1, 0, 0, 0, 0), DateTime(2014, 1, 3, 11, 0, 0, 0)] per 12 hours)", "4"), "unknown": ("Count(expand Interval[1, n])", "coalesce(n, 0)"), "steps": ("Count(expand { Interval[1, M.p_size], Interval[100, 109] } per 5 '1')", "p_size // 5 + 2"),
}, ", d: @2014-01-01 + (ToQuantity(ToString(M.p_size) + ' days'))")

# Dates and times of which not all is known, and their zones.

parts("dt_partial_arithmetic", {
    "year": ("year from (Date(1990 + M.p_size) + 18 months)", "1991 + p_size"), "month": ("month from (Date(1990 + M.p_size, 5) + 9 months)", "2"), "carried": ("year from (Date(1990 + M.p_size, 5) + 9 months)", "1991 + p_size"), "days": ("month from (Date(2000, 1) + ToQuantity(ToString(M.p_size) + ' days'))", "1 + p_size // 30"),
    "back": ("year from (Date(2050) - ToQuantity(ToString(M.p_size) + ' years'))", "2050 - p_size"), "hours": ("day from (DateTime(2000, 1, 1) + ToQuantity(ToString(M.p_size) + ' hours'))", "1 + p_size // 24"), "null_amount": ("DateTime(2000, 1, 1, 0, 0, 0, 0) + (null as Quantity)", "NULL::TIMESTAMP"), "next": ("year from (successor of Date(1990 + M.p_size))", "1991 + p_size"),
    "month_before": ("month from (predecessor of Date(1990, 1))", "12"),
})
parts("dt_uncertain_durations", {
    "more": ("(days between DateTime(2015, 2, 10) and DateTime(2015, 3)) > M.p_size", "CASE WHEN p_size < 18 THEN true WHEN p_size >= 49 THEN false END"), "same": ("(months between Date(2014) and Date(2014, 12, 31)) = M.p_size", "CASE WHEN p_size > 11 THEN false END"),
    "sum": ("((days between DateTime(2015, 2, 10) and DateTime(2015, 3)) + M.p_size) >= 50", "CASE WHEN p_size >= 32 THEN true WHEN p_size = 0 THEN false END"), "sure": ("years between Date(1990) and Date(1990 + M.p_size)", "p_size"), "unknown": ("months between Date(2014, 1, 1) and Date(2014, 1, 1) + ToQuantity(ToString(n) + ' months')", "n"),
})
parts("dt_timezone_from", {"r": ("timezone from DateTime(2000, 1, 1, 8, 25, 25, 300, M.p_size / 4 - 5)", "CASE WHEN p_size * 15 < 300 THEN '-' ELSE '+' END || lpad((abs(p_size * 15 - 300) // 60)::VARCHAR, 2, '0') || ':' || lpad((abs(p_size * 15 - 300) % 60)::VARCHAR, 2, '0')"), "utc": ("timezone from @2014-01-01T00:00:00.000Z", "'+00:00'")})
parts("dt_timezone_offset_from", {
    "r": ("Truncate((timezoneoffset from DateTime(2000, 1, 1, 8, 25, 25, 300, M.p_size / 4 - 5)) * 60)", "p_size * 15 - 300"), "literal": ("Truncate((timezoneoffset from @2014-01-01T12:05:05.955-01:15) * 60)", "-75"), "hour": ("hour from DateTime(2000, 1, 1, 8, 0, 0, 0, -(M.p_size mod 5))", "8 + p_size % 5"),
    "text": ("ToString(DateTime(2000, 1, 1, 8, 25, 25, 300, -(M.p_size mod 5)))", "'2000-01-01T08:25:25.300' || CASE WHEN p_size % 5 = 0 THEN '+' ELSE '-' END || '0' || p_size % 5 || ':00'"), "parsed": ("Truncate((timezoneoffset from ToDateTime('2014-01-01T12:05:05.955+01:30')) * 60)", "90"),
})
said(
    "dt_now_today_timeofday", "[Encounter] O return Tuple { o_orderkey: O.o_orderkey, later: O.o_orderdate > Now(), days: difference in days between O.o_orderdate and Today(), years: years between O.o_orderdate and Now(), hour: hour from TimeOfDay(), minute: minute from Now() }",
    "SELECT o_orderkey, o_orderdate > TIMESTAMP '1997-06-01 10:30:00' AS later, date_diff('day', o_orderdate::DATE, DATE '1997-06-01')::INT AS days, "
    "CASE WHEN o_orderdate <= TIMESTAMP '1997-06-01 10:30:00' THEN datesub('year', o_orderdate, TIMESTAMP '1997-06-01 10:30:00') ELSE -datesub('year', TIMESTAMP '1997-06-01 10:30:00', o_orderdate) END::INT AS years, 10 AS hour, 30 AS minute FROM orders",
)

# Lists and codes with operands of the row.

parts("list_exists", {"r": ("exists ({ n })", "n IS NOT NULL"), "empty": ("exists (({ M.p_size }) X where X > 40)", "p_size > 40"), "null_list": ("exists (null as List<Integer>)", "false")})
parts("list_times", {"n": ("Count(Times({ M.p_size, 1 }, { 'a', 'b', 'c' }))", "6"), "sum": ("Sum((Times({ M.p_size, 1 }, { 2, 3 })) P return all P.X * P.Y)", "5 * p_size + 5")})
parts("list_flatten", {"n": ("Count(flatten { { M.p_size, 2 }, { 3 }, { n } })", "3 + (n IS NOT NULL)::INT"), "first": ("First(flatten { { M.p_size, 2 }, { 3 } })", "p_size"), "sum": ("Sum(flatten { { M.p_size, 2 }, { n } })", "p_size + 2 + coalesce(n, 0)")})
parts("list_count", {"r": ("Count({ M.p_size, n, null })", "1 + (n IS NOT NULL)::INT"), "some": ("Count(({ 10, 20, 30, 40 }) X where X < M.p_size)", "(10 < p_size)::INT + (20 < p_size)::INT + (30 < p_size)::INT + (40 < p_size)::INT")})
parts("clin_code_equal", {"r": ("Code { code: M.p_brand, system: 's' } = Code { code: 'Brand#1', system: 's' }", "p_brand = 'Brand#1'"), "like": ("Code { code: M.p_brand, system: 's', version: '1' } ~ Code { code: 'Brand#1', system: 's', version: '2' }", "p_brand = 'Brand#1'")})
parts("conv_converts_to_string", {"r": ("ConvertsToString(M.p_size)", "true"), "unknown": ("ConvertsToString(n)", "CASE WHEN n IS NOT NULL THEN true END"), "date": ("ConvertsToString(@2014-01-01)", "true")})
parts("cond_choice", {
    "r": ("ToString(if M.p_size > 25 then M.p_size else M.p_brand)", "CASE WHEN p_size > 25 THEN p_size::VARCHAR ELSE p_brand END"), "is_number": ("(if M.p_size > 25 then M.p_size else M.p_brand) is Integer", "p_size > 25"), "number": ("(if M.p_size > 25 then M.p_size else M.p_brand) as Integer", "n"), "mixed": ("Count({ M.p_size, 'hi', n })", "2 + (n IS NOT NULL)::INT"),
})
parts("num_quantity_units", {
    "m": ("ToString(ToQuantity(ToString(M.p_size) + ' \\'m\\'') + 1 'cm')", "p_size || '.01 ''m'''"), "less": ("ToQuantity(ToString(M.p_size) + ' \\'cm\\'') < 0.25 'm'", "p_size < 25"), "minus": ("ToString(1 'm' - ToQuantity(ToString(n) + ' \\'cm\\''))", "CASE WHEN n % 10 = 0 THEN '0.' || (100 - n) // 10 || ' ''m''' WHEN n IS NOT NULL THEN '0.' || lpad((100 - n)::VARCHAR, 2, '0') || ' ''m''' END"),
})

# First and last rows of tables.

_ORDERS = "[Encounter] E return Tuple { o_custkey: E.o_custkey, o_orderkey: E.o_orderkey, day: date from E.o_orderdate } sort by day, o_orderkey"
for _word, _up in (("First", ""), ("Last", " DESC")):
    said(f"q_{_word.lower()}", f"{_word}({_ORDERS})", f"SELECT o_custkey, o_orderkey, o_orderdate::DATE AS day FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE{_up}, o_orderkey{_up}) = 1", "Patient")
