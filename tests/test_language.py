"""Expressions in text and what they evaluate to."""

from datetime import datetime

import pytest

from asclepia.plans import elm
from asclepia import __main__ as command
from asclepia.plans import compiler, errors
from asclepia.plans.compiler import CompileError
from asclepia.plans.engine import Engine
from asclepia.plans.lang import SyntaxProblem, parse_expression, parse_library
from asclepia.sources.catalog import Catalog
from asclepia.sources.terminology import Terminology

CASES = """
1 + 2 | 3
2 + 3 * 4 ^ 2 | 50
7 div 2 | 3
-7 mod 3 | -1
5 / 0 | null
1 / 4 | 0.25
Round(-0.5) | 0.0
Round(-1.5) | -1.0
Round(3.14159, 3) | 3.142
2 ^ -2 | 0.25
1L + 2 | 3L
1 + null | null
Ceiling(1.1) | 2
Truncate(-1.9) | -1
Ln(-1.0) | null
successor of 1.0 | 1.00000001
predecessor of @2000-03-01 | @2000-02-29
maximum Integer | 2147483647
Precision(1.587) | 3
HighBoundary(1.58) | 1.58999999
'a' + 'b' | 'ab'
'a' & null | null
Substring('abcdef', 2, 2) | 'cd'
Substring('abc', 3) | null
PositionOf('c', 'abc') | 2
Split('a,b,', ',') | {'a', 'b', ''}
Combine({'a', null, 'b'}, '-') | 'a-b'
'abc'[1] | 'b'
Matches('wander', 'and') | true
ReplaceMatches('abc', 'b', '$') | error
true and null | null
false and null | false
null or true | true
true xor null | null
null implies true | true
not null | null
null is null | true
1 is not null | true
Coalesce(null, 2) | 2
if null then 1 else 2 | 2
case 3 when 1 then 'a' when 3 then 'b' end | 'b'
{1, null} = {1, null} | true
{1, 2} = {1, null} | null
{1, 2} = {2, null} | false
{1, 2} ~ {1, 2} | true
'A' ~ 'a' | true
null ~ null | true
1 'cm' = 0.01 'm' | true
1 'kg' > 999 'g' | true
Tuple { a: 1, b: null } = Tuple { a: 2, b: null } | false
@2014-01-01 < @2014-02 | true
@2014-01 < @2014-01-15 | null
@2014 = @2015 | false
DateTime(2014, 1, 1) = DateTime(2014, 1, 1) | true
@2014-01-31 + 1 month | @2014-02-28
@2020-02-29 + 1 year | @2021-02-28
@T23:30:00.000 + 1 hour | @T00:30:00.000
months between @2014-01-31 and @2014-02-28 | 0
years between @2000-06-01 and @1999-03-01 | -1
difference in months between @2014-01-31 and @2014-02-01 | 1
difference in years between @2013-12-31 and @2014-01-01 | 1
year from @2014-05-06 | 2014
hour from @2014-05-06T12:00:00.000 | 12
date from @2014-05-06T12:00:00.000 | @2014-05-06
@2014-01-15 same month as @2014-01-01 | true
@2014-01-15 before month of @2014-02-01 | true
@2014-01-15 on or before @2014-01-15 | true
Interval[1, 5] contains 5 | true
5 in Interval[1, 5) | false
start of Interval(1, 5] | 1
width of Interval[1, 5] | 4
Interval[1, 4] overlaps Interval[4, 8] | true
Interval[1, 3] meets before Interval[4, 8] | true
Interval[1, 3] before Interval[4, 8] | true
Interval[4, 5] during Interval[4, 8] | true
Interval[4, 8] properly includes Interval[4, 8] | false
Interval[1, 3] starts Interval[1, 8] | true
Interval[1, 5] union Interval[4, 9] | Interval[1, 9]
Interval[1, 5] intersect Interval[4, 9] | Interval[4, 5]
Interval[1, 9] except Interval[5, 9] | Interval[1, 4]
collapse {Interval[1, 3], Interval[4, 6], Interval[8, 9]} | {Interval[1, 6], Interval[8, 9]}
expand Interval[1, 6] per 2 | error
expand Interval[1, 4] | {1, 2, 3, 4}
Interval[5, 1] | error
{1, 2, 2} union {2, 3} | {1, 2, 2, 3}
{1, 2, 2, 3} except {3} | {1, 2, 2}
{1, 2, 2} intersect {2} | {2}
distinct {1, 2, 1, null, null} | {1, 2, null}
flatten {{1}, {2, 3}} | {1, 2, 3}
exists {null} | false
First({5, 6}) | 5
Last({5, 6}) | 6
Tail({1, 2, 3}) | {2, 3}
Take({1, 2, 3}, 2) | {1, 2}
Skip({1, 2, 3}, 2) | {3}
IndexOf({'a', 'b'}, 'b') | 1
singleton from {7} | 7
singleton from {7, 8} | error
{1, 2, 3} contains 2 | true
null in {1, null} | true
{1, 2} included in {1, 2, 3} | true
Count({1, null, 3}) | 2
Sum({1, null, 3}) | 4
Avg({1.0, 2.0}) | 1.5
Median({1, 2, 3, 4}) | 2.5
Mode({1, 2, 2}) | 2
Product({2, 3}) | 6
Variance({1.0, 2.0, 3.0, 4.0}) | 1.66666667
AllTrue({true, null}) | true
AllTrue({}) | true
AnyTrue({}) | false
(4) l | 4
({1, 2, 3}) l where l > 1 return l * 10 | {20, 30}
({1, 2, 3}) l sort desc | {3, 2, 1}
({1, 2, 3, 3, 4}) L aggregate A starting 1: A * L | 72
({1, 2, 3, 3, 4}) L aggregate distinct A starting 1: A * L | 24
from ({1, 2}) A, ({3, 4}) B return A * B | {3, 4, 6, 8}
({1, 2, 3, 4}) X with ({2, 4}) Y such that X = Y | {2, 4}
({1, 2, 3, 4}) X without ({2, 4}) Y such that X = Y | {1, 3}
({1, 2}) X let d: X * 2 return d + 1 | {3, 5}
({Tuple { v: 3 }, Tuple { v: 1 }}) X sort by v | {{ v: 1 }, { v: 3 }}
ToInteger('12') | 12
ToInteger('1.5') | null
ToBoolean('yes') | true
ToDecimal('1.50') | 1.5
ToQuantity('10 \\'mg\\'') | 10.0 'mg'
ToString(1.50) | '1.5'
ToDate('2014-01-01') = @2014-01-01 | true
ConvertsToInteger('x') | false
convert '5' to Integer | 5
'5' is Integer | false
Code { code: '1', system: 's' } ~ Code { code: '1', system: 's', version: '2' } | true
CalculateAgeInYearsAt(@2000-05-06, @2014-05-05) | 13
Message(5, true, 'c', 'Trace', 'm') | 5
99999999999 | error
"missing" | error
"""

#: Nulls, parts of dates, zones, steps, choices, and values that need all their digits.
MORE = """
Ceiling(null as Decimal) | null
Floor(null as Decimal) | null
3L ^ 35L | 50031545098999707L
(-1) ^ 1000000001 | -1
0L ^ 0L | 1L
2L ^ 63L | error
Round(1234567890123.12345678, 8) | 1234567890123.12345678
Round(-2.5, 0) | -2.0
Round(1250.0, -2) | 1300.0
12345678901.00000001 * 3.0 | 37037036703.00000003
Product({3L, null, 1000000007L, 1000000007L}) | 3000000042000000147L
Product({0.5, 0.5}) | 0.25
Size(Interval[1, null]) | null
Size(null as Interval<Integer>) | null
collapse {Interval[1, null], Interval[5, 9]} | {Interval[1, null]}
collapse {Interval[null, 3], Interval[2, 9], Interval[20, 30]} | {Interval[null, 9], Interval[20, 30]}
collapse {Interval[1, 3], Interval[6, 9]} per 3 '1' | {Interval[1, 9]}
collapse {Interval[@2014-01-01, @2014-01-31], Interval[@2014-02-10, @2014-02-20]} per 2 weeks | {Interval[@2014-01-01, @2014-02-20]}
expand Interval[@2014-01-31, @2014-05-15] per month | {@2014-01-31, @2014-02-28, @2014-03-31}
expand Interval[@2012-02-29, @2016-02-28] per 2 years | {@2012-02-29, @2014-02-28}
expand Interval[1.0, 2.0] per 0.5 '1' | {1.0, 1.5}
expand Interval[@T10, @T12] per hour | error
expand Interval[@T10:00:00.000, @T11:59:59.999] per hour | {@T10:00:00.000, @T11:00:00.000}
expand {Interval[@2014-01-01, @2014-01-04]} per 2 days | {Interval[@2014-01-01, @2014-01-02], Interval[@2014-01-03, @2014-01-04]}
@2014 + 1 year | @2015
@2014-11 + 3 months | @2015-02
@2014-01 - 45 days | @2013-12
@2014-01-31T10 + 90 minutes | @2014-01-31T11
@2014 + null | null
@2014-01-01T00:00:00.000 + (null as Quantity) | null
@2014 + 1 'mg' | error
successor of @2014-12 | @2015-01
predecessor of @T10:00 | @T09:59
successor of @9999 | error
predecessor of @0001-01-01 | error
maximum Quantity | 99999999999999999999.99999999 '1'
days between DateTime(2015, 2, 10) and DateTime(2015, 3) | Interval[18, 49]
(months between @2014 and @2014-05) > 12 | false
(months between @2014 and @2014-05) >= -7 | true
(months between @2014 and @2014-05) = 2 | null
years between @2014 and @2016 | 2
timezoneoffset from @2014-01-01T12:05:05.955+01:30 | 1.5
hour from @2014-01-01T12:05:05.955+01:30 | 10
ToDateTime('2014-01-01T12:05:05.955-01:15') | @2014-01-01T12:05:05.955-01:15
ToDateTime('2014-01-01T12:05') | @2014-01-01T12:05
ToDateTime('2014-01-01T25') | null
ToString(DateTime(2000, 1, 1, 8, 25, 25, 300, -7)) | '2000-01-01T08:25:25.300-07:00'
DateTime(2000, 1, 1, 8, 25, 25, 300, 14.5) | error
DateTime(2000, 1, 1, 8, 25, 25, -1) | error
@T23:59:59.10000 | error
@2014-01-01T00:00:00.000 before week of @2014-02-01T00:00:00.000 | error
ToString(125 'cm') | '125 \\'cm\\''
1 'm' + 1 'cm' | 1.01 'm'
1 'm' + 1 'g' | error
{1, 'hi', null} | {1, 'hi', null}
if 1 = 2 then 2 else 'other' | 'other'
({1, 'hi'})[1] as String | 'hi'
({1, 'hi'})[1] as Integer | null
({1, 'hi'})[0] is Integer | true
Coalesce(null as Integer, 'x') | 'x'
Interval[1, 5] properly contains 3 | true
3 properly in Interval[1, 5] | true
Message(3, true, 'c', 'Error', 'no') | error
Message(3, false, 'c', 'Error', 'no') | 3
Message(3, true, 'c', 'Warning', 'no') | 3
"""


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, now=datetime(2024, 6, 1, 10, 30))


def test_cases(engine):
    wrong = []
    for line in filter(None, CASES.splitlines()):
        text, _, want = line.rpartition(" | ")
        try:
            got = engine.text(text.replace("\\\\", "\\"))
        except Exception:  # noqa: BLE001  any error is what the case asks for, or a difference
            got = "error"
        if got != want:
            wrong.append((text, want, got))
    assert not wrong


def test_more_cases(engine):
    wrong = []
    for line in filter(None, MORE.splitlines()):
        text, _, want = line.rpartition(" | ")
        try:
            got = engine.text(text)
        except errors.QueryError:  # never another error
            got = "error"
        if got != want.replace("\\\\", "\\"):
            wrong.append((text, want, got))
    assert not wrong


@pytest.mark.parametrize("text,code", [
    ("1 +", "CQL0002"), ("1 ? 2", "CQL0001"), ("missing", "CQL0101"), ("Missing(1)", "CQL0102"), ("1 + 'a'", "CQL0103"), ("99999999999", "CQL0100"), ("@2014-01-01T00:00:00.0000", "CQL0105"), ("2147483647 + 1", "CQL0201"),
    ("Date(2014, 5, 32)", "CQL0204"), ("Time(25)", "CQL0204"), ("1 'm' = 1 'g'", "CQL0205"), ("Interval[5, 1]", "CQL0206"), ("Message(1, true, 'c', 'Error', 'no')", "CQL0207"), ("[Patient]", "CQL0303"), ("(Tuple { a: 1 }).b", "CQL0302"),
])
def test_error_codes(engine, text, code):
    with pytest.raises(errors.QueryError) as e:
        engine.text(text)
    assert e.value.code == code and str(e.value).startswith(code)


def test_now(engine):
    assert engine.text("Now()") == "@2024-06-01T10:30:00.000"
    assert engine.text("Today()") == "@2024-06-01"


@pytest.mark.parametrize("text", ["1 +", "define X:", "if 1 then 2", "{1, 2", "Interval[1, 2", "'open"])
def test_syntax(text):
    with pytest.raises(SyntaxProblem):
        parse_expression(text)


def test_library(spark):
    people = spark.createDataFrame([(1, "ann"), (2, "bo"), (3, None)], "id long, name string")
    visits = spark.createDataFrame([(10, 1, "a", 5), (11, 1, "b", 7), (12, 2, "a", None)], "visit long, id long, kind string, n int")
    expansion = spark.createDataFrame([("vs", "sys", "a", "A")], "valueset string, system string, code string, display string")
    catalog = Catalog(spark, terminology=Terminology(expansion))
    catalog.add("Patient", people, context="id").add("Visit", visits, context="id", code_path="kind")
    text = """
    library L version '1'
    include Other called O
    valueset "VS": 'vs'
    parameter P Integer default 6
    define function Twice(x Integer): x * 2
    define function Twice(x Decimal): x + 0.5
    define Big: [Visit] V where V.n > P return Tuple { visit: V.visit, t: Twice(V.n) }
    define InVS: [Visit: "VS"] V return V.visit
    define Both: ([Visit] V return V.kind) union ([Visit] W return W.kind)
    define Sum: Sum([Visit] V return V.n)
    context Patient
    define N: Count([Visit])
    """
    lib = parse_library(text)
    lib.includes = {}
    compiled = Engine(spark, catalog).compile(lib)
    assert [tuple(r) for r in compiled.evaluate("Big").collect()] == [(11, 14)]
    assert sorted(r[0] for r in compiled.evaluate("InVS").collect()) == [10, 12]
    assert sorted(r[0] for r in compiled.evaluate("Both").collect()) == ["a", "a", "b"]
    assert compiled.evaluate("Sum").first()[0] == 12
    assert sorted(tuple(r) for r in compiled.evaluate("N").collect()) == [(1, 2), (2, 1), (3, 0)]
    assert Engine(spark, catalog).compile(lib, {"P": 4}).evaluate("Big").count() == 2


def test_cycles(spark):
    with pytest.raises(CompileError):
        Engine(spark).compile("define A: B\ndefine B: A").evaluate("A")
    with pytest.raises(CompileError):
        Engine(spark).compile("define function F(x Integer): F(x)\ndefine A: F(1)").evaluate("A")


def test_elm(spark):
    three = {"type": "Literal", "valueType": "{urn:hl7-org:elm-types:r1}Integer", "value": "3"}
    items = {"type": "List", "element": [three, {"type": "Null"}, three | {"value": "4"}]}
    this = {"type": "Current"}
    defs = [
        {"name": "A", "expression": {"type": "Add", "operand": [three, three]}},
        {"name": "B", "expression": {"type": "Multiply", "operand": [{"type": "ExpressionRef", "name": "A"}, three]}},
        {"name": "F", "expression": {"type": "Filter", "source": items, "condition": {"type": "Greater", "operand": [this, three]}}},
        {"name": "E", "expression": {"type": "ForEach", "source": items, "element": {"type": "Add", "operand": [this, three]}}},
        {"name": "Q", "expression": {"type": "Query", "source": [{"alias": "X", "expression": items}], "relationship": [], "where": {"type": "Greater", "operand": [{"type": "AliasRef", "name": "X"}, three]}, "return": {"expression": {"type": "Negate", "operand": {"type": "AliasRef", "name": "X"}}}}},
        {"name": "I", "expression": {"type": "In", "operand": [three, {"type": "Interval", "low": three, "high": three | {"value": "9"}}]}},
        {"name": "T", "expression": {"type": "ToString", "operand": three}},
        {"name": "S", "expression": {"type": "Sum", "source": items}},
    ]
    compiled = Engine(spark).compile(elm.library({"library": {"identifier": {"id": "E"}, "statements": {"def": defs}}}))
    got = {n: df.first()[0] for n, df in compiled.results().items()}
    assert got == {"A": 6, "B": 18, "F": [4], "E": [6, None, 7], "Q": [-4], "I": True, "T": "3", "S": 7}
    assert elm.dump(parse_expression("1 + 2"))["type"] == "Add"


LIBRARY = """
library Round version '2'
using FHIR version '4.0.1'
include Other version '1' called O
codesystem "S": 'urn:s'
valueset "V": 'urn:v'
code "C": 'c' from "S" display 'see'
concept "K": { "C" } display 'kay'
parameter P Interval<Integer> default Interval[1, 9)
define function F(x Integer, y List<String>): x + Count(y)
define A: (3 + 4.5 * 2) / 2
define B: if A > 3 then 'x' else Substring('abc', 1)
define D: case 3 when 1 then 'a' when 3 then 'b' else null end
define E: ({1, 2, null, 3}) X let y: X * 2 where y > 2 return all Tuple { x: X, y: y } sort by x desc
define G: from ({1, 2}) X, ({2, 3}) Y where X = Y return X + Y
define H: ({1, 2, 3}) X with ({2}) Y such that X = Y without ({9}) Z such that X = Z
define I: ({1, 2, 3}) X aggregate T starting 10: T * X
define J: months between @2014-01-15 and DateTime(2014, 5, 20, 10, 30, 0, 0)
define K2: collapse {Interval[1, 3], Interval[4, 6)} per 1 '1'
define L: F(2, {'a', 'b'}) in P
define M: Code { code: 'c', system: 'urn:s' } ~ "C" and Code { code: 'c', system: 'urn:s' } ~ "K"
define N: (convert '3' to Integer) is Integer and (null as String) is null
define Q2: Round(2.567, 1) + Length('abc') + PositionOf('b', 'abc') + First(Skip({5, 6}, 1)) + Last(Take({5, 6}, 1)) + Count(Tail({1, 2, 3}))
define R: Message(3 'mg', false, 'c', 'Error', 'm')
define S2: Sum(ForEach(Filter({1, 2, 3}, $this > 1), $this * 10))
define T: Combine({'a', 'b'}, '-') + Split('a,b', ',')[1]
define U: minimum Integer + 1 < 0 and @T10:30 before @T11:00 and hour from @2014-01-01T10 = 10
define X: { 1 'mg':2 'mg' }
"""


def test_export_reads_back(spark, tmp_path):
    (tmp_path / "Other-1.cql").write_text("library Other version '1' define Z: 1")
    engine = Engine(spark, now=datetime(2024, 6, 1), library_path=str(tmp_path))
    first = parse_library(LIBRARY)
    json = elm.export(first)
    second = elm.library(json)
    assert elm.export(second) == json
    one, two = engine.compile(first).results(), engine.compile(second).results()
    assert one.keys() == two.keys() and {n: one[n].collect() for n in one} == {n: two[n].collect() for n in two}
    kinds = str(json)
    assert all(f"'type': '{k}'" in kinds for k in ("ExpressionRef", "ParameterRef", "AliasRef", "QueryLetRef", "OperandRef", "CodeRef", "ConceptRef", "FunctionDef", "With", "Without", "Slice", "DurationBetween", "NamedTypeSpecifier"))
    from xml.etree import ElementTree

    root = ElementTree.fromstring(elm.xml(first))
    assert root.tag == "{urn:hl7-org:elm:r1}library" and len(root.findall(".//{urn:hl7-org:elm:r1}statements/{urn:hl7-org:elm:r1}def")) == len(first.definitions) + 1


def test_command_line(spark, tmp_path, capsys):
    file = tmp_path / "x.cql"
    file.write_text("parameter P Integer define A: P + 1 define B: [nation] N where N.n_nationkey < P return N.n_name")
    assert command.main(["execute", str(file), "--data", "/root/testdata/sf0.001", "--param", "P=1", "--format", "pretty"]) == 0
    assert capsys.readouterr().out.startswith("A: 2\nB:\n  value: ")
    assert command.main(["execute", str(file), "--data", "/root/testdata/sf0.001", "--param", "P=2", "--define", "A"]) == 0
    assert capsys.readouterr().out == '{"define": "A", "row": {"A": 3}}\n'
    assert command.main(["translate", str(file)]) == 0 and '"type": "ParameterRef"' in capsys.readouterr().out
    assert command.main(["translate", str(file), "--format", "xml"]) == 0 and 'xsi:type="ParameterRef"' in capsys.readouterr().out
    assert command.main(["validate", str(file)]) == 0 and capsys.readouterr().out == "2 definitions\n"
    file.write_text("define A: Missing(1) define B: 2")
    assert command.main(["validate", str(file), "--data", "/root/testdata/sf0.001"]) == 1
    assert "CQL0102" in capsys.readouterr().err
    assert command.main(["execute", str(file), "--param", "nothing"]) == 1 and "CQL0402" in capsys.readouterr().err
    file.write_text("define A: (")
    assert command.main(["validate", str(file)]) == 1 and "CQL0002" in capsys.readouterr().err


def test_large_value_set_in_an_expression(spark, monkeypatch):
    """More codes than a literal takes: a join of the query over the table, with the same answers."""
    rows = spark.createDataFrame([(1, "a", "s"), (2, "b", "s"), (3, None, "s"), (4, "a", "t")], "id long, kind string, sys string")
    expansion = spark.createDataFrame([("vs", "s", "a", "A")] + [("vs", "s", f"x{i}", "X") for i in range(50)], "valueset string, system string, code string, display string")
    catalog = Catalog(spark, terminology=Terminology(expansion)).add("Visit", rows, code_path="kind")
    text = """valueset "VS": 'vs'
    define Flag: [Visit] V return Tuple { id: V.id, text: V.kind in "VS", code: Code { code: V.kind, system: V.sys } in "VS" }
    define Kept: [Visit] V let k: V.kind in "VS" where k or V.id = 2 return V.id"""
    answers = []
    for most in (10_000, 10):
        monkeypatch.setattr(compiler, "MAX_LITERAL_CODES", most)
        made = Engine(spark, catalog).compile(text)
        answers.append((sorted((r.id, r.text, r.code) for r in made.evaluate("Flag").collect()), sorted(r[0] for r in made.evaluate("Kept").collect())))
    assert answers[0] == answers[1] == ([(1, True, True), (2, False, False), (3, None, None), (4, True, False)], [1, 2, 4])


def test_retrieve_options(spark):
    rows = spark.createDataFrame([(1, ("a", "s")), (2, ("a", "t")), (3, ("a", None)), (4, ("b", "s"))], "id long, kind struct<code:string,system:string>")
    catalog = Catalog(spark).add("Visit", rows, context="id", code_path="kind")
    made = Engine(spark, catalog).compile("""codesystem "S": 's' code "A": 'a' from "S" define Same: [Visit: kind = "A"] V return V.id define Like: [Visit: kind ~ "A"] V return V.id define In: [Visit: kind in "A"] V return V.id""")
    assert [sorted(r[0] for r in made.evaluate(n).collect()) for n in ("Same", "Like", "In")] == [[1], [1], [1, 2, 3]]
    population = spark.createDataFrame([(2,), (2,), (9,)], "p long")
    assert [r.id for r in catalog.retrieve("Visit", context=population).collect()] == [2] and catalog.retrieve("Visit", ids=[1, 4]).count() == 2
    from asclepia.sources.catalog import nothing

    assert catalog.add("None", nothing(spark, "id long")).retrieve("None").count() == 0
    with pytest.raises(errors.ModelError):
        catalog.retrieve("Missing")


def test_folds_and_ends_of_tables(spark):
    rows = spark.createDataFrame([(1, 3, 7), (1, 1, 9), (2, 2, None), (2, 5, -4)], "id long, day int, n int")
    catalog = Catalog(spark).add("Patient", spark.createDataFrame([(1,), (2,), (3,)], "id long"), context="id").add("Visit", rows, context="id")
    made = Engine(spark, catalog).compile("""define Fold: [Visit] V aggregate T starting 2L: T * V.n
    define All: Product([Visit] V return all V.n)
    define First: First([Visit] V return Tuple { day: V.day } sort by day)
    context Patient define Product: Product([Visit] V return all V.n)
    define Last: Last([Visit] V return Tuple { id: V.id, day: V.day } sort by day)""")
    assert made.evaluate("Fold").first()[0] == -504 and made.evaluate("All").first()[0] == -252 and made.evaluate("First").first().day == 1
    assert sorted(tuple(r) for r in made.evaluate("Product").collect()) == [(1, 63), (2, -4), (3, None)]
    assert sorted((r.id, r.day) for r in made.evaluate("Last").collect()) == [(1, 3), (2, 5)]
