"""One query per operator on values inside a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from asclepia.functions import arithmetic as A
from asclepia.functions import clinical as K
from asclepia.functions import comparison as C
from asclepia.functions import conversion as V
from asclepia.functions import intervals as I
from asclepia.functions import lists as L
from asclepia.functions import logic as N
from asclepia.functions import strings as S
from asclepia.functions import temporal as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
c, lit = F.col, F.lit

#: Key columns of each table, so that results have their row.
KEYS = {
    "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "customer": ["c_custkey"], "part": ["p_partkey"],
    "events": ["event_id"], "nation": ["n_nationkey"], "embeddings": ["vec_id"], "documents": ["doc_id"], "supplier": ["s_suppkey"],
}
FROM = {
    # Orders beside the labels of a document with the same number: many nulls.
    "labelled": ("documents", "labels", "doc_id", ["doc_id"]),
}


def _columns() -> None:
    """The columns that the queries below name briefly; they need a session, which importing this module doesn't."""
    global i, q, p, x, ql, tx, n, ty, o, ts, two
    i, q, p, x = c("l_linenumber"), c("l_quantity"), c("l_extendedprice"), c("l_discount")
    ql, tx, n, ty, o, ts = c("quality"), c("toxic"), c("p_name"), c("p_type"), c("o_orderdate"), c("ts")
    two = I.interval(lit(3), lit(5))


def add(name: str, table: str, columns: dict[str, tuple[Callable[[], Column] | Column, str]]) -> None:
    """``columns``: alias to (Column or a function that makes it, SQL)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _columns()
        if table in FROM:
            left, right, key, keys = FROM[table]
            df = spark.read.parquet(f"{sf_dir}/{left}.parquet").select(key).join(spark.read.parquet(f"{sf_dir}/{right}.parquet"), key, "left")
        else:
            df, keys = spark.read.parquet(f"{sf_dir}/{table}.parquet"), KEYS[table]
        return df.select(*keys, *[(x() if callable(x) and not isinstance(x, Column) else x).alias(a) for a, (x, _) in columns.items()])

    if table in FROM:
        left, right, key, keys = FROM[table]
        source = f"(SELECT doc_id FROM {left}) t LEFT JOIN {right} USING ({key})"
    else:
        keys, source = KEYS[table], table
    QUERIES[name] = run
    ORACLES[name] = f"SELECT {', '.join(keys)}, " + ", ".join(f"{sql} AS {a}" for a, (_, sql) in columns.items()) + f" FROM {source}"


def D(x: Column) -> Column:
    return F.round(x.cast("double"), 4)


def d(sql: str) -> str:
    return f"round(CAST({sql} AS DOUBLE), 4)"


def register() -> None:
    # Literals, references, property access.
    add("lit_literals", "nation", {
        "i": (lambda: lit(7), "7"), "l": (lambda: lit(7).cast("bigint"), "7::BIGINT"), "s": (lambda: lit("x"), "'x'"), "b": (lambda: lit(True), "true"),
        "dec": (lambda: lit("1.5").cast("decimal(28,8)").cast("double"), "1.5::DOUBLE"), "dt": (lambda: lit("2014-01-25").cast("date").cast("string"), "'2014-01-25'"),
        "nul": (lambda: lit(None).cast("int"), "NULL::INT"),
    })
    add("lit_property", "events", {"k": (lambda: F.get_json_object("props", "$.k").cast("int"), "json_extract_string(props, '$.k')::INT"), "v": (lambda: c("value"), "value")})
    add("tuple_instance", "customer", {
        "name": (lambda: F.struct(c("c_name").alias("name"), c("c_acctbal").alias("bal"))["name"], "c_name"),
        "bal": (lambda: F.struct(c("c_name").alias("name"), c("c_acctbal").alias("bal"))["bal"], "c_acctbal"),
    })
    # Arithmetic.
    add("num_add", "lineitem", {"ints": (lambda: A.add(i, i), "l_linenumber + l_linenumber"), "decs": (lambda: D(A.add(A.decimal(p), A.decimal(q))), d("l_extendedprice + l_quantity"))})
    add("num_subtract", "lineitem", {"ints": (lambda: A.subtract(i, lit(3)), "l_linenumber - 3"), "decs": (lambda: D(A.subtract(A.decimal(p), A.decimal(q))), d("l_extendedprice - l_quantity"))})
    add("num_multiply", "lineitem", {"ints": (lambda: A.multiply(i, i), "l_linenumber * l_linenumber"), "decs": (lambda: D(A.multiply_decimal(q, x)), d("l_quantity * l_discount"))})
    add("num_divide", "lineitem", {"r": (lambda: D(A.divide(q, i)), d("l_quantity / l_linenumber")), "zero": (lambda: D(A.divide(q, x)), d("l_quantity / nullif(l_discount, 0)"))})
    add("num_truncated_divide", "lineitem", {
        "r": (lambda: A.truncated_divide(i - 4, lit(2)).cast("int"), "((l_linenumber - 4) // 2)::INT"), "zero": (lambda: A.truncated_divide(i, i - 4).cast("int"), "(l_linenumber // nullif(l_linenumber - 4, 0))::INT"),
        "decs": (lambda: A.truncated_divide_decimal(q - 25, lit(4)).cast("double"), "(trunc((l_quantity - 25) / 4) + 0.0)::DOUBLE"),
    })
    add("num_modulo", "lineitem", {"r": (lambda: A.modulo(i - 4, lit(3)), "(l_linenumber - 4) % 3"), "zero": (lambda: A.modulo(i, i - 4), "l_linenumber % nullif(l_linenumber - 4, 0)")})
    add("num_power", "lineitem", {"ints": (lambda: A.power(i, lit(3), "int"), "(l_linenumber * l_linenumber * l_linenumber)"), "neg": (lambda: D(A.power(i, lit(-2))), d("pow(l_linenumber, -2)"))})
    add("num_negate", "lineitem", {"r": (lambda: A.negate(i), "-l_linenumber"), "f": (lambda: A.negate(q), "-l_quantity")})
    add("num_abs", "customer", {"r": (lambda: A.absolute(c("c_acctbal")), "abs(c_acctbal)")})
    add("num_ceiling", "customer", {"r": (lambda: A.ceiling(c("c_acctbal")), "ceil(c_acctbal)::INT")})
    add("num_floor", "customer", {"r": (lambda: A.floor(c("c_acctbal")), "floor(c_acctbal)::INT")})
    add("num_truncate", "customer", {"r": (lambda: A.truncate(c("c_acctbal")), "trunc(c_acctbal)::INT")})
    add("num_round", "lineitem", {
        "half": (lambda: A.round_((i - 4) / 2).cast("double"), "floor((l_linenumber - 4) / 2 + 0.5)::DOUBLE"),
        "tenth": (lambda: A.round_(c("l_extendedprice"), 1).cast("double"), "(floor(l_extendedprice::DECIMAL(18,2) * 10 + 0.5) / 10)::DOUBLE"),
    })
    add("num_ln", "lineitem", {"r": (lambda: D(A.ln(q)), d("ln(l_quantity)")), "neg": (lambda: D(A.ln(i - 4.5)), d("CASE WHEN l_linenumber > 4.5 THEN ln(l_linenumber - 4.5) END"))})
    add("num_exp", "lineitem", {"r": (lambda: D(A.exp(x)), d("exp(l_discount)"))})
    add("num_log", "lineitem", {"r": (lambda: D(A.log(q, i)), d("CASE WHEN l_linenumber > 1 THEN ln(l_quantity) / ln(l_linenumber) END"))})
    add("num_successor", "lineitem", {"i": (lambda: A.successor(i), "l_linenumber + 1"), "dec": (lambda: A.successor(q, "Decimal").cast("string"), "(l_quantity::DECIMAL(28,8) + 0.00000001::DECIMAL(28,8))::DECIMAL(28,8)::VARCHAR"), "day": (lambda: A.successor(F.to_date("l_shipdate"), "Date").cast("string"), "strftime(l_shipdate::DATE + 1, '%Y-%m-%d')")})
    add("num_predecessor", "lineitem", {"i": (lambda: A.predecessor(i), "l_linenumber - 1"), "dec": (lambda: A.predecessor(q, "Decimal").cast("string"), "(l_quantity::DECIMAL(28,8) - 0.00000001::DECIMAL(28,8))::DECIMAL(28,8)::VARCHAR"), "day": (lambda: A.predecessor(F.to_date("l_shipdate"), "Date").cast("string"), "strftime(l_shipdate::DATE - 1, '%Y-%m-%d')")})
    add("num_min_value", "nation", {"i": (lambda: A.minimum("Integer"), "(-2147483648)::INT"), "l": (lambda: A.minimum("Long"), "(-9223372036854775808)::BIGINT"), "dec": (lambda: A.minimum("Decimal").cast("string"), "'-99999999999999999999.99999999'"), "dt": (lambda: A.minimum("Date").cast("string"), "'0001-01-01'")})
    add("num_max_value", "nation", {"i": (lambda: A.maximum("Integer"), "2147483647::INT"), "l": (lambda: A.maximum("Long"), "9223372036854775807::BIGINT"), "dec": (lambda: A.maximum("Decimal").cast("string"), "'99999999999999999999.99999999'"), "dt": (lambda: A.maximum("Date").cast("string"), "'9999-12-31'"), "tm": (lambda: A.maximum("Time"), "86399999::INT")})
    add("num_precision", "customer", {"r": (lambda: A.precision(A.decimal(c("c_acctbal"))), "length(regexp_extract(regexp_replace(c_acctbal::DECIMAL(28,8)::VARCHAR, '\\.?0+$', ''), '\\.(\\d+)', 1))::INT")})
    add("num_low_boundary", "customer", {"r": (lambda: A.low_boundary(c("c_acctbal").cast("decimal(10,2)"), 4).cast("string"), "c_acctbal::DECIMAL(10,2)::DECIMAL(28,4)::VARCHAR")})
    add("num_high_boundary", "customer", {"r": (lambda: A.high_boundary(c("c_acctbal").cast("decimal(10,2)"), 2, 4).cast("string"), "(c_acctbal::DECIMAL(10,2)::DECIMAL(28,4) + CASE WHEN c_acctbal < 0 THEN -0.0099 ELSE 0.0099 END::DECIMAL(28,4))::DECIMAL(28,4)::VARCHAR")})
    # Comparison.
    for name, f, op in (("equal", C.equal, "="), ("not_equal", C.not_equal, "<>"), ("less", C.less, "<"), ("greater", C.greater, ">"), ("less_or_equal", C.less_or_equal, "<="), ("greater_or_equal", C.greater_or_equal, ">=")):
        add(f"cmp_{name}", "labelled", {"r": (lambda f=f: f(ql, tx), f"quality {op} toxic")})
        add(f"cmp_{name}_values", "orders", {"s": (lambda f=f: f(c("o_orderpriority"), lit("3-MEDIUM")), f"o_orderpriority {op} '3-MEDIUM'"), "t": (lambda f=f: f(c("o_orderdate"), lit("1997-05-28").cast("timestamp_ntz")), f"o_orderdate {op} TIMESTAMP '1997-05-28'")})
    add("cmp_equivalent", "labelled", {"r": (lambda: C.equivalent(ql, tx), "quality IS NOT DISTINCT FROM toxic")})
    add("cmp_equivalent_strings", "part", {"r": (lambda: C.equivalent_strings(F.upper("p_name"), c("p_name")), "true"), "o": (lambda: C.equivalent_strings(c("p_type"), c("p_name")), "lower(p_type) = lower(p_name)")})
    add("cmp_between", "part", {"r": (lambda: C.between(c("p_size"), lit(10), lit(20)), "p_size BETWEEN 10 AND 20")})
    three = lambda last: F.array(c("quality"), c("toxic"), lit(last).cast("int"))
    add("cmp_equal_lists", "labelled", {"r": (lambda: C.equal_lists(three(1), F.array(lit(1), lit(0), lit(1))), "CASE WHEN quality <> 1 OR toxic <> 0 THEN false WHEN quality IS NULL OR toxic IS NULL THEN NULL ELSE true END"), "sz": (lambda: C.equal_lists(three(1), F.array(lit(1))), "false")})
    add("cmp_equal_tuples", "labelled", {"r": (lambda: C.equal_tuples(F.struct(ql.alias("a"), tx.alias("b")), F.struct(lit(1).alias("a"), lit(0).alias("b")), ["a", "b"]), "CASE WHEN quality <> 1 OR toxic <> 0 THEN false WHEN quality IS NULL OR toxic IS NULL THEN NULL ELSE true END")})
    add("cmp_equivalent_lists", "labelled", {"r": (lambda: C.equivalent_lists(F.array(ql, tx), F.array(tx, ql)), "quality IS NOT DISTINCT FROM toxic")})
    mg, g = (lambda: V.quantity(c("p_size") * 1000, "mg")), (lambda: V.quantity(lit(20), "g"))
    add("cmp_quantities", "part", {"e": (lambda: C.equal_quantities(mg(), g()), "p_size = 20"), "l": (lambda: C.less_quantities(mg(), g()), "p_size < 20")})
    # Logic and nulls.
    a, b = (lambda: ql == 1), (lambda: tx == 1)
    sa, sb = "(quality = 1)", "(toxic = 1)"
    add("logic_and", "labelled", {"r": (lambda: N.and_(a(), b()), f"{sa} AND {sb}"), "n": (lambda: N.and_(a(), lit(False)), "false")})
    add("logic_or", "labelled", {"r": (lambda: N.or_(a(), b()), f"{sa} OR {sb}"), "n": (lambda: N.or_(a(), lit(True)), "true")})
    add("logic_xor", "labelled", {"r": (lambda: N.xor(a(), b()), f"{sa} <> {sb}")})
    add("logic_implies", "labelled", {"r": (lambda: N.implies(a(), b()), f"NOT {sa} OR {sb}")})
    add("logic_not", "labelled", {"r": (lambda: N.not_(a()), f"NOT {sa}")})
    add("null_is_null", "labelled", {"r": (lambda: N.is_null(ql), "quality IS NULL"), "n": (lambda: ~N.is_null(ql), "quality IS NOT NULL")})
    add("null_is_true", "labelled", {"r": (lambda: N.is_true(a()), f"{sa} IS NOT DISTINCT FROM true")})
    add("null_is_false", "labelled", {"r": (lambda: N.is_false(a()), f"{sa} IS NOT DISTINCT FROM false")})
    add("null_coalesce", "labelled", {"r": (lambda: N.coalesce(ql, tx, lit(-1)), "coalesce(quality, toxic, -1)"), "l": (lambda: N.coalesce_list(F.array(ql, lit(5))), "coalesce(quality, 5)")})
    add("cond_if", "labelled", {"r": (lambda: N.if_(a(), lit("good"), lit("else")), f"CASE WHEN {sa} THEN 'good' ELSE 'else' END")})
    add("cond_case", "labelled", {"r": (lambda: N.case([(a() & b(), lit(1)), (a(), lit(2))]), f"CASE WHEN {sa} AND {sb} THEN 1 WHEN {sa} THEN 2 END"), "k": (lambda: N.case([(lit(1), lit("one")), (lit(0), lit("zero"))], lit("none"), ql), "CASE quality WHEN 1 THEN 'one' WHEN 0 THEN 'zero' ELSE 'none' END")})
    # Strings.
    add("str_concatenate", "part", {"r": (lambda: S.concatenate(n, lit("-"), ty), "p_name || '-' || p_type")})
    add("str_combine", "part", {"r": (lambda: S.combine(F.array(n, lit(None).cast("string"), ty), ", "), "p_name || ', ' || p_type"), "none": (lambda: S.combine(F.array(lit(None).cast("string"))), "NULL::VARCHAR")})
    add("str_split", "part", {"first": (lambda: F.get(S.split(n, lit(" ")), lit(0)), "string_split(p_name, ' ')[1]"), "n": (lambda: F.size(S.split(n, lit("e"))), "len(string_split(p_name, 'e'))::INT")})
    add("str_split_on_matches", "part", {"n": (lambda: F.size(S.split_on_matches(n, lit("[aeiou]"))), "len(string_split_regex(p_name, '[aeiou]'))::INT")})
    add("str_length", "part", {"r": (lambda: S.length(n), "length(p_name)::INT")})
    add("str_upper", "part", {"r": (lambda: S.upper(n), "upper(p_name)")})
    add("str_lower", "part", {"r": (lambda: S.lower(ty), "lower(p_type)")})
    add("str_indexer", "part", {"r": (lambda: S.indexer(n, lit(2)), "substr(p_name, 3, 1)"), "out": (lambda: S.indexer(n, lit(-1)), "NULL::VARCHAR")})
    add("str_position_of", "part", {"r": (lambda: S.position_of(lit("e"), n), "(strpos(p_name, 'e') - 1)::INT")})
    add("str_last_position_of", "part", {"r": (lambda: S.last_position_of(lit("e"), n), "CASE WHEN strpos(p_name, 'e') = 0 THEN -1 ELSE length(p_name) - strpos(reverse(p_name), 'e') END::INT")})
    add("str_substring", "part", {"r": (lambda: S.substring(n, lit(2)), "substr(p_name, 3)"), "s": (lambda: S.substring(n, lit(1), lit(3)), "substr(p_name, 2, 3)"), "out": (lambda: S.substring(n, lit(100)), "NULL::VARCHAR")})
    add("str_starts_with", "part", {"r": (lambda: S.starts_with(n, lit("s")), "starts_with(p_name, 's')")})
    add("str_ends_with", "part", {"r": (lambda: S.ends_with(n, lit("t")), "suffix(p_name, 't')")})
    add("str_matches", "part", {"r": (lambda: S.matches(n, lit("r[ei]")), "regexp_matches(p_name, 'r[ei]')")})
    add("str_replace_matches", "part", {"r": (lambda: S.replace_matches(n, lit("([aeiou])"), lit("<$1>")), "regexp_replace(p_name, '([aeiou])', '<\\1>', 'g')")})
    # Dates and times.
    end = lambda: lit("1999-03-15").cast("timestamp_ntz")
    e = "TIMESTAMP '1999-03-15'"
    add("dt_now_today_timeofday", "nation", {"now": (lambda: F.date_format(lit("2024-06-01 10:30:00").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss"), "'2024-06-01 10:30:00'"), "today": (lambda: T.date_from(lit("2024-06-01 10:30:00").cast("timestamp_ntz")).cast("string"), "'2024-06-01'"), "tod": (lambda: T.time_from(lit("2024-06-01 10:30:00").cast("timestamp_ntz")).cast("bigint"), "37800000::BIGINT")})
    add("dt_date", "part", {"r": (lambda: T.date(lit(2000) + c("p_size"), lit(2), lit(28)).cast("string"), "strftime(make_date(2000 + p_size, 2, 28), '%Y-%m-%d')")})
    add("dt_date_time", "part", {"r": (lambda: F.date_format(T.date_time(lit(2000), lit(1), lit(1), c("p_size") % 24, c("p_size"), lit(5)), "yyyy-MM-dd HH:mm:ss"), "strftime(make_timestamp(2000, 1, 1, p_size % 24, p_size, 5.0), '%Y-%m-%d %H:%M:%S')")})
    add("dt_time", "part", {"r": (lambda: T.time(c("p_size") % 24, c("p_size")).cast("bigint"), "(((p_size % 24) * 60 + p_size) * 60000)::BIGINT")})
    add("dt_date_from", "events", {"r": (lambda: T.date_from(ts).cast("string"), "strftime(ts::DATE, '%Y-%m-%d')")})
    add("dt_time_from", "events", {"r": (lambda: T.time_from(ts).cast("bigint"), "((date_part('hour', ts) * 60 + date_part('minute', ts)) * 60000 + date_part('millisecond', ts))::BIGINT")})
    add("dt_timezone_from", "part", {"r": (lambda: T.timezone_text(c("p_size") * 15 - 300), "CASE WHEN p_size * 15 < 300 THEN '-' ELSE '+' END || lpad((abs(p_size * 15 - 300) // 60)::VARCHAR, 2, '0') || ':' || lpad((abs(p_size * 15 - 300) % 60)::VARCHAR, 2, '0')")})
    add("dt_timezone_offset_from", "part", {"r": (lambda: D(T.timezone_offset(c("p_size") * 15 - 300)), d("(p_size * 15 - 300) / 60"))})
    add("dt_component_from", "events", {k: (lambda k=k: T.component(ts, k).cast("int"), f"date_part('{k}', ts)::INT" if k != "millisecond" else "(date_part('millisecond', ts) % 1000)::INT") for k in T.PRECISIONS})
    months = f"((year({e}) - year(o_orderdate)) * 12 + month({e}) - month(o_orderdate))"
    whole = f"({months} - CASE WHEN {months} > 0 AND day({e}) < day(o_orderdate) THEN 1 WHEN {months} < 0 AND day({e}) > day(o_orderdate) THEN -1 ELSE 0 END)"
    add("dt_duration_between", "orders", {
        "y": (lambda: T.duration_between(o, end(), "year"), f"trunc({whole} / 12)::INT"), "m": (lambda: T.duration_between(o, end(), "months"), f"{whole}::INT"),
        "w": (lambda: T.duration_between(o, end(), "week"), f"trunc((epoch({e}) - epoch(o_orderdate)) / 604800)::INT"), "dd": (lambda: T.duration_between(o, end(), "day"), f"trunc((epoch({e}) - epoch(o_orderdate)) / 86400)::INT"),
        "h": (lambda: T.duration_between(o, end(), "hour"), f"trunc((epoch({e}) - epoch(o_orderdate)) / 3600)::INT"),
    })
    add("dt_difference_between", "orders", {
        "y": (lambda: T.difference_between(o, end(), "year"), f"date_diff('year', o_orderdate, {e})::INT"), "m": (lambda: T.difference_between(o, end(), "month"), f"date_diff('month', o_orderdate, {e})::INT"),
        "dd": (lambda: T.difference_between(o, end(), "day"), f"date_diff('day', o_orderdate, {e})::INT"), "h": (lambda: T.difference_between(o, end(), "hour"), f"date_diff('hour', o_orderdate, {e})::INT"),
    })
    noon = "TIMESTAMP '2024-01-15 12:00:00'"
    mid = lambda: lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    for name, f, op in (("same_as", T.same_as, "="), ("same_or_before", T.same_or_before, "<="), ("same_or_after", T.same_or_after, ">="), ("before", T.before, "<"), ("after", T.after, ">")):
        add(f"dt_{name}", "events", {"r": (lambda f=f: f(ts, mid()), f"ts {op} {noon}"), **{k: (lambda f=f, k=k: f(ts, mid(), k), f"date_trunc('{k}', ts) {op} date_trunc('{k}', {noon})") for k in ("month", "day", "hour")}})
    add("dt_add", "orders", {k: (lambda k=k: F.date_format(T.add(o, lit(3), k), "yyyy-MM-dd HH:mm:ss"), f"strftime(o_orderdate + INTERVAL 3 {k.upper()}, '%Y-%m-%d %H:%M:%S')") for k in ("year", "month", "week", "day", "hour", "minute")})
    add("dt_subtract", "orders", {k: (lambda k=k: F.date_format(T.subtract(o, lit(5), k), "yyyy-MM-dd HH:mm:ss"), f"strftime(o_orderdate - INTERVAL 5 {k.upper()}, '%Y-%m-%d %H:%M:%S')") for k in ("year", "month", "week", "day", "hour", "minute")})
    add("dt_add_to_date", "orders", {k: (lambda k=k: T.add(F.to_date(o), lit(2), k, "Date").cast("string"), f"strftime((o_orderdate::DATE + INTERVAL 2 {k.upper()})::DATE, '%Y-%m-%d')") for k in ("year", "month", "week", "day")})
    add("dt_add_to_time", "events", {"r": (lambda: T.add(T.time_from(ts), lit(30), "hour", "Time").cast("bigint"), "(((date_part('hour', ts) + 30) % 24 * 60 + date_part('minute', ts)) * 60000 + date_part('millisecond', ts))::BIGINT")})
    year = lambda: T.partial_date(F.year(o))
    full = lambda: T.as_partial(lit("1997-06-01").cast("date"), 3)
    add("dt_partial_compare", "orders", {
        "lt": (lambda: T.partial_less(year(), full()), "CASE WHEN year(o_orderdate) < 1997 THEN true WHEN year(o_orderdate) > 1997 THEN false END"),
        "eq": (lambda: T.partial_equal(year(), full()), "CASE WHEN year(o_orderdate) <> 1997 THEN false END"),
        "lo": (lambda: T.low_boundary(year()).cast("string"), "strftime(make_date(year(o_orderdate), 1, 1), '%Y-%m-%d')"), "hi": (lambda: T.high_boundary(year()).cast("string"), "strftime(make_date(year(o_orderdate), 12, 31), '%Y-%m-%d')"),
        "digits": (lambda: T.precision_digits(year()), "4"),
    })
    # Intervals: [linenumber, linenumber + quantity % 5] against [3, 6).
    lo, hi = "l_linenumber", "(l_linenumber + l_quantity::INT % 5)"
    iv = lambda: I.interval(i, (i + q.cast("int") % 5))
    r = lambda: I.interval(lit(3), lit(6), True, False)
    add("ivl_interval_bounds", "lineitem", {"s": (lambda: I.start(iv()), lo), "e": (lambda: I.end(iv()), hi), "w": (lambda: I.width(iv()), f"{hi} - {lo}"), "z": (lambda: I.size(iv()), f"{hi} - {lo} + 1"), "oz": (lambda: I.size(r()), "3"), "pt": (lambda: I.point_from(iv()), f"CASE WHEN {lo} = {hi} THEN {lo} END")})
    pred = {
        "contains": (lambda: I.contains(r(), i), f"{lo} >= 3 AND {lo} < 6"), "in": (lambda: I.in_(i, iv()), "true"),
        "includes": (lambda: I.includes(iv(), r()), f"{lo} <= 3 AND {hi} >= 6"), "included_in": (lambda: I.included_in(iv(), r()), f"{lo} >= 3 AND {hi} < 6"),
        "proper_contains": (lambda: I.proper_contains(iv(), lit(4)), f"4 BETWEEN {lo} AND {hi}"), "proper_in": (lambda: I.proper_in(lit(4), iv()), f"4 BETWEEN {lo} AND {hi}"),
        "proper_includes": (lambda: I.proper_includes(iv(), I.interval(i, i)), f"{hi} > {lo}"), "proper_included_in": (lambda: I.proper_included_in(iv(), r()), f"{lo} >= 3 AND {hi} < 6"),
        "before": (lambda: I.before(iv(), r()), f"{hi} < 3"), "after": (lambda: I.after(iv(), r()), f"{lo} >= 6"),
        "meets_before": (lambda: I.meets_before(iv(), r()), f"{hi} + 1 = 3"), "meets_after": (lambda: I.meets_after(iv(), r()), f"{lo} = 6"), "meets": (lambda: I.meets(iv(), r()), f"{hi} + 1 = 3 OR {lo} = 6"),
        "overlaps": (lambda: I.overlaps(iv(), r()), f"{lo} < 6 AND {hi} >= 3"), "overlaps_before": (lambda: I.overlaps_before(iv(), r()), f"{lo} < 3 AND {hi} >= 3 AND {hi} < 6"),
        "overlaps_after": (lambda: I.overlaps_after(iv(), r()), f"{lo} >= 3 AND {lo} < 6 AND {hi} >= 6"),
        "starts": (lambda: I.starts(iv(), r()), f"{lo} = 3 AND {hi} < 6"), "ends": (lambda: I.ends(iv(), I.interval(lit(0), lit(7))), f"{hi} = 7"), "equal": (lambda: I.equal(iv(), I.interval(lit(2), lit(4))), f"{lo} = 2 AND {hi} = 4"),
    }
    for k, (f, sql) in pred.items():
        add(f"ivl_{k}", "lineitem", {"r": (f, sql)})
    for k, f, none, low, high in (
        ("union", lambda: I.union(iv(), two), f"{lo} <= 6 AND {hi} >= 2", f"least({lo}, 3)", f"greatest({hi}, 5)"),
        ("intersect", lambda: I.intersect(iv(), two), f"{lo} <= 5 AND {hi} >= 3", f"greatest({lo}, 3)", f"least({hi}, 5)"),
    ):
        add(f"ivl_{k}", "lineitem", {"lo": (lambda f=f: f()["low"], f"CASE WHEN {none} THEN {low} END"), "hi": (lambda f=f: f()["high"], f"CASE WHEN {none} THEN {high} END")})
    add("ivl_except", "lineitem", {
        "lo": (lambda: I.except_(iv(), two)["low"], f"CASE WHEN {hi} < 3 OR {lo} > 5 THEN {lo} WHEN {lo} < 3 AND {hi} <= 5 THEN {lo} WHEN {lo} >= 3 AND {hi} > 5 THEN 6 END"),
        "hi": (lambda: I.except_(iv(), two)["high"], f"CASE WHEN {hi} < 3 OR {lo} > 5 THEN {hi} WHEN {lo} < 3 AND {hi} <= 5 THEN 2 WHEN {lo} >= 3 AND {hi} > 5 THEN {hi} END"),
    })
    add("ivl_expand", "lineitem", {"n": (lambda: F.size(I.expand(iv())), f"({hi} - {lo} + 1)::INT"), "s": (lambda: L.sum_(I.expand(iv())), f"(({lo} + {hi}) * ({hi} - {lo} + 1) // 2)::INT"), "per2": (lambda: F.size(I.expand_intervals(iv(), 2)), f"(({hi} - {lo} + 1) // 2)::INT")})
    add("ivl_collapse_list", "lineitem", {"n": (lambda: F.size(I.collapse(F.array(iv(), I.interval(lit(3), lit(5)), lit(None).cast("struct<low:int,high:int,lowClosed:boolean,highClosed:boolean>")))), f"CASE WHEN {lo} <= 6 AND {hi} >= 2 THEN 1 ELSE 2 END"), "lo": (lambda: F.get(I.collapse(F.array(iv(), I.interval(lit(3), lit(5)))), lit(0))["low"], f"least({lo}, 3)")})
    add("ivl_uncertain_arithmetic", "lineitem", {"a": (lambda: I.add(iv(), two)["high"], f"{hi} + 5"), "s": (lambda: I.subtract(iv(), two)["low"], f"{lo} - 5"), "m": (lambda: I.multiply(iv(), I.interval(lit(-2), lit(2)))["low"], f"-2 * {hi}")})
    # Lists: the first eight numbers of an embedding, in hundredths.
    ints = lambda: F.transform(F.slice("embedding", 1, 8), lambda v: F.floor(v.cast("double") * 10).cast("int"))
    arr = "list_transform(embedding[1:8], lambda v: floor(v::DOUBLE * 10)::INT)"
    j = lambda x: F.array_join(x.cast("array<string>"), ",")
    js = lambda x: f"array_to_string({x}, ',')"
    lst = {
        "list": (lambda: j(L.list_(c("label"), lit(1))), "label || ',1'"), "exists": (lambda: L.exists(ints()), "true"),
        "times": (lambda: F.size(L.times(ints(), ints())), "64"), "filter": (lambda: j(L.filter_(ints(), lambda v: v > 0)), js(f"list_filter({arr}, lambda v: v > 0)")),
        "for_each": (lambda: j(L.for_each(ints(), lambda v: v * 2)), js(f"list_transform({arr}, lambda v: v * 2)")), "first": (lambda: L.first(ints()), f"{arr}[1]"), "last": (lambda: L.last(ints()), f"{arr}[8]"),
        "slice": (lambda: j(L.slice_(ints(), 2, 5)), js(f"{arr}[3:5]")), "take": (lambda: j(L.take(ints(), 3)), js(f"{arr}[1:3]")), "skip": (lambda: j(L.skip(ints(), 3)), js(f"{arr}[4:8]")), "tail": (lambda: j(L.tail(ints())), js(f"{arr}[2:8]")),
        "index_of": (lambda: L.index_of(ints(), lit(0)), f"(coalesce(list_position({arr}, 0), 0) - 1)::INT"), "indexer": (lambda: L.indexer(ints(), lit(3)), f"{arr}[4]"),
        "contains": (lambda: L.contains(ints(), lit(1)), f"list_contains({arr}, 1)"), "in": (lambda: L.in_(lit(-1), ints()), f"list_contains({arr}, -1)"),
        "includes": (lambda: L.includes(ints(), F.array(lit(0), lit(1))), f"list_has_all({arr}, [0, 1])"), "included_in": (lambda: L.included_in(ints(), F.array(*[lit(k) for k in range(-2, 3)])), f"list_has_all([-2, -1, 0, 1, 2], {arr})"),
        "proper_includes": (lambda: L.proper_includes(ints(), F.array(lit(0))), f"list_has_all({arr}, [0]) AND len(list_distinct({arr})) > 1"),
        "flatten": (lambda: F.size(L.flatten(F.array(ints(), lit(None).cast("array<int>"), ints()))), "16"), "sort": (lambda: j(L.sort(ints())), js(f"list_sort({arr})")), "sort_descending": (lambda: j(L.sort(ints(), True)), js(f"list_reverse_sort({arr})")),
        "distinct": (lambda: j(F.array_sort(L.distinct(ints()))), js(f"list_sort(list_distinct({arr}))")),
        "union": (lambda: F.size(L.union(ints(), F.array(lit(7), lit(0), lit(7)))), f"(8 + 1 + CASE WHEN list_contains({arr}, 0) THEN 0 ELSE 1 END)::INT"),
        "intersect": (lambda: j(F.array_sort(L.intersect(ints(), F.array(lit(0), lit(1), lit(-1))))), js(f"list_sort(list_distinct(list_intersect({arr}, [0, 1, -1])))")),
        "except": (lambda: j(L.except_(ints(), F.array(lit(0)))), js(f"list_filter({arr}, lambda v: v <> 0)")), "singleton_from": (lambda: L.singleton_from(F.array(c("label"))), "label"),
        "count": (lambda: L.count(ints()), "8"), "sum": (lambda: L.sum_(ints()), f"list_sum({arr})::INT"), "product": (lambda: L.product(ints()), f"list_product({arr})::INT"), "min": (lambda: L.min_(ints()), f"list_min({arr})"), "max": (lambda: L.max_(ints()), f"list_max({arr})"),
        "avg": (lambda: D(L.avg(ints())), d(f"list_avg({arr})")), "median": (lambda: D(L.median(ints())), d(f"list_median({arr})")), "mode": (lambda: L.mode(ints()), f"list_sort(list_transform(list_filter(list_transform(list_distinct({arr}), lambda u: [u, len(list_filter({arr}, lambda w: w = u))]), lambda z: z[2] = list_max(list_transform({arr}, lambda u: len(list_filter({arr}, lambda w: w = u))))), lambda z: z[1]))[1]::INT"),
        "variance": (lambda: D(L.variance(ints())), d(f"list_var_samp({arr})")), "population_variance": (lambda: D(L.population_variance(ints())), d(f"list_var_pop({arr})")), "std_dev": (lambda: D(L.std_dev(ints())), d(f"list_stddev_samp({arr})")), "population_std_dev": (lambda: D(L.population_std_dev(ints())), d(f"list_stddev_pop({arr})")),
        "all_true": (lambda: L.all_true(F.transform(ints(), lambda v: v < 2)), f"coalesce(list_bool_and(list_transform({arr}, lambda v: v < 2)), true)"), "any_true": (lambda: L.any_true(F.transform(ints(), lambda v: v > 1)), f"coalesce(list_bool_or(list_transform({arr}, lambda v: v > 1)), false)"),
        "aggregate": (lambda: L.aggregate(ints(), lit(1), lambda t, v: t * 2 + v), f"list_reduce(list_prepend(1, {arr}), lambda t, v: t * 2 + v)::INT"), "geometric_mean": (lambda: D(L.geometric_mean(F.transform(ints(), lambda v: F.abs(v) + 1))), d(f"exp(list_avg(list_transform({arr}, lambda v: ln(abs(v) + 1))))")),
        "repeat": (lambda: F.size(L.repeat(F.array(c("label")), lambda v: F.array((v + 3) % 7), 7)), "CASE WHEN label < 7 THEN 7 ELSE 8 END"),
    }
    for k, (f, sql) in lst.items():
        add(f"list_{k}", "embeddings", {"r": (f, sql)})
    # Conversions.
    odd = lambda: F.when(c("p_size") % 3 == 0, lit("abc")).otherwise(c("p_size").cast("string"))
    so = "CASE WHEN p_size % 3 = 0 THEN 'abc' ELSE p_size::VARCHAR END"
    day = lambda: F.concat(lit("2001-02-"), F.lpad((c("p_size") % 31 + 1).cast("string"), 2, "0"))
    sd = "'2001-02-' || lpad((p_size % 31 + 1)::VARCHAR, 2, '0')"
    yes = lambda: F.when(c("p_size") % 3 == 0, lit("Yes")).when(c("p_size") % 3 == 1, lit("f")).otherwise(lit("maybe"))
    add("conv_as", "part", {"r": (lambda: V.as_(c("p_size"), "bigint"), "p_size::BIGINT")})
    add("conv_is", "labelled", {"r": (lambda: V.is_(ql), "quality IS NOT NULL")})
    add("conv_convert", "part", {"r": (lambda: V.convert(odd(), "Integer"), f"TRY_CAST({so} AS INT)")})
    add("conv_can_convert", "part", {"r": (lambda: V.can_convert(odd(), "Integer"), "p_size % 3 <> 0")})
    add("conv_to_boolean", "part", {"r": (lambda: V.to_boolean(yes()), "CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END"), "n": (lambda: V.boolean_from_number(c("p_size") % 2), "p_size % 2 <> 0")})
    add("conv_to_chars", "part", {"r": (lambda: F.array_join(V.to_chars(n), "."), "array_to_string(string_split(p_name, ''), '.')")})
    add("conv_to_integer", "part", {"r": (lambda: V.to_integer(odd()), f"TRY_CAST({so} AS INT)"), "f": (lambda: V.integer_from_number(c("p_retailprice")), "trunc(p_retailprice)::INT"), "frac": (lambda: V.to_integer(lit("1.5")), "NULL::INT")})
    add("conv_to_long", "part", {"r": (lambda: V.to_long(odd()), f"TRY_CAST({so} AS BIGINT)")})
    add("conv_to_decimal", "part", {"r": (lambda: D(V.to_decimal(c("p_retailprice").cast("string"))), d("p_retailprice")), "bad": (lambda: D(V.to_decimal(n)), "NULL::DOUBLE")})
    add("conv_to_string", "part", {"r": (lambda: V.to_string(c("p_size")), "p_size::VARCHAR"), "q": (lambda: V.to_string(V.quantity(c("p_size"), "mg"), "Quantity"), "p_size || ' ''mg'''"), "t": (lambda: V.to_string(c("p_size") * 60000, "Time"), "'00:' || lpad(p_size::VARCHAR, 2, '0') || ':00.000'")})
    add("conv_to_date", "part", {"r": (lambda: V.to_date(day()).cast("string"), f"strftime(TRY_CAST({sd} AS DATE), '%Y-%m-%d')"), "p": (lambda: V.to_partial_date(lit("2001-02"))["hi"].cast("string"), "'2001-02-28'")})
    add("conv_to_date_time", "part", {"r": (lambda: F.date_format(V.to_date_time(F.concat(day(), lit("T10:00:00"))), "yyyy-MM-dd HH:mm:ss"), f"strftime(TRY_CAST({sd} || ' 10:00:00' AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')")})
    add("conv_to_time", "part", {"r": (lambda: V.to_time(F.concat(lit("T10:"), F.lpad(c("p_size").cast("string"), 2, "0"))).cast("bigint"), "((600 + p_size) * 60000)::BIGINT"), "bad": (lambda: V.to_time(n), "NULL::INT")})
    add("conv_to_quantity", "part", {"v": (lambda: V.to_quantity(F.concat(c("p_size").cast("string"), lit(" 'mg'")))["value"].cast("double"), "p_size::DOUBLE"), "u": (lambda: V.to_quantity(F.concat(c("p_size").cast("string"), lit(" 'mg'")))["unit"], "'mg'"), "bad": (lambda: V.to_quantity(n)["unit"], "NULL::VARCHAR")})
    add("conv_to_ratio", "part", {"n": (lambda: V.to_ratio(F.concat(c("p_size").cast("string"), lit(" 'mg' : 2 'mL'")))["numerator"]["value"].cast("double"), "p_size::DOUBLE"), "du": (lambda: V.to_ratio(F.concat(c("p_size").cast("string"), lit(" 'mg' : 2 'mL'")))["denominator"]["unit"], "'mL'")})
    add("conv_to_list", "labelled", {"n": (lambda: F.size(V.to_list(ql)), "CASE WHEN quality IS NULL THEN 0 ELSE 1 END")})
    add("conv_to_concept", "part", {"r": (lambda: F.get(V.to_concept(K.code(ty, c("p_brand")))["codes"], lit(0))["code"], "p_type")})
    for kind, col, sql in (("Boolean", yes, "p_size % 3 <> 2"), ("Integer", odd, "p_size % 3 <> 0"), ("Long", odd, "p_size % 3 <> 0"), ("Decimal", odd, "p_size % 3 <> 0"), ("String", odd, "true"), ("Date", day, "p_size % 31 + 1 <= 28"), ("DateTime", day, "p_size % 31 + 1 <= 28"), ("Time", lambda: F.concat(lit("T10:"), (c("p_size") + 50).cast("string")), "p_size + 50 < 60"), ("Quantity", odd, "p_size % 3 <> 0"), ("Ratio", lambda: F.concat(odd(), lit(":2")), "p_size % 3 <> 0")):
        add(f"conv_converts_to_{kind.lower()}", "part", {"r": (lambda kind=kind, col=col: V.converts_to(col(), kind), sql)})
    # Clinical.
    code = lambda: K.code(ty, c("p_brand"), lit("1"))
    other = lambda: K.code(lit("ECONOMY"), c("p_brand"), lit("2"))
    add("clin_code", "part", {"code": (lambda: code()["code"], "p_type"), "system": (lambda: code()["system"], "p_brand")})
    add("clin_concept", "part", {"n": (lambda: F.size(K.concept([code(), other()])["codes"]), "2")})
    add("clin_quantity", "part", {"v": (lambda: D(K.quantity(c("p_size"), "mg")["value"]), d("p_size")), "sum": (lambda: D(K.add_quantities(K.quantity(c("p_size"), "mg"), K.quantity(lit(5), "mg"))["value"]), d("p_size + 5")), "diff": (lambda: D(K.subtract_quantities(K.quantity(c("p_size"), "mg"), K.quantity(lit(5), "mg"))["value"]), d("p_size - 5")), "times": (lambda: D(K.multiply_quantity(K.quantity(c("p_size"), "mg"), lit(3))["value"]), d("p_size * 3")), "div": (lambda: D(K.divide_quantities(K.quantity(c("p_size"), "mg"), K.quantity(lit(4), "mL"))["value"]), d("p_size / 4")), "unit": (lambda: K.divide_quantities(K.quantity(c("p_size"), "mg"), K.quantity(lit(4), "mL"))["unit"], "'mg/mL'")})
    add("clin_ratio", "part", {"d": (lambda: D(K.ratio(K.quantity(c("p_size"), "mg"), K.quantity(lit(2), "mL"))["denominator"]["value"]), d("2"))})
    add("clin_code_equal", "part", {"r": (lambda: C.equal_codes(code(), other()), "false"), "same": (lambda: C.equal_codes(code(), code()), "true")})
    add("clin_code_equivalent", "part", {"r": (lambda: C.equivalent_codes(code(), other()), "p_type = 'ECONOMY'")})
    add("clin_concept_equivalent", "part", {"r": (lambda: C.equivalent_concepts(K.concept([code()]), K.concept([other()])), "p_type = 'ECONOMY'")})
    add("clin_in_code_system", "part", {"r": (lambda: K.in_code_system(code(), "Brand#2"), "p_brand = 'Brand#2'"), "k": (lambda: K.in_code_system(K.concept([code()]), "Brand#2", True), "p_brand = 'Brand#2'")})
    add("clin_age", "orders", {"y": (lambda: K.age(o, end()), f"trunc({whole} / 12)::INT"), "m": (lambda: K.age_at(o, end(), "month"), f"{whole}::INT")})


register()
