"""One query per operator on relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asclepia.functions import aggregates as G
from asclepia.functions import intervals as I
from asclepia.operators import relations as R
from asclepia.operators.query import Query, fold_as_aggregate
from asclepia.sources.catalog import test_tables
from asclepia.sources.terminology import Terminology

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def sql(text: str):
    def keep(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark, sf_dir)

        run.__name__ = f.__name__
        QUERIES[f.__name__], ORACLES[f.__name__] = run, text
        return f

    return keep


@sql("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def q_without(t, spark, sf_dir):
    q = Query(t("orders"), "O").without(t("lineitem"), "L", lambda q: (q.L.l_orderkey == q.O.o_orderkey) & (q.L.l_returnflag == "R"))
    return q.where(lambda q: q.O.o_totalprice > 1000).return_(o_orderkey=lambda q: q.O.o_orderkey, o_totalprice=lambda q: q.O.o_totalprice).dataframe()


@sql("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def q_with(t, spark, sf_dir):
    q = Query(t("orders"), "O").with_(t("lineitem"), "L", lambda q: (q.L.l_orderkey == q.O.o_orderkey) & (q.L.l_quantity > 45))
    return q.return_(o_orderkey=lambda q: q.O.o_orderkey).dataframe()


@sql("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 90 DAY)")
def q_with_theta(t, spark, sf_dir):
    q = Query(t("orders"), "O").with_(t("lineitem"), "L", lambda q: (q.L.l_orderkey == q.O.o_orderkey) & (q.L.l_shipdate > q.O.o_orderdate + F.expr("interval 90 day")))
    return q.return_(o_orderkey=lambda q: q.O.o_orderkey).dataframe()


@sql("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def q_multi_with(t, spark, sf_dir):
    q = Query(t("customer"), "C").with_(t("orders"), "A", lambda q: (q.A.o_custkey == q.C.c_custkey) & (q.A.o_orderstatus == "F"))
    return q.without(t("orders"), "B", lambda q: (q.B.o_custkey == q.C.c_custkey) & (q.B.o_orderpriority == "1-URGENT")).return_(c_custkey=lambda q: q.C.c_custkey).dataframe()


@sql("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_discount > 0.05 AND l_shipdate >= TIMESTAMP '1998-01-01'")
def q_where(t, spark, sf_dir):
    q = Query(t("lineitem"), "L").where(lambda q: (q.L.l_discount > 0.05) & (q.L.l_shipdate >= F.lit("1998-01-01").cast("timestamp_ntz")))
    return q.return_(**{c: (lambda q, c=c: q.L[c]) for c in ("l_orderkey", "l_linenumber", "l_extendedprice")}).dataframe()


@sql("SELECT l_orderkey AS k, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def q_return(t, spark, sf_dir):
    return Query(t("lineitem"), "L").return_(k=lambda q: q.L.l_orderkey, net=lambda q: F.round(q.L.l_extendedprice * (1 - q.L.l_discount), 4)).dataframe()


@sql("SELECT * FROM supplier")
def q_default_return(t, spark, sf_dir):
    return Query(t("supplier"), "S").dataframe()


@sql("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def q_return_distinct(t, spark, sf_dir):
    return Query(t("lineitem"), "L").return_(distinct=True, l_returnflag=lambda q: q.L.l_returnflag, l_linestatus=lambda q: q.L.l_linestatus).dataframe()


@sql("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS gross FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 50000")
def q_let(t, spark, sf_dir):
    q = Query(t("lineitem"), "L").let(net=lambda q: q.L.l_extendedprice * (1 - q.L.l_discount)).let(gross=lambda q: q.net * (1 + q.L.l_tax))
    return q.where(lambda q: q.net > 50000).return_(l_orderkey=lambda q: q.L.l_orderkey, l_linenumber=lambda q: q.L.l_linenumber, gross=lambda q: F.round(q.gross, 6)).dataframe()


@sql("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
def q_multisource_equi(t, spark, sf_dir):
    q = Query(t("nation"), "N").from_(t("region"), "R").where(lambda q: q.N.n_regionkey == q.R.r_regionkey)
    return q.return_(n_name=lambda q: q.N.n_name, r_name=lambda q: q.R.r_name).dataframe()


@sql("SELECT n_name, r_name FROM nation, region WHERE n_regionkey < r_regionkey")
def q_multisource_theta(t, spark, sf_dir):
    q = Query(t("nation"), "N").from_(t("region"), "R").where(lambda q: q.N.n_regionkey < q.R.r_regionkey)
    return q.return_(n_name=lambda q: q.N.n_name, r_name=lambda q: q.R.r_name).dataframe()


@sql("SELECT n_nationkey, r_regionkey FROM nation, region")
def q_multisource_cross(t, spark, sf_dir):
    df = Query(t("nation"), "N").from_(t("region"), "R").dataframe()
    return df.select(F.col("N.n_nationkey").alias("n_nationkey"), F.col("R.r_regionkey").alias("r_regionkey"))


@sql("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def q_sort_topk(t, spark, sf_dir):
    q = Query(t("orders"), "O").return_(o_orderkey=lambda q: q.O.o_orderkey, o_totalprice=lambda q: q.O.o_totalprice)
    return q.sort(("o_totalprice", "desc"), "o_orderkey").dataframe().limit(20)


@sql("SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 10 OFFSET 5)")
def q_slice(t, spark, sf_dir):
    q = Query(t("orders"), "O").return_(o_orderkey=lambda q: q.O.o_orderkey, at=lambda q: q.O.o_orderdate).sort("at", "o_orderkey").dataframe()
    return q.offset(5).limit(10).select("o_orderkey")


@sql("SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1")
def q_first(t, spark, sf_dir):
    return t("orders").orderBy("o_orderdate", "o_orderkey").limit(1).select("o_orderkey")


@sql("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def q_first_per_patient(t, spark, sf_dir):
    return R.first_per(t("orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@sql("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def q_last_per_patient(t, spark, sf_dir):
    return R.last_per(t("orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@sql("SELECT r_name FROM region ORDER BY r_name OFFSET 1")
def q_tail(t, spark, sf_dir):
    return t("region").orderBy("r_name").offset(1).select("r_name")


@sql("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'")
def q_retrieve(t, spark, sf_dir):
    low, high = (F.lit(x).cast("timestamp_ntz") for x in ("1996-01-01", "1996-12-31"))
    return test_tables(spark, sf_dir).retrieve("Encounter", codes=["1-URGENT", "2-HIGH"], date_range=(low, high)).select("o_orderkey")


def _aggregate(name: str, column, text: str, table: str = "lineitem", by: str = "l_returnflag") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{table}.parquet").groupBy(by).agg(column().alias("r"))

    QUERIES[name], ORACLES[name] = run, f"SELECT {by}, {text} AS r FROM {table} GROUP BY {by}"


c = F.col
D = lambda x: F.round(x.cast("double"), 3)
_aggregate("agg_count", lambda: G.count(c("l_quantity")), "count(l_quantity)::INT")
_aggregate("agg_sum", lambda: G.sum_(c("l_linenumber"), "bigint"), "sum(l_linenumber)::BIGINT")
_aggregate("agg_min", lambda: G.min_(c("l_extendedprice")), "min(l_extendedprice)")
_aggregate("agg_max", lambda: G.max_(c("l_extendedprice")), "max(l_extendedprice)")
_aggregate("agg_avg", lambda: D(G.avg(c("l_quantity"))), "round(avg(l_quantity), 3)")
_aggregate("agg_geometric_mean", lambda: D(G.geometric_mean(c("l_quantity"))), "round(exp(avg(ln(l_quantity))), 3)")
_aggregate("agg_median", lambda: D(G.median(c("l_extendedprice"))), "round(median(l_extendedprice), 3)")
QUERIES["agg_mode"] = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").agg(G.mode(F.col("l_linenumber")).alias("r"))
_aggregate("agg_variance", lambda: D(G.variance(c("l_quantity"))), "round(var_samp(l_quantity), 3)")
_aggregate("agg_population_variance", lambda: D(G.population_variance(c("l_quantity"))), "round(var_pop(l_quantity), 3)")
_aggregate("agg_std_dev", lambda: D(G.std_dev(c("l_quantity"))), "round(stddev_samp(l_quantity), 3)")
_aggregate("agg_population_std_dev", lambda: D(G.population_std_dev(c("l_quantity"))), "round(stddev_pop(l_quantity), 3)")
_aggregate("agg_all_true", lambda: G.all_true(c("value") > 1), "coalesce(bool_and(value > 1), true)", "events", "user_id")
_aggregate("agg_any_true", lambda: G.any_true(c("value") > 90), "coalesce(bool_or(value > 90), false)", "events", "user_id")
ORACLES["agg_mode"] = "SELECT l_returnflag, l_linenumber AS r FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_linenumber) AS k FROM (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE k = 1"
QUERIES["agg_product"] = lambda spark, sf_dir: R.product(spark.read.parquet(f"{sf_dir}/nation.parquet").withColumn("x", F.col("n_nationkey") + 1), ["n_regionkey"], "x", "r")
ORACLES["agg_product"] = "SELECT n_regionkey, product(n_nationkey + 1)::BIGINT AS r FROM nation GROUP BY n_regionkey"


@sql("SELECT c_custkey, count(o_orderkey)::INT AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total, coalesce(bool_and(o_orderstatus = 'F'), true) AS all_f FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def agg_context_patient(t, spark, sf_dir):
    population = t("customer").select(F.col("c_custkey"))
    rows = t("orders").withColumnRenamed("o_custkey", "c_custkey")
    return R.in_context(population, rows, "c_custkey", n=(G.count(c("o_orderkey")), 0), total=(F.sum(c("o_totalprice").cast("decimal(18,2)")).cast("double"), None), all_f=(F.bool_and(c("o_orderstatus") == "F"), True))


@sql("SELECT user_id, sum((value * 100)::BIGINT)::BIGINT AS r FROM events GROUP BY user_id")
def agg_fold_sum(t, spark, sf_dir):
    total = fold_as_aggregate(0, "+")
    return t("events").groupBy("user_id").agg(total(F.round(c("value") * 100).cast("bigint")).alias("r"))


@sql("SELECT user_id, list_reduce(list_prepend(0::BIGINT, list((value * 100)::BIGINT ORDER BY ts, event_id)), lambda a, x: (a * 31 + x) % 1000003)::BIGINT AS r FROM events GROUP BY user_id")
def agg_fold_ordered(t, spark, sf_dir):
    q = Query(t("events"), "E")
    out = q.aggregate(F.lit(0).cast("bigint"), lambda a, x: (a * 31 + x) % 1000003, lambda q: F.round(q.E.value * 100).cast("bigint"), [lambda q: q.E.ts, lambda q: q.E.event_id], [lambda q: q.E.user_id], name="r")
    return out.withColumnRenamed("k0", "user_id")


@sql("SELECT user_id, sum(DISTINCT value::INT)::BIGINT AS r FROM events GROUP BY user_id")
def agg_fold_distinct(t, spark, sf_dir):
    q = Query(t("events"), "E")
    out = q.aggregate(F.lit(0).cast("bigint"), lambda a, x: a + x, lambda q: F.rint(q.E.value).cast("bigint"), [lambda q: q.E.ts], [lambda q: q.E.user_id], distinct=True, name="r")
    return out.withColumnRenamed("k0", "user_id")


@sql("SELECT c_nationkey AS k FROM customer UNION ALL SELECT k FROM (SELECT DISTINCT s_nationkey AS k FROM supplier) WHERE k NOT IN (SELECT c_nationkey FROM customer)")
def set_union(t, spark, sf_dir):
    return R.union(t("customer").select(c("c_nationkey").alias("k")), t("supplier").select(c("s_nationkey").alias("k")))


@sql("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(t, spark, sf_dir):
    return R.intersect(t("customer").select(c("c_nationkey").alias("k")), t("supplier").select(c("s_nationkey").alias("k")))


@sql("SELECT c_nationkey AS k FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def set_except(t, spark, sf_dir):
    return R.except_(t("customer").select(c("c_nationkey").alias("k")), t("supplier").filter("s_acctbal > 5000").select(c("s_nationkey").alias("k")))


@sql("SELECT DISTINCT p_type, p_size FROM part")
def set_distinct(t, spark, sf_dir):
    return R.distinct(t("part").select("p_type", "p_size"))


@sql("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def rel_exists(t, spark, sf_dir):
    return Query(t("orders"), "O").with_(t("lineitem"), "L", lambda q: q.L.l_orderkey == q.O.o_orderkey).return_(o_orderkey=lambda q: q.O.o_orderkey).dataframe()


_ISLANDS = """WITH e AS (SELECT user_id, epoch_us(ts) // 1000000 AS low, epoch_us(ts) // 1000000 + 21600 AS high FROM events),
m AS (SELECT *, CASE WHEN low <= max(high) OVER (PARTITION BY user_id ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS n FROM e),
i AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, min(low)::BIGINT AS low, max(high)::BIGINT AS high FROM i GROUP BY user_id, k"""


@sql(_ISLANDS)
def ivl_collapse(t, spark, sf_dir):
    low = F.unix_seconds(c("ts").cast("timestamp"))
    return R.collapse_integers(t("events").select("user_id", low.alias("low"), (low + 21600).alias("high")), ["user_id"])


@sql("SELECT c_custkey, p::INT AS point FROM (SELECT c_custkey, unnest(generate_series(c_nationkey, c_nationkey + c_custkey % 4)) AS p FROM customer)")
def ivl_expand_rows(t, spark, sf_dir):
    low = c("c_nationkey")
    df = t("customer").withColumn("i", I.interval(low, (low + c("c_custkey").cast("int") % 4).cast("int")))
    return R.expand(df, I.expand(c("i"))).select("c_custkey", "point")


_O = "SELECT o_orderkey, o_custkey, (epoch(o_orderdate) // 86400)::BIGINT AS a, (epoch(o_orderdate) // 86400)::BIGINT + 20 AS b FROM orders"


@sql(f"WITH o AS ({_O}) SELECT o.o_orderkey, x.o_orderkey AS x_key FROM o JOIN o AS x ON o.a <= x.a + 1 AND x.a <= o.a + 1")
def ivl_overlap_join(t, spark, sf_dir):
    day = F.datediff(c("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("bigint")
    o = t("orders").select("o_orderkey", day.alias("a"), (day + 1).alias("b"))
    x = o.select(c("o_orderkey").alias("x_key"), c("a").alias("x_a"), c("b").alias("x_b"))
    return R.range_join(o, x, "a", "b", "x_a", "x_b", 2).select("o_orderkey", "x_key")


@sql(f"WITH o AS ({_O}), m AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS d FROM orders), x AS (SELECT (epoch(d) // 86400)::BIGINT AS x_a, (epoch(last_day(d)) // 86400)::BIGINT AS x_b FROM m) SELECT o_orderkey, x_a AS month_day FROM o JOIN x ON a <= x_b AND x_a <= b")
def ivl_overlap_join_months(t, spark, sf_dir):
    number = lambda x: F.datediff(x, F.lit("1970-01-01").cast("date")).cast("bigint")
    o = t("orders").select("o_orderkey", number(c("o_orderdate")).alias("a"), (number(c("o_orderdate")) + 20).alias("b"))
    months = R.distinct(t("orders").select(F.trunc("o_orderdate", "month").alias("d")))
    x = months.select(number(c("d")).alias("x_a"), number(F.last_day("d")).alias("x_b"))
    return R.range_join(o, x, "a", "b", "x_a", "x_b", 32).select("o_orderkey", c("x_a").alias("month_day"))


@sql(f"WITH o AS ({_O}) SELECT x.o_orderkey AS k1, y.o_orderkey AS k2 FROM o x JOIN o y ON x.o_custkey = y.o_custkey AND x.a <= y.b AND y.a <= x.b AND x.o_orderkey < y.o_orderkey")
def ivl_overlap_join_keyed(t, spark, sf_dir):
    day = F.datediff(c("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("bigint")
    o = t("orders").select("o_orderkey", "o_custkey", day.alias("a"), (day + 20).alias("b"))
    p = o.select(c("o_orderkey").alias("k2"), "o_custkey", c("a").alias("a2"), c("b").alias("b2"))
    return R.range_join(o, p, "a", "b", "a2", "b2", 32, ["o_custkey"]).filter("o_orderkey < k2").select(c("o_orderkey").alias("k1"), "k2")


@sql("WITH vs AS (SELECT DISTINCT p_type AS code, p_brand AS system FROM part WHERE p_size > 45) SELECT p_partkey FROM part WHERE (p_type, p_brand) IN (SELECT code, system FROM vs)")
def clin_in_value_set(t, spark, sf_dir):
    vs = t("part").filter("p_size > 45").select(F.lit("vs").alias("valueset"), c("p_brand").alias("system"), c("p_type").alias("code"), c("p_type").alias("display"))
    return Terminology(vs).in_value_set(t("part"), c("p_type"), "vs", c("p_brand")).select("p_partkey")


@sql("WITH vs AS (SELECT DISTINCT p_type AS code FROM part WHERE p_size > 49) SELECT p_partkey, p_type IN (SELECT code FROM vs) AS r FROM part")
def clin_value_set_flag(t, spark, sf_dir):
    vs = t("part").filter("p_size > 49").select(F.lit("vs").alias("valueset"), c("p_brand").alias("system"), c("p_type").alias("code"), c("p_type").alias("display"))
    return Terminology(vs).flag_in_value_set(t("part"), c("p_type"), "vs", "r").select("p_partkey", "r")


@sql("WITH RECURSIVE r(k) AS (SELECT 1::BIGINT UNION SELECT (k * 3 + 1) % 101 FROM r) SELECT k FROM r")
def repeat_closure(t, spark, sf_dir):
    return R.repeat(spark.range(1, 2).withColumnRenamed("id", "k"), lambda df: df.select(((c("k") * 3 + 1) % 101).alias("k")))


@sql("SELECT c_custkey, c_name || '|' || c_mktsegment AS leaves FROM customer")
def descendants(t, spark, sf_dir):
    df = t("customer").withColumn("x", F.struct("c_name", F.struct("c_mktsegment").alias("s")))
    values = R.descendants(df.schema["x"].dataType, c("x"))
    return df.select("c_custkey", F.array_join(F.filter(values, lambda v: ~v.startswith("{")), "|").alias("leaves"))


# The same through the text of the language.

LIBRARY = """
library Example version '1.0'
using FHIR version '4.0.1'
codesystem "Brands": 'Brand#2'
valueset "Large": 'large'
code "Urgent": '1-URGENT' from "Brands" display 'Urgent'
parameter "Least" Decimal default 1000.0
context Unfiltered
define "HighValue": [Encounter] O without [Observation] L such that L.l_orderkey = O.o_orderkey and L.l_returnflag = 'R' where O.o_totalprice > "Least" return Tuple { o_orderkey: O.o_orderkey, year: year from O.o_orderdate }
define "Heavy": [Encounter] O with [Observation] L such that L.l_orderkey = O.o_orderkey and L.l_quantity > 45.0 return O.o_orderkey
define "Urgent orders": [Encounter: "Urgent"] O let age: difference in days between @1995-01-01 and O.o_orderdate where age between 100 and 400 return Tuple { o_orderkey: O.o_orderkey, age: age } sort by age desc, o_orderkey
define "Sizes": [Medication] M return distinct Tuple { p_type: M.p_type, large: M.p_size > 25 }
define "Flags": [Event] E return Tuple { event_id: E.event_id, flag: case when E.value > 50.0 then 'high' when E.value > 20.0 then 'mid' else 'low' end, hour: hour from E.ts }
define "In range": [Observation] L where L.l_shipdate in Interval[@1996-01-01T00:00:00.000, @1997-01-01T00:00:00.000) and L.l_quantity >= 40.0 return Tuple { l_orderkey: L.l_orderkey, l_linenumber: L.l_linenumber }
define "Total": [Event] E aggregate A starting 0: A + E.event_id
define "Pairs": from [nation] N, [region] R where N.n_regionkey = R.r_regionkey and R.r_name in { 'ASIA', 'EUROPE' } return Tuple { n: N.n_name, r: R.r_name }
context Patient
define "Orders": Count([Encounter])
define "Any urgent": exists ([Encounter] O where O.o_orderpriority = '1-URGENT')
"""


def _text(name: str, definition: str, text: str, rename: dict[str, str] | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from asclepia.plans.engine import Engine

        df = Engine(spark, test_tables(spark, sf_dir)).compile(LIBRARY).evaluate(definition)
        for a, b in (rename or {}).items():
            df = df.withColumnRenamed(a, b)
        return df

    QUERIES[name], ORACLES[name] = run, text


_text("cql_high_value_orders", "HighValue", "SELECT o_orderkey, year(o_orderdate)::INT AS year FROM orders WHERE o_totalprice > 1000 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
_text("cql_with", "Heavy", "SELECT o_orderkey AS k FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)", {"value": "k"})
_text("cql_let_code_sort", "Urgent orders", "SELECT o_orderkey, date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::INT AS age FROM orders WHERE o_orderpriority = '1-URGENT' AND date_diff('day', DATE '1995-01-01', o_orderdate::DATE) BETWEEN 100 AND 400")
_text("cql_return_distinct", "Sizes", "SELECT DISTINCT p_type, p_size > 25 AS large FROM part")
_text("cql_case", "Flags", "SELECT event_id, CASE WHEN value > 50 THEN 'high' WHEN value > 20 THEN 'mid' ELSE 'low' END AS flag, hour(ts)::INT AS hour FROM events")
_text("cql_interval_membership", "In range", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_quantity >= 40")
_text("cql_aggregate_clause", "Total", "SELECT sum(event_id)::BIGINT AS total FROM events", {"value": "total"})
_text("cql_multi_source", "Pairs", "SELECT n_name AS n, r_name AS r FROM nation, region WHERE n_regionkey = r_regionkey AND r_name IN ('ASIA', 'EUROPE')")
_text("cql_patient_count", "Orders", "SELECT c_custkey, count(o_orderkey)::INT AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey", {"_context": "c_custkey", "Orders": "orders"})
_text("cql_patient_exists", "Any urgent", "SELECT c_custkey, coalesce(bool_or(o_orderpriority = '1-URGENT'), false) AS urgent FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey", {"_context": "c_custkey", "Any urgent": "urgent"})
