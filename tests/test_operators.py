"""Edge cases of the operators: nulls, empties, ties, overflow."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from asclepia.functions import arithmetic as A
from asclepia.functions import intervals as I
from asclepia.functions import lists as L
from asclepia.functions import temporal as T
from asclepia.operators import relations as R
from asclepia.operators.query import Query, singleton
from asclepia.sources import catalog
from asclepia.sources.terminology import Terminology
from asclepia import streaming


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()[0]


def test_overflow_raises(spark):
    with pytest.raises(Exception, match="OVERFLOW"):
        one(spark, A.add(F.lit(2147483647) + F.col("id").cast("int"), F.lit(1)))


def test_interval_null_bounds(spark):
    i = I.interval(F.lit(None).cast("int"), F.lit(5))
    assert one(spark, I.contains(i, F.lit(-100))) is True
    assert one(spark, I.contains(F.lit(None).cast("struct<low:int,high:int,lowClosed:boolean,highClosed:boolean>"), F.lit(1))) is False
    assert one(spark, I.before(i, I.interval(F.lit(6), F.lit(None).cast("int")))) is True
    assert one(spark, I.after(i, I.interval(F.lit(6), F.lit(None).cast("int")))) is None


def test_list_nulls(spark):
    a = F.array(F.lit(1), F.lit(None).cast("int"))
    assert one(spark, L.contains(a, F.lit(None).cast("int"))) is True
    assert one(spark, L.sum_(F.array(F.lit(None).cast("int")))) is None
    assert one(spark, L.mode(F.array(*[F.lit(x) for x in (3, 1, 3, 1)]))) == 1


def test_duration_descending(spark):
    d = lambda s: F.lit(s).cast("date")
    assert one(spark, T.duration_between(d("2020-06-01"), d("2019-03-01"), "year")) == -1
    assert one(spark, T.duration_between(d("2020-01-31"), d("2020-02-29"), "month")) == 0


def test_set_operators_nulls(spark):
    a = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    b = spark.createDataFrame([(None,), (2,), (2,)], "k int")
    key = lambda df: sorted((r[0] is None, r[0] or 0) for r in df.collect())
    assert key(R.union(a, b)) == [(False, 1), (False, 1), (False, 2), (True, 0)]
    assert key(R.except_(a, b)) == [(False, 1), (False, 1)]
    assert key(R.intersect(a, b)) == [(True, 0)]


def test_without_keeps_null_keys(spark):
    a = spark.createDataFrame([(1,), (None,)], "k int")
    b = spark.createDataFrame([(1,)], "k int")
    assert Query(a, "A").without(b, "B", lambda q: q.A.k == q.B.k).dataframe().collect()[0][0] is None
    assert Query(a, "A").without(b.limit(0), "B").dataframe().count() == 2


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "g int, low int, high int")
    assert R.collapse_integers(empty, ["g"]).count() == 0
    assert R.range_join(empty, empty, "low", "high", "low", "high", 4).count() == 0


def test_range_join_once(spark):
    a = spark.createDataFrame([(1, 0, 100), (2, 5, 5)], "a int, low int, high int")
    b = spark.createDataFrame([(1, 0, 100), (2, 101, 102)], "b int, lo int, hi int")
    got = sorted(tuple(r) for r in R.range_join(a, b, "low", "high", "lo", "hi", 10).select("a", "b").collect())
    assert got == [(1, 1), (2, 1)]


def test_repeat_ends(spark):
    seed = spark.createDataFrame([(0,)], "k int")
    assert R.repeat(seed, lambda d: d.select(((F.col("k") + 1) % 5).alias("k"))).count() == 5
    with pytest.raises(RecursionError):
        R.repeat(seed, lambda d: d.select((F.col("k") + 1).alias("k")), rounds=3)


def test_singleton(spark):
    assert singleton(spark.range(0)) is None
    with pytest.raises(ValueError):
        singleton(spark.range(2))


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, s string")
    for kind in ("parquet", "json", "orc"):
        catalog.write(df, f"{tmp_path}/x.{kind}", kind)
        assert [tuple(r) for r in catalog.Catalog(spark).add("X", f"{tmp_path}/x.{kind}", df.schema).retrieve("X").collect()] == [(1, "a")]
    with pytest.raises(KeyError):
        catalog.Catalog(spark).retrieve("Y")


def test_terminology(spark):
    t = Terminology(spark.createDataFrame([("v", "s", "a", "A"), ("v", "s2", "b", "B")], "valueset string, system string, code string, display string"))
    df = spark.createDataFrame([("a", "s"), ("b", "s"), (None, "s")], "c string, y string")
    assert t.in_value_set(df, F.col("c"), "v", F.col("y")).count() == 1
    assert t.in_value_set(df, F.col("c"), "v").count() == 2
    assert [r.f for r in t.flag_in_value_set(df, F.col("c"), "v", "f", F.col("y")).orderBy(F.col("c").asc_nulls_last()).collect()] == [True, False, None]
    assert t.expand("none").count() == 0


def test_streaming(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:05:00"), (1, "2024-01-01 05:00:00")], "u int, s string").select("u", F.to_timestamp("s").alias("ts")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("u int, ts timestamp").parquet(f"{tmp_path}/in")
    streaming.run(Query(stream, "E").where(lambda q: F.hour(q.E.ts) < 1).dataframe(), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    assert streaming.collapse(stream, ["u"], "ts", "10 minutes", "1 hour").isStreaming


def test_predicates_reach_the_scan(spark):
    df = catalog.test_tables(spark, "/root/testdata/sf0.001").retrieve("Encounter", codes=["1-URGENT"]).select("o_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderpriority), EqualTo(o_orderpriority,1-URGENT)]" in plan and "o_totalprice" not in plan.split("ReadSchema")[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_range_join_of_whole_tables(spark):
    """Every order's interval against every order's, and the registered join of whole tables, by brute force."""
    from asclepia.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    days = [(r.o_orderkey, r.day) for r in spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey", "datediff(o_orderdate, date'1970-01-01') day").collect()]
    o = spark.createDataFrame([(k, d, d + 20) for k, d in days], "k long, a long, b long")
    got = R.range_join(o, o.toDF("k2", "a2", "b2"), "a", "b", "a2", "b2", 32).select("k", "k2").collect()
    assert sorted(map(tuple, got)) == sorted((k, k2) for k, d in days for k2, d2 in days if abs(d - d2) <= 20)
    months = [(m - timedelta(m.day - 1), m) for m in {date(1970, 1, 1) + timedelta(d) for _, d in days}]
    months = {low: (low + timedelta(31)).replace(day=1) - timedelta(1) for low, _ in months}
    number = lambda d: (d - date(1970, 1, 1)).days
    want = sorted((k, number(low)) for k, d in days for low, high in months.items() if d <= number(high) and number(low) <= d + 20)
    assert {k for k, _ in want} == {k for k, _ in days}
    assert sorted(map(tuple, QUERIES["ivl_overlap_join_months"](spark, sf).select("o_orderkey", "month_day").collect())) == want


def test_range_join_by_brute_force(spark):
    """Points, long intervals, null bounds, bounds the wrong way round, keys, clashing names; a row is dealt to a bounded number of buckets."""
    rnd = random.Random(2)
    bound = lambda: rnd.choice([None, rnd.randrange(50), rnd.randrange(100_000), -rnd.randrange(10**9)])
    a, b = ([(i, rnd.randrange(3), *rnd.choice([(x := rnd.randrange(3_000), x + rnd.randrange(9)), (bound(), bound())])) for i in range(150)] for _ in range(2))
    left, right = spark.createDataFrame(a, "i int, k int, _own int, hi int"), spark.createDataFrame(b, "j int, k int, lo int, _at int")
    overlap = lambda p, q: all(x is None or y is None or x <= y for x, y in ((p[2], q[3]), (q[2], p[3]), (p[2], p[3]), (q[2], q[3])))
    for width in (3, 700):
        got = R.range_join(left, right, "_own", "hi", "lo", "_at", width).select("i", "j").collect()
        assert sorted(map(tuple, got)) == sorted((p[0], q[0]) for p in a for q in b if overlap(p, q))
    keyed = R.range_join(left, right, "_own", "hi", "lo", "_at", 3, ["k"])
    assert sorted((r.i, r.j) for r in keyed.collect()) == sorted((p[0], q[0]) for p in a for q in b if p[1] == q[1] and overlap(p, q))
    long = spark.createDataFrame([(0, 10**9)], "lo long, hi long")
    assert len(long.select(R._dealt(R._level(F.col("lo"), F.col("hi"), 1), F.col("lo"), F.col("hi"), 1, [0], list(range(R.LEVELS))).alias("x")).first().x) <= R.SPAN + 2


def test_range_join_of_many_rows_of_one_interval(spark, monkeypatch):
    """Rows of one interval are joined as arrays, and a hot bucket's pairs come from a grid of parts: none is lost or comes twice, repeated rows count."""
    monkeypatch.setattr(R, "ROWS", 8)
    monkeypatch.setattr(R, "PAIRS", 50)
    rnd = random.Random(3)
    a, b = ([(i // 2, i % 2, 10, 11) for i in range(60)] * 2 + [(100 + i, i % 2, rnd.choice([None, rnd.randrange(20)]), rnd.choice([None, 20 + rnd.randrange(3_000)])) for i in range(20)] for _ in range(2))
    left, right = spark.createDataFrame(a, "i int, k int, lo int, hi int"), spark.createDataFrame(b, "j int, k int, lo int, hi int")
    overlap = lambda p, q: all(x is None or y is None or x <= y for x, y in ((p[2], q[3]), (q[2], p[3])))
    for on in (None, ["k"]):
        joined = R.range_join(left, right, "lo", "hi", "lo", "hi", 2, on)
        assert joined.columns == ["i", "k", "lo", "hi", "j"]
        got = sorted((r.i, r.j) for r in joined.collect())
        assert got == sorted((p[0], q[0]) for p in a for q in b if overlap(p, q) and (on is None or p[1] == q[1]))
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")


def test_expand_evaluates_its_interval_once(spark):
    """However many points an interval has, its bounds are evaluated once: the plan names the interval's check once, in queries of the language too."""
    from asclepia.queries import QUERIES

    i = I.interval(F.col("id").cast("int"), F.col("id").cast("int") + 3)
    df = spark.range(3).select(I.expand(i).alias("v"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("invalid interval") <= 1
    assert [r.v for r in df.orderBy("v").collect()] == [[k, k + 1, k + 2, k + 3] for k in range(3)]
    plan = QUERIES["ivl_expand_units"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("invalid interval") <= 10


def test_expand_makes_whole_numbers_by_a_sequence(spark):
    """No function runs for each whole number; at the types' ends nothing overflows, and a null bound or a step that isn't above 0 gives null."""
    rows = [(2147483640, 2147483647, 3), (-2147483648, -2147483645, 2), (5, 5, 9), (5, 6, 9), (None, 3, 1), (1, None, 1), (1, 3, 0), (1, 3, -1), (1, 3, None)]
    df = spark.createDataFrame(rows, "low int, high int, step int").select("low", "high", "step", I.expand(I.interval(F.col("low"), F.col("high")), F.col("step")).alias("v"))
    got = [r.v for r in df.collect()]
    assert got == [[2147483640, 2147483643], [-2147483648, -2147483646], [], [], None, None, None, None, None]
    assert dict(df.dtypes)["v"] == "array<int>"
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(cast(" in plan and "sequence(0" not in plan


def test_collapse_copies_only_ended_intervals(spark):
    """Growing an interval copies no list: neither the plan's step nor its result looks at the last element of a list; empty and null lists, nulls, open bounds."""
    kind = "struct<low:int,high:int,lowClosed:boolean,highClosed:boolean>"
    of = lambda *pairs: [None if p is None else (*p, True, True) for p in pairs]
    cases = [(0, []), (1, None), (2, of(None)), (3, of((5, 9), None, (1, 4), (20, 30), (11, 12))), (4, of((1, None), (5, 9))), (5, of((None, 3), (9, 9))), (6, of((2147483647, 2147483647), (1, 2147483647)))]
    df = spark.createDataFrame(cases, f"n int, xs array<{kind}>").select("n", I.collapse(F.col("xs")).alias("v"), I.collapse_per(F.filter("xs", lambda x: x["high"] < 1000), F.lit(2), "Integer").alias("per"))
    got = {r.n: (r.v and [(x.low, x.high) for x in r.v], r.per and [(x.low, x.high) for x in r.per]) for r in df.collect()}
    assert got == {0: ([], []), 1: (None, None), 2: ([], []), 3: ([(1, 9), (11, 12), (20, 30)], [(1, 12), (20, 30)]), 4: ([(1, None)], [(5, 9)]), 5: ([(None, 3), (9, 9)], [(None, 3), (9, 9)]), 6: ([(1, 2147483647)], [])}
    assert "element_at" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_product(spark):
    rows = [("a", 3), ("a", -4), ("a", None), ("b", 0), ("b", 10**9), ("b", 10**18), ("c", None), (None, 1), (None, -1), ("d", 2)] + [("e", 2)] * 62 + [("f", 1)] * 1_000 + [("z", 0)] + [("z", 5)] * 100
    got = {r.k: r["product"] for r in R.product(spark.createDataFrame(rows, "k string, x long"), ["k"], "x").collect()}
    assert got == {"a": -12, "b": 0, "c": None, None: -1, "d": 2, "e": 1 << 62, "f": 1, "z": 0}
    assert R.product(spark.createDataFrame([(5,), (7,)], "x int"), [], "x").first()[0] == 35
    assert R.product(spark.createDataFrame([], "x int"), [], "x").first()[0] is None
    for wrong in ([(2,)] * 64, [(10**10,), (10**10,)]):
        with pytest.raises(Exception, match="(?i)overflow"):
            R.product(spark.createDataFrame(wrong, "x long"), [], "x").collect()


def test_displays_by_system(spark):
    t = Terminology(spark.createDataFrame([("v", "s", "a", "one"), ("v", "t", "a", "two")], "valueset string, system string, code string, display string"))
    df = spark.createDataFrame([("a", "s"), ("a", "t"), ("a", None), ("b", "s")], "c string, y string")
    got = {(r.c, r.y): r.display for r in t.with_display(df, F.col("c"), system=F.col("y")).collect()}
    assert got == {("a", "s"): "one", ("a", "t"): "two", ("a", None): None, ("b", "s"): None}
    assert {r.display for r in t.with_display(df, F.col("c")).collect()} == {"one", None}


def test_other_queries_without_the_training_data_operators(tmp_path):
    """The entry point works where those folders are gone, and where a folder of that name can't be imported."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "asclepia", tmp_path / "asclepia", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    count = [sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'q_with' in e.oracle_sql())"]
    for _ in range(2):
        out = subprocess.run(count, cwd=tmp_path, capture_output=True, text=True, timeout=120)
        assert out.returncode == 0 and int(out.stdout.split()[0]) > 250 and out.stdout.split()[1] == "True", out.stderr
        (tmp_path / "asclepia/llm/__pycache__").mkdir(parents=True, exist_ok=True)
