"""Set operators, collapse, expand, range joins, closures and descendants on relations."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a`` with its duplicates, then the distinct rows of ``b`` that it lacks."""
    b = b.select(*a.columns)
    right = b.dropDuplicates().alias("r")
    left = a.alias("l")
    on = reduce(lambda x, y: x & y, [F.col(f"r.`{c}`").eqNullSafe(F.col(f"l.`{c}`")) for c in a.columns])
    return a.unionByName(right.join(left, on, "left_anti"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of both; nulls match."""
    return a.intersect(b.select(*a.columns))


def except_(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` that ``b`` lacks, duplicates kept."""
    left, right = a.alias("l"), b.select(*a.columns).alias("r")
    on = reduce(lambda x, y: x & y, [F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in a.columns])
    return left.join(right, on, "left_anti")


def distinct(a: DataFrame) -> DataFrame:
    return a.dropDuplicates()


def collapse(df: DataFrame, by: list[str], low: str = "low", high: str = "high", reach=None) -> DataFrame:
    """Closed intervals of each group merged where they overlap or are adjacent: gaps and islands by windows.

    ``reach(high)`` is the last low that still joins; without it intervals must overlap or touch. Rows with a null bound are left out.
    """
    rows = df.filter(F.col(low).isNotNull() & F.col(high).isNotNull()).select(*by, F.col(low).alias("low"), F.col(high).alias("high"))
    order = W.partitionBy(*by).orderBy("low", "high")
    before = F.max("high").over(order.rowsBetween(W.unboundedPreceding, -1))
    limit = before if reach is None else reach(before)
    marked = rows.withColumn("_new", F.when(limit.isNotNull() & (F.col("low") <= limit), 0).otherwise(1))
    islands = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return islands.groupBy(*by, "_island").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("_island")


def collapse_integers(df: DataFrame, by: list[str], low: str = "low", high: str = "high") -> DataFrame:
    return collapse(df, by, low, high, reach=lambda h: h + 1)


def expand(df: DataFrame, points: Column, name: str = "point") -> DataFrame:
    """A row for each point of an interval column expanded by functions.intervals.expand."""
    return df.withColumn(name, F.explode(points))


#: An interval is dealt to so many buckets at most; a longer one goes to buckets that are so many times wider, and one without an end to a single bucket.
SPAN, LEVELS = 32, 8


def _level(low: Column, high: Column, width: float) -> Column:
    """The first level whose buckets, width * SPAN ** level wide, an interval spans fewer than SPAN of; LEVELS if there is none or a bound is null."""
    out = None
    for k in range(LEVELS):
        size = F.lit(float(width) * SPAN**k)
        fits = F.floor(high / size) - F.floor(low / size) < SPAN
        out = F.when(fits, k) if out is None else out.when(fits, k)
    return out.otherwise(LEVELS).cast("int")


def _dealt(level: Column, low: Column, high: Column, width: float, others: list[int], own: list[int]) -> Column:
    """The (level, bucket)s of an interval: at its own level, and at each coarser one where the other side has intervals."""
    none = F.array().cast("array<struct<level:int,bucket:bigint>>")
    parts = [none]
    for k in range(LEVELS + 1):
        if k not in own and k not in others:
            continue
        here = level == k if k not in others else level <= k
        if k == LEVELS:
            buckets = F.array(F.struct(F.lit(k).alias("level"), F.lit(0).cast("bigint").alias("bucket")))
        else:
            size = F.lit(float(width) * SPAN**k)
            first, last = F.floor(F.coalesce(low, F.lit(0)) / size), F.floor(F.coalesce(high, F.lit(0)) / size)
            at_level = F.lit(k).alias("level")
            buckets = F.transform(F.sequence(first, F.least(F.greatest(first, last), first + SPAN)), lambda b: F.struct(at_level, b.cast("bigint").alias("bucket")))  # noqa: B023  used at once
        parts.append(F.when(here, buckets).otherwise(none))
    return F.concat(*parts)


#: Rows of one interval come together in arrays of about so many at most; a bucket that holds more pairs is dealt over a grid of parts.
ROWS, PAIRS = 1 << 16, 1 << 28


def range_join(a: DataFrame, b: DataFrame, a_low: str, a_high: str, b_low: str, b_high: str, width: float, on: list[str] | None = None) -> DataFrame:
    """Pairs of rows whose closed intervals overlap, on equal keys ``on`` if given. Bounds are numbers; a null bound doesn't limit, an interval
    whose bounds are the wrong way round overlaps nothing.

    Both sides are dealt to buckets of ``width``: an equi join instead of a nested loop. Intervals much longer than that are dealt to wider buckets, so that
    a row comes SPAN times at most and once or twice at each coarser level; a pair meets at the coarser level of the two only. Of the buckets that it shares there, the
    first one yields it, so that no pair comes twice. Choose ``width`` near the usual length of an interval.

    Joined are not rows but arrays of rows of one interval; their pairs are then unfolded, without a condition for each. Where there may be many pairs, the tasks of
    the join are as many as partitions of a shuffle, however few bytes they read, and a bucket with over PAIRS pairs is dealt over several of them.
    """
    spark, on = a.sparkSession, on or []
    same = [f"k{i}" for i in range(len(on))]
    sides = []
    for df, low, high in ((a, a_low, a_high), (b, b_low, b_high)):
        level = _level(F.col(low).cast("double"), F.col(high).cast("double"), width)
        right_way = df.filter(F.coalesce(F.col(low) <= F.col(high), F.lit(True)))
        hashed = F.xxhash64(F.spark_partition_id(), *[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind])
        whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)])
        sides.append(right_way.select(whole.alias("row"), hashed.alias("hash"), F.col(low).alias("low"), F.col(high).alias("high"), level.alias("level"), *[F.col(k).alias(n) for k, n in zip(on, same, strict=True)]))
    seen = reduce(DataFrame.union, [x.select(F.lit(i).alias("side"), "level") for i, x in enumerate(sides)]).groupBy("side", "level").count().collect()  # at most LEVELS + 1 for each side
    levels = [sorted(r.level for r in seen if r.side == i) for i in (0, 1)]
    counts = [sum(r["count"] for r in seen if r.side == i) for i in (0, 1)]
    many = counts[0] * counts[1] > PAIRS
    cell = [*same, "at"]

    def dealt(x: DataFrame, i: int) -> DataFrame:
        return x.withColumn("at", F.explode(_dealt(F.col("level"), F.col("low"), F.col("high"), width, levels[1 - i], levels[i])))

    interval = [*same, "level", "low", "high"]
    blocks = [-(-n // ROWS) or 1 for n in counts]
    parts = [dealt(x.groupBy(*interval, F.pmod("hash", F.lit(n)).cast("int").alias("block")).agg(F.collect_list("row").alias("rows")), i) for i, (x, n) in enumerate(zip(sides, blocks, strict=True))]
    if many:
        held = [dealt(x.groupBy(*interval).count(), i).groupBy(*cell).agg(F.sum("count").cast("double").alias(f"n{i}")) for i, x in enumerate(sides)]
        grid = F.least(F.ceil(F.sqrt(F.col("n0") * F.col("n1") / PAIRS)), F.lit(max(blocks))).cast("int")
        hot = F.broadcast(held[0].join(held[1], cell).filter(F.col("n0") * F.col("n1") > PAIRS).select(*cell, grid.alias("grid")))  # a row for every sqrt(PAIRS) dealt rows at most
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
        for i, (x, mine, other) in enumerate(zip(parts, ("p0", "p1"), ("p1", "p0"), strict=True)):
            size = F.coalesce("grid", F.lit(1))
            x = x.join(hot, cell, "left").withColumn(mine, F.pmod(F.col("block"), size)).withColumn(other, F.explode(F.sequence(F.lit(0), size - 1)))
            parts[i] = x.repartition(tasks, *cell, "p0", "p1")
        cell = [*cell, "p0", "p1"]
    size = F.lit(float(width)) * F.pow(F.lit(float(SPAN)), F.col("at.level"))
    first = F.when(F.col("at.level") < LEVELS, F.floor(F.coalesce(F.col("low"), F.lit(0)) / size)).otherwise(0)
    # A bucket's level is that of its interval or coarser, and its place the interval's first or later: the coarser level of two is one's own, the later first place one's first.
    left, right = (x.select(*cell, "low", "high", "rows", (F.col("at.level") == F.col("level")).alias("own"), (F.col("at.bucket") == first).alias("first")).alias(n) for x, n in zip(parts, ("l", "r"), strict=True))
    before = lambda x, y: F.coalesce(F.col(x) <= F.col(y), F.lit(True))
    keys = reduce(lambda x, y: x & y, [F.col(f"l.{k}") == F.col(f"r.{k}") for k in cell])
    found = left.join(right, keys & (F.col("l.own") | F.col("r.own")) & (F.col("l.first") | F.col("r.first")) & before("l.low", "r.high") & before("r.low", "l.high"))
    pairs = found.select(F.col("l.rows").alias("l"), F.col("r.rows").alias("r")).select(F.explode("l").alias("x"), "r").select("x", F.explode("r").alias("y"))
    taken = set(a.columns)
    return pairs.select(*[F.col(f"x.c{i}").alias(c) for i, c in enumerate(a.columns)], *[F.col(f"y.c{i}").alias(c) for i, c in enumerate(b.columns) if c not in taken])


def product(df: DataFrame, by: list[str], column: str, name: str = "product", kind: str = "bigint") -> DataFrame:
    """The exact product of a whole-number column in each group; null without values. One that doesn't fit ``kind`` raises.

    A product that fits has 63 factors other than 0, 1 and -1 at most: only those of groups without a zero and with no more of them come together in a row.
    """
    x = F.col(column).cast("bigint")
    big = F.abs(x) > 1
    sums = df.groupBy(*by).agg(F.count(x).alias("_n"), F.count_if(x == 0).alias("_zeros"), F.count_if(x < 0).alias("_negative"), F.count_if(big).alias("_big"))
    few = df.filter(big).groupBy(*by, F.abs(x).alias("_x")).agg(F.count(F.lit(1)).alias("_times"))
    some = sums.filter("_zeros = 0 AND _big BETWEEN 1 AND 63")
    same = lambda l, r: reduce(lambda p, q: p & q, [F.col(f"{l}.`{k}`").eqNullSafe(F.col(f"{r}.`{k}`")) for k in by], F.lit(True))
    few = few.alias("f").join(some.select(*by).alias("s"), same("f", "s"), "left_semi") if by else few.crossJoin(some.select("_big")).drop("_big")
    factors = few.groupBy(*by).agg(F.collect_list(F.struct("_x", "_times")).alias("_factors"))
    one = F.lit(1).cast("bigint")
    size = F.aggregate(F.flatten(F.transform("_factors", lambda f: F.array_repeat(f["_x"], f["_times"].cast("int")))), one, lambda t, v: t * v)
    value = F.when(F.col("_n") == 0, F.lit(None).cast("bigint")).when(F.col("_zeros") > 0, 0).when(F.col("_big") > 63, F.raise_error(F.lit("product overflow")).cast("bigint"))
    value = value.otherwise(F.coalesce(size, one) * F.when(F.col("_negative") % 2 == 1, -1).otherwise(1)).cast(kind)
    joined = sums.alias("s").join(factors.alias("f"), same("s", "f"), "left") if by else sums.alias("s").crossJoin(factors)
    return joined.select(*[F.col(f"s.`{k}`") for k in by], value.alias(name))


def repeat(seed: DataFrame, step, rounds: int = 1000) -> DataFrame:
    """Transitive closure: ``step`` (new rows to next rows) until nothing unseen comes. Nulls match; the seed is kept.

    Each round's new rows are written to spark.checkpoint.dir, so that the plan stays short, no round is computed again, and lost executors cost one round.
    Where that setting is absent, a Spark that runs in one process uses a local folder; on a cluster it is an error.
    """
    sc = seed.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        where = seed.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not where and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="asclepia-rounds-"))
    cut = lambda d: d.checkpoint()
    seen, new = seed, seed
    for _ in range(rounds):
        found = step(new).select(*seed.columns).dropDuplicates()
        new = cut(except_(found, seen))
        if not new.limit(1).count():
            return seen
        seen = seen.unionByName(new)
    raise RecursionError(f"no end after {rounds} rounds")


def descendants(schema: T.DataType, column: Column) -> Column:
    """All values nested in a column, depth first, as strings; null gives an empty list."""

    def walk(kind: T.DataType, c: Column) -> Column:
        if isinstance(kind, T.StructType):
            parts = [x for f in kind.fields for x in (own(f.dataType, c.getField(f.name)), walk(f.dataType, c.getField(f.name)))]
            return F.concat(*parts) if parts else none()
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.flatten(F.transform(c, lambda x: F.concat(own(kind.elementType, x), walk(kind.elementType, x)))), none())
        return none()

    def none() -> Column:
        return F.array().cast("array<string>")

    def own(kind: T.DataType, c: Column) -> Column:
        nested = isinstance(kind, (T.StructType, T.ArrayType, T.MapType))
        return F.when(c.isNull(), none()).otherwise(F.array(F.to_json(c) if nested else c.cast("string")))

    return walk(schema, column)


def best_per(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The row of each group that comes first in an order; partial rankings before the shuffle keep one row of a group per task."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def last_per(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The last row of each group in an order: the as-of idiom."""
    w = W.partitionBy(*by).orderBy(*[c.desc_nulls_last() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def first_per(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    w = W.partitionBy(*by).orderBy(*[c.asc_nulls_first() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def in_context(population: DataFrame, rows: DataFrame, key: str, **aggregates: tuple[Column, object]) -> DataFrame:
    """One row per member of a population: each aggregate over its rows, or the given value where it has none."""
    found = rows.groupBy(key).agg(*[c.alias(n) for n, (c, _) in aggregates.items()])
    out = population.select(key).join(found, key, "left")
    return out.select(key, *[F.coalesce(F.col(n), F.lit(v)).alias(n) if v is not None else F.col(n) for n, (_, v) in aggregates.items()])
