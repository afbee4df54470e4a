"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

A source's target is a share of all words; a document of the source is wanted target / source_size times. The whole part
of that is taken as it is; the fraction is rounded dependently: two documents are paired, words move at random from one
to the other (each keeps its expected number of copies) until one of them has a whole number of copies, and
the other one goes on to the next pair. The words taken therefore stay equal to the target up to the last document left over.

Pairs are made inside blocks of about ``BLOCK`` documents of a source, dealt by a hash, largest documents first so that
what is left of a block is small. What each block leaves over is one row of the next level, blocked in the same way: a
reduction tree with as many levels as the largest source needs, each 1/BLOCK of the one below. A hot source
has more blocks, not larger ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from asclepia.llm._base import at_rest, fresh, joined, located, small_side, with_place, written

BLOCK = 128
#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: No source, and so no document, is taken more often than this.
MOST = 3
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """How many runs of other than space, tab, LF, VT, FF and CR; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(sizes: DataFrame) -> DataFrame:
    """``sizes`` with rank, the place of its source in code-point order from 0 on, null last: sorted in ranges, no task has all."""
    last = F.col("source").asc_nulls_last()
    ordered = sizes.repartitionByRange(last).sortWithinPartitions(last)
    rows = written(ordered.withColumn("_at", F.monotonically_increasing_id()), "mix-ordered")
    part = F.shiftright("_at", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # one row per range
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_before"))
    ranked = rows.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return ranked.withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_before")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds target to one row per source (source, source_size): the weights' shares of all words, none above
    ``most`` times its source, the excess shared again by weight until none is above.

    A source is capped if its weight's share at the level that the others get is above its cap. The level rises as sources are capped; each
    round is one aggregation, until no more are. Caps and weights are whole numbers, so sums don't depend on their order.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = _ranked(sizes.select("source", "source_size")).withColumn("weight", weight).withColumn("cap", (F.col("source_size") * most).cast("double"))
    total, left = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast("double"), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    level = 0.0
    while left:
        now = F.col("cap") <= F.lit(level) * F.col("weight")
        capped, left = rows.agg(F.coalesce(F.sum(F.when(now, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~now, F.col("weight"))), F.lit(0.0))).first()
        if not left or (total - capped) / left <= level:
            break
        level = (total - capped) / left
    share = F.least("cap", F.lit(level) * F.col("weight")) if left else F.col("cap")
    return rows.select("source", "source_size", share.alias("target"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: a lambda over an array of one."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pair(acc: Column, x: Column) -> Column:
    """One step of a block's fold: ``acc`` is (done, carry); the carried document and ``x`` are rounded against each other."""
    fields = ("id", "_file", "_row", "key", "source", "size", "source_size", "target", "whole", "u")

    def item(e: Column, p: Column) -> Column:
        return F.struct(*[e[f].alias(f) for f in fields], p.alias("p"))

    def step(v: Column) -> Column:
        c, up, top, bottom = v["c"], v["up"], v["top"], v["bottom"]
        cp, xp, cs, xs = c["p"], x["p"], c["size"], x["size"]
        # up: the carried one gains. It is whole if what it lacks is no more than what x has; otherwise x is empty.
        c_done = F.when(up, (1 - cp) * cs <= xp * xs).otherwise(cp * cs <= (1 - xp) * xs)
        c_new = F.when(c_done, F.when(up, 1.0).otherwise(0.0)).otherwise(F.when(up, cp + top / cs).otherwise(cp - bottom / cs))
        x_new = F.when(~c_done, F.when(up, 0.0).otherwise(1.0)).otherwise(F.when(up, xp - top / xs).otherwise(xp + bottom / xs))
        done = F.when(c_done, item(c, c_new)).otherwise(item(x, x_new))
        left = F.when(c_done, item(x, x_new)).otherwise(item(c, c_new))
        return F.struct(F.concat(acc["done"], F.array(done)).alias("done"), left.alias("carry"))

    c = acc["carry"]
    moved = F.struct(
        c.alias("c"),
        F.least((1 - c["p"]) * c["size"], x["p"] * x["size"]).alias("top"),
        F.least(c["p"] * c["size"], (1 - x["p"]) * x["size"]).alias("bottom"),
    )
    with_side = _let(moved, lambda m: F.struct(
        m["c"].alias("c"), m["top"].alias("top"), m["bottom"].alias("bottom"),
        (x["u"] * (m["top"] + m["bottom"]) < m["bottom"]).alias("up"),
    ))
    started = F.struct(acc["done"].alias("done"), item(x, x["p"]).alias("carry"))
    return F.when(c.isNull(), started).otherwise(_let(with_side, step))


ITEM = "struct<id:bigint,_file:string,_row:bigint,key:bigint,source:string,size:bigint,source_size:bigint,target:double,whole:bigint,u:double,p:double>"


def _level(items: DataFrame, level: int, seed: int) -> DataFrame:
    """One level of the tree: items (ITEM's fields and block) to one row per block, done and carry."""
    u = F.pmod(F.xxhash64("key", F.lit(seed), F.lit(level)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    ordered = F.struct((-F.col("size")).alias("_o"), F.xxhash64("key", F.lit(seed + 1)).alias("_h"), *[
        (u if f == "u" else F.col(f)).alias(f) for f in ("id", "_file", "_row", "key", "source", "size", "source_size", "target", "whole", "u", "p")
    ])
    blocks = items.groupBy("source", "block").agg(F.sort_array(F.collect_list(ordered)).alias("items"), F.first("blocks").alias("blocks"))
    start = F.expr(f"named_struct('done', cast(array() as array<{ITEM}>), 'carry', cast(null as {ITEM}))")
    return blocks.select("source", "blocks", F.aggregate("items", start, _pair).alias("fold"))


def _blocks(n: Column) -> Column:
    return F.ceil(n / F.lit(BLOCK)).cast("long")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 7,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target (its source's), taken (words), copies, _file, _row.

    copies is target / source_size rounded down or up, so no document exceeds ``most`` times its size. The randomness is a
    hash of id, text and ``seed``: reruns agree, whatever the files (rows that repeat id and text, and null ids, are told apart by their place). Null text has size 0 and is never taken; a null source is a source of its own,
    the last; an empty table gives no rows; repeated rows are decided each for itself; other columns are not looked at.
    """
    docs = at_rest(docs)
    # What randomness comes from: id and text, so that the same documents in other files or order are decided alike.
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    base = written(located(docs, {"id": F.col(id_col), "source": F.col(source_col), "size": words(F.col(text_col)), "key": key}), "mix-sizes")
    # Only rows that repeat id and text, or have no id, are told apart by their place; otherwise they would all be in one block.
    again = written(base.filter("id IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("_again")).filter("_again > 1"), "mix-repeats")
    if again.limit(1).count():
        base = joined(base, again, "key", "_again", base.count(), "left")
    else:
        base = base.withColumn("_again", F.lit(None).cast("long"))
    own = F.when(F.col("_again").isNull() & F.col("id").isNotNull(), F.col("key")).otherwise(F.xxhash64("key", "_file", "_row"))
    base = base.withColumn("key", own).drop("_again")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    sizes = written(sizes, "mix-sources")
    goals = targets(sizes.select("source", "source_size"), weights, most)
    per_source = goals.join(sizes.select(F.col("source").alias("_s"), "docs"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    n_sources, most_docs = sizes.agg(F.count(F.lit(1)), F.coalesce(F.max("docs"), F.lit(0))).first()
    per_source = small_side(written(per_source, "mix-targets").withColumnRenamed("source", "_s"), n_sources)
    rows = base.join(per_source, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("rate", F.least(rate, F.lit(float(most)))).withColumn("whole", F.floor("rate").cast("long"))
    rows = rows.withColumn("p", F.when(F.col("size") > 0, F.col("rate") - F.col("whole")).otherwise(F.lit(0.0)))
    fixed = rows.filter("p <= 0").withColumn("copies", F.when(F.col("size") > 0, F.col("whole")).otherwise(F.lit(0)))
    open_ = rows.filter("p > 0").withColumn("blocks", _blocks(F.col("docs")))

    def dealt(df: DataFrame, level: int) -> DataFrame:
        return df.withColumn("block", F.pmod(F.xxhash64("key", F.lit(seed), F.lit(level + 1000)), F.col("blocks")))

    out, level, most_blocks = [fixed], 0, -(-most_docs // BLOCK)
    while True:
        folded = written(_level(dealt(open_, level), level, seed), f"mix-level-{level}")
        done = folded.select(F.explode("fold.done").alias("e")).select("e.*")
        out.append(done.withColumn("copies", F.col("whole") + F.col("p").cast("long")))
        left = folded.filter("fold.carry IS NOT NULL").select("fold.carry.*", _blocks(F.col("blocks")).alias("blocks"))
        if most_blocks <= 1:
            break
        open_, level, most_blocks = left, level + 1, -(-most_blocks // BLOCK)
    out.append(left.withColumn("copies", F.col("whole") + (F.col("p") >= 0.5).cast("long")))
    columns = ["id", "size", "source_size", "target", "copies", "_file", "_row"]
    return reduce(DataFrame.unionByName, [x.select(*columns) for x in out]).select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "_file", "_row"
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: rows not taken are gone, rows taken k times come k times, all columns as they were."""
    docs = at_rest(docs)
    at, file, row = with_place(docs)
    mix_file, mix_row, mix_copies, mix_copy = fresh(at, "_mix_file", "_mix_row", "_mix_copies", "_mix_copy")
    copies = mix(docs, **options).filter("copies > 0").select(F.col("_file").alias(mix_file), F.col("_row").alias(mix_row), F.col("copies").cast("int").alias(mix_copies))
    taken = at.join(copies, (F.col(file) == F.col(mix_file)) & (F.col(row) == F.col(mix_row)))
    taken = taken.withColumn(mix_copy, F.explode(F.sequence(F.lit(1), F.col(mix_copies))))
    return taken.drop(file, row, mix_file, mix_row, mix_copies, mix_copy)
