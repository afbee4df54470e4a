"""Exact dedup by a stateful stream.

Every row becomes a slim event (digest, stable identifier, content locator) in an inbox folder. A streaming aggregation
keeps, in a RocksDB store on the executors' disks and without expiry, one state row per digest: how often it came, the
largest identifier and the locator of its content. Map-side partial aggregation folds a hot group's events before the
shuffle, so that no task sees more than one row of a group from each map task. On hits, that is digests that came more than
once, the full bytes are checked: rows of hit digests are grouped by digest *and* content, so that two contents with
one digest come apart and are then grouped by content alone.

A further batch of documents can be added to the same inbox and checkpoint; the state then also remembers what came before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asclepia.llm._base import at_rest, delete, dropped, fresh, joined, located, shared_dir, small_side, with_place, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: F.Column) -> F.Column:
    """A-Z to lower case, nothing else; null as empty. lower() has a fast path and is the same where all is ASCII."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


class DedupState:
    """The keyed state: an inbox folder for events and the checkpoint of the query that folds them."""

    def __init__(self, spark: SparkSession, folder: str | None = None, files_per_trigger: int | None = None) -> None:
        self.folder = folder = folder or shared_dir(spark, "dedup-state")
        self.spark, self.inbox, self.checkpoint, self.per_trigger = spark, f"{folder}/inbox", f"{folder}/checkpoint", files_per_trigger
        self.session = spark.newSession()  # the streaming settings stay out of the caller's session
        for key, value in {
            "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
            "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
            "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
            "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
            "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
            "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        }.items():
            self.session.conf.set(key, value)

    def add(self, events: DataFrame) -> None:
        """Appends events (digest, id, _file, _row, ...) and runs the stream over whatever is new."""
        events.write.mode("append").option("compression", "zstd").parquet(self.inbox)
        stream = self.session.readStream.schema(events.schema)
        if self.per_trigger:
            stream = stream.option("maxFilesPerTrigger", self.per_trigger)
        folded = stream.parquet(self.inbox).groupBy("digest").agg(
            F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "_file", "_row")).alias("head")
        )
        query = (
            folded.writeStream.outputMode("update").format("noop")
            .option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()

    def events(self) -> DataFrame:
        return self.spark.read.parquet(self.inbox)

    def groups(self) -> DataFrame:
        """The state as it is now: digest, n, head (id, _file, _row of the row that stays)."""
        state = self.session.read.format("statestore").load(self.checkpoint)
        n, head = state.schema["value"].dataType.names
        return state.select(F.col("key.digest").alias("digest"), F.col(f"value.{n}").alias("n"), F.col(f"value.{head}").alias("head"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bytes: int = 32, files_per_trigger: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, and its place (_file, _row).

    Texts are equal when identical after lower-casing A-Z. Of a group the largest id stays; a null id is smallest, and
    of repeated rows with the same id one stays, the one with the greatest place. Null text counts as empty, an empty
    table gives no rows, other columns are not looked at. ``key_bytes`` shortens the state's digest (for tests of
    collisions: results stay exact with any value).
    """
    spark, docs = docs.sparkSession, at_rest(docs)
    sha = F.unhex(F.sha2(normalised(F.col(text_col)), 256))
    rows = located(docs, {"id": F.col(id_col), "sha": sha})
    rows = rows.select(F.substring("sha", 1, key_bytes).alias("digest"), "id", "sha", "_file", "_row")
    state = DedupState(spark, files_per_trigger=files_per_trigger)
    state.add(rows)
    events = state.events()
    hits = written(state.groups().filter("n > 1"), "dedup-hits")
    grouped = joined(events, hits, "digest", "n", events.count(), "left")
    grouped = written(grouped.select(
        "digest", "id", "sha", "_file", "_row", F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("head", F.struct("id", "_file", "_row")).alias("head"),
    ), "dedup-rows")

    # Full bytes on hits: equal digests with different contents show as two groups of the same digest. The rows whose
    # bytes are read again are found by their content locator.
    hit_rows = written(grouped.filter("n > 1").select(F.xxhash64("_file", "_row").alias("place")), "dedup-hit-rows")
    full = located(docs, {"id": F.col(id_col), "text": F.col(text_col)}).withColumn("place", F.xxhash64("_file", "_row"))
    full = full.join(small_side(hit_rows, hit_rows.count()), "place", "left_semi")
    full = full.select("id", "_file", "_row", normalised(F.col("text")).alias("content"))
    full = full.withColumn("sha", F.unhex(F.sha2("content", 256))).withColumn("digest", F.substring("sha", 1, key_bytes))
    contents = full.groupBy("digest", "content").agg(F.count(F.lit(1)).alias("n"))
    collided = contents.groupBy("digest").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1").select("digest")
    collided = written(collided, "dedup-collided")
    n_collided = collided.count()
    plain = grouped
    if n_collided:
        mixed = full.join(small_side(collided, n_collided), "digest", "left_semi")
        true_groups = mixed.groupBy("digest", "content").agg(
            F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "_file", "_row")).alias("head")
        )
        split = mixed.join(true_groups, ["digest", "content"]).select("digest", "id", "sha", "_file", "_row", "n", "head")
        plain = written(grouped.join(small_side(collided, n_collided), "digest", "left_anti").unionByName(split), "dedup-rows")
        dropped(grouped)
    dropped(hits, hit_rows, collided)
    delete(spark, state.folder)
    return plain.select(
        F.col("id").alias(id_col), F.col("head.id").alias("keep_id"), F.col("n").cast("long").alias("group_size"),
        ((F.col("head._file") == F.col("_file")) & (F.col("head._row") == F.col("_row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), "_file", "_row",
    )


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows at the places in ``gone`` (_file, _row); ``docs`` must be a file scan (at_rest)."""
    at, file, row = with_place(docs)
    gone_file, gone_row = fresh(at, "_gone_file", "_gone_row")
    gone = written(gone.select(F.col("_file").alias(gone_file), F.col("_row").alias(gone_row)), "gone")
    same = (F.col(file) == F.col(gone_file)) & (F.col(row) == F.col(gone_row))
    return at.join(small_side(gone, gone.count()), same, "left_anti").drop(file, row)


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were."""
    docs = at_rest(docs)
    return without_rows(docs, exact_dedup(docs, id_col, text_col).filter("NOT kept"))


__all__ = ["DedupState", "exact_dedup", "kept_documents", "normalised", "without_rows"]
