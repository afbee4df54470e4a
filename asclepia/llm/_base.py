"""Shared plumbing of the training-data operators: the folder that all machines share, row locators, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast on purpose only up to this many counted keys (about 16 MB as a hash relation).
MAX_BROADCAST_KEYS = 200_000
#: A key is hot if it has 1 / HOT of the rows or more; one with fewer rows than LUKEWARM never is.
HOT, LUKEWARM = 1_000, 1_000
#: Rows and bytes of one Arrow batch; documents can be long, so the default of 10,000 rows is too many.
ARROW_ROWS, ARROW_BYTES = 1_000, 8 << 20


def conf(spark: SparkSession, key: str, default: str | None = None) -> str | None:
    return spark.conf.get(key, None) or spark.sparkContext.getConf().get(key, default)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, the one that driver and executors share.

    Where that setting is absent, a Spark that runs in one process (tests, a laptop) gets a local folder, remembered in the
    session; on a cluster that is an error, since no machine could read what another one wrote.
    """
    base = conf(spark, "spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master or ""
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="asclepia-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, survives lost executors, gives Catalyst true sizes."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path  # for dropped()
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by :func:`written` that no returned frame reads."""
    for df in tables:
        delete(df.sparkSession, df._shared_path)


def trimmed(spark: SparkSession) -> None:
    """Lets the executors' JVMs return memory that earlier work left free: a heap once grown stays so until a full collection."""
    n = max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


#: What a plan may consist of for a row of its one file scan to come at most once, under its place.
_PLAIN = {"LogicalRelation", "SubqueryAlias", "Project", "Filter"}


def _plain_scan(docs: DataFrame) -> bool:
    plan = docs._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.nodeName() in _PLAIN and plan.children().size() == 1:
        plan = plan.children().apply(0)
    if plan.nodeName() not in _PLAIN or plan.children().size() or not plan.metadataOutput().size():
        return False
    roots = plan.relation().location().rootPaths()
    names = [roots.apply(i).toString().rstrip("/") + "/" for i in range(roots.size())]
    return not any(a.startswith(b) for i, a in enumerate(names) for j, b in enumerate(names) if i != j)


def _place(docs: DataFrame) -> tuple[Column, Column]:
    at = docs.metadataColumn("_metadata")
    return at["file_path"], at["row_index"]


def at_rest(docs: DataFrame) -> DataFrame:
    """``docs`` itself if its rows have places of their own, else a written copy of it.

    A place is the file and the row in it. It is the same whenever the file is read again, whatever partitions or executors do,
    and tells repeated rows apart. Only a plain scan of Parquet files, columns and deterministic filters over it included, has one:
    copies of a row that a join, an ``explode`` or a union makes share the row's place, and so does a file that is read twice.
    """
    if _plain_scan(docs):
        try:
            docs.select(*_place(docs)).schema  # noqa: B018  other formats have no row index
            return docs
        except PySparkException:
            pass
    return written(docs, "staged")


def located(docs: DataFrame, columns: dict[str, Column], file: str = "_file", row: str = "_row") -> DataFrame:
    """``columns`` of ``docs`` with the place of each row (see :func:`at_rest`) as ``file`` and ``row``."""
    docs = at_rest(docs)
    at_file, at_row = _place(docs)
    return docs.select(*[c.alias(k) for k, c in columns.items()], at_file.alias(file), at_row.alias(row))


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores behind it as keep it apart from the columns of ``docs``."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_place(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """All columns of ``docs`` (a file scan, see :func:`at_rest`) and its rows' places under unused names, which are given too."""
    file, row = fresh(docs, "_at_file", "_at_row")
    at_file, at_row = _place(docs)
    return docs.select("*", at_file.alias(file), at_row.alias(row)), file, row


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if its counted rows are within the bound; else Spark shuffles or decides by size."""
    return F.broadcast(df) if rows <= MAX_BROADCAST_KEYS else df


def joined(rows: DataFrame, table: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``table``, which has ``key`` once and in ``size`` how many of about ``total`` rows have that key.

    Hot keys, ``HOT`` at most since their sizes add up, are broadcast; rows that have them aren't shuffled. The others are joined as Spark sees fit.
    """
    hot = F.col(size) >= max(LUKEWARM, total // HOT)
    warm = F.broadcast(table.filter(hot))
    rest = rows.join(warm.select(key), key, "left_anti").join(table.filter(~hot), key, how)
    return rows.join(warm, key).unionByName(rest)


def shipped(spark: SparkSession) -> None:
    """Gives the executors this package, once per context, so that jobs need no installation or PYTHONPATH there."""
    sc = spark.sparkContext
    if getattr(sc, "_asclepia_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="asclepia-ship-")) / "asclepia_package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted(root.rglob("*.py")):
            out.write(f, f"asclepia/{f.relative_to(root)}")
    sc.addPyFile(str(archive))
    sc._asclepia_shipped = True


def arrow(spark: SparkSession) -> None:
    """Before any Python stage: small Arrow batches, and the package on the executors."""
    shipped(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def map_rows(df: DataFrame, fn: Callable[..., dict], schema: str) -> DataFrame:
    """Arrow batches through ``fn``: it gets each column as a Python list and returns columns as lists or arrays."""
    arrow(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = fn(*[c.to_pylist() for c in batch.columns])
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)
