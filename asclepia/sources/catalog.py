"""The retrieve catalog: resource types as tables, with the code and date filters pushed to the scan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from asclepia.plans.errors import ModelError
from asclepia.sources.terminology import Terminology


@dataclass
class Table:
    """A retrievable type: its rows, the column of its context (the patient), its primary code and date columns."""

    load: Callable[[], DataFrame]
    context: str | None = None
    code_path: str | None = None
    date_path: str | None = None
    system_path: str | None = None
    id_path: str | None = None


@dataclass
class Catalog:
    spark: SparkSession
    tables: dict[str, Table] = field(default_factory=dict)
    terminology: Terminology | None = None

    def add(self, name: str, source: DataFrame | str | Callable[[], DataFrame], schema=None, **paths: str | None) -> Catalog:
        """A frame, a function that makes one, or a path to parquet (the default), .orc, .csv or JSON lines (.json, .ndjson)."""
        if isinstance(source, DataFrame):
            load = lambda: source
        elif callable(source):
            load = source
        else:
            load = lambda: read(self.spark, source, schema)
        self.tables[name] = Table(load, **paths)
        return self

    def retrieve(
        self, name: str, codes: list[str] | None = None, value_set: str | None = None, date_range: tuple | None = None,
        code_path: str | None = None, date_path: str | None = None, context: list | DataFrame | None = None, code: tuple[str, str | None] | None = None, comparator: str = "~", ids: list | None = None, id_path: str | None = None,
    ) -> DataFrame:
        """Rows of a type: with a code among ``codes`` or in a value set, with a date within a closed range, of given contexts or ids.

        ``code`` is one code and its system: ``~`` compares code and system, ``=`` also asks that the system, where the rows have one, is known.
        Contexts may be a list, or a frame of one column for a population of any size. A type that isn't there is an error; :func:`nothing` gives rows of none.
        """
        if name not in self.tables:
            raise ModelError(f"no such type: {name}", 1)
        t = self.tables[name]
        df = t.load()
        own, date = code_path or t.code_path, date_path or t.date_path
        if codes is not None:
            df = df.filter(_path(df, own).isin(*codes))
        if value_set is not None:
            if self.terminology is None:
                raise ModelError("a value set needs a terminology", 3)
            df = self.terminology.in_value_set(df, _path(df, own), value_set, _path(df, t.system_path) if t.system_path else None)
        if code is not None:
            path = code_path or t.code_path
            df = df.filter(_path(df, path) == code[0])
            system = F.col(t.system_path) if t.system_path else _system(df, path)
            if code[1] is not None and system is not None:
                df = df.filter((system == code[1]) if comparator == "=" else system.eqNullSafe(F.lit(code[1])))
        if ids is not None:
            df = df.filter(F.col(id_path or t.id_path or t.context).isin(*ids))
        if date_range is not None:
            low, high = date_range
            d = _path(df, date)
            df = df.filter(F.lit(True) if low is None else d >= low).filter(F.lit(True) if high is None else d <= high)
        if isinstance(context, DataFrame):
            df = df.join(context.select(F.col(context.columns[0]).alias("_population")).dropDuplicates(), F.col(t.context) == F.col("_population"), "left_semi")
        elif context is not None:
            df = df.filter(F.col(t.context).isin(*context))
        return df


def nothing(spark: SparkSession, schema) -> Callable[[], DataFrame]:
    """A source without rows, for a type that has no data."""
    return lambda: spark.createDataFrame([], schema)


def _system(df: DataFrame, path: str | None) -> Column | None:
    kind = df.select(F.col(path).alias("x")).schema["x"].dataType
    return F.col(path)["system"] if "system" in (getattr(kind, "names", None) or ()) else None


def _path(df: DataFrame, path: str | None) -> Column:
    """A dotted path; a struct with a code stands for its code."""
    if path is None:
        raise ModelError("the type has no such path", 2)
    kind = df.select(F.col(path).alias("x")).schema["x"].dataType
    return F.col(path)["code"] if getattr(kind, "names", None) and "code" in kind.names else F.col(path)


def read(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if path.endswith((".json", ".ndjson", ".jsonl")):
        return reader.json(path)
    if path.endswith(".csv"):
        return reader.option("header", True).csv(path)
    return reader.orc(path) if path.endswith(".orc") else reader.parquet(path)


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """parquet, json (lines), csv or orc."""
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    getattr(writer, kind)(path)


def test_tables(spark: SparkSession, sf_dir: str) -> Catalog:
    """The test tables as a patient (customer), encounters (orders) and observations (lineitem, events)."""
    at = lambda n: f"{sf_dir}/{n}.parquet"
    out = Catalog(spark)
    out.add("Patient", at("customer"), context="c_custkey")
    out.add("Encounter", at("orders"), context="o_custkey", code_path="o_orderpriority", date_path="o_orderdate")
    out.add("Observation", at("lineitem"), context="l_orderkey", code_path="l_returnflag", date_path="l_shipdate")
    out.add("Event", at("events"), context="user_id", code_path="event_type", date_path="ts")
    out.add("Medication", at("part"), code_path="p_type", system_path="p_brand")
    for n in ("region", "nation", "supplier", "documents", "labels", "embeddings", "pages", "benchmark", "conversations"):
        out.add(n, at(n))
    return out
