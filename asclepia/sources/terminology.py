"""Value sets and code systems as tables: membership by semi join, displays by join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An expansion is broadcast only up to this many codes.
MAX_BROADCAST_CODES = 200_000


class Terminology:
    """``expansion``: valueset, system, code, display."""

    def __init__(self, expansion: DataFrame) -> None:
        self.expansion = expansion

    def expand(self, value_set: str) -> DataFrame:
        return self.expansion.filter(F.col("valueset") == value_set).select("system", "code", "display")

    def _side(self, value_set: str) -> DataFrame:
        codes = self.expand(value_set).select(F.col("code").alias("_vs_code"), F.col("system").alias("_vs_system")).dropDuplicates()
        few = codes.limit(MAX_BROADCAST_CODES + 1).count() <= MAX_BROADCAST_CODES
        return F.broadcast(codes) if few else codes

    def in_value_set(self, df: DataFrame, code: Column, value_set: str, system: Column | None = None, negate: bool = False) -> DataFrame:
        """Rows whose code (and system, if given) is in the value set; a null code is in none."""
        on = code == F.col("_vs_code")
        if system is not None:
            on = on & (system == F.col("_vs_system"))
        return df.join(self._side(value_set), on, "left_anti" if negate else "left_semi")

    def flag_in_value_set(self, df: DataFrame, code: Column, value_set: str, name: str, system: Column | None = None) -> DataFrame:
        """The same as a column: null for a null code."""
        side = self._side(value_set)
        if system is None:
            side = side.select("_vs_code").dropDuplicates()
        on = code == F.col("_vs_code")
        if system is not None:
            on = on & (system == F.col("_vs_system"))
        joined = df.withColumn("_code", code).join(side, on, "left")
        return joined.select(*df.columns, F.when(F.col("_code").isNotNull(), F.col("_vs_code").isNotNull()).alias(name))

    def concept_in_value_set(self, df: DataFrame, key: str, codes: Column, value_set: str) -> DataFrame:
        """Keys of rows of which any code of a list of code structs is in the value set."""
        rows = df.select(key, F.explode(codes).alias("_c"))
        return self.in_value_set(rows, F.col("_c.code"), value_set, F.col("_c.system")).select(key).dropDuplicates()

    def in_code_system(self, df: DataFrame, system: Column, uri: str) -> DataFrame:
        return df.filter(system == uri)

    def with_display(self, df: DataFrame, code: Column, name: str = "display", system: Column | None = None) -> DataFrame:
        """The display of each row's code, of its ``system`` if given; of several, or without a system of several systems', the first."""
        keys = [F.col("code").alias("_vs_code")] + ([F.col("system").alias("_vs_system")] if system is not None else [])
        shown = self.expansion.groupBy(*keys).agg(F.min("display").alias(name))
        on = code == F.col("_vs_code")
        if system is not None:
            on = on & (system == F.col("_vs_system"))
        return df.join(shown, on, "left").drop("_vs_code", "_vs_system")
