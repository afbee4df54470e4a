"""Definitions on streams.

The language has no streams of its own. What filters, projects and joins with tables runs unchanged on a streaming
DataFrame; this module starts such queries and adds the one stateful operator that corresponds to collapse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run(df: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Appends a streaming query's rows to parquet at ``path``; with ``once`` it ends when what is there is done."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def collapse(df: DataFrame, by: list[str], time: str, gap: str, late: str) -> DataFrame:
    """Events of each group closer than ``gap`` merged to intervals, as session windows; events later than ``late`` are dropped by the watermark."""
    session = F.session_window(time, gap)
    out = df.withWatermark(time, late).groupBy(*by, session.alias("s")).agg(F.count(F.lit(1)).alias("events"))
    return out.select(*by, F.col("s.start").alias("low"), F.col("s.end").alias("high"), "events")
