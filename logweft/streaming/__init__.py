"""Matching as a stream: templates are a literal of the plan, so each micro-batch is a projection without state."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.matching import match_rows
from ..sources.lines import stream_lines


def match_stream(lines: DataFrame, templates: list) -> DataFrame:
    """Streaming lines (raw, ...) with a column `matches`."""
    return match_rows(lines, templates)


def match_folder(spark, folder: str, templates: list, output: str, checkpoint: str):
    """A query that matches files as they arrive and appends JSON lines; exactly once, by its checkpoint."""
    found = match_stream(stream_lines(spark, folder), templates)
    rows = found.select(F.to_json(F.struct(F.col("raw").alias("message"), "matches"), {"ignoreNullFields": "false"}).alias("value"))
    return rows.writeStream.format("text").option("path", output).option("checkpointLocation", checkpoint).outputMode("append").start()
