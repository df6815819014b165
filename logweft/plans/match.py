"""Matching a log file against templates, into JSON lines."""
from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import as_bytes, from_bytes
from ..operators.matching import match
from ..sources.lines import read_lines, same_file
from ..sources.templates import parse_templates, templates_frame


def json_lines(matches: DataFrame) -> DataFrame:
    """(line, value): each match row as JSON, ambiguous captures as null, control characters in lower-case hex, other bytes as they are."""
    capture = lambda c: F.struct(*[c[x].alias(x) for x in ("placeholder", "token_begin", "token_end")], as_bytes(c["value"]).alias("value"))
    found = F.transform("matches", lambda m: F.struct(m["template"].alias("template"), m["capture_ambiguous"].alias("capture_ambiguous"), F.transform(m["captures"], capture).alias("captures")))
    value = F.to_json(F.struct("line", as_bytes(F.col("message")).alias("message"), found.alias("matches")), {"ignoreNullFields": "false"})
    return matches.select("line", from_bytes(_lower_hex(value)).alias("value"))


def _lower_hex(value: Column) -> Column:
    """Escapes of control characters whose hex has letters, where the backslash is not itself escaped."""
    for code in (*range(0x0A, 0x10), *range(0x1A, 0x20)):
        value = F.regexp_replace(value, rf"(?<!\\)((?:\\\\)*)\\u{code:04X}", rf"$1\\u{code:04x}")
    return value


def match_file(spark: SparkSession, templates_path: str, input_path: str, output_path: str | None = None) -> DataFrame:
    """Matches of a file's lines; with output_path also written as one JSON-lines file, in line order.

    The output must not be the input or the templates, through links either.
    """
    if output_path and any(same_file(output_path, p) for p in (templates_path, input_path)):
        raise ValueError("the output would overwrite an input")
    with open(templates_path, encoding="utf-8", newline="") as f:
        templates = parse_templates(f.read())
    if not templates:
        raise ValueError("no templates")
    found = match(read_lines(spark, input_path), templates_frame(spark, templates))
    if output_path:
        with open(output_path, "wb") as f:
            for row in json_lines(found).select("line", F.col("value").cast("binary").alias("value")).orderBy("line").toLocalIterator():
                f.write(bytes(row.value) + b"\n")
    return found


def write_matches(matches: DataFrame, folder: str) -> None:
    """JSON lines in a folder, range-sorted by line: the form for large logs."""
    json_lines(matches).orderBy("line").select("value").write.mode("overwrite").text(folder)


def templates_from(spark: SparkSession, path: str) -> DataFrame:
    """Templates from a saved mine (folder) or a report (file)."""
    if os.path.isfile(path):
        with open(path, encoding="utf-8", newline="") as f:
            return templates_frame(spark, parse_templates(f.read()))
    return spark.read.parquet(path)
