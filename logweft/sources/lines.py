"""Log files as rows, and the preparation of `$` records."""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbering import checkpointed
from ..functions.tokens import trim


def _placed(spark: SparkSession, path: str, keep) -> DataFrame:
    """(row_id, source_line, value) of the lines of a text file or folder for which keep(value) holds."""
    # values are the lines' bytes, whatever their encoding: nothing here decodes them
    text = spark.read.option("lineSep", "\n").text(path).select(F.col("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    splits = text.groupBy("file", "split").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    kept = text.where(keep(F.col("value"))).withColumn("mid", F.monotonically_increasing_id())
    kept_splits = kept.groupBy("file", "split").agg(F.min("mid").alias("first_kept"), F.count(F.lit(1)).alias("k"))
    order = Window.orderBy("file", "split")
    places = splits.join(kept_splits, ["file", "split"], "left").select(
        "file", "split", "first", "first_kept", (F.sum("n").over(order) - F.col("n")).alias("lines_before"), (F.sum(F.coalesce("k", F.lit(0))).over(order) - F.coalesce("k", F.lit(0))).alias("kept_before")
    )
    out = kept.join(checkpointed(places), ["file", "split"])
    return out.select((F.col("kept_before") + F.col("mid") - F.col("first_kept")).alias("row_id"), (F.col("lines_before") + F.col("at") - F.col("first") + 1).alias("source_line"), "value")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, source_line, raw): trimmed non-blank lines of a text file or folder.

    row_id counts kept lines from 0, source_line physical lines of all files
    from 1, in the order of the files' paths.  Order comes from each split's
    place in its file, so no line is sorted: one small aggregate over splits
    gives their offsets.  A path that cannot be read raises.
    """
    return _placed(spark, path, lambda v: trim(v) != "").select("row_id", "source_line", trim(F.col("value")).alias("raw"))


def physical_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_line, value): all lines as they are, counted from 1."""
    return _placed(spark, path, lambda v: F.lit(True)).select("source_line", "value")


def stream_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(raw) of the lines of files that arrive in a folder; blank lines go."""
    return spark.readStream.text(folder).select(trim(F.col("value")).alias("raw")).where("raw <> ''")


def lines_of(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """A table's rows as lines: row_id from its key, raw from an SQL expression."""
    return df.select(F.col(id_col).cast("long").alias("row_id"), (F.col(id_col).cast("long") + 1).alias("source_line"), trim(F.expr(text)).alias("raw")).where("raw <> ''")


def split_records(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, record): content cut at line ends of any kind, literal backslash ones too; empty records go."""
    plain = F.regexp_replace(F.regexp_replace(F.col(text_col), r"\\r\\n", "\n"), r"\r\n?", "\n")
    return df.select(F.col(id_col).alias("id"), F.posexplode(F.split(plain, "\n")).alias("pos", "record")).where("record <> ''")


def prepare(df: DataFrame, id_col: str, text_col: str, keep_prefix: bool = False, on_invalid: str = "error") -> DataFrame:
    """(id, pos, record): records from their single `$` on (or whole, with keep_prefix).

    A record with no `$` or several is an error; with on_invalid="drop" it goes.
    """
    records = split_records(df, id_col, text_col)
    dollars = F.length("record") - F.length(F.replace(F.col("record"), F.lit("$"), F.lit("")))
    if on_invalid == "drop":
        records = records.where(dollars == 1)
    else:
        bad = F.concat(F.lit("record needs exactly one $: "), F.col("record"))
        records = records.withColumn("record", F.when(dollars == 1, F.col("record")).otherwise(F.raise_error(bad).cast("string")))
    return records if keep_prefix else records.withColumn("record", F.expr("substring(record, instr(record, '$'))"))


def validated_content(content: str) -> list[str]:
    """Records of a prepared file's content: LF-terminated, no CR, one `$` each; raises ValueError otherwise."""
    if not content.endswith("\n") or "\r" in content:
        raise ValueError("records must end in line feeds, without carriage returns")
    records = content.split("\n")[:-1]
    for n, x in enumerate(records, 1):
        if x.count("$") != 1:
            raise ValueError(f"line {n} does not hold exactly one $")
    return records


def validated_file(spark: SparkSession, path: str) -> int:
    """Records of a prepared file, by the same rules, without holding it: the number of records."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    size = fs.getFileStatus(hadoop).getLen()
    with_end = size > 0
    if with_end:
        stream = fs.open(hadoop)
        stream.seek(size - 1)
        with_end = stream.read() == 10
        stream.close()
    if not with_end:
        raise ValueError("records must end in line feeds, without carriage returns")
    lines = physical_lines(spark, path)
    dollars = F.length("value") - F.length(F.replace(F.col("value"), F.lit("$"), F.lit("")))
    r = lines.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.contains(F.col("value"), F.lit("\r"))).alias("cr"), F.min(F.when(dollars != 1, F.col("source_line"))).alias("bad")).first()
    if r.cr:
        raise ValueError("records must end in line feeds, without carriage returns")
    if r.bad is not None:
        raise ValueError(f"line {r.bad} does not hold exactly one $")
    return r.n


def same_file(a: str, b: str) -> bool:
    """Whether two paths are one file: links of both kinds count."""
    if os.path.exists(a) and os.path.exists(b) and os.path.samefile(a, b):
        return True
    return os.path.realpath(a) == os.path.realpath(b)
