"""Checkpoints, the spread of work, and dense row numbers without a global window."""
from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def checkpoint_dir(spark) -> str:
    """The folder of checkpoints: that of spark.checkpoint.dir; where it is unset, a temporary one on a single machine and an error on a cluster."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once into the folder of checkpoints, its lineage cut."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, *keys) -> DataFrame:
    """df over all shuffle partitions, by keys or evenly: for little data that takes much work, which would else be put into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def numbered(df: DataFrame, order: list, name: str, start: int = 0) -> DataFrame:
    """df with `name` = start, start + 1, ... in the given order.

    A range sort numbers rows inside partitions; offsets come from one count a
    partition.
    """
    rows = checkpointed(df.orderBy(*order).withColumn("mid_", F.monotonically_increasing_id()))
    part = F.shiftright("mid_", 33)
    sizes = rows.groupBy(part.alias("part_")).count()
    offsets = sizes.select("part_", (F.sum("count").over(Window.orderBy("part_")) - F.col("count")).alias("offset_"))
    local = F.col("mid_").bitwiseAND((1 << 33) - 1)
    return rows.withColumn("part_", part).join(F.broadcast(offsets), "part_").withColumn(name, F.col("offset_") + local + start).drop("mid_", "part_", "offset_")


def numbered_within(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """df with `name` = 0, 1, ... inside each group of equal keys, in the given order; a group of any size spreads over the range partitions of one sort."""
    rows = numbered(df, [*keys, *order], "at_")
    first = rows.groupBy(*[F.col(k).alias(f"{k}_") for k in keys]).agg(F.min("at_").alias("first_"))
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    joined = rows.join(first, same)
    return joined.withColumn(name, (F.col("at_") - F.col("first_")).cast("int")).select(*df.columns, name)
