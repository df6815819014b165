"""Arithmetic on places in a grid of any number of dimensions, held as array<int> columns."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moved(place: Column, delta) -> Column:
    """All coordinates moved by one number."""
    return F.transform(place, lambda x: x + delta)


def top_left(place: Column) -> Column:
    return moved(place, -1)


def bottom_right(place: Column) -> Column:
    return moved(place, 1)


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def distance(a: Column, b: Column) -> Column:
    """Coordinates of a less those of b, which is before it."""
    return F.zip_with(a, b, lambda x, y: x - y)


def is_top(place: Column) -> Column:
    """Whether a place is on a lower face of the grid."""
    return F.exists(place, lambda x: x == 0)


def l1_from_zero(place: Column) -> Column:
    return F.aggregate(place, F.lit(0), lambda a, x: a + x)


def faces(groups: DataFrame) -> DataFrame:
    """groups (label, sizes array<int>) -> (label, face, place): on each face all coordinates are the last ones, but for the face's own, which runs through."""
    at = groups.select("label", "sizes", F.posexplode("sizes").alias("face", "size")).where("size > 0")
    at = at.select("label", "sizes", "face", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("at"))
    return at.select("label", "face", F.transform("sizes", lambda n, k: F.when(k == F.col("face"), F.col("at")).otherwise(n - 1)).alias("place"))
