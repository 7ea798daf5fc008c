"""Masks over pictures: marked places as rows (picture_id, x, y), or as a column of the pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pixels as P


def mark(marks: DataFrame, places: DataFrame, width: int, height: int) -> DataFrame:
    """Marks with more places, each once; places outside the picture are ignored."""
    inside = places.filter(P.contains(F.col("x"), F.col("y"), width, height))
    return marks.select(*P.KEYS).unionByName(inside.select(*P.KEYS)).distinct()


def attach(px: DataFrame, marks: DataFrame) -> DataFrame:
    """Pixels with a column ``marked``, in place of one they may have; marks without a pixel go."""
    rows = marks.select(*P.KEYS).distinct().withColumn("__set", F.lit(True))
    return px.drop("marked").join(rows, list(P.KEYS), "left").withColumn("marked", F.coalesce("__set", F.lit(False))).drop("__set")


def enable(px: DataFrame) -> DataFrame:
    """Pixels with a column ``marked`` that is unset, unless they have one."""
    return px if "marked" in px.columns else px.withColumn("marked", F.lit(False))


def clear(px: DataFrame) -> DataFrame:
    return px.drop("marked")
