"""Normalising and standardising encodings, absent numbers counted as zeros."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sketch

EPS = 1e-12
KEY = ["rep", "part", "i"]


def l2_normalise(rows: DataFrame, column: str = "vec", least: float = EPS) -> DataFrame:
    return rows.withColumn(column, sketch.l2_normalised(F.col(column), least))


def column_stats(long: DataFrame, items: int) -> DataFrame:
    """(rep, part, i, mean, std) over ``items`` items; std is the population's."""
    sums = long.groupBy(*KEY).agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    mean = F.col("s") / items
    return sums.select(*KEY, mean.alias("mean"), F.sqrt(F.greatest(F.col("ss") / items - mean * mean, F.lit(0.0))).alias("std"))


def standardised(long: DataFrame, ids: DataFrame, items: int | None = None) -> DataFrame:
    """(x - mean) / (std + eps) for every item and every number that any item has; others are 0 throughout."""
    stats = column_stats(long, ids.count() if items is None else items)
    grid = ids.select("id").crossJoin(F.broadcast(stats))  # as many columns as the configuration allows
    value = (F.coalesce("value", F.lit(0.0)) - F.col("mean")) / (F.col("std") + EPS)
    return grid.join(long, ["id", *KEY], "left").select("id", *KEY, value.alias("value"))
