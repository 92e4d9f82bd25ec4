"""Ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 1024


def rank_within(rows: DataFrame, by: list[str], value: str, tie: str, bins: int = BINS) -> DataFrame:
    """``rows`` with ``rank`` (1 for the largest ``value``, ties by the smaller ``tie``) and ``n``, the size of the group.

    A group is cut into ranges of its values. A row's rank is its place in its range behind the rows of all higher ranges, so
    a group of a third of all rows is sorted in many tasks. Values must be numbers without null.
    """
    lim = rows.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count("*").alias("n"))
    share = (F.col("_hi") - F.col(value)) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0))
    binned = rows.join(lim, by).withColumn("_bin", F.floor(F.coalesce(share, F.lit(0.0)) * (bins - 1)))
    counts = binned.groupBy(*by, "_bin").agg(F.count("*").alias("_k"))
    before = counts.withColumn("_before", F.sum("_k").over(Window.partitionBy(*by).orderBy("_bin")) - F.col("_k")).drop("_k")  # a row for each range
    own = F.row_number().over(Window.partitionBy(*by, "_bin").orderBy(F.desc(value), tie))
    ranked = binned.withColumn("_own", own).join(before, [*by, "_bin"])
    return ranked.select(*rows.columns, "n", (F.col("_own") + F.col("_before")).cast("long").alias("rank"))
