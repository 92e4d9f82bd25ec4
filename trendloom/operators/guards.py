"""Guards against leakage between splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without_leaks(train: DataFrame, holdout: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``train`` that share no key with ``holdout``: one equi anti join for each key; empty keys match nothing."""
    return reduce(
        lambda rows, k: rows.join(holdout.where(F.col(k).isNotNull() & (F.col(k).cast("string") != "")).select(k).distinct(), k, "left_anti"), keys, train
    ).select(train.columns)


def conflicts(rows: DataFrame, keys: list[str], split: str = "split") -> DataFrame:
    """(key, value, splits): identity values that occur in more than one split."""
    long = rows.select(split, F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])))
    return long.where("value is not null").groupBy("key", "value").agg(F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits")).where("splits like '%,%'")
