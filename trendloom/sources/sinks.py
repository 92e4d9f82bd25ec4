"""Sinks: JSON lines and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``old`` with the rows of ``new``: the last of ``new`` wins by ``order``, nulls keep what was there, keys are null-safe.

    A column ``state`` tells created, updated and kept rows apart.
    """
    from functools import reduce

    values = [c for c in old.columns if c not in keys]
    last = new.groupBy(*keys).agg(*[F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(order))).alias("_new_" + c) for c in values]).withColumn("_in", F.lit(True))
    last = last.select(*[F.col(k).alias("_k_" + k) for k in keys], *["_new_" + c for c in values], "_in")
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col("_k_" + k)) for k in keys])
    both = old.withColumn("_was", F.lit(True)).join(last, on, "full")
    state = F.when(F.col("_was").isNull(), "created").when(F.col("_in"), "updated").otherwise("kept")
    return both.select(*[F.when(F.col("_was"), F.col(k)).otherwise(F.col("_k_" + k)).alias(k) for k in keys], *[F.coalesce("_new_" + c, c).alias(c) for c in values], state.alias("state"))
