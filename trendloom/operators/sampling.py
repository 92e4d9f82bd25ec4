"""Evaluation samples and holdouts: balanced over categories, spread over channels, decided by seeded hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_hash(value: Column, seed: str) -> Column:
    return F.sha2(F.concat(F.lit(seed + "|"), value.cast("string")), 256)


def balanced_sample(rows: DataFrame, size: int, test_size: int, seed: str, key: str = "id", category: str = "category", channel: str = "channel") -> DataFrame:
    """``rows`` of a sample with ``split`` (test or development): categories take turns, and inside one its channels do.

    A category that runs out leaves its turns to the others, so a sample is short only if there are fewer rows than ``size``; then the test part
    is in proportion. The test part is shared among categories by largest remainder. Every order is by a hash of the key.
    """
    if not 0 < test_size < size:
        raise ValueError("the test part must be between 1 and size - 1")
    h = order_hash(F.col(key), seed)
    turn = F.row_number().over(Window.partitionBy(category, channel).orderBy("_h", key))
    place = F.row_number().over(Window.partitionBy(category).orderBy("_turn", "_h", key))
    # no sample takes more than ``size`` rows of a channel or category: Spark cuts these groups before it shuffles them
    taken = rows.withColumn("_h", h).withColumn("_turn", turn).where(F.col("_turn") <= size).withColumn("_place", place).where(F.col("_place") <= size)
    taken = taken.orderBy("_place", category, "_h", key).limit(size)
    counts = taken.groupBy(category).agg(F.count("*").alias("_n"))
    every = Window.partitionBy(F.lit(0))  # a row for each category
    n = F.sum("_n").over(every)
    target = F.when(n < size, F.floor(n * test_size / size)).otherwise(F.least(F.lit(test_size), n - 1))
    share = counts.withColumn("_all", n).withColumn("_target", target)
    share = share.withColumn("_floor", F.expr("_n * _target div _all")).withColumn("_rest", F.expr("_n * _target % _all"))
    share = share.withColumn("_left", F.col("_target") - F.sum("_floor").over(every))
    first = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("_rest"), category))
    share = share.withColumn("_quota", F.col("_floor") + (first <= F.col("_left")).cast("long")).select(F.col(category).alias("_category"), "_quota")
    taken = taken.join(F.broadcast(share), F.col(category).eqNullSafe(F.col("_category")))
    within = F.row_number().over(Window.partitionBy(category).orderBy(order_hash(F.col(key), "split|" + seed), key))  # of the sample
    return taken.withColumn("split", F.when(within <= F.col("_quota"), "test").otherwise("development")).select(*rows.columns, "split")


def holdout_plan(rows: DataFrame, validation: int, test: int, seed: str = "scope-holdout-v1") -> tuple[DataFrame, DataFrame]:
    """(channels, changes): which training channels go to validation and test, so that these get enough unknown rows.

    ``rows`` is (id, channel, known, split). channels has (channel, unknown, known_train, splits, conflict, place, new_split): those with unknown
    rows; one in several splits is a conflict and never moves. Training channels without conflict come in the order of a hash, ``place``; the
    first ones go to validation until it has as many unknown rows as asked, the next ones to test. Every channel has a row at least, so no more
    of them are looked at than rows are needed. changes is (id, channel, split, new_split), a row for each row that moves.
    """
    unknown = F.when(~F.col("known"), 1)
    g = rows.groupBy("channel").agg(
        F.count(unknown).alias("unknown"), F.count(F.when(F.col("known") & (F.col("split") == "train"), 1)).alias("known_train"), F.array_join(F.array_sort(F.collect_set("split")), ",").alias("splits")
    ).where("unknown > 0").withColumn("conflict", F.contains("splits", F.lit(",")))
    have = rows.where(~F.col("known")).agg(F.count_if(F.col("split") == "validation").alias("v"), F.count_if(F.col("split") == "test").alias("t"))
    need = have.select(F.greatest(F.lit(validation) - F.col("v"), F.lit(0)).alias("need_v"), F.greatest(F.lit(test) - F.col("t"), F.lit(0)).alias("need_t"))  # one row
    free = g.where("splits = 'train'").select("channel", "unknown", F.sha2(F.concat(F.lit(seed + ":"), F.col("channel")), 256).alias("_h"))
    first = free.orderBy("_h", "channel").limit(validation + test)
    order = Window.partitionBy(F.lit(0)).orderBy("_h", "channel")  # at most as many rows as are needed
    before = F.sum("unknown").over(order) - F.col("unknown")
    placed = first.withColumn("_before", before).withColumn("place", F.row_number().over(order).cast("long")).join(F.broadcast(need), F.lit(True))
    at_v = F.min(F.when(F.col("_before") >= F.col("need_v"), F.col("_before"))).over(Window.partitionBy(F.lit(0)))  # rows given to validation
    placed = placed.withColumn("_from", at_v)
    new = F.when(F.col("_before") < F.col("need_v"), "validation").when(F.col("_before") - F.col("_from") < F.col("need_t"), "test")
    plan = g.join(placed.select("channel", "place", new.alias("new_split")), "channel", "left")
    moves = plan.where("new_split is not null").select("channel", "new_split")
    return plan, rows.join(F.broadcast(moves), "channel").select("id", "channel", "split", "new_split")
