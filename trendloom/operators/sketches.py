"""Seeded resampling on Spark: bootstrap intervals over channels."""

from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def draws(n_resamples: int, seed: int):
    """(resample, draw) expressions: a hash gives the place drawn, so a rerun of a task draws the same."""
    place = F.pmod(F.xxhash64(F.lit(seed), "resample", "draw", "grp"), F.col("n")) + 1
    return F.explode(F.sequence(F.lit(1), F.lit(n_resamples))).alias("resample"), place


def resampled(values: DataFrame, by: str, n_resamples: int = 200, seed: int = 7) -> DataFrame:
    """(grp, resample, stat): the median of every resample of a group's values, drawn with replacement.

    ``values`` has one row for each channel of a group (columns ``by`` and ``value``), which are few against rows.
    """
    w = Window.partitionBy("grp").orderBy("value", "id")
    v = values.select(F.col(by).alias("grp"), "value", "id").withColumn("place", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("grp")))
    each, place = draws(n_resamples, seed)
    picks = v.select("grp", "n", F.col("place").alias("draw"), each).select("grp", "resample", place.cast("int").alias("place"))
    return picks.join(v.select("grp", "place", "value"), ["grp", "place"]).groupBy("grp", "resample").agg(F.percentile("value", 0.5).alias("stat"))


def bca_interval(values: DataFrame, by: str, n_resamples: int = 200, confidence: float = 0.9, least: int = 10, seed: int = 7) -> DataFrame:
    """(grp, n, point, low, high): bias-corrected and accelerated interval of the median of one value for each channel.

    Null bounds below ``least`` channels or where all values are equal. The resamples and the leave-one-out medians are
    DataFrame work; only the one-row normal quantiles of a group are Python.
    """
    v = values.select(F.col(by).alias("grp"), "value", "id")
    point = v.groupBy("grp").agg(F.count("*").alias("n"), F.percentile("value", 0.5).alias("point"), (F.max("value") > F.min("value")).alias("varied"))
    stats = resampled(values, by, n_resamples, seed)
    bias = stats.join(point, "grp").groupBy("grp").agg((F.sum(F.when(F.col("stat") < F.col("point"), 1.0).when(F.col("stat") == F.col("point"), 0.5).otherwise(0.0)) / F.count("*")).alias("below"))
    # a leave-one-out median depends only on the values next to the middle and the side that the left-out value is on
    w = Window.partitionBy("grp").orderBy("value", "id")
    ranked = v.withColumn("i", F.row_number().over(w) - 1).join(point.select("grp", "n"), "grp").where("n > 1").withColumn("h", F.floor(F.col("n") / 2))
    near = ranked.groupBy("grp").agg(*[F.max(F.when(F.col("i") == F.col("h") + d, F.col("value"))).alias(name) for d, name in ((-1, "x0"), (0, "x1"), (1, "x2"))])
    odd = F.when(F.col("i") < F.col("h"), F.col("x1") + F.col("x2")).when(F.col("i") == F.col("h"), F.col("x0") + F.col("x2")).otherwise(F.col("x0") + F.col("x1")) / 2
    even = F.when(F.col("i") < F.col("h"), F.col("x1")).otherwise(F.col("x0"))
    loo = ranked.join(near, "grp").select("grp", F.when(F.col("n") % 2 == 1, odd).otherwise(even).alias("loo"))
    mean = loo.groupBy("grp").agg(F.avg("loo").alias("mean"))
    d = F.col("mean") - F.col("loo")
    accel = loo.join(mean, "grp").groupBy("grp").agg(F.sum(d * d * d).alias("cube"), F.sum(d * d).alias("square"))

    @F.pandas_udf("low double, high double")
    def levels(below: pd.Series, cube: pd.Series, square: pd.Series) -> pd.DataFrame:
        z, out = NormalDist(), []
        for b, c3, c2 in zip(below, cube, square):
            z0 = z.inv_cdf(min(max(b, 0.5 / n_resamples), 1 - 0.5 / n_resamples))
            a = c3 / (6 * c2**1.5) if c2 and c2 > 0 else 0.0
            out.append([z.cdf(z0 + (z0 + q) / (1 - a * (z0 + q))) for q in (z.inv_cdf((1 - confidence) / 2), z.inv_cdf((1 + confidence) / 2))])
        return pd.DataFrame(out, columns=["low", "high"])

    q = bias.join(accel, "grp").select("grp", levels("below", "cube", "square").alias("q"))
    sorted_stats = stats.groupBy("grp").agg(F.array_sort(F.collect_list("stat")).alias("s"))  # n_resamples values each
    at = lambda x: F.get("s", F.least(F.greatest(F.round(x * F.size("s")).cast("int") - 1, F.lit(0)), F.size("s") - 1))
    bounds = q.join(sorted_stats, "grp").select("grp", at(F.col("q.low")).alias("low"), at(F.col("q.high")).alias("high"))
    ok = (F.col("n") >= least) & F.col("varied")
    return point.join(bounds, "grp", "left").select("grp", "n", "point", F.when(ok, F.col("low")).alias("low"), F.when(ok, F.col("high")).alias("high"))
