"""Benchmarks, group comparisons and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


BINS = 1024


def weighted_median(rows: DataFrame, by: list[str], value: str = "views", channel: str = "channel", id_col: str = "dataset_id") -> DataFrame:
    """(by, threshold): the first value whose cumulative weight reaches half, every channel weighing one in all.

    A row of a channel with n rows weighs 1/n; the tolerance of 1e-9 keeps rounding from deciding a tie. Weights are
    first summed by ``BINS`` ranges of the value, so that only the rows of the range in which half is reached are sorted,
    however many rows a group has.
    """
    sizes = rows.groupBy(*by, channel).agg(F.count("*").alias("_n"))
    lim = rows.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    total = sizes.groupBy(*by).agg(F.count("*").alias("_total"))
    share = (F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0))
    w = rows.join(sizes, [*by, channel]).join(lim.join(total, by), by).select(
        *by, value, id_col, "_total", (F.lit(1.0) / F.col("_n")).alias("_w"), F.floor(F.coalesce(share, F.lit(0.0)) * (BINS - 1)).alias("_bin")
    )
    mass = w.groupBy(*by, "_bin", "_total").agg(F.sum("_w").alias("_m"))
    order = Window.partitionBy(*by).orderBy("_bin")
    cum = mass.withColumn("_cum", F.sum("_m").over(order)).where(F.col("_cum") + 1e-9 >= F.col("_total") / 2)
    middle = cum.groupBy(*by).agg(F.min_by(F.struct("_bin", (F.col("_cum") - F.col("_m")).alias("_before")), "_bin").alias("_b")).select(*by, "_b.*")
    inside = w.join(middle, [*by, "_bin"])
    running = F.sum("_w").over(Window.partitionBy(*by).orderBy(value, id_col).rowsBetween(Window.unboundedPreceding, 0))
    reached = inside.withColumn("_cum", running + F.col("_before")).where(F.col("_cum") + 1e-9 >= F.col("_total") / 2)
    return reached.groupBy(*by).agg(F.min(F.struct(value, id_col))[value].alias("threshold"))


def classification(rows: DataFrame, gold: str, pred: str, by: list[str]) -> DataFrame:
    """Precision, recall, F1 and support of every class; classes are those of gold or prediction."""
    long = rows.select(
        *by, F.inline(F.array(
            F.struct(F.col(gold).alias("label"), F.lit(1).alias("is_gold"), F.lit(0).alias("is_pred"), (F.col(gold) == F.col(pred)).cast("int").alias("hit")),
            F.struct(F.col(pred).alias("label"), F.lit(0).alias("is_gold"), F.lit(1).alias("is_pred"), F.lit(0).alias("hit")),
        ))
    )
    sums = long.groupBy(*by, "label").agg(F.sum("is_gold").alias("support"), F.sum("is_pred").alias("predicted"), F.sum("hit").alias("hits"))
    p, r = F.col("hits") / F.nullif(F.col("predicted"), F.lit(0)), F.col("hits") / F.nullif(F.col("support"), F.lit(0))
    f1 = F.lit(2.0) * F.col("hits") / (F.col("predicted") + F.col("support"))
    return sums.select(*by, "label", p.alias("precision"), r.alias("recall"), f1.alias("f1"), "support")


def area_under_roc(rows: DataFrame, by: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """(by, auc): ties count half. One row for each distinct score goes through the window, not one for each case."""
    d = rows.groupBy(*by, score).agg(F.sum(label).alias("pos"), (F.count("*") - F.sum(label)).alias("neg"))
    below = F.sum("neg").over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1))
    parts = d.withColumn("_below", F.coalesce(below, F.lit(0)))
    sums = parts.groupBy(*by).agg(F.sum(F.col("pos") * (2 * F.col("_below") + F.col("neg"))).alias("u2"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return sums.select(*by, F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u2") / (F.lit(2.0) * F.col("p") * F.col("n"))).alias("auc"))
