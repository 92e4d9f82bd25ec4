"""Trend operators over ranked snapshots and counter readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_runs(runs: DataFrame, keys: list[str], at: str, n: int = 1) -> DataFrame:
    """The newest ``n`` rows of each group of ``keys`` by ``at``, with their place from 1."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(at)))
    return runs.withColumn("place", place).where(F.col("place") <= n)


def first_per(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def previous_run(runs: DataFrame) -> DataFrame:
    """(platform, run_at, prev_at): the run before each successful one, skipping failed runs."""
    good = runs.where("status = 'ok'")
    return good.select("platform", "run_at", F.lag("run_at").over(Window.partitionBy("platform").orderBy("run_at")).alias("prev_at"))


def as_of_run(runs: DataFrame, delay_days: int) -> DataFrame:
    """Backward as-of: for each run the newest successful run at least ``delay_days`` older.

    Runs are few against items, so both sides are tagged in one pass over the runs and the last value is carried forward.
    """
    shift = F.expr(f"run_at + INTERVAL {delay_days} DAYS")
    tagged = runs.where("status = 'ok'").select("platform", shift.alias("at"), F.lit(0).alias("side"), F.col("run_at").alias("found"), F.lit(None).cast("timestamp_ntz").alias("run_at")).unionByName(
        runs.select("platform", F.col("run_at").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("timestamp_ntz").alias("found"), "run_at")
    )
    last = F.last("found", ignorenulls=True).over(Window.partitionBy("platform").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0))
    return tagged.withColumn("as_of", last).where("side = 1").select("platform", "run_at", "as_of")


def changes(items: DataFrame, runs: DataFrame) -> DataFrame:
    """Items of every successful run against the previous successful run of their platform."""
    prev = items.select("platform", F.col("run_at").alias("prev_at"), "key", F.col("rank").alias("prev_rank"), F.col("score").alias("prev_score"))
    now = items.join(previous_run(runs), ["platform", "run_at"])
    rows = now.join(prev, ["platform", "prev_at", "key"], "left")
    kind = (
        F.when(F.col("prev_at").isNull(), "first_run").when(F.col("prev_rank").isNull(), "new").when(F.col("prev_rank") > F.col("rank"), "up")
        .when(F.col("prev_rank") < F.col("rank"), "down").otherwise("same")
    )
    return rows.select(
        "platform", "run_at", "key", "rank", "prev_rank", (F.col("prev_rank") - F.col("rank")).alias("rank_change"), (F.col("score") - F.col("prev_score")).alias("delta"), kind.alias("change_kind")
    )


def snapshot_changes(items: DataFrame, runs: DataFrame) -> DataFrame:
    """Items of every successful run against the run before: ranks, score difference, percent, rate a minute, kind, status.

    Scores counted in another way (``metric_version``) are not compared: their difference, percent and rate are 0, as for
    an item without a predecessor. Percent is 0 where the score before is not above 0. Hot are the first tenth of a run
    by rank, one item at least.
    """
    run = previous_run(runs).join(runs.select("platform", "run_at", "n_items"), ["platform", "run_at"])
    prev = items.select("platform", F.col("run_at").alias("prev_at"), "key", F.col("rank").alias("prev_rank"), F.col("score").alias("_score"), F.col("metric_version").alias("_version"))
    rows = items.join(run, ["platform", "run_at"]).join(prev, ["platform", "prev_at", "key"], "left")
    us = lambda x: F.unix_micros(F.col(x).cast("timestamp"))
    seconds = F.greatest(F.lit(1.0), (us("run_at") - us("prev_at")) / 1_000_000.0)
    comparable = F.coalesce(F.col("_version") == F.col("metric_version"), F.lit(False))
    delta = F.when(comparable, F.col("score") - F.col("_score")).otherwise(0.0)
    moved = F.coalesce(F.col("prev_rank") - F.col("rank"), F.lit(0))
    kind = (
        F.when(F.col("prev_at").isNull(), "baseline").when(F.col("prev_rank").isNull(), "new").when(moved > 0, "rank_up").when(moved < 0, "rank_down").otherwise("none")
    )
    return rows.select(
        "platform", "run_at", "key", "rank", "prev_rank", moved.alias("rank_change"), delta.alias("delta"),
        F.when(comparable & (F.col("_score") > 0), delta / F.col("_score") * 100.0).otherwise(0.0).alias("percent"),
        F.when(F.col("prev_at").isNotNull(), delta / (seconds / 60.0)).otherwise(0.0).alias("per_minute"),
        (F.col("prev_rank").isNotNull() & ~comparable).alias("metric_changed"), (F.col("prev_at").isNotNull() & F.col("prev_rank").isNull()).alias("is_new"), kind.alias("change_kind"),
        F.when(F.col("rank") <= F.greatest(F.lit(1), F.ceil(F.col("n_items") / 10)), "Hot").otherwise("Stable").alias("status"),
    )


def intervals(points: DataFrame, key: str = "entity") -> DataFrame:
    """Each reading against the one before: its kind, the counter's change and the change an hour."""
    w = Window.partitionBy(key).orderBy("us", "obs_id")
    p = points.withColumn("before", F.lag(F.struct("us", "status", "counter", "metric_version")).over(w))
    kind = (
        F.when(F.col("before").isNull(), "first").when((F.col("status") == "failed") | (F.col("before.status") == "failed"), "missing")
        .when(F.col("before.metric_version") != F.col("metric_version"), "metric_changed").when(F.col("counter") < F.col("before.counter"), "counter_decreased").otherwise("measured")
    )
    p = p.withColumn("kind", kind)
    hours = (F.col("us") - F.col("before.us")) / 3_600_000_000.0
    gain = F.when(F.col("kind") == "measured", F.col("counter") - F.col("before.counter"))
    return p.select(key, "obs_id", "kind", gain.alias("gain"), F.when((gain >= 0) & (hours > 0), gain / hours).alias("per_hour"))


def islands(grid: DataFrame, keys: list[str], step: str, value: str) -> DataFrame:
    """Runs of equal ``value`` along the consecutive integers ``step``: first, last and length of each run."""
    w, each = Window.partitionBy(*keys).orderBy(step), Window.partitionBy(*keys, value).orderBy(step)
    marked = grid.withColumn("run", F.row_number().over(w) - F.row_number().over(each))
    return marked.groupBy(*keys, value, "run").agg(F.min(step).alias("first"), F.max(step).alias("last"), F.count("*").alias("n")).drop("run")


def growth_pairs(points: DataFrame, low_h: int = 12, high_h: int = 36, target_h: int = 24) -> DataFrame:
    """For the latest good reading of an entity the earlier one nearest to ``target_h`` hours before it.

    Both must count in the same way, with no failed reading between them: a running count of failures turns that into
    an equality, so this is one equi join on the entity with a range filter.
    """
    w = Window.partitionBy("entity").orderBy("us", "obs_id")
    p = points.withColumn("bad", F.count_if(F.col("status") == "failed").over(w))
    good = p.where("status = 'complete'")
    last = good.groupBy("entity").agg(F.max_by(F.struct("obs_id", "us", "counter", "metric_version", "bad"), F.struct("us", "obs_id")).alias("l")).select("entity", "l.*")
    early = good.select("entity", F.col("obs_id").alias("e_id"), F.col("us").alias("e_us"), F.col("counter").alias("e_counter"), F.col("metric_version").alias("e_version"), F.col("bad").alias("e_bad"))
    age = F.col("us") - F.col("e_us")
    hour = 3_600_000_000
    pairs = last.join(early, "entity").where((age >= low_h * hour) & (age <= high_h * hour) & (F.col("metric_version") == F.col("e_version")) & (F.col("bad") == F.col("e_bad")))
    best = pairs.groupBy("entity", "obs_id", "us", "counter").agg(F.min_by(F.struct("e_id", "e_us", "e_counter"), F.struct(F.abs(age - target_h * hour), "e_id")).alias("e"))
    return best.select("entity", "obs_id", "e.e_id", (F.col("counter") - F.col("e.e_counter")).alias("gain"), (F.col("us") - F.col("e.e_us")).alias("age_us"))


def share_not_above(value: Column, by: list[str], among: Column) -> Column:
    """The share of a group's marked values that are at most this one, in percent; null for other values."""
    w = Window.partitionBy(*by, among).orderBy(value)
    return F.when(among, 100.0 * F.count("*").over(w.rangeBetween(Window.unboundedPreceding, 0)) / F.count("*").over(Window.partitionBy(*by, among)))
