"""Reports on how a scope was observed through time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOUR, GAP, SHIFT_HOURS = 3_600_000_000, 5_400_000_000, 7  #: microseconds; hours by which local days begin earlier than those of UTC


def gap_flags(points: DataFrame, key: str = "entity", gap: int = GAP) -> DataFrame:
    """(key, obs_id, gap_us, interrupted, gap_before) of every good reading.

    ``gap_us`` is the time since the good reading before, null for the first. A gap stands before a reading if that time
    is longer than ``gap`` or a failed reading lies between the two. A running count of failures tells the latter, so one
    window serves both. A key without good readings has no row.
    """
    order = Window.partitionBy(key).orderBy("us", "obs_id")
    good = points.withColumn("_bad", F.count_if(F.col("status") == "failed").over(order)).where("status <> 'failed'")
    p = good.withColumn("_b", F.lag(F.struct("us", "_bad")).over(order))
    since = F.col("us") - F.col("_b.us")
    cut = F.coalesce(F.col("_bad") > F.col("_b._bad"), F.lit(False))
    return p.select(key, "obs_id", since.alias("gap_us"), cut.alias("interrupted"), (cut | F.coalesce(since > gap, F.lit(False))).alias("gap_before"))


def hourly(attempts: DataFrame) -> DataFrame:
    """One row for each scope and hour with an attempt: first and last good one, failures, and those before and between these two.

    Windows over this table see one row an hour, however many attempts an hour has.
    """
    at = attempts.withColumn("hour", F.floor(F.col("us") / HOUR))
    good = F.when(~F.col("failed"), F.col("us"))
    h = at.groupBy("scope", "hour").agg(F.min(good).alias("lo"), F.max(good).alias("hi"), F.count_if("failed").alias("bad"), F.max(F.when(F.col("failed"), F.col("us"))).alias("last_bad"))
    failures = at.where("failed").select("scope", "hour", "us").join(h.where("bad > 0 and lo is not null").select("scope", "hour", "lo", "hi"), ["scope", "hour"])
    placed = failures.groupBy("scope", "hour").agg(F.count_if(F.expr("us <= lo")).alias("_before"), F.count_if(F.expr("us > lo and us <= hi")).alias("_inside"))
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    return h.join(placed, ["scope", "hour"], "left").select("scope", "hour", "lo", "hi", "bad", "last_bad", zero("_before").alias("before"), zero("_inside").alias("inside"))


def coverage_report(attempts: DataFrame, gap: int = GAP, shift: int = SHIFT_HOURS) -> DataFrame:
    """How each scope was observed, one row for each scope and local day, the scope's summary beside.

    ``attempts`` has scope, key, us (microseconds) and failed. The first and last good attempt of an hour are its points. A
    gap stands before a point if the one before is over ``gap`` older or a failed attempt lies between. Hours run from the
    first to the last attempt of all scopes: partial where good and failed ones meet, unobserved without a good one.
    ``default_key`` is the key of the last observed hour that was seen in most hours (ties: the smaller key). A scope
    without a good attempt is stale, with null times and key. Rows with a null scope, time or outcome are left out; an
    empty table gives an empty report.
    """
    rows = attempts.where("scope is not null and us is not null and failed is not null")
    h = hourly(rows)
    limits = h.agg(F.min("hour").alias("from_hour"), F.max("hour").alias("to_hour"), F.max(F.greatest("hi", "last_bad")).alias("end"))  # one row
    earlier = F.coalesce(F.sum("bad").over(Window.partitionBy("scope").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seen = h.withColumn("at_lo", earlier + F.col("before")).withColumn("at_hi", F.col("at_lo") + F.col("inside")).where("lo is not null")
    last = F.lag(F.struct("hi", "at_hi")).over(Window.partitionBy("scope").orderBy("hour"))
    outer = F.coalesce((F.col("lo") - F.col("_l.hi") > gap) | (F.col("at_lo") > F.col("_l.at_hi")), F.lit(False))
    inner = (F.col("inside") > 0) | (F.col("hi") - F.col("lo") > gap)
    points = seen.withColumn("_l", last).groupBy("scope").agg(
        F.sum(F.when(F.col("lo") < F.col("hi"), 2).otherwise(1)).alias("points"), F.count("*").alias("hours_observed"), F.sum(outer.cast("long") + inner.cast("long")).alias("gap_count"),
        F.min("lo").alias("first_us"), F.max("hi").alias("last_us"), F.max("hour").alias("last_hour"),
    )
    hours = rows.where("not failed and key is not null").groupBy("scope", "key", F.floor(F.col("us") / HOUR).alias("hour")).agg(F.lit(1).alias("_1"))
    keys = hours.groupBy("scope", "key").agg(F.count("*").alias("n"), F.max("hour").alias("last_hour")).join(points.select("scope", "last_hour"), ["scope", "last_hour"])
    default = keys.groupBy("scope").agg(F.min_by("key", F.struct(-F.col("n"), "key")).alias("default_key"))
    failed = h.groupBy("scope").agg(F.sum("bad").alias("failed_total"), F.max("last_bad").alias("last_bad"))
    summary = failed.join(points, "scope", "left").join(default, "scope", "left").join(F.broadcast(limits), F.lit(True)).select(
        "scope", F.coalesce("points", F.lit(0)).alias("points"), F.coalesce("hours_observed", F.lit(0)).alias("hours_observed"), F.coalesce("gap_count", F.lit(0)).alias("gap_count"), "failed_total",
        "first_us", "last_us", F.coalesce(F.col("end") - F.col("last_us") > gap, F.lit(True)).alias("is_stale"),
        F.coalesce(F.col("last_bad") >= F.coalesce("last_us", F.col("last_bad")), F.lit(False)).alias("latest_unavailable"), "default_key", "from_hour", "to_hour",
    )
    grid = summary.select("scope", F.explode(F.sequence("from_hour", "to_hour")).alias("hour")).join(h.select("scope", "hour", "lo", "bad"), ["scope", "hour"], "left")
    good = F.col("lo").isNotNull()
    days = grid.groupBy("scope", F.date_from_unix_date(F.floor((F.col("hour") + shift) / 24).cast("int")).alias("day")).agg(
        F.count_if(good).alias("observed_hours"), F.count_if(good & (F.col("bad") > 0)).alias("partial_hours"), F.count_if(~good).alias("unobserved_hours"), F.coalesce(F.sum("bad"), F.lit(0)).alias("failed_attempts")
    )
    return days.join(summary.drop("from_hour", "to_hour"), "scope")
