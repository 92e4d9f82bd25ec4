"""Structured Streaming jobs over the event stream: archives, sessions, growth, notifications and merges.

Every job is a function from a streaming DataFrame to a streaming DataFrame; ``drain`` runs one over all there is and
returns what it wrote, so that a job can be held against its batch twin.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.operators.components import shared_folder
from trendloom.streaming.stateful import for_watchers
from trendloom.streaming.tables import MergedTable, run_into


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def drain(stream: DataFrame, mode: str = "append", path: str | None = None) -> DataFrame:
    """Run a stream over what is available and read its output back; with the path of an earlier run it goes on from there. Append only."""
    spark, path = stream.sparkSession, path or new_folder(stream.sparkSession)
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path + "/out").option("checkpointLocation", path + "/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path + "/out")


def schema_of(rows: DataFrame) -> str:
    return ", ".join(f"{n} {t}" for n, t in rows.dtypes)


def merge_latest(stream: DataFrame, keys: list[str], order: list[str], path: str | None = None) -> DataFrame:
    """The newest row of every key, by ``order``; see trendloom.streaming.tables for restarts."""
    values = [c for c in stream.columns if c not in keys]
    newest = lambda rows: rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("v")).select(*keys, "v.*")
    return run_into(stream, MergedTable(stream.sparkSession, path or new_folder(stream.sparkSession), schema_of(stream), newest)).read()


NOTICE = "session string, platform string, key long, detected_at timestamp"


def notifications(found: DataFrame, sessions: DataFrame, follows: DataFrame, path: str | None = None) -> DataFrame:
    """One notice for each session and trend key, when it was first detected: new keys (a stream) meet the watchers of their batch."""
    first = lambda rows: rows.groupBy("session", "platform", "key").agg(F.min("detected_at").alias("detected_at"))
    table = MergedTable(found.sparkSession, path or new_folder(found.sparkSession), NOTICE, first)
    return run_into(found, table, lambda rows, batch: for_watchers(rows, sessions, follows)).read()


def hour_archive(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """First and last event of every platform and hour, once the watermark has passed the hour."""
    at = F.struct("ts", "event_id")
    g = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "event_type").agg(
        F.count("*").alias("n"), F.min_by("event_id", at).alias("first_sample"), F.max_by("event_id", at).alias("last_sample")
    )
    return g.select(F.col("event_type").alias("platform"), F.col("window.start").alias("bucket_at"), "n", "first_sample", "last_sample")


def once_per_key(events: DataFrame, keys: list[str], delay: str = "60 days") -> DataFrame:
    """Replay-safe ingest: a key passes once within the watermark's delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys).select(*keys)


def sessions(events: DataFrame, gap: str = "90 minutes", delay: str = "10 minutes") -> DataFrame:
    """Collection sessions of a platform; a gap of more than ``gap`` begins a new one."""
    g = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last_at"))
    return g.select(F.col("event_type").alias("platform"), F.col("session_window.start").alias("first_at"), "last_at", "n")


ARCHIVE = "platform string, bucket_at timestamp, n long, first_at timestamp, first_sample long, last_at timestamp, last_sample long"
AUDIT = "event_id long, platform string, ts timestamp, state string, widened string"


def widest(rows: DataFrame) -> DataFrame:
    """One row for each platform and hour: the earliest first and the latest last sample."""
    first, last = F.struct("first_at", "first_sample"), F.struct("last_at", "last_sample")
    g = rows.groupBy("platform", "bucket_at").agg(F.sum("n").alias("n"), F.min(first).alias("f"), F.max(last).alias("l"))
    return g.select("platform", "bucket_at", "n", "f.first_at", "f.first_sample", "l.last_at", "l.last_sample")


def late_audit(events: DataFrame, path: str | None = None, delay: str = "10 minutes", fresh: str = "24 hours", kept: str = "90 days") -> tuple[DataFrame, DataFrame]:
    """(archive, audit) of a stream. The archive has the first and last sample of each platform and hour; late rows still widen it.

    A row is late if, when its batch begins, an event later than it by more than ``delay`` has been archived. Late rows are listed in the
    audit with their age against the newest event (fresh, archived, expired) and what they widened; expired ones are not archived. Each
    batch is merged once, also when it runs again after a failure, and the audit before the archive.
    """
    spark, path = events.sparkSession, path or new_folder(events.sparkSession)
    archive = MergedTable(spark, path + "/archive", ARCHIVE, widest)
    audit = MergedTable(spark, path + "/audit", AUDIT, lambda rows: rows.dropDuplicates(["event_id"]))

    def change(rows: DataFrame, batch: int) -> DataFrame:
        rows = rows.select("event_id", F.col("event_type").alias("platform"), "ts", F.date_trunc("hour", "ts").alias("bucket_at"))
        before = archive.read()
        seen = before.agg(F.max("last_at").alias("seen_at"))  # one row
        now = rows.agg(F.max("ts").alias("batch_at"))  # one row
        age = F.greatest("seen_at", "batch_at") - F.col("ts")
        state = F.when(age <= F.expr(f"INTERVAL {fresh}"), "fresh").when(age <= F.expr(f"INTERVAL {kept}"), "archived").otherwise("expired")
        rows = rows.join(F.broadcast(seen), F.lit(True)).join(F.broadcast(now), F.lit(True)).withColumn("state", state)
        late = rows.where(F.col("ts") < F.col("seen_at") - F.expr(f"INTERVAL {delay}")).join(before.select("platform", "bucket_at", "first_at", "last_at"), ["platform", "bucket_at"], "left")
        widened = F.when(F.col("state") == "expired", "none").when(F.col("first_at").isNull(), "new").when(F.col("ts") < F.col("first_at"), "first").when(F.col("ts") > F.col("last_at"), "last").otherwise("none")
        audit.apply(late.select("event_id", "platform", "ts", "state", widened.alias("widened")), batch)
        live = rows.where("state <> 'expired'")
        at = F.struct("ts", "event_id")
        return live.groupBy("platform", "bucket_at").agg(F.count("*").alias("n"), F.min("ts").alias("first_at"), F.min_by("event_id", at).alias("first_sample"), F.max("ts").alias("last_at"), F.max_by("event_id", at).alias("last_sample"))

    run_into(events, archive, change)
    return archive.read(), audit.read()


def sliding_health(events: DataFrame, size: str = "24 hours", step: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    g = events.withWatermark("ts", delay).groupBy(F.window("ts", size, step), "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 5).alias("good"))
    return g.select(F.col("event_type").alias("platform"), F.col("window.start").alias("from_at"), "n", "good")


def topic_counts(events: DataFrame, catalog: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Events by day and topic of a versioned catalog."""
    g = events.join(catalog, "user_id").withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "topic", "version").agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("day"), "topic", "version", "n")
