"""The content, trend and text tables that the operators work on, as lazy DataFrames over the stored Parquet tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendloom.functions.text import phrase_counts, tokens
from trendloom.functions.splits import channel_split

METRIC_CHANGE = "2001-08-15"  #: content captured from this day on uses the second way of counting views
OBSERVATION_CHANGE = "2024-01-15"


def micros(ts) -> F.Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


class Views:
    """Tables of one directory; every property is a DataFrame that reads only what is used of it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def content(self) -> DataFrame:
        """Corpus rows with counters: one for each part that was ever shipped."""
        sums = self.table("lineitem").groupBy("l_partkey").agg(
            F.floor(F.sum(F.col("l_extendedprice").cast("decimal(18,2)"))).cast("long").alias("views"),
            F.sum(F.col("l_quantity").cast("long")).alias("likes"), F.count("*").alias("comments"),
            F.min("l_shipdate").alias("published"), F.max("l_shipdate").alias("captured"),
        )
        return self.table("part").join(sums, F.col("p_partkey") == F.col("l_partkey")).select(
            F.col("p_partkey").alias("dataset_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("channel"), F.col("p_type").alias("leaf"),
            F.col("p_size").cast("long").alias("duration"), "views", "likes", "comments", "published", "captured",
            F.when(F.col("captured") < F.lit(METRIC_CHANGE).cast("timestamp_ntz"), "v1").otherwise("v2").alias("metric_version"),
            F.when(F.col("p_size") <= 25, "short").otherwise("long").alias("format"),
        )

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").withColumn("us", micros("ts"))

    @cached_property
    def items(self) -> DataFrame:
        """Ranked snapshot items: one run a day for each platform, keys ranked by their summed score."""
        scores = self.table("events").groupBy(F.col("event_type").alias("platform"), F.date_trunc("day", "ts").alias("run_at"), F.col("user_id").alias("key")).agg(
            F.sum(F.col("value").cast("decimal(18,2)")).alias("score"), F.count("*").alias("views")
        )
        rank = F.row_number().over(Window.partitionBy("platform", "run_at").orderBy(F.desc("score"), "key"))
        return scores.select("platform", F.col("run_at").cast("timestamp_ntz").alias("run_at"), "key", F.col("score").cast("double").alias("score"), "views", rank.cast("long").alias("rank"))

    @cached_property
    def runs(self) -> DataFrame:
        """Collection runs: one for each platform and day; failed where over a fifth of the day's events are errors."""
        day = F.date_trunc("day", "ts").cast("timestamp_ntz")
        bad = self.table("events").groupBy(day.alias("run_at")).agg((F.count_if(F.col("event_type") == "error") * 5 > F.count("*")).alias("failed"))
        return self.items.groupBy("platform", "run_at").agg(F.count("*").alias("n_items")).join(bad, "run_at").select(
            "platform", "run_at", "n_items", F.when(F.col("failed"), "failed").otherwise("ok").alias("status")
        )

    @cached_property
    def observations(self) -> DataFrame:
        """Counter readings of entities: errors are failed readings, others count up by one."""
        order = Window.partitionBy("user_id").orderBy("ts", "event_id")
        return self.events.select(
            F.col("event_id").alias("obs_id"), F.col("user_id").alias("entity"), "ts", "us",
            F.when(F.col("event_type") == "error", "failed").otherwise("complete").alias("status"),
            F.when(F.col("event_type") != "error", F.count_if(F.col("event_type") != "error").over(order)).alias("views"),
            F.when(F.col("ts") < F.lit(OBSERVATION_CHANGE).cast("timestamp_ntz"), "v1").otherwise("v2").alias("metric_version"),
        )

    @cached_property
    def readings(self) -> DataFrame:
        """Readings whose counter may fall: the event's value in whole units."""
        return self.observations.join(self.events.select(F.col("event_id").alias("obs_id"), F.floor("value").cast("long").alias("counter")), "obs_id")

    @cached_property
    def transcripts(self) -> DataFrame:
        """Texts with their channel, leaf (the language), review label and data split."""
        return self.table("documents").join(self.table("labels"), "doc_id", "left").select(
            F.col("doc_id").alias("dataset_id"), "text", F.col("source").alias("channel"), F.col("lang").alias("leaf"), "n_chars",
            F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic"), channel_split(F.col("source")).alias("split"),
        )

    @cached_property
    def terms(self) -> DataFrame:
        """(dataset_id, channel, leaf, term, tf): distinct tokens of texts, counted row by row; a text is one row."""
        return self.transcripts.select("dataset_id", "channel", "leaf", F.inline(phrase_counts(tokens(F.col("text"))))).select("dataset_id", "channel", "leaf", F.col("value").alias("term"), F.col("n").alias("tf"))

    @cached_property
    def topics(self) -> DataFrame:
        """Topics by a rule on the words of titles: topic_id is the word."""
        words = self.table("part").select(F.explode(F.split("p_name", " ")).alias("topic_id"))
        return words.groupBy("topic_id").agg(F.count("*").alias("n_titles"))

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"), F.col("label").cast("long").alias("label"))

    @cached_property
    def segments(self) -> DataFrame:
        return self.table("conversations").select(
            "conv_id", F.col("turn").alias("segment_index"), "role", "text", (F.col("turn") * 10).alias("start"), (F.col("turn") * 10 + 10).alias("end")
        )

    @cached_property
    def customers(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("region"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("role")
        )

    @cached_property
    def analyses(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("analysis_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("score"),
            F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("priority"),
        )
