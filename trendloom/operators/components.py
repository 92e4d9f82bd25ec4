"""Connected components of graphs and of rows that share identities."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HUB_SALTS = 8


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share, from ``spark.checkpoint.dir``. Only where executors are threads of this process, as
    in tests, is a temporary one made if it is unset."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v of one type with an order), component being its smallest reachable node.

    Large-star and small-star rounds over DataFrames until the edges form stars, so long chains take few rounds; each round is
    checkpointed. Hubs are summed map-side, and their edges meet the sum under several salts, so that no task gets a whole hub.
    """

    def with_least(rows: DataFrame, least: DataFrame) -> DataFrame:
        salted = least.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(HUB_SALTS)])))
        return rows.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(HUB_SALTS)).cast("int")).join(salted, ["u", "salt"])

    edges = checkpointed(edges.where("u <> v").distinct())
    stamp = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == stamp or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        stamp = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = with_least(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = with_least(large, low).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = checkpointed(small.union(low.select("u", F.col("m").alias("v"))).distinct())


def identity_components(rows: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """(id, component): rows that share a value of any key are one component, named after its least id.

    Every row gets an edge to the least row of each of its values, which spans the value's rows; null values link nothing.
    Values of a third of the rows are summed map-side, and the sums are stored, so that a join with them can be split.
    """
    ids = rows.select(F.col(id_col).alias("id"))
    pairs = rows.select(F.col(id_col).alias("id"), F.explode(F.array(*[F.concat(F.lit(k + "="), F.col(k).cast("string")) for k in keys])).alias("value")).where("value is not null")
    pairs = checkpointed(pairs.distinct())
    first = checkpointed(pairs.groupBy("value").agg(F.min("id").alias("v"), F.count("*").alias("n")).where("n > 1").select("value", "v"))
    parts = connected_components(pairs.join(first, "value").select(F.col("id").alias("u"), "v"))
    return ids.distinct().join(parts.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def identity_issues(rows: DataFrame, id_col: str, keys: list[str], sample_keys: list[str], role: str) -> DataFrame:
    """(id, component, reasons): what keeps a record out because of whom it shares an identity with.

    Records that share a value of any of ``keys`` are one component. If one has records of several roles, all are listed as crossing. Of
    records that share a value of a sample key, those but the least id are duplicates, or all cross if their roles differ. Null roles, null and
    empty values count for nothing. Values and components are summed map-side and joined back, so a frequent one is no task of its own.
    """
    clean = rows.select(F.col(id_col).alias("id"), F.col(role).alias("role"), *[F.nullif(F.col(k).cast("string"), F.lit("")).alias(k) for k in dict.fromkeys([*keys, *sample_keys])])
    clean = checkpointed(clean)
    parts = checkpointed(identity_components(clean, "id", keys))
    spread = clean.join(parts, "id").groupBy("component").agg((F.min("role") < F.max("role")).alias("crosses"))
    crossing = parts.join(spread.where("crosses"), "component").select("id", F.lit("identity_crosses_outcome_partitions").alias("reason"))
    values = clean.select("id", "role", F.explode(F.array(*[F.concat(F.lit(k + ":"), F.col(k)) for k in sample_keys])).alias("value")).where("value is not null")
    groups = checkpointed(values.groupBy("value").agg(F.count("*").alias("n"), F.min("id").alias("keep"), F.coalesce(F.min("role") < F.max("role"), F.lit(False)).alias("mixed")).where("n > 1"))
    shared = values.join(groups, "value").where("mixed or id <> keep")
    shared = shared.select("id", F.when(F.col("mixed"), "identity_crosses_outcome_partitions").otherwise("duplicate_video_or_transcript").alias("reason"))
    reasons = crossing.unionByName(shared).groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))  # two reasons
    return parts.join(reasons, "id", "left").select("id", "component", F.coalesce("reasons", F.lit("")).alias("reasons"))
