"""Import of review decisions: ordered gates, each event once, and what changes in the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.functions.reasons import first_reason

#: fixed values: what an approved row may have
QUALITIES = ("good", "acceptable")
LICENSES = ("creativeCommon", "youtube")
SOURCES = ("caption_api", "uploaded")
CAPTIONS = ("manual", "automatic")
EVENT = ["run_key", "id", "artifact_sha256", "decision"]


def decide(reviews: DataFrame, candidates: DataFrame, events: DataFrame, datasets: DataFrame, run_key: str, artifact: str, leaves, languages) -> DataFrame:
    """(id, decision, outcome, ...): every review row with the first gate that stops it, or what it does.

    ``reviews`` (id, candidate_sha256, decision, reviewer, reviewed_at, reviewed_leaf, transcript_quality) are strings as a sheet has them;
    ``candidates`` (id, candidate_sha256, transcript_sha256, license, transcript_source, caption_type, language, channel); ``events`` (run_key,
    id, artifact_sha256, decision) are those processed before; ``datasets`` (id, transcript_sha256, dataset_source, deleted). The gates, in this
    order: pending, bad decision, unknown id, changed candidate, no reviewer, bad time; for approvals leaf, quality, licence, source, caption,
    language; event known (unchanged), row twice in the batch, dataset deleted; rejections take effect; a transcript that another dataset or an
    earlier row of the batch has, an id of a foreign source; else created or updated. Repeated rows of an id: the first by decision and time counts.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    rows = reviews.select(
        text("id").alias("id"), F.col("candidate_sha256").alias("claimed"), F.lower(text("decision")).alias("decision"), text("reviewer").alias("reviewer"), F.col("reviewed_at").try_cast("timestamp").alias("reviewed_at"),
        F.lower(text("reviewed_leaf")).alias("leaf"), F.lower(text("transcript_quality")).alias("quality"),
    ).withColumn("row", F.xxhash64("id", "claimed", "decision", "reviewer", "reviewed_at", "leaf", "quality"))
    known = candidates.select(F.col("id").cast("string").alias("id"), F.col("candidate_sha256").alias("own"), "transcript_sha256", "license", "transcript_source", "caption_type", "language", F.lit(True).alias("is_candidate"))
    done = events.where((F.col("run_key") == run_key) & (F.col("artifact_sha256") == artifact)).select(F.col("id").cast("string").alias("id"), "decision").distinct().withColumn("is_done", F.lit(True))
    held = datasets.select(F.col("id").cast("string").alias("id"), "dataset_source", "deleted", F.lit(True).alias("is_held"))
    # of each transcript two datasets are enough to know whether another one has it
    twins = datasets.groupBy("transcript_sha256").agg(F.min(F.col("id").cast("string")).alias("low"), F.max(F.col("id").cast("string")).alias("high"))
    rows = rows.join(known, "id", "left").join(done, ["id", "decision"], "left").join(held, "id", "left").join(twins, "transcript_sha256", "left")
    approve = F.col("decision") == "approve"
    no = lambda c, allowed: approve & ~F.coalesce(F.col(c).isin(*allowed), F.lit(False))
    gate = first_reason(
        (F.col("decision") == "", "pending"), (~F.col("decision").isin("approve", "reject"), "decision_must_be_approve_or_reject"), (F.col("is_candidate").isNull(), "unknown_id"),
        (~F.col("claimed").eqNullSafe(F.col("own")), "candidate_hash_mismatch"), (F.col("reviewer") == "", "reviewer_is_required"), (F.col("reviewed_at").isNull(), "reviewed_at_is_no_time"),
        (no("leaf", leaves), "reviewed_leaf_is_required"), (no("quality", QUALITIES), "transcript_quality_not_accepted"), (no("license", LICENSES), "license_is_missing"),
        (no("transcript_source", SOURCES), "transcript_source_not_accepted"), (no("caption_type", CAPTIONS), "caption_type_not_accepted"), (no("language", languages), "transcript_language_not_accepted"),
        (F.col("is_done"), "unchanged"),
    )
    rows = rows.withColumn("gate", gate)
    # one row of each id goes on, and of the approved ones one of each transcript: sums by key, then joined back
    mark = F.struct("decision", "reviewed_at", "row")
    open_rows = rows.where("gate is null")
    first = open_rows.groupBy("id").agg(F.min(mark).alias("first_row"), F.count("*").alias("copies"))
    taken = open_rows.where(approve & ~F.coalesce("deleted", F.lit(False))).groupBy("transcript_sha256").agg(F.min("id").alias("taker"))
    rows = rows.join(first, "id", "left").join(taken, "transcript_sha256", "left")
    elsewhere = F.coalesce((F.col("low") != F.col("id")) | (F.col("high") != F.col("id")), F.lit(False))
    outcome = F.coalesce(
        "gate",
        first_reason(
            (mark != F.col("first_row"), "twice_in_batch"), (F.coalesce("deleted", F.lit(False)), "dataset_deleted"), (~approve, "rejected"), (elsewhere, "transcript_in_another_dataset"),
            (F.col("taker") != F.col("id"), "transcript_twice_in_batch"), (F.col("is_held") & ~F.col("dataset_source").isin("reviewed"), "id_of_another_source"),
        ),
        F.when(F.col("is_held"), "updated").otherwise("created"),
    )
    return rows.select("id", "decision", outcome.alias("outcome"), "leaf", "quality", "reviewer", "reviewed_at", "transcript_sha256", F.coalesce("is_held", F.lit(False)).alias("is_held"))


def new_events(decided: DataFrame, run_key: str, artifact: str) -> DataFrame:
    """Events of the rows that took effect, to be appended to the processed ones: a second import of the same artifact changes nothing."""
    return decided.where(F.col("outcome").isin("created", "updated", "rejected")).select(F.lit(run_key).alias("run_key"), "id", F.lit(artifact).alias("artifact_sha256"), "decision", "reviewer", "reviewed_at").dropDuplicates(EVENT)


def changed_datasets(datasets: DataFrame, decided: DataFrame) -> DataFrame:
    """``datasets`` (with is_active) after the import: rejected ones are inactive, updated ones active, created ones added."""
    took = decided.where(F.col("outcome").isin("created", "updated", "rejected")).select(F.col("id").alias("_id"), "outcome", F.col("transcript_sha256").alias("_sha")).dropDuplicates(["_id"])  # a repeated row takes effect once
    both = datasets.join(took, datasets["id"].cast("string") == F.col("_id"), "left")
    old = both.select(*[(F.when(F.col("outcome") == "rejected", False).when(F.col("outcome") == "updated", True).otherwise(F.col(c)) if c == "is_active" else F.when(F.col("outcome") == "updated", F.col("_sha")).otherwise(F.col(c)) if c == "transcript_sha256" else F.col(c)).alias(c) for c in datasets.columns])
    new = took.where("outcome = 'created'").select(F.col("_id").cast(datasets.schema["id"].dataType).alias("id"), F.col("_sha").alias("transcript_sha256"), F.lit("reviewed").alias("dataset_source"), F.lit(False).alias("deleted"), F.lit(True).alias("is_active"))
    return old.unionByName(new.select([c for c in datasets.columns if c in new.columns]), allowMissingColumns=True)
