"""Checks that stand before stored rows are changed or frozen: replacements, enrichment, saved groups and label bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.functions.reasons import all_reasons, first_reason
from trendloom.operators.benchmark import weighted_median
from trendloom.operators.components import checkpointed

c = F.col
PREFIX = 200  #: characters without white space that two texts must share before a changed title is taken
STATUSES = ("pending", "labeled", "no_topic", "ambiguous")


def replacement_plan(entries: DataFrame, rows: DataFrame, reviews: DataFrame) -> DataFrame:
    """What becomes of each entry that is to replace a stored text: ready, unchanged or blocked, with reasons and warnings.

    ``entries``: entry_id, parsed, target, declared, leaf, title, text. ``rows``: dataset_id, active, manual, leaf, title,
    creator, text. ``reviews``: dataset_id and sha256 of a text for which a person accepted another title. The reason is the
    first of: not_parsed, id_mismatch, no_single_row, archived, other_category, other_method, no_text, copy_of_other_row,
    title_differs. A title fits if it is the stored one, that with " | " and the creator behind, or a reviewed one whose
    text starts like the stored text. Two entries with one target or text block each other, ``batch`` says by which.
    Nulls: a null flag is false, a null text empty; a null target or category fits nothing.
    """
    body = F.trim(F.coalesce("text", F.lit("")))
    start = F.substring(F.regexp_replace(body, r"\s+", ""), 1, PREFIX)
    # digests, lengths and starts stand for the texts, so that no join moves a text
    told = [F.sha2(body, 256).alias("_sha"), F.length(body).alias("_size"), start.alias("_start")]
    e = entries.select(*[x for x in entries.columns if x != "text"], *told)
    one = rows.where("dataset_id is not null").select(c("dataset_id").alias("target"), F.struct("active", "manual", "leaf", "title", "creator", *told).alias("_r"))
    one = one.groupBy("target").agg(F.count("*").alias("_n"), F.first("_r").alias("_r"))
    owners = rows.where("trim(text) <> ''").groupBy(F.sha2(body, 256).alias("_sha")).agg(F.min("dataset_id").alias("_lo"), F.max("dataset_id").alias("_hi"))
    seen = reviews.select(c("dataset_id").alias("target"), c("sha256").alias("_sha")).distinct().withColumn("_reviewed", F.lit(True))
    x = e.join(one, "target", "left").join(owners, "_sha", "left").join(seen, ["target", "_sha"], "left")
    own, given = F.trim(F.coalesce(c("_r.title"), F.lit(""))), F.trim(F.coalesce("title", F.lit("")))
    suffixed = given == F.concat(own, F.lit(" | "), F.coalesce(c("_r.creator"), F.lit("")))
    reviewed = F.coalesce("_reviewed", F.lit(False)) & F.coalesce((F.length("_r._start") == PREFIX) & (c("_r._start") == c("_start")), F.lit(False))
    no = lambda x: ~F.coalesce(x, F.lit(False))
    reason = first_reason(
        (no(c("parsed")), "not_parsed"), (no(c("target") == c("declared")), "id_mismatch"), (no(c("_n") == 1), "no_single_row"), (no(c("_r.active")), "archived"), (no(c("leaf") == c("_r.leaf")), "other_category"),
        (no(c("_r.manual")), "other_method"), (c("_size") == 0, "no_text"), (F.coalesce((c("_lo") != c("target")) | (c("_hi") != c("target")), F.lit(False)), "copy_of_other_row"),
        (~((given == own) | suffixed | reviewed), "title_differs"),
    )
    known = F.array(F.lit("not_parsed"), F.lit("id_mismatch"), F.lit("no_single_row"), F.lit("archived"), F.lit("other_category"), F.lit("other_method"))
    counted = x.withColumn("reason", reason).withColumn("_text", F.when(~F.coalesce(F.array_contains(known, c("reason")), F.lit(False)) & (c("_size") > 0), c("_sha")))
    # an entry names its target unless it was not parsed, and its text once the row stands
    counted = counted.withColumn("_video", F.when(F.coalesce(c("reason") != "not_parsed", F.lit(True)), c("target")))
    counted = checkpointed(counted.select("entry_id", "target", "reason", "_video", "_text", "_sha", "_size", c("_r._sha").alias("_old"), c("_r._size").alias("_old_size"), (given == own).alias("_same_title"), suffixed.alias("_suffixed")))
    twice = lambda key, name: counted.where(c(key).isNotNull()).groupBy(F.col(key).cast("string").alias(f"{name}_key")).agg(F.count("*").alias("_k")).where("_k > 1").select(f"{name}_key", F.lit(True).alias(name))
    # a row without key gets one of its own that fits nothing, so that such rows don't meet in one task
    keyed = lambda rows, key, name: rows.withColumn(f"{name}_key", F.coalesce(F.col(key).cast("string"), F.concat(F.lit("none "), F.xxhash64("entry_id")))).join(twice(key, name), f"{name}_key", "left")
    z = keyed(keyed(counted, "_video", "_same_video"), "_text", "_same_text")
    batch = all_reasons((c("_same_video"), "same_row"), (c("_same_text"), "same_text"))
    ok = c("reason").isNull() & (batch == "")
    status = F.when(~ok, "blocked").when(c("_sha") == F.coalesce(c("_old"), F.sha2(F.lit("").cast("binary"), 256)), "unchanged").otherwise("ready")
    warnings = F.when(c("reason").isNull(), all_reasons((c("_suffixed") & ~c("_same_title"), "creator_in_title"), (~c("_same_title") & ~c("_suffixed"), "reviewed_title"), (c("_size") < F.coalesce(c("_old_size"), F.lit(0)), "shorter"))).otherwise("")
    return z.select("entry_id", "target", status.alias("status"), "reason", batch.alias("batch"), warnings.alias("warnings"))


def enrich(stored: DataFrame, sample: DataFrame, on: list[str], same: str, blank: list[str], absent: list[str], order: str) -> DataFrame:
    """``stored`` with missing fields taken from the sample of the same run, where key and title agree.

    ``blank`` fields are missing if null or empty, ``absent`` ones if null. Of several samples with one key the last by
    ``order`` counts. Nothing that is there is replaced; ``enriched`` tells whether a field was filled.
    """
    last = sample.where(" and ".join(f"{k} is not null" for k in on)).groupBy(*on).agg(F.max_by(F.struct(same, *blank, *absent), order).alias("_s"))
    rows = stored.join(last, on, "left")
    agree = c(same).eqNullSafe(c(f"_s.{same}")) & c("_s").isNotNull()
    missing = {f: (c(f).isNull() | (c(f).cast("string") == "")) if f in blank else c(f).isNull() for f in [*blank, *absent]}
    new = {f: F.when(m & agree, c(f"_s.{f}")).otherwise(c(f)) for f, m in missing.items()}
    filled = F.greatest(*[(m & agree & c(f"_s.{f}").isNotNull()).cast("int") for f, m in missing.items()], F.lit(0)) > 0
    return rows.select(*[new.get(x, c(x)).alias(x) for x in stored.columns], filled.alias("enriched"))


def saved_groups(rows: DataFrame, saved: DataFrame, members: DataFrame, cell: list[str]) -> DataFrame:
    """Each saved group derived again from ``rows``, and whether it is accepted.

    ``rows`` (eligible ones: video_id, dataset_id, channel, views, detected, cell columns; of a video the least dataset_id
    counts) give each cell its channel-weighted median and the detected videos above it. ``saved`` has one row a cell with
    threshold and benchmark_count, ``members`` one row for each saved member. Accepted only if both member sets, the
    number of rows behind the median and the threshold are equal; a cell that is saved but can't be derived is not.
    """
    first = rows.groupBy("video_id").agg(F.min_by(F.struct("dataset_id", "channel", "views", "detected", *cell), "dataset_id").alias("_f")).select("video_id", "_f.*")
    derived = first.groupBy(*cell).agg(F.count("*").alias("n")).join(weighted_median(first, cell).withColumnRenamed("threshold", "derived_threshold"), cell)
    above = first.where("detected").join(derived, cell).where("views > derived_threshold").select(*cell, "video_id", F.lit(True).alias("_d"))
    both = above.join(members.select(*cell, "video_id", F.lit(True).alias("_s")).distinct(), [*cell, "video_id"], "full").groupBy(*cell).agg(
        F.count_if(c("_s").isNull()).alias("only_derived"), F.count_if(c("_d").isNull()).alias("only_saved"), F.count_if(c("_s") & c("_d")).alias("in_both")
    )
    z = saved.join(derived, cell, "left").join(both, cell, "left")
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long").alias(x)
    z = z.select(*cell, "threshold", "derived_threshold", "benchmark_count", zero("n"), zero("only_derived"), zero("only_saved"), zero("in_both"))
    same = (c("threshold") == c("derived_threshold")) & (c("benchmark_count") == c("n")) & (c("only_derived") + c("only_saved") == 0)
    return z.withColumn("accepted", F.coalesce(same, F.lit(False)))


def bundle_issues(samples: DataFrame, labels: DataFrame) -> DataFrame:
    """(split, sample_id, status, issues) of a frozen bundle: every sample and every label row that belongs to none.

    ``samples``: split, sample_id, video_id, title, title_sha256. ``labels``: split, sample_id, video_id, title, status,
    topics, evidence (arrays), annotator, notes. Codes: duplicate_sample, duplicate_video and duplicate_title (over all splits),
    digest, label_missing, label_added, label_twice, edited, topics (blank, repeated, of other number than the quotes, a
    quote that the title lacks, none on a labeled row or some on another), status, annotator, note. Of repeated rows one,
    by its columns, is looked at.
    """
    more = lambda key, name: samples.where(c(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_k")).where("_k > 1").select(key, F.lit(True).alias(name))
    keys = ["split", "sample_id"]
    s = samples.groupBy(*keys).agg(F.count("*").alias("_ns"), F.min(F.struct("video_id", "title", "title_sha256")).alias("_s")).select(*keys, "_ns", "_s.*")
    s = s.join(more("video_id", "_v"), "video_id", "left").join(more("title", "_t"), "title", "left")
    fields = ["video_id", "title", "status", "topics", "evidence", "annotator", "notes"]
    lab = labels.groupBy(*keys).agg(F.count("*").alias("_nl"), F.min(F.struct(*fields)).alias("l"))
    x = s.join(lab, keys, "full")
    said = F.coalesce(c("l.status"), F.lit(""))
    none = F.array().cast("array<string>")
    topics, quotes = F.coalesce(c("l.topics"), none), F.coalesce(c("l.evidence"), none)
    blank = lambda a: F.exists(a, lambda t: F.coalesce(F.trim(t) == "", F.lit(True)))
    lacking = F.exists(quotes, lambda q: ~F.coalesce(c("title").contains(q), F.lit(False)))
    bad = blank(topics) | blank(quotes) | (F.size(F.array_distinct(topics)) != F.size(topics)) | (F.size(topics) != F.size(quotes)) | lacking
    bad = bad | ((said == "labeled") & (F.size(topics) == 0)) | ((said != "labeled") & (F.size(topics) + F.size(quotes) > 0))
    both = c("_ns").isNotNull() & c("_nl").isNotNull()
    empty = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    return x.select(*keys, c("l.status").alias("status"), all_reasons(
        (c("_ns") > 1, "duplicate_sample"), (c("_v"), "duplicate_video"), (c("_t"), "duplicate_title"), (c("_ns").isNotNull() & ~c("title_sha256").eqNullSafe(F.sha2("title", 256)), "digest"),
        (c("_nl").isNull(), "label_missing"), (c("_ns").isNull(), "label_added"), (c("_nl") > 1, "label_twice"),
        (both & ~(c("l.video_id").eqNullSafe(c("video_id")) & c("l.title").eqNullSafe(c("title"))), "edited"), (both & bad, "topics"), (both & ~said.isin(*STATUSES), "status"),
        (both & (said != "pending") & empty(c("l.annotator")), "annotator"), (both & (said == "ambiguous") & empty(c("l.notes")), "note"),
    ).alias("issues"))
