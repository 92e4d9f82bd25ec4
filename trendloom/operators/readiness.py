"""What a corpus lacks before it can be used: paired comparisons of topics, plans by category and issues of training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.functions.reasons import all_reasons
from trendloom.functions.splits import bucket
from trendloom.operators.ranking import rank_within

MIN_VIDEOS, MIN_PAIRED, SURE_PAIRED = 10, 5, 10  #: rows on each side and paired channels for a description, paired channels for a range


def median_within(rows: DataFrame, by: list[str], value: str, tie: str) -> DataFrame:
    """(by, n, median): the exact median of a number without nulls, the mean of the middle two of an even count.

    Ranks come in ranges of values, so that no task sorts or holds the values of a large group.
    """
    ranked = rank_within(rows.select(*by, value, tie), by, value, tie)
    middle = ranked.where((F.col("rank") * 2 == F.col("n")) | (F.col("rank") * 2 == F.col("n") + 1) | (F.col("rank") * 2 == F.col("n") + 2))
    return middle.groupBy(*by).agg(F.first("n").alias("n"), (F.sum(value) / F.count("*")).alias("median"))


def paired_topics(rows: DataFrame, topics: list[str], words: str, strata: list[str], domain: str = "leaf", channel: str = "channel", value: str = "views", tie: str = "dataset_id") -> DataFrame:
    """One row for each domain and topic of a catalog: rows with and without the topic, compared within channel and stratum.

    A cell of one channel and stratum counts if it has rows on both sides; its difference is median with less median
    without; a channel's difference is the median over its cells, the result that over channels. Status: not_comparable
    without such a cell; reference_only below ``MIN_VIDEOS`` rows on a side or ``MIN_PAIRED`` channels; descriptive below
    ``SURE_PAIRED`` channels; then supported if the range of the median by the sign test (1.96 standard deviations)
    leaves zero out, else uncertain. Rows whose value, channel or words are null are left out. The catalog is a fixed
    list, so every row is repeated once for each of its topics.
    """
    usable = rows.where(F.col(value).isNotNull() & F.col(channel).isNotNull() & F.col(words).isNotNull())
    arms = usable.select(domain, channel, *strata, value, tie, F.explode(F.transform(F.array(*[F.lit(t) for t in topics]), lambda t: F.struct(t.alias("topic"), F.array_contains(words, t).alias("hit")))).alias("_t"))
    arms = arms.select(domain, channel, *strata, value, tie, "_t.*")
    cell = [domain, "topic", channel, *strata]
    m = median_within(arms, [*cell, "hit"], value, tie)
    side = lambda x, yes: F.max(F.when(F.col("hit") == yes, F.col(x)))
    cells = m.groupBy(*cell).agg(side("median", True).alias("d"), side("median", False).alias("a"), side("n", True).alias("nd"), side("n", False).alias("na"))
    both = F.col("d").isNotNull() & F.col("a").isNotNull()
    diff = F.when(both, F.col("d") - F.col("a"))
    channels = cells.groupBy(domain, "topic", channel).agg(
        F.percentile(diff, 0.5).alias("diff"), F.count_if(both).alias("cells"), F.sum(F.when(both, F.col("nd"))).alias("pd"), F.sum(F.when(both, F.col("na"))).alias("pa"),
        F.sum("nd").alias("nd"), F.sum("na").alias("na"),
    )
    zero = lambda x: F.coalesce(F.sum(x), F.lit(0))
    t = channels.groupBy(domain, "topic").agg(
        zero("nd").alias("detected"), zero("na").alias("not_detected"), zero("pd").alias("paired_detected"), zero("pa").alias("paired_not_detected"), F.sum("cells").alias("matched_strata"),
        F.count("diff").alias("paired_channels"), F.percentile("diff", 0.5).alias("difference"), (F.count_if(F.expr("diff > 0")) - F.count_if(F.expr("diff < 0"))).alias("lead"), F.count_if((F.col("nd") > 0)).alias("channels"),
    )
    described = (F.col("paired_detected") >= MIN_VIDEOS) & (F.col("paired_not_detected") >= MIN_VIDEOS) & (F.col("paired_channels") >= MIN_PAIRED)
    status = (
        F.when(F.col("matched_strata") == 0, "not_comparable").when(~described, "reference_only").when(F.col("paired_channels") < SURE_PAIRED, "comparison_descriptive")
        .when(F.abs("lead") > 1.96 * F.sqrt(F.col("paired_channels").cast("double")), "comparison_supported").otherwise("comparison_uncertain")
    )
    direction = F.when(F.col("difference") > 0, "higher").when(F.col("difference") < 0, "lower").when(F.col("difference") == 0, "equal").otherwise("unknown")
    return t.select(domain, "topic", "detected", "not_detected", "channels", "matched_strata", "paired_channels", "difference", direction.alias("direction"), status.alias("status"))


def explained(actions: DataFrame, comparisons: DataFrame, on: list[str]) -> DataFrame:
    """``actions`` with the level of evidence that the comparison of their topic gives, and its numbers.

    Topics without a comparison, or with one that can't be made, are reference_examples; descriptive and uncertain ones
    say comparison_uncertain; a supported one says so with its direction. Numbers are null without a comparison.
    """
    rows = actions.join(comparisons, on, "left")
    level = (
        F.when(F.col("status") == "comparison_supported", "comparison_supported").when(F.col("status").isin("comparison_descriptive", "comparison_uncertain"), "comparison_uncertain")
        .otherwise("reference_examples")
    )
    return rows.select(*actions.columns, level.alias("level"), F.when(level != "reference_examples", F.col("direction")).alias("direction"), F.col("detected").alias("clips"), "channels", "paired_channels", "difference")


def category_plan(rows: DataFrame, checks: dict[str, Column], leaf: str = "leaf", channel: str = "channel") -> DataFrame:
    """One row a category: counts by split, channels, the largest channel's share, failed checks, pools and what to add.

    The cohort is the rows of the metric version that most rows have (ties: the later one). Its upper pool is the first
    40 %, rounded up, the rest is the comparison pool; only their sizes are told here. Rows of at most 300 seconds count for durations.
    Rows with a null category are left out, a null channel counts for no channel. ``checks`` maps the name of a field
    to the condition that a good row meets; a null condition counts as failed.
    """
    rows = rows.where(F.col(leaf).isNotNull())
    bad = [F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"missing_{name}") for name, ok in checks.items()]
    by_channel = rows.groupBy(leaf, channel).agg(
        F.count("*").alias("n"), *[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("train", "validation", "test")], F.count_if(F.expr("duration <= 300")).alias("durations"), *bad
    )
    names = [f"n_{s}" for s in ("train", "validation", "test")] + ["durations"] + [f"missing_{x}" for x in checks]
    known = F.when(F.col(channel).isNotNull(), F.col("n"))
    plan = by_channel.groupBy(leaf).agg(F.sum("n").alias("n"), F.count(channel).alias("channels"), (F.coalesce(F.max(known), F.lit(0)) / F.sum("n")).alias("largest_share"), *[F.sum(x).alias(x) for x in names])
    sizes = rows.groupBy(leaf, "metric_version").agg(F.count("*").alias("cohort"))
    cohort = sizes.groupBy(leaf).agg(F.max_by(F.struct("metric_version", "cohort"), F.struct("cohort", "metric_version")).alias("_c")).select(leaf, "_c.*")
    upper = F.ceil(F.col("cohort") * 2 / 5)
    plan = plan.join(cohort, leaf).withColumn("upper_pool", upper).withColumn("comparison_pool", F.col("cohort") - upper)
    missing = sum((F.col(f"missing_{x}") for x in checks), F.lit(0))
    return plan.withColumn("actions", all_reasons(
        (F.col("n") < 80, "more_rows"), (F.col("channels") < 10, "more_channels"), (F.col("largest_share") > 0.4, "one_channel_dominates"), (F.col("n_validation") < 5, "more_validation"),
        (F.col("n_test") < 5, "more_test"), (F.col("upper_pool") < 10, "more_upper"), (F.col("comparison_pool") < 10, "more_comparison"), (F.col("durations") < 10, "more_durations"), (missing > 0, "mend_fields"),
    ))


def training_issues(rows: DataFrame, minimum: int, reserve: int = 4) -> DataFrame:
    """Rows of the training split with the issues that keep them out, as sorted codes.

    reserved (the identity's hash keeps one in ``reserve`` back), split_mismatch (the stored split is not the channel's),
    holdout_text (the same text stands in another split), leaf_conflict (the same text has another leaf), few_rows (the
    leaf has under ``minimum`` different reviewed texts for training), unreviewed, empty. Texts are compared by digest in
    one grouping, which is joined back; a null text is empty and equal to no other.
    """
    rows = rows.withColumn("_d", F.sha2("text", 256)).withColumn("_empty", F.length(F.trim(F.coalesce("text", F.lit("")))) == 0)
    rows = rows.select("dataset_id", "leaf", "split", "stored_split", "quality", "_d", "_empty")  # texts stay where they were read
    texts = rows.where("_d is not null").groupBy("_d").agg(
        F.bool_or(F.col("stored_split") != "train").alias("_held"), (F.min("leaf") != F.max("leaf")).alias("_conflict")
    )
    train = rows.where("stored_split = 'train'").join(texts, "_d", "left")
    reviewed = train.where("quality is not null and _d is not null").groupBy("leaf", "_d").agg(F.lit(1).alias("_1")).groupBy("leaf").agg(F.count("*").alias("_n"))
    train = train.join(reviewed, "leaf", "left")
    return train.select("dataset_id", "leaf", all_reasons(
        (bucket(F.col("dataset_id"), reserve) == 0, "reserved"), (F.col("stored_split") != F.col("split"), "split_mismatch"), (F.col("_held"), "holdout_text"), (F.col("_conflict"), "leaf_conflict"),
        (F.coalesce("_n", F.lit(0)) < minimum, "few_rows"), (F.col("quality").isNull(), "unreviewed"), (F.col("_empty"), "empty"),
    ).alias("issues"))
