"""Audits of recommendations and of the people who rate them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VARIANTS = ("A", "B", "C")
REVIEWERS = 3  #: complete ones that a case needs


def utility(ratings: DataFrame, opinions: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, state, a, b, c, b_minus_a, c_minus_b, reviewers): what reviewers think of three variants of a case.

    ``ratings`` is (case_id, reviewer, variant, score), of a reviewer's repeated rating the least; ``opinions`` (case_id, opportunity: yes or no);
    ``cases`` (case_id, eligible). Only reviewers count who rated all three variants. A case is in if it is eligible and two or more, and more than
    half of those with an opinion, see an opportunity; otherwise it has no row. It is incomplete with under three reviewers, an abstention if a variant
    has no score at all, else paired: medians by variant and their differences. A missing score is no zero.
    """
    one = ratings.where(F.col("variant").isin(*VARIANTS)).groupBy("case_id", "reviewer", "variant").agg(F.min("score").alias("score"))
    by_reviewer = one.groupBy("case_id", "reviewer").agg(F.count("*").alias("n"), *[F.max(F.when(F.col("variant") == x, F.col("score"))).alias(x.lower()) for x in VARIANTS]).where(F.col("n") == len(VARIANTS))
    medians = by_reviewer.groupBy("case_id").agg(F.count("*").alias("reviewers"), *[F.percentile(x.lower(), 0.5).alias(x.lower()) for x in VARIANTS])  # a case has few reviewers
    votes = opinions.groupBy("case_id").agg(F.count_if(F.col("opportunity") == "yes").alias("yes"), F.count_if(F.col("opportunity") == "no").alias("no")).where("yes >= 2 and yes > no")
    rows = cases.where("eligible").join(votes, "case_id").join(medians, "case_id", "left")
    enough = F.coalesce(F.col("reviewers") >= REVIEWERS, F.lit(False))
    scored = F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("c").isNotNull()
    state = F.when(~enough, "incomplete").when(~scored, "abstention").otherwise("paired")
    paired = lambda x: F.when(enough & scored, x)
    return rows.select(
        "case_id", state.alias("state"), *[F.when(enough, F.col(x.lower())).alias(x.lower()) for x in VARIANTS], paired(F.col("b") - F.col("a")).alias("b_minus_a"), paired(F.col("c") - F.col("b")).alias("c_minus_b"),
        F.coalesce("reviewers", F.lit(0)).alias("reviewers"),
    )


def outcomes(per_case: DataFrame) -> DataFrame:
    """(comparison, n, wins, ties, losses, median) over the paired cases; of either comparison a row, with a null median where nothing is paired."""
    long = per_case.unpivot(["case_id"], ["b_minus_a", "c_minus_b"], "comparison", "difference")
    d = F.col("difference")
    return long.groupBy("comparison").agg(F.count("difference").alias("n"), F.count_if(d > 0).alias("wins"), F.count_if(d == 0).alias("ties"), F.count_if(d < 0).alias("losses"), F.percentile("difference", 0.5).alias("median"))


def structural_issues(items: DataFrame, references: DataFrame, mentions: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """``items`` (case_id, lane, place, domain, keyword, ids, support_count, total_frequency) with ``issues``, their codes sorted and joined.

    ``references`` is (id, domain, split, keyword, frequency), a row for each keyword of a corpus row; ``mentions`` (case_id, keyword) what the case says
    itself. With ``corpus`` (id, domain, split), a row for each corpus row, the references need only (id, keyword, frequency) of the items' keywords. Cited rows must be training rows of the domain that have the keyword, each once, as many as stated, with the stated sum of frequencies.
    """
    key = ["case_id", "lane", "place"]
    ids = F.coalesce("ids", F.array().cast("array<long>"))
    first = items.groupBy("case_id", "lane", "keyword").agg(F.min("place").alias("first_place"))
    cited = items.select(*key, "domain", "keyword", F.explode(ids).alias("id"))
    rows = (references if corpus is None else corpus).select("id", F.col("domain").alias("row_domain"), "split").distinct()
    terms = references.select("id", "keyword", "frequency")
    checked = cited.join(rows, "id", "left").join(terms, ["id", "keyword"], "left")
    valid = F.coalesce((F.col("split") == "train") & (F.col("row_domain") == F.col("domain")), F.lit(False))
    sums = checked.groupBy(*key).agg(
        F.bool_or(~valid).alias("bad_row"), F.bool_or(valid & F.col("frequency").isNull()).alias("no_term"), F.sum(F.when(valid, F.coalesce("frequency", F.lit(0)))).alias("found"),
    )
    said = mentions.select("case_id", "keyword").distinct().withColumn("said", F.lit(True))
    all_ = items.join(first, ["case_id", "lane", "keyword"]).join(sums, key, "left").join(said, ["case_id", "keyword"], "left")
    n = F.size(ids)
    codes = [
        (F.col("said"), "already_mentioned_or_synonym"), (F.col("place") > F.col("first_place"), "duplicate_suggestion"), (n == 0, "no_dataset_evidence"),
        ((n != F.size(F.array_distinct(ids))) | ~F.col("support_count").eqNullSafe(F.size(F.array_distinct(ids)).cast("long")), "invalid_support_count"), (F.col("bad_row"), "invalid_reference_row"),
        (F.col("no_term"), "term_not_found_in_cited_transcript"), ((n > 0) & ~F.col("total_frequency").eqNullSafe(F.coalesce("found", F.lit(0))), "invalid_total_frequency"), (F.col("domain") == "unknown", "unknown_should_abstain"),
    ]
    listed = F.filter(F.array(*[F.when(on, code) for on, code in codes]), lambda x: x.isNotNull())
    return all_.select(*[items[c] for c in items.columns], F.array_sort(listed).alias("issues"))


def issue_counts(audited: DataFrame, by: list[str]) -> DataFrame:
    """(by, issue, n): how often each issue occurs, beside the rows ``units`` and ``units_with_issues``."""
    each = F.concat(F.array(F.lit("units")), F.when(F.size("issues") > 0, F.array(F.lit("units_with_issues"))).otherwise(F.array().cast("array<string>")), F.array_distinct("issues"))
    return audited.select(*by, F.explode(each).alias("issue")).groupBy(*by, "issue").agg(F.count("*").alias("n"))


def quote_issues(quotes: DataFrame, documents: DataFrame) -> DataFrame:
    """``quotes`` (item, id, start, end, quote) with ``issues``: a quote must be what the document of the training split says at that place."""
    both = quotes.join(documents.select("id", "text", "split"), "id", "left")
    inside = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("text"))
    said = F.expr("substring(text, cast(start + 1 as int), cast(end - start as int))")
    bad = ~F.coalesce(inside & (said == F.col("quote")) & (F.col("quote") != ""), F.lit(False))
    codes = F.array(F.when(F.col("text").isNull() | (F.coalesce("split", F.lit("")) != "train"), "invalid_action_reference_row"), F.when(F.col("text").isNotNull() & bad, "fabricated_or_misaligned_quote"))
    return both.select(*quotes.columns, F.array_sort(F.filter(codes, lambda x: x.isNotNull())).alias("issues"))
