"""Audits of ratings and evidence, and the grid of classifiers, on cases made by hand."""

import random

from pyspark.sql import functions as F

from trendloom.operators import audits as A
from trendloom.operators import models as L

RATING = "case_id long, reviewer long, variant string, score long"


def rated(case, rows):
    return [(case, reviewer, x, s) for reviewer, scores in rows.items() for x, s in zip("ABC", scores)]


def test_utility_pairs_medians_of_complete_reviewers(spark):
    ratings = rated(1, {1: (1, 3, 5), 2: (2, 4, 4), 3: (3, 3, 4), 4: (5, 5)})  # reviewer 4 did not rate C
    ratings += rated(2, {1: (1, 1, 1), 2: (1, 1, 1)}) + rated(3, {i: (None, 4, 4) for i in range(3)}) + rated(4, {i: (4, 4, 4) for i in range(3)}) + rated(5, {i: (4, 3, 4) for i in range(3)})
    ratings += [(1, 1, "A", 4), (1, 1, "D", 1)]  # a repeated rating, of which the least counts, and an unknown variant
    votes = {1: "yes yes no", 2: "yes yes", 3: "yes yes", 4: "yes no no", 5: "yes yes", 6: "yes yes"}
    opinions = [(case, v) for case, vs in votes.items() for v in vs.split()]
    cases = spark.createDataFrame([(i, i != 5) for i in range(1, 8)], "case_id long, eligible boolean")
    got = A.utility(spark.createDataFrame(ratings, RATING), spark.createDataFrame(opinions, "case_id long, opportunity string"), cases)
    assert {r.case_id: tuple(r)[1:] for r in got.collect()} == {
        1: ("paired", 2.0, 3.0, 4.0, 1.0, 1.0, 3), 2: ("incomplete", None, None, None, None, None, 2), 3: ("abstention", None, 4.0, 4.0, None, None, 3), 6: ("incomplete", None, None, None, None, None, 0),
    }
    assert {r.comparison: (r.n, r.wins, r.ties, r.losses, r["median"]) for r in A.outcomes(got).collect()} == {"b_minus_a": (1, 1, 0, 0, 1.0), "c_minus_b": (1, 1, 0, 0, 1.0)}
    assert {(r.n, r["median"]) for r in A.outcomes(got.where("case_id = 2")).collect()} == {(0, None)}


def test_suggestions_against_the_rows_they_cite(spark):
    references = [(10, "en", "train", "cat", 2), (11, "en", "train", "cat", 3), (12, "en", "test", "cat", 1), (13, "de", "train", "cat", 1), (14, "en", "train", "dog", 1)]
    items = [
        (1, "m", 1, "en", "cat", [10, 11], 2, 5), (1, "m", 2, "en", "cat", [10], 1, 2), (1, "m", 3, "en", "owl", [], 0, 0), (1, "h", 4, "en", "cat", [10, 10], 1, 4), (1, "h", 5, "en", "dog", [14, 99], 2, 1),
        (1, "h", 6, "en", "fox", [12, 13], 2, 2), (1, "h", 7, "en", "emu", [14], 1, 1), (2, "m", 1, "unknown", "cat", None, None, None), (3, "m", 1, "en", "cat", [10], 1, 2),
    ]
    audited = A.structural_issues(
        spark.createDataFrame(items, "case_id long, lane string, place long, domain string, keyword string, ids array<long>, support_count long, total_frequency long"),
        spark.createDataFrame(references, "id long, domain string, split string, keyword string, frequency long"), spark.createDataFrame([(3, "cat"), (3, "cat")], "case_id long, keyword string"),
    )
    got = {(r.case_id, r.place): r.issues for r in audited.collect()}
    assert got == {
        (1, 1): [], (1, 2): ["duplicate_suggestion"], (1, 3): ["no_dataset_evidence"], (1, 4): ["invalid_support_count"], (1, 5): ["invalid_reference_row"],
        (1, 6): ["invalid_reference_row", "invalid_total_frequency"], (1, 7): ["invalid_total_frequency", "term_not_found_in_cited_transcript"],
        (2, 1): ["invalid_support_count", "no_dataset_evidence", "unknown_should_abstain"], (3, 1): ["already_mentioned_or_synonym"],
    }
    counts = {(r.lane, r.issue): r.n for r in A.issue_counts(audited, ["lane"]).collect()}
    assert counts["m", "units"] == 5 and counts["m", "units_with_issues"] == 4 and counts["h", "invalid_reference_row"] == 2


def test_quotes_must_stand_where_they_say(spark):
    documents = spark.createDataFrame([(1, "a 𝄞 note here", "train"), (2, "held out", "test")], "id long, text string, split string")
    quotes = [(1, 1, 2, 8, "𝄞 note"), (2, 1, 3, 9, "𝄞 note"), (3, 1, 9, 99, "here"), (4, 2, 0, 4, "held"), (5, 7, 0, 1, "x"), (6, 1, 2, 2, ""), (7, 1, None, 2, "a")]
    got = {r.item: r.issues for r in A.quote_issues(spark.createDataFrame(quotes, "item long, id long, start long, end long, quote string"), documents).collect()}
    bad, row = ["fabricated_or_misaligned_quote"], ["invalid_action_reference_row"]
    assert got == {1: [], 2: bad, 3: bad, 4: row, 5: row, 6: bad, 7: bad}


def test_character_runs_are_those_of_a_window(spark):
    texts = ["Ab  c\nd", "", "é𝄞x", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(L.char_runs(F.col("t"), (3, 4))).collect()]
    low = [None if t is None else " ".join(t.lower().split()) for t in texts]
    assert got == [None if s is None else [s[i : i + n] for n in (3, 4) for i in range(len(s) - n + 1)] for s in low]


def test_a_grid_takes_the_better_value_and_keeps_channels_whole(spark):
    draw = random.Random(1)
    word = lambda y: "".join(draw.choices("abcd" if y else "wxyz", k=5))
    rows = [(i, f"ch{i % 8}", float(i % 2), " ".join(word(i % 2) for _ in range(6))) for i in range(48)]
    df = spark.createDataFrame(rows, "dataset_id long, channel string, y double, text string").withColumn("tokens", F.split("text", " "))
    value, scores = L.grid_search(L.hashed(df, words=256, runs=512).cache(), "nb")
    got = {r.value: (r.n, r.macro_recall) for r in scores.collect()}
    assert set(got) == set(L.GRIDS["nb"]) and {n for n, _ in got.values()} == {48} and got[value][1] == max(m for _, m in got.values()) > 0.9
    assert L.folds(df, 2).groupBy("channel").agg(F.count_distinct("fold").alias("k")).where("k > 1").count() == 0
