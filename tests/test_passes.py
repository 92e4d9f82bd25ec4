"""Words and phrases counted text by text, and how often queries read the texts."""

import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trendloom.functions.text import phrase_counts
from trendloom.operators import models, readiness
from trendloom.plans import learning, registry
from trendloom.sources.views import Views

SF = "/root/testdata/sf0.001"


def scans(df) -> int:
    """How often a plan reads the texts."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("text#" in columns for columns in re.findall(r"FileScan parquet \[([^]]*)\]", plan))


def test_phrases_are_counted_like_in_plain_python(spark):
    texts = [None, [], ["a"], ["a", "b", "a", "b", "a"], ["x"] * 20_000, ["ä", "ß", "ä", "ß", "\U00020000"]]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, ws array<string>").select("id", F.inline(phrase_counts(F.col("ws"), 3))).collect()
    want = set()
    for i, ws in enumerate(texts):
        for k in (1, 2, 3):
            for g, n in Counter(zip(*[(ws or [])[j:] for j in range(k)])).items():
                want |= {(i, k, " ".join(g), n)} if k == 1 or n >= 2 else set()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)


@pytest.mark.parametrize("name, most", [("f17_bigram_candidates", 1), ("m01_tf_vectors", 1), ("m09_centroid_classifier", 0), ("a06_keyword_evidence", 0), ("a42_structural_audit", 0), ("a63_evidence_correctness", 2)])
def test_texts_are_read_few_times(spark, name, most):
    """Reads of the plan that is left; a stored intermediate result is read in place of the texts."""
    assert scans(registry.queries()[name](spark, SF)) <= most


def test_folds_share_hashed_words_and_k_means_reads_stored_shares(spark, monkeypatch):
    stored = []
    for module in (models, learning):
        monkeypatch.setattr(module, "checkpointed", lambda df, keep=module.checkpointed: stored.append(set(df.columns)) or keep(df))
    assert registry.queries()["m11_grouped_cross_validation"](spark, SF).count() == 3
    assert registry.queries()["m02_kmeans_texts"](spark, SF).count() == 4
    assert {"dataset_id", "channel", "fold", "y", "tf"} in stored and {"dataset_id", *(f"t{i}" for i in range(20))} in stored and not any("text" in x for x in stored)


def joined(plan) -> set:
    """The columns that leave the joins of a plan."""
    below = [plan.children().apply(i) for i in range(plan.children().size())]
    own = {plan.output().apply(i).name() for i in range(plan.output().size())} if plan.nodeName() == "Join" else set()
    return own.union(*map(joined, below))


def test_texts_are_not_dealt_out_for_issues_of_training_rows(spark):
    rows = spark.createDataFrame([(i, "en", "train", "train", 1, f"text {i % 5}") for i in range(60)], "dataset_id long, leaf string, split string, stored_split string, quality long, text string")
    assert "text" not in joined(readiness.training_issues(rows, 5)._jdf.queryExecution().optimizedPlan())


def test_users_and_keys_meet_once(spark, tmp_path):
    customers = [(1, 7), (1, 8), (3, 7), (3, 7), (6, 9)]
    spark.createDataFrame([(u, "n", r, 1.0, "s") for u, r in customers], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    events = [(i, f"2024-01-0{i % 3 + 1} 10:00:00", [7, 8, 9, 7, 8][i % 5], ["error", "view"][i % 2], float(i)) for i in range(30)]
    spark.createDataFrame(events, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    got = registry.queries()["j09_follow_interests"](spark, str(tmp_path))
    top = [tuple(r) for r in Views(spark, str(tmp_path)).items.where("rank <= 3").select("platform", "key", "rank").collect()]
    want = {(u, p, k) for u, r in customers for p, k, rank in top if r == k or (u % 3 == 0 and p == "error" and rank == 1)}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert "Aggregate [user_id" not in got._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_runs_hashed_in_numpy_are_those_of_hashing_tf(spark):
    texts = ["", "ab", "abc", "Ab  c\nd", "é𝄞x ÄÖ ß", "x" * 5000, "日本語 text und mehr " * 40]
    low = [re.sub(r"\s+", " ", t.lower()) for t in texts]
    runs = [[s[i : i + n] for n in (3, 4, 5) for i in range(len(s) - n + 1)] for s in low]  # a character of four bytes begins one run of each size
    rows = spark.createDataFrame([(i, t, t.split(), r) for i, (t, r) in enumerate(zip(texts, runs))], "id int, text string, tokens array<string>, runs array<string>")
    want = models.HashingTF(inputCol="tokens", outputCol="w", numFeatures=64).transform(rows)
    want = models.HashingTF(inputCol="runs", outputCol="r", numFeatures=500).transform(want)
    got = {r.id: r.tf.toArray().tolist() for r in models.hashed(rows.drop("runs"), words=64, runs=500).collect()}
    assert got == {r.id: [*r.w.toArray().tolist(), *r.r.toArray().tolist()] for r in want.collect()}


def test_classifiers_share_the_weights_of_a_fold(spark, monkeypatch):
    fits = []
    monkeypatch.setattr(models, "scale", lambda rows, scale=models.scale: fits.append(1) or scale(rows))
    registry.queries()["m10_text_classifiers"](spark, SF)
    assert len(fits) == 3  # two folds and all training rows, for the three classifiers of texts together


def test_vectors_are_stored_once_in_columns(spark):
    folder = models.shared_folder(spark).removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files)
    draw, before = random.Random(3), size()
    words = ["".join(draw.choices("abcdefghij", k=6)) for _ in range(2000)]
    rows = [(i, " ".join(draw.choices(words, k=400))) for i in range(120)]
    got = models.hashed(spark.createDataFrame(rows, "id int, text string").withColumn("tokens", F.split("text", " ")).coalesce(1))
    entries = sum(len(r.tf.indices) for r in got.collect())
    assert entries > 100_000 and size() - before < 4 * entries  # rows of vectors alone take twelve bytes an entry


def test_many_rows_have_one_copy_at_a_time(spark, monkeypatch):
    pools = []
    monkeypatch.setattr(models, "ThreadPool", lambda n, pool=models.ThreadPool: pools.append(n) or pool(n))
    data = [(f"c{i}", float(i % 2), [float(i % 2), 1.0]) for i in range(24)]
    rows = spark.createDataFrame(data, "channel string, y double, v array<double>").select("channel", "y", learning.array_to_vector("v").alias("vector")).cache()
    few = models.grid_search(rows, "vectors")
    monkeypatch.setattr(models, "FEW", 10)
    assert models.grid_search(rows, "vectors")[0] == few[0] and pools == [models.AT_ONCE, 1]
    rows.unpersist()
