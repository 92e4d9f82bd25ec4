"""Hand-made boundary cases, invariants and plans of the library's operators."""

import random

import pytest
from pyspark.sql import functions as F

from trendloom.functions import metrics as M
from trendloom.functions import text as T
from trendloom.functions.reasons import all_reasons, first_reason
from trendloom.functions.splits import channel_split
from trendloom.operators import benchmark as B
from trendloom.operators import guards, models, sketches, textml, trend
from trendloom.operators.components import identity_components
from trendloom.sources import sinks

c = F.col


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x if values else spark.range(1).select(column.alias("x")).first().x


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, M.iso_seconds(lit("P1DT2H3M4S"))) == 93784 and one(spark, M.iso_seconds(lit("2:03"))) is None
    assert [one(spark, M.count_text(lit(t))) for t in ("1.2M+", "12,345 views", "3K", "none")] == [1_200_000, 12_345, 3_000, None]
    assert one(spark, M.video_id(lit("https://www.youtube.com/watch?v=abcdefghijk&t=1"))) == "abcdefghijk"
    assert one(spark, M.video_id(lit("https://youtube.com.evil.org/watch?v=abcdefghijk"))) is None
    assert [one(spark, M.canonical_count(lit(t))) for t in ("0", "12", "012", "-1", "9223372036854775807", "9223372036854775808")] == [0, 12, None, None, 9223372036854775807, None]
    assert [one(spark, M.age_bucket(lit(d))) for d in (-0.1, 0.0, 6.99, 7.0, 364.9, 365.0)] == ["invalid", "0-7", "0-7", "7-30", "90-365", "365+"]
    assert one(spark, T.phrase_count(lit("The the other THE"), "the")) == 3
    assert [one(spark, T.csv_safe(lit(t))) for t in ("=1+1", "-x", "plain")] == ["'=1+1", "'-x", "plain"]
    assert one(spark, T.normal(lit(" a&amp;lt; \n b "))) == "a&lt; b"


def test_reasons(spark):
    df = spark.createDataFrame([(1, None), (5, 2), (None, 9)], "a int, b int")
    rows = df.select(all_reasons((c("a") < 3, "z_low"), (c("b").isNull(), "no_b")).alias("all"), first_reason((c("a") < 3, "low"), (c("b") > 5, "high")).alias("first")).collect()
    assert [tuple(r) for r in rows] == [("no_b,z_low", "low"), ("", None), ("", "high")]


def test_channels_are_in_one_split(spark):
    df = spark.range(1000).select(channel_split(c("id").cast("string")).alias("s")).groupBy("s").count()
    n = {r.s: r["count"] for r in df.collect()}
    assert abs(n["train"] - 700) < 60 and abs(n["test"] - 150) < 50


def test_anti_joins_skip_empty_keys(spark):
    train = spark.createDataFrame([(1, "a", None), (2, "b", "g"), (3, "c", ""), (4, "d", "h")], "id int, channel string, grp string")
    held = spark.createDataFrame([("d", None), ("x", "g"), ("y", "")], "channel string, grp string")
    got = guards.without_leaks(train, held, ["channel", "grp"])
    assert sorted(r.id for r in got.collect()) == [1, 3] and got.columns == train.columns
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_components(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "y"), (4, "c", None), (5, None, None), (6, "d", "q"), (7, "d", "q")], "id long, k1 string, k2 string")
    got = {r.id: r.component for r in identity_components(rows, "id", ["k1", "k2"]).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 6}
    chain = spark.range(40).select("id", F.floor(c("id") / 2).cast("string").alias("k1"), F.floor((c("id") + 1) / 2).cast("string").alias("k2"))
    assert {r.component for r in identity_components(chain, "id", ["k1", "k2"]).collect()} == {0}


def test_growth_pair_boundaries(spark):
    h = 3_600_000_000
    mk = lambda e, hours, status="complete", version="v1": (e, int(hours * 10), int(hours * h), status, int(hours), version)
    rows = [mk(1, 0), mk(1, 12), mk(1, 24), mk(2, 0), mk(2, 10, "failed"), mk(2, 24), mk(3, 0), mk(3, 37), mk(4, 0, version="v0"), mk(4, 24), mk(5, 0), mk(5, 11), mk(6, 0), mk(6, 36)]
    df = spark.createDataFrame(rows, "entity int, obs_id int, us long, status string, counter long, metric_version string")
    got = {r.entity: (r.e_id, r.gain) for r in trend.growth_pairs(df).collect()}
    assert got == {1: (0, 24), 6: (0, 36)}


def test_intervals_and_islands(spark):
    rows = [(1, 1, 0, "complete", 5, "a"), (1, 2, 10, "complete", 4, "a"), (1, 3, 20, "failed", 9, "a"), (1, 4, 30, "complete", 9, "b"), (1, 5, 40, "complete", 9, "a"), (1, 6, 50, "complete", 12, "a")]
    df = spark.createDataFrame(rows, "entity int, obs_id int, us long, status string, counter long, metric_version string")
    assert [r.kind for r in trend.intervals(df).orderBy("obs_id").collect()] == ["first", "counter_decreased", "missing", "missing", "metric_changed", "measured"]
    grid = spark.createDataFrame([("p", i, s) for i, s in enumerate("aabba")], "k string, i int, s string")
    assert sorted((r.s, r["first"], r["last"], r.n) for r in trend.islands(grid, ["k"], "i", "s").collect()) == [("a", 0, 1, 2), ("a", 4, 4, 1), ("b", 2, 3, 2)]


def test_as_of_run(spark):
    import datetime as d

    day = lambda n: d.datetime(2024, 1, n)
    runs = spark.createDataFrame([("p", day(1), 1, "ok"), ("p", day(2), 1, "failed"), ("p", day(3), 1, "ok"), ("p", day(5), 1, "ok")], "platform string, run_at timestamp_ntz, n_items int, status string")
    got = {r.run_at.day: r.as_of and r.as_of.day for r in trend.as_of_run(runs, 2).collect()}
    assert got == {1: None, 2: None, 3: 1, 5: 3}


def test_weighted_median_balances_channels(spark):
    rows = [("g", "a", i, 100 + i) for i in range(9)] + [("g", "b", 20, 1), ("g", "c", 21, 2)]
    df = spark.createDataFrame(rows, "cell string, channel string, dataset_id int, views long")
    assert B.weighted_median(df, ["cell"]).first().threshold == 2
    assert B.weighted_median(df.limit(0), ["cell"]).count() == 0


def test_weighted_median_against_a_plain_loop(spark):
    import random

    rnd = random.Random(3)
    rows = [(rnd.choice("gh"), rnd.choice("abcde"), i, rnd.randint(0, 50) ** 3) for i in range(300)]
    df = spark.createDataFrame(rows, "cell string, channel string, dataset_id int, views long")
    for r in B.weighted_median(df, ["cell"]).collect():
        own = sorted((x[3], x[2], x[1]) for x in rows if x[0] == r.cell)
        n = {k: sum(x[2] == k for x in own) for k in "abcde"}
        cum, half = 0.0, sum(k > 0 for k in n.values()) / 2
        for value, _, ch in own:
            cum += 1 / n[ch]
            if cum + 1e-9 >= half:
                break
        assert r.threshold == value


def test_ranks_with_ties_and_equal_groups(spark):
    from trendloom.operators.ranking import rank_within

    rows = [("a", i, float(i % 4)) for i in range(20)] + [("b", i, 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, id int, x double")
    want = {}
    for g in "ab":
        for k, (x, i) in enumerate(sorted((-x, i) for h, i, x in rows if h == g)):
            want[g, i] = k + 1
    assert {(r.g, r.id): r["rank"] for r in rank_within(df, ["g"], "x", "id", bins=3).collect()} == want


def test_auc(spark):
    df = spark.createDataFrame([("x", 1, 0.9), ("x", 0, 0.1), ("x", 1, 0.5), ("x", 0, 0.5), ("y", 1, 0.3)], "s string, label int, score double")
    assert {r.s: r.auc for r in B.area_under_roc(df, ["s"]).collect()} == {"x": 0.875, "y": None}


def test_bootstrap_interval(spark):
    rows = [("a", str(i), float(i)) for i in range(21)] + [("few", str(i), float(i)) for i in range(9)] + [("flat", str(i), 1.0) for i in range(12)]
    values = spark.createDataFrame(rows, "grp string, id string, value double").withColumnRenamed("grp", "g")
    got = {r.grp: r for r in sketches.bca_interval(values, "g").collect()}
    assert got["a"].point == 10 and got["a"].low <= 10 <= got["a"].high and got["a"].low < got["a"].high
    assert got["few"].low is None and got["flat"].high is None
    again = {r.grp: r for r in sketches.bca_interval(values, "g").collect()}
    assert again["a"] == got["a"]


def test_upsert(spark):
    old = spark.createDataFrame([(1, None, "a"), (2, "k", "b")], "id int, key string, value string")
    new = spark.createDataFrame([(1, None, "x", 1), (1, None, None, 2), (3, "n", "c", 1)], "id int, key string, value string, seq int")
    got = {(r.id, r.key): (r.value, r.state) for r in sinks.upsert(old, new, ["id", "key"], "seq").collect()}
    assert got == {(1, None): ("x", "updated"), (2, "k"): ("b", "kept"), (3, "n"): ("c", "created")}


def test_kmeans_keeps_rows(spark):
    df = spark.createDataFrame([(i, float(i // 5) * 100 + i) for i in range(10)], "id int, x double")
    got = models.clusters(df, ["x"], 2).collect()
    assert len(got) == 10 and len({r.cluster for r in got if r.id < 5}) == 1 and len({r.cluster for r in got}) == 2
    assert len({r.cluster for r in models.clusters(df.withColumn("x", F.lit(1.0)), ["x"], 2).collect()}) >= 1


def test_folds_keep_channels_whole(spark):
    df = spark.range(200).select(c("id"), (c("id") % 17).cast("string").alias("channel"))
    assert models.folds(df, 4).groupBy("channel").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0


def test_unit_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(textml.unit(c("v")).alias("u"))
    assert [r.u for r in df.collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_filters_reach_the_scan(spark):
    from trendloom.sources.views import Views

    v = Views(spark, "/root/testdata/sf0.001")
    plan = v.events.where("event_type = 'view'").select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,view)" in plan and "props" not in plan



def test_text_functions_read_every_script(spark):
    from trendloom.functions import text as T

    data = [(1, "รีวิว โทรศัพท์ รีวิว 2024"), (2, "Москва — МОСКВА город"), (3, "!!! ..."), (4, ""), (5, None), (6, "Review, review; the phone!")]
    rows = spark.createDataFrame(data, "i int, t string")
    t = F.col("t")
    got = {r.i: r for r in rows.select("i", T.tokens(t).alias("w"), T.identity(t).alias("d"), T.clean(t).alias("c"), T.phrase_count(t, "город").alias("n")).collect()}
    assert got[1].w == ["รีวิว", "โทรศัพท์", "รีวิว"] and got[2].w == ["москва", "москва", "город"] and got[6].w == ["review", "review", "phone"]
    assert got[3].d is None and got[4].d is None and got[5].d is None and len({got[i].d for i in (1, 2, 6)}) == 3
    assert got[2].c == "москва москва город" and got[2].n == 1
    counts = {r.i: r for r in rows.select("i", T.counted(T.tokens(t)).alias("k"), T.grams(T.tokens(t), 2).alias("g")).collect()}
    assert {x.value: x.n for x in counts[1].k} == {"รีวิว": 2, "โทรศัพท์": 1} and counts[2].g == ["москва москва", "москва город"]
    assert counts[3].k is None and counts[3].g == []


def test_nearest_texts_in_blocks_of_any_size(spark):
    rows = [(d, f"t{t}", ((d * 7 + t * 3) % 11 + 1) / 10) for d in range(45) for t in range(30) if (d * t + d + t) % 4 == 0]
    weights = spark.createDataFrame(rows, "dataset_id long, term string, w double")
    of = {}
    for d, t, w in rows:
        of.setdefault(d, {})[t] = w
    want = set()
    for q in (d for d in of if d % 20 == 0):
        sims = sorted((-round(sum(w * of[q][t] for t, w in x.items() if t in of[q]), 6), d) for d, x in of.items() if d != q and x.keys() & of[q].keys())
        want |= {(q, d, -s) for s, d in sims[:5]}
    for size in (2_000_000, 60):
        got = {tuple(r) for r in textml.nearest_texts(weights, F.col("dataset_id") % 20 == 0, 5, size, size).collect()}
        assert got == want
    assert textml.nearest_texts(weights.limit(0), F.col("dataset_id") % 20 == 0, 5).count() == 0
