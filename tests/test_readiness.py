"""Coverage reports, gaps, snapshot changes, paired topics, category plans and training issues against plain Python."""

import datetime
import random
import statistics

from pyspark.sql import functions as F

from trendloom.operators import history as H
from trendloom.operators import readiness as R
from trendloom.operators import trend as T
from trendloom.plans.aggregates import compared
from trendloom.sources.views import Views

HOUR = H.HOUR
ATTEMPT = "scope string, key long, us long, failed boolean"


def report(rows):
    """The report of one table by loops over its points."""
    rows = [r for r in rows if None not in (r[0], r[2], r[3])]
    hours = sorted({r[2] // HOUR for r in rows})
    end, out = max(r[2] for r in rows), {}
    for scope in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == scope]
        good, bad = sorted(r[2] for r in mine if not r[3]), [r[2] for r in mine if r[3]]
        points = sorted({x for h in hours for x in ([y for y in good if y // HOUR == h][:1] + [y for y in good if y // HOUR == h][-1:])})
        gaps = sum(b - a > H.GAP or any(a < f <= b for f in bad) for a, b in zip(points, points[1:]))
        seen = {}
        for _, key, us, failed in mine:
            if not failed and key is not None:
                seen.setdefault(key, set()).add(us // HOUR)
        last = [k for k, hs in seen.items() if good and good[-1] // HOUR in hs]
        summary = (len(points), len({x // HOUR for x in points}), gaps, len(bad), good[0] if good else None, good[-1] if good else None, not good or end - good[-1] > H.GAP,
                   bool(bad) and (not good or max(bad) >= good[-1]), min(last, key=lambda k: (-len(seen[k]), k)) if last else None)
        for h in range(hours[0], hours[-1] + 1):
            day = datetime.date(1970, 1, 1) + datetime.timedelta(days=(h + 7) // 24)
            g, b = any(x // HOUR == h for x in good), sum(x // HOUR == h for x in bad)
            d = out.setdefault((scope, day), [0, 0, 0, 0, summary])
            d[0] += g
            d[1] += g and b > 0
            d[2] += not g
            d[3] += b
    return {k: tuple(v) for k, v in out.items()}


def test_coverage_report_against_loops(spark):
    rnd = random.Random(4)
    for n in (1, 12, 90, 400):
        rows = [(rnd.choice("abc"), rnd.choice([1, 2, 3, None]), rnd.randrange(0, 60 * HOUR, HOUR // 4), rnd.random() < 0.3) for _ in range(n)] + [("a", 1, 5 * HOUR, True), ("a", 2, 5 * HOUR, False)]
        rows += [(None, 1, 0, False), ("a", 1, None, False), ("a", 1, 0, None), ("d", 7, 9 * HOUR, True)]  # left out but for the scope that only failed
        got = H.coverage_report(spark.createDataFrame(rows, ATTEMPT)).collect()
        names = "points hours_observed gap_count failed_total first_us last_us is_stale latest_unavailable default_key".split()
        assert {(r.scope, r.day): (r.observed_hours, r.partial_hours, r.unobserved_hours, r.failed_attempts, tuple(r[x] for x in names)) for r in got} == report(rows)
    assert H.coverage_report(spark.createDataFrame([], ATTEMPT)).count() == 0


def test_gap_flags(spark):
    m = 60_000_000
    rows = [("a", 1, 0, "complete"), ("a", 2, 90 * m, "complete"), ("a", 3, 181 * m, "complete"), ("a", 4, 182 * m, "failed"), ("a", 5, 183 * m, "complete"), ("b", 6, 0, "failed"), ("b", 7, 1, "complete"), (None, 8, 5, "complete")]
    got = H.gap_flags(spark.createDataFrame(rows, "entity string, obs_id long, us long, status string"))
    assert {r.obs_id: (r.gap_us, r.interrupted, r.gap_before) for r in got.collect()} == {
        1: (None, False, False), 2: (90 * m, False, False), 3: (91 * m, False, True), 5: (2 * m, True, True), 7: (None, False, False), 8: (None, False, False),
    }


def test_snapshot_changes(spark):
    day = lambda d: datetime.datetime(2024, 1, d)
    runs = [("p", day(1), 12, "ok"), ("p", day(2), 1, "failed"), ("p", day(3), 11, "ok"), ("p", day(4), 1, "ok")]
    items = [("p", day(1), i, i, float(100 - i), "v1") for i in range(1, 13)] + [("p", day(3), 2, 1, 196.0, "v1"), ("p", day(3), 1, 2, 49.5, "v1"), ("p", day(3), 99, 3, 5.0, "v1"), ("p", day(4), 2, 1, 7.0, "v2")]
    got = T.snapshot_changes(spark.createDataFrame(items, "platform string, run_at timestamp_ntz, key long, rank long, score double, metric_version string"), spark.createDataFrame(runs, "platform string, run_at timestamp_ntz, n_items long, status string"))
    rows = {(r.run_at.day, r.key): r for r in got.collect()}
    assert len(rows) == 16 and {k for (d, k), r in rows.items() if d == 1 and r.status == "Hot"} == {1, 2} and {r.change_kind for (d, _), r in rows.items() if d == 1} == {"baseline"}
    two = rows[3, 2]
    assert (two.rank_change, two.delta, two.percent, two.change_kind, two.status) == (1, 98.0, 100.0, "rank_up", "Hot") and two.per_minute == 98.0 / 2880
    assert (rows[3, 1].change_kind, rows[3, 1].percent, rows[3, 99].change_kind, rows[3, 99].is_new, rows[3, 99].delta) == ("rank_down", -50.0, "new", True, 0.0)
    assert (rows[4, 2].metric_changed, rows[4, 2].delta, rows[4, 2].percent, rows[4, 2].change_kind) == (True, 0.0, 0.0, "none")


def paired(rows, topics):
    out = {}
    for leaf, topic in {(r[1], t) for r in rows if None not in r[2:] for t in topics}:
        cells, channels = {}, {}
        for i, lf, ch, st, views, words in rows:
            if lf == leaf and None not in (ch, views, words):
                cells.setdefault((ch, st), {True: [], False: []})[topic in words].append(views)
        both = {k: v for k, v in cells.items() if v[True] and v[False]}
        for (ch, _), v in both.items():
            channels.setdefault(ch, []).append(statistics.median(v[True]) - statistics.median(v[False]))
        diffs = [statistics.median(x) for x in channels.values()]
        sides = [sum(len(v[x]) for v in both.values()) for x in (True, False)]
        lead = abs(sum((d > 0) - (d < 0) for d in diffs))
        status = ("not_comparable" if not both else "reference_only" if min(sides) < 10 or len(diffs) < 5 else "comparison_descriptive" if len(diffs) < 10
                  else "comparison_supported" if lead > 1.96 * len(diffs) ** 0.5 else "comparison_uncertain")
        out[leaf, topic] = (sum(len(v[True]) for v in cells.values()), sum(len(v[False]) for v in cells.values()), len({ch for (ch, _), v in cells.items() if v[True]}), len(both), len(diffs),
                            statistics.median(diffs) if diffs else None, status)
    return out


def test_paired_topics_against_loops(spark):
    rnd, topics = random.Random(9), ["up", "flat", "rare", "never"]
    rows = []
    for i in range(1500):
        words = [w for w, p in (("up", 0.4), ("flat", 0.4), ("rare", 0.01)) if rnd.random() < p]
        leaf = "x" if i % 3 else "y"  # y has seven channels only, and a third of x is one channel
        rows.append((i, leaf, "hot" if leaf == "x" and i % 9 == 1 else f"c{rnd.randrange(7 if leaf == 'y' else 30)}", rnd.choice("st"), rnd.randrange(50) + 100 * ("up" in words), words))
    rows += [(9001, "x", None, "s", 1, ["up"]), (9002, "x", "c1", "s", None, ["up"]), (9003, "x", "c1", "s", 5, None), (9004, "z", "c1", "s", 5, [])]
    table = spark.createDataFrame(rows, "dataset_id long, leaf string, channel string, stratum string, views long, words array<string>")
    got = {(r.leaf, r.topic): (r.detected, r.not_detected, r.channels, r.matched_strata, r.paired_channels, r.difference, r.status) for r in R.paired_topics(table, topics, "words", ["stratum"]).collect()}
    assert got == paired(rows, topics)
    assert {v[-1] for v in got.values()} == {"not_comparable", "reference_only", "comparison_descriptive", "comparison_supported", "comparison_uncertain"}
    actions = spark.createDataFrame([(1, "x", "up"), (2, "x", "flat"), (3, "x", "unheard"), (4, None, "up")], "id long, leaf string, topic string")
    levels = {r.id: (r.level, r.direction) for r in R.explained(actions, R.paired_topics(table, topics, "words", ["stratum"]), ["leaf", "topic"]).collect()}
    assert levels[1] == ("comparison_supported", "higher") and levels[3] == levels[4] == ("reference_examples", None) and levels[2][0] == "comparison_uncertain"
    assert R.paired_topics(table.limit(0), topics, "words", ["stratum"]).count() == 0


def test_median_within(spark):
    rnd = random.Random(1)
    groups = {g: [rnd.randrange(-5, 5) if g % 2 else rnd.randrange(10**6) for _ in range(g)] for g in range(1, 40)}
    rows = [(g, x, i) for g, xs in groups.items() for i, x in enumerate(xs)]
    got = R.median_within(spark.createDataFrame(rows, "g long, x long, i long"), ["g"], "x", "i").collect()
    assert {r.g: (r.n, r.median) for r in got} == {g: (len(xs), statistics.median(xs)) for g, xs in groups.items()}


def test_category_plan(spark):
    rows = [(i, "a", "big" if i < 60 else f"c{i}", "train", "v2", 10, i) for i in range(100)] + [(200 + i, "b", None, "test", "v1" if i else "v2", 999, 1) for i in range(3)] + [(300, None, "c", "train", "v1", 1, 1)]
    table = spark.createDataFrame(rows, "dataset_id long, leaf string, channel string, split string, metric_version string, duration long, likes long")
    got = {r.leaf: r for r in R.category_plan(table, {"likes": F.col("likes") > 0, "none": F.lit(None).cast("boolean")}).collect()}
    assert set(got) == {"a", "b"}
    a, b = got["a"], got["b"]
    assert (a.n, a.channels, a.largest_share, a.n_train, a.n_test, a.durations, a.missing_likes, a.missing_none, a.upper_pool, a.comparison_pool) == (100, 41, 0.6, 100, 0, 100, 1, 100, 40, 60)
    assert a.actions == "mend_fields,more_test,more_validation,one_channel_dominates"
    assert (b.n, b.channels, b.largest_share, b.metric_version, b.cohort, b.upper_pool, b.comparison_pool, b.durations) == (3, 0, 0.0, "v1", 2, 1, 1, 0)


def test_training_issues(spark):
    rows = [(i, f"text {i}", "en", 1, "train", "train") for i in range(40)]
    rows += [(100, "text 1", "de", 1, "train", "train"), (101, "text 2", "en", 1, "test", "test"), (102, None, "en", None, "train", "test"), (103, None, "en", 1, "test", "test"), (104, " ", "en", 1, "train", "train")]
    got = R.training_issues(spark.createDataFrame(rows, "dataset_id long, text string, leaf string, quality long, stored_split string, split string"), 10).collect()
    issues = {r.dataset_id: set(r.issues.split(",")) - {"", "reserved"} for r in got}
    assert issues.pop(1) == {"leaf_conflict"} and issues.pop(2) == {"holdout_text"} and issues.pop(100) == {"leaf_conflict", "few_rows"} and issues.pop(102) == {"unreviewed", "empty", "split_mismatch"} and issues.pop(104) == {"empty"}
    assert set(map(frozenset, issues.values())) == {frozenset()} and 101 not in issues
    assert 3 < sum("reserved" in r.issues for r in got) < 20


def test_comparisons_read_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    n = Views(spark, sf).content.count()
    assert compared(Views(spark, sf)).groupBy("topic").agg(F.sum(F.col("detected") + F.col("not_detected")).alias("n")).where(F.col("n") != n).count() == 0
