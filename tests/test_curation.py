"""Replacement plans, enrichment, saved groups, label bundles, counted observations, discovered phrases and closest centroids."""

import hashlib
import random
from collections import Counter

from trendloom.operators import curation as C
from trendloom.operators import discovery as D
from trendloom.operators import textml as X

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def counted(rows, catalog):
    """Observations read row by row."""
    out = {}
    for obs in {r[0] for r in rows if r[0] is not None}:
        mine, seen, ranks, totals, invalid, duplicates = [r for r in rows if r[0] == obs], set(), set(), Counter(), 0, 0
        for _, video, rank, _, topics in sorted(mine, key=lambda r: (r[2] if r[2] is not None else 999, r[3])):
            if video is None or rank is None or not 1 <= rank <= 50:
                invalid += 1
            elif video in seen:
                duplicates += 1
            elif rank in ranks:
                invalid += 1
            else:
                seen.add(video)
                ranks.add(rank)
                totals.update(set(topics or []))
        out |= {(obs, t): (totals[t], len(mine), len(seen), invalid, duplicates, "insufficient_source" if invalid else "complete") for t in catalog}
    return out


def test_count_observations_row_by_row(spark):
    rnd, rows = random.Random(6), []
    for obs, n, m, ranks in (("few", 12, 20, 60), ("ties", 400, 25, 12), ("hot", 3000, 90, 50), ("clean", 5, 0, 0)):
        for i in range(n):
            video = i if obs == "clean" else rnd.choice([*range(m), None] if obs == "few" else range(m))
            rows.append((obs, video, i + 1 if obs == "clean" else rnd.choice([*range(1, ranks + 1), None, 0]), i, rnd.choice([["a"], ["a", "b", "b"], [], None])))
    rows += [(None, 1, 1, 1, ["a"]), ("empty", None, None, 0, None)]
    table = spark.createDataFrame(rows, "obs string, video_id long, rank long, place long, topics array<string>")
    got = {(r.obs, r.topic): (r.videos, r.source_rows, r.eligible, r.invalid, r.duplicates, r.quality) for r in D.count_observations(table, ["a", "b", "c"], ["obs"]).collect()}
    assert got == counted(rows, "abc") and got["clean", "c"][-1] == "complete"
    assert D.count_observations(table.limit(0), ["a"], ["obs"]).count() == 0


def test_discover_topics(spark):
    titles = [(1, "Cheap Flights to Rome", "A"), (2, "cheap flights in May", "B"), (3, "CHEAP flights 2024", "A"), (4, "cheap flights 2024!", "C"), (5, "the Rome of May", None), (6, None, "A"), (7, "...", "A"), (8, "cheap cheap flights", "A")]
    got = {r.phrase: (r.label, r.n, r.nc) for r in D.discover_topics(spark.createDataFrame(titles, "video_id long, title string, channel string")).collect()}
    # 3 and 4 are one title, which counts for the channel of 3; the label is the commonest spelling
    assert got == {"cheap": ("cheap", 4, 2), "flights": ("flights", 4, 2), "cheap flights": ("cheap flights", 4, 2)}
    assert D.discover_topics(spark.createDataFrame(titles, "video_id long, title string, channel string").limit(0)).count() == 0


def test_replacement_plan(spark):
    long = "word " * 60
    row = lambda i, **k: {"dataset_id": i, "active": True, "manual": True, "leaf": "en", "title": f"T{i}", "creator": "ann", "text": f"old {i}"} | k
    rows = [row(1), row(2), row(3, active=False), row(4, manual=None), row(5, text="five"), row(6, text=long + "a"), row(7, text=None), row(8), row(8), row(9), row(10)]
    entry = lambda n, i, **k: {"entry_id": n, "parsed": True, "target": i, "declared": i, "leaf": "en", "title": f"T{i}", "text": f"new text {n}"} | k
    entries = [
        entry(1, 1), entry(2, 2, text=" old 2 "), entry(3, 3), entry(4, 4), entry(5, 5, text="old 1"), entry(6, 6, title="other", text=long + "b"), entry(7, 7, title="T7 | ann"), entry(8, 8), entry(9, 99), entry(10, None), entry(11, 9, declared=1, leaf="de"),
        entry(12, 10, parsed=None), entry(13, 10, text="  "), entry(14, 1, leaf="de"), entry(15, 9, title="what"),
    ]
    reviews = [{"dataset_id": 6, "sha256": sha(long + "b")}, {"dataset_id": 6, "sha256": sha(long + "b")}]
    make = lambda x, s: spark.createDataFrame([tuple(r.values()) for r in x], s)
    got = C.replacement_plan(
        make(entries, "entry_id long, parsed boolean, target long, declared long, leaf string, title string, text string"), make(rows, "dataset_id long, active boolean, manual boolean, leaf string, title string, creator string, text string"),
        make(reviews, "dataset_id long, sha256 string"),
    ).collect()
    assert {r.entry_id: (r.status, r.reason, r.batch, r.warnings) for r in got} == {
        1: ("blocked", None, "same_row", ""), 2: ("unchanged", None, "", ""), 3: ("blocked", "archived", "", ""), 4: ("blocked", "other_method", "", ""), 5: ("blocked", "copy_of_other_row", "", ""),
        6: ("ready", None, "", "reviewed_title"), 7: ("ready", None, "", "creator_in_title"), 8: ("blocked", "no_single_row", "", ""), 9: ("blocked", "no_single_row", "", ""), 10: ("blocked", "id_mismatch", "", ""),
        11: ("blocked", "id_mismatch", "same_row", ""), 12: ("blocked", "not_parsed", "", ""), 13: ("blocked", "no_text", "", ""), 14: ("blocked", "other_category", "same_row", ""), 15: ("blocked", "title_differs", "same_row", ""),
    }


def test_enrich(spark):
    schema = "run string, key long, title string, channel string, views long"
    stored = [("r", 1, "t", "", None), ("r", 2, "t", "own", 5), ("r", 3, "changed", None, None), ("q", 1, "t", None, None), (None, 1, "t", None, None), ("r", 4, None, None, 1)]
    sample = [("r", 1, "t", "early", 1, 0), ("r", 1, "t", "late", 2, 1), ("r", 2, "t", "x", 9, 0), ("r", 3, "t", "x", 9, 0), (None, 1, "t", "x", 9, 0), ("r", 4, None, "x", None, 0)]
    got = C.enrich(spark.createDataFrame(stored, schema), spark.createDataFrame(sample, schema + ", seq long"), ["run", "key"], "title", ["channel"], ["views"], "seq")
    assert {(r.run, r.key): (r.title, r.channel, r.views, r.enriched) for r in got.collect()} == {
        ("r", 1): ("t", "late", 2, True), ("r", 2): ("t", "own", 5, False), ("r", 3): ("changed", None, None, False), ("q", 1): ("t", None, None, False), (None, 1): ("t", None, None, False), ("r", 4): (None, "x", 1, True),
    }


def test_saved_groups(spark):
    rows = [(i, i, f"c{i}", i * 10, i % 2 == 0, cell) for cell, lo in (("a", 1), ("b", 21), ("c", 41)) for i in range(lo, lo + 9)] + [(1, 90, "c1", 10**6, True, "a")]  # a second row of video 1
    table = spark.createDataFrame(rows, "video_id long, dataset_id long, channel string, views long, detected boolean, cell string")
    saved = spark.createDataFrame([("a", 50, 9), ("b", 250, 9), ("c", 450, 8), ("gone", 1, 1)], "cell string, threshold long, benchmark_count long")
    members = spark.createDataFrame([("a", 6), ("a", 8), ("a", 8), ("b", 26), ("b", 27), ("c", 46), ("c", 48), ("gone", 7)], "cell string, video_id long")
    got = {r.cell: (r.derived_threshold, r.n, r.only_derived, r.only_saved, r.in_both, r.accepted) for r in C.saved_groups(table, saved, members, ["cell"]).collect()}
    assert got == {"a": (50, 9, 0, 0, 2, True), "b": (250, 9, 1, 1, 1, False), "c": (450, 9, 0, 0, 2, False), "gone": (None, 0, 0, 1, 0, False)}


def test_bundle_issues(spark):
    s = lambda i, split="train", video=None, title=None: (split, i, video or i, title or f"title {i}", sha(title or f"title {i}"))
    samples = [s(i) for i in range(1, 13)] + [s(12), s(20, "test", video=1), s(21, "test", title="title 2"), ("test", 22, 22, "title 22", None), ("test", 23, 23, None, None)]
    lab = lambda i, status, topics=(), quotes=(), split="train", who="ann", note=None, title=None, video=None: (split, i, video or i, title or f"title {i}", status, list(topics), list(quotes), who, note)
    labels = [
        lab(1, "pending", who=None), lab(2, "labeled", ["t"], ["title"]), lab(3, "labeled", ["t"], ["Title"]), lab(4, "labeled"), lab(5, "no_topic", ["t"], ["title"]), lab(6, "labeled", ["t", "t"], ["title", "6"]), lab(7, "labeled", ["t", " "], ["title", "7"]),
        lab(8, "ambiguous"), lab(9, "ambiguous", note="why", who=" "), lab(10, "what"), lab(11, "no_topic", title="edited"), lab(12, "no_topic"), lab(12, "no_topic"), lab(99, "no_topic"), lab(20, "no_topic", split="test", video=1),
        lab(21, "labeled", ["t"], ["title 2"], split="test", title="title 2"), ("test", 22, 22, "title 22", "no_topic", None, None, "ann", None), ("test", 23, 23, None, "labeled", ["t"], ["q"], "ann", None),
    ]
    got = C.bundle_issues(
        spark.createDataFrame(samples, "split string, sample_id long, video_id long, title string, title_sha256 string"),
        spark.createDataFrame(labels, "split string, sample_id long, video_id long, title string, status string, topics array<string>, evidence array<string>, annotator string, notes string"),
    )
    assert {r.sample_id: r.issues for r in got.collect()} == {
        1: "duplicate_video", 2: "duplicate_title", 3: "topics", 4: "topics", 5: "topics", 6: "topics", 7: "topics", 8: "note", 9: "annotator", 10: "status", 11: "edited", 12: "duplicate_sample,duplicate_title,duplicate_video,label_twice", 99: "label_added",
        20: "duplicate_video", 21: "duplicate_title", 22: "digest", 23: "topics",
    }


def test_closest_centroids(spark):
    unit = lambda *v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    rows = spark.createDataFrame([(1, unit(1.0, 0.1, 0.0)), (2, unit(1.0, 1.0, 0.0)), (3, unit(-1.0, -1.0, -0.2)), (4, unit(1.0, 0.99, 0.0)), (5, unit(0.0, 0.0, 1.0))], "id long, vec array<double>")
    means = [(0, [2.0, 0.0, 0.0]), (1, [0.0, 3.0, 0.0])]
    got = {r.id: (r.first_label, r.second_label, r.state) for r in X.closest_centroids(rows, spark.createDataFrame(means, "g long, vec array<double>"), "g").collect()}
    assert got == {1: (0, 1, "ready"), 2: (0, 1, "text_centroid_tie"), 3: (0, 1, "no_semantic_similarity"), 4: (0, 1, "similar_text_distances"), 5: (0, 1, "no_semantic_similarity")}
    near = means[:1] + [(1, [2.0, 0.02, 0.0])]
    assert {r.state for r in X.closest_centroids(rows.where("id = 1"), spark.createDataFrame(near, "g long, vec array<double>"), "g").collect()} == {"overlapping_text_centroids"}
    assert X.closest_centroids(rows, spark.createDataFrame(means[:1], "g long, vec array<double>"), "g").count() == 0


def test_entries_without_key_do_not_meet_in_one_task(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, value in zip(kept, ("false", "-1")):
        spark.conf.set(k, value)
    try:
        entries = spark.range(400).selectExpr("id AS entry_id", "false AS parsed", "id AS target", "id AS declared", "'a' AS leaf", "'t' AS title", "'text' AS text")
        rows = spark.range(400).selectExpr("id AS dataset_id", "true AS active", "true AS manual", "'a' AS leaf", "'t' AS title", "'c' AS creator", "'text' AS text")
        got = C.replacement_plan(entries, rows, rows.selectExpr("dataset_id", "'x' AS sha256").limit(1))
        sizes = [len(part) for part in got.select("entry_id").rdd.glom().collect()]
    finally:
        for k, value in kept.items():
            spark.conf.set(k, value)
    assert sum(sizes) == 400 and max(sizes) < 200  # none has a text or a row to its name, all were dealt to one task
