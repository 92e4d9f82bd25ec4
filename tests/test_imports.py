"""Candidate lines, review sheets and the import of decisions."""

import hashlib
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from trendloom.operators import reviews as R
from trendloom.plans import registry
from trendloom.sources import artifacts, sinks


def line(**row):
    row["candidate_sha256"] = hashlib.sha256(json.dumps(row, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    return json.dumps(row, ensure_ascii=False)


def test_scan_tells_why_lines_are_rejected(spark, tmp_path):
    forged = json.loads(line(id="e", n=1)) | {"n": 2}
    lines = [line(id="a", n=1), line(id="a", n=2), line(id="a", n=1), line(id="é", n=None), line(id=None, n=1), line(id="  ", n=1), '{"id": "x", ', json.dumps(forged), json.dumps({"id": "f", "n": 1}), ""]
    (tmp_path / "c.jsonl").write_text("\n".join(lines), encoding="utf-8")
    scanned = artifacts.scan_candidates(spark, str(tmp_path / "c.jsonl"), "id string, n long")
    assert sorted((r.id or "", r.reason or "") for r in scanned.collect()) == [("", "malformed"), ("", "no_id"), ("  ", "no_id"), ("a", ""), ("a", "duplicate_id"), ("a", "duplicate_id"), ("e", "hash_mismatch"), ("f", "hash_mismatch"), ("é", "")]
    good = artifacts.split_rejects(scanned, str(tmp_path / "bad"))
    assert sorted(r.id for r in good.collect()) == ["a", "é"] and good.columns == ["id", "n"]
    assert spark.read.json(str(tmp_path / "bad")).groupBy("reason").count().count() == 4


def test_written_candidates_are_accepted(spark, tmp_path):
    rows = spark.createDataFrame([("a", 'say "hi"\n\\ /', 1.5), ("b", None, None)], "id string, text string, x double")
    artifacts.write_candidates(rows, str(tmp_path / "c"))
    scanned = artifacts.scan_candidates(spark, str(tmp_path / "c"), "id string, text string, x double")
    assert scanned.where("reason is not null").count() == 0 and scanned.select(rows.columns).exceptAll(rows).count() == 0


def test_sheets_keep_texts_and_tolerate_missing_optional_columns(spark, tmp_path):
    texts = ["plain", "=1+1", " @x", 'a "b", c', "two\nlines\n", "", None, "  padded  "]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, note string")
    artifacts.write_sheet(rows, str(tmp_path / "s"))
    got = {int(r.id): (r.note, r.extra) for r in artifacts.read_sheet(spark, str(tmp_path / "s"), ["id"], ("note", "extra")).collect()}
    assert got == {0: ("plain", ""), 1: ("'=1+1", ""), 2: ("' @x", ""), 3: ('a "b", c', ""), 4: ("two\nlines\n", ""), 5: ("", ""), 6: ("", ""), 7: ("  padded  ", "")}
    with pytest.raises(ValueError, match="reviewer"):
        artifacts.read_sheet(spark, str(tmp_path / "s"), ["id", "reviewer"])
    (tmp_path / "bom.csv").write_text("﻿id, decision \n1,approve\n", encoding="utf-8")
    assert artifacts.read_sheet(spark, str(tmp_path / "bom.csv"), ["id", "decision"]).collect() == [("1", "approve")]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        sinks.write_jsonl(rows, str(tmp_path / "s"))  # an artifact is never overwritten


def test_cells_are_those_of_the_sql_for_odd_texts_and_ids(spark, tmp_path):
    texts = [None, "", "\\N", "\\\\N", "\\N\n", '"', '\0"', 'a\0"b', "\r\n", "a\rb", "\x0b=1", "\x0c=1", " \n=1", "\\", "'", "same", "same", "x,\"y\n"]
    ids = [*range(len(texts) - 5), None, None, 7, 7, 7]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in zip(ids, texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, 1, 0), (7, 0, 0), (3, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    key = lambda row: [(x is None, x) for x in row]
    want = sorted(con.execute(registry.oracle_sql()["s04_spreadsheet_cells"]).fetchall(), key=key)
    got = registry.queries()["s04_spreadsheet_cells"](spark, str(tmp_path)).select("dataset_id", "cell", "text_md5", "n_chars")
    assert sorted(map(tuple, got.collect()), key=key) == want


OK = {"candidate_sha256": "h", "decision": "approve", "reviewer": "ann", "reviewed_at": "2024-01-01 00:00:00", "reviewed_leaf": "Food", "transcript_quality": "good"}
SHEET = "id string, candidate_sha256 string, decision string, reviewer string, reviewed_at string, reviewed_leaf string, transcript_quality string"
CANDIDATE = "id long, candidate_sha256 string, transcript_sha256 string, license string, transcript_source string, caption_type string, language string, channel string"
DATASET = "id long, transcript_sha256 string, dataset_source string, deleted boolean, is_active boolean, title string"


def sheet(spark, *rows):
    return spark.createDataFrame([tuple((OK | {"id": i} | change).get(c.split()[0]) for c in SHEET.split(", ")) for i, change in rows], SHEET)


@pytest.fixture
def world(spark):
    good = ("h", None, "creativeCommon", "caption_api", "manual", "th", "ch")
    rows = [(i, good[0], f"t{i}", *good[2:]) for i in range(1, 41)]
    change = {9: {3: None}, 10: {4: "ocr"}, 11: {5: "none"}, 12: {6: "xx"}, 16: {2: "t30"}, 21: {2: "t20"}}
    rows = [tuple(change.get(r[0], {}).get(k, x) for k, x in enumerate(r)) for r in rows]
    datasets = [(13, "t13", "reviewed", True, True, "a"), (14, "t14", "reviewed", False, True, "b"), (15, "old", "reviewed", False, False, "c"), (17, "t17", "upload", False, True, "d"), (30, "t30", "reviewed", False, True, "e")]
    return spark.createDataFrame(rows, CANDIDATE), spark.createDataFrame(datasets, DATASET)


def test_gates_in_their_order_and_one_import_only(spark, world):
    candidates, datasets = world
    cases = {
        1: ({}, "created"), 2: ({"decision": " "}, "pending"), 3: ({"decision": "Maybe", "reviewer": ""}, "decision_must_be_approve_or_reject"), 99: ({}, "unknown_id"), 4: ({"candidate_sha256": "x", "reviewer": ""}, "candidate_hash_mismatch"),
        5: ({"reviewer": "  "}, "reviewer_is_required"), 6: ({"reviewed_at": "soon"}, "reviewed_at_is_no_time"), 7: ({"reviewed_leaf": None}, "reviewed_leaf_is_required"), 8: ({"transcript_quality": "bad"}, "transcript_quality_not_accepted"),
        9: ({}, "license_is_missing"), 10: ({}, "transcript_source_not_accepted"), 11: ({}, "caption_type_not_accepted"), 12: ({}, "transcript_language_not_accepted"), 13: ({}, "dataset_deleted"), 14: ({"decision": "REJECT", "reviewed_leaf": "", "transcript_quality": "bad"}, "rejected"),
        15: ({}, "updated"), 16: ({}, "transcript_in_another_dataset"), 17: ({}, "id_of_another_source"), 18: ({"decision": "reject"}, "rejected"), 20: ({}, "created"), 21: ({}, "transcript_twice_in_batch"),
    }
    rows = sheet(spark, *[(str(i), change) for i, (change, _) in cases.items()], ("1", {}), ("1", {"reviewed_at": "2024-05-01 00:00:00"}))
    events = spark.createDataFrame([], "run_key string, id string, artifact_sha256 string, decision string, reviewer string, reviewed_at timestamp")
    decided = R.decide(rows, candidates, events, datasets, "r", "s", ["food"], ["th"]).cache()
    got = [(r.id, r.outcome) for r in decided.collect()]
    assert sorted(x for x in got if x[0] != "1") == sorted((str(i), outcome) for i, (_, outcome) in cases.items() if i != 1)
    assert {o for i, o in got if i == "1"} == {"created", "twice_in_batch"}
    changed = R.changed_datasets(datasets, decided).cache()
    assert {r.id: (r.transcript_sha256, r.is_active) for r in changed.collect()} == {13: ("t13", True), 14: ("t14", False), 15: ("t15", True), 17: ("t17", True), 30: ("t30", True), 1: ("t1", True), 20: ("t20", True)}
    events = R.new_events(decided, "r", "s")
    assert sorted(r.id for r in events.collect()) == ["1", "14", "15", "18", "20"]
    again = R.decide(rows, candidates, events, changed, "r", "s", ["food"], ["th"])
    assert R.new_events(again, "r", "s").count() == 0 and again.where("outcome = 'unchanged'").count() >= 5
    other = R.decide(rows, candidates, events, datasets, "r", "another sheet", ["food"], ["th"])
    assert other.where("outcome = 'unchanged'").count() == 0
    assert R.decide(rows.limit(0), candidates, events, datasets, "r", "s", ["food"], ["th"]).collect() == []
    decided.unpersist()


def test_a_transcript_that_many_datasets_have(spark, world):
    candidates, datasets = world
    many = datasets.unionByName(spark.range(1000, 1200).select("id", F.lit("t1").alias("transcript_sha256"), F.lit("reviewed").alias("dataset_source"), F.lit(False).alias("deleted"), F.lit(True).alias("is_active"), F.lit("x").alias("title")))
    events = spark.createDataFrame([], "run_key string, id string, artifact_sha256 string, decision string")
    assert [r.outcome for r in R.decide(sheet(spark, ("1", {})), candidates, events, many, "r", "s", ["food"], ["th"]).collect()] == ["transcript_in_another_dataset"]
