"""Ingest, listing and plans (family S)."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from trendloom.functions.reasons import all_reasons
from trendloom.functions.splits import channel_split
from trendloom.operators import reviews
from trendloom.operators.components import shared_folder
from trendloom.operators.trend import latest_runs
from trendloom.plans.eligibility import reasons_sql
from trendloom.plans.registry import bucket_sql, query
from trendloom.sources import artifacts, sinks
from trendloom.sources.views import Views

c = F.col


@query("SELECT event_id, substr(trim(event_type), 1, 5) AS title, coalesce(TRY_CAST(props::JSON ->> '$.views' AS BIGINT), TRY_CAST(props::JSON ->> '$.k' AS BIGINT), 0) AS views, coalesce(props::JSON ->> '$.category', 'general') AS category FROM events WHERE length(trim(event_type)) > 0")
def s01_typed_ingest(v: Views):
    p = F.from_json("props", "views string, k string, category string")
    rows = v.table("events").where(F.length(F.trim("event_type")) > 0).withColumn("p", p)
    return rows.select("event_id", F.substring(F.trim("event_type"), 1, 5).alias("title"), F.coalesce(c("p.views").try_cast("long"), c("p.k").try_cast("long"), F.lit(0)).alias("views"), F.coalesce("p.category", F.lit("general")).alias("category"))


def written(v: Views, write) -> str:
    """A new path in the shared folder to which ``write`` has written."""
    path = f"{shared_folder(v.spark)}/{uuid.uuid4().hex}"
    write(path)
    return path


@query("""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id // 2 END AS id, text, doc_id % 17 = 0 AS torn, doc_id % 13 = 0 AS forged FROM documents), n AS (SELECT *, NOT torn AND id IS NOT NULL AND NOT forged AS good FROM r)
SELECT id, reason, count(*) AS n, min(m) AS first_text FROM (SELECT CASE WHEN torn THEN NULL ELSE id END AS id, CASE WHEN torn THEN 'malformed' WHEN id IS NULL THEN 'no_id' ELSE 'hash_mismatch' END AS reason, md5(CASE WHEN torn THEN '' ELSE text END) AS m FROM n WHERE NOT good
UNION ALL SELECT id, unnest(CASE WHEN count(*) > 1 THEN ['accepted', 'duplicate_id'] ELSE ['accepted'] END), '' FROM n WHERE good GROUP BY id) GROUP BY 1, 2""")
def s02_candidate_scan(v: Views):
    """Candidate lines as files, some torn, without id, forged or of one id, and what a scan accepts of them; rejects are written beside."""
    rows = v.table("documents").select("doc_id", F.when(c("doc_id") % 11 != 0, F.floor(c("doc_id") / 2)).alias("id"), "text")
    claimed = F.when(c("doc_id") % 13 == 0, "forged").otherwise(artifacts.content_hash(rows.columns)).alias("candidate_sha256")
    lines = rows.select("doc_id", F.to_json(F.struct("*", claimed), {"ignoreNullFields": "false"}).alias("line"))
    torn = F.when(c("doc_id") % 17 == 0, F.expr("substring(line, 1, length(line) - 3)")).otherwise(c("line"))
    path = written(v, lambda p: lines.select(torn.alias("value")).write.text(p))
    scanned = artifacts.scan_candidates(v.spark, path, "doc_id long, id long, text string")
    accepted = artifacts.split_rejects(scanned, path + "-rejects")
    rejects = v.spark.read.schema("id long, text string, reason string").json(path + "-rejects")
    shown = F.when(c("reason") == "duplicate_id", "").otherwise(F.md5(F.coalesce("text", F.lit(""))))
    both = accepted.select("id", F.lit("accepted").alias("reason"), F.lit("").alias("m")).unionByName(rejects.select("id", "reason", shown.alias("m")))
    return both.groupBy("id", "reason").agg(F.count("*").alias("n"), F.min("m").alias("first_text"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE quality WHEN 1 THEN 'approve' ELSE 'reject' END AS decision, CASE WHEN doc_id % 5 = 0 THEN 'said "no", then' || chr(10) || 'yes' ELSE chr(39) || '=sum(1)' END AS review_notes, '' AS view_metric_version FROM labels""")
def s03_review_rows(v: Views):
    """A review sheet as CSV files with a byte order mark, quotes, commas and line breaks, read with a column that it lacks."""
    notes = F.when(c("doc_id") % 5 == 0, 'said "no", then\nyes').otherwise("=sum(1)")
    rows = v.table("labels").select(c("doc_id").cast("string").alias("doc_id"), F.when(c("quality") == 1, " Approve").otherwise("REJECT ").alias("decision"), notes.alias("review_notes"))
    path = written(v, lambda p: artifacts.write_sheet(rows, p))
    sheet = artifacts.read_sheet(v.spark, path, ["doc_id", "decision"], ("review_notes", "view_metric_version"))
    return sheet.withColumn("decision", F.lower(F.trim("decision")))


@query(r"""SELECT dataset_id, CASE WHEN regexp_matches(text, '^\s*[-=+@]') THEN chr(39) || text ELSE text END AS cell, md5(text) AS text_md5, n_chars FROM transcripts""")
def s04_spreadsheet_cells(v: Views):
    """Texts written as JSON lines and from them as a sheet, and read back: safe cells from the one, the texts themselves from the other.

    Rows meet again by a number that the lines keep, so ids that are null or come twice lose and multiply nothing.
    """
    rows = v.transcripts.select(F.monotonically_increasing_id().alias("row"), "dataset_id", "text", "n_chars")
    lines = written(v, lambda p: sinks.write_jsonl(rows, p))
    texts = v.spark.read.schema("row long, dataset_id long, text string, n_chars long").json(lines)
    sheet = written(v, lambda p: artifacts.write_sheet(texts.select("row", "text"), p))
    cells = artifacts.read_sheet(v.spark, sheet, ["row", "text"]).select(c("row").cast("long").alias("row"), c("text").alias("cell"))
    return cells.join(texts.select("row", "dataset_id", F.md5("text").alias("text_md5"), "n_chars"), "row").drop("row")


@query("WITH o AS (SELECT dataset_id, metric_version, views FROM content WHERE dataset_id % 3 <> 0), n AS (SELECT dataset_id, metric_version, views + 1 AS views FROM content WHERE dataset_id % 2 = 0) SELECT coalesce(o.dataset_id, n.dataset_id) AS dataset_id, coalesce(o.metric_version, n.metric_version) AS metric_version, coalesce(n.views, o.views) AS views, CASE WHEN o.dataset_id IS NULL THEN 'created' WHEN n.dataset_id IS NULL THEN 'kept' ELSE 'updated' END AS state FROM o FULL JOIN n ON o.dataset_id = n.dataset_id AND o.metric_version = n.metric_version")
def s05_upsert_trends(v: Views):
    old = v.content.where("dataset_id % 3 <> 0").select("dataset_id", "metric_version", "views")
    new = v.content.where("dataset_id % 2 = 0").select("dataset_id", "metric_version", (c("views") + 1).alias("views"))
    return sinks.upsert(old, new.withColumn("seq", F.lit(1)), ["dataset_id", "metric_version"], "seq")


@query("""WITH o AS (SELECT key, CASE WHEN key % 4 = 0 THEN NULL ELSE platform END AS platform, max(score) AS score FROM items WHERE run_at < TIMESTAMP '2024-01-10' GROUP BY 1, 2),
n AS (SELECT key, CASE WHEN key % 4 = 0 THEN NULL ELSE platform END AS platform, max(score) AS score FROM items WHERE run_at >= TIMESTAMP '2024-01-10' AND key % 3 <> 1 GROUP BY 1, 2)
SELECT coalesce(o.key, n.key) AS key, coalesce(o.platform, n.platform) AS platform, coalesce(n.score, o.score) AS score, CASE WHEN o.key IS NULL THEN 'created' WHEN n.key IS NULL THEN 'kept' ELSE 'updated' END AS state FROM o FULL JOIN n ON o.key = n.key AND o.platform IS NOT DISTINCT FROM n.platform""")
def s06_upsert_items(v: Views):
    rows = v.items.select("key", F.when(c("key") % 4 != 0, c("platform")).alias("platform"), "score", "run_at")
    top = lambda r: r.groupBy("key", "platform").agg(F.max("score").alias("score"))
    day = F.lit("2024-01-10").cast("timestamp_ntz")
    return sinks.upsert(top(rows.where(c("run_at") < day)), top(rows.where((c("run_at") >= day) & (c("key") % 3 != 1))).withColumn("seq", F.lit(1)), ["key", "platform"], "seq")


@query("SELECT dataset_id, title, total FROM (SELECT dataset_id, title, count(*) OVER () AS total FROM content WHERE title LIKE '%ring%' AND channel LIKE 'Brand#1%') ORDER BY dataset_id DESC LIMIT 20 OFFSET 2")
def s07_corpus_listing(v: Views):
    rows = v.content.where("title like '%ring%' and channel like 'Brand#1%'").select("dataset_id", "title")
    total = rows.agg(F.count("*").alias("total"))  # one row
    return rows.orderBy(F.desc("dataset_id")).offset(2).limit(20).join(F.broadcast(total), F.lit(True))


@query("SELECT event_id, ts, event_type FROM events WHERE event_type = 'error' AND props LIKE '%1%' ORDER BY ts DESC, event_id LIMIT 50")
def s08_log_listing(v: Views):
    return v.table("events").where("event_type = 'error' and props like '%1%'").orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "ts", "event_type")


@query("SELECT event_id, 'k' AS scope, TRY_CAST(props::JSON ->> '$.k' AS BIGINT) AS value, CASE WHEN TRY_CAST(props::JSON ->> '$.k' AS BIGINT) >= 50 THEN 'high' ELSE 'low' END AS mode FROM events")
def s09_json_decode(v: Views):
    rows = v.table("events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("scope", "value"))
    n = c("value").try_cast("long")
    return rows.select("event_id", "scope", n.alias("value"), F.when(n >= 50, "high").otherwise("low").alias("mode"))


@query("WITH i AS (SELECT dataset_id, n_chars, leaf, sha256(text) AS h FROM transcripts WHERE dataset_id % 2 = 0), k AS (SELECT DISTINCT sha256(text) AS h FROM transcripts WHERE dataset_id % 2 = 1) SELECT dataset_id, CASE WHEN n_chars < 60 THEN 'invalid' WHEN row_number() OVER (PARTITION BY i.h ORDER BY dataset_id) > 1 THEN 'duplicate_in_batch' WHEN k.h IS NOT NULL THEN 'duplicate_transcript' WHEN leaf = 'es' THEN 'needs_metadata' ELSE 'ok' END AS status FROM i LEFT JOIN k ON i.h = k.h")
def s10_batch_audit(v: Views):
    rows = v.transcripts.withColumn("h", F.sha2("text", 256))
    catalog = rows.where("dataset_id % 2 = 1").select("h").distinct().withColumn("known", F.lit(True))
    again = F.row_number().over(Window.partitionBy("h").orderBy("dataset_id")) > 1
    batch = rows.where("dataset_id % 2 = 0").withColumn("again", again).join(catalog, "h", "left")
    status = F.when(c("n_chars") < 60, "invalid").when(c("again"), "duplicate_in_batch").when(c("known"), "duplicate_transcript").when(c("leaf") == "es", "needs_metadata").otherwise("ok")
    return batch.select("dataset_id", status.alias("status"))


@query(f"WITH s AS (SELECT channel, count(DISTINCT CASE WHEN dataset_id % 5 = 0 THEN 'test' ELSE 'train' END) AS k, min(captured) AS first_at FROM content WHERE dataset_id % 2 = 1 GROUP BY 1) SELECT dataset_id, CASE WHEN {bucket_sql('content.channel', 100)} < 70 THEN 'train' WHEN {bucket_sql('content.channel', 100)} < 85 THEN 'validation' ELSE 'test' END AS split, coalesce(k > 1, FALSE) AS split_conflict, first_at FROM content LEFT JOIN s ON s.channel = content.channel WHERE dataset_id % 2 = 0")
def s11_attach_metadata(v: Views):
    kept = v.content.where("dataset_id % 2 = 1").groupBy("channel").agg(F.collect_set(F.when(c("dataset_id") % 5 == 0, "test").otherwise("train")).alias("s"), F.min("captured").alias("first_at"))
    rows = v.content.where("dataset_id % 2 = 0").join(kept, "channel", "left")
    return rows.select("dataset_id", channel_split(c("channel")).alias("split"), F.coalesce(F.size("s") > 1, F.lit(False)).alias("split_conflict"), "first_at")


LEAVES = ("en", "de", "fr", "es")


@query(f"""WITH ca AS (SELECT doc_id, sha256(text) AS sha, CASE WHEN doc_id % 19 = 0 THEN NULL ELSE 'creativeCommon' END AS license, CASE WHEN doc_id % 23 = 0 THEN 'ocr' ELSE 'caption_api' END AS src, CASE WHEN doc_id % 61 = 0 THEN 'none' ELSE 'manual' END AS cap, CASE WHEN doc_id % 67 = 0 THEN 'xx' ELSE lang END AS lng FROM documents WHERE doc_id % 71 <> 0),
ds AS (SELECT doc_id, sha256(text) AS sha, CASE WHEN doc_id % 3 = 0 THEN 'upload' ELSE 'reviewed' END AS source, doc_id % 10 = 0 AS deleted FROM documents WHERE doc_id % 2 = 0), tw AS (SELECT sha, min(CAST(doc_id AS VARCHAR)) AS low, max(CAST(doc_id AS VARCHAR)) AS high FROM ds GROUP BY 1),
rv AS (SELECT l.doc_id, CASE WHEN l.doc_id % 29 = 0 THEN '' WHEN l.doc_id % 31 = 0 THEN 'maybe' WHEN quality = 1 OR l.doc_id % 3 > 0 THEN 'approve' ELSE 'reject' END AS decision, CASE WHEN l.doc_id % 37 = 0 THEN 'bad' ELSE sha256(text) END AS claimed, l.doc_id % 41 = 0 AS nameless, l.doc_id % 43 = 0 AS timeless, CASE WHEN l.doc_id % 47 = 0 THEN '' ELSE lang END AS leaf, toxic = 1 AS poor, unnest(range(0, CASE WHEN l.doc_id % 6 = 1 THEN 2 ELSE 1 END)) AS k FROM labels l JOIN documents USING (doc_id)),
g AS (SELECT rv.*, ca.sha, ds.doc_id IS NOT NULL AS held, coalesce(deleted, false) AS deleted, source, low, high, CASE WHEN decision = '' THEN 'pending' WHEN decision = 'maybe' THEN 'decision_must_be_approve_or_reject' WHEN ca.doc_id IS NULL THEN 'unknown_id' WHEN claimed <> ca.sha THEN 'candidate_hash_mismatch' WHEN nameless THEN 'reviewer_is_required' WHEN timeless THEN 'reviewed_at_is_no_time'
 WHEN decision = 'approve' AND leaf NOT IN {LEAVES} THEN 'reviewed_leaf_is_required' WHEN decision = 'approve' AND poor THEN 'transcript_quality_not_accepted' WHEN decision = 'approve' AND license IS NULL THEN 'license_is_missing' WHEN decision = 'approve' AND src = 'ocr' THEN 'transcript_source_not_accepted' WHEN decision = 'approve' AND cap = 'none' THEN 'caption_type_not_accepted'
 WHEN decision = 'approve' AND lng NOT IN {LEAVES} THEN 'transcript_language_not_accepted' WHEN rv.doc_id % 7 = 0 THEN 'unchanged' END AS gate FROM rv LEFT JOIN ca USING (doc_id) LEFT JOIN ds ON ds.doc_id = rv.doc_id LEFT JOIN tw ON tw.sha = ca.sha),
o AS (SELECT *, min(CASE WHEN gate IS NULL AND decision = 'approve' AND NOT deleted THEN CAST(doc_id AS VARCHAR) END) OVER (PARTITION BY sha) AS taker FROM g)
SELECT CAST(doc_id AS VARCHAR) AS id, decision, CASE WHEN gate IS NOT NULL THEN gate WHEN k = 1 THEN 'twice_in_batch' WHEN deleted THEN 'dataset_deleted' WHEN decision = 'reject' THEN 'rejected' WHEN low <> CAST(doc_id AS VARCHAR) OR high <> CAST(doc_id AS VARCHAR) THEN 'transcript_in_another_dataset'
 WHEN taker <> CAST(doc_id AS VARCHAR) THEN 'transcript_twice_in_batch' WHEN held AND source <> 'reviewed' THEN 'id_of_another_source' WHEN held THEN 'updated' ELSE 'created' END AS outcome FROM o""")
def s12_review_import(v: Views):
    """A sheet of decisions over the candidates, through all gates, against events and datasets that are there."""
    d = v.table("documents")
    own = F.sha2("text", 256)
    candidates = d.where("doc_id % 71 <> 0").select(
        c("doc_id").alias("id"), own.alias("candidate_sha256"), own.alias("transcript_sha256"), F.when(c("doc_id") % 19 != 0, "creativeCommon").alias("license"), F.when(c("doc_id") % 23 == 0, "ocr").otherwise("caption_api").alias("transcript_source"),
        F.when(c("doc_id") % 61 == 0, "none").otherwise("manual").alias("caption_type"), F.when(c("doc_id") % 67 == 0, "xx").otherwise(c("lang")).alias("language"), c("source").alias("channel"),
    )
    datasets = d.where("doc_id % 2 = 0").select(c("doc_id").alias("id"), own.alias("transcript_sha256"), F.when(c("doc_id") % 3 == 0, "upload").otherwise("reviewed").alias("dataset_source"), (c("doc_id") % 10 == 0).alias("deleted"))
    decision = F.when(c("doc_id") % 29 == 0, " ").when(c("doc_id") % 31 == 0, "maybe").when((c("quality") == 1) | (c("doc_id") % 3 > 0), "Approve ").otherwise("reject")
    times = F.when(c("doc_id") % 43 == 0, F.array(F.lit("yesterday"))).otherwise(F.array(F.lit("2024-02-03 04:05:06")))
    again = F.when(c("doc_id") % 6 == 1, F.concat(times, F.array(F.lit("2024-02-03 04:05:07")))).otherwise(times)
    sheet = v.table("labels").join(d, "doc_id").select(
        c("doc_id").cast("string").alias("id"), F.when(c("doc_id") % 37 == 0, "bad").otherwise(own).alias("candidate_sha256"), decision.alias("decision"), F.when(c("doc_id") % 41 == 0, " ").otherwise("ann").alias("reviewer"),
        F.explode(again).alias("at"), c("doc_id"), F.when(c("doc_id") % 47 != 0, c("lang")).alias("reviewed_leaf"), F.when(c("toxic") == 1, "poor").otherwise("Good").alias("transcript_quality"),
    ).withColumn("reviewed_at", F.when(c("doc_id") % 43 == 0, "yesterday").otherwise(c("at")))
    events = d.where("doc_id % 7 = 0").select(F.lit("run-1").alias("run_key"), c("doc_id").alias("id"), F.lit("sheet-1").alias("artifact_sha256"), F.explode(F.array(F.lit("approve"), F.lit("reject"))).alias("decision"))
    return reviews.decide(sheet, candidates, events, datasets, "run-1", "sheet-1", LEAVES, LEAVES).select("id", "decision", "outcome")


@query("WITH m AS (SELECT max(run_at) AS now_at FROM runs) SELECT platform, run_at, n_items FROM runs, m WHERE run_at >= now_at - INTERVAL 20 DAY QUALIFY row_number() OVER (PARTITION BY platform ORDER BY run_at DESC) <= 12")
def s14_retention(v: Views):
    now = v.runs.agg(F.max("run_at").alias("now_at"))  # one row
    fresh = v.runs.join(F.broadcast(now), F.lit(True)).where(c("run_at") >= c("now_at") - F.expr("INTERVAL 20 DAYS"))
    return latest_runs(fresh, ["platform"], "run_at", 12).select("platform", "run_at", "n_items")


@query("SELECT p_partkey AS dataset_id, p_name AS title, p_brand AS channel, CAST(p_size AS BIGINT) AS seconds, CASE WHEN p_type = 'PROMO' THEN 'standard' ELSE 'creative-commons' END AS licence FROM part")
def s15_candidate_rows(v: Views):
    nested = v.table("part").select(
        F.to_json(F.struct(c("p_partkey").alias("id"), F.struct(c("p_name").alias("title"), c("p_brand").alias("channel")).alias("snippet"), F.struct(F.concat(F.lit("PT"), c("p_size").cast("string"), F.lit("S")).alias("duration")).alias("contentDetails"), F.struct(c("p_type").alias("license")).alias("status"))).alias("line")
    )
    from trendloom.functions.metrics import iso_seconds

    r = nested.select(F.from_json("line", "id long, snippet struct<title:string,channel:string>, contentDetails struct<duration:string>, status struct<license:string>").alias("r"))
    return r.select(c("r.id").alias("dataset_id"), "r.snippet.title", "r.snippet.channel", iso_seconds(c("r.contentDetails.duration")).alias("seconds"), F.when(c("r.status.license") == "PROMO", "standard").otherwise("creative-commons").alias("licence"))


@query(f"SELECT dataset_id, CASE WHEN {bucket_sql('channel', 100)} >= 85 THEN NULL ELSE views END AS outcome, sha256(dataset_id::VARCHAR || '|' || title) AS record_sha256, " + reasons_sql(("metric_version <> 'v2'", "metric"), ("duration > 45", "duration")) + " AS excluded FROM content")
def s16_manifest_freeze(v: Views):
    sealed = channel_split(c("channel")) == "test"
    return v.content.select(
        "dataset_id", F.when(~sealed, c("views")).alias("outcome"), F.sha2(F.concat_ws("|", c("dataset_id").cast("string"), "title"), 256).alias("record_sha256"),
        all_reasons((c("metric_version") != "v2", "metric"), (c("duration") > 45, "duration")).alias("excluded"),
    )


@query("WITH a AS (SELECT *, CAST(platform IN ('view', 'click') AND rank <= 5 AS INT) AS live FROM items), m AS (SELECT *, max(live) OVER (PARTITION BY platform) AS top FROM a) SELECT platform, run_at, key FROM m WHERE live = top QUALIFY row_number() OVER (PARTITION BY platform ORDER BY run_at DESC, rank) <= 20")
def s17_feed_load(v: Views):
    a = v.items.withColumn("live", (c("platform").isin("view", "click") & (c("rank") <= 5)).cast("int"))
    top = a.groupBy("platform").agg(F.max("live").alias("top"))
    rows = a.join(top, "platform").where("live = top")
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("platform").orderBy(F.desc("run_at"), "rank"))).where("k <= 20").select("platform", "run_at", "key")


@query("SELECT p_name AS alias, count(DISTINCT p_type) AS topics, min(p_type) AS first_topic FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def s18_catalog_validation(v: Views):
    return v.table("part").groupBy(c("p_name").alias("alias")).agg(F.count_distinct("p_type").alias("topics"), F.min("p_type").alias("first_topic")).where("topics > 1")


@query(r"WITH h AS (SELECT sha256(nullif(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}]', '', 'g'), '')) AS f FROM transcripts WHERE split = 'test'), r AS (SELECT dataset_id, channel, sha256(nullif(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}]', '', 'g'), '')) AS f FROM transcripts WHERE split <> 'test') SELECT f, max(dataset_id) AS dataset_id FROM r ANTI JOIN h USING (f) WHERE f IS NOT NULL GROUP BY 1")
def s20_discovery_corpus(v: Views):
    from trendloom.functions.text import identity

    rows = v.transcripts.select("dataset_id", "split", identity(c("text")).alias("f")).where("f is not null")
    held = rows.where("split = 'test'").select("f").distinct()
    return rows.where("split <> 'test'").join(held, "f", "left_anti").groupBy("f").agg(F.max("dataset_id").alias("dataset_id"))


@query("SELECT dataset_id, leaf IN ('en', 'de') AS kept, CASE WHEN leaf NOT IN ('en', 'de') THEN 'language:' || leaf END AS reason FROM transcripts")
def s21_retarget_languages(v: Views):
    ok = c("leaf").isin("en", "de")
    return v.transcripts.select("dataset_id", ok.alias("kept"), F.when(~ok, F.concat(F.lit("language:"), "leaf")).alias("reason"))


@query("WITH m AS (SELECT l_partkey AS dataset_id, count(*) AS n FROM lineitem GROUP BY 1) SELECT c.dataset_id, m.n IS NULL AS missing, CAST(ceil(coalesce(m.n, 0) / 50.0::DOUBLE) AS BIGINT) AS calls FROM content c LEFT JOIN m USING (dataset_id)")
def s22_manifest_check(v: Views):
    m = v.table("lineitem").groupBy(c("l_partkey").alias("dataset_id")).agg(F.count("*").alias("n"))
    return v.content.join(m, "dataset_id", "left").select("dataset_id", c("n").isNull().alias("missing"), F.ceil(F.coalesce("n", F.lit(0)) / 50).alias("calls"))


@query("WITH k AS (SELECT DISTINCT term FROM terms), old AS (SELECT DISTINCT term FROM terms WHERE dataset_id % 2 = 0) SELECT md5(k.term) AS keyword_id, k.term, old.term IS NULL AS created, count(*) AS links FROM k LEFT JOIN old USING (term) JOIN terms t ON t.term = k.term GROUP BY ALL")
def s23_keyword_dimension(v: Views):
    old = v.terms.where("dataset_id % 2 = 0").select("term").distinct().withColumn("old", F.lit(True))
    links = v.terms.groupBy("term").agg(F.count("*").alias("links"))
    return links.join(old, "term", "left").select(F.md5("term").alias("keyword_id"), "term", c("old").isNull().alias("created"), "links")
