"""Projections and filters with reason codes (family P), and the joins that guard splits (J5, J10, J18, J19)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from trendloom.functions import metrics as M
from trendloom.functions.reasons import all_reasons, first_reason
from trendloom.functions.splits import bucket, channel_split
from trendloom.functions.text import words
from trendloom.operators.components import identity_issues
from trendloom.operators.guards import conflicts, without_leaks
from trendloom.operators.overlap import normal_form, overlaps
from trendloom.plans.registry import bucket_sql, query
from trendloom.sources.views import Views

c = F.col
REASON_SQL = "array_to_string(list_sort(list_filter([{}], lambda x: x IS NOT NULL)), ',')"


def reasons_sql(*rules: tuple[str, str]) -> str:
    return REASON_SQL.format(", ".join(f"CASE WHEN {cond} THEN '{code}' END" for cond, code in rules))


#: The production contract: code of a failure, and the condition that a row must meet, in words that both engines read.
CONTRACT = (
    ("id_missing", "dataset_id IS NOT NULL"), ("text_missing", "text IS NOT NULL"), ("text_blank", "length(trim(text)) > 0"), ("text_short", "length(trim(text)) >= 80"),
    ("channel_missing", "channel IS NOT NULL"), ("channel_blank", "length(trim(channel)) > 0"), ("leaf_missing", "leaf IS NOT NULL"), ("leaf_blank", "length(trim(leaf)) > 0"),
    ("leaf_inactive", "leaf IN ('en', 'de', 'fr')"), ("size_missing", "n_chars IS NOT NULL"), ("size_zero", "n_chars > 0"), ("window_beyond_size", "length(text) <= n_chars"),
    ("digest_missing", "digest IS NOT NULL"), ("digest_length", "length(digest) = 64"), ("creator_key_missing", "creator_key IS NOT NULL"), ("creator_key_length", "length(creator_key) = 64"),
    ("batch_key_missing", "batch_key IS NOT NULL"), ("batch_key_length", "length(batch_key) = 64"), ("split_missing", "split IS NOT NULL"), ("split_unknown", "split IN ('train', 'validation', 'test')"),
    ("unreviewed", "quality IS NOT NULL"), ("not_eligible", "quality = 1"), ("toxicity_unknown", "toxic IS NOT NULL"), ("toxic", "toxic = 0"),
)
RECORDS_SQL = "(SELECT *, sha256(text) AS digest, sha256(channel) AS creator_key, sha256(channel || '|' || leaf) AS batch_key FROM transcripts)"


def records(v: Views):
    key = lambda *cols: F.sha2(F.concat(*cols), 256)
    return v.transcripts.withColumns({"digest": F.sha2("text", 256), "creator_key": F.sha2("channel", 256), "batch_key": key(c("channel"), F.lit("|"), c("leaf"))})


@query("SELECT dataset_id, leaf, split FROM " + RECORDS_SQL + " WHERE " + " AND ".join(rule for _, rule in CONTRACT))
def p01_production_contract(v: Views):
    """Rows that meet every condition of the contract."""
    return records(v).where(" AND ".join(rule for _, rule in CONTRACT)).select("dataset_id", "leaf", "split")


@query("SELECT dataset_id, channel FROM transcripts WHERE leaf NOT IN ('en', 'de') AND split = 'test' AND length(trim(text)) >= 80 AND coalesce(toxic, 0) = 0")
def p02_out_of_scope_set(v: Views):
    return v.transcripts.where(~c("leaf").isin("en", "de") & (c("split") == "test") & (F.length(F.trim("text")) >= 80) & (F.coalesce("toxic", F.lit(0)) == 0)).select("dataset_id", "channel")


@query("SELECT dataset_id, " + reasons_sql(*[(f"NOT coalesce({rule}, false)", code) for code, rule in CONTRACT]) + " AS failing FROM " + RECORDS_SQL)
def p03_failing_fields(v: Views):
    """Every condition of the contract that a row fails; an unknown result is a failure."""
    return records(v).select("dataset_id", all_reasons(*[(~F.coalesce(F.expr(rule), F.lit(False)), code) for code, rule in CONTRACT]).alias("failing"))


@query("SELECT dataset_id, views FROM content WHERE captured > published AND views >= 0 AND likes >= 0 AND comments >= 0 AND metric_version = 'v2' AND format = 'short' AND title NOT IN (SELECT title FROM content WHERE channel = 'Brand#1')")
def p04_reference_predicate(v: Views):
    rows = v.content.where((c("captured") > c("published")) & (c("views") >= 0) & (c("likes") >= 0) & (c("comments") >= 0) & (c("metric_version") == "v2") & (c("format") == "short"))
    return rows.join(v.content.where("channel = 'Brand#1'").select("title"), "title", "left_anti").select("dataset_id", "views")


@query(r"SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages WHERE regexp_extract(url, '^https?://[^/?#]+/([a-z]{2})/', 1) = regexp_extract(html, '<html lang=.([a-z]{2})', 1)")
def p05_source_matches(v: Views):
    ours, theirs = F.regexp_extract("url", r"^https?://[^/?#]+/([a-z]{2})/", 1), F.regexp_extract("html", "<html lang=.([a-z]{2})", 1)
    return v.table("pages").where(ours == theirs).select("page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"))


@query("WITH q AS (SELECT dataset_id, " + reasons_sql(("views < 1000000", "low_views"), ("likes < 700", "low_likes"), ("comments < 25", "few_comments"), ("duration < 5", "too_short"), ("captured <= published", "bad_dates"), ("metric_version <> 'v2'", "old_metric")) + " AS issues FROM content) SELECT dataset_id, issues, CASE WHEN issues = '' THEN 'ready' WHEN contains(issues, ',') THEN 'blocked' ELSE 'review' END AS status FROM q")
def p06_quality_checklist(v: Views):
    issues = all_reasons(
        (c("views") < 1_000_000, "low_views"), (c("likes") < 700, "low_likes"), (c("comments") < 25, "few_comments"), (c("duration") < 5, "too_short"),
        (c("captured") <= c("published"), "bad_dates"), (c("metric_version") != "v2", "old_metric"),
    )
    rows = v.content.select("dataset_id", issues.alias("issues"))
    return rows.withColumn("status", F.when(c("issues") == "", "ready").when(c("issues").contains(","), "blocked").otherwise("review"))


LAST = """l AS (SELECT entity, arg_max(views, (us, obs_id)) FILTER (status = 'complete') AS views, max(us) FILTER (status = 'complete') AS last_us, count(*) FILTER (status = 'failed') AS n_failed, max(us) AS any_us, arg_max(metric_version, (us, obs_id)) AS mv FROM observations GROUP BY 1)"""


def last_readings(v: Views):
    at, good = F.struct("us", "obs_id"), c("status") == "complete"
    return v.observations.groupBy("entity").agg(
        F.max_by(F.when(good, c("views")), F.when(good, at)).alias("views"), F.max(F.when(good, c("us"))).alias("last_us"), F.count_if(c("status") == "failed").alias("n_failed"),
        F.max("us").alias("any_us"), F.max_by("metric_version", at).alias("mv"),
    )


@query("WITH " + LAST + """ SELECT dataset_id, CASE WHEN leaf = 'PROMO' THEN 'leaf' WHEN metric_version <> 'v2' THEN 'metric' WHEN l.entity IS NULL THEN 'no_observation' WHEN n_failed > 13 THEN 'failures' WHEN duration > 45 THEN 'too_long' END AS reason FROM content LEFT JOIN l ON entity = dataset_id""")
def p07_first_failing_reason(v: Views):
    rows = v.content.join(last_readings(v).select("entity", "n_failed"), c("dataset_id") == c("entity"), "left")
    reason = first_reason((c("leaf") == "PROMO", "leaf"), (c("metric_version") != "v2", "metric"), (c("entity").isNull(), "no_observation"), (c("n_failed") > 13, "failures"), (c("duration") > 45, "too_long"))
    return rows.select("dataset_id", reason.alias("reason"))


@query("WITH " + LAST + " SELECT dataset_id, " + reasons_sql(("l.entity IS NULL", "no_observation"), ("l.last_us < l.any_us", "last_failed"), ("content.views < 1500000", "low_views"), ("format = 'long'", "format")) + " AS reasons FROM content LEFT JOIN l ON entity = dataset_id")
def p08_all_reasons(v: Views):
    rows = v.content.join(last_readings(v).select("entity", "last_us", "any_us"), c("dataset_id") == c("entity"), "left")
    return rows.select("dataset_id", all_reasons((c("entity").isNull(), "no_observation"), (c("last_us") < c("any_us"), "last_failed"), (c("views") < 1_500_000, "low_views"), (c("format") == "long", "format")).alias("reasons"))


@query("SELECT dataset_id, " + reasons_sql(("split = 'train'", "training_row"), ("quality IS NULL", "no_label"), ("n_copies > 1", "duplicate"), ("length(text) < 120", "no_speech")) + " AS excluded FROM (SELECT *, count(*) OVER (PARTITION BY sha256(text)) AS n_copies FROM transcripts)")
def p09_scoring_exclusions(v: Views):
    rows = v.transcripts.withColumn("digest", F.sha2("text", 256))
    copies = rows.groupBy("digest").agg(F.count("*").alias("n_copies"))
    rows = rows.join(copies, "digest")
    return rows.select("dataset_id", all_reasons((c("split") == "train", "training_row"), (c("quality").isNull(), "no_label"), (c("n_copies") > 1, "duplicate"), (F.length("text") < 120, "no_speech")).alias("excluded"))


@query("WITH " + LAST + ", g AS (SELECT entity, count(*) FILTER (gap > 86400000000) AS n_gaps FROM (SELECT entity, us - lag(us) OVER (PARTITION BY entity ORDER BY us, obs_id) AS gap FROM observations) GROUP BY 1) SELECT entity, n_gaps, " + reasons_sql(("n_gaps > 3", "gaps"), ("views IS NULL", "no_views"), ("n_failed > 10", "failed_readings"), ("mv <> 'v2'", "metric_version")) + " AS issues FROM l JOIN g USING (entity)")
def p10_readiness_audit(v: Views):
    gap = c("us") - F.lag("us").over(Window.partitionBy("entity").orderBy("us", "obs_id"))
    gaps = v.observations.withColumn("gap", gap).groupBy("entity").agg(F.count_if(c("gap") > 86_400_000_000).alias("n_gaps"))
    rows = last_readings(v).join(gaps, "entity")
    return rows.select("entity", "n_gaps", all_reasons((c("n_gaps") > 3, "gaps"), (c("views").isNull(), "no_views"), (c("n_failed") > 10, "failed_readings"), (c("mv") != "v2", "metric_version")).alias("issues"))


@query("WITH " + LAST + ", m AS (SELECT max(us) AS now_us FROM observations) SELECT entity, CASE WHEN views IS NULL THEN 'none' WHEN last_us < now_us - 3 * 86400000000 THEN 'stale' WHEN mv <> 'v2' THEN 'metric_mismatch' WHEN last_us < any_us THEN 'after_failure' ELSE 'ok' END AS state, views FROM l, m")
def p11_latest_observation(v: Views):
    rows = last_readings(v).join(F.broadcast(v.observations.agg(F.max("us").alias("now_us"))), F.lit(True))  # one row
    state = F.when(c("views").isNull(), "none").when(c("last_us") < c("now_us") - 3 * 86_400_000_000, "stale").when(c("mv") != "v2", "metric_mismatch").when(c("last_us") < c("any_us"), "after_failure").otherwise("ok")
    return rows.select("entity", state.alias("state"), "views")


@query("SELECT leaf, format, CASE WHEN views < 1000000 THEN 'repair' WHEN dataset_id % 10 = 0 THEN 'protected' ELSE 'development' END AS queue, count(*) AS n, min(dataset_id) AS first_id FROM content GROUP BY ALL")
def p12_review_queues(v: Views):
    queue = F.when(c("views") < 1_000_000, "repair").when(c("dataset_id") % 10 == 0, "protected").otherwise("development")
    return v.content.groupBy("leaf", "format", queue.alias("queue")).agg(F.count("*").alias("n"), F.min("dataset_id").alias("first_id"))


@query("SELECT dataset_id, CASE WHEN quality IS NULL THEN 'unreviewed' WHEN length(text) < 200 THEN 'short' END AS reason, CASE WHEN quality IS NOT NULL AND length(text) >= 200 THEN n_chars END AS f_chars, CASE WHEN quality IS NOT NULL AND length(text) >= 200 THEN CAST(contains(lower(text), 'license') AS INT) END AS f_license FROM transcripts")
def p13_feature_record(v: Views):
    reason = first_reason((c("quality").isNull(), "unreviewed"), (F.length("text") < 200, "short"))
    ok = reason.isNull()
    return v.transcripts.select("dataset_id", reason.alias("reason"), F.when(ok, c("n_chars")).alias("f_chars"), F.when(ok, F.lower("text").contains("license").cast("int")).alias("f_license"))


@query(f"SELECT dataset_id, CASE WHEN s >= 85 THEN 'independent_test' WHEN s >= 70 THEN 'calibration' WHEN slot = 0 THEN 'tuning' ELSE 'fit' END AS role FROM (SELECT dataset_id, {bucket_sql('channel', 100)} AS s, {bucket_sql('dataset_id::VARCHAR', 4)} AS slot FROM content)")
def p14_outcome_roles(v: Views):
    split = channel_split(c("channel"))
    role = F.when(split == "test", "independent_test").when(split == "validation", "calibration").when(bucket(c("dataset_id"), 4) == 0, "tuning").otherwise("fit")
    return v.content.select("dataset_id", role.alias("role"))


@query(f"SELECT channel, CASE WHEN channel IN ('Brand#1', 'Brand#2') THEN 'test' WHEN b < 70 THEN 'train' WHEN b < 85 THEN 'validation' ELSE 'test' END AS split, n FROM (SELECT channel, {bucket_sql('channel', 100)} AS b, count(*) AS n FROM content GROUP BY 1)")
def p15_channel_split(v: Views):
    registered = v.spark.createDataFrame([("Brand#1", "test"), ("Brand#2", "test")], "channel string, registered string")
    rows = v.content.groupBy("channel").agg(F.count("*").alias("n")).join(F.broadcast(registered), "channel", "left")
    return rows.select("channel", F.coalesce("registered", channel_split(c("channel"))).alias("split"), "n")


@query("WITH m AS (SELECT max(run_at) AS now_at FROM runs), l AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY platform ORDER BY run_at DESC) = 1) SELECT platform, run_at, n_items, status = 'ok' AND run_at >= now_at - INTERVAL 1 DAY AS live FROM l, m")
def p16_live_scopes(v: Views):
    last = v.runs.groupBy("platform").agg(F.max_by(F.struct("run_at", "n_items", "status"), "run_at").alias("r")).select("platform", "r.*")
    now = v.runs.agg(F.max("run_at").alias("now_at"))  # one row
    live = (c("status") == "ok") & (c("run_at") >= c("now_at") - F.expr("INTERVAL 1 DAY"))
    return last.join(F.broadcast(now), F.lit(True)).select("platform", "run_at", "n_items", live.alias("live"))


@query(f"WITH r AS (SELECT *, {bucket_sql('channel', 100)} < 70 AS train FROM content), s AS (SELECT leaf, format, title, count(DISTINCT dataset_id) AS nv, count(DISTINCT channel) AS nc FROM r WHERE train GROUP BY ALL) SELECT dataset_id, coalesce(nv >= 2 AND nc >= 2, FALSE) AS supported FROM r LEFT JOIN s USING (leaf, format, title) WHERE NOT train")
def p18_training_support(v: Views):
    rows = v.content.withColumn("split", channel_split(c("channel")))
    seen = rows.where("split = 'train'").groupBy("leaf", "format", "title").agg(F.count_distinct("dataset_id").alias("nv"), F.count_distinct("channel").alias("nc"))
    return rows.where("split <> 'train'").join(seen, ["leaf", "format", "title"], "left").select("dataset_id", F.coalesce((c("nv") >= 2) & (c("nc") >= 2), F.lit(False)).alias("supported"))


@query("WITH q AS (SELECT leaf, format FROM content GROUP BY 1, 2 HAVING count(*) >= 18 AND count(DISTINCT channel) >= 5) SELECT dataset_id, leaf, format FROM content SEMI JOIN q USING (leaf, format)")
def p19_qualified_context(v: Views):
    qualified = v.content.groupBy("leaf", "format").agg(F.count("*").alias("n"), F.count_distinct("channel").alias("nc")).where("n >= 18 and nc >= 5")
    return v.content.join(qualified, ["leaf", "format"], "left_semi").select("dataset_id", "leaf", "format")


@query("""WITH top AS (SELECT term FROM terms GROUP BY 1 ORDER BY count(*) DESC, term LIMIT 5), d AS (SELECT dataset_id, length(text) AS n FROM transcripts),
h AS (SELECT dataset_id, term, tf FROM terms JOIN top USING (term))
SELECT d.dataset_id, top.term, CASE WHEN n < 100 THEN 'unassessable' WHEN tf IS NOT NULL THEN 'already_detected' WHEN n < 1000 THEN 'insufficient_context' ELSE 'eligible' END AS decision FROM d CROSS JOIN top LEFT JOIN h ON h.dataset_id = d.dataset_id AND h.term = top.term""")
def p20_actionable_topics(v: Views):
    top = v.terms.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(5).select("term")
    listed = top.agg(F.array_sort(F.collect_list("term")).alias("topics"))  # five terms in one row
    docs = v.transcripts.select("dataset_id", F.length("text").alias("n")).join(F.broadcast(listed), F.lit(True)).select("dataset_id", "n", F.explode("topics").alias("term"))
    hits = v.terms.join(F.broadcast(top), "term").select("dataset_id", "term", "tf")
    decision = F.when(c("n") < 100, "unassessable").when(c("tf").isNotNull(), "already_detected").when(c("n") < 1000, "insufficient_context").otherwise("eligible")
    return docs.join(hits, ["dataset_id", "term"], "left").select("dataset_id", "term", decision.alias("decision"))


@query(f"WITH r AS (SELECT *, {bucket_sql('channel', 100)} AS b FROM content), t AS (SELECT DISTINCT title, duration FROM r WHERE b < 70) SELECT dataset_id, t.title IS NOT NULL AS seen_in_training, count(*) OVER (PARTITION BY r.title, r.duration) > 1 AS duplicated FROM r LEFT JOIN t ON r.title = t.title AND r.duration = t.duration WHERE b >= 85")
def p21_sealed_holdout(v: Views):
    rows = v.content.withColumn("split", channel_split(c("channel")))
    known = rows.where("split = 'train'").select("title", "duration").distinct().withColumn("seen", F.lit(True))
    held = rows.where("split = 'test'")
    copies = held.groupBy("title", "duration").agg(F.count("*").alias("n"))
    return held.join(known, ["title", "duration"], "left").join(copies, ["title", "duration"]).select("dataset_id", F.coalesce("seen", F.lit(False)).alias("seen_in_training"), (c("n") > 1).alias("duplicated"))


@query(r"SELECT dataset_id, len(regexp_extract_all(text, '[A-Za-z]')) / greatest(length(text), 1)::DOUBLE AS letter_ratio, length(text) = 0 OR regexp_matches(text, '(?i)all rights reserved') AS notice FROM transcripts")
def p22_transcript_flags(v: Views):
    ratio = F.regexp_count("text", F.lit("[A-Za-z]")) / F.greatest(F.length("text"), F.lit(1))
    return v.transcripts.select("dataset_id", ratio.alias("letter_ratio"), ((F.length("text") == 0) | c("text").rlike("(?i)all rights reserved")).alias("notice"))


@query("WITH demo AS (SELECT user_id FROM customers WHERE balance < 0) SELECT (SELECT count(*) FROM demo) AS demo_rows, (SELECT count(*) FROM analyses SEMI JOIN demo USING (user_id)) AS analyses_of_demo, (SELECT count(*) FROM customers WHERE balance >= 0) AS production_rows, (SELECT count(*) FROM analyses SEMI JOIN demo USING (user_id)) = 0 AS ready")
def p23_demo_guard(v: Views):
    demo = v.customers.where("balance < 0").select("user_id")
    people = v.customers.agg(F.count_if(c("balance") < 0).alias("demo_rows"), F.count_if(c("balance") >= 0).alias("production_rows"))
    used = v.analyses.join(demo, "user_id", "left_semi").agg(F.count("*").alias("analyses_of_demo"))
    return people.join(F.broadcast(used), F.lit(True)).withColumn("ready", c("analyses_of_demo") == 0)  # one row each


@query("WITH " + LAST + " SELECT dataset_id, l.views AS observed_views, CASE WHEN l.entity IS NULL THEN 'unobserved' WHEN l.views IS NULL THEN 'failed' WHEN mv <> 'v2' THEN 'unknown_metric' WHEN l.views < 10 THEN 'few_views' END AS excluded FROM content LEFT JOIN l ON l.entity = content.dataset_id")
def p24_cohort_records(v: Views):
    last = last_readings(v).select("entity", c("views").alias("observed_views"), "mv")
    reason = first_reason((c("entity").isNull(), "unobserved"), (c("observed_views").isNull(), "failed"), (c("mv") != "v2", "unknown_metric"), (c("observed_views") < 10, "few_views"))
    return v.content.join(last, c("dataset_id") == c("entity"), "left").select("dataset_id", "observed_views", reason.alias("excluded"))


@query(r"WITH k AS (SELECT dataset_id, unnest(['digest=' || sha256(text), 'identity=' || sha256(nullif(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}]', '', 'g'), ''))]) AS ident FROM transcripts), r AS (SELECT DISTINCT ident FROM k JOIN transcripts USING (dataset_id) WHERE split = 'train') SELECT dataset_id, count(*) AS reused_keys FROM k SEMI JOIN r USING (ident) JOIN transcripts USING (dataset_id) WHERE split <> 'train' GROUP BY 1")
def p25_identity_registry(v: Views):
    from trendloom.functions.text import identity

    keys = v.transcripts.select("dataset_id", "split", F.explode(F.array(F.concat(F.lit("digest="), F.sha2("text", 256)), F.concat(F.lit("identity="), identity(c("text"))))).alias("ident")).where("ident is not null")
    registry = keys.where("split = 'train'").select("ident").distinct()
    return keys.where("split <> 'train'").join(registry, "ident", "left_semi").groupBy("dataset_id").agg(F.count("*").alias("reused_keys"))


@query("WITH cell AS (SELECT leaf, format, count(*) AS n, count(DISTINCT channel) AS nc FROM content GROUP BY 1, 2) SELECT dataset_id, " + reasons_sql(("n < 18", "few_videos"), ("nc < 12", "few_channels"), ("metric_version <> 'v2'", "metric"), ("duration > 40", "duration")) + " AS reasons FROM content JOIN cell USING (leaf, format)")
def p26_context_reasons(v: Views):
    cell = v.content.groupBy("leaf", "format").agg(F.count("*").alias("n"), F.count_distinct("channel").alias("nc"))
    return v.content.join(cell, ["leaf", "format"]).select("dataset_id", all_reasons((c("n") < 18, "few_videos"), (c("nc") < 12, "few_channels"), (c("metric_version") != "v2", "metric"), (c("duration") > 40, "duration")).alias("reasons"))


@query("""WITH d AS (SELECT conv_id, string_agg(text, ' ' ORDER BY segment_index) AS body, coalesce(string_agg(text, ' ' ORDER BY segment_index) FILTER (start < 20), '') AS hook FROM segments GROUP BY 1)
SELECT conv_id, CASE WHEN length(body) < 150 THEN 'unassessable' WHEN contains(lower(body), 'tion') THEN 'detected' ELSE 'not_detected' END AS whole, CASE WHEN length(hook) < 150 THEN 'unassessable' WHEN contains(lower(hook), 'tion') THEN 'detected' ELSE 'not_detected' END AS hook FROM d""")
def p27_text_observation(v: Views):
    whole = v.segments.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("segment_index", "start", "text"))).alias("s"))
    body = F.array_join(F.transform("s", lambda x: x["text"]), " ")
    hook = F.array_join(F.transform(F.filter("s", lambda x: x["start"] < 20), lambda x: x["text"]), " ")
    state = lambda t: F.when(F.length(t) < 150, "unassessable").when(F.lower(t).contains("tion"), "detected").otherwise("not_detected")
    return whole.select("conv_id", state(body).alias("whole"), state(hook).alias("hook"))


@query("""WITH r AS (SELECT *, sha256(text) AS digest, leaf || ':' || n_chars::VARCHAR AS grp FROM transcripts), h AS (SELECT * FROM r WHERE split <> 'train')
SELECT dataset_id, channel, leaf FROM r WHERE split = 'train' AND channel NOT IN (SELECT channel FROM h) AND (grp IS NULL OR grp NOT IN (SELECT grp FROM h WHERE grp IS NOT NULL)) AND digest NOT IN (SELECT digest FROM h)""")
def j05_leakage_anti_join(v: Views):
    rows = v.transcripts.withColumn("digest", F.sha2("text", 256)).withColumn("grp", F.concat("leaf", F.lit(":"), c("n_chars").cast("string")))
    return without_leaks(rows.where("split = 'train'"), rows.where("split <> 'train'"), ["channel", "grp", "digest"]).select("dataset_id", "channel", "leaf")


#: the normal form of Latin texts in SQL, which has no compatibility forms
NORMAL = r"regexp_replace(replace(lower(nfc_normalize({})), 'ß', 'ss'), '\s+', '', 'g')"


@query(f"""WITH a AS (SELECT item_id AS case_id, 'd' || item_id * 3 AS record_key, {NORMAL.format('text')} AS t FROM benchmark), b AS (SELECT dataset_id AS id, 'd' || dataset_id AS record_key, {NORMAL.format('text')} AS t FROM transcripts),
ga AS (SELECT case_id, unnest(list_distinct(list_transform(range(1, length(t) - 10), lambda i: substr(t, i, 12)))) AS gram FROM a WHERE length(t) >= 200), gb AS (SELECT id, unnest(list_distinct(list_transform(range(1, length(t) - 10), lambda i: substr(t, i, 12)))) AS gram FROM b WHERE length(t) >= 200),
na AS (SELECT case_id, count(*) AS na FROM ga GROUP BY 1), nb AS (SELECT id, count(*) AS nb FROM gb GROUP BY 1), k AS (SELECT case_id, id, count(*) AS k FROM ga JOIN gb USING (gram) GROUP BY 1, 2),
r AS (SELECT case_id, id, 'near_transcript_requires_review' AS reason FROM k JOIN na USING (case_id) JOIN nb USING (id) JOIN a USING (case_id) JOIN b USING (id) WHERE k >= 0.8 * least(na, nb) AND a.t <> b.t
UNION ALL SELECT case_id, id, 'exact_transcript' FROM a JOIN b ON a.t = b.t AND a.t <> '' UNION ALL SELECT case_id, id, 'record_key' FROM a JOIN b USING (record_key))
SELECT case_id, id, array_to_string(list_sort(list(reason)), ',') AS reasons FROM r GROUP BY 1, 2""")
def j10_overlap_audit(v: Views):
    """Texts that share an identity, the normal text or most 12-character runs with a benchmark item."""
    cases = v.table("benchmark").select(c("item_id").alias("id"), F.concat(F.lit("d"), c("item_id") * 3).alias("record_key"), "text")
    pool = v.transcripts.select(c("dataset_id").alias("id"), F.concat(F.lit("d"), c("dataset_id")).alias("record_key"), "text")
    return overlaps(cases, pool, ["record_key"])


@query("WITH p AS (SELECT dataset_id, 'by_id' AS role FROM content WHERE dataset_id % 7 = 0), q AS (SELECT title, 'by_title' AS role FROM content WHERE leaf = 'PROMO' GROUP BY title) SELECT c.dataset_id, array_to_string(list_sort(list_filter([p.role, q.role], lambda x: x IS NOT NULL)), ',') AS roles FROM content c LEFT JOIN p ON p.dataset_id = c.dataset_id LEFT JOIN q ON q.title = c.title")
def j18_prior_roles(v: Views):
    by_id = v.content.where("dataset_id % 7 = 0").select("dataset_id", F.array(F.lit("by_id")).alias("a"))
    by_title = v.content.where("leaf = 'PROMO'").select("title").distinct().withColumn("b", F.array(F.lit("by_title")))
    none = F.array().cast("array<string>")
    rows = v.content.join(by_id, "dataset_id", "left").join(by_title, "title", "left")
    return rows.select("dataset_id", F.array_join(F.array_sort(F.array_union(F.coalesce("a", none), F.coalesce("b", none))), ",").alias("roles"))


#: the six identities of a record, as the tables can give them
KEYS = ("channel_key", "creator_group", "video_key", "transcript_sha256", "normalized_sha256", "near_duplicate_group")
SAMPLE_KEYS = KEYS[2:]


@query(rf"""WITH RECURSIVE r AS MATERIALIZED (SELECT dataset_id AS id, CASE WHEN {bucket_sql("(dataset_id // 4)", 10)} < 7 THEN 'fit' ELSE 'independent_test' END AS role, 'c' || dataset_id // 4 AS channel_key, CASE WHEN dataset_id % 40 < 8 THEN 'g' || dataset_id // 40 END AS creator_group, CASE WHEN dataset_id % 14 < 2 THEN 'v' || dataset_id // 14 END AS video_key,
 sha256(text) AS transcript_sha256, sha256(nullif({NORMAL.format('text')}, '')) AS normalized_sha256, sha256(nullif(array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}]+'))), ' '), '')) AS near_duplicate_group FROM transcripts),
k AS MATERIALIZED (SELECT id, role, unnest([{', '.join(f"'{x}:' || {x}" for x in KEYS)}]) AS ident FROM r), s AS MATERIALIZED (SELECT id, role, ident FROM k WHERE ident IS NOT NULL AND NOT starts_with(ident, 'channel_key') AND NOT starts_with(ident, 'creator_group')),
lo AS (SELECT ident, min(id) AS low FROM k WHERE ident IS NOT NULL GROUP BY 1), e AS MATERIALIZED (SELECT DISTINCT id AS a, low AS b FROM k JOIN lo USING (ident) WHERE id <> low), b AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
cc AS (SELECT id, id AS low FROM r UNION SELECT b.a, cc.low FROM cc JOIN b ON b.b = cc.id WHERE cc.low < b.a), comp AS MATERIALIZED (SELECT id, min(low) AS component FROM cc GROUP BY 1),
cr AS (SELECT component FROM comp JOIN r USING (id) GROUP BY 1 HAVING min(role) < max(role)), g AS (SELECT ident, min(id) AS keep, min(role) < max(role) AS mixed FROM s GROUP BY 1 HAVING count(*) > 1),
x AS (SELECT id, 'identity_crosses_outcome_partitions' AS reason FROM comp SEMI JOIN cr USING (component) UNION SELECT id, CASE WHEN mixed THEN 'identity_crosses_outcome_partitions' ELSE 'duplicate_video_or_transcript' END FROM s JOIN g USING (ident) WHERE mixed OR id <> keep)
SELECT comp.id, component, coalesce(array_to_string(list_sort(list(reason) FILTER (reason IS NOT NULL)), ','), '') AS reasons FROM comp LEFT JOIN x ON x.id = comp.id GROUP BY 1, 2""")
def j19_identity_components(v: Views):
    """Records that share one of six identities, and whether that keeps them out: across roles, or as duplicates."""
    part = lambda p, n: F.concat(F.lit(p), F.expr(f"dataset_id div {n}"))
    r = v.transcripts.select(
        "dataset_id", F.when(bucket(F.expr("dataset_id div 4"), 10) < 7, "fit").otherwise("independent_test").alias("role"), part("c", 4).alias("channel_key"), F.when(c("dataset_id") % 40 < 8, part("g", 40)).alias("creator_group"),
        F.when(c("dataset_id") % 14 < 2, part("v", 14)).alias("video_key"), F.sha2("text", 256).alias("transcript_sha256"), F.sha2(F.nullif(normal_form("text"), F.lit("")), 256).alias("normalized_sha256"),
        F.sha2(F.nullif(F.array_join(F.array_sort(F.array_distinct(words(c("text")))), " "), F.lit("")), 256).alias("near_duplicate_group"),
    )
    return identity_issues(r, "dataset_id", list(KEYS), list(SAMPLE_KEYS), "role")


@query("WITH k AS (SELECT split, unnest(['channel', 'digest', 'leaf']) AS key, unnest([channel, sha256(text), leaf]) AS value FROM transcripts) SELECT key, value, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM k GROUP BY 1, 2 HAVING count(DISTINCT split) > 1")
def a25_partition_conflicts(v: Views):
    return conflicts(v.transcripts.withColumn("digest", F.sha2("text", 256)), ["channel", "digest", "leaf"])
