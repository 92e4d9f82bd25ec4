"""Aggregations (family A)."""

from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from trendloom.functions.reasons import all_reasons
from trendloom.functions.splits import channel_split
from trendloom.operators import benchmark as B
from trendloom.operators import readiness as R
from trendloom.operators.components import checkpointed
from trendloom.operators.ranking import rank_within
from trendloom.plans.eligibility import reasons_sql
from trendloom.functions.text import phrase_counts, tokens
from trendloom.plans.registry import STOP_SQL, bucket_sql, query
from trendloom.sources.views import Views

c = F.col


@query("SELECT count(*) AS total, count(*) FILTER (status = 'O') AS active, count(*) FILTER (user_id % 10 = 3) AS mine, count(DISTINCT user_id) AS users, max(created_at) AS latest FROM analyses")
def a01_kpi_counts(v: Views):
    return v.analyses.agg(F.count("*").alias("total"), F.count_if(c("status") == "O").alias("active"), F.count_if(c("user_id") % 10 == 3).alias("mine"), F.count_distinct("user_id").alias("users"), F.max("created_at").alias("latest"))


@query("SELECT coalesce(leaf, 'unknown') AS leaf, format, count(*) AS n, CAST(sum(views) AS BIGINT) // count(*) AS mean_views, CAST(sum(likes) AS BIGINT) AS likes FROM content GROUP BY 1, 2")
def a02_admin_report(v: Views):
    return v.content.groupBy(F.coalesce("leaf", F.lit("unknown")).alias("leaf"), "format").agg(F.count("*").alias("n"), F.floor(F.sum("views") / F.count("*")).alias("mean_views"), F.sum("likes").alias("likes"))


@query("SELECT status, count(*) AS n, max(created_at) AS last_at, count(*) FILTER (priority LIKE '1%') / count(*)::DOUBLE AS urgent_ratio FROM analyses GROUP BY 1")
def a03_admin_statistics(v: Views):
    return v.analyses.groupBy("status").agg(F.count("*").alias("n"), F.max("created_at").alias("last_at"), (F.count_if(c("priority").like("1%")) / F.count("*")).alias("urgent_ratio"))


@query("""WITH d AS (SELECT CAST(created_at + INTERVAL 7 HOUR AS DATE) AS day, count(*) AS n FROM analyses GROUP BY 1), r AS (SELECT min(day) AS lo, max(day) AS hi FROM d),
g AS (SELECT CAST(unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day FROM r) SELECT g.day, coalesce(n, 0) AS n FROM g LEFT JOIN d ON g.day = d.day""")
def a04_usage_series(v: Views):
    days = v.analyses.groupBy(F.to_date(F.expr("created_at + INTERVAL 7 HOURS")).alias("day")).agg(F.count("*").alias("n"))
    grid = days.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("day"))
    return grid.join(days, "day", "left").select("day", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("WITH dim AS (SELECT DISTINCT leaf FROM content) SELECT leaf, count(dataset_id) AS verified, count(dataset_id) >= 20 AS ready FROM dim LEFT JOIN (SELECT * FROM content WHERE metric_version = 'v2' AND views >= 1500000) USING (leaf) GROUP BY 1")
def a05_taxonomy_coverage(v: Views):
    leaves = v.content.select("leaf").distinct()
    good = v.content.where("metric_version = 'v2' and views >= 1500000").groupBy("leaf").agg(F.count("*").alias("n"))
    return leaves.join(good, "leaf", "left").select("leaf", F.coalesce("n", F.lit(0)).cast("long").alias("verified"), (F.coalesce("n", F.lit(0)) >= 20).alias("ready"))


#: ids in a packed number: room for every id, and the largest
ID_ROOM, MAX_ID = Decimal(2**64), Decimal(2**63 - 1)


@query(r"""WITH r AS (SELECT t.leaf, t.term, t.tf, t.channel, t.dataset_id, 1.0::DOUBLE + coalesce(quality, 0) AS w FROM terms t JOIN transcripts USING (dataset_id)),
e AS (SELECT leaf, term, count(*) AS support, CAST(sum(tf) AS BIGINT) AS freq, sum(ln(1.0::DOUBLE + tf)) AS signal, sum(w) AS weight, count(DISTINCT channel) AS channels, arg_max(dataset_id, (tf, -dataset_id)) AS example FROM r GROUP BY 1, 2),
d AS (SELECT leaf, count(*) AS docs, sum(1.0::DOUBLE + coalesce(quality, 0)) AS total FROM transcripts GROUP BY 1), m AS (SELECT leaf, max(signal) AS top FROM e GROUP BY 1)
SELECT leaf, term, support, freq, channels, example, round(0.45::DOUBLE * support / docs + 0.25::DOUBLE * signal / top + 0.30::DOUBLE * weight / total, 6) AS score FROM e JOIN d USING (leaf) JOIN m USING (leaf) WHERE support >= CASE WHEN docs < 4 THEN 1 ELSE 2 END""")
def a06_keyword_evidence(v: Views):
    """Document share, damped frequency and share of the rows' weight (a reviewed good row counts twice), with the best example."""
    weight = F.lit(1.0) + F.coalesce("quality", F.lit(0))
    rows = v.transcripts.select("dataset_id", "channel", "leaf", weight.alias("w"), F.inline(phrase_counts(tokens(c("text"))))).withColumnsRenamed({"value": "term", "n": "tf"})
    most = c("tf").cast("decimal(10,0)") * F.lit(ID_ROOM) + F.lit(MAX_ID) - c("dataset_id").cast("decimal(20,0)")  # a number, so that sums stay in hash tables
    e = checkpointed(rows.groupBy("leaf", "term").agg(
        F.count("*").alias("support"), F.sum("tf").alias("freq"), F.sum(F.log1p("tf")).alias("signal"), F.sum("w").alias("weight"), F.count_distinct("channel").alias("channels"),
        F.max(most).alias("most"),
    ).withColumn("example", (F.lit(MAX_ID) - c("most") % F.lit(ID_ROOM)).cast("long")))  # read twice below
    docs = v.transcripts.groupBy("leaf").agg(F.count("*").alias("docs"), F.sum(weight).alias("total"))
    top = e.groupBy("leaf").agg(F.max("signal").alias("top"))
    out = e.join(docs, "leaf").join(top, "leaf").where(c("support") >= F.when(c("docs") < 4, 1).otherwise(2))
    score = F.lit(0.45) * c("support") / c("docs") + F.lit(0.25) * c("signal") / c("top") + F.lit(0.30) * c("weight") / c("total")
    return out.select("leaf", "term", "support", "freq", "channels", "example", F.round(score, 6).alias("score"))


@query("""SELECT leaf, count(*) AS n, CASE WHEN count(*) >= 10 THEN quantile_cont(duration, 0.25) END AS p25, CASE WHEN count(*) >= 10 THEN quantile_cont(duration, 0.5) END AS p50, CASE WHEN count(*) >= 10 THEN quantile_cont(duration, 0.75) END AS p75 FROM content GROUP BY 1""")
def a07_duration_summary(v: Views):
    s = v.content.groupBy("leaf").agg(F.count("*").alias("n"), F.percentile("duration", [0.25, 0.5, 0.75]).alias("p"))
    return s.select("leaf", "n", *[F.when(c("n") >= 10, c("p")[i]).alias(name) for i, name in enumerate(("p25", "p50", "p75"))])


MEDIAN = """w AS (SELECT leaf, format, views, dataset_id, sum(1.0::DOUBLE / n) OVER (PARTITION BY leaf, format ORDER BY views, dataset_id ROWS UNBOUNDED PRECEDING) AS cum FROM (SELECT *, count(*) OVER (PARTITION BY leaf, format, channel) AS n FROM content)),
tot AS (SELECT leaf, format, count(DISTINCT channel) AS t, count(*) AS nv FROM content GROUP BY 1, 2), med AS (SELECT leaf, format, min(views) AS threshold FROM w JOIN tot USING (leaf, format) WHERE cum + 1e-9 >= t / 2.0::DOUBLE GROUP BY 1, 2)"""


@query("WITH " + MEDIAN + " SELECT * FROM med")
def a08_weighted_median(v: Views):
    return B.weighted_median(v.content, ["leaf", "format"])


@query("WITH " + MEDIAN + " SELECT leaf, format, nv, t AS channels, threshold, " + reasons_sql(("nv < 20", "few_videos"), ("t < 12", "few_channels")) + " AS reasons FROM tot JOIN med USING (leaf, format)")
def a09_benchmark_cells(v: Views):
    cell = v.content.groupBy("leaf", "format").agg(F.count("*").alias("nv"), F.count_distinct("channel").alias("channels"))
    return cell.join(B.weighted_median(v.content, ["leaf", "format"]), ["leaf", "format"]).withColumn("reasons", all_reasons((c("nv") < 20, "few_videos"), (c("channels") < 12, "few_channels")))


@query("WITH " + MEDIAN + f" SELECT dataset_id, CASE WHEN {bucket_sql('channel', 100)} >= 85 THEN NULL ELSE CAST(views > threshold AS INT) END AS label, views = threshold AS tie FROM content LEFT JOIN med USING (leaf, format)")
def a10_labels(v: Views):
    rows = v.content.join(B.weighted_median(v.content, ["leaf", "format"]), ["leaf", "format"], "left")
    sealed = channel_split(c("channel")) == "test"
    return rows.select("dataset_id", F.when(~sealed, (c("views") > c("threshold")).cast("int")).alias("label"), (c("views") == c("threshold")).alias("tie"))


@query("SELECT split, leaf, count(*) AS n, count(DISTINCT channel) AS channels FROM transcripts GROUP BY GROUPING SETS ((split, leaf), (split), ())")
def a11_coverage_report(v: Views):
    rows = v.transcripts.groupingSets([[c("split"), c("leaf")], [c("split")], []], c("split"), c("leaf"))
    return rows.agg(F.count("*").alias("n"), F.count_distinct("channel").alias("channels")).select("split", "leaf", "n", "channels")


@query("WITH " + MEDIAN + ", r AS (SELECT leaf, format, split_part(title, ' ', 1) AS topic, count(*) AS n, count(DISTINCT channel) AS channels, count(*) FILTER (views > threshold) AS above FROM content JOIN med USING (leaf, format) GROUP BY ALL) SELECT leaf, format, topic, n, above, 100.0::DOUBLE * above / n AS share FROM r WHERE n >= 2 AND channels >= 2")
def a12_group_response(v: Views):
    rows = v.content.join(B.weighted_median(v.content, ["leaf", "format"]), ["leaf", "format"]).withColumn("topic", F.split_part("title", F.lit(" "), F.lit(1)))
    s = rows.groupBy("leaf", "format", "topic").agg(F.count("*").alias("n"), F.count_distinct("channel").alias("channels"), F.count_if(c("views") > c("threshold")).alias("above"))
    return s.where("n >= 2 and channels >= 2").select("leaf", "format", "topic", "n", "above", (F.lit(100.0) * c("above") / c("n")).alias("share"))


@query("""WITH s AS (SELECT channel, leaf, quantile_cont(views, 0.5) FILTER (title LIKE 'new%') AS d, quantile_cont(views, 0.5) FILTER (title NOT LIKE 'new%') AS a FROM content GROUP BY 1, 2),
k AS (SELECT channel, quantile_cont(d - a, 0.5) AS diff, count(*) AS strata FROM s WHERE d IS NOT NULL AND a IS NOT NULL GROUP BY 1)
SELECT count(*) AS channels, quantile_cont(diff, 0.5) AS median_diff, CASE WHEN count(*) < 5 THEN 'insufficient' WHEN count(*) < 10 THEN 'descriptive' ELSE 'comparable' END AS status FROM k""")
def a13_paired_comparison(v: Views):
    hit = c("title").like("new%")
    s = v.content.groupBy("channel", "leaf").agg(F.percentile(F.when(hit, c("views")), 0.5).alias("d"), F.percentile(F.when(~hit, c("views")), 0.5).alias("a"))
    k = s.where("d is not null and a is not null").groupBy("channel").agg(F.percentile(c("d") - c("a"), 0.5).alias("diff"))
    n = F.count("*")
    return k.agg(n.alias("channels"), F.percentile("diff", 0.5).alias("median_diff"), F.when(n < 5, "insufficient").when(n < 10, "descriptive").otherwise("comparable").alias("status"))


@query("SELECT channel, count(*) AS n, quantile_cont(views, 0.5) AS median, quantile_cont(views, 0.25) AS p25, quantile_cont(views, 0.75) AS p75 FROM content GROUP BY 1")
def a14_distribution(v: Views):
    s = v.content.groupBy("channel").agg(F.count("*").alias("n"), F.percentile("views", [0.5, 0.25, 0.75]).alias("p"))
    return s.select("channel", "n", c("p")[0].alias("median"), c("p")[1].alias("p25"), c("p")[2].alias("p75"))


@query("""WITH m AS (SELECT max(ts) AS now_ts FROM events) SELECT event_type AS platform, max(ts) AS last_attempt, max(ts) FILTER (value > 5) AS last_success, count(*) FILTER (ts > now_ts - INTERVAL 24 HOUR) AS n_24h, arg_max(user_id, (ts, event_id)) AS last_user FROM events, m GROUP BY 1""")
def a19_source_health(v: Views):
    now = v.table("events").agg(F.max("ts").alias("now_ts"))  # one row
    rows = v.table("events").join(F.broadcast(now), F.lit(True))
    return rows.groupBy(c("event_type").alias("platform")).agg(
        F.max("ts").alias("last_attempt"), F.max(F.when(c("value") > 5, c("ts"))).alias("last_success"), F.count_if(c("ts") > c("now_ts") - F.expr("INTERVAL 24 HOURS")).alias("n_24h"),
        F.max_by("user_id", F.struct("ts", "event_id")).alias("last_user"),
    )


@query("SELECT entity, arg_max(views, (us, obs_id)) FILTER (views IS NOT NULL) AS last_views, count(*) AS readings, CAST(ceil(count(*) / 50.0::DOUBLE) AS BIGINT) AS calls FROM observations GROUP BY 1")
def a20_statistics_overview(v: Views):
    at = F.when(c("views").isNotNull(), F.struct("us", "obs_id"))
    return v.observations.groupBy("entity").agg(F.max_by("views", at).alias("last_views"), F.count("*").alias("readings"), F.ceil(F.count("*") / 50).alias("calls"))


CHECKS = {"likes": "likes >= 100", "comments": "comments >= 3", "dates": "captured > published", "views": "views >= 1000"}


@query(f"""WITH r AS (SELECT *, {bucket_sql('channel', 100)} AS b FROM content), ch AS (SELECT leaf, channel, count(*) AS n FROM r GROUP BY 1, 2), top AS (SELECT leaf, max(n) AS m FROM ch GROUP BY 1),
co AS (SELECT leaf, metric_version, count(*) AS cohort FROM r GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY leaf ORDER BY cohort DESC, metric_version DESC) = 1),
up AS (SELECT leaf, count(*) FILTER (k <= ceil(n * 0.4::DOUBLE)) AS upper_pool, count(*) FILTER (k > ceil(n * 0.4::DOUBLE)) AS comparison_pool FROM (SELECT leaf, row_number() OVER (PARTITION BY leaf ORDER BY views) AS k, count(*) OVER (PARTITION BY leaf) AS n FROM r JOIN co USING (leaf, metric_version)) GROUP BY 1),
p AS (SELECT leaf, count(*) AS n, count(DISTINCT channel) AS channels, any_value(m) / count(*)::DOUBLE AS largest_share, count(*) FILTER (b < 70) AS n_train, count(*) FILTER (b BETWEEN 70 AND 84) AS n_validation, count(*) FILTER (b > 84) AS n_test, count(*) FILTER (duration <= 300) AS durations,
{", ".join(f"count(*) - count(*) FILTER ({ok}) AS missing_{name}" for name, ok in CHECKS.items())} FROM r JOIN top USING (leaf) GROUP BY 1)
SELECT *, {reasons_sql(("n < 80", "more_rows"), ("channels < 10", "more_channels"), ("largest_share > 0.4", "one_channel_dominates"), ("n_validation < 5", "more_validation"), ("n_test < 5", "more_test"), ("upper_pool < 10", "more_upper"), ("comparison_pool < 10", "more_comparison"), ("durations < 10", "more_durations"), (" OR ".join(f"missing_{x} > 0" for x in CHECKS), "mend_fields"))} AS actions FROM p JOIN co USING (leaf) JOIN up USING (leaf)""")
def a21_category_readiness(v: Views):
    rows = v.content.withColumn("split", channel_split(c("channel")))
    return R.category_plan(rows, {name: F.expr(ok) for name, ok in CHECKS.items()})


@query("WITH plan(leaf, target) AS (VALUES ('en', 400), ('de', 100), ('fr', 100), ('es', 100), ('it', 50)) SELECT p.leaf, CAST(target AS BIGINT) AS target, count(dataset_id) AS accepted, greatest(target - count(dataset_id), 0) AS missing, least(100.0::DOUBLE, 100.0::DOUBLE * count(dataset_id) / target) AS percent FROM plan p LEFT JOIN (SELECT * FROM transcripts WHERE quality = 1) t ON t.leaf = p.leaf GROUP BY p.leaf, target")
def a22_collection_progress(v: Views):
    plan = v.spark.createDataFrame([("en", 400), ("de", 100), ("fr", 100), ("es", 100), ("it", 50)], "leaf string, target long")
    got = v.transcripts.where("quality = 1").groupBy("leaf").agg(F.count("*").alias("n"))
    rows = F.broadcast(plan).join(got, "leaf", "left").select("leaf", "target", F.coalesce("n", F.lit(0)).cast("long").alias("accepted"))
    return rows.select("leaf", "target", "accepted", F.greatest(c("target") - c("accepted"), F.lit(0)).alias("missing"), F.least(F.lit(100.0), F.lit(100.0) * c("accepted") / c("target")).alias("percent"))


@query("WITH f AS (SELECT sha256(text) AS digest, arg_min(leaf, dataset_id) AS leaf, arg_min(channel, dataset_id) AS channel FROM transcripts GROUP BY 1) SELECT leaf, channel, count(*) AS n FROM f GROUP BY 1, 2")
def a23_dedup_catalog(v: Views):
    first = v.transcripts.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min_by(F.struct("leaf", "channel"), "dataset_id").alias("r"))
    return first.groupBy("r.leaf", "r.channel").agg(F.count("*").alias("n"))


@query("SELECT split, leaf, count(*) AS n, count(DISTINCT channel) AS channels, " + reasons_sql(("count(*) < 10", "few_rows"), ("count(DISTINCT channel) < 3", "few_channels")) + " AS issues FROM transcripts GROUP BY 1, 2")
def a24_corpus_readiness(v: Views):
    g = v.transcripts.groupBy("split", "leaf").agg(F.count("*").alias("n"), F.count_distinct("channel").alias("channels"))
    return g.withColumn("issues", all_reasons((c("n") < 10, "few_rows"), (c("channels") < 3, "few_channels")))


@query("SELECT sha256(text) AS digest, count(*) AS n, min(dataset_id) AS first_id, array_to_string(list_sort(list(DISTINCT channel)), ',') AS channels FROM transcripts GROUP BY 1 HAVING count(*) > 1")
def a26_duplicate_groups(v: Views):
    g = v.transcripts.groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"), F.min("dataset_id").alias("first_id"), F.collect_set("channel").alias("s"))
    return g.where("n > 1").select("digest", "n", "first_id", F.array_join(F.array_sort("s"), ",").alias("channels"))


@query("SELECT event_type AS platform, count(*) AS n, count(user_id) AS has_key, count(*) FILTER (value > 0) AS valid_value, count(*) FILTER (TRY_CAST(props::JSON ->> '$.k' AS BIGINT) IS NOT NULL) AS valid_props FROM events GROUP BY 1")
def a27_quality_profile(v: Views):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return v.table("events").groupBy(c("event_type").alias("platform")).agg(F.count("*").alias("n"), F.count("user_id").alias("has_key"), F.count_if(c("value") > 0).alias("valid_value"), F.count_if(k.isNotNull()).alias("valid_props"))


@query("""WITH e AS (SELECT *, props::JSON ->> '$.k' AS title FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM e)
SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, len(list_distinct(list(event_type))) AS scopes, len(list_distinct(list(title))) AS title_variants, max(title) FILTER (k = 1) AS latest_title, max(event_type) FILTER (k = 1) AS latest_type FROM r GROUP BY 1""")
def a28_entity_rollup(v: Views):
    """First and last time, scopes, variants of the title (the value of ``k``) and the latest title and type of each entity."""
    rows = v.table("events").withColumn("title", F.get_json_object("props", "$.k"))
    g = rows.groupBy("user_id").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count_distinct("event_type").alias("scopes"), F.count_distinct("title").alias("title_variants"),
        F.max_by(F.struct("title", "event_type"), F.struct("ts", "event_id")).alias("l"),
    )
    return g.select("user_id", "first_seen", "last_seen", "scopes", "title_variants", c("l.title").alias("latest_title"), c("l.event_type").alias("latest_type"))


#: gold is the language; the prediction is by the letters a text contains, so that there is something to measure
PRED = "CASE WHEN regexp_matches(text, 'ñ') THEN 'es' WHEN regexp_matches(text, '[äöüß]') THEN 'de' WHEN regexp_matches(text, '[éèêç]') THEN 'fr' ELSE 'en' END"


def predicted(v: Views):
    t = c("text")
    pred = F.when(t.rlike("ñ"), "es").when(t.rlike("[äöüß]"), "de").when(t.rlike("[éèêç]"), "fr").otherwise("en")
    return v.transcripts.select("dataset_id", "channel", "split", c("leaf").alias("gold"), pred.alias("pred"), "n_chars", "quality")


METRICS = "p AS (SELECT dataset_id, channel, split, leaf AS gold, " + PRED + " AS pred, n_chars, quality FROM transcripts), l AS (SELECT gold AS label, 1 AS g, 0 AS q, CAST(gold = pred AS INT) AS h, split FROM p UNION ALL SELECT pred, 0, 1, 0, split FROM p)"


@query("WITH " + METRICS + " SELECT label, sum(h) / nullif(sum(q), 0)::DOUBLE AS precision, sum(h) / nullif(sum(g), 0)::DOUBLE AS recall, 2.0::DOUBLE * sum(h)::BIGINT / (sum(q) + sum(g))::BIGINT AS f1, CAST(sum(g) AS BIGINT) AS support FROM l GROUP BY 1")
def a29_classification_metrics(v: Views):
    return B.classification(predicted(v), "gold", "pred", [])


@query("WITH " + METRICS + " SELECT split, count(*) AS n, count(*) FILTER (gold = pred) / count(*)::DOUBLE AS accuracy FROM p GROUP BY GROUPING SETS ((split), ())")
def a30_metrics_by_group(v: Views):
    rows = predicted(v).groupingSets([[c("split")], []], c("split"))
    return rows.agg(F.count("*").alias("n"), (F.count_if(c("gold") == c("pred")) / F.count("*")).alias("accuracy")).select("split", "n", "accuracy")


@query("WITH " + METRICS + " SELECT pred AS accepted_by, count(*) AS n, count(*) FILTER (n_chars < 500) / count(*)::DOUBLE AS unknown_recall FROM p WHERE gold IN ('fr', 'es') GROUP BY 1")
def a31_out_of_scope(v: Views):
    return predicted(v).where(c("gold").isin("fr", "es")).groupBy(c("pred").alias("accepted_by")).agg(F.count("*").alias("n"), (F.count_if(c("n_chars") < 500) / F.count("*")).alias("unknown_recall"))


@query("WITH " + METRICS + " SELECT count(*) AS n, count(*) FILTER (quality IS NULL) AS failures, count(*) FILTER (gold = pred AND quality IS NOT NULL) / count(*)::DOUBLE AS accuracy_with_failures, count(*) FILTER (gold = pred AND quality IS NOT NULL) / count(*)::DOUBLE >= 0.3 AS passed FROM p")
def a32_pilot_metrics(v: Views):
    ok = F.count_if((c("gold") == c("pred")) & c("quality").isNotNull()) / F.count("*")
    return predicted(v).agg(F.count("*").alias("n"), F.count_if(c("quality").isNull()).alias("failures"), ok.alias("accuracy_with_failures"), (ok >= 0.3).alias("passed"))


@query("WITH " + METRICS + " SELECT gold, pred, count(*) AS n, min(dataset_id) AS hard_case FROM p WHERE gold <> pred GROUP BY 1, 2")
def a33_confusion_pairs(v: Views):
    return predicted(v).where("gold <> pred").groupBy("gold", "pred").agg(F.count("*").alias("n"), F.min("dataset_id").alias("hard_case"))


SCORED = "s AS (SELECT dataset_id, leaf, format, channel, CAST(likes > 750 AS INT) AS label, (views // 250000) / 16.0::DOUBLE AS score FROM content)"


def scored(v: Views):
    return v.content.select("dataset_id", "leaf", "format", "channel", (c("likes") > 750).cast("int").alias("label"), (F.floor(c("views") / 250000) / 16.0).alias("score"))


@query("WITH " + SCORED + ", d AS (SELECT score, sum(label) AS pos, count(*) - sum(label) AS neg FROM s GROUP BY 1), b AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM d) SELECT CAST(sum(pos * (2 * below + neg)) AS BIGINT) / (2.0::DOUBLE * sum(pos)::BIGINT * sum(neg)::BIGINT) AS auc, (SELECT sum(CAST((label - score) * (label - score) AS DECIMAL(18, 9)))::DOUBLE / count(*) FROM s) AS brier FROM b")
def a34_auc_brier(v: Views):
    rows = scored(v)
    brier = rows.agg((F.sum(((c("label") - c("score")) * (c("label") - c("score"))).cast("decimal(18,9)")).cast("double") / F.count("*")).alias("brier"))
    return B.area_under_roc(rows, []).join(F.broadcast(brier), F.lit(True))  # one row each


@query("WITH " + SCORED + ", u AS (SELECT unnest(['leaf', 'format', 'all']) AS scope, unnest([leaf, format, 'all']) AS value, label, score FROM s) SELECT scope, value, count(*) AS n, count(*) FILTER (score > 0.4 OR score < 0.3) / count(*)::DOUBLE AS coverage, count(*) FILTER ((score > 0.4) = (label = 1)) / count(*)::DOUBLE AS accuracy FROM u GROUP BY 1, 2")
def a36_evaluation_by_scope(v: Views):
    scopes = F.array(*[F.struct(F.lit(n).alias("scope"), e.alias("value")) for n, e in (("leaf", c("leaf")), ("format", c("format")), ("all", F.lit("all")))])
    rows = scored(v).select("label", "score", F.inline(scopes))
    return rows.groupBy("scope", "value").agg(F.count("*").alias("n"), (F.count_if((c("score") > 0.4) | (c("score") < 0.3)) / F.count("*")).alias("coverage"), (F.count_if((c("score") > 0.4) == (c("label") == 1)) / F.count("*")).alias("accuracy"))


@query("WITH " + METRICS + ", m AS (SELECT split, count(*) AS n, count(*) FILTER (gold = pred) / count(*)::DOUBLE AS accuracy FROM p GROUP BY 1) SELECT split, " + reasons_sql(("n < 60", "few_rows"), ("accuracy < 0.9", "accuracy")) + " AS blocked FROM m")
def a37_promotion_checks(v: Views):
    m = predicted(v).groupBy("split").agg(F.count("*").alias("n"), (F.count_if(c("gold") == c("pred")) / F.count("*")).alias("accuracy"))
    return m.select("split", all_reasons((c("n") < 60, "few_rows"), (c("accuracy") < 0.9, "accuracy")).alias("blocked"))


@query("WITH " + METRICS + ", m AS (SELECT split, count(*)::DOUBLE AS n, count(*) FILTER (gold = pred)::DOUBLE AS hits FROM p GROUP BY 1) SELECT split, unnest(['n', 'hits']) AS metric, unnest([n, hits]) AS value FROM m")
def a38_metric_rows(v: Views):
    m = predicted(v).groupBy("split").agg(F.count("*").cast("double").alias("n"), F.count_if(c("gold") == c("pred")).cast("double").alias("hits"))
    return m.unpivot("split", ["n", "hits"], "metric", "value")


@query("WITH s AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY segment_index) AS prev, count(*) OVER (PARTITION BY conv_id, segment_index) AS copies FROM segments) SELECT conv_id, segment_index, " + reasons_sql(("text IS NULL OR length(text) = 0", "empty"), ("prev = role", "same_role_twice"), ("segment_index = 0 AND role <> 'user'", "wrong_first_role"), ("copies > 1", "duplicate")) + " AS rejected FROM s")
def a40_response_validation(v: Views):
    prev = F.lag("role").over(Window.partitionBy("conv_id").orderBy("segment_index"))
    rows = v.segments.withColumn("prev", prev).withColumn("copies", F.count("*").over(Window.partitionBy("conv_id", "segment_index")))
    return rows.select("conv_id", "segment_index", all_reasons((c("text").isNull() | (F.length("text") == 0), "empty"), (c("prev") == c("role"), "same_role_twice"), ((c("segment_index") == 0) & (c("role") != "user"), "wrong_first_role"), (c("copies") > 1, "duplicate")).alias("rejected"))


@query("WITH o AS (SELECT conv_id, string_agg(role, '>' ORDER BY segment_index) AS roles FROM segments WHERE segment_index < 3 GROUP BY 1) SELECT roles, count(*) AS n FROM o GROUP BY 1")
def a41_allocation_balance(v: Views):
    order = v.segments.where("segment_index < 3").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("segment_index", "role"))).alias("s"))
    return order.groupBy(F.array_join(F.transform("s", lambda x: x["role"]), ">").alias("roles")).agg(F.count("*").alias("n"))


@query("WITH a AS (SELECT platform, run_at, count(*) AS n FROM items WHERE rank <= 5 GROUP BY 1, 2), b AS (SELECT platform, run_at, least(n_items, 6) AS m FROM runs) SELECT coalesce(a.platform, b.platform) AS platform, coalesce(a.run_at, b.run_at) AS run_at, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM a FULL JOIN b ON a.platform = b.platform AND a.run_at = b.run_at WHERE n IS DISTINCT FROM m")
def a43_count_integrity(v: Views):
    a = v.items.where("rank <= 5").groupBy("platform", "run_at").agg(F.count("*").alias("n"))
    b = v.runs.select("platform", "run_at", F.least("n_items", F.lit(6)).alias("m"))
    return a.join(b, ["platform", "run_at"], "full").where(~c("n").eqNullSafe(c("m"))).select("platform", "run_at", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("m", F.lit(0)).cast("long").alias("m"))


@query("SELECT leaf, format, count(DISTINCT dataset_id) FILTER (metric_version = 'v2') AS fit, count(DISTINCT channel) FILTER (metric_version = 'v2') AS channels, greatest(20 - count(DISTINCT dataset_id) FILTER (metric_version = 'v2'), 0) AS missing FROM content GROUP BY 1, 2")
def a44_format_coverage(v: Views):
    new = c("metric_version") == "v2"
    g = v.content.groupBy("leaf", "format").agg(F.count_distinct(F.when(new, c("dataset_id"))).alias("fit"), F.count_distinct(F.when(new, c("channel"))).alias("channels"))
    return g.withColumn("missing", F.greatest(20 - c("fit"), F.lit(0)))


@query("SELECT leaf, split, greatest(30 - count(*), 0) AS missing, greatest(4 - count(DISTINCT channel), 0) AS missing_channels FROM transcripts WHERE quality = 1 GROUP BY 1, 2")
def a45_collection_plan(v: Views):
    return v.transcripts.where("quality = 1").groupBy("leaf", "split").agg(F.greatest(30 - F.count("*"), F.lit(0)).alias("missing"), F.greatest(4 - F.count_distinct("channel"), F.lit(0)).alias("missing_channels"))


@query("SELECT channel, sha256(CAST(sum(h) AS BIGINT)::VARCHAR || ':' || count(*)::VARCHAR) AS fingerprint, count(*) AS n FROM (SELECT channel, ('0x' || substr(sha256(dataset_id::VARCHAR || '|' || title || '|' || views::VARCHAR), 1, 8))::BIGINT AS h FROM content) GROUP BY 1")
def a46_dataset_fingerprint(v: Views):
    """A digest that doesn't depend on the order of rows: their hashes are added up, so no task holds a channel's rows."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", c("dataset_id").cast("string"), "title", c("views").cast("string")), 256), 1, 8), 16, 10).cast("long")
    g = v.content.select("channel", h.alias("h")).groupBy("channel").agg(F.sum("h").alias("s"), F.count("*").alias("n"))
    return g.select("channel", F.sha2(F.concat_ws(":", c("s").cast("string"), c("n").cast("string")), 256).alias("fingerprint"), "n")


@query("WITH k AS (SELECT leaf, metric_version FROM (SELECT leaf, metric_version, count(*) AS n FROM content GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY leaf ORDER BY n DESC, metric_version DESC) = 1) SELECT dataset_id, leaf, metric_version FROM content SEMI JOIN k USING (leaf, metric_version)")
def a47_single_metric_cohort(v: Views):
    n = v.content.groupBy("leaf", "metric_version").agg(F.count("*").alias("n"))
    chosen = n.groupBy("leaf").agg(F.max_by("metric_version", F.struct("n", "metric_version")).alias("metric_version"))
    return v.content.join(chosen, ["leaf", "metric_version"], "left_semi").select("dataset_id", "leaf", "metric_version")


@query("WITH seeds(leaf, term, weight) AS (VALUES ('en', 'that', 0.75::DOUBLE), ('de', 'ist', 0.75::DOUBLE), ('xx', 'seed', 0.15::DOUBLE)) SELECT leaf, term, sum(w) AS weight FROM (SELECT leaf, term, tf::DOUBLE AS w FROM terms UNION ALL SELECT * FROM seeds) GROUP BY 1, 2")
def a48_class_profiles(v: Views):
    seeds = v.spark.createDataFrame([("en", "that", 0.75), ("de", "ist", 0.75), ("xx", "seed", 0.15)], "leaf string, term string, weight double")
    return v.terms.select("leaf", "term", c("tf").cast("double").alias("weight")).unionByName(seeds).groupBy("leaf", "term").agg(F.sum("weight").alias("weight"))


TOKENS_SQL = "list_filter(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: length(w) > 1 AND w NOT IN (" + STOP_SQL + ") AND NOT regexp_full_match(w, '[0-9]+'))"


@query(f"""WITH h AS (SELECT unnest({TOKENS_SQL.format("title || ' ' || leaf")}) AS topic FROM content WHERE captured >= (SELECT max(captured) FROM content) - INTERVAL 30 DAY),
l AS (SELECT platform, max(run_at) AS run_at FROM runs WHERE status = 'ok' GROUP BY 1), w AS (SELECT unnest({TOKENS_SQL.format("p_name || ' ' || p_type")}) AS topic, CAST(round(100 * CASE WHEN score > 0 THEN score ELSE 1 END) AS BIGINT) AS cents FROM items JOIN l USING (platform, run_at) JOIN part ON p_partkey = key),
hn AS (SELECT topic, count(*) AS n FROM h GROUP BY 1), ln AS (SELECT topic, CAST(sum(CASE WHEN cents > 1000000 THEN 1000000 ELSE cents END) AS BIGINT) / 100000.0::DOUBLE AS score FROM w GROUP BY 1)
SELECT topic, coalesce(n, 0) AS historical, coalesce(score, 0.0::DOUBLE) AS live_score FROM hn FULL JOIN ln USING (topic)""")
def a49_topic_scores(v: Views):
    """Mentions among the rows of the last 30 days, and min(score / 1000, 10) summed over the latest good run's items, by topic word.

    A score that is missing or not above 0 counts as 1. Scores have two decimals, so their sum is exact in whole hundredths.
    """
    text = lambda a, b: F.explode(tokens(F.concat_ws(" ", a, b))).alias("topic")
    last = v.content.agg(F.max("captured").alias("_last"))  # one row
    recent = v.content.join(F.broadcast(last), F.expr("captured >= _last - interval 30 days"))
    history = recent.select(text("title", "leaf")).groupBy("topic").agg(F.count("*").alias("n"))
    runs = v.runs.where("status = 'ok'").groupBy("platform").agg(F.max("run_at").alias("run_at"))
    cents = F.least(F.round(100 * F.when(c("score") > 0, c("score")).otherwise(1)).cast("long"), F.lit(1_000_000))
    live = v.items.join(F.broadcast(runs), ["platform", "run_at"]).join(v.table("part"), c("key") == c("p_partkey")).select(text("p_name", "p_type"), cents.alias("cents"))
    scores = live.groupBy("topic").agg((F.sum("cents") / F.lit(100_000.0)).alias("score"))
    return history.join(scores, "topic", "full").select("topic", F.coalesce("n", F.lit(0)).cast("long").alias("historical"), F.coalesce("score", F.lit(0.0)).alias("live_score"))


@query("SELECT event_type AS platform, count(*) AS n, count(DISTINCT user_id) AS users, array_to_string(list_sort(list(DISTINCT user_id % 7)), ',') AS groups FROM events GROUP BY 1")
def a50_platform_summaries(v: Views):
    return v.table("events").groupBy(c("event_type").alias("platform")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.array_join(F.array_sort(F.collect_set(c("user_id") % 7)), ",").alias("groups"))


@query("SELECT channel, count(*) AS n FROM (SELECT * FROM content ORDER BY captured DESC, dataset_id DESC LIMIT 50) GROUP BY 1")
def a51_recent_sources(v: Views):
    return v.content.orderBy(F.desc("captured"), F.desc("dataset_id")).limit(50).groupBy("channel").agg(F.count("*").alias("n"))


@query("SELECT term, CAST(sum(tf) AS BIGINT) AS n FROM terms WHERE dataset_id IN (SELECT dataset_id FROM transcripts ORDER BY n_chars DESC, dataset_id LIMIT 100) AND term NOT IN (SELECT split_part(p_name, ' ', 1) FROM part) GROUP BY 1 ORDER BY n DESC, term LIMIT 30")
def a53_keyword_counts(v: Views):
    top = v.transcripts.orderBy(F.desc("n_chars"), "dataset_id").limit(100).select("dataset_id")
    known = v.table("part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("term")).distinct()
    return v.terms.join(F.broadcast(top), "dataset_id", "left_semi").join(known, "term", "left_anti").groupBy("term").agg(F.sum("tf").alias("n")).orderBy(F.desc("n"), "term").limit(30)


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY views DESC, dataset_id) AS k, count(*) OVER (PARTITION BY leaf) AS n FROM content WHERE metric_version = 'v2'),
t AS (SELECT * FROM r WHERE k <= ceil(0.4::DOUBLE * n)) SELECT leaf, count(*) AS n, quantile_cont(duration, 0.5) AS median_duration, count(DISTINCT channel) AS channels, mode(format ORDER BY format) AS format_any FROM t GROUP BY 1""")
def a55_domain_profile(v: Views):
    ranked = rank_within(v.content.where("metric_version = 'v2'"), ["leaf"], "views", "dataset_id")
    rows = ranked.where(c("rank") <= F.ceil(0.4 * c("n")))
    return rows.groupBy("leaf").agg(F.count("*").alias("n"), F.percentile("duration", 0.5).alias("median_duration"), F.count_distinct("channel").alias("channels"), F.mode("format", True).alias("format_any"))


@query("SELECT split_part(title, ' ', 2) AS topic, count(*) AS clips, count(DISTINCT channel) AS channels FROM content WHERE views > 2000000 GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT channel) >= 2 ORDER BY 2 DESC, 1 LIMIT 6")
def a56_topic_advice(v: Views):
    g = v.content.where("views > 2000000").groupBy(F.split_part("title", F.lit(" "), F.lit(2)).alias("topic")).agg(F.count("*").alias("clips"), F.count_distinct("channel").alias("channels"))
    return g.where("clips >= 2 and channels >= 2").orderBy(F.desc("clips"), "topic").limit(6)


CATALOG = ("small", "large", "hot", "red", "blue")  #: topics that comparisons look for in titles
PAIRED = f"""t(topic) AS (VALUES {", ".join(f"('{x}')" for x in CATALOG)}), arm AS (SELECT leaf, topic, channel, format, metric_version, views, list_contains(string_split(title, ' '), topic) AS hit FROM content CROSS JOIN t),
cell AS (SELECT leaf, topic, channel, format, metric_version, median(views) FILTER (hit) - median(views) FILTER (NOT hit) AS d, count(*) FILTER (hit) AS nd, count(*) FILTER (NOT hit) AS na FROM arm GROUP BY ALL),
chn AS (SELECT leaf, topic, channel, median(d) AS d, count(d) AS cells, sum(nd) FILTER (d IS NOT NULL) AS pd, sum(na) FILTER (d IS NOT NULL) AS pa, sum(nd) AS nd, sum(na) AS na FROM cell GROUP BY ALL),
tp AS (SELECT leaf, topic, CAST(sum(nd) AS BIGINT) AS detected, CAST(sum(na) AS BIGINT) AS not_detected, count(*) FILTER (nd > 0) AS channels, CAST(sum(cells) AS BIGINT) AS matched_strata, count(d) AS paired_channels, median(d) AS difference,
coalesce(sum(pd), 0) AS pd, coalesce(sum(pa), 0) AS pa, abs(sum(sign(d))) AS lead FROM chn GROUP BY ALL),
cmp AS (SELECT leaf, topic, detected, not_detected, channels, matched_strata, paired_channels, difference, CASE WHEN difference IS NULL THEN 'unknown' WHEN difference = 0 THEN 'equal' WHEN difference < 0 THEN 'lower' ELSE 'higher' END AS direction,
CASE WHEN matched_strata = 0 THEN 'not_comparable' WHEN pd < 10 OR pa < 10 OR paired_channels < 5 THEN 'reference_only' WHEN paired_channels < 10 THEN 'comparison_descriptive'
WHEN lead * lead > 1.96::DOUBLE * 1.96::DOUBLE * paired_channels THEN 'comparison_supported' ELSE 'comparison_uncertain' END AS status FROM tp)"""


def compared(v: Views):
    return R.paired_topics(v.content.withColumn("words", F.split("title", " ")), list(CATALOG), "words", ["format", "metric_version"])


@query("WITH " + PAIRED + " SELECT * FROM cmp")
def a57_topic_readiness(v: Views):
    return compared(v)


@query("SELECT u.user_id, count(analysis_id) AS analyses, count(analysis_id) FILTER (status = 'F') AS finished, max(created_at) AS last_at FROM customers u LEFT JOIN analyses a ON a.user_id = u.user_id GROUP BY 1")
def a58_user_activity(v: Views):
    g = v.analyses.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(c("status") == "F").alias("f"), F.max("created_at").alias("last_at"))
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    return v.customers.join(g, "user_id", "left").select("user_id", zero(c("n")).alias("analyses"), zero(c("f")).alias("finished"), "last_at")


@query("SELECT label, n, vec_id FROM (SELECT label, vec_id, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS k FROM vectors) WHERE k <= 20")
def a59_cluster_detail(v: Views):
    w = Window.partitionBy("label")
    return v.vectors.select("label", "vec_id", F.count("*").over(w).alias("n"), F.row_number().over(w.orderBy(F.desc("vec_id"))).alias("k")).where("k <= 20").select("label", "n", "vec_id")


@query("SELECT t.dataset_id, t.n_chars, coalesce(n_terms, 0) AS n_terms, top_term FROM transcripts t LEFT JOIN (SELECT dataset_id, count(*) AS n_terms, arg_max(term, (tf, term)) AS top_term FROM terms GROUP BY 1) s USING (dataset_id)")
def a60_text_summary(v: Views):
    s = v.terms.groupBy("dataset_id").agg(F.count("*").alias("n_terms"), F.max_by("term", F.struct("tf", "term")).alias("top_term"))
    return v.transcripts.select("dataset_id", "n_chars").join(s, "dataset_id", "left").select("dataset_id", "n_chars", F.coalesce("n_terms", F.lit(0)).cast("long").alias("n_terms"), "top_term")


@query("SELECT channel, count(*) FILTER (leaf = 'en') AS en, count(*) FILTER (leaf = 'de') AS de, count(*) FILTER (leaf = 'fr') AS fr, count(*) FILTER (leaf = 'es') AS es FROM transcripts WHERE split = 'train' GROUP BY 1")
def a61_language_counts(v: Views):
    counts = v.transcripts.where("split = 'train'").groupBy("channel").pivot("leaf", ["en", "de", "fr", "es"]).agg(F.count(F.lit(1)))
    return counts.select("channel", *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("en", "de", "fr", "es")])


#: a stored split that follows the channel but for every eleventh row, so that there are disagreements to find
STORED = "CASE WHEN dataset_id % 11 = 5 THEN 'train' ELSE split END"


@query(f"""WITH r AS (SELECT *, {STORED} AS stored, sha256(text) AS digest FROM transcripts), h AS (SELECT DISTINCT digest FROM r WHERE stored <> 'train'), k AS (SELECT digest FROM r GROUP BY 1 HAVING count(DISTINCT leaf) > 1),
n AS (SELECT leaf, count(DISTINCT digest) AS n FROM r WHERE stored = 'train' AND quality IS NOT NULL GROUP BY 1)
SELECT dataset_id, leaf, """ + reasons_sql((f"{bucket_sql('dataset_id::VARCHAR', 4)} = 0", "reserved"), ("stored <> split", "split_mismatch"), ("digest IN (SELECT digest FROM h)", "holdout_text"), ("digest IN (SELECT digest FROM k)", "leaf_conflict"),
    ("coalesce(n, 0) < 50", "few_rows"), ("quality IS NULL", "unreviewed"), ("trim(coalesce(text, '')) = ''", "empty")) + " AS issues FROM r LEFT JOIN n USING (leaf) WHERE stored = 'train'")
def a62_training_preparation(v: Views):
    return R.training_issues(v.transcripts.withColumn("stored_split", F.expr(STORED)), 50)


@query("SELECT leaf, format, greatest(count(*) FILTER (metric_version = 'v1'), 5) AS v1_minimum, greatest(count(*) FILTER (metric_version = 'v2'), 5) AS v2_minimum FROM content GROUP BY 1, 2")
def a64_partition_minima(v: Views):
    least = lambda m: F.greatest(F.count_if(c("metric_version") == m), F.lit(5))
    return v.content.groupBy("leaf", "format").agg(least("v1").alias("v1_minimum"), least("v2").alias("v2_minimum"))
