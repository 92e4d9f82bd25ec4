"""Further joins (family J), top-k and sampling (K) and set operations (U)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from trendloom.functions.splits import bucket
from trendloom.operators import benchmark as B
from trendloom.operators import sketches
from trendloom.operators.ranking import rank_within
from trendloom.operators.readiness import explained
from trendloom.operators.sampling import balanced_sample, holdout_plan
from trendloom.operators.trend import first_per
from trendloom.plans.aggregates import MEDIAN, PAIRED, compared, scored, SCORED
from trendloom.plans.registry import bucket_sql, query
from trendloom.sources.views import Views

c = F.col


@query("SELECT r.platform, r.run_at, r.status, count(i.key) AS n_top, count(i.key) = 0 AS blocked FROM runs r LEFT JOIN items i ON i.platform = r.platform AND i.run_at = r.run_at AND i.rank <= 3 AND r.status = 'ok' GROUP BY 1, 2, 3")
def j06_topic_jobs(v: Views):
    top = v.items.where("rank <= 3").groupBy("platform", "run_at").agg(F.count("*").alias("n"))
    rows = v.runs.join(top, ["platform", "run_at"], "left")
    n = F.when(c("status") == "ok", F.coalesce("n", F.lit(0))).otherwise(0).cast("long")
    return rows.select("platform", "run_at", "status", n.alias("n_top"), (n == 0).alias("blocked"))


@query("WITH g AS (SELECT dataset_id, topic_id FROM content CROSS JOIN topics) SELECT g.dataset_id, g.topic_id, CASE WHEN list_contains(string_split(title, ' '), g.topic_id) THEN 'detected' WHEN length(title) < 8 THEN 'unassessable' ELSE 'not_detected' END AS state FROM g JOIN content USING (dataset_id)")
def j08_topic_matching(v: Views):
    hits = v.content.select("dataset_id", F.explode(F.array_distinct(F.split("title", " "))).alias("topic_id")).withColumn("hit", F.lit(True))
    listed = v.topics.agg(F.collect_set("topic_id").alias("all"))  # the catalog, one row
    grid = v.content.select("dataset_id", "title").join(F.broadcast(listed), F.lit(True)).select("dataset_id", "title", F.explode("all").alias("topic_id"))
    state = F.when(c("hit"), "detected").when(F.length("title") < 8, "unassessable").otherwise("not_detected")
    return grid.join(hits, ["dataset_id", "topic_id"], "left").select("dataset_id", "topic_id", state.alias("state"))


@query("""WITH f AS (SELECT user_id, role AS kind, CASE WHEN user_id % 3 = 0 THEN 'error' END AS platform, region FROM customers)
SELECT DISTINCT f.user_id, i.platform, i.key FROM f JOIN items i ON (f.region = i.key OR (f.platform = i.platform AND i.rank = 1)) WHERE i.rank <= 3""")
def j09_follow_interests(v: Views):
    """Users and keys are made distinct before they meet, so that no task holds the pairs to tell them apart."""
    users = v.customers.where("user_id is not null").groupBy("user_id").agg(F.collect_set("region").alias("regions"))
    top = v.items.where("rank <= 3").groupBy("platform", "key").agg(F.min("rank").alias("rank"))
    by_region = users.select("user_id", F.explode("regions").alias("key")).join(top, "key").select("user_id", "platform", "key")
    firsts = top.where("rank = 1").groupBy("platform").agg(F.collect_list("key").alias("keys"))  # one key for each run
    by_platform = users.where("user_id % 3 = 0").withColumn("platform", F.lit("error")).join(firsts, "platform").select("user_id", "platform", "regions", F.explode("keys").alias("key"))
    return by_region.union(by_platform.where(~F.array_contains("regions", c("key"))).select("user_id", "platform", "key"))  # those are in the other part


@query("WITH k AS (SELECT unnest(range(0, 12)) AS label) SELECT k.label, count(vec_id) AS n FROM k LEFT JOIN vectors USING (label) GROUP BY 1")
def j11_cluster_sizes(v: Views):
    n = v.vectors.groupBy("label").agg(F.count("*").alias("n"))
    return v.spark.range(12).select(c("id").alias("label")).join(n, "label", "left").select("label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query(r"""WITH h AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages), u AS (SELECT host, min(page_id) AS one, count(DISTINCT page_id) AS n FROM h GROUP BY 1)
SELECT page_id, CASE WHEN n = 1 THEN one END AS resolved, CASE WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS state FROM h JOIN u USING (host)""")
def j13_identity_lookup(v: Views):
    h = v.table("pages").select("page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"))
    u = h.groupBy("host").agg(F.min("page_id").alias("one"), F.count_distinct("page_id").alias("n"))
    single = c("n") == 1
    return h.join(u, "host").select("page_id", F.when(single, c("one")).alias("resolved"), F.when(single, "resolved").otherwise("ambiguous").alias("state"))


@query("WITH a AS (SELECT leaf, count(*) AS n FROM content WHERE channel < 'Brand#2' GROUP BY 1), b AS (SELECT leaf, count(*) AS m FROM content WHERE channel >= 'Brand#2' AND leaf <> 'PROMO' GROUP BY 1) SELECT coalesce(a.leaf, b.leaf) AS leaf, coalesce(n, 0) AS n_left, coalesce(m, 0) AS n_right FROM a FULL JOIN b ON a.leaf = b.leaf")
def j14_profile_comparison(v: Views):
    left = v.content.where("channel < 'Brand#2'").groupBy("leaf").agg(F.count("*").alias("n"))
    right = v.content.where("channel >= 'Brand#2' and leaf <> 'PROMO'").groupBy("leaf").agg(F.count("*").alias("m"))
    return left.join(right, "leaf", "full").select("leaf", F.coalesce("n", F.lit(0)).cast("long").alias("n_left"), F.coalesce("m", F.lit(0)).cast("long").alias("n_right"))


@query("SELECT c.dataset_id, count(i.key) AS n_trends, string_agg(i.platform || ':' || i.rank::VARCHAR, ',' ORDER BY i.platform, i.run_at) AS evidence FROM content c LEFT JOIN items i ON i.key = c.dataset_id AND i.rank <= 2 GROUP BY 1")
def j15_corpus_with_trends(v: Views):
    near = v.items.where("rank <= 2").select(c("key").alias("dataset_id"), "platform", "run_at", "rank")
    g = v.content.select("dataset_id").join(near, "dataset_id", "left").groupBy("dataset_id").agg(F.count("platform").alias("n_trends"), F.array_sort(F.collect_list(F.struct("platform", "run_at", "rank"))).alias("s"))
    text = F.array_join(F.transform(F.filter("s", lambda x: x["platform"].isNotNull()), lambda x: F.concat_ws(":", x["platform"], x["rank"].cast("string"))), ",")
    return g.select("dataset_id", "n_trends", F.nullif(text, F.lit("")).alias("evidence"))


@query("WITH s AS (SELECT leaf, term, count(*) AS support FROM terms GROUP BY 1, 2 HAVING count(*) >= 2), u AS (SELECT DISTINCT leaf, term FROM terms WHERE channel = 'src1') SELECT leaf, term, support FROM s ANTI JOIN u USING (leaf, term) QUALIFY row_number() OVER (PARTITION BY leaf ORDER BY support DESC, term) <= 6")
def j16_keyword_gap(v: Views):
    s = v.terms.groupBy("leaf", "term").agg(F.count("*").alias("support")).where("support >= 2")
    own = v.terms.where("channel = 'src1'").select("leaf", "term").distinct()
    gap = s.join(own, ["leaf", "term"], "left_anti")
    return gap.withColumn("k", F.row_number().over(Window.partitionBy("leaf").orderBy(F.desc("support"), "term"))).where("k <= 6").drop("k")


@query("WITH a AS (SELECT leaf, term, count(*) AS n FROM terms WHERE dataset_id % 2 = 0 GROUP BY 1, 2), b AS (SELECT leaf, term, count(*) AS n FROM terms WHERE dataset_id % 2 = 1 GROUP BY 1, 2) SELECT coalesce(a.leaf, b.leaf) AS leaf, coalesce(a.term, b.term) AS term, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' WHEN a.n = b.n THEN 'kept' ELSE 'changed' END AS message FROM a FULL JOIN b ON a.leaf = b.leaf AND a.term = b.term")
def j17_revision_pairs(v: Views):
    side = lambda i, name: v.terms.where(c("dataset_id") % 2 == i).groupBy("leaf", "term").agg(F.count("*").alias(name))
    both = side(0, "a").join(side(1, "b"), ["leaf", "term"], "full")
    return both.select("leaf", "term", F.when(c("a").isNull(), "added").when(c("b").isNull(), "removed").when(c("a") == c("b"), "kept").otherwise("changed").alias("message"))


@query("WITH l AS (SELECT * FROM analyses QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, analysis_id DESC) = 1) SELECT u.user_id, u.role, coalesce(l.status, 'pending') AS state, l.analysis_id FROM customers u LEFT JOIN l USING (user_id)")
def j20_review_queue(v: Views):
    last = v.analyses.groupBy("user_id").agg(F.max_by(F.struct("analysis_id", "status"), F.struct("created_at", "analysis_id")).alias("l"))
    return v.customers.join(last, "user_id", "left").select("user_id", "role", F.coalesce("l.status", F.lit("pending")).alias("state"), "l.analysis_id")


@query("WITH e AS (SELECT leaf, term, count(*) AS support, array_to_string(list_slice(list_sort(list(DISTINCT channel)), 1, 3), ',') AS channels FROM terms GROUP BY 1, 2 HAVING count(*) >= 2), u AS (SELECT DISTINCT term FROM terms WHERE channel = 'src1') SELECT leaf, term, support, channels, u.term IS NULL AS gap FROM e LEFT JOIN u USING (term)")
def j23_evidence_assembly(v: Views):
    e = v.terms.groupBy("leaf", "term").agg(F.count("*").alias("support"), F.array_join(F.slice(F.array_sort(F.collect_set("channel")), 1, 3), ",").alias("channels")).where("support >= 2")
    own = v.terms.where("channel = 'src1'").select("term").distinct().withColumn("own", F.lit(True))
    return e.join(own, "term", "left").select("leaf", "term", "support", "channels", c("own").isNull().alias("gap"))


@query("WITH " + PAIRED + """, a AS (SELECT dataset_id, leaf, unnest(string_split(title, ' ')) AS topic FROM content)
SELECT a.*, CASE WHEN status = 'comparison_supported' THEN status WHEN status IN ('comparison_descriptive', 'comparison_uncertain') THEN 'comparison_uncertain' ELSE 'reference_examples' END AS level,
CASE WHEN status LIKE 'comparison%' THEN direction END AS direction, detected AS clips, channels, paired_channels, difference FROM a LEFT JOIN cmp ON cmp.leaf = a.leaf AND cmp.topic = a.topic""")
def j24_comparison_state(v: Views):
    """The evidence behind every topic that a row suggests; comparisons are one row for each category and topic of the catalog."""
    actions = v.content.select("dataset_id", "leaf", F.explode(F.split("title", " ")).alias("topic"))
    return explained(actions, compared(v), ["leaf", "topic"])


@query("WITH " + SCORED + " SELECT a.dataset_id, CASE WHEN a.leaf = b.leaf AND a.format = b.format THEN b.score - a.score END AS difference, a.leaf = b.leaf AND a.format = b.format AS comparable FROM s a JOIN s b ON b.dataset_id = a.dataset_id + 1")
def j25_probability_difference(v: Views):
    before = scored(v).select("dataset_id", "leaf", "format", "score")
    after = scored(v).select((c("dataset_id") - 1).alias("dataset_id"), c("leaf").alias("leaf2"), c("format").alias("format2"), c("score").alias("score2"))
    same = (c("leaf") == c("leaf2")) & (c("format") == c("format2"))
    return before.join(after, "dataset_id").select("dataset_id", F.when(same, c("score2") - c("score")).alias("difference"), same.alias("comparable"))


@query("WITH m AS (SELECT entity, max(us) AS top FROM observations GROUP BY 1) SELECT entity, count(*) AS n, min(obs_id) AS first_id FROM observations JOIN m USING (entity) WHERE us >= top - 60 * 3600000000 GROUP BY 1")
def j26_look_back(v: Views):
    top = v.observations.groupBy("entity").agg(F.max("us").alias("top"))
    return v.observations.join(top, "entity").where(c("us") >= c("top") - 60 * 3_600_000_000).groupBy("entity").agg(F.count("*").alias("n"), F.min("obs_id").alias("first_id"))


@query("WITH a AS (SELECT conv_id, segment_index AS i, role FROM segments WHERE conv_id % 2 = 0), b AS (SELECT conv_id - 1 AS conv_id, segment_index AS i, role FROM segments WHERE conv_id % 2 = 1) SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.i, b.i) AS place FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.i = b.i WHERE a.role IS DISTINCT FROM b.role")
def j27_variant_parity(v: Views):
    a = v.segments.where("conv_id % 2 = 0").select("conv_id", c("segment_index").alias("place"), c("role").alias("r1"))
    b = v.segments.where("conv_id % 2 = 1").select((c("conv_id") - 1).alias("conv_id"), c("segment_index").alias("place"), c("role").alias("r2"))
    return a.join(b, ["conv_id", "place"], "full").where(~c("r1").eqNullSafe(c("r2"))).select("conv_id", "place")


@query("""WITH h AS (SELECT w, count(*) AS n FROM (SELECT unnest(string_split(title, ' ')) AS w FROM content WHERE metric_version = 'v1') GROUP BY 1),
t AS (SELECT dataset_id, likes, views, unnest(list_distinct(string_split(title, ' '))) AS w FROM content WHERE metric_version = 'v2')
SELECT dataset_id, round(any_value(likes) / 100.0::DOUBLE + 120.0::DOUBLE * sum(1.0::DOUBLE / (1 + coalesce(n, 0))) + least(any_value(views) / 20000.0::DOUBLE, 10.0::DOUBLE), 6) AS score FROM t LEFT JOIN h USING (w) GROUP BY 1 ORDER BY score DESC, dataset_id LIMIT 100""")
def k01_priority_items(v: Views):
    """Top items of the current version: score, 120 for every unit of novelty against the words of older titles, and up to 10 for views."""
    words = lambda version: v.content.where(c("metric_version") == version)
    history = words("v1").select(F.explode(F.split("title", " ")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    rows = words("v2").select("dataset_id", "likes", "views", F.explode(F.array_distinct(F.split("title", " "))).alias("w")).join(history, "w", "left")
    novelty = F.sum(F.lit(1.0) / (1 + F.coalesce("n", F.lit(0))))
    scored = rows.groupBy("dataset_id").agg((F.first("likes") / 100.0 + F.lit(120.0) * novelty + F.least(F.first("views") / 20000.0, F.lit(10.0))).alias("score"))
    return scored.select("dataset_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "dataset_id").limit(100)


@query("WITH l AS (SELECT topic, CAST(sum(views) AS BIGINT) // 1000 AS s FROM (SELECT unnest(string_split(title, ' ')) AS topic, views FROM content WHERE metric_version = 'v2') GROUP BY 1), h AS (SELECT topic, count(*) AS h FROM (SELECT unnest(string_split(title, ' ')) AS topic FROM content WHERE metric_version = 'v1') GROUP BY 1) SELECT topic, s + 0.05::DOUBLE * coalesce(h, 0) AS priority, s * 2.0::DOUBLE / (1 + coalesce(h, 0)) AS emerging FROM l LEFT JOIN h USING (topic)")
def k02_priority_topics(v: Views):
    t = v.content.select(F.explode(F.split("title", " ")).alias("topic"), "views", "metric_version")
    live = t.where("metric_version = 'v2'").groupBy("topic").agg(F.floor(F.sum("views") / 1000).alias("s"))
    past = t.where("metric_version = 'v1'").groupBy("topic").agg(F.count("*").alias("h"))
    h = F.coalesce("h", F.lit(0))
    return live.join(past, "topic", "left").select("topic", (c("s") + F.lit(0.05) * h).alias("priority"), (c("s") * F.lit(2.0) / (1 + h)).alias("emerging"))


@query("SELECT leaf, dataset_id, k FROM (SELECT leaf, dataset_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY leaf) AS n FROM content WINDOW w AS (PARTITION BY leaf ORDER BY views DESC, dataset_id)) WHERE k <= least(200, greatest(10, CAST(ceil(0.4::DOUBLE * n) AS BIGINT)))")
def k03_high_performing(v: Views):
    rows = rank_within(v.content.select("leaf", "dataset_id", "views"), ["leaf"], "views", "dataset_id")
    kept = c("rank") <= F.least(F.lit(200), F.greatest(F.lit(10), F.ceil(0.4 * c("n"))))
    return rows.where(kept).select("leaf", "dataset_id", c("rank").alias("k"))


@query("SELECT term, count(*) AS n FROM terms WHERE leaf = 'en' AND term NOT IN (SELECT term FROM terms WHERE leaf = 'de') GROUP BY 1 ORDER BY n DESC, term LIMIT 20")
def k04_quick_gap_terms(v: Views):
    other = v.terms.where("leaf = 'de'").select("term").distinct()
    return v.terms.where("leaf = 'en'").join(other, "term", "left_anti").groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(20)


@query("SELECT leaf, format, CAST(sum(views) AS BIGINT) / count(*)::DOUBLE AS mean_top FROM (SELECT *, row_number() OVER (PARTITION BY leaf, format ORDER BY views DESC, dataset_id) AS k FROM content) WHERE k <= 5 GROUP BY 1, 2")
def k05_mean_of_top(v: Views):
    k = F.row_number().over(Window.partitionBy("leaf", "format").orderBy(F.desc("views"), "dataset_id"))
    return v.content.withColumn("k", k).where("k <= 5").groupBy("leaf", "format").agg((F.sum("views") / F.count("*")).alias("mean_top"))


@query("SELECT dataset_id, leaf FROM transcripts QUALIFY row_number() OVER (PARTITION BY leaf ORDER BY n_chars DESC, dataset_id) <= 25")
def k06_per_leaf_cap(v: Views):
    return v.transcripts.withColumn("k", F.row_number().over(Window.partitionBy("leaf").orderBy(F.desc("n_chars"), "dataset_id"))).where("k <= 25").select("dataset_id", "leaf")


@query("""WITH h AS (SELECT dataset_id, leaf, channel, sha256('sample-1|' || dataset_id) AS h FROM content), a AS (SELECT *, row_number() OVER (PARTITION BY leaf, channel ORDER BY h, dataset_id) AS t FROM h), b AS (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY t, h, dataset_id) AS p FROM a),
s AS (SELECT * FROM b ORDER BY p, leaf, h, dataset_id LIMIT 200), n AS (SELECT leaf, count(*) AS n FROM s GROUP BY 1), g AS (SELECT leaf, n, sum(n) OVER () AS every, CASE WHEN sum(n) OVER () < 200 THEN sum(n) OVER () * 90 // 200 ELSE least(90, sum(n) OVER () - 1) END AS target FROM n),
f AS (SELECT *, n * target // every AS floor_, row_number() OVER (ORDER BY n * target % every DESC, leaf) AS place, target - sum(n * target // every) OVER () AS left_ FROM g), q AS (SELECT leaf, floor_ + CASE WHEN place <= left_ THEN 1 ELSE 0 END AS quota FROM f)
SELECT dataset_id, leaf, channel, CASE WHEN row_number() OVER (PARTITION BY leaf ORDER BY sha256('split|sample-1|' || dataset_id), dataset_id) <= quota THEN 'test' ELSE 'development' END AS split FROM s JOIN q USING (leaf)""")
def k07_balanced_sample(v: Views):
    """200 rows, categories and their channels in turn, 90 of them for test by largest remainder."""
    return balanced_sample(v.content.select("dataset_id", "leaf", "channel"), 200, 90, "sample-1", "dataset_id", "leaf", "channel")


@query(f"""WITH r AS (SELECT dataset_id AS id, channel || '-' || n_chars % 50 AS channel, leaf <> 'es' AS known, CASE WHEN dataset_id % 97 = 0 THEN 'test' ELSE CAST({bucket_sql("(channel || '-' || n_chars % 50)", 100)} // 70 AS VARCHAR) END AS s FROM transcripts), rows_ AS (SELECT id, channel, known, CASE s WHEN '0' THEN 'train' WHEN '1' THEN 'validation' ELSE s END AS split FROM r),
g AS (SELECT channel, count(*) FILTER (NOT known) AS unknown, count(*) FILTER (known AND split = 'train') AS known_train, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM rows_ GROUP BY 1 HAVING count(*) FILTER (NOT known) > 0),
nd AS (SELECT greatest(20 - count(*) FILTER (split = 'validation'), 0) AS nv, greatest(30 - count(*) FILTER (split = 'test'), 0) AS nt FROM rows_ WHERE NOT known),
f AS (SELECT channel, unknown, sum(unknown) OVER w - unknown AS before, row_number() OVER w AS place FROM g WHERE splits = 'train' WINDOW w AS (ORDER BY sha256('scope-holdout-v1:' || channel), channel) QUALIFY place <= 50),
p AS (SELECT f.*, nv, nt, min(before) FILTER (before >= nv) OVER () AS from_ FROM f, nd), m AS (SELECT channel, place, CASE WHEN before < nv THEN 'validation' WHEN before - from_ < nt THEN 'test' END AS new_split FROM p)
SELECT 'channel' AS kind, g.channel, CAST(NULL AS BIGINT) AS id, splits AS split, new_split, unknown, known_train, contains(splits, ',') AS conflict, place FROM g LEFT JOIN m USING (channel)
UNION ALL SELECT 'change', channel, id, split, new_split, NULL, NULL, NULL, NULL FROM rows_ JOIN m USING (channel) WHERE new_split IS NOT NULL""")
def k08_scope_holdout(v: Views):
    """Channels with unknown rows and where they would move, and every row that moves with them."""
    channel = F.concat(c("channel"), F.lit("-"), c("n_chars") % 50)
    split = F.when(c("dataset_id") % 97 == 0, "test").when(bucket(channel, 100) < 70, "train").otherwise("validation")
    channels, changes = holdout_plan(v.transcripts.select(c("dataset_id").alias("id"), channel.alias("channel"), (c("leaf") != "es").alias("known"), split.alias("split")), 20, 30)
    none = lambda t: F.lit(None).cast(t)
    listed = channels.select(F.lit("channel").alias("kind"), "channel", none("long").alias("id"), c("splits").alias("split"), "new_split", "unknown", "known_train", "conflict", "place")
    moved = changes.select(F.lit("change").alias("kind"), "channel", "id", "split", "new_split", none("long").alias("unknown"), none("long").alias("known_train"), none("boolean").alias("conflict"), none("long").alias("place"))
    return listed.unionByName(moved)


@query("WITH k AS (SELECT dataset_id, term, tf, row_number() OVER (PARTITION BY dataset_id ORDER BY tf DESC, length(term) DESC, term) AS place FROM terms) SELECT a.dataset_id, a.term, a.tf FROM k a WHERE place <= 10 AND NOT EXISTS (SELECT 1 FROM k b WHERE b.dataset_id = a.dataset_id AND b.place < a.place AND b.place <= 10 AND contains(b.term, a.term) AND a.tf <= 2)")
def k09_keyword_ranking(v: Views):
    place = F.row_number().over(Window.partitionBy("dataset_id").orderBy(F.desc("tf"), F.desc(F.length("term")), "term"))
    top = v.terms.withColumn("place", place).where("place <= 10").groupBy("dataset_id").agg(F.array_sort(F.collect_list(F.struct("place", "term", "tf"))).alias("s"))  # ten terms
    one = top.select("dataset_id", "s", F.explode("s").alias("a"))
    covered = F.exists("s", lambda b: (b["place"] < c("a.place")) & b["term"].contains(c("a.term"))) & (c("a.tf") <= 2)
    return one.where(~covered).select("dataset_id", "a.term", "a.tf")


@query("SELECT * FROM (SELECT 'video' AS feed, key, score FROM items WHERE platform = 'view' UNION ALL SELECT 'sale', key, score FROM items WHERE platform = 'purchase') QUALIFY row_number() OVER (PARTITION BY feed ORDER BY score DESC, key) <= 50")
def u01_union_feeds(v: Views):
    feed = lambda name, p: v.items.where(c("platform") == p).select(F.lit(name).alias("feed"), "key", "score")
    rows = feed("video", "view").unionByName(feed("sale", "purchase"))
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("feed").orderBy(F.desc("score"), "key"))).where("k <= 50").drop("k")


@query("WITH a AS (SELECT platform, run_at, key, rank, 0 AS pri FROM items WHERE rank <= 5 UNION ALL SELECT platform, run_at, key, rank + 100, 1 FROM items WHERE rank <= 10) SELECT platform, run_at, key, rank FROM a QUALIFY row_number() OVER (PARTITION BY platform, run_at, key ORDER BY pri, rank) = 1")
def u02_raw_and_archive(v: Views):
    archive = v.items.where("rank <= 5").select("platform", "run_at", "key", "rank", F.lit(0).alias("pri"))
    raw = v.items.where("rank <= 10").select("platform", "run_at", "key", (c("rank") + 100).alias("rank"), F.lit(1).alias("pri"))
    return first_per(archive.unionByName(raw), ["platform", "run_at", "key"], ["pri", "rank"]).drop("pri")


@query("WITH h AS (SELECT event_type, date_trunc('hour', ts) AS b, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY 1, 2) SELECT DISTINCT event_type AS platform, t AS sample_at FROM (SELECT event_type, lo AS t FROM h UNION ALL SELECT event_type, hi FROM h)")
def u03_first_and_last(v: Views):
    h = v.table("events").groupBy(c("event_type").alias("platform"), F.date_trunc("hour", "ts").alias("b")).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return h.select("platform", F.explode(F.array("lo", "hi")).alias("sample_at")).distinct()


@query("WITH a AS (SELECT DISTINCT term FROM terms WHERE leaf = 'en'), b AS (SELECT DISTINCT term FROM terms WHERE leaf = 'fr') SELECT term, 'shared' AS kind FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT term, 'missing' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def u04_shared_and_missing(v: Views):
    a, b = (v.terms.where(c("leaf") == x).select("term").distinct() for x in ("en", "fr"))
    return a.intersect(b).withColumn("kind", F.lit("shared")).unionByName(a.subtract(b).withColumn("kind", F.lit("missing")))


@query()
def a15_bca_interval(v: Views):
    values = v.content.groupBy("leaf", "channel").agg(F.percentile("views", 0.5).alias("value")).withColumn("id", c("channel"))
    return sketches.bca_interval(values, "leaf").withColumnRenamed("grp", "leaf")


@query()
def a16_paired_bootstrap(v: Views):
    d = scored(v).groupBy("leaf", "channel").agg(F.avg(F.pow(c("label") - c("score"), 2) - F.pow(c("label") - F.lit(0.5), 2)).alias("value")).withColumn("id", c("channel"))
    stats = sketches.resampled(d, "leaf")
    return stats.groupBy(c("grp").alias("leaf")).agg(F.percentile("stat", [0.05, 0.95]).alias("q")).select("leaf", c("q")[0].alias("low"), c("q")[1].alias("high"))


@query("WITH " + SCORED + ", d AS (SELECT score, count(*) AS n, sum(label)::BIGINT AS pos FROM s GROUP BY 1), b AS (SELECT *, sum(n) OVER (ORDER BY score) - n AS before, sum(n) OVER () AS total FROM d) SELECT CAST(before * 5 // total AS BIGINT) AS bin, CAST(sum(n) AS BIGINT) AS cases, min(score) AS low, max(score) AS high, CAST(sum(pos) AS BIGINT) / CAST(sum(n) AS BIGINT)::DOUBLE AS rate FROM b GROUP BY 1")
def a35_calibration_bins(v: Views):
    d = scored(v).groupBy("score").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))  # a row for each distinct score: at most some dozens
    total = d.agg(F.sum("n").alias("total"))
    b = d.withColumn("before", F.sum("n").over(Window.orderBy("score")) - c("n")).join(F.broadcast(total), F.lit(True))
    g = b.groupBy(F.floor(c("before") * 5 / c("total")).alias("bin")).agg(F.sum("n").alias("cases"), F.min("score").alias("low"), F.max("score").alias("high"), (F.sum("pos") / F.sum("n")).alias("rate"))
    return g


@query("WITH " + MEDIAN + " SELECT leaf, CASE WHEN nv >= 20 AND t >= 12 THEN 'ready' ELSE 'inconclusive' END AS state, count(*) AS cells, count(*) FILTER (threshold > 1700000) AS high FROM tot JOIN med USING (leaf, format) GROUP BY 1, 2")
def a52_cohort_overview(v: Views):
    cell = v.content.groupBy("leaf", "format").agg(F.count("*").alias("nv"), F.count_distinct("channel").alias("t"))
    rows = cell.join(B.weighted_median(v.content, ["leaf", "format"]), ["leaf", "format"])
    return rows.groupBy("leaf", F.when((c("nv") >= 20) & (c("t") >= 12), "ready").otherwise("inconclusive").alias("state")).agg(F.count("*").alias("cells"), F.count_if(c("threshold") > 1_700_000).alias("high"))
