"""Scalar functions over whole tables (family F)."""

from pyspark.sql import functions as F

from trendloom.functions import metrics as M
from trendloom.functions import text as T
from trendloom.operators.overlap import normal_form
from trendloom.plans.registry import STOP_SQL, query
from trendloom.sources.views import Views


@query("""SELECT dataset_id, CASE WHEN views*0.2::DOUBLE + likes*1.5::DOUBLE + comments*3.0::DOUBLE > 0 THEN views*0.2::DOUBLE + likes*1.5::DOUBLE + comments*3.0::DOUBLE ELSE 1.0::DOUBLE END AS signal FROM content""")
def f01_engagement_signal(v: Views):
    return v.content.select("dataset_id", M.engagement(F.col("views"), F.col("likes"), F.col("comments"), F.lit(1.0)).alias("signal"))


@query("SELECT dataset_id, views*0.5::DOUBLE + likes*2.0::DOUBLE + comments*3.0::DOUBLE AS trend_score FROM content")
def f02_trend_score(v: Views):
    return v.content.select("dataset_id", M.trend_score(F.col("views"), F.col("likes"), F.col("comments")).alias("trend_score"))


@query("""WITH a AS (SELECT *, greatest((epoch_us(captured) - epoch_us(published)) / 86400000000.0::DOUBLE, 1.0::DOUBLE) AS age FROM content)
SELECT dataset_id, views / age AS views_per_day, (likes + comments) / views::DOUBLE AS engagement_rate,
round(ln(1 + views / age) * (1 + least((likes + comments) / views::DOUBLE * 10, 1.0::DOUBLE)), 6) AS signal FROM a""")
def f03_performance_metrics(v: Views):
    day = M.views_per_day(F.col("views"), M.days_between(F.col("published"), F.col("captured")))
    rate = M.engagement_rate(F.col("views"), F.col("likes"), F.col("comments"))
    return v.content.select("dataset_id", day.alias("views_per_day"), rate.alias("engagement_rate"), M.performance(day, rate).alias("signal"))


@query("""SELECT dataset_id, CAST((duration // 7) * 3600 + (duration % 7) * 60 + duration AS BIGINT) AS seconds FROM content""")
def f04_iso_duration(v: Views):
    text = F.format_string("PT%dH%dM%dS", F.floor(F.col("duration") / 7), F.col("duration") % 7, F.col("duration"))
    return v.content.select("dataset_id", M.iso_seconds(text).alias("seconds"))


@query("""SELECT dataset_id, CASE dataset_id % 3 WHEN 0 THEN views WHEN 1 THEN (views // 1000) * 1000 ELSE (views // 100000) * 100000 END AS n FROM content""")
def f05_count_text(v: Views):
    k, m = F.floor(F.col("views") / 1000), F.floor(F.col("views") / 100000)
    text = (
        F.when(F.col("dataset_id") % 3 == 0, F.concat(F.format_number("views", 0), F.lit(" views")))
        .when(F.col("dataset_id") % 3 == 1, F.format_string("%dK+", k))
        .otherwise(F.format_string("%d.%dM", F.floor(m / 10), m % 10))
    )
    return v.content.select("dataset_id", M.count_text(text).alias("n"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 4 < 3 THEN substr(md5(p_partkey::VARCHAR), 1, 11) END AS video_id FROM part
UNION ALL SELECT -1 - page_id, NULL FROM pages""")
def f06_video_id(v: Views):
    key = F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 11)
    form = (
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("https://www.youtube.com/watch?t=1&v="), key))
        .when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("https://youtu.be/"), key, F.lit("?si=x")))
        .when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("http://m.youtube.com/shorts/"), key))
        .otherwise(F.concat(F.lit("https://youtube.com/channel/"), key))
    )
    urls = v.table("part").select(F.col("p_partkey").alias("id"), form.alias("url")).union(v.table("pages").select(-1 - F.col("page_id"), "url"))
    return urls.select("id", M.video_id(F.col("url")).alias("video_id"))


@query("SELECT platform, run_at, key, sha1(platform || '|' || key::VARCHAR) AS trend_key FROM items")
def f07_stable_key(v: Views):
    return v.items.select("platform", "run_at", "key", M.stable_key(F.col("platform"), F.lit(""), F.col("key").cast("string")).alias("trend_key"))


@query("SELECT metric_version, format, count(*) AS n, max(captured) AS last_captured FROM content GROUP BY 1, 2")
def f08_metric_version(v: Views):
    return v.content.groupBy("metric_version", "format").agg(F.count("*").alias("n"), F.max("captured").alias("last_captured"))


@query("""WITH a AS (SELECT *, (epoch_us(captured) - epoch_us(published)) / 86400000000.0::DOUBLE - 2300 AS d FROM content)
SELECT dataset_id, CASE WHEN d < 0 THEN 'invalid' WHEN d < 7 THEN '0-7' WHEN d < 30 THEN '7-30' WHEN d < 90 THEN '30-90' WHEN d < 365 THEN '90-365' ELSE '365+' END AS age FROM a""")
def f09_age_bucket(v: Views):
    return v.content.select("dataset_id", M.age_bucket(M.days_between(F.col("published"), F.col("captured")) - 2300).alias("age"))


@query("SELECT CASE WHEN duration * 10 <= 180 THEN '<=180' ELSE '>180' END AS bucket, count(*) AS n FROM content GROUP BY 1")
def f10_duration_bucket(v: Views):
    return v.content.groupBy(M.duration_bucket(F.col("duration") * 10).alias("bucket")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, coalesce(props::JSON ->> '$.format.kind', props::JSON ->> '$.format', props::JSON ->> '$.k') AS confirmed FROM events""")
def f11_confirmed_format(v: Views):
    paths = ("$.format.kind", "$.format", "$.k")
    return v.table("events").select("event_id", F.coalesce(*[F.get_json_object("props", p) for p in paths]).alias("confirmed"))


@query(r"""SELECT page_id, length(t) AS n_chars, md5(t) AS digest, length(t) >= 80 AS usable FROM (SELECT page_id,
trim(regexp_replace(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM pages)""")
def f12_normal_text(v: Views):
    t = T.normal(F.col("html"))
    return v.table("pages").select("page_id", F.length(t).cast("long").alias("n_chars"), F.md5(t).alias("digest"), (F.length(t) >= 80).alias("usable"))


@query(r"SELECT dataset_id, sha256(text) AS raw_sha256, sha256(nullif(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}]', '', 'g'), '')) AS identity_sha256, sha256(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '\s+', '', 'g')) AS normal_sha256 FROM transcripts")
def f13_identity_hashes(v: Views):
    return v.transcripts.select("dataset_id", F.sha2("text", 256).alias("raw_sha256"), T.identity(F.col("text")).alias("identity_sha256"), F.sha2(normal_form("text"), 256).alias("normal_sha256"))


@query(r"SELECT dataset_id, md5(t) AS digest, length(t) AS n_chars FROM (SELECT dataset_id, trim(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}-]+', ' ', 'g')) AS t FROM transcripts)")
def f14_clean_text(v: Views):
    t = T.clean(F.col("text"))
    return v.transcripts.select("dataset_id", F.md5(t).alias("digest"), F.length(t).cast("long").alias("n_chars"))


@query("""SELECT dataset_id, md5(replace(replace(replace(lower(text), ' an ', ' one '), ' ist ', ' is '), ' une ', ' un ')) AS digest FROM transcripts""")
def f15_term_replacement(v: Views):
    t = F.lower("text")
    for a, b in ((" an ", " one "), (" ist ", " is "), (" une ", " un ")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return v.transcripts.select("dataset_id", F.md5(t).alias("digest"))


@query("SELECT dataset_id, CAST(sum(tf) AS BIGINT) AS n_tokens, count(*) AS n_terms FROM terms GROUP BY 1")
def f16_tokens(v: Views):
    t = T.tokens(F.col("text"))
    rows = v.transcripts.select("dataset_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_terms"))
    return rows.where("n_tokens > 0")


@query(rf"""WITH w AS (SELECT dataset_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}]+'), lambda w: length(w) > 1 AND w NOT IN ({STOP_SQL}) AND NOT regexp_full_match(w, '[0-9]+')) AS ws FROM transcripts),
g AS (SELECT dataset_id, 1 AS k, unnest(ws) AS gram FROM w UNION ALL SELECT dataset_id, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w
UNION ALL SELECT dataset_id, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w)
SELECT dataset_id, gram, count(*) AS frequency, round(CASE k WHEN 1 THEN count(*) + CASE WHEN length(gram) >= 6 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END WHEN 2 THEN count(*) * 1.8::DOUBLE + 0.3::DOUBLE ELSE count(*) * 2.2::DOUBLE + 0.4::DOUBLE END, 3) AS score
FROM g GROUP BY dataset_id, k, gram HAVING k = 1 OR count(*) >= 2""")
def f17_bigram_candidates(v: Views):
    """Single words, and pairs and triples of words that occur twice, counted row by row."""
    found = v.transcripts.select("dataset_id", F.inline(T.phrase_counts(T.tokens(F.col("text")), 3)))
    n, long = F.col("n"), F.length("value") >= 6
    score = F.when(F.col("k") == 1, n + F.when(long, 0.2).otherwise(0.0)).when(F.col("k") == 2, n * 1.8 + 0.3).otherwise(n * 2.2 + 0.4)
    return found.select("dataset_id", F.col("value").alias("gram"), n.alias("frequency"), F.round(score, 3).alias("score"))


@query(r"""SELECT dataset_id, len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+'), lambda w: w = 'the')) AS n_the FROM transcripts""")
def f18_phrase_count(v: Views):
    return v.transcripts.select("dataset_id", T.phrase_count(F.col("text"), "the").cast("long").alias("n_the"))


@query("""SELECT conv_id, string_agg(text, ' ' ORDER BY segment_index) FILTER (start < 30) AS hook, count(*) FILTER (start < 30) AS n_hook FROM segments GROUP BY 1""")
def f20_segment_window(v: Views):
    whole = v.segments.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("segment_index", "start", "text"))).alias("s"))
    inside = F.filter("s", lambda x: (x["start"] >= 0) & (x["start"] < 30))
    return whole.select("conv_id", F.array_join(F.transform(inside, lambda x: x["text"]), " ").alias("hook"), F.size(inside).cast("long").alias("n_hook"))


@query("""WITH lex AS (SELECT term, 'c' || (dense_rank() OVER (ORDER BY term) % 5)::VARCHAR AS concept FROM (SELECT term FROM terms GROUP BY 1 ORDER BY count(*) DESC, term LIMIT 40)),
m AS (SELECT dataset_id, concept, sum(tf) AS f, count(*) AS k FROM terms JOIN lex USING (term) GROUP BY 1, 2)
SELECT dataset_id, concept, least(5.0::DOUBLE, 2.6::DOUBLE + 0.35::DOUBLE * f::BIGINT + 0.15::DOUBLE * k) AS score FROM m""")
def f21_canonical_concepts(v: Views):
    from pyspark.sql import Window

    top = v.terms.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(40)  # a lexicon of fixed size
    lexicon = top.select("term", F.concat(F.lit("c"), (F.dense_rank().over(Window.orderBy("term")) % 5).cast("string")).alias("concept"))
    hits = v.terms.join(F.broadcast(lexicon), "term").groupBy("dataset_id", "concept").agg(F.sum("tf").alias("f"), F.count("*").alias("k"))
    return hits.select("dataset_id", "concept", F.least(F.lit(5.0), 2.6 + 0.35 * F.col("f") + 0.15 * F.col("k")).alias("score"))


@query("""WITH hints(domain, term) AS (VALUES ('en', 'that'), ('en', 'was'), ('en', 'with'), ('de', 'ist'), ('de', 'mit'), ('de', 'nicht'), ('fr', 'dans'), ('fr', 'une'), ('fr', 'pour'), ('es', 'por'), ('es', 'una'), ('es', 'para')),
h AS (SELECT dataset_id, domain, sum(tf)::BIGINT AS hits FROM terms JOIN hints USING (term) GROUP BY 1, 2)
SELECT t.dataset_id, coalesce(b.domain, 'unknown') AS domain, coalesce(b.hits, 0) AS hits FROM transcripts t
LEFT JOIN (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY hits DESC, domain) = 1) b USING (dataset_id)""")
def f22_domain_detection(v: Views):
    hints = {"en": ("that", "was", "with"), "de": ("ist", "mit", "nicht"), "fr": ("dans", "une", "pour"), "es": ("por", "una", "para")}
    table = v.spark.createDataFrame([(d, t) for d, ts in hints.items() for t in ts], "domain string, term string")
    hits = v.terms.join(F.broadcast(table), "term").groupBy("dataset_id", "domain").agg(F.sum("tf").alias("hits"))
    best = hits.groupBy("dataset_id").agg(F.min_by(F.struct("domain", "hits"), F.struct(-F.col("hits"), "domain")).alias("b"))
    return v.transcripts.join(best, "dataset_id", "left").select(
        "dataset_id", F.coalesce("b.domain", F.lit("unknown")).alias("domain"), F.coalesce("b.hits", F.lit(0)).cast("long").alias("hits")
    )


@query(r"""SELECT dataset_id, CASE WHEN regexp_matches(text, '\+[0-9]') THEN 1 ELSE 0 END AS has_phone, CAST(nullif(regexp_extract(text, 'Version ([0-9]+)', 1), '') AS BIGINT) AS version_no,
regexp_matches(text, '(?i)licensed') AS licensed, length(regexp_extract(text, 'AKIA[A-Z0-9]+')) AS key_chars FROM transcripts""")
def f23_specifications(v: Views):
    return v.transcripts.select(
        "dataset_id", F.when(F.col("text").rlike(r"\+[0-9]"), 1).otherwise(0).alias("has_phone"),
        F.nullif(F.regexp_extract("text", "Version ([0-9]+)", 1), F.lit("")).cast("long").alias("version_no"),
        F.col("text").rlike("(?i)licensed").alias("licensed"), F.length(F.regexp_extract("text", "AKIA[A-Z0-9]+", 0)).cast("long").alias("key_chars"),
    )


@query(r"""SELECT dataset_id, CASE WHEN n >= 3 THEN 'present' WHEN n >= 1 THEN 'weak' ELSE 'missing' END AS digits_status,
CASE WHEN n_chars >= 2000 THEN 'present' WHEN n_chars >= 200 THEN 'weak' ELSE 'missing' END AS length_status FROM (SELECT dataset_id, n_chars, len(regexp_extract_all(text, '[0-9]+')) AS n FROM transcripts)""")
def f24_dimension_status(v: Views):
    n = F.size(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)))
    ladder = lambda c, high, low: F.when(c >= high, "present").when(c >= low, "weak").otherwise("missing")
    return v.transcripts.select("dataset_id", ladder(n, 3, 1).alias("digits_status"), ladder(F.col("n_chars"), 2000, 200).alias("length_status"))


@query(r"""WITH s AS (SELECT dataset_id, unnest(string_split(text, '.')) AS s, generate_subscripts(string_split(text, '.'), 1) AS i FROM transcripts),
r AS (SELECT dataset_id, trim(s, ' ' || chr(10)) AS sentence, len(regexp_extract_all(s, '[,;]')) AS signal, length(s) AS n, i FROM s WHERE length(trim(s, ' ' || chr(10))) > 0)
SELECT dataset_id, md5(sentence) AS sentence_md5, signal FROM r QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY signal DESC, n, i) = 1""")
def f25_extractive_summary(v: Views):
    parts = v.transcripts.select("dataset_id", F.posexplode(F.split("text", "[.]")).alias("i", "s"))
    rows = parts.select(
        "dataset_id", "i", F.trim(F.col("s"), F.lit(" \n")).alias("sentence"), F.size(F.regexp_extract_all("s", F.lit("[,;]"), F.lit(0))).alias("signal"), F.length("s").alias("n")
    ).where("length(sentence) > 0")
    best = rows.groupBy("dataset_id").agg(F.min_by(F.struct("sentence", "signal"), F.struct(-F.col("signal"), "n", "i")).alias("b"))
    return best.select("dataset_id", F.md5("b.sentence").alias("sentence_md5"), F.col("b.signal").cast("long").alias("signal"))


@query(r"""SELECT dataset_id, len(e) AS n_entities, coalesce(array_to_string(list_sort(list_distinct(e)), ','), '') AS entities FROM (SELECT dataset_id, regexp_extract_all(text, '[A-Z]{2,}[0-9]*') AS e FROM transcripts)""")
def f26_product_entities(v: Views):
    e = F.regexp_extract_all("text", F.lit("[A-Z]{2,}[0-9]*"), F.lit(0))
    return v.transcripts.select("dataset_id", F.size(e).cast("long").alias("n_entities"), F.array_join(F.array_sort(F.array_distinct(e)), ",").alias("entities"))


@query(r"""SELECT dataset_id, md5(substr(regexp_replace(regexp_replace(text, '(password|token)\s*=\s*\S+', '\1=***', 'g'), 'AKIA[A-Z0-9]+', '***', 'g'), 1, 500)) AS digest FROM transcripts""")
def f28_log_redaction(v: Views):
    t = F.regexp_replace(F.regexp_replace("text", r"(password|token)\s*=\s*\S+", "$1=***"), "AKIA[A-Z0-9]+", "***")
    return v.transcripts.select("dataset_id", F.md5(F.substring(t, 1, 500)).alias("digest"))


@query("""WITH p AS (SELECT *, lag(rank) OVER (PARTITION BY platform, key ORDER BY run_at) AS before FROM items)
SELECT platform, run_at, key, CASE WHEN before IS NULL THEN 'new' WHEN before = rank THEN 'same' WHEN before > rank THEN 'up ' || (before - rank)::VARCHAR ELSE 'down ' || (rank - before)::VARCHAR END AS label FROM p""")
def f29_change_label(v: Views):
    from pyspark.sql import Window

    d = F.lag("rank").over(Window.partitionBy("platform", "key").orderBy("run_at")) - F.col("rank")
    label = F.when(d.isNull(), "new").when(d == 0, "same").when(d > 0, F.format_string("up %d", d)).otherwise(F.format_string("down %d", -d))
    return v.items.select("platform", "run_at", "key", label.alias("label"))


@query("""SELECT event_id, TRY_CAST(CASE WHEN regexp_full_match(props::JSON ->> '$.k', '0|[1-9][0-9]*') THEN props::JSON ->> '$.k' END AS BIGINT) AS n FROM events""")
def f32_canonical_count(v: Views):
    return v.table("events").select("event_id", M.canonical_count(F.get_json_object("props", "$.k")).alias("n"))


@query("""WITH rules(pattern, keyword) AS (VALUES ('license', 'rights'), ('password', 'secret'), ('@', 'contact'), ('stupid', 'insult'))
SELECT dataset_id, keyword FROM transcripts JOIN rules ON contains(lower(text), pattern)""")
def f33_rule_keywords(v: Views):
    rules = {"license": "rights", "password": "secret", "@": "contact", "stupid": "insult"}
    t = F.lower("text")
    hit = F.filter(F.array(*[F.when(t.contains(p), F.lit(k)) for p, k in rules.items()]), lambda x: x.isNotNull())
    return v.transcripts.select("dataset_id", F.explode(hit).alias("keyword"))


@query("""SELECT dataset_id, CASE WHEN greatest(l, p, c) = 0 THEN 'none' WHEN l >= p AND l >= c THEN 'legal' WHEN p >= c THEN 'account' ELSE 'contact' END AS domain FROM (SELECT dataset_id,
3 * contains(lower(text), 'license')::INT AS l, 2 * contains(lower(text), 'password')::INT AS p, 2 * contains(text, '@')::INT AS c FROM transcripts)""")
def f34_domain_from_features(v: Views):
    t = F.lower("text")
    legal, account, contact = (t.contains(p).cast("int") * w for p, w in (("license", 3), ("password", 2), ("@", 2)))
    best = F.when(F.greatest(legal, account, contact) == 0, "none").when((legal >= account) & (legal >= contact), "legal").when(account >= contact, "account").otherwise("contact")
    return v.transcripts.select("dataset_id", best.alias("domain"))


@query("SELECT dataset_id, term, tf, row_number() OVER (PARTITION BY dataset_id ORDER BY tf DESC, term) AS place FROM terms QUALIFY place <= 5")
def f36_local_keywords(v: Views):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("dataset_id").orderBy(F.desc("tf"), "term"))
    return v.terms.select("dataset_id", "term", "tf", place.cast("long").alias("place")).where("place <= 5")


@query(r"""WITH h AS (SELECT conv_id, string_agg(text, ' ' ORDER BY segment_index) AS body, string_agg(text, ' ' ORDER BY segment_index) FILTER (start < 30) AS hook FROM segments GROUP BY 1),
w AS (SELECT conv_id, unnest(regexp_extract_all(lower(body), '[\p{L}\p{M}\p{N}]+')) AS term, 1.0::DOUBLE AS weight FROM h UNION ALL SELECT conv_id, unnest(regexp_extract_all(lower(hook), '[\p{L}\p{M}\p{N}]+')), 0.5::DOUBLE FROM h)
SELECT conv_id, term, sum(weight) AS score FROM w GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY sum(weight) DESC, term) <= 5""")
def f35_hook_keywords(v: Views):
    from pyspark.sql import Window

    term = v.segments.select("conv_id", "start", F.explode(T.words(F.col("text"))).alias("term"))
    scored = term.groupBy("conv_id", "term").agg(F.sum(F.when(F.col("start") < 30, 1.5).otherwise(1.0)).alias("score"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "term"))
    return scored.withColumn("place", place).where("place <= 5").drop("place")
