"""Counts and discovery of topics (A17, A18), checks before rows change (J12, J21, S13, S19) and states of centroid distances (M6)."""

from pyspark.sql import functions as F

from trendloom.functions.splits import channel_split
from trendloom.operators import benchmark as B
from trendloom.operators import curation as C
from trendloom.operators import discovery as D
from trendloom.operators import textml as X
from trendloom.plans.eligibility import reasons_sql
from trendloom.plans.learning import CENT
from trendloom.plans.registry import STOP_SQL, bucket_sql, query
from trendloom.sources.views import Views

c = F.col
FIRST_LINE = r"^[^.\n]*"


@query("""WITH RECURSIVE e AS (SELECT event_type AS platform, date_trunc('day', ts)::TIMESTAMP AS run_at, CASE WHEN user_id % 13 <> 12 THEN user_id END AS video, CAST(floor(value) AS BIGINT) AS rank, event_id, CAST(props::JSON ->> '$.k' AS BIGINT) AS k FROM events),
g AS (SELECT platform, run_at, rank, video, count(*) AS n, min(event_id) AS place, arg_min(k, event_id) AS k FROM e WHERE video IS NOT NULL AND rank BETWEEN 1 AND 50 GROUP BY ALL),
v AS (SELECT platform, run_at, rank, list(video ORDER BY place) AS videos FROM g GROUP BY ALL),
w AS (SELECT DISTINCT platform, run_at, CAST(0 AS BIGINT) AS rank, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS pick FROM e UNION ALL
SELECT platform, run_at, rank, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END, pick FROM (SELECT w.platform, w.run_at, w.rank + 1 AS rank, w.taken, list_filter(v.videos, lambda x: NOT list_contains(w.taken, x))[1] AS pick FROM w LEFT JOIN v ON v.platform = w.platform AND v.run_at = w.run_at AND v.rank = w.rank + 1 WHERE w.rank < 50)),
a AS (SELECT platform, run_at, rank AS took, pick AS video FROM w WHERE pick IS NOT NULL), p AS (SELECT g.*, a.took FROM g LEFT JOIN a USING (platform, run_at, video)),
s AS (SELECT platform, run_at, count(*) AS source_rows, count(*) FILTER (video IS NULL OR rank IS NULL OR rank < 1 OR rank > 50) AS bad FROM e GROUP BY 1, 2),
q AS (SELECT platform, run_at, count(*) FILTER (took = rank) AS eligible, CAST(coalesce(sum(n - CAST(took = rank AS INT)) FILTER (took <= rank), 0) AS BIGINT) AS duplicates, CAST(coalesce(sum(n) FILTER (took IS NULL OR took > rank), 0) AS BIGINT) AS late,
count(*) FILTER (took = rank AND k < 30) AS low, count(*) FILTER (took = rank AND k % 2 = 0) AS even FROM p GROUP BY 1, 2),
t(topic) AS (VALUES ('low'), ('even'), ('none'))
SELECT s.platform, s.run_at, topic, coalesce(CASE topic WHEN 'low' THEN low WHEN 'even' THEN even END, 0) AS videos, source_rows, coalesce(eligible, 0) AS eligible, bad + coalesce(late, 0) AS invalid, coalesce(duplicates, 0) AS duplicates,
CASE WHEN bad + coalesce(late, 0) = 0 THEN 'complete' ELSE 'insufficient_source' END AS quality FROM s LEFT JOIN q USING (platform, run_at), t""")
def a17_topic_counts(v: Views):
    k = F.get_json_object("props", "$.k").cast("long")
    topics = F.filter(F.array(F.when(k < 30, "low"), F.when(k % 2 == 0, "even")), lambda x: x.isNotNull())
    rows = v.table("events").select(
        c("event_type").alias("platform"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("run_at"), F.when(c("user_id") % 13 != 12, c("user_id")).alias("video_id"),
        F.floor("value").cast("long").alias("rank"), c("event_id").alias("place"), topics.alias("topics"),
    )
    return D.count_observations(rows, ["low", "even", "none"], ["platform", "run_at"])


@query(rf"""WITH t AS (SELECT doc_id, source AS channel, regexp_extract_all(regexp_extract(text, '{FIRST_LINE}'), '[\p{{L}}\p{{M}}\p{{N}}]+') AS w FROM documents),
u AS (SELECT lower(array_to_string(w, ' ')) AS title, channel, w FROM t WHERE len(w) > 0 QUALIFY row_number() OVER (PARTITION BY lower(array_to_string(w, ' ')) ORDER BY doc_id) = 1),
g AS (SELECT title, channel, k, i, array_to_string(w[i : i + k - 1], ' ') AS surface, w[i] AS a, w[i + k - 1] AS z FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, unnest([1, 2, 3]) AS k FROM u) WHERE len(w) >= k)),
p AS (SELECT title, channel, lower(surface) AS phrase, arg_min(surface, i) AS surface FROM g WHERE lower(a) NOT IN ({STOP_SQL}) AND lower(z) NOT IN ({STOP_SQL}) AND NOT regexp_full_match(surface, '[0-9 ]+') GROUP BY 1, 2, 3),
n AS (SELECT phrase, count(*) AS n, count(DISTINCT channel) AS nc FROM p GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT channel) >= 2), l AS (SELECT phrase, surface, count(*) AS k FROM p GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY k DESC, surface) = 1)
SELECT phrase, surface AS label, n, nc FROM n JOIN l USING (phrase)""")
def a18_topic_discovery(v: Views):
    """Phrases of the first lines of all texts; a channel is a source."""
    return D.discover_topics(v.table("documents").select(c("doc_id").alias("video_id"), F.regexp_extract("text", FIRST_LINE, 0).alias("title"), c("source").alias("channel")))


@query("""WITH st AS (SELECT leaf AS run, dataset_id AS key, CASE WHEN dataset_id % 7 = 0 THEN 'renamed' ELSE title END AS title, CASE dataset_id % 3 WHEN 0 THEN '' WHEN 2 THEN channel END AS channel, CASE WHEN dataset_id % 5 > 0 THEN views END AS views FROM content),
sa AS (SELECT leaf AS run, dataset_id AS key, title, CASE WHEN dataset_id % 9 = 0 THEN 'later' ELSE channel END AS channel, views + 1 AS views FROM content WHERE dataset_id % 10 <> 7),
m AS (SELECT st.*, sa.title IS NOT NULL AND st.title = sa.title AS same, sa.channel AS c2, sa.views AS v2 FROM st LEFT JOIN sa USING (run, key))
SELECT run, key, title, CASE WHEN same AND coalesce(channel, '') = '' THEN c2 ELSE channel END AS channel, CASE WHEN same THEN coalesce(views, v2) ELSE views END AS views, same AND ((coalesce(channel, '') = '' AND c2 IS NOT NULL) OR (views IS NULL AND v2 IS NOT NULL)) AS enriched FROM m""")
def j12_fill_missing(v: Views):
    """Archived rows of a run, some without channel or counter, filled from the run's own sample."""
    i, rows = c("dataset_id"), v.content
    stored = rows.select(
        c("leaf").alias("run"), i.alias("key"), F.when(i % 7 == 0, "renamed").otherwise(c("title")).alias("title"), F.when(i % 3 == 0, "").when(i % 3 == 2, c("channel")).alias("channel"), F.when(i % 5 > 0, c("views")).alias("views"),
    )
    again = F.explode(F.array(F.struct(F.lit(0).alias("seq"), c("channel").alias("channel")), F.struct(F.when(i % 9 == 0, 1).otherwise(-1).alias("seq"), F.lit("later").alias("channel"))))
    sample = rows.where(i % 10 != 7).select(c("leaf").alias("run"), i.alias("key"), "title", (c("views") + 1).alias("views"), again.alias("s")).select("run", "key", "title", "views", "s.*")
    return C.enrich(stored, sample, ["run", "key"], "title", ["channel"], ["views"], "seq")


CELL = ["leaf", "format", "metric_version"]


@query(f"""WITH r AS (SELECT dataset_id - CASE WHEN dataset_id % 50 = 1 THEN 1 ELSE 0 END AS video_id, dataset_id, channel, views, title LIKE '%small%' AS detected, leaf, format, metric_version FROM content WHERE {bucket_sql('channel', 100)} < 70),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY dataset_id) = 1), k AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY leaf, format, metric_version, channel) AS w FROM f),
m AS (SELECT *, sum(w) OVER (PARTITION BY leaf, format, metric_version ORDER BY views, dataset_id ROWS UNBOUNDED PRECEDING) AS cum FROM k), t AS (SELECT leaf, format, metric_version, count(*) AS n, count(DISTINCT channel) AS ch FROM f GROUP BY ALL),
d AS (SELECT leaf, format, metric_version, any_value(n) AS n, min(views) AS th FROM m JOIN t USING (leaf, format, metric_version) WHERE cum + 1e-9 >= ch / 2.0::DOUBLE GROUP BY ALL),
a AS (SELECT leaf, format, metric_version, count(*) FILTER (dataset_id % 97 = 5) AS dropped, count(*) FILTER (dataset_id % 97 <> 5) AS kept FROM f JOIN d USING (leaf, format, metric_version) WHERE detected AND views > th GROUP BY ALL)
SELECT leaf, format, metric_version, th + CAST(format = 'long' AND leaf = 'PROMO' AS INT) AS threshold, th AS derived_threshold, n + CAST(leaf = 'ECONOMY' AND format = 'short' AS INT) AS benchmark_count, n, coalesce(dropped, 0) AS only_derived, CAST(0 AS BIGINT) AS only_saved, coalesce(kept, 0) AS in_both,
NOT (format = 'long' AND leaf = 'PROMO') AND NOT (leaf = 'ECONOMY' AND format = 'short') AND coalesce(dropped, 0) = 0 AS accepted FROM d LEFT JOIN a USING (leaf, format, metric_version)""")
def j21_saved_group(v: Views):
    """Groups as saved, three kinds of them altered, against the groups that the rows of the training channels give."""
    i = c("dataset_id")
    rows = v.content.where(channel_split(c("channel")) == "train").select((i - F.when(i % 50 == 1, 1).otherwise(0)).alias("video_id"), "dataset_id", "channel", "views", c("title").contains("small").alias("detected"), *CELL)
    first = rows.groupBy("video_id").agg(F.min_by(F.struct("dataset_id", "channel", "views", "detected", *CELL), "dataset_id").alias("r")).select("video_id", "r.*")
    cells = first.groupBy(*CELL).agg(F.count("*").alias("n")).join(B.weighted_median(first, CELL), CELL)
    members = first.join(cells, CELL).where(c("detected") & (c("views") > c("threshold")) & (i % 97 != 5)).select(*CELL, "video_id")
    moved = ((c("format") == "long") & (c("leaf") == "PROMO")).cast("long")
    saved = cells.select(*CELL, (c("threshold") + moved).alias("threshold"), (c("n") + ((c("leaf") == "ECONOMY") & (c("format") == "short")).cast("long")).alias("benchmark_count"))
    return C.saved_groups(rows, saved, members, CELL)


@query("WITH " + CENT + """, n AS (SELECT label, list_transform(cvec, lambda y: y / sqrt(list_sum(list_transform(cvec, lambda z: z * z)))) AS cvec FROM cen),
s AS (SELECT vec_id, n.label, cvec, round(list_sum(list_transform(range(1, len(cvec) + 1), lambda k: cvec[k] * u.vec[k])), 6) AS sim FROM u, n), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS k FROM s),
p AS (SELECT a.vec_id, a.label AS first_label, b.label AS second_label, a.sim AS similarity, round(a.sim - b.sim, 6) AS margin, round(1 - list_sum(list_transform(range(1, len(a.cvec) + 1), lambda k: a.cvec[k] * b.cvec[k])), 6) AS separation FROM r a JOIN r b ON a.vec_id = b.vec_id AND a.k = 1 AND b.k = 2)
SELECT *, CASE WHEN similarity <= 0 THEN 'no_semantic_similarity' WHEN margin <= 0.000001 THEN 'text_centroid_tie' WHEN separation < 0.001 THEN 'overlapping_text_centroids' WHEN margin < 0.01 THEN 'similar_text_distances' ELSE 'ready' END AS state FROM p""")
def m06_centroid_distances(v: Views):
    u = v.vectors.select("vec_id", "label", X.unit(c("vec")).alias("vec"))
    return X.closest_centroids(u.select("vec_id", "vec"), X.centroids(u, "label"), "label")


ENTRY = r"""d AS (SELECT x.doc_id, text, lang, source, regexp_extract(text, '^[^.\n]*') AS title, toxic, quality FROM documents x LEFT JOIN labels y ON x.doc_id = y.doc_id),
e AS (SELECT doc_id AS entry_id, doc_id % 31 <> 7 AS parsed, CASE WHEN doc_id % 13 = 0 THEN doc_id + 1 ELSE doc_id END AS target, CASE WHEN doc_id % 29 = 3 THEN -1 WHEN doc_id % 13 = 0 THEN doc_id + 1 ELSE doc_id END AS declared, CASE WHEN doc_id % 17 = 4 THEN 'xx' ELSE lang END AS leaf,
CASE WHEN doc_id % 7 = 2 THEN title || ' | ' || source WHEN doc_id % 11 = 5 THEN 'changed' ELSE title END AS title, CASE doc_id % 4 WHEN 0 THEN text || ' more' WHEN 1 THEN substr(text, 1, 300) ELSE text END AS text FROM d)"""


@query("WITH " + ENTRY + r""", r AS (SELECT doc_id AS dataset_id, toxic = 0 AS active, quality IS NOT NULL AS manual, lang AS leaf, trim(coalesce(title, '')) AS title, source AS creator, trim(coalesce(text, '')) AS text FROM d),
o AS (SELECT sha256(text) AS h, list(dataset_id) AS ids FROM r WHERE text <> '' GROUP BY 1),
x AS (SELECT e.entry_id, e.parsed, e.target, e.declared, e.leaf, trim(coalesce(e.title, '')) AS given, trim(coalesce(e.text, '')) AS body, r.dataset_id, r.active, r.manual, r.leaf AS rleaf, coalesce(r.title, '') AS own, coalesce(r.creator, '') AS creator, coalesce(r.text, '') AS old, o.ids FROM e LEFT JOIN r ON r.dataset_id = e.target LEFT JOIN o ON o.h = sha256(trim(coalesce(e.text, '')))),
y AS (SELECT *, given = own || ' | ' || creator AS suffixed, entry_id % 11 = 5 AND entry_id % 2 = 1 AND target = entry_id AND length(substr(regexp_replace(old, '\s+', '', 'g'), 1, 200)) = 200 AND substr(regexp_replace(old, '\s+', '', 'g'), 1, 200) = substr(regexp_replace(body, '\s+', '', 'g'), 1, 200) AS reviewed FROM x),
z AS (SELECT *, CASE WHEN NOT parsed THEN 'not_parsed' WHEN target <> declared THEN 'id_mismatch' WHEN dataset_id IS NULL THEN 'no_single_row' WHEN NOT coalesce(active, false) THEN 'archived' WHEN leaf <> rleaf THEN 'other_category' WHEN NOT manual THEN 'other_method'
WHEN body = '' THEN 'no_text' WHEN len(list_filter(ids, lambda i: i <> target)) > 0 THEN 'copy_of_other_row' WHEN NOT (given = own OR suffixed OR reviewed) THEN 'title_differs' END AS reason FROM y),
k AS (SELECT *, CASE WHEN coalesce(reason, '') <> 'not_parsed' THEN target END AS vid, CASE WHEN coalesce(reason, '') NOT IN ('not_parsed', 'id_mismatch', 'no_single_row', 'archived', 'other_category', 'other_method') AND body <> '' THEN sha256(body) END AS txt FROM z),
b AS (SELECT *, vid IS NOT NULL AND count(*) OVER (PARTITION BY vid) > 1 AS same_video, txt IS NOT NULL AND count(*) OVER (PARTITION BY txt) > 1 AS same_text FROM k)
SELECT entry_id, target, CASE WHEN reason IS NOT NULL OR same_video OR same_text THEN 'blocked' WHEN body = old THEN 'unchanged' ELSE 'ready' END AS status, reason, """ + reasons_sql(("same_video", "same_row"), ("same_text", "same_text")) + """ AS batch,
CASE WHEN reason IS NULL THEN """ + reasons_sql(("suffixed AND given <> own", "creator_in_title"), ("given <> own AND NOT suffixed", "reviewed_title"), ("length(body) < length(old)", "shorter")) + " ELSE '' END AS warnings FROM b")
def s13_replacement_plan(v: Views):
    """Every text offered as a replacement: some unread, misnamed, of another category, retitled, shortened or longer."""
    i = c("doc_id")
    d = v.table("documents").join(v.table("labels"), "doc_id", "left").withColumn("title", F.regexp_extract("text", FIRST_LINE, 0))
    target = F.when(i % 13 == 0, i + 1).otherwise(i)
    text = F.when(i % 4 == 0, F.concat("text", F.lit(" more"))).when(i % 4 == 1, F.substring("text", 1, 300)).otherwise(c("text"))
    entries = d.select(
        i.alias("entry_id"), (i % 31 != 7).alias("parsed"), target.alias("target"), F.when(i % 29 == 3, -1).otherwise(target).alias("declared"), F.when(i % 17 == 4, "xx").otherwise(c("lang")).alias("leaf"),
        F.when(i % 7 == 2, F.concat("title", F.lit(" | "), "source")).when(i % 11 == 5, "changed").otherwise(c("title")).alias("title"), text.alias("text"),
    )
    rows = d.select(i.alias("dataset_id"), (c("toxic") == 0).alias("active"), c("quality").isNotNull().alias("manual"), c("lang").alias("leaf"), "title", c("source").alias("creator"), "text")
    reviews = entries.where("entry_id % 11 = 5 and entry_id % 2 = 1").select(c("entry_id").alias("dataset_id"), F.sha2(F.trim("text"), 256).alias("sha256"))
    return C.replacement_plan(entries, rows, reviews)


@query(r"""WITH t AS (SELECT dataset_id, split, channel, text, regexp_extract(text, '^[^.\n]*') AS title, quality, toxic FROM transcripts), s AS (SELECT split, dataset_id AS sample_id, dataset_id - CASE WHEN dataset_id % 40 = 1 THEN 1 ELSE 0 END AS video_id, title, CASE WHEN dataset_id % 53 = 9 THEN 'x' ELSE sha256(title) END AS digest FROM t),
l AS (SELECT split, CASE WHEN dataset_id % 61 = 2 THEN -dataset_id ELSE dataset_id END AS sample_id, dataset_id - CASE WHEN dataset_id % 40 = 1 THEN 1 ELSE 0 END AS video_id, CASE WHEN dataset_id % 43 = 3 THEN upper(title) ELSE title END AS title,
CASE WHEN dataset_id % 37 = 8 THEN 'done' WHEN quality IS NULL THEN 'pending' WHEN toxic = 1 THEN 'ambiguous' WHEN quality = 1 THEN 'labeled' ELSE 'no_topic' END AS status, regexp_extract(title, '[\p{L}\p{M}]+') AS word, dataset_id % 23 = 4 AS wrong, dataset_id % 19 <> 6 AS signed, dataset_id AS id FROM t),
n AS (SELECT split, coalesce(s.sample_id, l.sample_id) AS sample_id, s.sample_id AS s_id, l.sample_id AS l_id, s.video_id, s.title, digest, l.video_id AS lv, l.title AS lt, status, word, wrong, signed, l.id FROM s FULL JOIN l USING (split, sample_id)),
q AS (SELECT *, s_id IS NOT NULL AND count(s_id) OVER (PARTITION BY video_id) > 1 AS dv, s_id IS NOT NULL AND title IS NOT NULL AND count(s_id) OVER (PARTITION BY title) > 1 AS dt, s_id IS NOT NULL AND l_id IS NOT NULL AS paired FROM n)
SELECT split, sample_id, status, """ + reasons_sql(
    ("dv", "duplicate_video"), ("dt", "duplicate_title"), ("s_id IS NOT NULL AND digest IS DISTINCT FROM sha256(title)", "digest"), ("l_id IS NULL", "label_missing"), ("s_id IS NULL", "label_added"),
    ("paired AND (lv IS DISTINCT FROM video_id OR lt IS DISTINCT FROM title)", "edited"),
    ("paired AND status = 'labeled' AND (coalesce(trim(word), '') = '' OR (wrong AND NOT contains(title, word || '!')))", "topics"), ("paired AND status = 'done'", "status"), ("paired AND status <> 'pending' AND NOT signed", "annotator"), ("paired AND status = 'ambiguous' AND id % 2 = 0", "note"),
) + " AS issues FROM q")
def s19_bundle_validation(v: Views):
    """Samples of all texts with label rows, some of them missing, added, edited, unsigned or with quotes that are not there."""
    i = c("dataset_id")
    t = v.transcripts.withColumn("title", F.regexp_extract("text", FIRST_LINE, 0)).withColumn("video_id", i - F.when(i % 40 == 1, 1).otherwise(0))
    samples = t.select("split", i.alias("sample_id"), "video_id", "title", F.when(i % 53 == 9, "x").otherwise(F.sha2("title", 256)).alias("title_sha256"))
    status = F.when(i % 37 == 8, "done").when(c("quality").isNull(), "pending").when(c("toxic") == 1, "ambiguous").when(c("quality") == 1, "labeled").otherwise("no_topic")
    word = F.regexp_extract("title", r"[\p{L}\p{M}]+", 0)
    listed = lambda x: F.when(status == "labeled", F.array(x)).otherwise(F.array().cast("array<string>"))
    labels = t.select(
        "split", F.when(i % 61 == 2, -i).otherwise(i).alias("sample_id"), "video_id", F.when(i % 43 == 3, F.upper("title")).otherwise(c("title")).alias("title"), status.alias("status"), listed(word).alias("topics"),
        listed(F.when(i % 23 == 4, F.concat(word, F.lit("!"))).otherwise(word)).alias("evidence"), F.when(i % 19 != 6, "ann").alias("annotator"), F.when(i % 2 == 1, "seen").alias("notes"),
    )
    return C.bundle_issues(samples, labels)
