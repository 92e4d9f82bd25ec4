"""Streams run to the end of what is there (family T); the SQL twins are the batch forms over closed windows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from trendloom.plans.registry import query
from trendloom.sources.views import OBSERVATION_CHANGE, Views
from trendloom.streaming import jobs as J
from trendloom.streaming import stateful as S

c = F.col
CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


def events(v: Views):
    return J.read_events(v.spark, v.sf_dir)


@query(f"SELECT event_type AS platform, date_trunc('hour', ts)::TIMESTAMP AS bucket_at, count(*) AS n, arg_min(event_id, (ts, event_id)) AS first_sample, arg_max(event_id, (ts, event_id)) AS last_sample FROM events GROUP BY 1, 2 HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= {CLOSED}")
def t01_hour_archive(v: Views):
    return J.drain(J.hour_archive(events(v))).withColumn("bucket_at", c("bucket_at").cast("timestamp_ntz"))


@query("SELECT DISTINCT event_type, user_id FROM events")
def t02_replay_safe_ingest(v: Views):
    return J.drain(J.once_per_key(events(v), ["event_type", "user_id"]))


@query(f"WITH b AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) <= INTERVAL 90 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM b) SELECT event_type AS platform, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n FROM s GROUP BY event_type, k HAVING max(ts) + INTERVAL 90 MINUTE <= {CLOSED}")
def t03_sessions(v: Views):
    return J.drain(J.sessions(events(v))).select("platform", c("first_at").cast("timestamp_ntz").alias("first_at"), c("last_at").cast("timestamp_ntz").alias("last_at"), "n")


@query(f"""WITH e AS (SELECT user_id, ts, event_id, event_type <> 'error' AS good, CAST(floor(value) AS BIGINT) AS x, CASE WHEN ts < TIMESTAMP '{OBSERVATION_CHANGE}' THEN 'v1' ELSE 'v2' END AS version FROM events),
p AS (SELECT *, lag(good) OVER w AS b, lag(x) OVER w AS bx, lag(version) OVER w AS bv, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 3600000000.0::DOUBLE AS h FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, CASE WHEN NOT good THEN 'failed' WHEN b IS NULL OR NOT b THEN 'chain_start' WHEN version <> bv OR h <= 0 THEN 'not_comparable' WHEN x < bx THEN 'counter_correction' ELSE 'measured' END AS state FROM p)
SELECT user_id AS entity, event_id AS obs_id, state, CASE WHEN state IN ('measured', 'counter_correction') THEN x - bx END AS growth, CASE WHEN good AND b THEN round(h, 6) END AS hours, CASE WHEN state = 'measured' THEN round((x - bx) / h, 6) END AS per_hour FROM s WHERE ts <= {CLOSED}""")
def t04_chained_growth(v: Views):
    got = J.drain(S.chained_growth(events(v), OBSERVATION_CHANGE))
    return got.select("entity", "obs_id", "state", "growth", F.round("hours", 6).alias("hours"), F.round("per_hour", 6).alias("per_hour"))


#: A session for each region and segment of customers; a third of them each follows all, what its customers follow, or nothing.
MODE = {0: "all", 1: "following", 2: "off"}
_MODE = " ".join(f"WHEN {k} THEN '{m}'" for k, m in MODE.items())


@query(f"""WITH ok AS (SELECT platform, run_at, lag(run_at) OVER (PARTITION BY platform ORDER BY run_at) AS before_at FROM runs WHERE status = 'ok'),
k AS (SELECT event_type AS platform, user_id AS key, date_trunc('day', ts)::TIMESTAMP AS run_at, arg_min(ts, (ts, event_id)) AS detected_at FROM events WHERE ts <= {CLOSED} GROUP BY 1, 2, 3),
o AS (SELECT k.*, before_at, lag(k.run_at) OVER (PARTITION BY k.platform, key ORDER BY k.run_at) AS last_at FROM k JOIN ok USING (platform, run_at)), new AS (SELECT platform, key, run_at, detected_at FROM o WHERE before_at IS NOT NULL AND last_at IS DISTINCT FROM before_at),
se AS (SELECT DISTINCT region || '|' || role AS session, CASE region % 3 {_MODE} END AS mode FROM customers), fo AS (SELECT region || '|' || role AS session, user_id AS key, TIMESTAMP '2024-01-01' + to_days(CAST(user_id % 30 AS INTEGER)) AS created_at FROM customers),
hit AS (SELECT session, new.* FROM new, se WHERE mode = 'all' UNION SELECT session, new.* FROM new JOIN fo USING (key) JOIN se USING (session) WHERE mode = 'following' AND created_at <= detected_at)
SELECT session, platform, key, min(detected_at) AS detected_at FROM hit GROUP BY 1, 2, 3""")
def t05_notifications(v: Views):
    """Each new trend once for every session whose mode asks for it."""
    before = F.lag("run_at").over(Window.partitionBy("platform").orderBy("run_at"))  # a row for each run
    runs = v.runs.where("status = 'ok'").select("platform", c("run_at").cast("timestamp").alias("run_at"), before.cast("timestamp").alias("before_at"))
    session = F.concat_ws("|", "region", "role").alias("session")
    mode = F.create_map(*[F.lit(x) for pair in MODE.items() for x in pair])
    sessions = v.customers.select(session, mode[(c("region") % 3).cast("int")].alias("mode")).distinct()
    follows = v.customers.select(session, c("user_id").alias("key"), F.date_add(F.lit("2024-01-01").cast("date"), (c("user_id") % 30).cast("int")).cast("timestamp").alias("created_at"))
    return J.notifications(S.new_keys(events(v), runs), sessions, follows).withColumn("detected_at", c("detected_at").cast("timestamp_ntz"))


@query("""SELECT event_type AS platform, date_trunc('hour', ts)::TIMESTAMP AS bucket_at, count(*) AS n, min(ts) AS first_at, arg_min(event_id, (ts, event_id)) AS first_sample, max(ts) AS last_at, arg_max(event_id, (ts, event_id)) AS last_sample
FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 90 DAY FROM events) GROUP BY 1, 2""")
def t06_late_audit(v: Views):
    """The archive after all rows, late ones included; the audit is the second result of the job."""
    archive, _ = J.late_audit(events(v))
    return archive.select("platform", *[c(x).cast("timestamp_ntz").alias(x) for x in ("bucket_at", "first_at", "last_at")], "n", "first_sample", "last_sample")


@query(f"WITH w AS (SELECT event_type AS platform, date_trunc('hour', ts)::TIMESTAMP - to_hours(k) AS from_at, value FROM events, range(0, 24) r(k)) SELECT platform, from_at, count(*) AS n, count(*) FILTER (value > 5) AS good FROM w GROUP BY 1, 2 HAVING from_at + INTERVAL 24 HOUR <= {CLOSED}")
def t07_sliding_health(v: Views):
    return J.drain(J.sliding_health(events(v))).withColumn("from_at", c("from_at").cast("timestamp_ntz"))


@query("SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events WHERE event_type <> 'error' GROUP BY 1")
def t08_merge_latest(v: Views):
    rows = events(v).where("event_type <> 'error'").select("user_id", "ts", "event_id", "event_type")
    return J.merge_latest(rows, ["user_id"], ["ts", "event_id"]).select("user_id", c("ts").cast("timestamp_ntz").alias("ts"), "event_id", "event_type")


@query(f"SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, 'topic' || (user_id % 4)::VARCHAR AS topic, 1 AS version, count(*) AS n FROM events SEMI JOIN (SELECT DISTINCT c_custkey AS user_id FROM customer) USING (user_id) GROUP BY 1, 2 HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= {CLOSED}")
def t09_topic_counts(v: Views):
    catalog = v.customers.select("user_id", F.concat(F.lit("topic"), (c("user_id") % 4).cast("string")).alias("topic"), F.lit(1).alias("version"))
    return J.drain(J.topic_counts(events(v), catalog)).withColumn("day", c("day").cast("timestamp_ntz"))
