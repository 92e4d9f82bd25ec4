"""Windows over snapshots and readings (family W) and the trend joins (J1-J4, J7)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from trendloom.functions import metrics as M
from trendloom.operators import history as H
from trendloom.operators import trend as T
from trendloom.operators.ranking import rank_within
from trendloom.plans.registry import query
from trendloom.sources.views import OBSERVATION_CHANGE, Views

HOUR = 3_600_000_000
c = F.col
CHANGES = """WITH pr AS (SELECT platform, run_at, lag(run_at) OVER (PARTITION BY platform ORDER BY run_at) AS prev_at FROM runs WHERE status = 'ok'),
ch AS (SELECT i.platform, i.run_at, i.key, i.rank, p.rank AS prev_rank, p.rank - i.rank AS rank_change, i.score - p.score AS delta,
CASE WHEN pr.prev_at IS NULL THEN 'first_run' WHEN p.rank IS NULL THEN 'new' WHEN p.rank > i.rank THEN 'up' WHEN p.rank < i.rank THEN 'down' ELSE 'same' END AS change_kind
FROM items i JOIN pr ON i.platform = pr.platform AND i.run_at = pr.run_at LEFT JOIN items p ON p.platform = i.platform AND p.run_at = pr.prev_at AND p.key = i.key) """


@query("""SELECT platform, key, run_at, rank, score FROM (SELECT i.*, row_number() OVER (PARTITION BY i.platform, key ORDER BY i.run_at DESC) AS n FROM items i JOIN runs r ON i.platform = r.platform AND i.run_at = r.run_at WHERE status = 'ok') WHERE n <= 10""")
def j01_item_history(v: Views):
    good = v.runs.where("status = 'ok'").select("platform", "run_at")
    return T.latest_runs(v.items.join(good, ["platform", "run_at"]), ["platform", "key"], "run_at", 10).select("platform", "key", "run_at", "rank", "score")


@query("""WITH ok AS (SELECT * FROM runs WHERE status = 'ok'), b AS (SELECT r.platform, r.run_at, r.n_items, max(p.run_at) AS prev_at FROM ok r LEFT JOIN ok p ON p.platform = r.platform AND p.run_at < r.run_at GROUP BY ALL),
j AS (SELECT i.*, b.n_items, b.prev_at, p.rank AS prev_rank, p.score AS b_score, (i.run_at < TIMESTAMP '2024-01-15') = (p.run_at < TIMESTAMP '2024-01-15') AS alike FROM items i JOIN b USING (platform, run_at) LEFT JOIN items p ON p.platform = i.platform AND p.run_at = b.prev_at AND p.key = i.key),
k AS (SELECT *, CASE WHEN alike THEN score - b_score ELSE 0.0::DOUBLE END AS d FROM j)
SELECT platform, run_at, key, rank, prev_rank, coalesce(prev_rank - rank, 0) AS rank_change, d AS delta, CASE WHEN alike AND b_score > 0 THEN d / b_score * 100.0::DOUBLE ELSE 0.0::DOUBLE END AS percent,
CASE WHEN prev_at IS NULL THEN 0.0::DOUBLE ELSE d / (date_diff('second', prev_at, run_at)::DOUBLE / 60.0::DOUBLE) END AS per_minute, coalesce(NOT alike, false) AS metric_changed, prev_at IS NOT NULL AND prev_rank IS NULL AS is_new,
CASE WHEN prev_at IS NULL THEN 'baseline' WHEN prev_rank IS NULL THEN 'new' WHEN rank < prev_rank THEN 'rank_up' WHEN rank > prev_rank THEN 'rank_down' ELSE 'none' END AS change_kind, CASE WHEN (rank - 1) * 10 < n_items THEN 'Hot' ELSE 'Stable' END AS status FROM k""")
def j02_snapshot_changes(v: Views):
    version = F.when(c("run_at") < F.lit(OBSERVATION_CHANGE).cast("timestamp_ntz"), "v1").otherwise("v2")
    return T.snapshot_changes(v.items.withColumn("metric_version", version), v.runs)


@query("""SELECT r.platform, r.run_at, max(g.run_at) AS as_of FROM runs r LEFT JOIN runs g ON g.platform = r.platform AND g.status = 'ok' AND g.run_at <= r.run_at - INTERVAL 2 DAY GROUP BY 1, 2""")
def j03_as_of_run(v: Views):
    return T.as_of_run(v.runs, 2)


@query(CHANGES + "SELECT platform, run_at, key, rank FROM ch WHERE change_kind = 'new'")
def j04_new_items(v: Views):
    before = v.items.select("platform", F.col("run_at").alias("prev_at"), "key")
    now = v.items.join(T.previous_run(v.runs).where("prev_at is not null"), ["platform", "run_at"])
    return now.join(before, ["platform", "prev_at", "key"], "left_anti").select("platform", "run_at", "key", "rank")


@query("""WITH r AS (SELECT *, count(*) FILTER (status = 'failed') OVER (PARTITION BY entity ORDER BY us, obs_id) AS bad FROM observations),
g AS (SELECT * FROM r WHERE status = 'complete'), l AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY entity ORDER BY us DESC, obs_id DESC) = 1)
SELECT l.entity, l.obs_id, e.obs_id AS e_id, l.counter - e.counter AS gain, l.us - e.us AS age_us FROM l JOIN g e ON e.entity = l.entity AND e.metric_version = l.metric_version AND e.bad = l.bad
AND l.us - e.us BETWEEN 12 * 3600000000 AND 36 * 3600000000 QUALIFY row_number() OVER (PARTITION BY l.entity ORDER BY abs(l.us - e.us - 24 * 3600000000), e.obs_id) = 1""")
def j07_growth_pair(v: Views):
    return T.growth_pairs(v.readings)


@query("""WITH ok AS (SELECT platform, run_at, row_number() OVER (PARTITION BY platform ORDER BY run_at DESC) AS place FROM runs WHERE status = 'ok'),
st AS (SELECT platform, max(run_at) FILTER (place = 1) AS last_at, max(run_at) FILTER (place = 2) AS prev_at FROM ok WHERE place <= 2 GROUP BY 1), s AS (SELECT platform, max(run_at) AS any_at FROM runs GROUP BY 1),
x AS (SELECT platform, last_at, prev_at, CASE WHEN any_at > last_at THEN 'latest_unavailable' WHEN last_at < (SELECT max(run_at) FROM runs) - INTERVAL 2 DAY THEN 'stale' WHEN prev_at IS NULL THEN 'insufficient' WHEN last_at > prev_at + INTERVAL 1 DAY THEN 'collection_gap' END AS state FROM st JOIN s USING (platform)),
n AS (SELECT i.* FROM items i JOIN x ON i.platform = x.platform AND i.run_at = x.last_at), p AS (SELECT i.* FROM items i JOIN x ON i.platform = x.platform AND i.run_at = x.prev_at),
f AS (SELECT coalesce(n.platform, p.platform) AS platform, coalesce(n.key, p.key) AS key, n.rank AS rank, p.rank AS prev_rank FROM n FULL JOIN p ON n.platform = p.platform AND n.key = p.key)
SELECT platform, key, rank, prev_rank, coalesce(state, CASE WHEN prev_rank IS NULL THEN 'new_entry' WHEN rank IS NULL THEN 'not_in_latest' WHEN rank < prev_rank THEN 'up' WHEN rank > prev_rank THEN 'down' ELSE 'unchanged' END) AS movement,
CASE WHEN state IS NULL THEN prev_rank - rank END AS change FROM f JOIN x USING (platform)""")
def w01_rank_movement(v: Views):
    """Movement between the last two good runs; a failed latest run, an old one, a single one or a gap takes the place of the movement."""
    two = T.latest_runs(v.runs.where("status = 'ok'"), ["platform"], "run_at", 2).select("platform", "run_at", "place")
    at = lambda i: F.max(F.when(F.col("place") == i, F.col("run_at")))
    points = two.groupBy("platform").agg(at(1).alias("at"), at(2).alias("bt")).join(v.runs.groupBy("platform").agg(F.max("run_at").alias("any_at")), "platform")
    points = points.join(F.broadcast(v.runs.agg(F.max("run_at").alias("now"))), F.lit(True))  # one row
    state = (
        F.when(F.col("any_at") > F.col("at"), "latest_unavailable").when(F.expr("at < now - interval 2 days"), "stale").when(F.col("bt").isNull(), "insufficient")
        .when(F.expr("at > bt + interval 1 day"), "collection_gap")
    )
    rows = v.items.join(two, ["platform", "run_at"])
    now, old = (rows.where(F.col("place") == i).select("platform", "key", F.col("rank").alias(name)) for i, name in ((1, "rank"), (2, "prev_rank")))
    both = now.join(old, ["platform", "key"], "full").join(points.select("platform", state.alias("state")), "platform")
    kind = (
        F.when(F.col("prev_rank").isNull(), "new_entry").when(F.col("rank").isNull(), "not_in_latest").when(F.col("rank") < F.col("prev_rank"), "up")
        .when(F.col("rank") > F.col("prev_rank"), "down").otherwise("unchanged")
    )
    change = F.when(F.col("state").isNull(), F.col("prev_rank") - F.col("rank"))
    return both.select("platform", "key", "rank", "prev_rank", F.coalesce("state", kind).alias("movement"), change.alias("change"))


INTERVALS = """WITH p AS (SELECT *, lag(us) OVER w AS b_us, lag(status) OVER w AS b_status, lag(counter) OVER w AS b_counter, lag(metric_version) OVER w AS b_version FROM observations WINDOW w AS (PARTITION BY entity ORDER BY us, obs_id)),
k AS (SELECT *, CASE WHEN b_us IS NULL THEN 'first' WHEN status = 'failed' OR b_status = 'failed' THEN 'missing' WHEN b_version <> metric_version THEN 'metric_changed' WHEN counter < b_counter THEN 'counter_decreased' ELSE 'measured' END AS kind FROM p) """


@query(INTERVALS + """SELECT entity, obs_id, kind, CASE WHEN kind = 'measured' THEN counter - b_counter END AS gain,
CASE WHEN kind = 'measured' AND us > b_us THEN (counter - b_counter) / ((us - b_us) / 3600000000.0::DOUBLE) END AS per_hour FROM k""")
def w02_view_intervals(v: Views):
    return T.intervals(v.readings)


@query("""WITH p AS (SELECT *, lag(status) OVER w AS b_status, lag(views) OVER w AS b_views, lag(us) OVER w AS b_us FROM observations WINDOW w AS (PARTITION BY entity ORDER BY us, obs_id))
SELECT entity, obs_id, CASE WHEN status = 'failed' THEN 'failed' WHEN b_status IS NULL OR b_status = 'failed' THEN 'chain_start' ELSE 'measured' END AS state,
CASE WHEN status <> 'failed' AND b_status = 'complete' THEN views - b_views END AS growth, CASE WHEN status <> 'failed' AND b_status = 'complete' THEN us - b_us END AS gap_us FROM p""")
def w03_growth_with_breaks(v: Views):
    before = F.lag(F.struct("status", "views", "us")).over(Window.partitionBy("entity").orderBy("us", "obs_id"))
    p = v.observations.withColumn("b", before)
    linked = (F.col("status") != "failed") & (F.col("b.status") == "complete")
    state = F.when(F.col("status") == "failed", "failed").when(F.col("b").isNull() | (F.col("b.status") == "failed"), "chain_start").otherwise("measured")
    return p.select("entity", "obs_id", state.alias("state"), F.when(linked, F.col("views") - F.col("b.views")).alias("growth"), F.when(linked, F.col("us") - F.col("b.us")).alias("gap_us"))


@query("""SELECT dataset_id, leaf, metric_version, row_number() OVER w AS rank, 100.0::DOUBLE * (n - (row_number() OVER w) + 1) / n AS percentile FROM (SELECT *, count(*) OVER (PARTITION BY leaf, metric_version) AS n,
views / greatest((epoch_us(captured) - epoch_us(published)) / 86400000000.0::DOUBLE, 1.0::DOUBLE) AS per_day FROM content) WINDOW w AS (PARTITION BY leaf, metric_version ORDER BY per_day DESC, dataset_id)""")
def w04_performance_rank(v: Views):
    day = M.views_per_day(F.col("views"), M.days_between(F.col("published"), F.col("captured")))
    rows = v.content.select("dataset_id", "leaf", "metric_version", day.alias("per_day"))
    ranked = rank_within(rows, ["leaf", "metric_version"], "per_day", "dataset_id")
    return ranked.select("dataset_id", "leaf", "metric_version", "rank", (F.lit(100.0) * (c("n") - c("rank") + 1) / c("n")).alias("percentile"))


@query(CHANGES + """, m AS (SELECT *, coalesce(delta, 0) > 0 AS pos, coalesce(delta, 0) < 0 AS neg FROM ch),
s AS (SELECT *, CASE WHEN pos THEN 100.0::DOUBLE * count(*) OVER (PARTITION BY platform, run_at, pos ORDER BY delta RANGE UNBOUNDED PRECEDING) / count(*) OVER (PARTITION BY platform, run_at, pos) END AS rising,
CASE WHEN neg THEN 100.0::DOUBLE * count(*) OVER (PARTITION BY platform, run_at, neg ORDER BY -delta RANGE UNBOUNDED PRECEDING) / count(*) OVER (PARTITION BY platform, run_at, neg) END AS cooling FROM m)
SELECT platform, run_at, key, rising, cooling, CASE WHEN rank_change > 0 THEN least(100, 45 + 12 * rank_change) END AS rank_momentum,
CASE WHEN rising >= 90 THEN 'Hot' WHEN rising >= 50 THEN 'Rising' WHEN cooling >= 70 THEN 'Cooling' ELSE 'Stable' END AS label FROM s""")
def w05_momentum(v: Views):
    d = F.coalesce("delta", F.lit(0.0))
    ch = T.changes(v.items, v.runs).withColumn("pos", d > 0).withColumn("neg", d < 0)
    by = ["platform", "run_at"]
    s = ch.withColumn("rising", T.share_not_above(F.col("delta"), by, F.col("pos"))).withColumn("cooling", T.share_not_above(-F.col("delta"), by, F.col("neg")))
    label = F.when(F.col("rising") >= 90, "Hot").when(F.col("rising") >= 50, "Rising").when(F.col("cooling") >= 70, "Cooling").otherwise("Stable")
    momentum = F.when(F.col("rank_change") > 0, F.least(F.lit(100), 45 + 12 * F.col("rank_change")))
    return s.select("platform", "run_at", "key", "rising", "cooling", momentum.alias("rank_momentum"), label.alias("label"))


@query("""WITH g AS (SELECT entity, obs_id, us, lag(us) OVER w AS b_us, lag(obs_id) OVER w AS b_id FROM observations WHERE status = 'complete' WINDOW w AS (PARTITION BY entity ORDER BY us, obs_id)),
f AS (SELECT entity, us, obs_id FROM observations WHERE status = 'failed'), n AS (SELECT g.entity, g.obs_id, g.us - g.b_us AS gap_us, count(f.us) > 0 AS interrupted
FROM g LEFT JOIN f ON f.entity = g.entity AND (f.us, f.obs_id) > (g.b_us, g.b_id) AND (f.us, f.obs_id) < (g.us, g.obs_id) GROUP BY 1, 2, 3)
SELECT *, interrupted OR coalesce(gap_us > 5400000000, false) AS gap_before FROM n""")
def w06_gap_flag(v: Views):
    return H.gap_flags(v.observations)


@query("""WITH e AS (SELECT user_id % 7 AS scope, user_id AS key, epoch_us(ts) AS us, epoch_us(ts) // 3600000000 AS hour, event_type = 'error' AS failed FROM events),
p AS (SELECT DISTINCT scope, us FROM (SELECT scope, hour, unnest([min(us), max(us)]) AS us FROM e WHERE NOT failed GROUP BY 1, 2)), q AS (SELECT scope, us, lag(us) OVER (PARTITION BY scope ORDER BY us) AS b FROM p),
g AS (SELECT q.scope, q.us, any_value(q.us - q.b > 5400000000) OR count(e.us) > 0 AS gap FROM q LEFT JOIN e ON e.scope = q.scope AND e.failed AND e.us > q.b AND e.us <= q.us GROUP BY 1, 2),
s AS (SELECT scope, count(*) AS points, count(DISTINCT us // 3600000000) AS hours_observed, count(*) FILTER (gap) AS gap_count, min(us) AS first_us, max(us) AS last_us FROM g GROUP BY 1),
fl AS (SELECT scope, count(*) FILTER (failed) AS failed_total, max(us) FILTER (failed) AS last_bad FROM e GROUP BY 1), lim AS (SELECT min(hour) AS lo, max(hour) AS hi, max(us) AS end_us FROM e),
o AS (SELECT e.scope, e.key, count(DISTINCT hour) AS n, bool_or(hour = last_us // 3600000000) AS latest FROM e JOIN s USING (scope) WHERE NOT failed GROUP BY 1, 2),
k AS (SELECT scope, key AS default_key FROM o WHERE latest QUALIFY row_number() OVER (PARTITION BY scope ORDER BY n DESC, key) = 1),
hr AS (SELECT scope, hour, count(*) FILTER (failed) AS bad, count(*) FILTER (NOT failed) AS good FROM e GROUP BY 1, 2),
d AS (SELECT x.scope, CAST(DATE '1970-01-01' + CAST((x.hour + 7) // 24 AS INTEGER) AS DATE) AS day, count(*) FILTER (good > 0) AS observed_hours, count(*) FILTER (good > 0 AND bad > 0) AS partial_hours, count(*) FILTER (coalesce(good, 0) = 0) AS unobserved_hours, CAST(coalesce(sum(bad), 0) AS BIGINT) AS failed_attempts
FROM (SELECT scope, unnest(range(lo, hi + 1)) AS hour FROM fl, lim) x LEFT JOIN hr ON hr.scope = x.scope AND hr.hour = x.hour GROUP BY 1, 2)
SELECT d.*, coalesce(points, 0) AS points, coalesce(hours_observed, 0) AS hours_observed, coalesce(gap_count, 0) AS gap_count, failed_total, first_us, last_us, coalesce(end_us - last_us > 5400000000, true) AS is_stale,
coalesce(last_bad >= coalesce(last_us, last_bad), false) AS latest_unavailable, default_key FROM d JOIN fl USING (scope) LEFT JOIN s USING (scope) LEFT JOIN k USING (scope), lim""")
def w07_history_report(v: Views):
    return H.coverage_report(v.events.select((c("user_id") % 7).alias("scope"), c("user_id").alias("key"), "us", (c("event_type") == "error").alias("failed")))


@query("SELECT i.platform, i.run_at, key, rank, score FROM items i JOIN (SELECT platform, max(run_at) AS run_at FROM runs WHERE status = 'ok' GROUP BY 1) l ON i.platform = l.platform AND i.run_at = l.run_at")
def w08_latest_snapshot(v: Views):
    last = v.runs.where("status = 'ok'").groupBy("platform").agg(F.max("run_at").alias("run_at"))
    return v.items.join(last, ["platform", "run_at"]).select("platform", "run_at", "key", "rank", "score")


HOURS = """WITH hr AS (SELECT event_type AS platform, epoch_us(ts) // 3600000000 AS h, count(*) AS n FROM events GROUP BY 1, 2),
lim AS (SELECT platform, min(h) AS lo, max(h) AS hi FROM hr GROUP BY 1), grid AS (SELECT platform, unnest(range(lo, hi + 1)) AS h FROM lim),
cov AS (SELECT grid.platform, grid.h, CASE WHEN n IS NULL THEN 'missing' ELSE 'observed' END AS status, coalesce(n, 0) AS n FROM grid LEFT JOIN hr ON hr.platform = grid.platform AND hr.h = grid.h) """


def hour_grid(v: Views):
    hours = v.events.groupBy(F.col("event_type").alias("platform"), F.floor(F.col("us") / HOUR).alias("h")).agg(F.count("*").alias("n"))
    grid = hours.groupBy("platform").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).select("platform", F.explode(F.sequence("lo", "hi")).alias("h"))
    return grid.join(hours, ["platform", "h"], "left").select("platform", "h", F.when(F.col("n").isNull(), "missing").otherwise("observed").alias("status"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query(HOURS + """SELECT platform, status, min(h) AS first, max(h) AS last, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY h) - row_number() OVER (PARTITION BY platform, status ORDER BY h) AS g FROM cov) GROUP BY platform, status, g""")
def w09_coverage_islands(v: Views):
    return T.islands(hour_grid(v).drop("n"), ["platform"], "h", "status")


@query("""SELECT event_type AS platform, date_trunc('hour', ts)::TIMESTAMP AS bucket_at, min(ts) AS first_at, max(ts) AS last_at, arg_min(event_id, (ts, event_id)) AS first_sample, arg_max(event_id, (ts, event_id)) AS last_sample, count(*) AS n FROM events GROUP BY 1, 2""")
def w10_hour_samples(v: Views):
    at = F.struct("ts", "event_id")
    return v.table("events").groupBy(F.col("event_type").alias("platform"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bucket_at")).agg(
        F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.min_by("event_id", at).alias("first_sample"), F.max_by("event_id", at).alias("last_sample"), F.count("*").alias("n")
    )


@query("""SELECT dataset_id, title, channel FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY dataset_id) AS a, row_number() OVER (PARTITION BY channel, duration ORDER BY dataset_id) AS b FROM content) WHERE a = 1 AND b = 1""")
def w11_first_occurrence(v: Views):
    a = F.row_number().over(Window.partitionBy("title").orderBy("dataset_id"))
    b = F.row_number().over(Window.partitionBy("channel", "duration").orderBy("dataset_id"))
    return v.content.withColumn("a", a).withColumn("b", b).where("a = 1 and b = 1").select("dataset_id", "title", "channel")


@query("""SELECT CAST(date_trunc('day', ts + INTERVAL 7 HOUR) AS TIMESTAMP) AS day, count(*) AS calls, greatest(1440.0::DOUBLE / count(*), 1.0::DOUBLE) AS minutes_between FROM events GROUP BY 1""")
def w12_daily_budget(v: Views):
    day = F.date_trunc("day", F.expr("ts + INTERVAL 7 HOURS")).cast("timestamp_ntz")
    return v.table("events").groupBy(day.alias("day")).agg(F.count("*").alias("calls"), F.greatest(F.lit(1440.0) / F.count("*"), F.lit(1.0)).alias("minutes_between"))


@query(HOURS + """SELECT platform, h, CASE WHEN n = 0 AND h = (SELECT max(hi) FROM lim) THEN 'pending' WHEN n = 0 THEN 'missed' WHEN n = 1 THEN 'interrupted' ELSE 'complete' END AS state FROM cov""")
def w13_schedule_slots(v: Views):
    grid = hour_grid(v)
    last = grid.agg(F.max("h").alias("top"))  # one row
    state = F.when((F.col("n") == 0) & (F.col("h") == F.col("top")), "pending").when(F.col("n") == 0, "missed").when(F.col("n") == 1, "interrupted").otherwise("complete")
    return grid.join(F.broadcast(last), F.lit(True)).select("platform", "h", state.alias("state"))


@query("SELECT user_id, analysis_id, created_at, status FROM analyses QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, analysis_id DESC) = 1")
def w14_latest_analysis(v: Views):
    best = v.analyses.groupBy("user_id").agg(F.max_by(F.struct("analysis_id", "created_at", "status"), F.struct("created_at", "analysis_id")).alias("a"))
    return best.select("user_id", "a.*")


@query("""WITH l AS (SELECT entity, max(us) FILTER (status = 'complete') AS last_us FROM observations GROUP BY 1) SELECT entity, (row_number() OVER (ORDER BY last_us NULLS FIRST, entity) - 1) // 50 AS batch FROM l""")
def w15_rotation(v: Views):
    last = v.observations.groupBy("entity").agg(F.max(F.when(F.col("status") == "complete", F.col("us"))).alias("at"))
    # rank by range: rows of a range are numbered on their own, behind the count of the ranges before it
    bounds = last.withColumn("part", F.floor(F.coalesce("at", F.lit(0)) / (24 * HOUR)))
    before = bounds.groupBy("part").agg(F.count("*").alias("n"))
    offset = before.withColumn("base", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "base")  # one row a day
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_first("at"), "entity")) - 1
    return bounds.withColumn("own", own).join(offset, "part").select("entity", F.floor((F.col("own") + F.col("base")) / 50).alias("batch"))


@query("""SELECT dataset_id, leaf, 1 + 2.0::DOUBLE * (views - min(views) OVER w) / nullif(max(views) OVER w - min(views) OVER w, 0) AS weight FROM content WINDOW w AS (PARTITION BY leaf)""")
def w16_min_max_weights(v: Views):
    w = Window.partitionBy("leaf")
    lo, hi = F.min("views").over(w), F.max("views").over(w)
    return v.content.select("dataset_id", "leaf", (1 + F.lit(2.0) * (F.col("views") - lo) / F.nullif(hi - lo, F.lit(0))).alias("weight"))


@query("SELECT event_id, user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) // 1000000 AS gap_seconds FROM events WHERE event_type = 'view'")
def w17_observation_gap(v: Views):
    before = F.lag("us").over(Window.partitionBy("user_id").orderBy("us", "event_id"))
    return v.events.where("event_type = 'view'").select("event_id", "user_id", F.floor((F.col("us") - before) / 1_000_000).alias("gap_seconds"))
