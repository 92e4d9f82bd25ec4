"""Human-review and evidence audits (A39, A42, A63)."""

from pyspark.sql import functions as F

from trendloom.functions.splits import channel_split
from trendloom.functions.text import tokens
from trendloom.operators import audits as A
from trendloom.operators import spans as S
from trendloom.operators.components import checkpointed
from trendloom.operators.textml import top_per
from trendloom.plans.registry import query
from trendloom.plans.topics import TERMS, longest_sql, places_sql
from trendloom.sources.views import Views

c = F.col


@query("""WITH r AS (SELECT conv_id, segment_index AS reviewer, variant, CASE WHEN length(text) % 11 = 0 AND variant = 'A' THEN NULL ELSE 1 + (length(text) + k * 3 * (conv_id % 4)) % 5 END AS score FROM segments, (VALUES ('A', 0), ('B', 1), ('C', 2)) x(variant, k) WHERE NOT (length(text) % 13 = 0 AND variant = 'C')),
t AS (SELECT conv_id, reviewer, max(score) FILTER (variant = 'A') AS a, max(score) FILTER (variant = 'B') AS b, max(score) FILTER (variant = 'C') AS c FROM (SELECT conv_id, reviewer, variant, min(score) AS score FROM r GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING count(*) = 3),
m AS (SELECT conv_id, count(*) AS reviewers, quantile_cont(a, 0.5) AS a, quantile_cont(b, 0.5) AS b, quantile_cont(c, 0.5) AS c FROM t GROUP BY 1),
v AS (SELECT conv_id FROM segments GROUP BY 1 HAVING count(*) FILTER (length(text) % 3 > 0) >= 2 AND count(*) FILTER (length(text) % 3 > 0) > count(*) FILTER (length(text) % 3 = 0)),
p AS (SELECT conv_id AS case_id, CASE WHEN coalesce(reviewers, 0) < 3 THEN 'incomplete' WHEN a IS NULL OR b IS NULL OR c IS NULL THEN 'abstention' ELSE 'paired' END AS state, a, b, c, coalesce(reviewers, 0) AS reviewers FROM (SELECT DISTINCT conv_id FROM segments WHERE conv_id % 5 > 0) JOIN v USING (conv_id) LEFT JOIN m USING (conv_id)),
d AS (SELECT case_id, state, CASE WHEN state <> 'incomplete' THEN a END AS a, CASE WHEN state <> 'incomplete' THEN b END AS b, CASE WHEN state <> 'incomplete' THEN c END AS c, CASE WHEN state = 'paired' THEN b - a END AS b_minus_a, CASE WHEN state = 'paired' THEN c - b END AS c_minus_b, reviewers FROM p),
l AS (SELECT 'b_minus_a' AS comparison, b_minus_a AS x FROM d UNION ALL SELECT 'c_minus_b', c_minus_b FROM d)
SELECT 'case' AS kind, case_id::VARCHAR AS name, state, a, b, c, b_minus_a, c_minus_b, reviewers AS n, CAST(NULL AS BIGINT) AS wins, CAST(NULL AS BIGINT) AS ties, CAST(NULL AS BIGINT) AS losses, CAST(NULL AS DOUBLE) AS median FROM d
UNION ALL SELECT 'comparison', comparison, NULL, NULL, NULL, NULL, NULL, NULL, count(x), count(*) FILTER (x > 0), count(*) FILTER (x = 0), count(*) FILTER (x < 0), quantile_cont(x, 0.5) FILTER (x IS NOT NULL) FROM l GROUP BY comparison""")
def a39_review_utility(v: Views):
    """Three variants of each conversation, rated once for each turn: medians, paired differences, wins, ties and losses."""
    variants = F.explode(F.array(*[F.struct(F.lit(x).alias("variant"), F.lit(k).alias("k")) for k, x in enumerate(A.VARIANTS)])).alias("x")
    size = F.length("text")
    rows = v.segments.select(c("conv_id").alias("case_id"), c("segment_index").alias("reviewer"), size.alias("size"), variants).select("*", "x.variant", "x.k")
    score = F.when(~((c("size") % 11 == 0) & (c("variant") == "A")), 1 + (c("size") + c("k") * 3 * (c("case_id") % 4)) % 5)
    ratings = rows.where(~((c("size") % 13 == 0) & (c("variant") == "C"))).select("case_id", "reviewer", "variant", score.alias("score"))
    opinions = v.segments.select(c("conv_id").alias("case_id"), F.when(size % 3 > 0, "yes").otherwise("no").alias("opportunity"))
    cases = v.segments.select(c("conv_id").alias("case_id"), (c("conv_id") % 5 > 0).alias("eligible")).distinct()
    per_case = A.utility(ratings, opinions, cases)
    none = lambda t, *names: [F.lit(None).cast(t).alias(n) for n in names]
    listed = per_case.select(F.lit("case").alias("kind"), c("case_id").cast("string").alias("name"), "state", "a", "b", "c", "b_minus_a", "c_minus_b", c("reviewers").alias("n"), *none("long", "wins", "ties", "losses"), *none("double", "median"))
    compared = A.outcomes(per_case).select(F.lit("comparison").alias("kind"), c("comparison").alias("name"), *none("string", "state"), *none("double", "a", "b", "c", "b_minus_a", "c_minus_b"), "n", "wins", "ties", "losses", "median")
    return listed.unionByName(compared)


#: For every leaf its five most widespread training terms, each with three rows that hold it, offered to every text of the test split; some are tampered with.
ITEMS = """df AS (SELECT terms.leaf, term, count(*) AS df FROM terms JOIN transcripts USING (dataset_id) WHERE split = 'train' GROUP BY terms.leaf, term), best AS MATERIALIZED (SELECT leaf, term, row_number() OVER (PARTITION BY leaf ORDER BY df DESC, term) AS place FROM df QUALIFY place <= 5),
sup AS MATERIALIZED (SELECT t.leaf, term, place, dataset_id, tf, row_number() OVER (PARTITION BY t.leaf, term ORDER BY dataset_id) AS k FROM terms t JOIN best USING (leaf, term) JOIN (SELECT dataset_id FROM transcripts WHERE split = 'train') USING (dataset_id) QUALIFY k <= 3),
it AS MATERIALIZED (SELECT leaf, term, place, list(dataset_id ORDER BY dataset_id) AS ids, count(*) AS support_count, CAST(sum(tf) AS BIGINT) AS total FROM sup GROUP BY 1, 2, 3),
cs AS (SELECT dataset_id AS case_id, CASE WHEN dataset_id % 10 = 0 THEN 'unknown' ELSE leaf END AS domain, leaf FROM transcripts WHERE split = 'test'),
items_ AS MATERIALIZED (SELECT case_id, CASE WHEN place <= 3 THEN 'missing' ELSE 'hook' END AS lane, place, domain, term AS keyword, CASE WHEN (case_id + place) % 7 = 0 THEN [] WHEN (case_id + place) % 11 = 0 THEN list_concat(ids, [ids[1]]) WHEN (case_id + place) % 13 = 0 THEN list_concat(ids, [case_id]) ELSE ids END AS ids, support_count + CASE WHEN (case_id + place) % 17 = 0 THEN 1 ELSE 0 END AS support_count, total + CASE WHEN (case_id + place) % 19 = 0 THEN 1 ELSE 0 END AS total FROM cs JOIN it USING (leaf)),
every AS MATERIALIZED (SELECT * FROM items_ UNION ALL SELECT case_id, lane, place + 100, domain, keyword, ids, support_count, total FROM items_ WHERE case_id % 5 = 0 AND place = 1),
ci AS (SELECT case_id, lane, place, domain, keyword, unnest(ids) AS id FROM every), ch AS (SELECT ci.*, coalesce(t.split = 'train' AND t.leaf = domain, false) AS valid, tf FROM ci LEFT JOIN transcripts t ON t.dataset_id = id LEFT JOIN terms ON terms.dataset_id = id AND term = keyword),
su AS (SELECT case_id, lane, place, bool_or(NOT valid) AS bad_row, bool_or(valid AND tf IS NULL) AS no_term, sum(CASE WHEN valid THEN coalesce(tf, 0) END) AS found FROM ch GROUP BY 1, 2, 3),
au AS MATERIALIZED (SELECT e.*, list_filter([CASE WHEN m.term IS NOT NULL THEN 'already_mentioned_or_synonym' END, CASE WHEN place > min(place) OVER (PARTITION BY e.case_id, lane, keyword) THEN 'duplicate_suggestion' END, CASE WHEN len(ids) = 0 THEN 'no_dataset_evidence' END,
 CASE WHEN len(ids) <> len(list_distinct(ids)) OR support_count <> len(list_distinct(ids)) THEN 'invalid_support_count' END, CASE WHEN bad_row THEN 'invalid_reference_row' END, CASE WHEN no_term THEN 'term_not_found_in_cited_transcript' END, CASE WHEN len(ids) > 0 AND total <> coalesce(found, 0) THEN 'invalid_total_frequency' END, CASE WHEN domain = 'unknown' THEN 'unknown_should_abstain' END], lambda x: x IS NOT NULL) AS issues
 FROM every e LEFT JOIN su USING (case_id, lane, place) LEFT JOIN terms m ON m.dataset_id = e.case_id AND m.term = e.keyword)"""


def audited_items(v: Views):
    seen = v.transcripts.where("split = 'train'").select("leaf", F.explode(F.array_distinct(tokens(c("text")))).alias("term"))
    best = checkpointed(top_per(seen.groupBy("leaf", "term").agg(F.count("*").alias("df")), ["leaf"], [F.desc("df"), "term"], 5))
    offered = best.select("term").distinct()  # all that the rest asks of the texts
    hits = checkpointed(v.terms.withColumn("split", channel_split(c("channel"))).join(F.broadcast(offered), "term", "left_semi"))
    held = top_per(hits.where("split = 'train'").select("leaf", "term", "dataset_id", "tf").join(F.broadcast(best.select("leaf", "term", c("place").alias("rank"))), ["leaf", "term"]), ["leaf", "term"], ["dataset_id"], 3)  # five terms a leaf
    it = held.groupBy("leaf", "term", "rank").agg(F.array_sort(F.collect_list("dataset_id")).alias("ids"), F.count("*").alias("support_count"), F.sum("tf").alias("total_frequency"))
    cases = v.transcripts.where("split = 'test'").select(c("dataset_id").alias("case_id"), F.when(c("dataset_id") % 10 == 0, "unknown").otherwise(c("leaf")).alias("domain"), "leaf")
    k = c("case_id") + c("rank")
    none = F.array().cast("array<bigint>")
    ids = F.when(k % 7 == 0, none).when(k % 11 == 0, F.concat("ids", F.slice("ids", 1, 1))).when(k % 13 == 0, F.concat("ids", F.array("case_id"))).otherwise(c("ids"))
    rows = cases.join(F.broadcast(it), "leaf").select(
        "case_id", F.when(c("rank") <= 3, "missing").otherwise("hook").alias("lane"), c("rank").cast("long").alias("place"), "domain", c("term").alias("keyword"), ids.alias("ids"),
        (c("support_count") + (k % 17 == 0).cast("long")).alias("support_count"), (c("total_frequency") + (k % 19 == 0).cast("long")).alias("total_frequency"),
    )
    again = rows.where("case_id % 5 = 0 and place = 1").withColumn("place", c("place") + 100)
    references = hits.select(c("dataset_id").alias("id"), c("term").alias("keyword"), c("tf").alias("frequency"))
    corpus = v.transcripts.select(c("dataset_id").alias("id"), c("leaf").alias("domain"), "split")
    return A.structural_issues(rows.unionByName(again), references, hits.select(c("dataset_id").alias("case_id"), c("term").alias("keyword")), corpus)


COUNTS = "SELECT {by}, issue, count(*) AS n FROM (SELECT {by}, unnest(list_concat(['units'], CASE WHEN len(issues) > 0 THEN ['units_with_issues'] ELSE [] END, list_distinct(issues))) AS issue FROM {rows}) GROUP BY ALL"


@query("WITH " + ITEMS + " " + COUNTS.format(by="lane", rows="au"))
def a42_structural_audit(v: Views):
    """Issues of suggested keywords against the corpus rows that they cite, by lane."""
    return A.issue_counts(audited_items(v), ["lane"])


_LONGEST = longest_sql(places_sql(TERMS, "b", "body", "id", "a-zA-Z0-9"), "id")


@query("WITH " + ITEMS + f""", b AS (SELECT dataset_id AS id, text AS body, split FROM transcripts), l AS ({_LONGEST}), q AS (SELECT l.id, greatest(0, m.s - {S.BEFORE}) AS s, least(length(body), m.e + {S.AFTER}) AS e, body, split FROM l JOIN b USING (id)),
w AS (SELECT id, split, substr(body, s + 1, e - s) AS quote, s + CASE WHEN id % 9 = 0 THEN 1 ELSE 0 END AS s, e, body FROM q), qi AS (SELECT id AS case_id, list_filter([CASE WHEN split <> 'train' THEN 'invalid_action_reference_row' END, CASE WHEN NOT (s >= 0 AND s < e AND e <= length(body) AND substr(body, s + 1, e - s) = quote AND quote <> '') THEN 'fabricated_or_misaligned_quote' END], lambda x: x IS NOT NULL) AS issues FROM w),
u AS (SELECT case_id, 'keyword' AS kind, issues FROM au UNION ALL SELECT case_id, 'quote', issues FROM qi), z AS (SELECT CASE WHEN case_id % 4 = 0 THEN 'regression' ELSE 'heldout' END AS role, kind, issues FROM u) """ + COUNTS.format(by="role, kind", rows="z"))
def a63_evidence_correctness(v: Views):
    """Issues of keywords and of quotes by the role of their case: what can be checked without a human."""
    found = S.locate_terms(v.transcripts.select(c("dataset_id").alias("id"), c("text").alias("body")), "body", TERMS)
    quotes = found.select(c("id").alias("item"), "id", (c("quote_start") + (c("id") % 9 == 0).cast("long")).alias("start"), c("quote_end").alias("end"), "quote")
    checked = A.quote_issues(quotes, v.transcripts.select(c("dataset_id").alias("id"), "text", "split"))
    units = audited_items(v).select("case_id", F.lit("keyword").alias("kind"), "issues").unionByName(checked.select(c("item").alias("case_id"), F.lit("quote").alias("kind"), "issues"))
    return A.issue_counts(units.withColumn("role", F.when(c("case_id") % 4 == 0, "regression").otherwise("heldout")), ["role", "kind"])
