"""Terms and topics in texts (F19, F27, F30), found by the automaton of trendloom.operators.spans.

The twins look at every place of a text instead: a term stands where the text from there on begins like it.
"""

from pyspark.sql import functions as F

from trendloom.functions.text import STOPWORDS
from trendloom.operators import spans as S
from trendloom.plans.registry import query
from trendloom.sources.views import Views

c = F.col

#: fixed values: terms that are looked for in whole texts
TERMS = ("license", "mit license", "apache license", "password", "token", "api key", "the license", "thing")

#: fixed values: topics with their aliases, and the words that must or must not stand within 80 characters
CATALOG = [
    {"id": "fastener", "label": "Fasteners", "aliases": [{"text": "bolt"}, {"text": "rod", "exclude_any": ["hot", "cold"]}, {"text": "small ring"}]},
    {"id": "machine", "label": "Machine parts", "aliases": [{"text": "gear", "context_any": ["large", "small", "new"]}, {"text": "widget"}]},
    {"id": "smithing", "label": "Smithing", "aliases": [{"text": "anvil", "context_any": ["hot", "old"], "exclude_any": ["cold"]}]},
    {"id": "licensing", "label": "Licences", "aliases": [{"text": "license", "context_any": ["mit", "apache", "public"]}, {"text": "licensed", "exclude_any": ["apache"]}]},
]
#: fixed values: words that end a phrase, and words of dates
BREAKS = ("vs", "versus", "review", "unboxing")
CALENDAR = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
#: fixed values: a topic's aliases and its context words, in the languages of the texts
TOPIC, CONTEXT = ("thing", "token", "license", "ment", "ung"), ("the", "and", "mit", "les", "und", "token")


def places_sql(terms, rows: str, text: str, keys: str, word: str) -> str:
    """Every place of every term between characters that do not go on with ``word``."""
    names = ", ".join(f"('{t}')" for t in terms)
    return f"""SELECT {keys}, term, p - 1 AS s, p - 1 + length(term) AS e, {text} AS body FROM (SELECT {keys}, {text}, unnest(range(1, length({text}) + 1)) AS p FROM {rows}) x JOIN (VALUES {names}) n(term)
ON lower(substr({text}, p, 1)) = term[1] AND lower(substr({text}, p, length(term))) = term WHERE NOT regexp_matches(substr({text}, p - 1, CASE WHEN p > 1 THEN 1 ELSE 0 END), '^[{word}]') AND NOT regexp_matches(substr({text}, p + length(term), 1), '^[{word}]')"""


def longest_sql(places: str, keys: str) -> str:
    """Of those places, from left to right and longest first, the ones that do not overlap."""
    return f"""SELECT {keys}, unnest(list_reduce(list([{{'s': s, 'e': e, 'term': term}}] ORDER BY s, e DESC), lambda a, x: CASE WHEN x[1].s >= a[-1].e THEN a || x ELSE a END)) AS m FROM ({places}) GROUP BY {keys}"""


TEXTS = "(SELECT 'text' AS origin, dataset_id AS id, CAST(NULL AS BIGINT) AS segment_index, text AS body FROM transcripts UNION ALL SELECT 'segment', conv_id, segment_index, text FROM segments)"


def texts(v: Views):
    """Whole texts and timed segments under one form."""
    whole = v.transcripts.select(F.lit("text").alias("origin"), c("dataset_id").alias("id"), F.lit(None).cast("long").alias("segment_index"), c("text").alias("body"))
    return whole.unionByName(v.segments.select(F.lit("segment").alias("origin"), c("conv_id").alias("id"), "segment_index", c("text").alias("body")))


@query(f"""WITH b AS {TEXTS}, l AS ({longest_sql(places_sql(TERMS, 'b', 'body', 'origin, id, segment_index', 'a-zA-Z0-9'), 'origin, id, segment_index')})
SELECT l.origin, l.id, l.segment_index, m.term AS term, m.s AS start_char, m.e AS end_char, substr(body, m.s + 1, m.e - m.s) AS matched, substr(body, greatest(0, m.s - {S.BEFORE}) + 1, least(length(body), m.e + {S.AFTER}) - greatest(0, m.s - {S.BEFORE})) AS quote,
greatest(0, m.s - {S.BEFORE}) AS quote_start, least(length(body), m.e + {S.AFTER}) AS quote_end, l.segment_index * 10 AS start_seconds, l.segment_index * 10 + 10 AS end_seconds
FROM l JOIN b ON l.origin = b.origin AND l.id = b.id AND l.segment_index IS NOT DISTINCT FROM b.segment_index""")
def f19_locate_terms(v: Views):
    """Spans of terms in whole texts and timed segments, longest first, each with its quote and, in a segment, its time."""
    return S.locate_terms(texts(v), "body", TERMS).select("*", (c("segment_index") * 10).alias("start_seconds"), (c("segment_index") * 10 + 10).alias("end_seconds"))


_ALIASES = [(t["id"], a["text"], a.get("context_any", []), a.get("exclude_any", [])) for t in CATALOG for a in t["aliases"]]
_VALUES = ", ".join(f"('{t}', '{a}', {need!r}::VARCHAR[], '{'|'.join(ex)}')" for t, a, need, ex in _ALIASES)
_PHRASES = sorted({a for _, a, _, _ in _ALIASES} | {p for _, _, need, _ in _ALIASES for p in need})
TITLED = "(SELECT 'title' AS origin, p_partkey AS id, p_name AS body FROM part UNION ALL SELECT 'text', dataset_id, text FROM transcripts)"


@query(f"""WITH b AS {TITLED}, m AS MATERIALIZED ({places_sql(_PHRASES, 'b', 'body', 'origin, id', 'a-zA-Z0-9_')}), al(topic_id, alias, need, exclude) AS (VALUES {_VALUES}),
k AS (SELECT m.origin, m.id, topic_id, alias, need, exclude, m.s, m.e, any_value(m.body) AS body, count(DISTINCT (n.s, n.e)) FILTER (n.s >= greatest(0, m.s - 80) AND n.e <= least(length(m.body), m.e + 80)) AS contexts
 FROM m JOIN al ON m.term = alias LEFT JOIN m n ON n.origin = m.origin AND n.id = m.id AND list_contains(need, n.term) GROUP BY ALL),
t AS (SELECT origin, id, topic_id AS name, 'topic' AS kind, alias, s AS start_char, e AS end_char, substr(body, s + 1, e - s) AS matched, CASE WHEN len(need) > 0 THEN contexts ELSE 0 END AS contexts FROM k
 WHERE (len(need) = 0 OR contexts > 0) AND (exclude = '' OR NOT regexp_matches(lower(substr(body, greatest(0, s - 80) + 1, least(length(body), e + 80) - greatest(0, s - 80))), '(^|[^a-z0-9_])(' || exclude || ')($|[^a-z0-9_])'))),
w AS (SELECT p_partkey AS id, p_name, string_split(p_name, ' ') AS ws FROM part), o AS (SELECT id, p_name, ws, unnest(range(1, len(ws) + 1)) AS i, len(ws) AS n FROM w), q AS (SELECT id, p_name, ws, i, unnest(range(i, n + 1)) AS j FROM o),
d AS (SELECT id, array_to_string(ws[i:j], ' ') AS name, CASE WHEN j > i THEN 'phrase' ELSE 'word' END AS kind, length(array_to_string(ws[1:i - 1], ' ')) + CASE WHEN i > 1 THEN 1 ELSE 0 END AS start_char FROM q
 WHERE array_to_string(ws[i:j], ' ') NOT IN (SELECT alias FROM al) AND ws[i] NOT IN {STOPWORDS} AND ws[j] NOT IN {STOPWORDS})
SELECT * FROM t UNION ALL SELECT 'title', id, name, kind, NULL, start_char, start_char + length(name), name, 0 FROM d QUALIFY row_number() OVER (PARTITION BY id, name ORDER BY start_char) = 1""")
def f27_title_topics(v: Views):
    """Known topics in titles and whole texts, where their context allows it; candidate phrases of titles."""
    titles = v.table("part").select(F.lit("title").alias("origin"), c("p_partkey").alias("id"), c("p_name").alias("body"))
    whole = v.transcripts.select(F.lit("text").alias("origin"), c("dataset_id").alias("id"), c("text").alias("body"))
    known = S.topic_spans(titles.unionByName(whole), "body", CATALOG).select("origin", "id", c("topic_id").alias("name"), F.lit("topic").alias("kind"), "alias", "start_char", "end_char", "matched", "contexts")
    offered = S.candidate_phrases(titles, "body", CATALOG, STOPWORDS, BREAKS, CALENDAR)
    return known.unionByName(
        offered.select("origin", "id", c("phrase").alias("name"), "kind", F.lit(None).cast("string").alias("alias"), "start_char", "end_char", c("phrase").alias("matched"), F.lit(0).cast("long").alias("contexts"))
    )


_NEAR = tuple(t for t in CONTEXT if t not in TOPIC)


@query(f"""WITH b AS {TEXTS}, lt AS ({longest_sql(places_sql(TOPIC, 'b', 'body', 'origin, id, segment_index', 'a-zA-Z0-9'), 'origin, id, segment_index')}),
lc AS ({longest_sql(places_sql(_NEAR, 'b', 'body', 'origin, id, segment_index', 'a-zA-Z0-9'), 'origin, id, segment_index')}),
x AS (SELECT b.*, (SELECT list(m) FROM lt WHERE lt.origin = b.origin AND lt.id = b.id AND lt.segment_index IS NOT DISTINCT FROM b.segment_index) AS ts, (SELECT list(m) FROM lc WHERE lc.origin = b.origin AND lc.id = b.id AND lc.segment_index IS NOT DISTINCT FROM b.segment_index) AS cs FROM b),
y AS (SELECT origin, id, coalesce(len(ts), 0) AS nt, coalesce(len(cs), 0) AS nc, CASE WHEN coalesce(len(ts), 0) = 0 OR coalesce(len(cs), 0) = 0 THEN false WHEN origin = 'segment' THEN true ELSE len(list_filter(ts, lambda t: len(list_filter(cs, lambda k:
 greatest(t.e, k.e) - least(t.s, k.s) <= {S.SENTENCE} AND NOT regexp_matches(substr(body, least(t.s, k.s) + 1, greatest(t.e, k.e) - least(t.s, k.s)), '[.!?\\n。！？]'))) > 0)) > 0 END AS same FROM x),
g AS (SELECT origin, id, CAST(sum(nt) AS BIGINT) AS topic_hits, CAST(sum(nc) AS BIGINT) AS context_hits, bool_or(same) AS same FROM y GROUP BY 1, 2)
SELECT origin, id, topic_hits, context_hits, CASE WHEN topic_hits = 0 THEN 'unclear' WHEN same THEN 'context_present' ELSE 'keyword_only' END AS status,
CASE WHEN topic_hits = 0 THEN 'topic_not_detected' WHEN same THEN 'same_segment_or_sentence' WHEN context_hits = 0 THEN 'no_nearby_context_evidence' ELSE 'context_found_elsewhere' END AS reason FROM g""")
def f30_topic_context(v: Views):
    """Whether a topic stands with its context: in one timed segment of a conversation, or in one sentence of a text."""
    rows = texts(v).withColumn("timed", c("segment_index").isNotNull())
    return S.context_status(S.context_rows(rows, "body", list(TOPIC), list(CONTEXT), "timed"), ["origin", "id"])
