"""All registered queries and their SQL twins."""

from __future__ import annotations

import importlib
import pkgutil

from trendloom import plans
from trendloom.sources.views import Views

_QUERIES: dict = {}
_SQL: dict[str, str] = {}

# The views of trendloom.sources.views in SQL, for the twins.
_BUCKET = "(('0x' || substr(sha256('split-v1|' || {}), 1, 8))::BIGINT % {})"
STOP_SQL = "'the','and','of','to','in','is','for','that','der','die','das','und','les','des','que','los','las','con'"
VIEWS = {
    "content": """SELECT p_partkey AS dataset_id, p_name AS title, p_brand AS channel, p_type AS leaf, CAST(p_size AS BIGINT) AS duration,
        CAST(floor(sum(CAST(l_extendedprice AS DECIMAL(18,2)))) AS BIGINT) AS views, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS likes,
        count(*) AS comments, min(l_shipdate) AS published, max(l_shipdate) AS captured,
        CASE WHEN max(l_shipdate) < TIMESTAMP '2001-08-15' THEN 'v1' ELSE 'v2' END AS metric_version, CASE WHEN p_size <= 25 THEN 'short' ELSE 'long' END AS format
        FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey, p_name, p_brand, p_type, p_size""",
    "items": """SELECT platform, run_at, key, CAST(score AS DOUBLE) AS score, views, row_number() OVER (PARTITION BY platform, run_at ORDER BY score DESC, key) AS rank
        FROM (SELECT event_type AS platform, date_trunc('day', ts)::TIMESTAMP AS run_at, user_id AS key, sum(CAST(value AS DECIMAL(18,2))) AS score, count(*) AS views FROM events GROUP BY 1, 2, 3)""",
    "runs": """SELECT platform, run_at, count(*) AS n_items, CASE WHEN any_value(failed) THEN 'failed' ELSE 'ok' END AS status FROM items
        JOIN (SELECT date_trunc('day', ts)::TIMESTAMP AS run_at, count(*) FILTER (event_type = 'error') * 5 > count(*) AS failed FROM events GROUP BY 1) USING (run_at) GROUP BY 1, 2""",
    "observations": """SELECT event_id AS obs_id, user_id AS entity, ts, epoch_us(ts) AS us, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'complete' END AS status,
        CASE WHEN event_type <> 'error' THEN count(*) FILTER (event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) END AS views,
        CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'v1' ELSE 'v2' END AS metric_version, CAST(floor(value) AS BIGINT) AS counter FROM events""",
    "transcripts": f"""SELECT d.doc_id AS dataset_id, text, source AS channel, lang AS leaf, n_chars, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic,
        CASE WHEN {_BUCKET.format('source', 100)} < 70 THEN 'train' WHEN {_BUCKET.format('source', 100)} < 85 THEN 'validation' ELSE 'test' END AS split
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "terms": f"""SELECT dataset_id, channel, leaf, term, count(*) AS tf FROM (SELECT dataset_id, channel, leaf, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}]+')) AS term FROM transcripts)
        WHERE length(term) > 1 AND term NOT IN ({STOP_SQL}) AND NOT regexp_full_match(term, '[0-9]+') GROUP BY 1, 2, 3, 4""",
    "topics": "SELECT topic_id, count(*) AS n_titles FROM (SELECT unnest(string_split(p_name, ' ')) AS topic_id FROM part) GROUP BY 1",
    "vectors": "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec, CAST(label AS BIGINT) AS label FROM embeddings",
    "segments": "SELECT conv_id, turn AS segment_index, role, text, turn * 10 AS start, turn * 10 + 10 AS \"end\" FROM conversations",
    "customers": "SELECT c_custkey AS user_id, c_name AS name, CAST(c_nationkey AS BIGINT) AS region, c_acctbal AS balance, c_mktsegment AS role FROM customer",
    "analyses": "SELECT o_orderkey AS analysis_id, o_custkey AS user_id, o_orderstatus AS status, o_totalprice AS score, o_orderdate AS created_at, o_orderpriority AS priority FROM orders",
}
_NEEDS = {"runs": ["items"], "terms": ["transcripts"]}


def bucket_sql(value: str, modulus: int) -> str:
    return _BUCKET.format(value, modulus)


def with_views(sql: str) -> str:
    """``sql`` with the views it names as common table expressions in front."""
    import re

    used: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in used:
            used.append(name)

    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            add(name)
    views = ", ".join(f"{name} AS ({VIEWS[name]})" for name in used)
    if not views:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {views}, {body[5:]}"
    return f"WITH {views} {body}"


def query(sql: str | None = None):
    """Register a function of the views under its name, with its SQL twin if it has one."""

    def add(f):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            _SQL[f.__name__] = with_views(sql)
        return f

    return add


def _load() -> None:
    for module in pkgutil.iter_modules(plans.__path__):
        importlib.import_module(f"trendloom.plans.{module.name}")


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
