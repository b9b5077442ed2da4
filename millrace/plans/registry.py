"""All registered queries and their DuckDB SQL."""

from __future__ import annotations

import re

QUERIES: dict = {}
SQL: dict = {}

#: DuckDB SQL of the views that queries share; millrace.plans.views has the same in Spark.
VIEWS = {
    "v_items": """SELECT event_type AS source, user_id || '-' || json_extract_string(props, '$.k') AS id,
        event_type || ' ' || props AS title, user_id, value, epoch_us(ts) AS us, event_id AS ord FROM events""",
    "v_runs": """SELECT event_id AS run, event_type AS name, value > 50 AS ok, value / 10 AS seconds,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS organic, 1 + user_id % 4 AS attempts FROM events""",
    "v_log": "SELECT event_id AS line, user_id AS worker, event_type AS bucket, epoch_us(ts) / 1000000.0::DOUBLE AS t, value FROM events",
    "v_gigs": """SELECT l_orderkey * 10 + l_linenumber AS id, CAST(round(l_extendedprice) AS BIGINT) AS price, p_brand AS leaf, p_type AS parent,
        l_suppkey AS seller, CAST(l_quantity * 6 AS BIGINT) - 6 AS reviews, p_name AS gtitle, l_returnflag AS level
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "v_orgs": """SELECT c_custkey AS oid, c_name AS title, c_mktsegment AS category, c_nationkey AS nation,
        59.914403 + ((c_custkey * 7919) % 601 - 300) * 1e-4 AS lat, 30.327319 + ((c_custkey * 104729) % 1201 - 600) * 1e-4 AS lon FROM customer""",
    "v_org_dist": f"""SELECT *, 2 * 6371000 * asin(sqrt(pow(sin(radians(lat - 59.914403) / 2), 2)
        + cos(radians(59.914403)) * cos(radians(lat)) * pow(sin(radians(lon - 30.327319) / 2), 2))) AS dist FROM v_orgs""",
    "v_sightings": """SELECT l_orderkey * 10 + l_linenumber AS sid, l_orderkey % 9 - 4 AS i, l_partkey % 9 - 4 AS j, o_custkey AS oid,
        l_linenumber * 5 AS rank, c_mktsegment AS category FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    "v_cards": """SELECT d.doc_id AS oid, d.source AS zone, d.text, d.n_chars, l.quality AS score, l.toxic,
        len(regexp_extract_all(d.text, '[\\p{L}\\p{N}._+-]+@[\\p{L}\\p{N}-]+\\.[\\p{L}\\p{N}.-]+')) AS emails,
        len(regexp_extract_all(d.text, '\\+?[0-9][0-9() -]{8,}[0-9]')) AS phones,
        len(regexp_extract_all(d.text, 'https?://[^ \\n]+')) AS links
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "v_arms": """SELECT l_partkey AS key, l_returnflag AS arm, CAST(round(sum(l_quantity)) AS BIGINT) AS m1, CAST(count(*) AS BIGINT) AS m2,
        CAST(round(sum(l_tax * 100)) AS BIGINT) AS m3 FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL""",
    "v_turns": "SELECT conv_id AS run, turn, role AS kind, text, substr(sha256(coalesce(text, '')), 1, 1) AS host FROM conversations",
    "v_pages": """SELECT page_id, url, html, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www\\.', ''), '^m\\.', '') AS domain
        FROM pages""",
    "v_text": "SELECT 'd' || doc_id AS key, text FROM documents UNION ALL SELECT 'c' || c_custkey, c_name FROM customer UNION ALL SELECT 'p' || p_partkey, p_name FROM part",
}


def expanded(sql: str) -> str:
    """Put the definitions of the views that sql names in front of it."""
    names: list[str] = []

    def need(text: str) -> None:
        for v in VIEWS:
            if re.search(rf"\b{v}\b", text) and v not in names:
                need(VIEWS[v])
                names.append(v)

    need(sql)
    if not names:
        return sql
    heads = ", ".join(f"{v} AS ({VIEWS[v]})" for v in names)
    body = sql.strip()
    return f"WITH {heads}, {body[4:]}" if body[:5].upper() in ("WITH ", "WITH\n") else f"WITH {heads} {body}"


def query(sql: str | None = None):
    """Register a query under its function's name, with its DuckDB SQL where SQL can express it."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = expanded(sql)
        return f

    return register


def load() -> None:
    """Import the modules that register queries."""
    from millrace.plans import agents, catalog, monitoring, research, spatial, telemetry, texts  # noqa: F401


load()
