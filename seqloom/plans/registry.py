"""Named queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Token tables as SQL, for use after WITH.
SQL = {
    "dw": """dw AS (SELECT doc_id AS tablet, lang AS stratum, source, unnest(w) AS tok, generate_subscripts(w, 1) - 1 AS pos
  FROM (SELECT doc_id, lang, source, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS w FROM documents))""",
    "ds": """ds AS (SELECT doc_id AS tablet, lang AS stratum, unnest(w) AS tok, generate_subscripts(w, 1) - 1 AS pos
  FROM (SELECT doc_id, lang, regexp_extract_all(lower(text), '((?:ng|[ghkmnprtv])?[aeiou])', 1) AS w FROM documents))""",
    "ue": """ue AS (SELECT user_id AS tablet, CASE WHEN user_id % 2 = 0 THEN 'pre' ELSE 'post' END AS stratum, event_type AS tok, ts,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)""",
    "cr": """cr AS (SELECT conv_id AS tablet, 'all' AS stratum, role AS tok, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS pos FROM conversations)""",
    "pb": """pb AS (SELECT l_orderkey AS tablet, CASE WHEN year(l_shipdate) < 1998 THEN 'pre' ELSE 'post' END AS stratum, p_brand AS tok, p_type,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS pos FROM lineitem JOIN part ON p_partkey = l_partkey)""",
    # Bigrams of the events.
    "eb": """eb AS (SELECT tok, nxt, count(*) AS f FROM (SELECT tok, lead(tok) OVER (PARTITION BY tablet ORDER BY pos) AS nxt FROM ue) WHERE nxt IS NOT NULL GROUP BY ALL)""",
}


def query(sql: str | None = None, *tables: str) -> Callable:
    """Register a function under its name; tables: names of SQL, put before the SQL as common table expressions."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            rest = sql.strip()
            head = ",\n".join(SQL[t] for t in tables)
            if head:
                rest = f"WITH {head},\n{rest[5:]}" if rest.upper().startswith("WITH ") else f"WITH {head}\n{rest}"
            ORACLES[f.__name__] = rest
        return f

    return add


def h(f: str = "f", base: str = "2") -> str:
    """SQL for the entropy of an aggregated column of counts."""
    return f"(ln(sum({f})::DOUBLE) - sum({f} * ln({f}::DOUBLE)) / sum({f})::DOUBLE) / ln({base}::DOUBLE)"
