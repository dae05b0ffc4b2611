"""Canonical tables derived from the event, conversation, document and page tables.

The expressions read alike in Spark SQL and DuckDB, so that queries over these views can be compared between both. Each view
is one SELECT over the base tables or over earlier views.
"""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoolsight.corpus import Corpus, schema
from spoolsight.operators.pricing import RateBook, rates_from_json

K = "TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
AGENT = "concat('agent-', CAST(user_id % 5 AS VARCHAR(9)))"
SESSION = "concat('s', CAST(user_id AS VARCHAR(20)), '-', CAST(CAST(ts AS DATE) AS VARCHAR(10)))"

VIEWS: dict[str, str] = {
    "ev": f"""SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type, value, {K} AS k, {AGENT} AS agent, {SESSION} AS session_id FROM events""",
    "v_sessions": """SELECT agent, session_id, concat('Work on ', max(event_type)) AS title, min(ts) AS created_at, max(ts) AS modified_at,
        concat('/home/u', CAST(max(user_id) % 7 AS VARCHAR(9)), '/proj') AS cwd, concat('/home/u', CAST(max(user_id) % 7 AS VARCHAR(9)), '/proj') AS workspace,
        '' AS repo_root, 'main' AS git_branch, 'ingest' AS origin, concat('/logs/', session_id, '.jsonl') AS source_path
        FROM ev GROUP BY agent, session_id""",
    "v_messages": """SELECT agent, session_id, event_id AS seq, concat('m', CAST(event_id AS VARCHAR(20))) AS external_id,
        CASE WHEN event_id % 5 = 0 THEN '' ELSE concat('c', CAST(event_id % 400 AS VARCHAR(9))) END AS content_id,
        CASE event_id % 3 WHEN 0 THEN 'user' ELSE 'assistant' END AS role, 'message' AS kind, ts AS created_at,
        CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'alpha' ELSE 'beta' END AS provider,
        CASE event_id % 4 WHEN 0 THEN 'm-large' WHEN 1 THEN 'm-small' WHEN 2 THEN 'm-nocache' ELSE 'm-unknown' END AS model,
        concat(event_type, ' number ', CAST(event_id AS VARCHAR(20))) AS text,
        CASE event_id % 6 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE '' END AS effort FROM ev""",
    "v_usage": """SELECT agent, session_id, event_id AS seq, CASE WHEN event_id % 5 = 0 THEN '' ELSE concat('c', CAST(event_id % 400 AS VARCHAR(9))) END AS content_id,
        concat('r', CAST(event_id % 3 AS VARCHAR(9))) AS request_id, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'alpha' ELSE 'beta' END AS provider,
        CASE event_id % 4 WHEN 0 THEN 'm-large' WHEN 1 THEN 'm-small' WHEN 2 THEN 'm-nocache' ELSE 'm-unknown' END AS model,
        CASE WHEN event_id % 97 = 0 THEN NULL ELSE ts END AS created_at,
        100 + (event_id * 37) % 5000 AS input, (event_id * 13) % 900 AS output, ((event_id * 101) % 20000) * (event_id % 3) AS cache_read,
        (event_id * 7) % 1000 AS cache_write, (event_id * 7) % 1000 - (event_id * 3) % 400 AS cache_write_1h,
        CASE event_type WHEN 'purchase' THEN CAST(floor(value * 100 + 0.5) AS BIGINT) * 10000 WHEN 'signup' THEN 0 END AS reported_nanos, 1 AS parser_version FROM ev""",
    "v_tool_calls": """SELECT agent, session_id, event_id AS seq, event_id AS message_seq, concat('call', CAST(event_id AS VARCHAR(20))) AS call_id,
        CASE event_type WHEN 'click' THEN 'Bash' WHEN 'view' THEN 'Read' WHEN 'purchase' THEN 'Edit' WHEN 'signup' THEN 'WebFetch' ELSE 'Grep' END AS name,
        CASE event_type WHEN 'click' THEN 'shell' WHEN 'view' THEN 'file_read' WHEN 'purchase' THEN 'file_edit' WHEN 'signup' THEN 'web' ELSE 'search' END AS kind,
        CASE event_type WHEN 'error' THEN 'error' ELSE 'ok' END AS status,
        CASE event_type WHEN 'purchase' THEN concat(CASE WHEN event_id % 2 = 0 THEN '/abs/' ELSE '' END, 'f', CAST(event_id % 50 AS VARCHAR(9)), '.py') ELSE '' END AS file_path,
        CASE WHEN event_type = 'click' AND event_id % 10 <> 0 THEN concat('make target', CAST(event_id % 20 AS VARCHAR(9))) ELSE '' END AS command,
        ts AS started_at, CASE WHEN k > 0 THEN CAST(k * 10 AS BIGINT) END AS duration_ms,
        CASE event_type WHEN 'purchase' THEN event_id % 40 END AS lines_added, CASE event_type WHEN 'purchase' THEN event_id % 17 END AS lines_removed FROM ev""",
    "v_session_events": """SELECT agent, session_id, event_id AS message_seq,
        CASE event_type WHEN 'error' THEN 'api_error' WHEN 'signup' THEN 'compaction' WHEN 'click' THEN 'hook' WHEN 'view' THEN 'turn' ELSE 'pr_link' END AS kind, ts AS at,
        concat('label', CAST(event_id % 4 AS VARCHAR(9))) AS label, CASE event_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'error' ELSE 'blocked' END AS status,
        CAST(k * 5 AS BIGINT) AS duration_ms, concat('https://git.example/pr/', CAST(event_id % 30 AS VARCHAR(9))) AS detail,
        concat('{"preTokens": ', CAST(k * 1000 AS VARCHAR(20)), '}') AS payload FROM ev""",
    "v_relations": """SELECT 'conv' AS agent, concat('c', CAST(conv_id AS VARCHAR(20))) AS from_id, concat('c', CAST(conv_id // 2 AS VARCHAR(20))) AS to_id, 'subagent_of' AS kind,
        '{"agentType": "helper"}' AS evidence, TRUE AS resolved, 0 AS attempts FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id > 0""",
    "v_conv_messages": """SELECT 'conv' AS agent, concat('c', CAST(conv_id AS VARCHAR(20))) AS session_id, turn AS seq, role, 'message' AS kind, text FROM conversations""",
    "v_artifacts": """SELECT 'docs' AS agent, CASE doc_id % 3 WHEN 0 THEN 'plan' WHEN 1 THEN 'memory' ELSE 'file_history' END AS kind,
        concat('doc', CAST(doc_id AS VARCHAR(20))) AS name, coalesce(text, '') AS content, source AS source_path FROM documents""",
}

RATES_JSON = """{
 "models": {
  "m-large": {"input": 0.000003, "output": 0.000015, "cache_write": 0.00000375, "cache_write_1h": 0.000006, "cache_read": 0.0000003,
    "tiers": [{"above_input_tokens": 20000, "input": 0.000006, "output": 0.0000225}, {"above_input_tokens": 30000, "cache_read": 0.0000006}]},
  "m-small": {"input": 0.0000008, "output": 0.000004, "cache_write": 0.000001, "cache_read": 0.00000008},
  "alpha/m-small": {"input": 0.0000007, "output": 0.0000035, "cache_write": 0.0000009, "cache_write_1h": 0.0000012, "cache_read": 0.00000007},
  "m-nocache": {"input": 0.000000123457, "output": 0.00000098765}
 },
 "history": {
  "m-nocache": [
    {"effective_from": "2024-01-05", "effective_to": "2024-01-15", "source": "card one", "rate": {"input": 0.0000002, "output": 0.000001, "cache_read": 0.00000002}},
    {"effective_from": "2024-01-12", "effective_to": "2024-01-20", "source": "card two", "rate": {"input": 0.0000003, "output": 0.0000015}}
  ]}
}"""
#: The same rates as bands, for SQL: model, provider (null: any other), dated (null: either), from, to, lo, hi, picodollars.
RATE_BANDS_SQL = """bands(model, provider, dated, valid_from, valid_to, lo, hi, pi, po, pw, pw1, pr) AS (VALUES
  ('m-large', NULL, NULL, NULL, NULL, -1, 20000, 3000000, 15000000, 3750000, 6000000, 300000),
  ('m-large', NULL, NULL, NULL, NULL, 20000, 30000, 6000000, 22500000, 3750000, 6000000, 300000),
  ('m-large', NULL, NULL, NULL, NULL, 30000, 9000000000, 6000000, 22500000, 3750000, 6000000, 600000),
  ('m-small', 'other', NULL, NULL, NULL, -1, 9000000000, 800000, 4000000, 1000000, NULL, 80000),
  ('m-small', 'alpha', NULL, NULL, NULL, -1, 9000000000, 700000, 3500000, 900000, 1200000, 70000),
  ('m-nocache', NULL, FALSE, NULL, NULL, -1, 9000000000, 123457, 987650, NULL, NULL, NULL),
  ('m-nocache', NULL, TRUE, TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-12', -1, 9000000000, 200000, 1000000, NULL, NULL, 20000),
  ('m-nocache', NULL, TRUE, TIMESTAMP '2024-01-12', TIMESTAMP '2024-01-20', -1, 9000000000, 300000, 1500000, NULL, NULL, NULL))"""


def view_sql(*names: str) -> str:
    """CTE list of the named views and of those that they need, for DuckDB."""
    needed: list[str] = []

    def add(name: str) -> None:
        for other in VIEWS:
            if other != name and re.search(rf"\b(FROM|JOIN) {other}\b", VIEWS[name]):
                add(other)
        if name not in needed:
            needed.append(name)

    for n in names:
        add(n)
    return ",\n".join(f"{n} AS ({VIEWS[n]})" for n in needed)


def view(spark: SparkSession, sf_dir: str, name: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """One view over the tables of ``sf_dir``. ``tables`` keeps those that were read already."""
    tables = {} if tables is None else tables
    sql = VIEWS[name].replace("//", "div") if "conv_id //" in VIEWS[name] else VIEWS[name]
    bases = [t for t in ("events", "conversations", "documents", "ev") if re.search(rf"\b(FROM|JOIN) {t}\b", sql)]
    for t in bases:
        if t not in tables:
            tables[t] = view(spark, sf_dir, t, tables) if t in VIEWS else spark.read.parquet(f"{sf_dir}/{t}.parquet")
    sql = sql.replace("{", "{{").replace("}", "}}")
    for t in bases:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: tables[t] for t in bases})


def _typed(df: DataFrame, table: str) -> DataFrame:
    fields = schema(table).fields
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))


def driver_rates(spark: SparkSession) -> RateBook:
    return rates_from_json(spark, RATES_JSON)


def driver_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """Corpus over the views. Only tables that an operation uses are made, and each base table's schema is read once."""
    read: dict[str, DataFrame] = {}
    names = ("sessions", "messages", "usage", "tool_calls", "session_events", "relations", "artifacts")
    return Corpus(spark, rates=driver_rates(spark), **{n: partial(lambda n: _typed(view(spark, sf_dir, f"v_{n}", read), n), n) for n in names})
