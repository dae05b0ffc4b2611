"""Registered queries over the canonical views, each with the SQL that it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spoolsight.corpus import Corpus
from spoolsight.functions import scalars as Z
from spoolsight.operators import activity as A
from spoolsight.operators import archive as K
from spoolsight.operators import links as L
from spoolsight.operators import pricing as P
from spoolsight.operators import scan as C
from spoolsight.operators import search as X
from spoolsight.operators import sessions as S
from spoolsight.operators import usage as U
from spoolsight.plans import driver_views as V
from spoolsight.shared import new_folder
from spoolsight.sources import claude, shared
from spoolsight.sources.lines import split_lines
from spoolsight.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL if it has one."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


#: Owned and priced usage in SQL; what ``operators.usage.priced_usage`` computes.
OWNED = f"""{V.view_sql("v_usage", "v_sessions")}, {V.RATE_BANDS_SQL},
owned AS (SELECT * FROM (SELECT u.*, s.workspace, s.created_at AS session_created_at, row_number() OVER (PARTITION BY u.agent, CASE WHEN u.content_id = '' THEN concat('#', CAST(u.seq AS VARCHAR)) ELSE u.content_id END, u.request_id
    ORDER BY s.modified_at, s.created_at, u.session_id, u.seq) AS rn FROM v_usage u JOIN v_sessions s ON u.agent = s.agent AND u.session_id = s.session_id) WHERE rn = 1),
matched AS (SELECT o.*, b.model IS NOT NULL AS known, pi, po, pw, pw1, pr, greatest(least(o.cache_write_1h, o.cache_write), 0) AS w1,
    o.input + o.output + o.cache_read + o.cache_write AS total_tokens,
    o.reported_nanos IS NOT NULL AND (o.reported_nanos <> 0 OR o.input + o.output + o.cache_read + o.cache_write = 0) AS rep
    FROM owned o LEFT JOIN bands b ON o.model = b.model AND (b.provider IS NULL OR b.provider = CASE WHEN o.provider = 'alpha' THEN 'alpha' ELSE 'other' END)
    AND (b.dated IS NULL OR b.dated = (o.created_at IS NOT NULL)) AND (b.valid_from IS NULL OR o.created_at >= b.valid_from) AND (b.valid_to IS NULL OR o.created_at < b.valid_to)
    AND o.input + o.cache_read + o.cache_write > b.lo AND o.input + o.cache_read + o.cache_write <= b.hi),
priced AS (SELECT *, CASE WHEN rep THEN reported_nanos ELSE 0 END AS reported_cost_nanos,
    CASE WHEN rep OR NOT known OR total_tokens = 0 THEN 0 ELSE CAST((CAST(input AS HUGEINT) * pi + CAST(output AS HUGEINT) * po + coalesce(CAST(cache_read AS HUGEINT) * pr, 0)
      + coalesce(CAST(cache_write - w1 AS HUGEINT) * pw, 0) + coalesce(CAST(w1 AS HUGEINT) * pw1, 0) + 500) // 1000 AS BIGINT) END AS estimated_nanos,
    CASE WHEN NOT rep AND NOT known THEN input ELSE 0 END AS unpriced_input, CASE WHEN NOT rep AND NOT known THEN output ELSE 0 END AS unpriced_output,
    CASE WHEN NOT rep AND pr IS NULL THEN cache_read ELSE 0 END AS unpriced_cache_read,
    CASE WHEN NOT rep AND pw IS NULL THEN cache_write - w1 ELSE 0 END + CASE WHEN NOT rep AND pw1 IS NULL THEN w1 ELSE 0 END AS unpriced_cache_write,
    coalesce(strftime(coalesce(created_at, session_created_at), '%Y-%m-%d'), '') AS day FROM matched)"""
SUMS = """CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write,
  CAST(sum(cache_write_1h) AS BIGINT) AS cache_write_1h, CAST(sum(unpriced_input) AS BIGINT) AS unpriced_input, CAST(sum(unpriced_output) AS BIGINT) AS unpriced_output,
  CAST(sum(unpriced_cache_read) AS BIGINT) AS unpriced_cache_read, CAST(sum(unpriced_cache_write) AS BIGINT) AS unpriced_cache_write,
  CAST(sum(reported_cost_nanos + estimated_nanos) AS BIGINT) AS cost_nanos, CAST(sum(reported_cost_nanos) AS BIGINT) AS reported_nanos, CAST(sum(estimated_nanos) AS BIGINT) AS estimated_nanos"""
PRICED_FLAG = "sum(unpriced_input + unpriced_output + unpriced_cache_read + unpriced_cache_write) = 0 AS priced"


def _usage(group: str, key: str) -> None:
    @query(f"usage_by_{group}", f"""WITH {OWNED} SELECT {key} AS "group", {SUMS}, count(*) AS requests, {PRICED_FLAG}, count(DISTINCT (agent, session_id)) AS sessions FROM priced GROUP BY 1""")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return U.usage(V.driver_corpus(spark, sf_dir), group)


for _group, _key in U.GROUPS.items():
    _usage(_group, _key)


def shown(df: DataFrame) -> DataFrame:
    """Times as text, for comparison across engines."""
    return df.withColumns({f.name: F.date_format(f.name, "yyyy-MM-dd HH:mm:ss") for f in df.schema.fields if f.dataType.simpleString() == "timestamp"})


def corpus(f: Callable[[Corpus], DataFrame]) -> Query:
    return lambda spark, sf_dir: shown(f(V.driver_corpus(spark, sf_dir)))


T = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
AT = T.format


def with_views(*names: str) -> str:
    return "WITH " + V.view_sql(*names) + " "


# -- cost and rollups
query("priced_usage", f"""WITH {OWNED} SELECT agent, session_id, seq, provider, model, workspace, total_tokens, reported_cost_nanos, estimated_nanos, reported_cost_nanos + estimated_nanos AS amount_nanos,
  unpriced_input, unpriced_output, unpriced_cache_read, unpriced_cache_write FROM priced""")(
    corpus(lambda c: U.priced_usage(c).select("agent", "session_id", "seq", "provider", "model", "workspace", "total_tokens", "reported_cost_nanos", "estimated_nanos", "amount_nanos", "unpriced_input", "unpriced_output", "unpriced_cache_read", "unpriced_cache_write"))
)
DAILY = f"SELECT day, agent, workspace, model, {SUMS}, count(*) AS requests, {PRICED_FLAG} FROM priced GROUP BY ALL"
query("rollup_usage_daily", f"WITH {OWNED} {DAILY}")(corpus(lambda c: U.build_rollups(U.priced_usage(c))[0]))
query("rollup_session_days", f"WITH {OWNED} SELECT DISTINCT day, agent, workspace, model, session_id FROM priced")(corpus(lambda c: U.build_rollups(U.priced_usage(c))[1]))


@query("refresh_rollups", f"WITH {OWNED} {DAILY}")
def _refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollups of the priced usage without some sessions, brought up to date for these sessions."""
    priced = U.priced_usage(V.driver_corpus(spark, sf_dir))
    dirty = priced.where(F.col("session_id").endswith("7")).select("agent", "session_id").distinct()
    old = U.build_rollups(priced.join(dirty, ["agent", "session_id"], "left_anti"))
    return U.refresh_rollups(old, priced, dirty)[0]


query("usage_pivot", f"""WITH {OWNED} SELECT day, {", ".join(f"CAST(sum(CASE WHEN agent = 'agent-{k}' THEN reported_cost_nanos + estimated_nanos ELSE 0 END) AS BIGINT) AS \"agent-{k}\"" for k in range(5))},
  sum(unpriced_input + unpriced_output + unpriced_cache_read + unpriced_cache_write) > 0 AS incomplete FROM priced GROUP BY day""")(corpus(lambda c: U.usage_pivot(c, "agent", [f"agent-{k}" for k in range(5)])))
query("blocks", f"""WITH {OWNED}, anchor AS (SELECT CAST(epoch(CAST(max(day) AS TIMESTAMP)) AS BIGINT) + 86400 AS a FROM priced),
  w AS (SELECT *, CAST(floor(epoch(created_at)) AS BIGINT) // 18000 AS win FROM priced WHERE created_at IS NOT NULL)
  SELECT strftime(make_timestamp(win * 18000000000), '%Y-%m-%d %H:%M:%S') AS start, strftime(make_timestamp((win + 1) * 18000000000), '%Y-%m-%d %H:%M:%S') AS "end", {SUMS},
  count(DISTINCT (agent, session_id)) AS sessions, count(*) AS requests, win * 18000 <= epoch(TIMESTAMP '2024-01-30 12:00:00') AND epoch(TIMESTAMP '2024-01-30 12:00:00') < (win + 1) * 18000 AS active
  FROM w, anchor WHERE win >= a // 18000 - 24 GROUP BY win ORDER BY win DESC LIMIT 24""")(corpus(lambda c: U.blocks(c, as_of="2024-01-30 12:00:00")))
_EFFORT = f"""WITH {OWNED.replace("%", "%%")}, m AS (SELECT agent, session_id, event_id AS seq, CASE event_id %% 6 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE '' END AS level FROM ev WHERE event_id %% 3 <> 0)
  SELECT %s level, count(*) AS requests, {SUMS} FROM priced JOIN m USING (agent, session_id, seq) GROUP BY ALL"""
query("effort_by_level", _EFFORT % "")(corpus(lambda c: U.effort(c)))
query("effort_by_agent", _EFFORT % 'agent AS "group",')(corpus(lambda c: U.effort(c, "agent")))
query("effort_by_day", _EFFORT % "coalesce(strftime(created_at, '%Y-%m-%d'), '') AS \"group\",")(corpus(lambda c: U.effort(c, "day")))


@query("richest_claims", f"""{with_views("v_usage")}, seen AS (SELECT *, CASE WHEN seq % 2 = 0 THEN 1 ELSE 2 END AS version FROM v_usage WHERE content_id <> ''),
  best AS (SELECT *, row_number() OVER (PARTITION BY agent, content_id, request_id ORDER BY version DESC, output DESC, input + output + cache_read + cache_write DESC, seq DESC) AS rn FROM seen)
  SELECT agent, content_id, request_id, version AS parser_version, seq, input, output FROM best WHERE rn = 1""")
def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = V.driver_corpus(spark, sf_dir).usage.where("content_id <> ''")
    claims = claims.withColumn("session_id", F.lit("s")).withColumn("parser_version", F.when(F.col("seq") % 2 == 0, 1).otherwise(2))
    return U.richest_claims(claims).select("agent", "content_id", "request_id", "parser_version", "seq", "input", "output")


@query("pricing_explain", f"""{with_views("v_usage")}, {V.RATE_BANDS_SQL}, r AS (SELECT DISTINCT provider, model, CAST(created_at AS DATE) AS d, input FROM v_usage)
  SELECT r.provider, r.model, strftime(r.d, '%Y-%m-%d %H:%M:%S') AS created_at, r.input, b.model IS NOT NULL AS found, b.pi AS input_picos, b.po AS output_picos, b.pr AS cache_read_picos FROM r LEFT JOIN bands b
  ON r.model = b.model AND (b.provider IS NULL OR b.provider = CASE WHEN r.provider = 'alpha' THEN 'alpha' ELSE 'other' END) AND (b.dated IS NULL OR b.dated = (r.d IS NOT NULL))
  AND (b.valid_from IS NULL OR r.d >= b.valid_from) AND (b.valid_to IS NULL OR r.d < b.valid_to) AND r.input > b.lo AND r.input <= b.hi""")
def _explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = V.driver_corpus(spark, sf_dir).usage.select("provider", "model", F.date_trunc("day", "created_at").alias("created_at"), "input").distinct()
    return shown(P.explain_pricing(asked, V.driver_rates(spark)).select("provider", "model", "created_at", "input", "found", "input_picos", "output_picos", "cache_read_picos"))


query("context", f"""{with_views("v_usage")} SELECT seq, {AT("created_at")} AS created_at, model, input + cache_read + cache_write AS prompt_tokens, max(input + cache_read + cache_write) OVER (ORDER BY seq) AS peak
  FROM v_usage WHERE agent = 'agent-3' AND session_id = (SELECT min(session_id) FROM v_usage WHERE agent = 'agent-3')""")(
    corpus(lambda c: U.context(c, "agent-3", c.usage.where("agent = 'agent-3'").agg(F.min("session_id")).first()[0]))
)

# -- tools, events, files
_TOOL = """SELECT name, kind, count(*) AS calls, count(*) FILTER (status = 'error') AS errors, count(DISTINCT (agent, session_id)) AS sessions, count(duration_ms) AS timed,
  CAST(coalesce(sum(duration_ms), 0) AS BIGINT) AS total_ms, coalesce(avg(duration_ms), 0.0) AS avg_ms, coalesce(max(duration_ms), 0) AS max_ms FROM v_tool_calls GROUP BY ALL"""
query("tool_stats", with_views("v_tool_calls") + _TOOL)(corpus(lambda c: A.tool_stats(c)))
for _group, _key in {"label": "label", "status": "status", "agent": "agent", "day": "strftime(v_session_events.at, '%Y-%m-%d')", "detail": "detail"}.items():
    query(f"event_stats_by_{_group}", f"""{with_views("v_session_events")} SELECT kind, {_key} AS "group", count(*) AS events, count(*) FILTER (status IN ('error', 'blocked')) AS failures,
      count(DISTINCT (agent, session_id)) AS sessions, CAST(sum(coalesce(duration_ms, 0)) AS BIGINT) AS total_ms, avg(coalesce(duration_ms, 0)) AS avg_ms, max(coalesce(duration_ms, 0)) AS max_ms FROM v_session_events GROUP BY ALL""")(corpus(lambda c, g=_group: A.event_stats(c, group=g)))
for _group, _key in {"day": "strftime(started_at, '%Y-%m-%d')", "agent": "agent", "file": "file"}.items():
    query(f"changes_by_{_group}", f"""{with_views("v_tool_calls", "v_sessions")}, p AS (SELECT t.*, CASE WHEN file_path LIKE '/%' THEN file_path ELSE concat(s.cwd, '/', file_path) END AS file FROM v_tool_calls t JOIN v_sessions s USING (agent, session_id)
      WHERE lines_added IS NOT NULL OR lines_removed IS NOT NULL) SELECT {_key} AS "group", CAST(sum(lines_added) AS BIGINT) AS added, CAST(sum(lines_removed) AS BIGINT) AS removed, count(*) AS changes, count(DISTINCT file) AS files,
      count(DISTINCT (agent, session_id)) AS sessions FROM p GROUP BY ALL""")(corpus(lambda c, g=_group: A.changes(c, g)))
query("compactions", f"""{with_views("v_session_events")} SELECT agent, count(*) AS compactions, count(DISTINCT session_id) AS sessions, count(*) FILTER (label = 'manual') AS manual,
  avg(CASE WHEN pre > 0 THEN pre END) AS avg_before FROM (SELECT *, CAST(regexp_extract(payload, '([0-9]+)', 1) AS BIGINT) AS pre FROM v_session_events WHERE kind = 'compaction') GROUP BY agent""")(corpus(lambda c: A.compactions(c)))
query("pull_requests", f"""{with_views("v_session_events")} SELECT detail AS url, arg_max(label, (v_session_events.at, label)) AS repository, count(DISTINCT (agent, session_id)) AS sessions, {AT("max(v_session_events.at)")} AS last_at
  FROM v_session_events WHERE kind = 'pr_link' GROUP BY detail""")(corpus(lambda c: A.pull_requests(c)))
query("session_events_page", f"""{with_views("v_session_events")} SELECT agent, session_id, message_seq, kind, {AT("v_session_events.at")} AS "at", label, status, duration_ms, detail, payload FROM v_session_events WHERE kind IN ('turn', 'hook') AND status = 'error'
  AND v_session_events.at >= TIMESTAMP '2024-01-03' AND v_session_events.at < TIMESTAMP '2024-01-21' ORDER BY duration_ms DESC, v_session_events.at DESC, message_seq DESC LIMIT 100 OFFSET 10""")(
    corpus(lambda c: A.session_events(c, kind="turn, hook", status="error", since="2024-01-03", until="2024-01-20", sort="duration", offset=10))
)
query("commands_page", f"""{with_views("v_tool_calls", "v_sessions")} SELECT command, {AT("started_at")} AS started_at, agent, session_id, seq, cwd FROM v_tool_calls JOIN v_sessions USING (agent, session_id)
  WHERE kind = 'shell' AND command <> '' AND contains(lower(command), 'target1') ORDER BY v_tool_calls.started_at DESC, session_id DESC, seq DESC, agent DESC LIMIT 1000""")(corpus(lambda c: A.commands(c, query="Target1", limit=1000)))
query("export_commands_fish", f"""{with_views("v_tool_calls")} SELECT concat('- cmd: ', command, chr(10), '  when: ', CAST(CAST(floor(epoch(started_at)) AS BIGINT) AS VARCHAR)) AS value FROM v_tool_calls WHERE kind = 'shell' AND command <> ''""")(
    corpus(lambda c: A.export_commands(c, "fish"))
)
query("tools_of_session", f"""{with_views("v_tool_calls")} SELECT seq, message_seq, call_id, name, kind, status, {AT("started_at")} AS started_at, duration_ms, lines_added, lines_removed, CASE WHEN command <> '' THEN command ELSE file_path END AS detail
  FROM v_tool_calls WHERE agent = 'agent-2' AND session_id = (SELECT max(session_id) FROM v_tool_calls WHERE agent = 'agent-2')""")(
    corpus(lambda c: A.tools(c, "agent-2", c.tool_calls.where("agent = 'agent-2'").agg(F.max("session_id")).first()[0], compact=True))
)
query("recent_files", f"""{with_views("v_tool_calls")}, n AS (SELECT * FROM v_tool_calls WHERE kind IN ('file_write', 'file_edit') AND file_path <> '' ORDER BY started_at DESC, session_id DESC, seq DESC LIMIT 120),
  r AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY started_at DESC, session_id DESC, seq DESC) AS rn FROM n)
  SELECT file_path, kind, agent, session_id, {AT("started_at")} AS started_at FROM r WHERE rn = 1 ORDER BY r.started_at DESC, file_path LIMIT 20""")(corpus(A.recent_files))

# -- overview
_STATS = {
    "counts": f"""{with_views("v_sessions", "v_messages", "v_tool_calls", "v_artifacts")} SELECT (SELECT count(*) FROM v_sessions) AS sessions, (SELECT count(*) FROM v_messages) AS messages, (SELECT count(*) FROM v_tool_calls) AS tool_calls,
      (SELECT count(*) FROM v_tool_calls WHERE kind = 'shell' AND command <> '') AS commands, (SELECT count(*) FROM v_artifacts) AS artifacts, 0 AS findings""",
    "totals": f"""WITH {OWNED} SELECT CAST(sum(total_tokens) AS BIGINT) AS tokens, CAST(sum(reported_cost_nanos + estimated_nanos) AS BIGINT) AS cost_nanos, CAST(sum(CASE WHEN day >= '2024-01-01' THEN reported_cost_nanos + estimated_nanos ELSE 0 END) AS BIGINT) AS cost_month_nanos,
      CAST(sum(unpriced_input + unpriced_output + unpriced_cache_read + unpriced_cache_write) AS BIGINT) AS unpriced_tokens, CAST(sum(CASE WHEN day >= '2024-01-01' THEN unpriced_input + unpriced_output + unpriced_cache_read + unpriced_cache_write ELSE 0 END) AS BIGINT) AS unpriced_month_tokens FROM priced""",
    "agents": f"""WITH {OWNED}, u AS (SELECT agent, CAST(sum(total_tokens) AS BIGINT) AS tokens, CAST(sum(reported_cost_nanos + estimated_nanos) AS BIGINT) AS cost_nanos, CAST(sum(unpriced_input + unpriced_output + unpriced_cache_read + unpriced_cache_write) AS BIGINT) AS unpriced_tokens FROM priced GROUP BY agent)
      SELECT agent, count(*) AS sessions, {AT("max(modified_at)")} AS last_active, any_value(tokens) AS tokens, any_value(cost_nanos) AS cost_nanos, any_value(unpriced_tokens) AS unpriced_tokens FROM v_sessions LEFT JOIN u USING (agent) GROUP BY agent""",
    "activity": f"""WITH {OWNED}, d AS (SELECT day, CAST(sum(reported_cost_nanos + estimated_nanos) AS BIGINT) AS cost_nanos, CAST(sum(unpriced_input + unpriced_output + unpriced_cache_read + unpriced_cache_write) AS BIGINT) AS unpriced_tokens FROM priced GROUP BY day),
      s AS (SELECT strftime(modified_at, '%Y-%m-%d') AS day, count(*) AS sessions FROM v_sessions GROUP BY 1) SELECT day, sessions, coalesce(cost_nanos, 0) AS cost_nanos, coalesce(unpriced_tokens, 0) AS unpriced_tokens FROM s LEFT JOIN d USING (day)""",
    "workspaces": f"""{with_views("v_sessions")} SELECT cwd, count(*) AS sessions, {AT("max(modified_at)")} AS last_active FROM v_sessions GROUP BY cwd ORDER BY max(modified_at) DESC, cwd LIMIT 8""",
    "tool_kinds": f"""{with_views("v_tool_calls")} SELECT kind, count(*) AS calls FROM v_tool_calls GROUP BY kind""",
}
for _facet, _sql in _STATS.items():
    query(f"stats_{_facet}", _sql)(corpus(lambda c, f=_facet: A.stats(c, "2024-01-31")[f]))

# -- sessions
_SUMMARY = f"""WITH {OWNED}, u AS (SELECT agent, session_id, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write,
    CAST(sum(reported_cost_nanos + estimated_nanos) AS BIGINT) AS cost_nanos, CAST(sum(unpriced_input + unpriced_output + unpriced_cache_read + unpriced_cache_write) AS BIGINT) AS unpriced_tokens FROM priced GROUP BY ALL),
  n AS (SELECT agent, session_id, count(*) AS n FROM ev GROUP BY ALL)
  SELECT agent, session_id, title, {AT("created_at")} AS created_at, {AT("modified_at")} AS modified_at, workspace, n AS messages, n AS tool_calls, coalesce(input, 0) AS input, coalesce(output, 0) AS output, coalesce(cache_read, 0) AS cache_read,
    coalesce(cache_write, 0) AS cache_write, coalesce(cost_nanos, 0) AS cost_nanos, coalesce(unpriced_tokens, 0) AS unpriced_tokens FROM v_sessions s JOIN n USING (agent, session_id) LEFT JOIN u USING (agent, session_id)"""
_SHOWN = ["agent", "session_id", "title", "created_at", "modified_at", "workspace", "messages", "tool_calls", "input", "output", "cache_read", "cache_write", "cost_nanos", "unpriced_tokens"]
query("session_summary", _SUMMARY)(corpus(lambda c: S.session_summary(c).select(*_SHOWN)))
query("sessions_page", _SUMMARY + " WHERE s.modified_at >= TIMESTAMP '2024-01-10' AND s.modified_at < TIMESTAMP '2024-01-21' ORDER BY s.modified_at DESC, session_id DESC, agent LIMIT 50 OFFSET 5")(
    corpus(lambda c: S.sessions(c, since="2024-01-10", until="2024-01-20", offset=5).select(*_SHOWN))
)
query("sessions_by_model", _SUMMARY + " WHERE s.agent = 'agent-1' AND contains(lower(s.title), 'view') AND EXISTS (SELECT 1 FROM ev e WHERE e.agent = s.agent AND e.session_id = s.session_id AND e.event_id % 4 = 0) ORDER BY s.modified_at DESC, session_id DESC LIMIT 500")(
    corpus(lambda c: S.sessions(c, agent="agent-1", title="VIEW", model="m-large", limit=500).select(*_SHOWN))
)
query("compare_sessions", f"""WITH a AS ({_SUMMARY}), t AS ({" UNION ALL ".join(f"SELECT '{m}' AS metric, arg_min({m}, concat(session_id, '/', agent)) AS \"left\", arg_max({m}, concat(session_id, '/', agent)) AS \"right\" FROM a" for m in ("messages", "tool_calls", "input", "output", "cache_read", "cache_write", "cost_nanos", "unpriced_tokens"))})
  SELECT metric, "left", "right", "right" - "left" AS delta FROM t""")(corpus(lambda c: _compare(c)))


def _compare(c: Corpus) -> DataFrame:
    name = F.concat_ws("/", "session_id", "agent")
    first, last = c.sessions.agg(F.min(name), F.max(name)).first()
    return S.compare_sessions(c, tuple(first.split("/")[::-1]), tuple(last.split("/")[::-1])).where("metric not in ('subagents', 'duration_seconds')")


query("subagent_closure", f"""WITH RECURSIVE {V.view_sql("v_relations")}, below AS (SELECT agent, to_id AS root, from_id AS node FROM v_relations WHERE from_id <> to_id
  UNION SELECT b.agent, b.root, r.from_id FROM below b JOIN v_relations r ON r.agent = b.agent AND r.to_id = b.node WHERE r.from_id <> b.root) SELECT * FROM below WHERE root <> node""")(corpus(lambda c: S.descendants(c.relations)))
query("relations_of_session", f"""{with_views("v_relations")} SELECT kind, 'out' AS direction, to_id AS other_id, CAST(NULL AS BIGINT) AS at_seq FROM v_relations WHERE from_id = 'c5' UNION ALL SELECT kind, 'in', from_id, NULL FROM v_relations WHERE to_id = 'c5'""")(
    corpus(lambda c: S.relations_of(c, "conv", "c5"))
)
query("transcript_page", f"""{with_views("v_messages")} SELECT seq, external_id, role, kind, {AT("created_at")} AS created_at, provider, model, text, effort FROM v_messages WHERE agent = 'agent-0' AND session_id = (SELECT max(session_id) FROM v_messages WHERE agent = 'agent-0')
  ORDER BY seq LIMIT 200""")(corpus(lambda c: S.transcript(c, "agent-0", c.messages.where("agent = 'agent-0'").agg(F.max("session_id")).first()[0]).select("seq", "external_id", "role", "kind", "created_at", "provider", "model", "text", "effort")))

# -- links
query("pair_results", f"""{with_views("v_tool_calls")}, r AS (SELECT agent, session_id, seq, max(seq + d) AS line FROM v_tool_calls, (VALUES (-1), (2), (5)) x(d) WHERE d > 0 AND seq % 7 <> 0 GROUP BY ALL)
  SELECT t.agent, t.session_id, t.seq, CASE WHEN line IS NULL THEN status WHEN line % 2 = 0 THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN line IS NOT NULL AND line % 3 > 0 THEN (line % 3) * 1000 ELSE duration_ms END AS duration_ms FROM v_tool_calls t LEFT JOIN r USING (agent, session_id, seq)""")(corpus(lambda c: _paired(c)))


def _paired(c: Corpus) -> DataFrame:
    """Calls with several late results each, one of them before the call, some ended before they began."""
    calls = c.tool_calls.withColumn("started_ms", F.lit(1_000_000).cast("bigint"))
    late = calls.where("seq % 7 <> 0").select("agent", "session_id", "call_id", F.explode(F.array(F.col("seq") - 1, F.col("seq") + 2, F.col("seq") + 5)).alias("line"), F.col("seq").alias("call_seq"))
    late = late.where("line > call_seq").select("agent", "session_id", "call_id", "line", F.when(F.col("line") % 2 == 0, "error").otherwise("ok").alias("status"), F.lit("").alias("excerpt"), F.lit("").alias("result"), F.when(F.col("line") % 3 > 0, 1_000_000 + F.col("line") % 3 * 1000).otherwise(F.lit(999_000)).alias("at_ms"), F.lit(None).cast("bigint").alias("lines_added"), F.lit(None).cast("bigint").alias("lines_removed"))
    return L.pair_results(calls, late).select("agent", "session_id", "seq", "status", "duration_ms")


query("resolve_relations", f"""{with_views("v_relations")}, e AS (SELECT *, (CAST(substr(from_id, 2) AS INT)) % 8 AS tried FROM v_relations), s AS (SELECT DISTINCT concat('c', CAST(conv_id AS VARCHAR)) AS id FROM conversations WHERE conv_id % 3 <> 0)
  SELECT from_id, to_id, f AND t AS resolved, CASE WHEN f AND t THEN tried ELSE tried + 1 END AS attempts FROM (SELECT *, from_id IN (SELECT id FROM s) AS f, to_id IN (SELECT id FROM s) AS t FROM e) WHERE (f AND t) OR tried + 1 <= 5""")(corpus(lambda c: _resolved(c)))


def _resolved(c: Corpus) -> DataFrame:
    edges = c.relations.withColumn("attempts", (F.substring("from_id", 2, 20).cast("int") % 8)).withColumn("resolved", F.lit(False))
    ids = c.relations.select("agent", F.col("from_id").alias("session_id")).union(c.relations.select("agent", "to_id")).distinct().where("cast(substr(session_id, 2) as int) % 3 <> 0")
    return L.resolve_relations(edges, ids).select("from_id", "to_id", "resolved", "attempts")


query("resolve_links", r"""WITH d AS (SELECT doc_id, doc_id % 3 AS k, coalesce(text, '') AS t FROM documents), p AS (SELECT doc_id, regexp_replace(regexp_replace(t, '^\\s+|\\s+$', '', 'g'), '[ \\t\\r]+\\n', chr(10), 'g') AS key FROM d WHERE k = 0),
  x AS (SELECT DISTINCT a.doc_id AS artifact, b.doc_id AS call, concat('s', CAST(b.doc_id % 11 AS VARCHAR)) AS session_id, b.doc_id AS seq FROM p a JOIN p b ON a.key = b.key WHERE b.doc_id % 2 = 0 AND a.key <> ''),
  m AS (SELECT doc_id AS artifact, doc_id AS seq, concat('s', CAST(doc_id % 11 AS VARCHAR)) AS session_id FROM d WHERE k = 1)
  SELECT 'plan' AS kind, concat('doc', CAST(artifact AS VARCHAR)) AS name, session_id, max(seq) AS anchor_seq FROM x GROUP BY ALL
  UNION ALL SELECT 'memory', concat('proj/doc', CAST(artifact AS VARCHAR)), session_id, seq FROM m""")(lambda spark, sf_dir: _linked(spark, sf_dir))


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans written by calls with the same text, and memories written by calls to their path."""
    c = V.driver_corpus(spark, sf_dir)
    number = F.substring("name", 4, 20).cast("bigint")
    base = c.artifacts.select("agent", "kind", "name", "content", number.alias("n"), F.concat(F.lit("s"), (number % 11).cast("string")).alias("session_id"))
    made = base.select("agent", "kind", F.when(F.col("kind") == "memory", F.concat(F.lit("proj/"), "name")).otherwise(F.col("name")).alias("name"), "content")
    plan = base.where("kind = 'plan' and n % 2 = 0").select("agent", "session_id", F.col("n").alias("message_seq"), F.lit("ExitPlanMode").alias("name"), F.lit("other").alias("kind"), F.to_json(F.struct(F.concat(F.lit("  "), "content", F.lit(" \n")).alias("plan"))).alias("input"), F.lit("").alias("file_path"))
    memory = base.where("kind = 'memory'").select("agent", "session_id", F.col("n").alias("message_seq"), F.lit("Write").alias("name"), F.lit("file_write").alias("kind"), F.lit("{}").alias("input"), F.concat(F.lit("/home/u/.x/projects/proj/memory/"), "name").alias("file_path"))
    c = c.with_tables(artifacts=made, tool_calls=plan.unionByName(memory))
    return L.resolve_links(c).select("kind", "name", "session_id", "anchor_seq")


# -- search, scan, artifacts
_DOC_TEXTS = """d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents WHERE doc_id % 3 <> 2)"""


def _index(spark: SparkSession, sf_dir: str):
    return X.build_search_index(X.search_documents(V.driver_corpus(spark, sf_dir).with_tables(messages=spark.createDataFrame([], V.schema("messages")))))


query("search_index_terms", rf"""WITH {_DOC_TEXTS}, w AS (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(t)), '[\p{{L}}\p{{N}}]+')) AS term FROM d WHERE regexp_matches(t, '\S'))
  SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM w GROUP BY term""")(
    lambda spark, sf_dir: _index(spark, sf_dir).postings.groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("positions")).alias("occurrences"))
)
query("search_hits", rf"""WITH {_DOC_TEXTS}, h AS (SELECT doc_id, concat(' ', array_to_string(regexp_extract_all(strip_accents(lower(t)), '[\p{{L}}\p{{N}}]+'), ' '), ' ') AS words FROM d)
  SELECT concat('artifact/docs/', CASE doc_id % 3 WHEN 0 THEN 'plan' ELSE 'memory' END, '/doc', CAST(doc_id AS VARCHAR)) AS doc FROM h WHERE contains(words, ' of the ') AND contains(words, ' that ')""")(
    lambda spark, sf_dir: _all_hits(_index(spark, sf_dir), "of_the that")
)


def _all_hits(index, q: str) -> DataFrame:
    """Every hit, without the page limit of the operation."""
    return X.hits(index, q).select("doc")


def _whole_index(spark: SparkSession, sf_dir: str):
    """Index of all messages and all documents; documents are of the one kind 'plan', so that each can be searched."""
    c = V.driver_corpus(spark, sf_dir)
    return X.build_search_index(X.search_documents(c.with_tables(artifacts=c.artifacts.withColumn("kind", F.lit("plan")))))


_ALL_TEXTS = f"""{with_views("v_messages", "v_artifacts")}, d AS (SELECT concat('message/', agent, '/', session_id, '/', CAST(seq AS VARCHAR)) AS doc, text AS t FROM v_messages
  UNION ALL SELECT concat('artifact/', agent, '/plan/', name), content FROM v_artifacts)"""
query("search_index_terms_whole", rf"""{_ALL_TEXTS}, w AS (SELECT doc, unnest(regexp_extract_all(strip_accents(lower(t)), '[\p{{L}}\p{{N}}]+')) AS term FROM d WHERE regexp_matches(t, '\S'))
  SELECT term, count(DISTINCT doc) AS documents, count(*) AS occurrences FROM w GROUP BY term""")(
    lambda spark, sf_dir: _whole_index(spark, sf_dir).postings.groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("positions")).alias("occurrences"))
)
for _name, _q, _words in (("search_hits_whole", "of_the that", (" of the ", " that ")), ("search_hits_messages", "click number", (" click ", " number "))):
    query(_name, rf"""{_ALL_TEXTS}, h AS (SELECT doc, concat(' ', array_to_string(regexp_extract_all(strip_accents(lower(t)), '[\p{{L}}\p{{N}}]+'), ' '), ' ') AS words FROM d)
  SELECT doc FROM h WHERE contains(words, '{_words[0]}') AND contains(words, '{_words[1]}')""")(lambda spark, sf_dir, q=_q: _all_hits(_whole_index(spark, sf_dir), q))


query("secret_scan", rf"""WITH {_DOC_TEXTS.replace(" WHERE doc_id % 3 <> 2", "")}, f AS (SELECT * FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(t, '(?i)\b(?:api_?key|secret|token|password|passwd)\b\s*[:=]\s*[''"]?([A-Za-z0-9_/+.=-]{{12,}})', 1))) AS secret FROM d) WHERE list_aggregate(string_split(secret, ''), 'entropy') >= 3.0)
  SELECT concat('docs/', CASE doc_id % 3 WHEN 0 THEN 'plan' WHEN 1 THEN 'memory' ELSE 'file_history' END, '/doc', CAST(doc_id AS VARCHAR)) AS natural_key, concat(left(secret, 4), '***') AS redacted,
  1 + length(substr(t, 1, instr(t, secret))) - length(replace(substr(t, 1, instr(t, secret)), chr(10), '')) AS line FROM f JOIN d USING (doc_id)""")(
    corpus(lambda c: C.find_secrets(C.scan_documents(c).where("entity_type = 'artifact'"), C.default_rules(c.spark).where("rule_id = 'assigned-secret'")).select("natural_key", "redacted", "line"))
)


@query("scan_rules", rf"""WITH {_DOC_TEXTS.replace(" WHERE doc_id % 3 <> 2", "")}, f AS (SELECT * FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(t, '(?i)\b(?:api_?key|secret|token|password|passwd)\b\s*[:=]\s*[''"]?([A-Za-z0-9_/+.=-]{{12,}})', 1))) AS secret FROM d) WHERE list_aggregate(string_split(secret, ''), 'entropy') >= 3.0)
  SELECT 'assigned-secret' AS rule_id, count(*) AS findings, count(*) FILTER (doc_id % 2 = 0) AS active, count(DISTINCT doc_id) AS entities FROM f HAVING count(*) > 0""")
def _scan_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of one rule, with those in odd documents ignored."""
    c = V.driver_corpus(spark, sf_dir)
    found = C.find_secrets(C.scan_documents(c).where("entity_type = 'artifact'"), C.default_rules(spark).where("rule_id = 'assigned-secret'")).withColumn("found_at", F.lit(None).cast("timestamp"))
    odd = found.where("cast(regexp_extract(natural_key, '([0-9]+)$', 1) as bigint) % 2 = 1")
    ignores = odd.select("entity_type", F.concat_ws("|", "rule_id", "natural_key", F.lit("*")).alias("natural_key"), F.lit("scan_ignore").alias("kind"), F.lit("").alias("value"), F.lit(None).cast("timestamp").alias("created_at"))
    return C.scan_rules(c.with_tables(findings=found, annotations=ignores)).drop("last_seen")


query("artifact_kinds", f"""{with_views("v_artifacts")} SELECT kind, count(*) AS artifacts FROM v_artifacts GROUP BY kind""")(corpus(lambda c: A.artifact_kinds(c)))
query("artifact_sizes", f"""{with_views("v_artifacts")} SELECT agent, kind, name, strlen(content) AS bytes FROM v_artifacts WHERE kind = 'plan'""")(corpus(lambda c: A.artifacts(c, kind="plan", limit=1 << 30).drop("modified_at")))

# -- keeping a corpus
query("prune_sessions", f"""{with_views("v_sessions", "v_usage")} SELECT agent, session_id, count(u.seq) AS requests FROM v_sessions LEFT JOIN v_usage u USING (agent, session_id) WHERE right(session_id, 1) <> '3' GROUP BY ALL""")(corpus(lambda c: _pruned(c)))


def _pruned(c: Corpus) -> DataFrame:
    listing = c.sessions.where(~F.col("session_id").endswith("3")).select(F.col("source_path").alias("path"))
    left = K.prune(c, listing, ["/logs"])
    return left.sessions.join(left.usage, ["agent", "session_id"], "left").groupBy("agent", "session_id").agg(F.count("seq").alias("requests"))


query("merge_archive", f"""{with_views("v_sessions")} SELECT agent, session_id, CASE WHEN right(session_id, 1) IN ('1', '2') THEN 'imported' ELSE 'ingest' END AS origin FROM v_sessions""")(
    corpus(lambda c: K.merge_archive(c.with_tables(sessions=c.sessions.where("right(session_id, 1) not in ('1', '2')")), c).sessions.select("agent", "session_id", "origin"))
)
query("reconcile_source", f"""{with_views("v_tool_calls")} SELECT session_id, call_id FROM v_tool_calls WHERE NOT (right(session_id, 1) = '4' AND seq % 5 = 0)""")(corpus(lambda c: _reconciled(c)))


def _reconciled(c: Corpus) -> DataFrame:
    stored = c.tool_calls.select("session_id", "call_id", "seq", F.col("session_id").alias("source_path"), F.lit("ingest").alias("origin"))
    complete = stored.where("right(session_id, 1) = '4'").select("source_path").distinct()
    seen = stored.where("seq % 5 <> 0")
    return K.reconcile_source(stored, seen, ["call_id"], complete).select("session_id", "call_id")


query("changed_sources", """SELECT page_id FROM pages WHERE page_id % 4 = 0 OR page_id % 10 = 3""")(lambda spark, sf_dir: _changed(spark, sf_dir))


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as sources: every fourth one is new, every tenth has another size."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("string").alias("path"), F.length("html").cast("bigint").alias("length"), F.lit(0).alias("mtime"))
    known = pages.where("cast(path as bigint) % 4 <> 0").select("path", F.when(F.col("path").cast("bigint") % 10 == 3, 0).otherwise(F.col("length")).cast("bigint").alias("length"), "mtime", F.lit("").alias("content_hash"), F.lit(1).alias("parser_version"))
    return K.changed_sources(pages, known, 1).select(F.col("path").cast("bigint").alias("page_id"))


query("upsert_sessions", f"""{with_views("v_messages")} SELECT agent, session_id, max(seq) AS seq FROM v_messages GROUP BY ALL""")(
    corpus(lambda c: K.upsert(c.messages.where("seq % 2 = 0").groupBy("agent", "session_id").agg(F.max("seq").alias("seq")), c.messages.select("agent", "session_id", "seq"), ["agent", "session_id"], "seq"))
)

# -- scalar functions over whole texts
query("text_scalars", """SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE length(t) - length(replace(t, chr(10), '')) + CASE WHEN right(t, 1) = chr(10) THEN 0 ELSE 1 END END AS lines, strlen(t) AS bytes,
  CASE WHEN regexp_matches(lower(t), 'rate limit|usage limit|quota') THEN 'rate_limit' WHEN regexp_matches(lower(t), 'context window|context_length') THEN 'invalid_request' WHEN regexp_matches(lower(t), 'oauth|unauthorized|api key|authentication') THEN 'authentication_failed'
    WHEN regexp_matches(lower(t), 'socket|connection|fetch failed|unable to connect|timed out') THEN 'connection' WHEN regexp_matches(lower(t), 'overloaded|server error|internal error|service unavailable') THEN 'server_error' ELSE 'error' END AS error_class
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")(lambda spark, sf_dir: _scalars(spark, sf_dir))


def _scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", Z.text_line_count(t).alias("lines"), F.octet_length(t).cast("bigint").alias("bytes"), Z.error_class(t).alias("error_class"))


# -- streams that run to the end of what is there, as a catch-up run does
def _streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a stream over the event table, which is a file or a folder of files."""
    kinds = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(kinds).parquet(f"{sf_dir}/events.parquet*")
    ev = spark.sql(V.VIEWS["ev"].replace("FROM events", "FROM {events}"), events=raw)
    return spark.sql(V.VIEWS[name].replace("FROM ev", "FROM {ev}"), ev=ev)


def _finish(df: DataFrame, mode: str) -> DataFrame:
    """Run a stream to its end, its state and its last whole result in the shared folder, and give that result."""
    folder, state = new_folder(df.sparkSession, "stream-out"), new_folder(df.sparkSession, "stream-state")
    store = lambda batch, _: batch.write.mode("overwrite").parquet(folder)  # noqa: E731  a batch that comes again writes the same
    df.writeStream.foreachBatch(store).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@query("stream_tool_counts", f"""{with_views("v_tool_calls")} SELECT strftime(CAST(started_at AS DATE), '%Y-%m-%d') AS day, name, count(*) AS n, count(*) FILTER (status IN ('error', 'blocked')) AS failures, CAST(sum(coalesce(duration_ms, 0)) AS BIGINT) AS total_ms FROM v_tool_calls GROUP BY ALL""")
def _stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _finish(live.stream_counts(_streamed(spark, sf_dir, "v_tool_calls"), ["name"]), "complete")
    return counted.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("stream_usage_blocks", f"""{with_views("v_usage")} SELECT strftime(make_timestamp((CAST(floor(epoch(created_at)) AS BIGINT) // 18000) * 18000000000), '%Y-%m-%d %H:%M:%S') AS start, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_read) AS BIGINT) AS cache_read,
  CAST(sum(cache_write) AS BIGINT) AS cache_write, count(*) AS requests FROM v_usage WHERE created_at IS NOT NULL GROUP BY 1""")
def _stream_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_finish(live.stream_blocks(_streamed(spark, sf_dir, "v_usage")), "complete").drop("end", "sessions").where("start is not null"))


# -- log adapters over logs that are derived from the tables
def _log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as session logs of one JSON record per line: path, line, value."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role in ('user', 'assistant')")
    at = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 1000 + F.col("turn")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    tokens = F.when(F.col("role") == "assistant", F.struct(F.length("text").alias("input_tokens"), (F.col("turn") + 1).alias("output_tokens")))
    call = F.array(F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name")), F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.concat_ws("-", F.lit("t"), "conv_id", "turn").alias("id"), F.lit("Bash").alias("name")))
    said = F.struct(F.concat_ws("-", F.lit("m"), "conv_id", "turn").alias("id"), F.col("role"), F.lit("model").alias("model"), call.alias("content"), tokens.alias("usage"))
    record = F.to_json(F.struct(F.col("role").alias("type"), F.concat_ws("-", F.lit("u"), "conv_id", "turn").alias("uuid"), at.alias("timestamp"), F.lit("/w").alias("cwd"), said.alias("message")))
    return turns.select(F.concat(F.lit("/logs/projects/p/c"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("path"), (F.col("turn") + 1).cast("bigint").alias("line"), record.alias("value"))


def _ingested(spark: SparkSession, sf_dir: str) -> Corpus:
    good, _ = split_lines(_log_lines(spark, sf_dir))
    return claude.from_lines(spark, good.select("path", "line", "value"))


_TURNS = "WITH t AS (SELECT concat('c', CAST(conv_id AS VARCHAR)) AS session_id, conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq FROM conversations WHERE role IN ('user', 'assistant'))"
query("ingest_messages", f"{_TURNS} SELECT session_id, seq, role, coalesce(text, '') AS text FROM t")(lambda spark, sf_dir: _ingested(spark, sf_dir).messages.select("session_id", "seq", "role", "text"))
query("ingest_usage", f"{_TURNS} SELECT session_id, seq, concat('m-', CAST(conv_id AS VARCHAR), '-', CAST(turn AS VARCHAR)) AS content_id, length(text) AS input, turn + 1 AS output FROM t WHERE role = 'assistant'")(lambda spark, sf_dir: _ingested(spark, sf_dir).usage.select("session_id", "seq", "content_id", "input", "output"))
query("ingest_tool_calls", f"{_TURNS} SELECT session_id, seq, seq AS message_seq, 'Bash' AS name, 'shell' AS kind FROM t")(lambda spark, sf_dir: _ingested(spark, sf_dir).tool_calls.select("session_id", "seq", "message_seq", "name", "kind"))
query("ingest_sessions", f"{_TURNS} SELECT session_id, strftime(make_timestamp((1700000000 + conv_id * 1000 + min(turn)) * 1000000), '%Y-%m-%d %H:%M:%S') AS created_at, strftime(make_timestamp((1700000000 + conv_id * 1000 + max(turn)) * 1000000), '%Y-%m-%d %H:%M:%S') AS modified_at, '/w' AS workspace FROM t GROUP BY session_id, conv_id")(
    lambda spark, sf_dir: shown(_ingested(spark, sf_dir).sessions.select("session_id", "created_at", "modified_at", "workspace"))
)
query("counter_deltas", f"""{with_views("v_usage")}, c AS (SELECT agent, seq, input AS last, sum(input) OVER (PARTITION BY agent, seq // 50 ORDER BY seq) AS total FROM v_usage)
  SELECT agent, seq, CASE WHEN was IS NULL OR total < was THEN total ELSE total - was END AS delta FROM (SELECT *, lag(total) OVER (PARTITION BY agent ORDER BY seq) AS was FROM c)""")(corpus(lambda c: _deltas(c)))


def _deltas(c: Corpus) -> DataFrame:
    """Cumulative counters that start anew every so often, and the usage per turn read off them."""
    run = Window.partitionBy("agent", F.expr("seq div 50")).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = c.usage.select("agent", F.lit("s").alias("session_id"), F.col("seq").alias("line"), F.struct(F.sum("input").over(run).alias("total_tokens")).alias("total"), F.lit(None).cast("struct<total_tokens:bigint>").alias("last"))
    return shared.counter_deltas(rows, ["total_tokens"]).select("agent", F.col("line").alias("seq"), F.col("delta.total_tokens").alias("delta"))
