"""Registered queries of the log adapters: conversations become logs of each agent, and are read back as canonical tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spoolsight.corpus import Corpus
from spoolsight.plans.queries import query, shown
from spoolsight.sources import claude, codex, cursor, opencode, pi

BEGIN = 1_700_000_000


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns with a role, each a second after the one before; sessions are 1,000 seconds apart."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role is not null")
    at = F.timestamp_seconds(F.lit(BEGIN) + F.col("conv_id") * 1000 + F.col("turn"))
    return turns.withColumns({"at": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), "ms": F.unix_millis(at), "size": F.length("text"), "said": F.col("role") == "assistant"})


def _sessions(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.min("at").alias("at"), F.min("ms").alias("ms"), F.max("ms").alias("last_ms"))


def _line(path: str, line: Column, **record: Column) -> list[Column]:
    return [F.concat(F.lit(path), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("path"), line.cast("bigint").alias("line"), F.to_json(F.struct(*(c.alias(n) for n, c in record.items()))).alias("value")]


def _id(prefix: str) -> Column:
    return F.concat_ws("-", F.lit(prefix), "conv_id", "turn")


def codex_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """Typed envelopes with cumulative counters. Even conversations also tell the last turn's figures; of every tenth one each
    count comes twice."""
    turns = _turns(spark, sf_dir)
    heads = _sessions(turns)
    path = "/logs/rollout-"
    meta = heads.select(*_line(path, F.lit(1), timestamp=F.col("at"), type=F.lit("session_meta"), payload=F.struct(F.concat(F.lit("x"), F.col("conv_id").cast("string")).alias("id"), F.lit("/w").alias("cwd"))))
    context = heads.select(*_line(path, F.lit(2), timestamp=F.col("at"), type=F.lit("turn_context"), payload=F.struct(F.lit("m1").alias("model"), F.lit("high").alias("effort"))))
    said = F.struct(F.lit("message").alias("type"), "role", F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content"))
    messages = turns.select(*_line(path, 10 + 10 * F.col("turn"), timestamp=F.col("at"), type=F.lit("response_item"), payload=said))
    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    figures = lambda i, o: F.struct(i.alias("input_tokens"), F.lit(0).alias("cached_input_tokens"), F.lit(0).alias("cache_write_input_tokens"), o.alias("output_tokens"), F.lit(0).alias("reasoning_output_tokens"), (i + o).alias("total_tokens"))
    counted = turns.where("said").withColumns({"i": F.sum("size").over(so_far), "o": F.sum(F.col("turn") + 1).over(so_far)})
    info = F.struct(figures(F.col("i"), F.col("o")).alias("total_token_usage"), F.when(F.col("conv_id") % 2 == 0, figures(F.col("size").cast("bigint"), F.col("turn") + 1)).alias("last_token_usage"))
    times = counted.withColumn("again", F.explode(F.when(F.col("conv_id") % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    counts = times.select(*_line(path, 10 + 10 * F.col("turn") + F.col("again"), timestamp=F.col("at"), type=F.lit("event_msg"), payload=F.struct(F.lit("token_count").alias("type"), info.alias("info"))))
    return codex.from_lines(spark, meta.union(context).union(messages).union(counts))


def pi_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """Entries with a header, a model change and reported costs."""
    turns = _turns(spark, sf_dir)
    heads = _sessions(turns)
    path = "/logs/p"
    head = heads.select(*_line(path, F.lit(1), type=F.lit("session"), id=F.concat(F.lit("p"), F.col("conv_id").cast("string")), cwd=F.lit("/w"), timestamp=F.col("at")))
    change = heads.select(*_line(path, F.lit(2), type=F.lit("model_change"), provider=F.lit("x"), modelId=F.lit("m")))
    use = F.when(F.col("said"), F.struct(F.col("size").alias("input"), (F.col("turn") + 1).alias("output"), F.lit(2).alias("cacheRead"), F.lit(3).alias("cacheWrite"), F.struct(((F.col("turn") + 1) / 1000).alias("total")).alias("cost")))
    messages = turns.select(*_line(path, 10 + F.col("turn"), type=F.lit("message"), id=_id("e"), timestamp=F.col("at"), message=F.struct("role", F.col("text").alias("content"), use.alias("usage"))))
    return pi.from_lines(spark, head.union(change).union(messages))


def opencode_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """Session and message documents, whose output does not count reasoning."""
    turns = _turns(spark, sf_dir)
    of = F.concat(F.lit("o"), F.col("conv_id").cast("string"))
    sessions = _sessions(turns).select(of.alias("id"), F.lit("T").alias("title"), F.lit("").alias("parentID"), F.lit("/w").alias("directory"), F.struct(F.col("ms").alias("created"), F.col("last_ms").alias("updated")).alias("time"))
    tokens = F.when(F.col("said"), F.struct(F.col("size").cast("bigint").alias("input"), (F.col("turn") + 1).alias("output"), F.lit(4).cast("bigint").alias("reasoning"), F.struct(F.lit(2).cast("bigint").alias("read"), F.lit(3).cast("bigint").alias("write")).alias("cache")))
    none = F.lit(None).cast("string")
    part = F.struct(F.lit("a").alias("id"), F.lit("text").alias("type"), "text", none.alias("tool"), none.alias("callID"), F.lit(None).cast("struct<status:string,input:string,output:string>").alias("state"))
    messages = turns.select(_id("m").alias("id"), of.alias("sessionID"), "role", F.lit("p").alias("providerID"), F.lit("m").alias("modelID"), F.struct(F.col("ms").alias("created")).alias("time"), F.lit(None).cast("double").alias("cost"), tokens.alias("tokens"), F.array(part).alias("parts"))
    return opencode.ingest_opencode(spark, (sessions, messages))


def cursor_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """Rows of hexadecimal JSON, ordered by their ids as numbers."""
    turns = _turns(spark, sf_dir)
    of = F.concat(F.lit("u"), F.col("conv_id").cast("string")).alias("session_id")
    packed = lambda *fields: F.hex(F.to_json(F.struct(*fields)).cast("binary"))
    meta = _sessions(turns).select(of, F.lit(1).cast("bigint").alias("rowid"), packed(F.lit("N").alias("name"), F.lit("/w").alias("workspaceRoot"), F.col("ms").alias("createdAt")).alias("value"))
    use = F.when(F.col("said"), F.struct(F.col("size").alias("inputTokens"), (F.col("turn") + 1).alias("outputTokens"), F.lit(2).alias("cacheReadTokens"), F.lit(3).alias("cacheWriteTokens")))
    blobs = turns.select(of, F.col("turn").cast("string").alias("id"), packed("role", F.col("text").alias("content"), F.col("ms").alias("timestamp"), F.lit("m").alias("model"), use.alias("usage")).alias("data"))
    return cursor.ingest_cursor(spark, meta, blobs)


def claude_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """Records of every turn. System turns are compactions; every seventh turn ends in an error of the service, and sessions
    whose number divides by four lie below their half's as subagents."""
    turns = _turns(spark, sf_dir)
    system = F.col("role") == "system"
    nested = (F.col("conv_id") % 4 == 0) & (F.col("conv_id") > 0)
    path = F.when(nested, F.concat(F.lit("/logs/projects/p/c"), F.expr("conv_id div 2").cast("string"), F.lit("/subagents/agent-"), F.col("conv_id").cast("string"), F.lit(".jsonl"))).otherwise(F.concat(F.lit("/logs/projects/p/c"), F.col("conv_id").cast("string"), F.lit(".jsonl")))
    failed = (F.col("turn") % 7 == 3) & F.col("said")
    compact = F.when(system, F.struct(F.lit("auto").alias("trigger"), F.col("size").alias("preTokens"), F.col("turn").alias("postTokens"), F.lit(12).alias("durationMs")))
    said = F.when(~system, F.struct(_id("m").alias("id"), "role", F.col("text").alias("content")))
    record = F.to_json(F.struct(F.col("role").alias("type"), _id("u").alias("uuid"), F.col("at").alias("timestamp"), F.lit("/w").alias("cwd"), F.when(system, "compact_boundary").alias("subtype"), F.when(system, F.col("text")).alias("content"), compact.alias("compactMetadata"), F.when(failed, True).alias("isApiErrorMessage"), F.when(failed, F.lit("rate_limit")).alias("error"), said.alias("message")))
    return claude.from_lines(spark, turns.select(path.alias("path"), (F.col("turn") + 1).cast("bigint").alias("line"), record.alias("value")))


_TURNS = "WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq FROM conversations WHERE role IS NOT NULL)"
_AT = "strftime(make_timestamp((1700000000 + conv_id * 1000 + turn) * 1000000), '%Y-%m-%d %H:%M:%S')"
for _name, _make, _prefix, _model, _output, _cache in (("codex", codex_corpus, "x", "m1", "turn + 1", "0"), ("pi", pi_corpus, "p", "m", "turn + 1", "2"), ("opencode", opencode_corpus, "o", "m", "turn + 5", "2"), ("cursor", cursor_corpus, "u", "m", "turn + 1", "2")):
    _session = f"concat('{_prefix}', CAST(conv_id AS VARCHAR)) AS session_id"
    _seq = "seq + 1 AS seq" if _name == "pi" else "seq"  # there the model change before the first turn is message 0
    query(f"ingest_{_name}_messages", f"""{_TURNS} SELECT {_session}, {_seq}, role, '{_model}' AS model, coalesce(text, '') AS text, {_AT} AS created_at FROM t""")(
        lambda spark, sf_dir, make=_make: shown(make(spark, sf_dir).messages.where("kind = 'message'").select("session_id", "seq", "role", "model", "text", "created_at"))
    )
    query(f"ingest_{_name}_usage", f"""{_TURNS} SELECT {_session}, {_seq}, '{_model}' AS model, length(text) AS input, {_output} AS output, {_cache} AS cache_read FROM t WHERE role = 'assistant'""")(
        lambda spark, sf_dir, make=_make: make(spark, sf_dir).usage.select("session_id", "seq", "model", "input", "output", "cache_read")
    )
query("ingest_pi_costs", f"""{_TURNS} SELECT concat('p', CAST(conv_id AS VARCHAR)) AS session_id, seq + 1 AS seq, (turn + 1) * 1000000 AS reported_nanos FROM t WHERE role = 'assistant'""")(lambda spark, sf_dir: pi_corpus(spark, sf_dir).usage.select("session_id", "seq", "reported_nanos"))
_SPANS = f"""{_TURNS} SELECT concat('%s', CAST(conv_id AS VARCHAR)) AS session_id, '/w' AS workspace, strftime(make_timestamp((1700000000 + conv_id * 1000 + min(turn)) * 1000000), '%%Y-%%m-%%d %%H:%%M:%%S') AS created_at,
  strftime(make_timestamp((1700000000 + conv_id * 1000 + max(turn)) * 1000000), '%%Y-%%m-%%d %%H:%%M:%%S') AS modified_at FROM t GROUP BY conv_id"""
for _name, _make, _prefix in (("codex", codex_corpus, "x"), ("pi", pi_corpus, "p"), ("opencode", opencode_corpus, "o"), ("cursor", cursor_corpus, "u")):
    query(f"ingest_{_name}_sessions", _SPANS % _prefix)(lambda spark, sf_dir, make=_make: shown(make(spark, sf_dir).sessions.select("session_id", "workspace", "created_at", "modified_at")))
_CLAUDE = f"""{_TURNS}, s AS (SELECT *, CASE WHEN conv_id % 4 = 0 AND conv_id > 0 THEN concat('agent-', CAST(conv_id AS VARCHAR)) ELSE concat('c', CAST(conv_id AS VARCHAR)) END AS session_id FROM t)"""
query("ingest_events", f"""{_CLAUDE} SELECT session_id, seq AS message_seq, 'compaction' AS kind, 'auto' AS label, concat(CAST(length(text) AS VARCHAR), ' -> ', CAST(turn AS VARCHAR)) AS detail, 12 AS duration_ms FROM s WHERE role = 'system'
  UNION ALL SELECT session_id, seq, 'api_error', 'rate_limit', left(text, 20), 0 FROM s WHERE role = 'assistant' AND turn % 7 = 3""")(lambda spark, sf_dir: claude_corpus(spark, sf_dir).session_events.select("session_id", "message_seq", "kind", "label", F.left("detail", F.lit(20)).alias("detail"), "duration_ms"))
query("ingest_relations", f"""{_CLAUDE} SELECT DISTINCT session_id AS from_id, concat('c', CAST(conv_id // 2 AS VARCHAR)) AS to_id, 'subagent_of' AS kind FROM s WHERE conv_id % 4 = 0 AND conv_id > 0""")(lambda spark, sf_dir: claude_corpus(spark, sf_dir).relations.select("from_id", "to_id", "kind"))
query("ingest_all_turns", f"""{_CLAUDE} SELECT session_id, seq, role, CASE role WHEN 'system' THEN 'compaction' ELSE 'message' END AS kind, coalesce(text, '') AS text FROM s""")(lambda spark, sf_dir: claude_corpus(spark, sf_dir).messages.select("session_id", "seq", "role", "kind", "text"))


@query("ingest_codex_calls", "SELECT concat('x', CAST(conv_id AS VARCHAR)) AS session_id, concat('call-', CAST(conv_id AS VARCHAR), '-', CAST(turn AS VARCHAR)) AS call_id, row_number() OVER w - 1 AS seq, row_number() OVER w - 1 AS message_seq FROM conversations WHERE role IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def _codex_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call after each turn belongs to the last message before its line."""
    turns = _turns(spark, sf_dir)
    heads = _sessions(turns)
    path = "/logs/rollout-"
    meta = heads.select(*_line(path, F.lit(1), timestamp=F.col("at"), type=F.lit("session_meta"), payload=F.struct(F.concat(F.lit("x"), F.col("conv_id").cast("string")).alias("id"), F.lit("/w").alias("cwd"))))
    said = F.struct(F.lit("message").alias("type"), "role", F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content"))
    messages = turns.select(*_line(path, 10 + 10 * F.col("turn"), timestamp=F.col("at"), type=F.lit("response_item"), payload=said))
    call = F.struct(F.lit("function_call").alias("type"), F.lit("shell").alias("name"), F.concat_ws("-", F.lit("call"), "conv_id", "turn").alias("call_id"), F.lit("{}").alias("arguments"))
    calls = turns.select(*_line(path, 15 + 10 * F.col("turn"), timestamp=F.col("at"), type=F.lit("response_item"), payload=call))
    return codex.from_lines(spark, meta.union(messages).union(calls)).tool_calls.select("session_id", "call_id", "seq", "message_seq")
