"""Session logs with one JSON record per line, one file per session, sub-agents in files of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spoolsight.corpus import Corpus
from spoolsight.functions.scalars import DETAIL_BYTES, EDIT_BYTES, EXCERPT_BYTES, content_text, diff_line_counts, joined_thinking, text_line_count, tool_kind, truncate_bytes
from spoolsight.operators.filters import synthetic_prompt
from spoolsight.operators.links import pair_results
from spoolsight.sources.lines import read_jsonl
from spoolsight.sources.shared import KEY, assemble, conform, file_stem, fold_sessions, numbered

AGENT = "claude"
LINE = (
    "type string, uuid string, parentUuid string, isSidechain boolean, isMeta boolean, sessionId string, cwd string, gitBranch string, timestamp timestamp, requestId string, costUSD double, customTitle string, aiTitle string, content string,"
    " message struct<id:string,role:string,model:string,content:string,usage:struct<input_tokens:bigint,output_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint,service_tier:string,cache_creation:struct<ephemeral_1h_input_tokens:bigint>>>,"
    " isApiErrorMessage boolean, apiErrorStatus int, error string, quotaLimits struct<rateLimitType:string>, toolDenialKind string, subtype string, durationMs bigint, messageCount int, effort string,"
    " compactMetadata struct<trigger:string,preTokens:bigint,postTokens:bigint,durationMs:bigint>, attachment struct<type:string,hookEvent:string,hookName:string,command:string,exitCode:int,durationMs:bigint>,"
    " toolUseResult string, prNumber int, prUrl string, prRepository string"
)
BLOCKS = "array<struct<type:string,text:string,thinking:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean,source:struct<media_type:string>>>"
INTERRUPTED = "[Request interrupted by user"


def ingest_claude(spark: SparkSession, *paths: str) -> Corpus:
    """Canonical tables from a folder of session logs. Unknown record types are skipped, bad lines become issues."""
    lines, issues = read_jsonl(spark, *paths)
    return from_lines(spark, lines.select("path", "line", "value"), issues.withColumn("agent", F.lit(AGENT)))


def from_lines(spark: SparkSession, lines: DataFrame, issues: DataFrame | None = None) -> Corpus:
    """The same from numbered lines."""
    raw = lines.select("path", "line", F.from_json("value", LINE).alias("r")).select("path", "line", "r.*").where("type is not null")
    raw = raw.withColumns({"agent": F.lit(AGENT), "session_id": file_stem(F.col("path")), "nested": F.col("path").contains("/subagents/")})
    said = raw.where(F.col("type").isin("user", "assistant", "system"))
    body = F.coalesce("message.content", F.lit(""))
    quoted = F.when(F.ltrim(body).startswith("["), body).when(body == "", F.coalesce("content", F.lit(""))).otherwise(body)
    said = numbered(said.withColumns({"blocks": F.when(F.ltrim(body).startswith("["), F.from_json(body, BLOCKS)), "body": quoted}), "seq", "line")
    text = F.when(F.col("blocks").isNotNull(), F.array_join(F.transform(F.filter("blocks", lambda b: (b.type == "text") & (b.text != "")), lambda b: b.text), "\n")).otherwise(F.col("body"))
    pointer = lambda i: F.concat(F.lit("/content/"), i.cast("string"), F.lit("/source/data"))
    images = F.filter(F.transform("blocks", lambda b, i: F.when(b.type == "image", F.struct(b.source.media_type.alias("media_type"), pointer(i).alias("pointer")))), lambda x: x.isNotNull())
    messages = said.withColumns({
        "text": text, "images": images, "thinking": joined_thinking(F.transform(F.filter(F.coalesce("blocks", F.array().cast(BLOCKS)), lambda b: b.type == "thinking"), lambda b: b.thinking)),
        "role": F.coalesce("message.role", "type"), "kind": F.when(F.col("subtype") == "compact_boundary", "compaction").otherwise("message"), "is_side": F.coalesce("isSidechain", F.lit(False)) & ~F.col("nested"),
    })

    results = said.select(*KEY, "line", "timestamp", "toolUseResult", F.explode(F.filter("blocks", lambda b: b.type == "tool_result")).alias("b"))
    patch = F.flatten(F.transform(F.from_json("toolUseResult", "structuredPatch array<struct<lines:array<string>>>").structuredPatch, lambda p: p.lines))
    made = F.from_json("toolUseResult", "type string, content string")
    counts = F.when(F.size(patch) > 0, diff_line_counts(patch)).when(made.type == "create", F.struct(text_line_count(F.coalesce(made.content, F.lit(""))).alias("added"), F.lit(0).cast("bigint").alias("removed")))
    outcome = F.coalesce("b.content", F.lit(""))
    shown = F.when(F.ltrim(outcome).startswith("["), content_text(outcome)).otherwise(outcome)
    results = results.select(*KEY, F.col("b.tool_use_id").alias("call_id"), "line", F.when(F.coalesce("b.is_error", F.lit(False)), "error").otherwise("ok").alias("status"), truncate_bytes(F.trim(shown), EXCERPT_BYTES).alias("excerpt"), shown.alias("result"), F.unix_millis("timestamp").alias("at_ms"), counts.added.alias("lines_added"), counts.removed.alias("lines_removed"))

    used = said.select(*KEY, "line", F.col("seq").alias("message_seq"), "timestamp", F.posexplode(F.filter("blocks", lambda b: b.type == "tool_use")).alias("pos", "b"))
    arg = lambda name: F.get_json_object("b.input", f"$.{name}")
    calls = numbered(used, "seq", "line", "pos").select(
        *KEY, "seq", "message_seq", F.col("b.id").alias("call_id"), F.col("b.name").alias("name"), tool_kind(F.lit(AGENT), F.col("b.name")).alias("kind"), F.col("b.input").alias("input"),
        F.coalesce(arg("file_path"), arg("notebook_path"), arg("path")).alias("file_path"), arg("command").alias("command"), truncate_bytes(arg("old_string"), EDIT_BYTES).alias("old_text"),
        truncate_bytes(F.coalesce(arg("new_string"), arg("content")), EDIT_BYTES).alias("new_text"), F.col("timestamp").alias("started_at"), F.unix_millis("timestamp").alias("started_ms"),
    )

    usage = said.where("message.usage is not null").select(
        *KEY, "seq", F.coalesce("message.id", F.lit("")).alias("content_id"), F.coalesce("requestId", F.lit("")).alias("request_id"), F.lit("").alias("provider"), F.col("message.model").alias("model"), F.col("timestamp").alias("created_at"),
        F.col("message.usage.input_tokens").alias("input"), F.col("message.usage.output_tokens").alias("output"), F.col("message.usage.cache_read_input_tokens").alias("cache_read"), F.col("message.usage.cache_creation_input_tokens").alias("cache_write"),
        F.coalesce("message.usage.cache_creation.ephemeral_1h_input_tokens", F.lit(0)).alias("cache_write_1h"), F.lit(0).alias("reasoning"), F.col("message.usage.service_tier").alias("service_tier"),
        F.round(F.col("costUSD") * 1e9).cast("bigint").alias("reported_nanos"), F.lit(1).alias("parser_version"),
    )

    prompt = (F.col("role") == "user") & ~F.col("is_side") & ~F.coalesce("isMeta", F.lit(False)) & (F.trim("text") != "") & ~synthetic_prompt(F.col("agent"), F.col("text"))
    titles = messages.select(*KEY, "line", F.col("timestamp").alias("at"), "cwd", F.col("gitBranch").alias("git_branch"), F.when(prompt, F.trim("text")).alias("title"), F.lit(1).alias("title_priority"), F.col("path").alias("source_path"))
    named = raw.where("customTitle is not null or aiTitle is not null").join(said.select(*KEY).distinct(), KEY, "left_semi").select(*KEY, "line", F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast("string").alias("cwd"), F.lit(None).cast("string").alias("git_branch"), F.coalesce("customTitle", "aiTitle").alias("title"), F.when(F.col("customTitle").isNotNull(), 3).otherwise(2).alias("title_priority"), F.col("path").alias("source_path"))

    foreign = said.where(~F.col("nested") & (F.coalesce("sessionId", F.lit("")) != "") & (F.col("sessionId") != F.col("session_id")))
    copied = foreign.groupBy(*KEY).agg(F.max_by("sessionId", "line").alias("to_id"), F.max_by("uuid", "line").alias("branchUuid"), F.count(F.lit(1)).alias("copiedEntries"))
    resumed = copied.select("agent", F.col("session_id").alias("from_id"), "to_id", F.lit("resumed_from").alias("kind"), F.to_json(F.struct(F.lit("copied-history").alias("source"), "branchUuid", "copiedEntries")).alias("evidence"))
    by_path = F.regexp_extract("path", r"/([^/]+)/subagents/", 1)
    below = raw.where("nested").groupBy("agent", "session_id", "path").agg(F.min_by("sessionId", F.when(F.col("sessionId").isNotNull(), F.col("line"))).alias("first_id"))
    parent = F.coalesce(F.nullif(by_path, F.lit("")), F.col("first_id"))
    nested = below.select("agent", F.col("session_id").alias("from_id"), parent.alias("to_id"), F.lit("subagent_of").alias("kind"), F.lit("{}").alias("evidence"))

    return assemble(
        spark, sessions=fold_sessions(titles.unionByName(named)), relations=resumed.unionByName(nested).withColumns({"resolved": F.lit(False), "attempts": F.lit(0)}), usage=usage,
        messages=messages.select(*KEY, "seq", F.col("uuid").alias("external_id"), F.col("parentUuid").alias("parent_id"), F.col("message.id").alias("content_id"), "role", "kind", F.col("timestamp").alias("created_at"), F.col("message.model").alias("model"), "cwd", F.col("is_side").alias("is_sidechain"), "text", "thinking", "images", "effort", F.col("requestId").alias("request_id"), F.to_json(F.struct(F.col("message.content").alias("content"))).alias("content")),
        tool_calls=pair_results(_unpaired(calls), results), tool_results=results, session_events=session_events(raw, messages, results), **({"issues": issues} if issues is not None else {}),
    )


def _unpaired(calls: DataFrame) -> DataFrame:
    """Calls whose outcome is still to come."""
    blank = conform(calls, "tool_calls")
    return blank.withColumns({n: F.lit(None).cast("string") for n in ("status", "excerpt", "result")})


def session_events(raw: DataFrame, messages: DataFrame, results: DataFrame) -> DataFrame:
    """Events that lines record; of a message's line the first that fits: failed request, denied tool, compaction, turn,
    interruption. Hooks and pull requests have lines of their own."""
    first = results.groupBy(*KEY, "line").agg(F.min_by("excerpt", "call_id").alias("excerpt"), F.min("call_id").alias("toolUseId"))
    rows = messages.join(first, [*KEY, "line"], "left")
    c, none = F.col, F.lit(None).cast("string")
    event = lambda kind, label="", status="", ms=0, detail="", payload=none: F.struct(*(x.alias(n) for n, x in {"kind": F.lit(kind), "label": label if not isinstance(label, str) else F.lit(label), "status": status if not isinstance(status, str) else F.lit(status), "duration_ms": (ms if not isinstance(ms, int) else F.lit(ms)).cast("bigint"), "detail": truncate_bytes(detail if not isinstance(detail, str) else F.lit(detail), DETAIL_BYTES), "payload": payload}.items()))
    cm = c("compactMetadata")
    chosen = (
        F.when(F.coalesce("isApiErrorMessage", F.lit(False)), event("api_error", F.coalesce(F.nullif("error", F.lit("")), F.lit("error")), F.coalesce(F.nullif("apiErrorStatus", F.lit(0)).cast("string"), F.lit("")), 0, F.trim("text"), F.when(c("quotaLimits.rateLimitType").isNotNull(), F.to_json("quotaLimits"))))
        .when(F.coalesce("toolDenialKind", F.lit("")) != "", event("tool_denied", c("toolDenialKind"), "", 0, F.coalesce("excerpt", F.lit("")), F.when(c("toolUseId").isNotNull(), F.to_json(F.struct("toolUseId")))))
        .when((c("type") == "system") & (c("subtype") == "compact_boundary") & cm.isNotNull(), event("compaction", F.coalesce(cm.trigger, F.lit("")), "", F.coalesce(cm.durationMs, F.lit(0)), F.concat(F.coalesce(cm.preTokens, F.lit(0)).cast("string"), F.lit(" -> "), F.coalesce(cm.postTokens, F.lit(0)).cast("string")), F.to_json(F.struct(cm.preTokens.alias("preTokens"), cm.postTokens.alias("postTokens")))))
        .when((c("type") == "system") & (c("subtype") == "turn_duration") & (c("durationMs") > 0), event("turn", "", "", c("durationMs"), "", F.to_json(F.struct("messageCount"))))
        .when((c("role") == "user") & F.trim("text").startswith(INTERRUPTED), event("aborted", "user", "", 0, F.trim("text")))
    )
    from_messages = rows.select(*KEY, c("seq").alias("message_seq"), c("timestamp").alias("at"), chosen.alias("e")).where("e is not null").select(*KEY, "message_seq", "at", "e.*")
    a = c("attachment")
    status = F.when(a.type == "hook_blocking_error", "blocked").when(F.coalesce(a.exitCode, F.lit(0)) != 0, "error").otherwise("ok")
    hooks = raw.where(a.type.isin("hook_success", "async_hook_response", "hook_blocking_error")).select(*KEY, F.lit(0).cast("bigint").alias("message_seq"), c("timestamp").alias("at"), F.lit("hook").alias("kind"), F.coalesce(a.hookEvent, F.lit("")).alias("label"), status.alias("status"), F.coalesce(a.durationMs, F.lit(0)).alias("duration_ms"), truncate_bytes(F.coalesce(F.nullif(a.command, F.lit("")), a.hookName, F.lit("")), DETAIL_BYTES).alias("detail"), F.to_json(F.struct(a.hookName.alias("hookName"), a.exitCode.alias("exitCode"))).alias("payload"))
    links = raw.where("prUrl <> ''").withColumn("_r", F.row_number().over(Window.partitionBy(*KEY, "prUrl").orderBy("line"))).where("_r = 1")
    pulls = links.select(*KEY, F.lit(0).cast("bigint").alias("message_seq"), c("timestamp").alias("at"), F.lit("pr_link").alias("kind"), F.coalesce("prRepository", F.lit("")).alias("label"), F.lit("").alias("status"), F.lit(0).cast("bigint").alias("duration_ms"), c("prUrl").alias("detail"), F.to_json(F.struct("prNumber")).alias("payload"))
    return from_messages.unionByName(hooks).unionByName(pulls)


def with_subagent_types(relations: DataFrame, metas: DataFrame) -> DataFrame:
    """Edges with the agent type of sibling meta files: ``path`` (``.../agent-<id>.meta.json`` or ``.json``) and ``value``."""
    meta = metas.select(F.regexp_replace(F.substring_index("path", "/", -1), r"(\.meta)?\.json$", "").alias("from_id"), F.from_json("value", "agentType string, description string, toolUseId string, parentAgentId string").alias("m"))
    joined = relations.join(meta, "from_id", "left")
    evidence = F.when(F.col("m").isNotNull(), F.to_json("m")).otherwise(F.col("evidence"))
    parent = F.coalesce(F.concat(F.lit("agent-"), F.nullif("m.parentAgentId", F.lit(""))), F.col("to_id"))
    sub = F.col("kind") == "subagent_of"
    return joined.select(*(F.when(sub, evidence).otherwise(F.col(c)).alias(c) if c == "evidence" else F.when(sub, parent).otherwise(F.col(c)).alias(c) if c == "to_id" else F.col(c) for c in relations.columns))
