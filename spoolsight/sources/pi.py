"""Session logs whose first line is the session's header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoolsight.corpus import Corpus
from spoolsight.functions.scalars import DETAIL_BYTES, EDIT_BYTES, EXCERPT_BYTES, content_text, diff_line_counts, error_class, joined_thinking, tool_kind, truncate_bytes
from spoolsight.operators.filters import synthetic_prompt
from spoolsight.operators.links import pair_results
from spoolsight.sources.lines import read_jsonl
from spoolsight.sources.shared import KEY, assemble, carried, conform, fold_sessions, numbered

AGENT = "pi"
_U = "struct<input:bigint,output:bigint,cacheRead:bigint,cacheWrite:bigint,totalTokens:bigint,cost:struct<total:double>>"
ENTRY = (
    "type string, id string, parentId string, timestamp timestamp, cwd string, parentSession string, provider string, modelId string, thinkingLevel string, summary string, tokensBefore bigint, fromId string, name string, content string,"
    f" usage {_U}, message struct<role:string,provider:string,model:string,thinkingLevel:string,stopReason:string,errorMessage:string,toolCallId:string,toolName:string,isError:boolean,content:string,usage:{_U},"
    "nestedCalls:struct<calls:array<struct<id:string,name:string,status:string,error:string,arguments:string,durationMs:double>>>,details:struct<patch:string>>"
)
BLOCKS = "array<struct<type:string,text:string,thinking:string,id:string,name:string,arguments:string>>"
KINDS = {"message": "message", "compaction": "compaction", "branch_summary": "branch_point", "model_change": "model_change", "custom_message": "info", "label": "info"}


def ingest_pi(spark: SparkSession, *paths: str) -> Corpus:
    """Canonical tables from a folder of session logs; a file without header becomes an issue."""
    lines, issues = read_jsonl(spark, *paths)
    return from_lines(spark, lines.select("path", "line", "value"), issues.withColumn("agent", F.lit(AGENT)))


def from_lines(spark: SparkSession, lines: DataFrame, issues: DataFrame | None = None) -> Corpus:
    """The same from numbered lines. Provider and model are carried from change to change, as one: a change that names only
    a model clears the provider."""
    entry = lines.select("path", "line", F.from_json("value", ENTRY).alias("e")).select("path", "line", "e.*").withColumn("agent", F.lit(AGENT))
    first = entry.groupBy("path").agg(F.min_by(F.struct("type", "id", "cwd", "timestamp", "parentSession"), "line").alias("h"))
    headed = entry.join(first.where("h.type = 'session'").select("path", F.col("h.id").alias("session_id"), F.col("h.cwd").alias("session_cwd")), "path")
    bad = first.where("h.type <> 'session' or h.type is null").select(F.lit(None).cast("bigint").alias("run_id"), F.lit("error").alias("severity"), F.lit("format").alias("category"), F.lit(AGENT).alias("agent"), "path", F.lit(1).cast("bigint").alias("line"), F.lit("first line is no session header").alias("detail"))
    change = F.when(F.col("type") == "model_change", F.struct(F.coalesce("provider", F.lit("")).alias("provider"), F.coalesce("modelId", F.lit("")).alias("model")))
    state = headed.withColumns({"now": carried(change), "level": carried(F.when(F.col("type") == "thinking_level_change", F.col("thinkingLevel")))})

    body = F.coalesce("message.content", "content", F.lit(""))
    result = F.col("message.role") == "toolResult"
    shown = state.where(F.col("type").isin(*KINDS)).withColumn("blocks", F.when(F.ltrim(body).startswith("["), F.from_json(body, BLOCKS)))
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair)), F.col("type"))
    text = F.when(F.col("type").isin("compaction", "branch_summary"), F.coalesce("summary", F.lit(""))).when(F.col("blocks").isNotNull(), content_text(body)).otherwise(body)
    said = numbered(shown, "seq", "line").withColumns({
        "kind": kind, "text": text, "role": F.when(result, "tool").otherwise(F.coalesce("message.role", F.lit("system"))), "use": F.coalesce("message.usage", "usage"),
        "model": F.coalesce("message.model", "now.model", F.lit("")), "provider": F.coalesce("message.provider", F.when(F.col("message.model").isNull(), F.col("now.provider")), F.lit("")),
        "thinking": joined_thinking(F.transform(F.filter(F.coalesce("blocks", F.array().cast(BLOCKS)), lambda b: b.type == "thinking"), lambda b: b.thinking)),
    })
    said = said.withColumn("effort", F.when((F.col("role") == "assistant") & (F.col("kind") == "message"), F.coalesce("message.thinkingLevel", "level", F.lit(""))).otherwise(""))
    usage = said.where("use is not null").select(*KEY, "seq", F.coalesce("id", F.lit("")).alias("content_id"), "provider", "model", F.col("timestamp").alias("created_at"), F.col("use.input").alias("input"), F.col("use.output").alias("output"), F.col("use.cacheRead").alias("cache_read"), F.col("use.cacheWrite").alias("cache_write"), F.lit(0).alias("cache_write_1h"), F.lit(0).alias("reasoning"), F.round(F.col("use.cost.total") * 1e9).cast("bigint").alias("reported_nanos"), F.lit(1).alias("parser_version"))

    own = said.select(*KEY, "line", F.col("seq").alias("message_seq"), "timestamp", F.lit(0).alias("rank"), F.posexplode(F.filter("blocks", lambda b: b.type == "toolCall")).alias("pos", "b")).select(*KEY, "line", "message_seq", "timestamp", "rank", "pos", F.col("b.id").alias("call_id"), F.col("b.name").alias("name"), F.col("b.arguments").alias("input"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("excerpt"), F.lit(None).cast("bigint").alias("duration_ms"))
    nested = said.where("message.nestedCalls is not null").select(*KEY, "line", F.col("seq").alias("message_seq"), "timestamp", F.lit(1).alias("rank"), F.posexplode("message.nestedCalls.calls").alias("pos", "n")).select(*KEY, "line", "message_seq", "timestamp", "rank", "pos", F.col("n.id").alias("call_id"), F.col("n.name").alias("name"), F.col("n.arguments").alias("input"), F.when(F.col("n.status") == "error", "error").otherwise("ok").alias("status"), truncate_bytes(F.coalesce("n.error", F.lit("")), EXCERPT_BYTES).alias("excerpt"), F.round("n.durationMs").cast("bigint").alias("duration_ms"))
    arg = lambda *names: F.coalesce(*(F.get_json_object("input", f"$.{n}") for n in names), F.lit(""))
    calls = numbered(own.unionByName(nested), "seq", "line", "rank", "pos").withColumns({
        "kind": tool_kind(F.lit(AGENT), F.col("name")), "file_path": arg("path", "file_path"), "command": arg("command", "code"), "old_text": truncate_bytes(arg("oldText", "old_string"), EDIT_BYTES),
        "new_text": truncate_bytes(arg("newText", "new_string", "content"), EDIT_BYTES), "started_at": F.col("timestamp"), "started_ms": F.unix_millis("timestamp"),
    })
    calls = conform(calls, "tool_calls").withColumns({n: F.nullif(n, F.lit("")) for n in ("status", "excerpt", "result")})
    sized = diff_line_counts(F.split(F.col("message.details.patch"), "\n"))
    results = said.where(result).select(*KEY, F.col("message.toolCallId").alias("call_id"), "line", F.when(F.coalesce("message.isError", F.lit(False)), "error").otherwise("ok").alias("status"), truncate_bytes(F.trim("text"), EXCERPT_BYTES).alias("excerpt"), F.col("text").alias("result"), F.unix_millis("timestamp").alias("at_ms"), sized.added.alias("lines_added"), sized.removed.alias("lines_removed"))

    stopped = F.coalesce("message.errorMessage", F.lit(""))
    events = said.select(
        *KEY, F.col("seq").alias("message_seq"), F.col("timestamp").alias("at"),
        F.when(F.col("type") == "compaction", "compaction").when(F.col("message.stopReason") == "aborted", "aborted").when(F.col("message.stopReason") == "error", "api_error").alias("kind"),
        F.when(F.col("message.stopReason") == "error", error_class(stopped)).when(F.col("message.stopReason") == "aborted", "user").otherwise("").alias("label"), F.lit("").alias("status"), F.lit(0).cast("bigint").alias("duration_ms"),
        truncate_bytes(F.trim(stopped), DETAIL_BYTES).alias("detail"), F.when(F.col("type") == "compaction", F.to_json(F.struct(F.col("tokensBefore").alias("preTokens")))).alias("payload"),
    ).where("kind is not null")
    edges = headed.where("type = 'session' and parentSession <> ''").select("agent", F.col("session_id").alias("from_id"), F.col("parentSession").alias("to_id"), F.lit("fork_of").alias("kind"), F.lit('{"source":"header.parentSession"}').alias("evidence"), F.lit(False).alias("resolved"), F.lit(0).alias("attempts"))
    prompt = (F.col("role") == "user") & (F.trim("text") != "") & ~synthetic_prompt(F.lit(AGENT), F.col("text"))
    folds = said.select(*KEY, "line", F.col("timestamp").alias("at"), F.col("session_cwd").alias("cwd"), F.lit(None).cast("string").alias("git_branch"), F.when(prompt, F.trim("text")).alias("title"), F.lit(1).alias("title_priority"), F.col("path").alias("source_path"))
    heads = headed.where("type in ('session', 'session_info')").select(*KEY, "line", F.col("timestamp").alias("at"), F.col("session_cwd").alias("cwd"), F.lit(None).cast("string").alias("git_branch"), F.when(F.col("type") == "session_info", F.col("name")).alias("title"), F.lit(3).alias("title_priority"), F.col("path").alias("source_path"))
    messages = said.select(*KEY, "seq", F.col("id").alias("external_id"), F.col("parentId").alias("parent_id"), F.col("id").alias("content_id"), "role", "kind", F.col("timestamp").alias("created_at"), "provider", "model", F.col("session_cwd").alias("cwd"), "text", "thinking", "effort")
    return assemble(spark, sessions=fold_sessions(folds.unionByName(heads)), relations=edges, messages=messages, usage=usage, tool_calls=pair_results(calls, results), tool_results=results, session_events=events, issues=bad if issues is None else issues.unionByName(bad))
