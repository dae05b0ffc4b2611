"""Session logs of typed envelopes with cumulative token counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spoolsight.corpus import Corpus
from spoolsight.functions.scalars import EDIT_BYTES, EXCERPT_BYTES, command_line, diff_line_counts, first_patched_file, tool_kind, truncate_bytes
from spoolsight.operators.filters import synthetic_prompt
from spoolsight.operators.links import pair_results
from spoolsight.sources.lines import read_jsonl
from spoolsight.sources.shared import KEY, assemble, carried, conform, counter_deltas, file_stem, fold_sessions, numbered

AGENT = "codex"
COUNTS = ["input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens"]
_U = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"
PAYLOAD = (
    "id string, cwd string, git struct<branch:string>, model string, effort string, type string, role string, content string, name string, arguments string, input string, call_id string, output string,"
    f" duration_ms bigint, time_to_first_token_ms bigint, message string, info struct<total_token_usage:{_U},last_token_usage:{_U}>"
)


def ingest_codex(spark: SparkSession, *paths: str) -> Corpus:
    """Canonical tables from a folder of session logs. ``session_index.jsonl`` files name threads; a later name wins."""
    lines, issues = read_jsonl(spark, *paths)
    return from_lines(spark, lines.select("path", "line", "value"), issues.withColumn("agent", F.lit(AGENT)))


def thread_names(lines: DataFrame) -> DataFrame:
    rows = lines.where(F.col("path").endswith("session_index.jsonl")).select("line", F.from_json("value", "id string, thread_name string").alias("r"))
    return rows.groupBy(F.col("r.id").alias("session_id")).agg(F.max_by("r.thread_name", "line").alias("thread_name")).where("thread_name <> ''")


def _items(text: Column) -> Column:
    """Text of an item's content blocks, joined by line ends."""
    return F.array_join(F.transform(F.filter(F.from_json(text, "array<struct<type:string,text:string>>"), lambda b: b.text != ""), lambda b: b.text), "\n")


def from_lines(spark: SparkSession, lines: DataFrame, issues: DataFrame | None = None) -> Corpus:
    """The same from numbered lines.

    Model and effort hold from a turn's context on. A token count goes to the assistant message right before it, if no other
    message or call stands between and it has none yet; otherwise it makes an ``info`` message of its own.
    """
    raw = lines.where(~F.col("path").endswith("session_index.jsonl")).select("path", "line", F.from_json("value", "timestamp timestamp, type string, payload string").alias("r")).select("path", "line", "r.timestamp", F.col("r.type").alias("envelope"), F.from_json("r.payload", PAYLOAD).alias("p"), "r.payload")
    stem = F.regexp_replace(file_stem(F.col("path")), "^rollout-", "")
    own = raw.where("envelope = 'session_meta'").groupBy("path").agg(F.min_by("p.id", "line").alias("meta_id"))
    raw = raw.join(own, "path", "left").withColumns({"agent": F.lit(AGENT), "session_id": F.coalesce(F.nullif("meta_id", F.lit("")), stem)})
    context = F.col("envelope") == "turn_context"
    state = raw.withColumns({"model": F.coalesce(carried(F.when(context, F.nullif("p.model", F.lit("")))), F.lit("")), "effort": F.coalesce(carried(F.when(context, F.nullif("p.effort", F.lit("")))), F.lit("")), "cwd": F.coalesce(carried(F.nullif("p.cwd", F.lit(""))), F.lit(""))})

    kind = F.col("p.type")
    item, event = F.col("envelope") == "response_item", F.col("envelope") == "event_msg"
    message = item & (kind == "message")
    call = item & kind.isin("function_call", "custom_tool_call")
    count = event & (kind == "token_count") & F.col("p.info").isNotNull()
    assistant = message & (F.col("p.role") == "assistant")
    counted = counter_deltas(state.where(count).withColumns({"total": F.col("p.info.total_token_usage"), "last": F.col("p.info.last_token_usage")}), COUNTS).where("delta is not null").select(*KEY, "line", "delta")
    rows = state.join(counted, [*KEY, "line"], "left").withColumns({"is_message": F.coalesce(message, F.lit(False)), "is_count": F.col("delta").isNotNull(), "is_assistant": F.coalesce(assistant, F.lit(False))})
    done = event & (kind == "task_complete")
    holds = F.when(F.col("is_assistant"), F.col("line")).when(F.col("is_message") | F.coalesce(call | done, F.lit(False)) | F.col("is_count"), F.lit(-1))
    earlier = Window.partitionBy(*KEY).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("held", F.last(holds, ignorenulls=True).over(earlier))
    attached = rows.where("is_count and held > 0").select(*KEY, F.col("held").alias("line"), F.col("delta").alias("own_delta"))
    lone = F.col("is_count") & (F.coalesce("held", F.lit(-1)) <= 0)
    said = numbered(rows.where(F.col("is_message") | lone).join(attached, [*KEY, "line"], "left"), "seq", "line")
    said = said.withColumns({"text": F.when(F.col("is_message"), _items(F.col("p.content"))).otherwise(""), "role": F.when(F.col("is_message"), F.col("p.role")).otherwise("assistant"), "delta": F.coalesce("own_delta", "delta")})
    messages = said.select(*KEY, "seq", "line", "path", "role", F.when(F.col("is_message"), "message").otherwise("info").alias("kind"), F.col("timestamp").alias("created_at"), "model", "cwd", "text", F.when(F.col("role") == "assistant", F.col("effort")).otherwise("").alias("effort"), F.col("payload").alias("content"), F.col("p.git.branch").alias("branch"))
    plain = F.col("delta.input_tokens") - F.coalesce("delta.cached_input_tokens", F.lit(0)) - F.coalesce("delta.cache_write_input_tokens", F.lit(0))
    usage = said.where("delta is not null").select(
        *KEY, "seq", "model", F.col("timestamp").alias("created_at"), F.greatest(plain, F.lit(0)).alias("input"), F.col("delta.output_tokens").alias("output"), F.coalesce("delta.cached_input_tokens", F.lit(0)).alias("cache_read"),
        F.coalesce("delta.cache_write_input_tokens", F.lit(0)).alias("cache_write"), F.lit(0).alias("cache_write_1h"), F.coalesce("delta.reasoning_output_tokens", F.lit(0)).alias("reasoning"), F.lit(1).alias("parser_version"), (plain < 0).alias("clamped"), "path", "line",
    )
    odd = usage.where("clamped").select(F.lit(None).cast("bigint").alias("run_id"), F.lit("warning").alias("severity"), F.lit("usage").alias("category"), F.lit(AGENT).alias("agent"), "path", "line", F.lit("cached input exceeds input; ordinary input taken as 0").alias("detail"))

    spoken = said.select(*KEY, "line", F.col("seq").alias("m_seq"), F.lit(False).alias("is_call"))
    called = rows.where(call).select(*KEY, "line", F.lit(None).cast("bigint").alias("m_seq"), F.lit(True).alias("is_call"))
    before = spoken.unionByName(called).withColumn("m_seq", F.last("m_seq", ignorenulls=True).over(earlier)).where("is_call").select(*KEY, "line", "m_seq")
    used = numbered(rows.where(call).join(before, [*KEY, "line"]), "seq", "line")
    function = kind == "function_call"
    arguments = F.coalesce("p.arguments", F.lit("{}"))
    arg = lambda name: F.get_json_object(arguments, f"$.{name}")
    text = F.when(function, arg("input")).otherwise(F.col("p.input"))
    patch = F.col("p.name") == "apply_patch"
    sized = diff_line_counts(F.split(F.coalesce(text, F.lit("")), "\n"))
    script = tool_kind(F.lit(AGENT), F.col("p.name")) == "script"
    calls = used.select(
        *KEY, "seq", F.coalesce("m_seq", F.lit(0)).alias("message_seq"), F.col("p.call_id").alias("call_id"), F.col("p.name").alias("name"), tool_kind(F.lit(AGENT), F.col("p.name")).alias("kind"),
        F.when(function, arguments).otherwise(F.to_json(F.struct(F.col("p.input").alias("input")))).alias("input"), F.when(patch, first_patched_file(text)).otherwise(arg("path")).alias("file_path"),
        F.when(patch, "").when(script, text).otherwise(command_line(arguments)).alias("command"), truncate_bytes(arg("old_text"), EDIT_BYTES).alias("old_text"), truncate_bytes(F.coalesce(arg("new_text"), arg("content")), EDIT_BYTES).alias("new_text"),
        F.col("timestamp").alias("started_at"), F.unix_millis("timestamp").alias("started_ms"), F.when(patch, sized.added).alias("lines_added"), F.when(patch, sized.removed).alias("lines_removed"),
    )
    output = F.coalesce(F.get_json_object("p.output", "$.output"), F.nullif(_items(F.col("p.output")), F.lit("")), F.col("p.output"), F.lit(""))
    results = rows.where(item & kind.isin("function_call_output", "custom_tool_call_output") & (F.coalesce("p.call_id", F.lit("")) != "")).select(*KEY, F.col("p.call_id").alias("call_id"), "line", F.lit("ok").alias("status"), truncate_bytes(F.trim(output), EXCERPT_BYTES).alias("excerpt"), output.alias("result"), F.unix_millis("timestamp").alias("at_ms"), F.lit(None).cast("bigint").alias("lines_added"), F.lit(None).cast("bigint").alias("lines_removed"))
    bare = conform(calls, "tool_calls").withColumns({n: F.lit(None).cast("string") for n in ("status", "excerpt", "result")})

    turns = rows.where(done & (F.coalesce("p.duration_ms", F.lit(0)) > 0)).select(*KEY, F.lit(0).cast("bigint").alias("message_seq"), F.col("timestamp").alias("at"), F.lit("turn").alias("kind"), F.lit("").alias("label"), F.lit("").alias("status"), F.col("p.duration_ms").alias("duration_ms"), F.lit("").alias("detail"), F.to_json(F.struct(F.col("p.time_to_first_token_ms").alias("firstTokenMs"))).alias("payload"))
    names = thread_names(lines)
    prompt = (F.col("role") == "user") & (F.trim("text") != "") & ~synthetic_prompt(F.lit(AGENT), F.col("text"))
    folds = messages.select(*KEY, "line", F.col("created_at").alias("at"), "cwd", F.lit(None).cast("string").alias("git_branch"), F.when(prompt, F.trim("text")).alias("title"), F.lit(1).alias("title_priority"), F.col("path").alias("source_path"))
    meta = raw.where("envelope = 'session_meta'").select(*KEY, "line", F.col("timestamp").alias("at"), F.col("p.cwd").alias("cwd"), F.col("p.git.branch").alias("git_branch"), F.lit(None).cast("string").alias("title"), F.lit(0).alias("title_priority"), F.col("path").alias("source_path"))
    named = raw.select(*KEY).distinct().join(names, "session_id").select(*KEY, F.lit(0).cast("bigint").alias("line"), F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast("string").alias("cwd"), F.lit(None).cast("string").alias("git_branch"), F.col("thread_name").alias("title"), F.lit(3).alias("title_priority"), F.lit(None).cast("string").alias("source_path"))
    found = odd if issues is None else issues.unionByName(odd)
    return assemble(spark, sessions=fold_sessions(folds.unionByName(meta).unionByName(named)), messages=messages, usage=usage, tool_calls=pair_results(bare, results), tool_results=results, session_events=turns, issues=found)
