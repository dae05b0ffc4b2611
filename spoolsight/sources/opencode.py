"""Sessions, messages and parts as documents, or as exported rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoolsight.corpus import Corpus
from spoolsight.functions.scalars import EDIT_BYTES, EXCERPT_BYTES, TITLE_BYTES, canonical_path, from_millis, joined_thinking, tool_kind, truncate_bytes
from spoolsight.sources.shared import KEY, assemble, numbered

AGENT = "opencode"
PART = "struct<id:string,type:string,text:string,tool:string,callID:string,state:struct<status:string,input:string,output:string>>"
SESSION = "id string, title string, parentID string, directory string, time struct<created:bigint,updated:bigint>"
MESSAGE = f"id string, sessionID string, role string, providerID string, modelID string, time struct<created:bigint>, cost double, tokens struct<input:bigint,output:bigint,reasoning:bigint,cache:struct<read:bigint,write:bigint>>, parts array<{PART}>"
SEPARATE_PART = "id string, messageID string, type string, text string, tool string, callID string, state struct<status:string,input:string,output:string>"


def read_documents(spark: SparkSession, sessions: str, messages: str, parts: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Session and message documents; parts that lie in files of their own are put into their messages, in id order."""
    read = lambda kind, path: spark.read.schema(kind).json(path, multiLine=True, recursiveFileLookup=True)
    s, m = read(SESSION, sessions), read(MESSAGE, messages)
    if parts is not None:
        own = read(SEPARATE_PART, parts)
        value = F.struct("id", "type", "text", "tool", "callID", "state")
        grouped = own.groupBy(F.col("messageID").alias("id")).agg(F.array_sort(F.collect_list(value)).alias("own_parts"))
        m = m.join(grouped, "id", "left").withColumn("parts", F.coalesce("parts", "own_parts")).drop("own_parts")
    return s, m


def ingest_opencode(spark: SparkSession, native: tuple[DataFrame, DataFrame], legacy: tuple[DataFrame, DataFrame] | None = None) -> Corpus:
    """Canonical tables from (sessions, messages). Native rows take the place of legacy documents of the same session.

    Reasoning is counted on top of output here, so it is added once, at this place.
    """
    sessions, messages = native
    if legacy is not None:
        old = legacy[0].join(sessions.select("id"), "id", "left_anti")
        messages = messages.unionByName(legacy[1].join(old.select(F.col("id").alias("sessionID")), "sessionID", "left_semi").select(*messages.columns))
        sessions = sessions.unionByName(old.select(*sessions.columns))
    s = sessions.select(F.lit(AGENT).alias("agent"), F.col("id").alias("session_id"), truncate_bytes(F.trim(F.coalesce("title", F.lit(""))), TITLE_BYTES).alias("title"), from_millis(F.col("time.created")).alias("created_at"), from_millis(F.col("time.updated")).alias("modified_at"), F.col("directory").alias("cwd"), canonical_path(F.coalesce("directory", F.lit(""))).alias("workspace"), F.lit("ingest").alias("origin"), "parentID")
    m = messages.join(s.select(F.col("session_id").alias("sessionID"), F.col("cwd").alias("_cwd")), "sessionID").withColumns({"agent": F.lit(AGENT), "session_id": F.col("sessionID"), "at": from_millis(F.col("time.created"))})
    m = numbered(m, "seq", "at", "id").withColumn("parts", F.coalesce("parts", F.array().cast(f"array<{PART}>")))
    texts = F.transform(F.filter("parts", lambda p: (p.type == "text") & (p.text != "")), lambda p: p.text)
    said = m.select(*KEY, "seq", F.col("id").alias("external_id"), F.col("id").alias("content_id"), "role", F.lit("message").alias("kind"), F.col("at").alias("created_at"), F.col("providerID").alias("provider"), F.col("modelID").alias("model"), F.col("_cwd").alias("cwd"), F.array_join(texts, "\n").alias("text"), joined_thinking(F.transform(F.filter("parts", lambda p: p.type == "reasoning"), lambda p: p.text)).alias("thinking"))
    zero = F.lit(0)
    usage = m.where("tokens is not null or cost is not null").select(*KEY, "seq", F.col("id").alias("content_id"), F.col("id").alias("request_id"), F.col("providerID").alias("provider"), F.col("modelID").alias("model"), F.col("at").alias("created_at"), F.coalesce("tokens.input", zero).alias("input"), (F.coalesce("tokens.output", zero) + F.coalesce("tokens.reasoning", zero)).alias("output"), F.coalesce("tokens.cache.read", zero).alias("cache_read"), F.coalesce("tokens.cache.write", zero).alias("cache_write"), zero.alias("cache_write_1h"), F.coalesce("tokens.reasoning", zero).alias("reasoning"), F.round(F.col("cost") * 1e9).cast("bigint").alias("reported_nanos"), zero.alias("parser_version"))
    used = m.select(*KEY, F.col("seq").alias("message_seq"), "at", F.posexplode(F.filter("parts", lambda p: (p.type == "tool") & (p.tool != ""))).alias("pos", "p"))
    arg = lambda *names: F.coalesce(*(F.get_json_object("p.state.input", f"$.{n}") for n in names), F.lit(""))
    status = F.when(F.col("p.state.status") == "completed", "ok").otherwise(F.coalesce("p.state.status", F.lit("")))
    calls = numbered(used, "seq", "message_seq", "pos").select(*KEY, "seq", "message_seq", F.col("p.callID").alias("call_id"), F.col("p.tool").alias("name"), tool_kind(F.lit(AGENT), F.col("p.tool")).alias("kind"), F.col("p.state.input").alias("input"), status.alias("status"), truncate_bytes(F.coalesce("p.state.output", F.lit("")), EXCERPT_BYTES).alias("excerpt"), F.col("p.state.output").alias("result"), arg("filePath").alias("file_path"), arg("command").alias("command"), truncate_bytes(arg("oldString"), EDIT_BYTES).alias("old_text"), truncate_bytes(arg("newString", "content"), EDIT_BYTES).alias("new_text"), F.col("at").alias("started_at"), F.unix_millis("at").alias("started_ms"))
    edges = s.where("parentID <> ''").select("agent", F.col("session_id").alias("from_id"), F.col("parentID").alias("to_id"), F.lit("fork_of").alias("kind"), F.lit("{}").alias("evidence"), F.lit(False).alias("resolved"), zero.alias("attempts"))
    return assemble(spark, sessions=s, relations=edges, messages=said, usage=usage, tool_calls=calls)
