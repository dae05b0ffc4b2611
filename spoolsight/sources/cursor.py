"""Exported key/value rows with JSON in hexadecimal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoolsight.corpus import Corpus
from spoolsight.functions.scalars import TITLE_BYTES, canonical_path, content_text, from_millis, truncate_bytes
from spoolsight.sources.shared import KEY, assemble, numbered

AGENT = "cursor"
META = "name string, agentId string, createdAt bigint, workspaceRoot string"
BLOB = "role string, content string, timestamp bigint, model string, usage struct<inputTokens:bigint,outputTokens:bigint,cacheReadTokens:bigint,cacheWriteTokens:bigint>"


def unhex_json(data: Column) -> Column:
    """Text of hexadecimal UTF-8; null where it is damaged."""
    raw = F.when(F.trim(data).rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(F.trim(data)))
    return F.try_validate_utf8(raw.cast("string"))


def ingest_cursor(spark: SparkSession, meta: DataFrame, blobs: DataFrame) -> Corpus:
    """Canonical tables from ``meta`` (session_id, rowid, value) and ``blobs`` (session_id, id, data).

    The first meta row that describes a session holds. Blobs go by their ids as numbers; in a store where some id is no
    number, as text. Blobs without a role are no messages; unreadable ones become issues.
    """
    told = meta.select("session_id", "rowid", F.from_json(unhex_json(F.col("value")), META).alias("m")).where("m.name <> '' or m.workspaceRoot <> '' or m.createdAt <> 0")
    first = told.groupBy("session_id").agg(F.min_by("m", "rowid").alias("m"))
    text = blobs.select("session_id", "id", unhex_json(F.col("data")).alias("json"))
    parsed = text.withColumn("b", F.when(F.try_parse_json("json").isNotNull(), F.from_json("json", BLOB)))
    bad = parsed.where("b is null").select(F.lit(None).cast("bigint").alias("run_id"), F.lit("warning").alias("severity"), F.lit("parse").alias("category"), F.lit(AGENT).alias("agent"), F.concat(F.col("session_id"), F.lit("/"), F.col("id")).alias("path"), F.lit(None).cast("bigint").alias("line"), F.lit("unreadable row").alias("detail"))
    good = parsed.where("b.role <> ''").withColumn("agent", F.lit(AGENT))
    number = F.expr("try_cast(id as bigint)")
    mixed = good.groupBy("session_id").agg(F.bool_or(number.isNull()).alias("mixed"))
    ordered = good.join(mixed, "session_id").withColumns({"_n": F.when(~F.col("mixed"), number), "at": from_millis(F.col("b.timestamp"))})
    said = numbered(ordered, "seq", "_n", "id")
    body = F.coalesce("b.content", F.lit(""))
    messages = said.select(*KEY, "seq", F.col("id").alias("external_id"), F.col("b.role").alias("role"), F.lit("message").alias("kind"), F.col("at").alias("created_at"), F.col("b.model").alias("model"), F.when(F.ltrim(body).startswith("["), content_text(body)).otherwise(body).alias("text"))
    zero = F.lit(0)
    usage = said.where("b.usage is not null").select(*KEY, "seq", F.col("b.model").alias("model"), F.col("at").alias("created_at"), F.coalesce("b.usage.inputTokens", zero).alias("input"), F.coalesce("b.usage.outputTokens", zero).alias("output"), F.coalesce("b.usage.cacheReadTokens", zero).alias("cache_read"), F.coalesce("b.usage.cacheWriteTokens", zero).alias("cache_write"), zero.alias("cache_write_1h"), zero.alias("reasoning"), zero.alias("parser_version"))
    spans = said.groupBy("session_id").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    ids = blobs.select("session_id").union(meta.select("session_id")).distinct()
    sessions = ids.join(first, "session_id", "left").join(spans, "session_id", "left").select(F.lit(AGENT).alias("agent"), "session_id", truncate_bytes(F.trim(F.coalesce("m.name", F.lit(""))), TITLE_BYTES).alias("title"), F.coalesce(from_millis(F.col("m.createdAt")), "first_at").alias("created_at"), F.col("last_at").alias("modified_at"), F.col("m.workspaceRoot").alias("cwd"), canonical_path(F.coalesce("m.workspaceRoot", F.lit(""))).alias("workspace"), F.lit("ingest").alias("origin"))
    return assemble(spark, sessions=sessions, messages=messages, usage=usage, issues=bad)
