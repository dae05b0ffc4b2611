"""Resolution of links: late tool results, session relations, artifacts made by sessions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoolsight.corpus import Corpus
from spoolsight.functions.scalars import ARTIFACT_BYTES, TRUNCATED, memory_path_tail, plan_key, truncate_bytes

MOST_ATTEMPTS = 5
KEY = ["agent", "session_id"]


def pair_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Tool calls with the last result of their call id. Status and excerpt are the result's; the duration is taken only
    if it is not negative, line counts only if the result has them. A result before its call is none of its."""
    late = results.select(*KEY, "call_id", F.struct("line", "status", "excerpt", "result", "at_ms", "lines_added", "lines_removed").alias("_v"), F.col("line").alias("_line"))
    starts = calls.where("call_id <> ''").groupBy(*KEY, "call_id").agg(F.min("seq").alias("_seq"))
    last = late.join(starts, [*KEY, "call_id"]).groupBy(*KEY, "call_id").agg(F.max_by("_v", "_line").alias("_v"))
    took = F.col("_v.at_ms") - F.col("started_ms")
    out = calls.join(last, [*KEY, "call_id"], "left")
    picks = {
        "status": F.coalesce("_v.status", "status"), "excerpt": F.coalesce("_v.excerpt", "excerpt"), "result": F.coalesce("_v.result", "result"),
        "duration_ms": F.when(took >= 0, took).otherwise(F.col("duration_ms")),
        "lines_added": F.coalesce("_v.lines_added", "lines_added"), "lines_removed": F.coalesce("_v.lines_removed", "lines_removed"),
    }
    return out.withColumns(picks).select(*calls.columns)


def resolve_relations(edges: DataFrame, sessions: DataFrame, data_changed: bool = True) -> DataFrame:
    """Edges both of whose sessions exist are resolved; others age by a pass that changed data, and go after five."""
    ids = sessions.select("agent", "session_id").distinct()
    ends = edges.join(ids.withColumnRenamed("session_id", "from_id").withColumn("_f", F.lit(True)), ["agent", "from_id"], "left").join(ids.withColumnRenamed("session_id", "to_id").withColumn("_t", F.lit(True)), ["agent", "to_id"], "left")
    both = F.col("_f").isNotNull() & F.col("_t").isNotNull()
    aged = F.when(both, F.col("attempts")).otherwise(F.col("attempts") + int(data_changed))
    return ends.select(*(both.alias(c) if c == "resolved" else aged.cast("int").alias(c) if c == "attempts" else F.col(c) for c in edges.columns)).where(f"resolved or attempts <= {MOST_ATTEMPTS}")


@dataclass(frozen=True)
class LinkRule:
    """Which calls make artifacts of a kind: a filter over tool calls, and a key on both sides that must agree.

    Keys are Column expressions over ``artifacts`` and ``tool_calls`` (a pandas UDF may be one). Without keys the rule only
    finds, for sessions that are linked already, the last matching call.
    """

    kind: str
    calls: Column
    artifact_key: Column | None = None
    call_key: Column | None = None
    agent: str | None = None


def default_rules() -> list[LinkRule]:
    """Plans by their text, memories by the tail of their path, todo lists by anchor only."""
    plan = truncate_bytes(F.get_json_object("input", "$.plan"), ARTIFACT_BYTES, TRUNCATED)
    folder, file = F.substring_index("name", "/", 1), F.regexp_replace(F.col("name"), r"^[^/]*/", "")
    memory = F.when(F.col("name").rlike("^[^/]+/."), F.concat(F.lit("/projects/"), folder, F.lit("/memory/"), file))
    writes = F.col("kind").isin("file_write", "file_edit") & F.col("file_path").contains("/memory/")
    return [
        LinkRule("plan", F.col("name") == "ExitPlanMode", plan_key(F.col("content")), plan_key(plan)),
        LinkRule("memory", writes, memory, memory_path_tail(F.col("file_path"))),
        LinkRule("todo_list", F.col("name") == "TodoWrite"),
    ]


def expected_links(c: Corpus, rules: list[LinkRule]) -> DataFrame:
    """Links that the rules call for, anchored at the last matching call's message."""
    out = c.spark.createDataFrame([], c.artifact_links.schema)
    for r in rules:
        calls = c.tool_calls.where(r.calls)
        made = c.artifacts.where(F.col("kind") == r.kind)
        if r.agent:
            calls, made = calls.where(F.col("agent") == r.agent), made.where(F.col("agent") == r.agent)
        if r.artifact_key is not None and r.call_key is not None:
            # keys may be whole texts; their digests are what is moved
            left = made.select("agent", "kind", "name", F.sha2(r.artifact_key, 256).alias("_key")).where("_key is not null")
            right = calls.select("agent", "session_id", "message_seq", F.sha2(r.call_key, 256).alias("_key")).where("_key is not null")
            found = left.join(right, ["agent", "_key"]).groupBy("agent", "kind", "name", "session_id").agg(F.max("message_seq").alias("anchor_seq"))
            rows = found.select("agent", "kind", "name", "session_id", F.lit("produced").alias("relation"), F.lit("rule").alias("evidence"), "anchor_seq")
        else:
            last = calls.groupBy(*KEY).agg(F.max("message_seq").alias("_seq"))
            rows = c.artifact_links.where(F.col("kind") == r.kind).join(last, KEY).select("agent", "kind", "name", "session_id", "relation", "evidence", F.col("_seq").alias("anchor_seq"))
        out = out.unionByName(rows)
    return out


def reconcile_links(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """What to do with each link: add, move (another anchor), delete, or keep. Links by other evidence are kept."""
    pair = ["agent", "kind", "name", "session_id", "relation"]
    a = stored.select(*pair, F.col("evidence").alias("had"), F.col("anchor_seq").alias("old_seq"), F.lit(True).alias("_s"))
    b = expected.select(*pair, F.col("evidence").alias("wants"), F.col("anchor_seq").alias("new_seq"), F.lit(True).alias("_e"))
    both = a.join(b, pair, "full_outer")
    action = F.when(F.col("_s").isNull(), "add").when(F.col("_e").isNull(), F.when(F.col("had") == "rule", "delete").otherwise("keep")).when(~F.col("old_seq").eqNullSafe(F.col("new_seq")), "move").otherwise("keep")
    return both.select(*pair, F.coalesce("had", "wants").alias("evidence"), F.when(F.col("_e").isNull(), F.col("old_seq")).otherwise(F.col("new_seq")).alias("anchor_seq"), action.alias("action"))


def resolve_links(c: Corpus, rules: list[LinkRule] | None = None) -> DataFrame:
    """Artifact links after all rules."""
    plan = reconcile_links(c.artifact_links, expected_links(c, default_rules() if rules is None else rules))
    return plan.where("action <> 'delete'").select(*c.artifact_links.columns)
