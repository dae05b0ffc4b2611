"""The canonical tables of a corpus of agent logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Closed vocabularies of the data model.
ROLES = ("user", "assistant", "system", "tool")
MESSAGE_KINDS = ("message", "compaction", "model_change", "branch_point", "info")
TOOL_KINDS = ("shell", "file_read", "file_write", "file_edit", "search", "discovery", "subagent", "web", "script", "other")
EVENT_KINDS = ("api_error", "aborted", "tool_denied", "pr_link", "turn", "compaction", "hook")
ARTIFACT_KINDS = ("plan", "todo_list", "task_group", "shell_snapshot", "paste", "memory", "file_history", "usage_facet", "usage_report")

SCHEMAS: dict[str, str] = {
    "sessions": "agent string, session_id string, title string, created_at timestamp, modified_at timestamp, cwd string, workspace string, repo_root string, git_branch string, origin string, source_path string",
    "relations": "agent string, from_id string, to_id string, kind string, evidence string, resolved boolean, attempts int",
    "messages": "agent string, session_id string, seq bigint, external_id string, parent_id string, content_id string, role string, kind string, created_at timestamp, provider string, model string, cwd string, is_sidechain boolean, text string, thinking string, images array<struct<media_type:string,pointer:string>>, effort string, request_id string, content string",
    "usage": "agent string, session_id string, seq bigint, content_id string, request_id string, provider string, model string, created_at timestamp, input bigint, output bigint, cache_read bigint, cache_write bigint, cache_write_1h bigint, reasoning bigint, service_tier string, reported_nanos bigint, parser_version int",
    "tool_calls": "agent string, session_id string, seq bigint, message_seq bigint, call_id string, name string, kind string, input string, status string, excerpt string, result string, file_path string, command string, old_text string, new_text string, started_at timestamp, started_ms bigint, duration_ms bigint, lines_added bigint, lines_removed bigint",
    "tool_results": "agent string, session_id string, call_id string, line bigint, status string, excerpt string, result string, at_ms bigint, lines_added bigint, lines_removed bigint",
    "session_events": "agent string, session_id string, message_seq bigint, kind string, at timestamp, label string, status string, duration_ms bigint, detail string, payload string",
    "artifacts": "agent string, kind string, name string, content string, metadata string, source_path string, modified_at timestamp",
    "artifact_links": "agent string, kind string, name string, session_id string, relation string, evidence string, anchor_seq bigint",
    "history": "agent string, display string, at timestamp, session_id string, source_path string",
    "issues": "run_id bigint, severity string, category string, agent string, path string, line bigint, detail string",
    "ingest_runs": "run_id bigint, started_at timestamp, finished_at timestamp, status string, files bigint, sessions bigint, messages bigint, failures bigint, warnings bigint",
    "findings": "rule_id string, entity_type string, agent string, natural_key string, session_id string, artifact_kind string, artifact_name string, line bigint, redacted string, found_at timestamp",
    "annotations": "entity_type string, natural_key string, kind string, value string, created_at timestamp",
}


def schema(name: str) -> T.StructType:
    return T._parse_datatype_string(SCHEMAS[name])  # noqa: SLF001


class Corpus:
    """Canonical tables; those not given are empty. A table may be given as a function that makes it, which is called when the
    table is first asked for. ``rates`` is a rate book (see ``operators.pricing``)."""

    def __init__(self, spark: SparkSession, rates: object = None, **tables: DataFrame | Callable[[], DataFrame] | None):
        if unknown := tables.keys() - SCHEMAS.keys():
            raise TypeError(f"no such tables: {sorted(unknown)}")
        self.spark, self.rates, self._tables = spark, rates, dict(tables)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        table = self._tables.get(name)
        if table is None:
            table = self.spark.createDataFrame([], SCHEMAS[name])
        elif not isinstance(table, DataFrame):
            table = table()
        self._tables[name] = table
        return table

    def with_tables(self, **tables) -> Corpus:
        """The same corpus with some tables, or its rates, replaced."""
        return Corpus(self.spark, **({"rates": self.rates} | self._tables | tables))


def union_corpora(corpora: list[Corpus]) -> Corpus:
    """One corpus of several agents' tables."""
    first, *rest = corpora
    for other in rest:
        first = first.with_tables(**{n: getattr(first, n).unionByName(getattr(other, n), allowMissingColumns=True) for n in SCHEMAS})
    return first


def vocabulary_issues(df: DataFrame, column: str, allowed: tuple[str, ...], category: str) -> DataFrame:
    """Rows of ``issues`` for values outside a closed vocabulary."""
    odd = df.where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed)).groupBy("agent", column).count()
    return odd.select(
        F.lit(None).cast("bigint").alias("run_id"), F.lit("warning").alias("severity"), F.lit(category).alias("category"), "agent",
        F.lit("").alias("path"), F.lit(None).cast("bigint").alias("line"), F.concat(F.lit(f"{column}="), column, F.lit(" x"), F.col("count").cast("string")).alias("detail"),
    )
