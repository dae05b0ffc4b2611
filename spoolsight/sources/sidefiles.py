"""Files beside the session logs: plans, todos, tasks, memories and the like, and the prompt history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoolsight.functions.scalars import ARTIFACT_BYTES, TRUNCATED, project_dir, truncate_bytes
from spoolsight.sources.shared import conform

AGENT = "claude"
UUID = r"([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"


def classify(relative: Column) -> Column:
    """Kind of a file by its path below the root; null for what is no artifact."""
    parts = F.split(relative, "/")
    n, part = F.size(parts), lambda k: F.get(parts, F.lit(k))
    below = lambda folder, depth: (part(0) == folder) & (n == depth)
    return (
        F.when(relative == "usage-data/report.html", "usage_report").when(below("usage-data", 3) & (part(1) == "facets"), "usage_facet").when(below("plans", 2), "plan").when(below("shell-snapshots", 2), "shell_snapshot")
        .when(below("paste-cache", 2), "paste").when(below("todos", 2), "todo_list").when(below("tasks", 3), "task_group").when(below("file-history", 3), "file_history").when(below("projects", 4) & (part(2) == "memory"), "memory")
    )


def ingest_artifacts(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Artifacts and their links to sessions, from a folder."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified_at"), "value")
    base = root.split("://")[-1].rstrip("/")
    return from_files(files.withColumn("relative", F.substring_index("path", base + "/", -1)))


def from_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same from ``path``, ``relative``, ``modified_at``, ``value``. The files of a task group or file history make one artifact, in
    name order."""
    kind = files.withColumn("kind", classify(F.col("relative"))).where("kind is not null")
    parts = F.split("relative", "/")
    last = F.element_at(parts, -1)
    single = kind.where("kind not in ('task_group', 'file_history')")
    name = F.when(F.col("kind") == "memory", F.concat(F.get(parts, F.lit(1)), F.lit("/"), last)).otherwise(last)
    one = single.select("kind", name.alias("name"), F.col("value").alias("content"), F.col("path").alias("source_path"), "modified_at")
    folded = kind.where("kind in ('task_group', 'file_history')").groupBy("kind", F.get(parts, F.lit(1)).alias("name")).agg(F.array_sort(F.collect_list(F.struct(last.alias("file"), "value"))).alias("files"), F.min("path").alias("source_path"), F.max("modified_at").alias("modified_at"))
    many = folded.select("kind", "name", F.array_join(F.transform("files", lambda f: F.concat(f.file, F.lit("\n"), f.value)), "\n").alias("content"), "source_path", "modified_at")
    all_of = one.unionByName(many).withColumns({"agent": F.lit(AGENT), "content": truncate_bytes(F.coalesce("content", F.lit("")), ARTIFACT_BYTES, TRUNCATED), "metadata": F.lit("{}")})
    owner = F.when(F.col("kind") == "usage_facet", F.get_json_object("content", "$.session_id")).when(F.col("kind").isin("todo_list", "task_group", "file_history"), F.nullif(F.regexp_extract("name", UUID, 1), F.lit("")))
    links = all_of.withColumn("session_id", owner).where("session_id is not null").select("agent", "kind", "name", "session_id", F.lit("belongs_to").alias("relation"), F.lit("name").alias("evidence"), F.lit(None).cast("bigint").alias("anchor_seq"))
    return conform(all_of, "artifacts"), conform(links, "artifact_links")


def ingest_history(spark: SparkSession, *paths: str) -> DataFrame:
    """Prompt history from JSON lines; lines that cannot be read are skipped."""
    rows = spark.read.schema("display string, timestamp bigint, project string, sessionId string").json(list(paths)).select(F.lit(AGENT).alias("agent"), "display", F.timestamp_millis(F.nullif("timestamp", F.lit(0).cast("bigint"))).alias("at"), F.col("sessionId").alias("session_id"), F.col("_metadata.file_path").alias("source_path"))
    return conform(rows.where("display is not null"), "history")


def project_path(folder: Column) -> Column:
    """Path of a project from its folder's name, as far as it can be told."""
    return project_dir(folder)
