"""Keeping a corpus: changed sources, replacement, pruning, merging an older one, status."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoolsight.corpus import SCHEMAS, Corpus

KEPT_RUNS = 100
CHILDREN = ("messages", "usage", "tool_calls", "session_events", "artifact_links")
KEY = ["agent", "session_id"]


def list_sources(spark: SparkSession, *globs: str) -> DataFrame:
    """Files under the given paths with size and time; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(globs))
    return files.select("path", "length", F.col("modificationTime").alias("mtime"))


def discover(spark: SparkSession, agent: str, roots: list[str]) -> tuple[DataFrame | None, list[str], DataFrame]:
    """Sources of all roots that can be listed (None without any), those roots, and an issue for each other root.

    A root that is missing or unreadable is incomplete: nothing that came from it counts as vanished (see ``prune``, which
    takes the roots given back here). There are a few roots, each named by the user.
    """
    listings, accessible, bad = [], [], []
    for root in roots:
        try:
            listings.append(list_sources(spark, root))
            accessible.append(root)
        except AnalysisException as e:
            bad.append((None, "warning", "discovery", agent, root, None, str(e).split("\n", 1)[0]))
    return (reduce(DataFrame.unionByName, listings) if listings else None), accessible, spark.createDataFrame(bad, SCHEMAS["issues"])


def changed_sources(listing: DataFrame, manifest: DataFrame, parser_version: int, content: DataFrame | None = None) -> DataFrame:
    """Sources to parse: new size or time, or another parser version. With ``content`` (path, content), only files with
    another signature are read, and those whose hash did not change are left out.

    ``manifest``: path, length, mtime, content_hash, parser_version.
    """
    now = listing.withColumn("parser_version", F.lit(parser_version))
    moved = now.join(manifest.select("path", "length", "mtime", "parser_version"), ["path", "length", "mtime", "parser_version"], "left_anti")
    if content is None:
        return moved
    hashed = moved.join(content.select("path", F.sha2("content", 256).alias("content_hash")), "path")
    return hashed.join(manifest.select("path", "content_hash", "parser_version"), ["path", "content_hash", "parser_version"], "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """Old rows with new ones in their place; of several new ones for a key the last by ``order``."""
    if order is not None:
        value = F.struct(*(c for c in new.columns if c not in key))
        new = new.groupBy(*key).agg(F.max_by(value, F.col(order)).alias("_v")).select(*(F.col(c) if c in key else F.col(f"_v.{c}").alias(c) for c in new.columns))
    return old.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def replace_sessions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Whole sessions replaced: delivering the same batch again changes nothing."""
    return old.join(new.select(*KEY).distinct(), KEY, "left_anti").unionByName(new, allowMissingColumns=True)


def replace_sources(stored: DataFrame, fresh: DataFrame, failed: DataFrame) -> DataFrame:
    """Rows of a full pass in place of the stored ones, but of sources in ``failed`` (``source_path``) all that was stored, and
    nothing of what the pass saw before it failed there."""
    kept = stored.join(failed.select("source_path").distinct(), "source_path", "left_semi")
    return kept.unionByName(fresh.join(failed.select("source_path").distinct(), "source_path", "left_anti"), allowMissingColumns=True)


def replace_history(old: DataFrame, new: DataFrame) -> DataFrame:
    """Prompt logs replaced by whole source files."""
    return old.join(new.select("source_path").distinct(), "source_path", "left_anti").unionByName(new)


def reconcile_source(stored: DataFrame, seen: DataFrame, key: list[str], complete: DataFrame) -> DataFrame:
    """Stored rows without those that a full, successful parse of their source no longer saw. ``complete`` lists such
    sources by ``source_path``; rows of other origin than ingest stay."""
    gone = stored.join(complete.select("source_path"), "source_path", "left_semi").where("origin = 'ingest'").join(seen.select("source_path", *key), ["source_path", *key], "left_anti")
    return stored.join(gone.select("source_path", *key), ["source_path", *key], "left_anti")


def prune(c: Corpus, listing: DataFrame, accessible_roots: list[str]) -> Corpus:
    """Corpus without the sessions whose source vanished from a root that could be listed, and without what belongs to
    them. Imported sessions stay. Who owns a shared turn follows from the remaining sessions."""
    under = F.lit(False)
    for root in accessible_roots:
        under = under | F.col("source_path").startswith(root.rstrip("/") + "/")
    gone = c.sessions.where(under & (F.col("origin") == "ingest")).join(listing.select(F.col("path").alias("source_path")), "source_path", "left_anti").select(*KEY)
    kept = {n: getattr(c, n).join(gone, KEY, "left_anti") for n in CHILDREN}
    ends = gone.select("agent", F.col("session_id").alias("_id"))
    edges = c.relations.join(ends.withColumnRenamed("_id", "from_id"), ["agent", "from_id"], "left_anti").join(ends.withColumnRenamed("_id", "to_id"), ["agent", "to_id"], "left_anti")
    return c.with_tables(sessions=c.sessions.join(gone, KEY, "left_anti"), relations=edges.select(*c.relations.columns), **kept)


def merge_archive(c: Corpus, other: Corpus) -> Corpus:
    """Corpus with the sessions and artifacts that only an older archive has, marked as imported, and its ignores."""
    lacking = other.sessions.join(c.sessions.select(*KEY), KEY, "left_anti")
    tables = {"sessions": c.sessions.unionByName(lacking.withColumn("origin", F.lit("imported")), allowMissingColumns=True)}
    for n in CHILDREN:
        tables[n] = getattr(c, n).unionByName(getattr(other, n).join(lacking.select(*KEY), KEY, "left_semi"), allowMissingColumns=True)
    name = ["agent", "kind", "name"]
    tables["artifacts"] = c.artifacts.unionByName(other.artifacts.join(c.artifacts.select(*name), name, "left_anti"), allowMissingColumns=True)
    moved = other.relations.join(lacking.select("agent", F.col("session_id").alias("from_id")), ["agent", "from_id"], "left_semi")
    tables["relations"] = c.relations.unionByName(moved.select(*c.relations.columns))
    mark = ["entity_type", "natural_key", "kind"]
    tables["annotations"] = c.annotations.unionByName(other.annotations.join(c.annotations.select(*mark), mark, "left_anti"))
    return c.with_tables(**tables)


def archive_status(c: Corpus, dirty: DataFrame | None = None, built: dict | None = None, current: dict | None = None) -> DataFrame:
    """One row: sessions awaiting rollups, imported sessions, the last run (its number, status, start, end, failures, warnings, and size
    truncations), and whether rollups or the scan are behind. ``built`` and ``current`` hold the fingerprints and generations that
    they were and would be made from. ``built`` also tells when the last scan was completed (``scan_completed_at``) and whether it
    left something out (``scan_incomplete``): a scan that was never completed, or left something out, is behind."""
    built, current = built or {}, current or {}
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    of_run = ("status", "started_at", "finished_at", "failures", "warnings")
    last = c.ingest_runs.agg(F.max("run_id").alias("last_run"), F.max_by(F.struct(*of_run), "run_id").alias("_run"))
    last = last.select("last_run", *(F.col(f"_run.{n}").alias(f"last_{n}") for n in of_run))
    sized = c.issues.where("category = 'size_limit'").groupBy("run_id").agg(F.count(F.lit(1)).alias("truncated"))
    last = last.join(sized, F.col("run_id") == F.col("last_run"), "left").drop("run_id").withColumn("truncated", F.coalesce("truncated", F.lit(0).cast("bigint")))
    out = count(c.sessions.where("origin = 'imported'"), "imported_sessions").crossJoin(last)  # of one row each
    out = out.crossJoin(count(dirty, "dirty_sessions") if dirty is not None else c.spark.range(1).select(F.lit(0).cast("bigint").alias("dirty_sessions")))
    behind = {k: built.get(k) != v for k, v in current.items()}
    completed = built.get("scan_completed_at")
    scan_behind = behind.get("scan", False) or completed is None or bool(built.get("scan_incomplete"))
    return out.select("*", F.lit(behind.get("rollups", False)).alias("rollups_pending"), F.lit(completed).cast("timestamp").alias("scan_completed_at"), F.lit(scan_behind).alias("scan_pending"))


def record_run(runs: DataFrame, issues: DataFrame, run: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Diagnostics with a further run: status ok, partial (some sources failed) or failed, the last hundred runs and their
    issues are kept."""
    kinds = {"failures": F.count_if(F.col("severity") == "error"), "warnings": F.count_if(F.col("severity") == "warning")}
    counted = found.groupBy("run_id").agg(*(count.alias(n) for n, count in kinds.items()))
    done = run.drop(*kinds).join(counted, "run_id", "left").withColumns({n: F.coalesce(n, F.lit(0).cast("bigint")) for n in kinds})
    status = F.when(F.col("failures") == 0, "ok").when(F.col("files") > F.col("failures"), "partial").otherwise("failed")
    done = done.withColumn("status", status)
    absent = [f for f in runs.schema.fields if f.name not in done.columns]
    done = done.withColumns({f.name: F.lit(None).cast(f.dataType) for f in absent}) if absent else done
    kept = runs.unionByName(done.select(*runs.columns)).orderBy(F.desc("run_id")).limit(KEPT_RUNS)
    return kept, issues.unionByName(found).join(kept.select("run_id"), "run_id", "left_semi").select(*issues.columns)


def stale(manifest: dict, inputs: dict) -> list[str]:
    """Derived tables to compute anew: the generation or fingerprint of their input is not the one they were built from, be it
    that data moved, that rates changed, or that a pass died after its sources were committed."""
    return sorted(name for name, made_from in inputs.items() if manifest.get(name) != made_from)
