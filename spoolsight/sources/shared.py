"""What the adapters of several agents share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoolsight.corpus import Corpus, schema
from spoolsight.functions.scalars import TITLE_BYTES, canonical_path, truncate_bytes

KEY = ["agent", "session_id"]


def conform(df: DataFrame, table: str) -> DataFrame:
    """A canonical table's columns in order; those that are missing are null, or empty if they are texts."""
    nullable = {"evidence", "reported_nanos", "started_at", "content", "payload"}
    out = []
    for f in schema(table).fields:
        if f.name in df.columns:
            c = F.col(f.name).cast(f.dataType)
            out.append((F.coalesce(c, F.lit("")) if isinstance(f.dataType, T.StringType) and f.name not in nullable else c).alias(f.name))
        else:
            out.append((F.lit("") if isinstance(f.dataType, T.StringType) and f.name not in nullable else F.lit(None)).cast(f.dataType).alias(f.name))
    return df.select(*out)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.jsonl?$", "")


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Adds a number from 0 on within each session."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*KEY).orderBy(*order)) - 1).cast("bigint"))


def carried(column: Column, order: str = "line") -> Column:
    """Last known value up to this row of the session."""
    return F.last(column, ignorenulls=True).over(Window.partitionBy(*KEY).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def fold_sessions(rows: DataFrame) -> DataFrame:
    """Sessions from rows with ``line``, ``at``, ``cwd``, ``git_branch``, ``title``, ``title_priority``, ``source_path``.

    First known folder and time, last time and branch. Of titles the highest priority wins; of the first priority (prompts)
    the first one, of the others the last.
    """
    known = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("line"))
    place = F.when(F.col("title_priority") == 1, -F.col("line")).otherwise(F.col("line"))
    titled = F.when(F.coalesce("title", F.lit("")) != "", F.struct(F.col("title_priority"), place))
    folded = rows.groupBy(*KEY).agg(
        F.max_by("title", titled).alias("title"), F.min("at").alias("created_at"), F.max("at").alias("modified_at"), F.min_by("cwd", known("cwd")).alias("cwd"),
        F.max_by("git_branch", known("git_branch")).alias("git_branch"), F.min("source_path").alias("source_path"),
    )
    titled = folded.withColumn("title", truncate_bytes(F.coalesce("title", F.lit("")), TITLE_BYTES)).withColumn("origin", F.lit("ingest"))
    return conform(titled.withColumn("workspace", canonical_path(F.coalesce("cwd", F.lit("")))), "sessions")


def counter_deltas(rows: DataFrame, fields: list[str], total: str = "total", last: str = "last", order: str = "line") -> DataFrame:
    """Usage per turn from cumulative counters: adds ``delta``, null where a row adds nothing.

    ``total`` and ``last`` are structs with ``fields``. A row with a last-turn figure gives it, unless the row before had the same
    one and the last known total is the same: that is a repeat. A row with only a total gives the difference to the last
    known total, or the total itself where the counter fell, which is a restart. Rows without last figure end a run.
    """
    session = Window.partitionBy(*KEY).orderBy(order)
    earlier = session.rowsBetween(Window.unboundedPreceding, -1)
    previous_total = F.last(total, ignorenulls=True).over(earlier)
    out = rows.withColumns({"_had": previous_total, "_was": F.lag(last).over(session)})
    repeat = F.col(last).isNotNull() & F.col("_was").isNotNull() & (F.col(last) == F.col("_was")) & F.col(total).eqNullSafe(F.col("_had"))
    restart = F.col("_had").isNull() | (F.col(f"{total}.total_tokens") < F.col("_had.total_tokens"))
    difference = F.struct(*((F.col(f"{total}.{f}") - F.col(f"_had.{f}")).alias(f) for f in fields))
    as_fields = lambda c: F.when(F.col(c).isNotNull(), F.struct(*(F.col(f"{c}.{f}").alias(f) for f in fields)))
    delta = F.when(F.col(last).isNotNull(), F.when(~repeat, as_fields(last))).when(F.col(total).isNull(), None).when(restart, as_fields(total)).otherwise(difference)
    return out.withColumn("delta", delta).drop("_had", "_was")


def assemble(spark, **tables: DataFrame) -> Corpus:
    return Corpus(spark, **{n: conform(t, n) for n, t in tables.items()})
