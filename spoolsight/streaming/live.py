"""Live forms of the operations: appended logs, incremental rollups, windows, counters, deltas, and late results.

All of them take streaming DataFrames whose time column is a TIMESTAMP. How often a query runs is its trigger's matter
(``processingTime`` for a cadence, ``availableNow`` for a catch-up run).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spoolsight.functions.scalars import day_of
from spoolsight.sources.shared import counter_deltas

KEY = ["agent", "session_id"]


def read_segments(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Lines of log segments dropped into a folder: ``path``, ``value``. Each segment is read once; a growing log must be landed as
    segments, as a file stream does not follow a file that grows."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    return lines.select(F.col("_metadata.file_path").alias("path"), "value")


def stream_ingest(lines: DataFrame, store: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None):
    """Hand every batch of lines to ``store`` (for example one that parses and replaces the touched sessions). A batch that
    fails is given again with the same number, so a store that replaces by key loses and doubles nothing."""
    return lines.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def rollup_writer(folder: str, all_rows: Callable[[], DataFrame], build: Callable[[DataFrame], DataFrame], day: str = "day") -> Callable[[DataFrame, int], None]:
    """A store that keeps a table of daily rollups: of each batch only its days are computed anew, from all rows of those days,
    and their partitions replaced."""

    def store(batch: DataFrame, _: int) -> None:
        days = batch.select(day).distinct()
        fresh = build(all_rows().join(days, day, "left_semi"))
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(folder)

    return store


def with_day(rows: DataFrame, at: str = "ts") -> DataFrame:
    return rows.withColumn("day", day_of(F.col(at)))


def once_each(rows: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """Rows without those delivered again within the delay."""
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def stream_blocks(usage: DataFrame, delay: str = "1 hour", at: str = "created_at") -> DataFrame:
    """Usage by five-hour windows since the epoch. Sessions are counted approximately, as exact distinct counts need all
    sessions in state; rows later than the delay are left out."""
    sums = [F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("input", "output", "cache_read", "cache_write")]
    windows = usage.withWatermark(at, delay).groupBy(F.window(at, "5 hours"))
    return windows.agg(*sums, F.count(F.lit(1)).alias("requests"), F.approx_count_distinct(F.concat_ws("/", *KEY), 0.01).alias("sessions")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *(c for c in ("input", "output", "cache_read", "cache_write", "requests", "sessions")))


def stream_counts(rows: DataFrame, keys: list[str], at: str = "started_at", delay: str = "1 hour") -> DataFrame:
    """Calls or events so far by day and keys: number, failures, total time. For update or complete mode."""
    ms = F.coalesce("duration_ms", F.lit(0))
    return rows.withWatermark(at, delay).groupBy(F.window(at, "1 day").alias("day"), *keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status").isin("error", "blocked")).alias("failures"), F.sum(ms).alias("total_ms")).select(F.to_date("day.start").alias("day"), *keys, "n", "failures", "total_ms")


def stream_pair_results(calls: DataFrame, results: DataFrame, wait: str = "1 hour") -> DataFrame:
    """Calls with their results, joined as both arrive; a call whose result does not come within the wait goes out alone.

    ``calls``: agent, session_id, call_id, started_at. ``results``: agent, session_id, call_id, at, status.
    """
    a = calls.withWatermark("started_at", wait).alias("a")
    b = results.withWatermark("at", wait).alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in (*KEY, "call_id")]
    in_time = F.expr(f"b.at >= a.started_at AND b.at <= a.started_at + interval {wait}")
    joined = a.join(b, same[0] & same[1] & same[2] & in_time, "left_outer")
    took = F.unix_millis("b.at") - F.unix_millis("a.started_at")
    return joined.select(*(F.col(f"a.{k}").alias(k) for k in (*KEY, "call_id")), "a.started_at", "b.status", took.alias("duration_ms"))


LATE_ROW = "agent string, session_id string, call_id string, started_at timestamp, line bigint, at timestamp, status string"
#: Sessions share a group's state, so that Python gets the rows and the state of many of them at a time, as columns. A stored
#: stream keeps its number.
BUCKETS = 4096
LATE_COLUMNS = [*KEY, "call_id", "started_us", "started", "line", "lined", "at_us", "dated", "status", "seen"]
_LATE_TYPES = {"started_us": "int64", "started": "bool", "line": "int64", "lined": "bool", "at_us": "int64", "dated": "bool", "seen": "int64"}


def _bucket() -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)).cast("int").alias("bucket")


def _packed(rows: pd.DataFrame) -> bytes:
    """Rows as one Arrow stream, which is what a group's state holds."""
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(state: GroupState) -> list[pd.DataFrame]:
    return [pa.ipc.open_stream(state.get[0]).read_all().to_pandas()] if state.exists else []


def _late_results(keep_ms: int):
    """Of the calls of some sessions what is known, their starts and last results, until one was not seen for ``keep_ms``."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fresh = [] if state.hasTimedOut else list(frames)
        known = _unpacked(state)
        rows = pd.concat([df[LATE_COLUMNS] for df in (*known, *fresh)], ignore_index=True).astype(_LATE_TYPES)
        stored = sum(map(len, known))
        call = rows.groupby([*KEY, "call_id"], dropna=False, sort=False).ngroup().to_numpy()
        n = call.max() + 1
        of_last = np.lexsort((np.arange(len(rows)), rows["line"].to_numpy(), rows["lined"].to_numpy(), call))  # of equal lines the later row
        last = of_last[np.searchsorted(call[of_last], np.arange(n), "right") - 1]
        calls = rows.iloc[last].reset_index(drop=True)
        least = np.full(n, np.iinfo("i8").max)
        np.minimum.at(least, call[rows["started"]], rows["started_us"].to_numpy()[rows["started"]])
        calls["started"] = least < np.iinfo("i8").max
        calls["started_us"] = np.where(calls["started"], least, 0)
        seen = np.zeros(n, "i8")
        np.maximum.at(seen, call, rows["seen"].to_numpy())
        calls["seen"] = seen
        if fresh:
            yield calls.iloc[np.unique(call[stored:])]
        now = state.getCurrentWatermarkMs()
        kept = calls[calls["seen"] + keep_ms > now]
        if len(kept):
            state.update((_packed(kept),))
            state.setTimeoutTimestamp(int(kept["seen"].min()) + keep_ms)
        elif state.exists:
            state.remove()

    return run


def stream_late_results(calls: DataFrame, results: DataFrame, keep: str = "1 day") -> DataFrame:
    """What is known of each call whenever that changes: of several results the last by line, and results that come before their
    call. For append mode; ``latest_results`` takes the rows of a call together.

    ``calls``: agent, session_id, call_id, started_at. ``results``: agent, session_id, call_id, line, at, status. A call's state is let
    go of ``keep`` after it last arrived, by timers on the time of arrival, so no row is too late: a result beyond that goes out
    alone and meets its call among the stored rows.
    """
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    rows = calls.select(*KEY, "call_id", "started_at").unionByName(results.select(*KEY, "call_id", "line", "at", "status"), allowMissingColumns=True)
    arrived = rows.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", "0 seconds")
    number = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    flat = arrived.select(
        _bucket(), *KEY, "call_id", number(F.unix_micros("started_at")).alias("started_us"), F.col("started_at").isNotNull().alias("started"), number(F.col("line")).alias("line"), F.col("line").isNotNull().alias("lined"),
        number(F.unix_micros("at")).alias("at_us"), F.col("at").isNotNull().alias("dated"), "status", F.unix_millis("arrived").alias("seen"), "arrived",
    )
    kinds = "agent string, session_id string, call_id string, started_us bigint, started boolean, line bigint, lined boolean, at_us bigint, dated boolean, status string, seen bigint"
    known = flat.groupBy("bucket").applyInPandasWithState(_late_results(keep_ms), kinds, "calls binary", "append", GroupStateTimeout.EventTimeTimeout)
    when = lambda flag, c: F.when(F.col(flag), c)
    return known.select(*KEY, "call_id", when("started", F.timestamp_micros("started_us")).alias("started_at"), when("lined", F.col("line")).alias("line"), when("dated", F.timestamp_micros("at_us")).alias("at"), "status")


def latest_results(rows: DataFrame) -> DataFrame:
    """One row a call from all rows that ``stream_late_results`` gave: its last result, and the time that it took, if that is not
    negative. Results of calls that never came are left out."""
    result = F.max_by(F.struct("at", "status"), "line")
    whole = rows.groupBy(*KEY, "call_id").agg(F.min("started_at").alias("started_at"), result.alias("_last")).where("started_at is not null")
    took = F.unix_millis("_last.at") - F.unix_millis("started_at")
    return whole.select(*KEY, "call_id", "started_at", "_last.status", F.when(took >= 0, took).alias("duration_ms"))


DELTA_FIELDS = ["input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens"]
DELTA_SCHEMA = "agent string, session_id string, line bigint, " + ", ".join(f"{f} bigint" for f in DELTA_FIELDS)


_COUNTS = [f"{kind}_{f}" for kind in ("total", "last") for f in DELTA_FIELDS]
_COUNTER_COLUMNS = [*KEY, "line", "totalled", "told", *_COUNTS]


def _counter_deltas(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Deltas of the rows of some sessions. What is known of a session, its last total and the last-turn figure of the row before,
    is kept as one row, which stands before those that arrive."""
    known = _unpacked(state)
    rows = pd.concat([df[_COUNTER_COLUMNS] for df in (*known, *frames)], ignore_index=True)
    fresh = np.arange(len(rows)) >= sum(map(len, known))
    session = rows.groupby(KEY, dropna=False, sort=False).ngroup().to_numpy()
    order = np.lexsort((rows["line"].to_numpy(), fresh, session))
    rows, fresh, session, at = rows.iloc[order], fresh[order], session[order], np.arange(len(rows))
    total, last = (rows[[f"{kind}_{f}" for f in DELTA_FIELDS]].to_numpy("i8") for kind in ("total", "last"))
    totalled, told = rows["totalled"].to_numpy("bool"), rows["told"].to_numpy("bool")
    start = np.searchsorted(session, session)
    newest = np.maximum.accumulate(np.where(totalled, at, -1))  # the last row with a total, perhaps of a session before
    newest = np.where(newest >= start, newest, -1)
    before = np.maximum(at - 1, 0)
    had = np.where(at > start, newest[before], -1)
    same_total = np.where(had < 0, ~totalled, totalled & (total == total[had]).all(axis=1))
    repeat = (at > start) & told[before] & (last == last[before]).all(axis=1) & same_total
    restart = (had < 0) | (total[:, -1] < total[had, -1])
    delta = np.where(told[:, None], last, np.where(restart[:, None], total, total - total[had]))
    given = fresh & np.where(told, ~repeat, totalled)
    out = rows.loc[given, [*KEY, "line"]].reset_index(drop=True)
    yield pd.concat([out, pd.DataFrame(delta[given], columns=DELTA_FIELDS)], axis=1)

    end = np.flatnonzero(np.diff(session, append=-1))
    kept = rows.iloc[end].copy()
    kept["totalled"] = newest[end] >= 0
    kept[[f"total_{f}" for f in DELTA_FIELDS]] = np.where((newest[end] >= 0)[:, None], total[newest[end]], 0)
    state.update((_packed(kept),))


def stream_deltas(rows: DataFrame) -> DataFrame:
    """Usage per turn from cumulative counters as they arrive, with the last total of every session in state.

    ``rows``: agent, session_id, line, and ``total_*`` and ``last_*`` for each of ``DELTA_FIELDS``. A figure missing beside a known
    ``total_tokens`` counts 0.
    """
    counts = [F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint")).alias(c) for c in _COUNTS]
    flat = rows.select(_bucket(), *KEY, "line", F.col("total_total_tokens").isNotNull().alias("totalled"), F.col("last_total_tokens").isNotNull().alias("told"), *counts)
    return flat.groupBy("bucket").applyInPandasWithState(_counter_deltas, DELTA_SCHEMA, "counters binary", "append", GroupStateTimeout.NoTimeout)


def batch_deltas(rows: DataFrame) -> DataFrame:
    """The same over a finished table."""
    pack = lambda kind: F.when(F.col(f"{kind}_total_tokens").isNotNull(), F.struct(*(F.col(f"{kind}_{f}").alias(f) for f in DELTA_FIELDS)))
    packed = rows.withColumns({"total": pack("total"), "last": pack("last")})
    return counter_deltas(packed, DELTA_FIELDS).where("delta is not null").select(*KEY, "line", *(F.col(f"delta.{f}").alias(f) for f in DELTA_FIELDS))
