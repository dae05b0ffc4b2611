"""State of many sessions in one group of a stream, and turns that only look like repeats."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spoolsight.plans import more_queries
from spoolsight.streaming import live

T0 = datetime(2024, 1, 1)


def drained(spark, tmp_path, stream_of, portions, schemas):
    """Rows that a stream gives out over portions that arrive one after the other."""
    for portion in portions:
        streams = []
        for k, (rows, schema) in enumerate(zip(portion, schemas, strict=True)):
            spark.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(str(tmp_path / f"in{k}"))
            streams.append(spark.readStream.schema(schema).parquet(str(tmp_path / f"in{k}")))
        out = stream_of(*streams)
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(str(tmp_path / "out"))


@pytest.mark.parametrize("buckets", [1, 7])
def test_deltas_of_sessions_that_share_a_group(spark, tmp_path, monkeypatch, buckets):
    monkeypatch.setattr(live, "BUCKETS", buckets)
    rnd = random.Random(buckets)
    schema = "agent string, session_id string, line bigint, " + ", ".join(f"{kind}_{f} bigint" for kind in ("total", "last") for f in live.DELTA_FIELDS)
    counts = lambda: [None] * 6 if rnd.random() < 0.4 else [(n := rnd.randint(1, 3)), 0, 0, n, 0, 2 * n]
    portions = [[[(rnd.choice("ab"), f"s{s}", 10 * p + k, *counts(), *counts()) for s in range(25) for k in range(rnd.randint(0, 6))]] for p in range(3)]
    rows = [r for (portion,) in portions for r in {r[:3]: r for r in portion}.values()]
    got = drained(spark, tmp_path, live.stream_deltas, [[[r for r in rows if r[2] // 10 == p]] for p in range(3)], [schema])
    assert Counter(got.collect()) == Counter(live.batch_deltas(spark.createDataFrame(rows, schema)).collect())


def test_turns_with_equal_figures_are_no_repeats(spark):
    """Two counters that start anew with the figures of the turn before: event numbers 45,000 apart have the same ones."""
    usage = spark.createDataFrame([("a", "s", n, 100 + n * 37 % 5000, n * 13 % 900) for n in (1000, 46000, 46001, 91000)], "agent string, session_id string, seq bigint, input bigint, output bigint")
    got = live.batch_deltas(more_queries._counters(usage)).select("line", "input_tokens", "output_tokens").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, usage.select("seq", "input", "output").collect()))


def test_state_of_calls_ends_one_by_one(spark, tmp_path, monkeypatch):
    """Calls of many sessions in one group; a call that was not seen for the time to keep is let go of, its late result goes out alone."""
    monkeypatch.setattr(live, "BUCKETS", 1)
    of_calls, of_results = "agent string, session_id string, call_id string, started_at timestamp", "agent string, session_id string, call_id string, line bigint, at timestamp, status string"
    calls = [("a", f"s{k % 5}", f"c{k}", T0 + timedelta(microseconds=k)) for k in range(40)]
    result = lambda k, line, status: ("a", f"s{k % 5}", f"c{k}", line, T0 + timedelta(seconds=k), status)
    portions = [[calls[:30], [result(k, 5, "ok") for k in range(20)] + [result(k, 3, "error") for k in range(10)]], [calls[30:], []], [[], [result(k, 9, "late") for k in range(0, 40, 4)]]]
    rows = drained(spark, tmp_path, lambda c, r: live.stream_late_results(c, r, "1 millisecond"), portions, [of_calls, of_results])
    alone = rows.where(F.col("status") == "late").where("started_at is null").count()
    assert alone == 8  # those of the first portion; what was seen last is still known
    got = {r.call_id: (r.started_at, r.status) for r in live.latest_results(rows).collect()}
    assert got == {f"c{k}": (calls[k][3], "late" if k % 4 == 0 else "ok" if k < 20 else None) for k in range(40)}
