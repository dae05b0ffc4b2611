from datetime import datetime, timedelta

from pyspark.sql import functions as F

from spoolsight.streaming import live

T0 = datetime(2024, 1, 1)


def landed(spark, folder, rows, schema, parts=2):
    """Rows as files of a folder, read as a stream."""
    spark.createDataFrame(rows, schema).repartition(parts).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).parquet(str(folder))


def finished(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.sql(f"select * from {name}")


def test_blocks_and_counts_match_batch(spark, tmp_path):
    rows = [("a", f"s{k % 7}", T0 + timedelta(hours=k), k, 1, 0, 0) for k in range(60)]
    schema = "agent string, session_id string, created_at timestamp, input bigint, output bigint, cache_read bigint, cache_write bigint"
    got = finished(live.stream_blocks(landed(spark, tmp_path / "u", rows, schema)), "blocks", "complete").collect()
    want = {}
    for r in rows:
        w = int((r[2] - datetime(1970, 1, 1)).total_seconds()) // 18000
        n = want.setdefault(w, [0, 0, set()])
        n[0], n[1] = n[0] + r[3], n[1] + 1
        n[2].add(r[1])
    assert {int((r.start - datetime(1970, 1, 1)).total_seconds()) // 18000: (r.input, r.requests, r.sessions) for r in got} == {w: (a, b, len(c)) for w, (a, b, c) in want.items()}
    calls = [("a", "s", T0 + timedelta(hours=k), "Bash", "error" if k % 3 == 0 else "ok", k if k % 2 else None) for k in range(48)]
    got = finished(live.stream_counts(landed(spark, tmp_path / "c", calls, "agent string, session_id string, started_at timestamp, name string, status string, duration_ms bigint"), ["name"]), "counts", "complete").collect()
    assert {(str(r.day), r.n, r.failures, r.total_ms) for r in got} == {("2024-01-01", 24, 8, sum(range(1, 24, 2))), ("2024-01-02", 24, 8, sum(range(25, 48, 2)))}


def test_counter_deltas_across_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    fields = live.DELTA_FIELDS

    def row(session, line, total=None, last=None):
        pick = lambda v: [None] * 6 if v is None else [v, 0, 0, v, 0, 2 * v]
        t, n = pick(total), pick(last)
        return ("a", session, line, *(x for pair in zip(t, n) for x in pair))

    schema = "agent string, session_id string, line bigint, " + ", ".join(f"total_{f} bigint, last_{f} bigint" for f in fields)
    rows = [row("s", 1, 10, 10), row("s", 2, 10, 10), row("s", 3, 25), row("s", 4, 25, 10), row("s", 5), row("s", 6, 3), row("t", 1, 4), row("t", 2, 9), row("t", 3, None, 9), row("t", 4, None, 9), row("t", 5, 20)]
    batch = sorted(tuple(r) for r in live.batch_deltas(spark.createDataFrame(rows, schema)).collect())
    assert [(r[1], r[2], r[3]) for r in batch] == [("s", 1, 10), ("s", 3, 15), ("s", 4, 10), ("s", 6, 3), ("t", 1, 4), ("t", 2, 5), ("t", 3, 9), ("t", 4, 9), ("t", 5, 11)]
    for cut in (rows[:3] + rows[6:8], rows[3:6] + rows[8:]):
        stream = landed(spark, tmp_path / "d", cut, schema, 1)
        q = live.stream_deltas(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == batch


def test_late_results_and_time_out(spark, tmp_path):
    calls = [("a", "s", f"c{k}", T0 + timedelta(minutes=10 * k)) for k in range(40)]
    results = [("a", "s", f"c{k}", T0 + timedelta(minutes=10 * k + 1), "ok") for k in range(0, 40, 2)]
    a = landed(spark, tmp_path / "a", calls, "agent string, session_id string, call_id string, started_at timestamp", 1)
    b = landed(spark, tmp_path / "b", results, "agent string, session_id string, call_id string, at timestamp, status string", 1)
    got = {r.call_id: (r.status, r.duration_ms) for r in finished(live.stream_pair_results(a, b), "paired").collect()}
    assert {k: v for k, v in got.items() if v[0]} == {f"c{k}": ("ok", 60_000) for k in range(0, 40, 2)}
    assert all(int(k[1:]) % 2 == 1 for k, v in got.items() if v[0] is None)


def test_rollup_writer_replaces_only_touched_days(spark, tmp_path):
    schema = "agent string, session_id string, ts timestamp, n bigint"
    source, out, ck = tmp_path / "rows", str(tmp_path / "rollup"), str(tmp_path / "ck")
    build = lambda df: df.groupBy("day", "agent").agg(F.sum("n").alias("n"))
    everything = lambda: live.with_day(spark.read.schema(schema).parquet(str(source)))
    first = [("a", "s", T0 + timedelta(days=k), 1) for k in range(3)]
    for rows in (first, [("a", "s", T0 + timedelta(days=1, hours=2), 5), ("b", "s", T0 + timedelta(days=4), 7)]):
        stream = live.with_day(landed(spark, source, rows, schema, 1))
        live.stream_ingest(stream, live.rollup_writer(out, everything, build), ck).awaitTermination()
    got = sorted((str(r.day), r.agent, r.n) for r in spark.read.parquet(out).collect())
    assert got == sorted((str(r.day), r.agent, r.n) for r in build(everything()).collect()) and len(got) == 4


def test_segments_and_duplicates(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.jsonl").write_text('{"a":1}\n{"a":2}\n')
    assert sorted(r.value for r in finished(live.read_segments(spark, str(tmp_path / "in")), "lines").collect()) == ['{"a":1}', '{"a":2}']
    rows = [("x", T0), ("x", T0), ("y", T0)]
    stream = landed(spark, tmp_path / "dup", rows, "id string, at timestamp", 1)
    assert sorted(r.id for r in finished(live.once_each(stream, ["id"], "at", "1 hour"), "once").collect()) == ["x", "y"]


def test_last_result_wins_whenever_it_comes(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    of_calls, of_results = "agent string, session_id string, call_id string, started_at timestamp", "agent string, session_id string, call_id string, line bigint, at timestamp, status string"
    call = lambda n: ("a", "s", n, T0)
    result = lambda n, line, status, seconds=1: ("a", "s", n, line, None if seconds is None else T0 + timedelta(seconds=seconds), status)
    portions = [
        ([call("two"), call("none"), call("back")], [result("two", 9, "ok", 3), result("two", 4, "error"), result("before", 2, "ok", 2), result("back", 3, "ok", -5), result("orphan", 1, "ok")]),
        ([call("before"), call("twice")], [result("two", 6, "late but earlier", 8)]),
        ([call("twice")], [result("twice", 11, "ok", None), result("before", 12, None, 7)]),
    ]
    for calls, results in portions:
        late = live.stream_late_results(landed(spark, tmp_path / "c", calls, of_calls, 1), landed(spark, tmp_path / "r", results, of_results))
        late.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    got = {r.call_id: (r.status, r.duration_ms) for r in live.latest_results(spark.read.schema(live.LATE_ROW).parquet(str(tmp_path / "out"))).collect()}
    assert got == {"two": ("ok", 3000), "none": (None, None), "back": ("ok", None), "before": (None, 7000), "twice": ("ok", None)}
