"""Growing logs, owners that move, refreshed days, and totals of subtrees."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spoolsight.corpus import Corpus, schema
from spoolsight.operators import pricing, sessions, usage
from spoolsight.sources import growing
from spoolsight.sources.lines import read_jsonl


# -- logs that grow
class Follower:
    """A stream over a folder, run once after each change."""

    def __init__(self, spark, tmp_path, index=True, size=64):
        self.logs, self.out, self.state = tmp_path / "logs", tmp_path / "out", tmp_path / "state"
        self.index = f"file://{tmp_path}/index" if index else None
        self.spark, self.size, self.seen = spark, size, Counter()
        self.logs.mkdir()

    def new(self):
        lines = growing.read_growing(self.spark, f"file://{self.logs}", self.index, range_bytes=self.size)
        lines.writeStream.format("parquet").option("path", str(self.out)).option("checkpointLocation", str(self.state)).trigger(availableNow=True).start().awaitTermination()
        rows = Counter((r.path.rsplit("/", 1)[1], r.line, r.value) for r in self.spark.read.schema("path string, line long, value string").parquet(str(self.out)).collect())
        fresh, self.seen = rows - self.seen, rows
        return sorted(fresh.elements())


@pytest.mark.parametrize("index", [True, False])
def test_a_log_gives_each_line_once_as_it_grows(spark, tmp_path, index):
    f = Follower(spark, tmp_path, index)
    a = f.logs / "a"
    a.write_text("".join(f"line {k} {'x' * (k % 50)}\n" for k in range(1, 60)) + "\n\r\nunfinished")
    assert f.new() == sorted(("a", k, f"line {k} {'x' * (k % 50)}") for k in range(1, 60))  # blank ones count, the last one waits
    assert f.new() == []
    with a.open("a") as file:
        file.write(" no more\r\nnext\nhalf")
    (f.logs / "b").write_text("own\n")
    assert f.new() == [("a", 62, "unfinished no more"), ("a", 63, "next"), ("b", 1, "own")]
    with a.open("a") as file:
        file.write("\n")
    assert f.new() == [("a", 64, "half")]


def test_logs_that_are_cut_replaced_and_renamed(spark, tmp_path):
    f = Follower(spark, tmp_path)
    for name in ("cut", "replaced", "renamed", "gone"):
        (f.logs / name).write_text("".join(f"{name} is a log, line {k}\n" for k in range(1, 5)))
    assert len(f.new()) == 16
    (f.logs / "cut").write_text("cut is a log, line 1\n")
    (f.logs / "replaced").write_text("".join(f"quite another log, line {k}\n" for k in range(1, 9)))
    (f.logs / "renamed").rename(f.logs / "renamed.1")
    with (f.logs / "renamed.1").open("a") as file:
        file.write("one more\n")
    (f.logs / "renamed").write_text("a new log under the old name\n")
    (f.logs / "gone").unlink()
    got = f.new()
    assert got == sorted([("cut", 1, "cut is a log, line 1"), ("renamed.1", 5, "one more"), ("renamed", 1, "a new log under the old name")] + [("replaced", k, f"quite another log, line {k}") for k in range(1, 9)])
    with (f.logs / "renamed.1").open("a") as file:
        file.write("and more\n")
    assert f.new() == [("renamed.1", 6, "and more")]


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
def test_ranges_of_any_size_give_the_same_lines(spark, tmp_path, size):
    rnd = random.Random(size)
    text = "".join("é" * rnd.choice([0, 1, 3, 40, 200]) + rnd.choice(["\n", "\r\n"]) for _ in range(60))
    path = tmp_path / "x.jsonl"
    path.write_bytes(text.encode())
    logs = growing._Logs({"path": f"file://{tmp_path}", "rangebytes": str(size)})
    got = [r for part in growing.ranges({}, logs.files(), size) for batch in logs.lines(part) for r in batch.to_pylist()]
    assert [(r["line"], r["value"]) for r in got] == [(k + 1, line) for k, line in enumerate(text.replace("\r\n", "\n").split("\n")[:-1]) if line]


def test_long_lines_are_cut_and_an_empty_folder_has_none(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(growing, "MOST_BYTES", 10)
    monkeypatch.setattr(growing, "READ", 4)
    (tmp_path / "x").write_text("short\n" + "y" * 100 + "\nlast\n")
    logs = growing._Logs({"path": f"file://{tmp_path}", "rangebytes": "16"})
    assert [r for p in growing.ranges({}, logs.files(), 16) for b in logs.lines(p) for r in b.column(2).to_pylist()] == ["short", "y" * 11, "last"]
    assert growing.read_growing(spark, f"file://{tmp_path}/none", stream=False).count() == 0


def test_numbered_lines_move_no_text(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n\n{"k": 2}\n')
    good, _ = read_jsonl(spark, str(tmp_path))
    assert sorted((r.line, r.value) for r in good.collect()) == [(1, '{"k": 1}'), (3, '{"k": 2}')]
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


# -- owners that move
D = datetime(2026, 3, 1)
RATES = '{"models": {"m": {"input": 1e-6, "output": 1e-6}}}'


def rows(spark, table, values):
    fields = schema(table)
    return spark.createDataFrame([tuple(v.get(f.name) for f in fields) for v in values], fields)


def session(i, ended, **k):
    return {"agent": "a", "session_id": i, "workspace": "/w", "created_at": D, "modified_at": D + timedelta(days=ended)} | k


def turn(i, seq, content, day, **k):
    return {"agent": "a", "session_id": i, "seq": seq, "content_id": content, "request_id": "r", "provider": "", "model": "m", "created_at": D + timedelta(days=day), "input": 10 + seq, "output": 1, "cache_read": 0, "cache_write": 0, "cache_write_1h": 0, "parser_version": 1} | k


def test_turns_move_to_the_session_that_ended_first(spark):
    claims = [turn("old", 1, "c1", 0), turn("copy", 2, "c1", 1), turn("copy", 3, "c2", 2), turn("third", 4, "c2", 3), turn("third", 5, "", 5), turn("far", 6, "c9", 8), turn("new", 7, "c9", 8, request_id=None), turn("new", 8, "c3", 9)]
    was = [session("old", 2), session("copy", 4), session("third", 6), session("far", 9)]
    now = [session("old", 5), session("copy", 4), session("third", 6), session("far", 9), session("new", 9)]
    corpus = lambda s, u: Corpus(spark, rates=pricing.rates_from_json(spark, RATES), sessions=rows(spark, "sessions", s), usage=rows(spark, "usage", u))
    before, after = corpus(was, claims[:6]), corpus(now, claims)
    owners = usage.usage_owners(before.usage, before.sessions)
    dirty = spark.createDataFrame([("a", "old"), ("a", "new")], "agent string, session_id string")
    moves, known = usage.owner_moves(after.usage, after.sessions, owners, dirty)
    got = {(r.content_id, r.request_id, r.from_session, r.from_seq, r.to_session, r.to_seq) for r in moves.collect()}
    assert got == {("c1", "r", "old", 1, "copy", 2), ("c9", "", None, None, "new", 7), ("c3", "r", None, None, "new", 8)}
    assert {r.session_id for r in known.collect()} == {"old", "copy", "new"}
    nothing = usage.owner_moves(after.usage, after.sessions, usage.usage_owners(after.usage, after.sessions), dirty)
    assert nothing[0].count() == 0 and {r.session_id for r in nothing[1].collect()} == {"old", "new"}

    gone = after.with_tables(usage=rows(spark, "usage", claims[1:6] + claims[7:]))
    left = usage.owner_moves(gone.usage, gone.sessions, usage.usage_owners(after.usage, after.sessions), dirty)[0]
    assert {(r.content_id, r.from_session, r.to_session) for r in left.collect()} == {("c9", "new", None)}


def test_each_turn_is_ranked_in_one_round(spark, monkeypatch):
    claims = [turn("old", 1, "c1", 0), turn("copy", 2, "c1", 1), turn("copy", 3, "c2", 2), turn("third", 4, "c2", 3)]
    now, was = ([session("old", ended), session("copy", 4), session("third", 6)] for ended in (5, 2))
    table = rows(spark, "usage", claims)
    owners = usage.usage_owners(table, rows(spark, "sessions", was))
    asked, write = [], usage.written
    monkeypatch.setattr(usage, "written", lambda df, name: (out := write(df, name), name == "dirty-turns" and asked.append(out))[0])
    moves, _ = usage.owner_moves(table, rows(spark, "sessions", now), owners, spark.createDataFrame([("a", "old")], "agent string, session_id string"))
    assert [(r.content_id, r.from_session, r.to_session) for r in moves.collect()] == [("c1", "old", "copy")]
    assert [[r.content_id for r in df.collect()] for df in asked] == [["c1"], ["c2"]]


def test_owners_of_priced_usage_are_those_that_ranking_gives(spark):
    claims = [turn(f"s{k % 3}", k, f"c{k % 4}" if k % 5 else "", k) for k in range(20)]
    c = Corpus(spark, rates=pricing.rates_from_json(spark, RATES), sessions=rows(spark, "sessions", [session(f"s{k}", 9 - k) for k in range(3)]), usage=rows(spark, "usage", claims))
    want = sorted(map(tuple, usage.usage_owners(c.usage, c.sessions).collect()))
    assert sorted(map(tuple, usage.owners_of(usage.priced_usage(c)).collect())) == want and len(want) == 4


def test_a_refresh_prices_only_touched_days(spark, monkeypatch):
    claims = [turn(f"s{k % 7}", k, f"c{k // 2}" if k % 9 else "", 2 * (k % 7) + k // 30) for k in range(60)] + [turn("s1", 90, "c1", 0, created_at=None)]
    was = [session(f"s{k}", 20 + k) for k in range(7)]
    now = [session(f"s{k}", 20 + k if k != 2 else 1) for k in range(7)]
    corpus = lambda s: Corpus(spark, rates=pricing.rates_from_json(spark, RATES), sessions=rows(spark, "sessions", s), usage=rows(spark, "usage", claims))
    before, after = corpus(was), corpus(now)
    old = usage.build_rollups(usage.priced_usage(before))
    dirty = spark.createDataFrame([("a", "s2")], "agent string, session_id string")
    moves, _ = usage.owner_moves(after.usage, after.sessions, usage.usage_owners(before.usage, before.sessions), dirty)
    assert moves.count() > 0
    days = {r.day for r in usage.touched_days(after, old[1], dirty, moves).collect()}
    priced, price = [], usage.price
    monkeypatch.setattr(usage, "price", lambda df, rates: priced.append(df.withColumn("day", usage.usage_day())) or price(df, rates))
    got = usage.refresh_moved(after, old, dirty, moves)
    assert {r.day for r in priced[0].select("day").distinct().collect()} <= days < {r.day for r in old[1].select("day").distinct().collect()}
    monkeypatch.undo()
    want = usage.build_rollups(usage.priced_usage(after))
    for g, w in zip(got, want, strict=True):
        assert Counter(map(tuple, g.select(*w.columns).collect())) == Counter(map(tuple, w.collect()))


# -- totals of subtrees
def plain_totals(edges, values):
    below = defaultdict(set)
    for child, up in edges:
        if child != up:
            below[up].add(child)
    out = {}
    for root in {x for e in edges if e[0] != e[1] for x in e}:
        seen, todo = set(), [root]
        while todo:
            for child in below[todo.pop()] - seen:
                seen.add(child)
                todo.append(child)
        out[root] = len(seen - {root}), sum(values.get(n, 0) or 0 for n in seen - {root})
    return out


def totals(spark, edges, values):
    table = spark.createDataFrame([("a", c, u, "subagent_of") for c, u in edges] + [("a", "n1", "n0", "fork_of")], "agent string, from_id string, to_id string, kind string")
    known = spark.createDataFrame([("a", n, v) for n, v in values.items()], "agent string, session_id string, v long")
    return {r.session_id: (r.sessions, r.v) for r in sessions.subtree_totals(table, known, ["v"]).collect()}


def test_totals_of_a_forest_with_rings_and_shared_nodes(spark):
    rnd = random.Random(4)
    edges = [(f"n{k + 1}", f"n{k}") for k in range(70)] + [(f"t{k}", f"t{rnd.randrange(k)}") for k in range(1, 40)]
    edges += [(f"r{(k + 1) % 3}", f"r{k}") for k in range(3)] + [("x", "r0"), ("y", "x"), ("self", "self"), ("z", "self"), ("t5", "t4"), ("t5", "t4")]
    values = {x: rnd.randrange(100) for e in edges for x in e if rnd.random() < 0.8} | {"n7": None}
    assert totals(spark, edges, values) == plain_totals(edges, values)
    shared = [*edges, ("n40", "n20"), ("y", "r1"), ("n60", "x")]  # several parents, across trees and into a ring
    assert totals(spark, shared, values) == plain_totals(shared, values)


def test_totals_of_no_edges(spark):
    assert totals(spark, [], {"n1": 4}) == {}
    assert totals(spark, [("b", "a")], {}) == {"a": (1, 0), "b": (0, 0)}


def test_one_root_touches_its_own_subtree(spark, monkeypatch):
    """Levels are written one by one and hold nothing of other trees."""
    edges = [("a", f"k{k}", f"k{k // 3}", "subagent_of") for k in range(1, 60)] + [("a", f"o{k + 1}", f"o{k}", "subagent_of") for k in range(40)]
    table = spark.createDataFrame(edges, "agent string, from_id string, to_id string, kind string")
    sizes, write = [], sessions.written
    monkeypatch.setattr(sessions, "written", lambda df, name: sizes.append((name, (out := write(df, name)).count())) or out)
    got = sessions.descendants(table, roots=spark.createDataFrame([("a", "k5")], "agent string, session_id string"))
    assert {r.node for r in got.collect()} == {f"k{k}" for k in [15, 16, 17, *range(45, 54)]}
    assert [n for _, n in sizes] == [1, 3, 9, 0] and {name for name, _ in sizes} == {"level"}
    monkeypatch.setattr(sessions, "LEVELS", 2)
    deep = sessions.descendants(table, roots=spark.createDataFrame([("a", "o10")], "agent string, session_id string"))
    assert {r.node for r in deep.collect()} == {f"o{k}" for k in range(11, 41)}
