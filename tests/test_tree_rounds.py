"""The rounds of totals below nodes grow with the depth, not with the number of nodes; pairs stay among nodes above several parents."""

from spoolsight.operators import sessions


def test_rounds_and_pairs(spark, monkeypatch):
    edges = [(f"n{k}", f"n{k + 1 if k % 4 < 3 else k - 3}") for k in range(400)]  # rings of four
    edges += [("m1", "m0"), ("m2", "m1"), ("m2", "m0")] + [(f"x{k}", "m2") for k in range(50)]  # two parents, fifty leaves below
    seen = []
    write, below = sessions.written, sessions.descendants
    monkeypatch.setattr(sessions, "written", lambda df, name: (seen.append(name), write(df, name))[1])
    listed = []
    monkeypatch.setattr(sessions, "descendants", lambda *a, **k: (listed.append(below(*a, **k)), listed[-1])[1])
    table = spark.createDataFrame([("a", c, p, "subagent_of") for c, p in edges], "agent string, from_id string, to_id string, kind string")
    values = spark.createDataFrame([("a", n, 1) for n in {x for e in edges for x in e}], "agent string, session_id string, v bigint")
    got = {r.session_id: (r.sessions, r.v) for r in sessions.subtree_totals(table, values, ["v"]).collect()}
    assert got["n0"] == (3, 3) and got["m0"] == (52, 52) and got["m1"] == (51, 51) and got["m2"] == (50, 50) and got["x0"] == (0, 0)
    assert sum(n in ("cycle-pointers", "cycles") for n in seen) <= 6
    assert listed[-1].count() == 3


def test_edges_below_a_root_are_read_once(spark, tmp_path, monkeypatch):
    edges = [(f"n{k + 1}", f"n{k}") for k in range(5)] + [("m1", "m0"), ("n1", "n0")]
    spark.createDataFrame([("a", c, p, "subagent_of") for c, p in edges], "agent string, from_id string, to_id string, kind string").write.parquet(f"{tmp_path}/stored-edges")
    read, write = [], sessions.written
    monkeypatch.setattr(sessions, "written", lambda df, name: (read.append(df.inputFiles()), write(df, name))[1])
    roots = spark.createDataFrame([("a", "n0")], "agent string, session_id string")
    below = sessions.descendants(spark.read.parquet(f"{tmp_path}/stored-edges"), roots=roots)
    assert sorted(r.node for r in below.collect()) == ["n1", "n2", "n3", "n4", "n5"]
    assert len(read) > 5 and sum(any("stored-edges" in f for f in files) for files in read) == 1
