import json
import posixpath

import pytest
from pyspark.sql import functions as F

from spoolsight.functions import scalars as S
from spoolsight.operators import filters


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_truncation_at_every_byte(spark):
    text = "aé日😀b\n"
    rows = spark.range(len(text.encode()) + 2).select("id")
    got = [spark.range(1).select(S.truncate_bytes(F.lit(text), n).alias("v")).first().v for n in range(len(text.encode()) + 2)]
    assert got == [text.encode()[:n].decode(errors="ignore") for n in range(len(text.encode()) + 2)] and rows.count() == len(got)
    assert value(spark, S.truncate_bytes(F.lit("abcdef"), 3, "~")) == "abc~"


@pytest.mark.parametrize("path", ["/a//b/./c/", "/a/../..", "a/../../b", " /x/y ", "", "/", ".", "a/..", "/../a", "//a", "../x/..", "a/b/../c"])
def test_canonical_path(spark, path):
    import re

    p = path.strip()
    want = re.sub("^//", "/", posixpath.normpath(p)) if p else ""
    want = "" if want == "." else want
    assert value(spark, S.canonical_path(F.lit(path))) == want == filters.canonical_argument(path)


def test_text_helpers(spark):
    v = lambda c: value(spark, c)
    assert [v(S.text_line_count(F.lit(t))) for t in ("", "a", "a\n", "a\nb", "\n\n")] == [0, 1, 1, 2, 2]
    counts = v(S.diff_line_counts(F.array(*map(F.lit, ["+++ b", "--- a", "+x", "-y", "-z", " k", "*** f"]))))
    assert (counts.added, counts.removed) == (1, 2)
    assert v(S.resolve_path(F.lit("a.py"), F.lit("/w//"))) == "/w/a.py" and v(S.resolve_path(F.lit("/a"), F.lit("/w"))) == "/a"
    assert v(S.command_line(F.lit('{"command": ["bash", "-lc", "ls"]}'))) == "ls" and v(S.command_line(F.lit('{"command": ["a", "b"]}'))) == "a b" and v(S.command_line(F.lit('{"cmd": "x"}'))) == "x" and v(S.command_line(F.lit("{}"))) == ""
    assert v(S.error_class(F.lit("Socket hang up"))) == "connection" and v(S.error_class(F.lit("?"))) == "error"
    assert v(S.content_text(F.lit('[{"type": "text", "text": "a"}, {"type": "x", "text": "n"}, {"type": "text", "text": "b"}]'))) == "a\nb" and v(S.content_text(F.lit('"q\\n"'))) == "q\n"
    assert v(S.plan_key(F.lit("\n a  \nb\t\r\n\n"))) == "a\nb" and v(S.plan_key(F.lit(" \n"))) is None
    assert v(S.memory_path_tail(F.lit("/projects/x/projects/p/memory/m"))) == "/projects/p/memory/m" and v(S.memory_path_tail(F.lit("/projects/p/m"))) is None
    assert v(S.tool_kind(F.lit("claude"), F.lit("Bash"))) == "shell" and v(S.tool_kind(F.lit("pi"), F.lit("nope"))) == "other"
    assert v(S.zsh_escaped(F.lit("a\n\nb"))) == "a\\\\\n\\\nb" and v(S.zsh_escaped(F.lit("a\\b"))) == "a\\b"
    assert v(S.fish_escaped(F.lit("a\\n\nb"))) == "a\\\\n\\nb"
    assert [v(S.usd_exact(F.lit(n).cast("bigint"))) for n in (0, 1, -1_500_000_000, 2_000_000_000)] == ["0", "0.000000001", "-1.5", "2"]
    assert v(S.first_patched_file(F.lit("*** Begin\n*** Update File: a b.py \nx"))) == "a b.py"
    assert v(S.redacted(F.lit("AKIAABCDEFGH"))) == "AKIA***" and v(S.redacted(F.lit("abcd"))) == "ab***"
    assert v(S.joined_thinking(F.array(F.lit(" a "), F.lit(" "), F.lit("b")))) == "a\n\nb"
    assert v(S.path_name(F.lit("/a/b"))) == "b" and v(S.path_name(F.lit("/"))) == "/"


def test_day_window_includes_its_last_day(spark):
    rows = spark.sql("select * from values (timestamp'2026-01-01 00:00:00'), (timestamp'2026-01-02 23:59:59'), (timestamp'2026-01-03'), (null) as t(at)")
    assert rows.where(filters.day_window(F.col("at"), "2026-01-01", "2026-01-02")).count() == 2
    assert rows.where(filters.day_window(F.col("at"), None, None)).count() == 4
    assert rows.where(filters.contains(F.lit("50%_Off"), "%_o")).count() == 4 and rows.where(filters.contains(F.lit("50x off"), "%")).count() == 0


def test_json_pointers(spark):
    doc = '{"a": [{"b": 1}, "x"], "a/b": {"~": "t", "": "e"}, "0": "zero", "it\'s": [[2]], "null": null, "~1": "s"}'
    want = {"/a/0/b": "1", "/a/1": '"x"', "/a~1b/~0": '"t"', "/a~1b/": '"e"', "/0": '"zero"', "/it's/0/0": "2", "/null": "null", "/~01": '"s"', "/a/2": None, "/a/01": None, "/a/-": None, "/a/b": None, "/null/x": None, "a": None, "/a/1/0": None}
    rows = spark.createDataFrame([(doc, p) for p in want] + [(doc, ""), (doc, None), ("{", "/a"), (None, "/a")], "doc string, pointer string")
    out = rows.select("doc", "pointer", F.to_json(S.json_pointer(F.col("doc"), F.col("pointer"))).alias("v")).collect()
    assert {r.pointer: r.v for r in out[: len(want)]} == want
    assert json.loads(out[-4].v) == json.loads(doc) and [r.v for r in out[-3:]] == [None] * 3
