import json
from datetime import datetime

from spoolsight.sources import claude, codex, cursor, opencode, pi, sidefiles
from spoolsight.sources.lines import read_jsonl, split_lines


def lines_of(spark, files):
    rows = [(path, n, json.dumps(r) if not isinstance(r, str) else r) for path, records in files.items() for n, r in enumerate(records, 1)]
    return spark.createDataFrame(rows, "path string, line bigint, value string")


def by(rows, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in rows}


def test_bad_blank_and_long_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\nnot json\n{"x": 2}\n{"x": ')
    good, issues = read_jsonl(spark, str(tmp_path))
    assert sorted(r.line for r in good.collect()) == [1, 4]
    assert sorted((r.line, r.category, r.severity) for r in issues.collect()) == [(3, "bad_json", "error"), (5, "bad_json", "error")]
    long = spark.createDataFrame([("p", 1, '"' + "x" * (10 << 20) + '"')], "path string, line bigint, value string")
    good, issues = split_lines(long)
    assert good.count() == 0 and issues.first().category == "size_limit"


def test_numbers_of_a_log_that_is_split(spark, tmp_path):
    """A log is read by several tasks; lines keep their numbers, blank ones counted."""
    text = "".join("\n" if n % 7 == 0 else json.dumps({"n": n, "pad": "é" * (n % 300)}) + ("\r\n" if n % 2 else "\n") for n in range(1, 3001))
    (tmp_path / "big.jsonl").write_bytes(text.encode())
    (tmp_path / "small.jsonl").write_text('{"n": 1}')
    had = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        good, issues = read_jsonl(spark, str(tmp_path))
        assert good.rdd.getNumPartitions() > 3
        rows = [(r.path.rsplit("/", 1)[1], r.line, json.loads(r.value)["n"]) for r in good.select("path", "line", "value").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", had)
    assert all(line == n for _, line, n in rows) and issues.count() == 0
    assert sorted(n for f, _, n in rows if f == "big.jsonl") == [n for n in range(1, 3001) if n % 7] and len(rows) == 3000 - 3000 // 7 + 1


def test_claude_logs(spark):
    t = lambda s: f"2026-07-01T10:00:{s:02d}Z"
    usage = {"input_tokens": 10, "output_tokens": 5, "cache_read_input_tokens": 7, "cache_creation_input_tokens": 4, "cache_creation": {"ephemeral_1h_input_tokens": 3}}
    main = [
        {"type": "user", "uuid": "u0", "sessionId": "old", "timestamp": t(0), "message": {"role": "user", "content": "copied prompt"}, "cwd": "/w//p/"},
        {"type": "user", "uuid": "u1", "sessionId": "s1", "timestamp": t(1), "message": {"role": "user", "content": "<command-name>x"}, "gitBranch": "main"},
        {"type": "user", "uuid": "u2", "sessionId": "s1", "timestamp": t(2), "message": {"role": "user", "content": "Fix the bug"}},
        {"type": "assistant", "uuid": "a1", "sessionId": "s1", "timestamp": t(3), "requestId": "r1", "message": {"id": "m1", "role": "assistant", "model": "big", "usage": usage, "content": [
            {"type": "thinking", "thinking": " hm "}, {"type": "text", "text": "one"}, {"type": "text", "text": "two"}, {"type": "tool_use", "id": "c1", "name": "Bash", "input": {"command": "ls"}},
            {"type": "tool_use", "id": "c2", "name": "Write", "input": {"file_path": "/w/f", "content": "a\nb"}}]}},
        {"type": "user", "uuid": "u3", "sessionId": "s1", "timestamp": t(5), "toolUseResult": {"type": "create", "content": "a\nb\n"}, "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "c2", "content": "ok"}, {"type": "image", "source": {"media_type": "image/png", "data": "AA=="}}]}},
        {"type": "user", "uuid": "u4", "sessionId": "s1", "timestamp": t(6), "toolDenialKind": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "c1", "content": [{"type": "text", "text": "no"}], "is_error": True}]}},
        {"type": "system", "subtype": "compact_boundary", "sessionId": "s1", "timestamp": t(7), "content": "Compacted", "compactMetadata": {"trigger": "auto", "preTokens": 900, "postTokens": 90, "durationMs": 12}},
        {"type": "custom-title", "customTitle": "My title", "timestamp": t(8)},
        {"type": "pr-link", "prUrl": "https://x/1", "prRepository": "r", "prNumber": 1, "timestamp": t(8)},
        {"type": "pr-link", "prUrl": "https://x/1", "prRepository": "r", "prNumber": 1, "timestamp": t(9)},
        {"type": "attachment", "timestamp": t(9), "attachment": {"type": "hook_success", "hookEvent": "Stop", "command": "c", "exitCode": 2, "durationMs": 5}},
        {"type": "progress", "x": 1},
    ]
    nested = [{"type": "user", "uuid": "n1", "sessionId": "s1", "isSidechain": True, "timestamp": t(4), "message": {"role": "user", "content": "Look"}}]
    c = claude.from_lines(spark, lines_of(spark, {"/r/projects/p/s1.jsonl": main, "/r/projects/p/s1/subagents/agent-7.jsonl": nested}))
    sessions = by(c.sessions.collect(), "session_id")
    assert sessions["s1"].title == "My title" and sessions["s1"].workspace == "/w/p" and sessions["s1"].git_branch == "main"
    assert sessions["agent-7"].title == "Look"
    messages = by(c.messages.where("session_id = 's1'").collect(), "seq")
    assert [messages[k].text for k in range(4)] == ["copied prompt", "<command-name>x", "Fix the bug", "one\ntwo"]
    assert messages[3].thinking == "hm" and messages[6].kind == "compaction" and messages[4].images[0].pointer == "/content/1/source/data"
    u = c.usage.collect()
    assert [(x.seq, x.content_id, x.request_id, x.input, x.output, x.cache_read, x.cache_write, x.cache_write_1h) for x in u] == [(3, "m1", "r1", 10, 5, 7, 4, 3)]
    calls = by(c.tool_calls.collect(), "call_id")
    assert (calls["c1"].kind, calls["c1"].command, calls["c1"].status, calls["c1"].excerpt, calls["c1"].duration_ms) == ("shell", "ls", "error", "no", 3000)
    assert (calls["c2"].kind, calls["c2"].seq, calls["c2"].lines_added, calls["c2"].lines_removed, calls["c2"].new_text) == ("file_write", 1, 2, 0, "a\nb")
    events = by(c.session_events.collect(), "kind")
    assert set(events) == {"tool_denied", "compaction", "hook", "pr_link"} and events["hook"].status == "error" and events["compaction"].detail == "900 -> 90"
    assert c.session_events.where("kind = 'pr_link'").count() == 1
    edges = by(c.relations.collect(), "kind")
    assert (edges["resumed_from"].from_id, edges["resumed_from"].to_id, json.loads(edges["resumed_from"].evidence)["branchUuid"]) == ("s1", "old", "u0")
    assert (edges["subagent_of"].from_id, edges["subagent_of"].to_id) == ("agent-7", "s1")
    metas = spark.createDataFrame([("/x/agent-7.meta.json", '{"agentType": "helper"}')], "path string, value string")
    typed = by(claude.with_subagent_types(c.relations, metas).collect(), "kind")
    assert json.loads(typed["subagent_of"].evidence)["agentType"] == "helper"


def counts(i, c, o, total):
    return {"input_tokens": i, "cached_input_tokens": c, "cache_write_input_tokens": 0, "output_tokens": o, "reasoning_output_tokens": 1, "total_tokens": total}


def test_codex_logs(spark):
    e = lambda s, kind, **p: {"timestamp": f"2026-07-05T00:00:{s:02d}Z", "type": kind, "payload": p}
    msg = lambda s, role, text: e(s, "response_item", type="message", role=role, content=[{"type": "text", "text": text}])
    tok = lambda s, **info: e(s, "event_msg", type="token_count", info=info)
    records = [
        e(0, "session_meta", id="sid", cwd="/w", git={"branch": "dev"}), e(1, "turn_context", model="m1", effort="high"), msg(2, "user", "<environment_context>"), msg(3, "user", "Do it"), msg(4, "assistant", "ok"),
        tok(5, total_token_usage=counts(10, 4, 3, 13), last_token_usage=counts(10, 4, 3, 13)), tok(6, total_token_usage=counts(10, 4, 3, 13), last_token_usage=counts(10, 4, 3, 13)),
        e(7, "response_item", type="function_call", name="shell", call_id="c1", arguments=json.dumps({"command": ["bash", "-lc", "ls -l"]})), e(8, "response_item", type="function_call_output", call_id="c1", output=json.dumps({"output": "done"})),
        e(8, "response_item", type="custom_tool_call", name="apply_patch", call_id="c2", input="*** Begin Patch\n*** Update File: a.py\n-x\n+y\n+z\n*** End Patch"),
        tok(9, total_token_usage=counts(25, 4, 8, 33)), tok(10, total_token_usage=counts(5, 9, 1, 6)), e(11, "event_msg", type="task_complete", duration_ms=4000),
    ]
    files = {"/r/rollout-x.jsonl": records, "/r/session_index.jsonl": [{"id": "sid", "thread_name": "old"}, {"id": "sid", "thread_name": "Renamed"}]}
    c = codex.from_lines(spark, lines_of(spark, files))
    s = c.sessions.first()
    assert (s.session_id, s.title, s.cwd, s.git_branch) == ("sid", "Renamed", "/w", "dev")
    assert [(m.seq, m.role, m.kind, m.text, m.effort, m.model) for m in sorted(c.messages.collect(), key=lambda m: m.seq)] == [
        (0, "user", "message", "<environment_context>", "", "m1"), (1, "user", "message", "Do it", "", "m1"), (2, "assistant", "message", "ok", "high", "m1"), (3, "assistant", "info", "", "high", "m1"), (4, "assistant", "info", "", "high", "m1")]
    # attached to the held message; a repeat adds nothing; a difference; a restart whose subsets exceed its input
    assert [(u.seq, u.input, u.cache_read, u.output) for u in sorted(c.usage.collect(), key=lambda u: u.seq)] == [(2, 6, 4, 3), (3, 15, 0, 5), (4, 0, 9, 1)]
    assert [i.category for i in c.issues.collect()] == ["usage"]
    calls = by(c.tool_calls.collect(), "call_id")
    assert (calls["c1"].command, calls["c1"].kind, calls["c1"].excerpt, calls["c1"].duration_ms, calls["c1"].message_seq) == ("ls -l", "shell", "done", 1000, 2)
    assert (calls["c2"].file_path, calls["c2"].lines_added, calls["c2"].lines_removed, calls["c2"].kind) == ("a.py", 2, 1, "file_edit")
    assert c.session_events.first().duration_ms == 4000


def test_pi_logs(spark):
    t = lambda s: f"2026-07-01T00:00:{s:02d}Z"
    use = {"input": 3, "output": 2, "cacheRead": 1, "cacheWrite": 0, "cost": {"total": 0.001}}
    records = [
        {"type": "session", "id": "p1", "cwd": "/w", "timestamp": t(0), "parentSession": "p0"}, {"type": "model_change", "provider": "x", "modelId": "m"}, {"type": "thinking_level_change", "thinkingLevel": "low"},
        {"type": "message", "id": "e1", "timestamp": t(1), "message": {"role": "user", "content": "Hello there"}},
        {"type": "message", "id": "e2", "timestamp": t(2), "message": {"role": "assistant", "usage": use, "content": [{"type": "text", "text": "hi"}, {"type": "toolCall", "id": "c1", "name": "bash", "arguments": {"command": "pwd"}}]}},
        {"type": "message", "id": "e3", "timestamp": t(4), "message": {"role": "toolResult", "toolCallId": "c1", "isError": True, "content": [{"type": "text", "text": "bad"}], "nestedCalls": {"calls": [{"id": "n1", "name": "read", "status": "ok", "arguments": {"path": "f"}, "durationMs": 4.6}]}}},
        {"type": "model_change", "modelId": "m2"},
        {"type": "message", "id": "e4", "timestamp": t(5), "message": {"role": "assistant", "stopReason": "error", "errorMessage": "Rate limit hit", "content": []}},
        {"type": "compaction", "id": "e5", "timestamp": t(6), "summary": "short", "tokensBefore": 50},
    ]
    c = pi.from_lines(spark, lines_of(spark, {"/r/a.jsonl": records, "/r/b.jsonl": [{"type": "message"}]}))
    s = c.sessions.first()
    assert (s.session_id, s.title, s.workspace) == ("p1", "Hello there", "/w") and c.issues.first().category == "format"
    m = by(c.messages.collect(), "external_id")
    assert (m["e2"].provider, m["e2"].model, m["e2"].effort, m["e2"].text) == ("x", "m", "low", "hi")
    assert (m["e4"].provider, m["e4"].model) == ("", "m2") and m["e5"].kind == "compaction" and m["e3"].role == "tool"
    u = c.usage.first()
    assert (u.input, u.output, u.reported_nanos) == (3, 2, 1_000_000)
    calls = by(c.tool_calls.collect(), "call_id")
    assert (calls["c1"].status, calls["c1"].command, calls["c1"].duration_ms) == ("error", "pwd", 2000) and (calls["n1"].kind, calls["n1"].duration_ms, calls["n1"].status) == ("file_read", 5, "ok")
    assert {(e.kind, e.label) for e in c.session_events.collect()} == {("api_error", "rate_limit"), ("compaction", "")}
    assert c.relations.first().to_id == "p0"


def test_opencode_documents(spark, tmp_path):
    for name, rows in {"session": [{"id": "s1", "title": "T", "directory": "/w", "time": {"created": 1000, "updated": 9000}}, {"id": "s2", "title": "old", "parentID": "s1", "directory": "/w", "time": {"created": 1, "updated": 2}}],
                       "message": [{"id": "m1", "sessionID": "s1", "role": "assistant", "providerID": "p", "modelID": "m", "time": {"created": 2000}, "cost": 0.5, "tokens": {"input": 1, "output": 2, "reasoning": 3, "cache": {"read": 4, "write": 5}}}],
                       "part": [{"id": "a", "messageID": "m1", "type": "text", "text": "x"}, {"id": "b", "messageID": "m1", "type": "tool", "tool": "bash", "callID": "c", "state": {"status": "completed", "input": {"command": "ls"}, "output": "o"}}]}.items():
        (tmp_path / name).mkdir()
        for k, r in enumerate(rows):
            (tmp_path / name / f"{k}.json").write_text(json.dumps(r, indent=1))
    native = opencode.read_documents(spark, *(str(tmp_path / n) for n in ("session", "message", "part")))
    c = opencode.ingest_opencode(spark, (native[0].where("id = 's1'"), native[1]), native)
    assert sorted(s.session_id for s in c.sessions.collect()) == ["s1", "s2"] and c.messages.count() == 1
    u = c.usage.first()
    assert (u.output, u.reasoning, u.reported_nanos) == (5, 3, 500_000_000)
    call = c.tool_calls.first()
    assert (call.status, call.command, call.kind) == ("ok", "ls", "shell") and c.relations.first().kind == "fork_of"


def test_cursor_rows(spark):
    h = lambda o: json.dumps(o).encode().hex()
    meta = spark.createDataFrame([("s", 1, h({"x": 1})), ("s", 2, h({"name": "N", "workspaceRoot": "/w", "createdAt": 5000}))], "session_id string, rowid bigint, value string")
    blobs = spark.createDataFrame([("s", "10", h({"role": "assistant", "content": "b", "model": "m", "usage": {"inputTokens": 2, "outputTokens": 1}})), ("s", "9", h({"role": "user", "content": "a", "timestamp": 6000})), ("s", "11", "zz"), ("s", "12", h({"no": 1}))], "session_id string, id string, data string")
    c = cursor.ingest_cursor(spark, meta, blobs)
    assert [(m.seq, m.text) for m in sorted(c.messages.collect(), key=lambda m: m.seq)] == [(0, "a"), (1, "b")]
    s = c.sessions.first()
    assert (s.title, s.cwd, s.created_at) == ("N", "/w", datetime(1970, 1, 1, 0, 0, 5)) and c.issues.count() == 1 and c.usage.first().input == 2


def test_side_files(spark, tmp_path):
    uid = "33333333-aaaa-bbbb-cccc-333333333333"
    for path, text in {"plans/p.md": "plan", f"tasks/{uid}/2.json": "two", f"tasks/{uid}/1.json": "one", f"todos/{uid}-agent.json": "[]", "projects/-w/memory/m.md": "mem", "usage-data/facets/f.json": json.dumps({"session_id": "s9"}), "other/x": "no"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    artifacts, links = sidefiles.ingest_artifacts(spark, str(tmp_path))
    rows = by(artifacts.collect(), "kind")
    assert set(rows) == {"plan", "task_group", "todo_list", "memory", "usage_facet"}
    assert rows["task_group"].content == "1.json\none\n2.json\ntwo" and rows["memory"].name == "-w/m.md"
    assert {(r.kind, r.session_id) for r in links.collect()} == {("task_group", uid), ("todo_list", uid), ("usage_facet", "s9")}
    (tmp_path / "history.jsonl").write_text('{"display": "hi", "timestamp": 1000}\n{"display": null}\n')
    assert [(r.display, r.at) for r in sidefiles.ingest_history(spark, str(tmp_path / "history.jsonl")).collect()] == [("hi", datetime(1970, 1, 1, 0, 0, 1))]
