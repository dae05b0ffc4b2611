"""What agents did: tool calls, events, changed files, commands, prompts, and the overview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoolsight.corpus import EVENT_KINDS, Corpus
from spoolsight.functions.scalars import day_of, fish_escaped, resolve_path, zsh_escaped
from spoolsight.operators import filters
from spoolsight.operators.scan import active_findings
from spoolsight.operators.usage import build_rollups, priced_usage

KEY = ["agent", "session_id"]
STATUSES = ("ok", "error", "blocked")


def tool_stats(c: Corpus, agent: str | None = None, since: str | None = None, until: str | None = None, sort: str = "errors", limit: int | None = None) -> DataFrame:
    """Calls, errors, sessions and durations by tool. Calls without a duration do not count in the mean."""
    order = {"errors": "errors", "total": "total_ms", "avg": "avg_ms", "calls": "calls"}
    if sort not in order:
        raise ValueError(f"unknown sort: {sort}")
    rows = c.tool_calls.where(filters.equal(F.col("agent"), agent) & filters.day_window(F.col("started_at"), since, until))
    sums = rows.groupBy("name", "kind").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("status") == "error").alias("errors"), F.countDistinct(*KEY).alias("sessions"), F.count("duration_ms").alias("timed"),
        F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("total_ms"), F.coalesce(F.avg("duration_ms"), F.lit(0.0)).alias("avg_ms"), F.coalesce(F.max("duration_ms"), F.lit(0)).alias("max_ms"),
    )
    return filters.page(sums, [F.desc(order[sort]), F.desc("calls"), F.col("name"), F.col("kind")], "tool_stats", limit)


def _events(c: Corpus, kind: str | None, status: str | None, agent: str | None, since: str | None, until: str | None) -> DataFrame:
    wanted = filters.one_of(F.col("kind"), kind, EVENT_KINDS, "kind") & filters.equal(F.col("agent"), agent) & filters.day_window(F.col("at"), since, until)
    return c.session_events.where(wanted & filters.one_of(F.col("status"), status, STATUSES, "status"))


def session_events(c: Corpus, kind: str | None = None, status: str | None = None, agent: str | None = None, session: str | None = None, since: str | None = None, until: str | None = None, sort: str = "time", limit: int | None = None, offset: int = 0) -> DataFrame:
    """Events, newest or longest first."""
    if sort not in ("time", "duration"):
        raise ValueError(f"unknown sort: {sort}")
    rows = _events(c, kind, status, agent, since, until).where(filters.equal(F.col("session_id"), session))
    tie = [F.desc("at"), F.desc("message_seq"), F.col("agent"), F.col("session_id"), F.col("kind")]
    return filters.page(rows, [F.desc("duration_ms"), *tie] if sort == "duration" else tie, "session_events", limit, offset)


def event_stats(c: Corpus, kind: str | None = None, group: str = "label", agent: str | None = None, since: str | None = None, until: str | None = None, limit: int | None = None) -> DataFrame:
    """Events by kind and label, status, agent, day or detail. An event without duration counts as 0 ms in the mean."""
    keys = {"label": F.col("label"), "status": F.col("status"), "agent": F.col("agent"), "day": day_of(F.col("at")), "detail": F.col("detail")}
    if group not in keys:
        raise ValueError(f"unknown group: {group}")
    rows = _events(c, kind, None, agent, since, until).withColumn("_ms", F.coalesce("duration_ms", F.lit(0)))
    sums = rows.groupBy("kind", F.coalesce(keys[group], F.lit("")).alias("group")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("status").isin("error", "blocked")).alias("failures"), F.countDistinct(*KEY).alias("sessions"),
        F.sum("_ms").alias("total_ms"), F.avg("_ms").alias("avg_ms"), F.max("_ms").alias("max_ms"),
    )
    return filters.page(sums, [F.desc("events"), F.col("kind"), F.col("group")], "event_stats", limit)


def compactions(c: Corpus, agent: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Compactions by agent: number, sessions, manual ones, mean context before them where it is known."""
    before = F.get_json_object("payload", "$.preTokens").cast("bigint")
    rows = _events(c, "compaction", None, agent, since, until).withColumn("_pre", before)
    return rows.groupBy("agent").agg(F.count(F.lit(1)).alias("compactions"), F.countDistinct("session_id").alias("sessions"), F.count_if(F.col("label") == "manual").alias("manual"), F.avg(F.when(F.col("_pre") > 0, F.col("_pre"))).alias("avg_before")).orderBy("agent")


def pull_requests(c: Corpus, agent: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Pull requests with the sessions that worked on them, newest first."""
    rows = _events(c, "pr_link", None, agent, since, until).where("detail <> ''")
    sums = rows.groupBy(F.col("detail").alias("url")).agg(F.max_by("label", F.struct("at", "label")).alias("repository"), F.countDistinct(*KEY).alias("sessions"), F.max("at").alias("last_at"))
    return sums.orderBy(F.desc("last_at"), "url")


def _sized_changes(c: Corpus) -> DataFrame:
    placed = c.tool_calls.where("lines_added is not null or lines_removed is not null").join(c.sessions.select(*KEY, F.col("cwd").alias("_cwd")), KEY)
    return placed.withColumn("file", resolve_path(F.coalesce("file_path", F.lit("")), F.coalesce("_cwd", F.lit(""))))


def changes(c: Corpus, group: str = "day", agent: str | None = None, since: str | None = None, until: str | None = None, limit: int | None = None) -> DataFrame:
    """Lines added and removed by day, agent or file, over calls whose size is known. Relative files are resolved first."""
    keys = {"day": day_of(F.col("started_at")), "agent": F.col("agent"), "file": F.col("file")}
    if group not in keys:
        raise ValueError(f"unknown group: {group}")
    rows = _sized_changes(c).where(filters.equal(F.col("agent"), agent) & filters.day_window(F.col("started_at"), since, until))
    sums = rows.groupBy(keys[group].alias("group")).agg(
        F.coalesce(F.sum("lines_added"), F.lit(0)).alias("added"), F.coalesce(F.sum("lines_removed"), F.lit(0)).alias("removed"), F.count(F.lit(1)).alias("changes"),
        F.countDistinct(F.nullif("file", F.lit(""))).alias("files"), F.countDistinct(*KEY).alias("sessions"),
    )
    order = [F.desc("group")] if group == "day" else [F.desc(F.col("added") + F.col("removed")), F.col("group")]
    return filters.page(sums, order, "changes", limit)


def commands(c: Corpus, agent: str | None = None, project: str | None = None, query: str | None = None, since: str | None = None, until: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Shell commands with their session, newest first."""
    return filters.page(_commands(c, agent, project, query, since, until), [F.desc("started_at"), *_command_ties(F.desc)], "commands", limit, offset)


def _command_ties(way) -> list[Column]:
    return [way("session_id"), way("seq"), way("agent")]


def _commands(c: Corpus, agent: str | None, project: str | None, query: str | None, since: str | None, until: str | None) -> DataFrame:
    wanted = filters.browsable_command(F.col("kind"), F.col("command")) & filters.equal(F.col("agent"), agent) & filters.contains(F.col("command"), query) & filters.day_window(F.col("started_at"), since, until)
    rows = c.tool_calls.where(wanted).join(c.sessions.select(*KEY, "cwd"), KEY)
    return rows.where(filters.contains(F.col("cwd"), project)).select("command", "started_at", "agent", "session_id", "seq", "cwd")


def export_commands(c: Corpus, fmt: str, path: str | None = None, limit: int | None = None, **options) -> DataFrame:
    """The newest commands, oldest first, as lines of a shell history: plain, bash, zsh or fish."""
    at = F.coalesce(F.unix_seconds("started_at"), F.lit(0)).cast("string")
    text = F.col("command")
    lines = {
        "plain": text,
        "bash": F.when(F.col("started_at").isNull(), text).otherwise(F.concat(F.lit("#"), at, F.lit("\n"), text)),
        "zsh": F.concat(F.lit(": "), at, F.lit(":0;"), zsh_escaped(text)),
        "fish": F.concat(F.lit("- cmd: "), fish_escaped(text), F.lit("\n  when: "), at),
    }
    if fmt not in lines:
        raise ValueError(f"unknown format: {fmt}")
    filters.positive("limit", limit)
    arguments = {"agent": None, "project": None, "query": None, "since": None, "until": None} | options
    rows = _commands(c, **arguments)
    if limit:
        rows = rows.orderBy(F.desc("started_at"), *_command_ties(F.desc)).limit(limit)
    out = rows.orderBy(F.asc("started_at"), *_command_ties(F.asc)).select(lines[fmt].alias("value"))
    if path is not None:
        out.write.mode("overwrite").text(path)
    return out


def history(c: Corpus, agent: str | None = None, query: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Prompts, newest first."""
    rows = c.history.where(filters.equal(F.col("agent"), agent) & filters.contains(F.col("display"), query))
    return filters.page(rows, [F.desc("at"), F.desc("display"), F.col("agent")], "history", limit, offset)


def tools(c: Corpus, agent: str, session_id: str, from_seq: int | None = None, to_seq: int | None = None, compact: bool = False, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Tool calls of a session in order; compact rows have 120 characters of detail instead of texts."""
    rows = c.tool_calls.where((F.col("agent") == agent) & (F.col("session_id") == session_id))
    if from_seq is not None:
        rows = rows.where(F.col("message_seq") >= from_seq)
    if to_seq is not None:
        rows = rows.where(F.col("message_seq") <= to_seq)
    slim = ["seq", "message_seq", "call_id", "name", "kind", "status", "started_at", "duration_ms", "lines_added", "lines_removed"]
    detail = F.substring(F.coalesce(F.nullif("command", F.lit("")), F.nullif("file_path", F.lit("")), F.col("input"), F.lit("")), 1, 120)
    shown = rows.select(*slim, detail.alias("detail")) if compact else rows.select(*slim, "file_path", "command", "excerpt", "input")
    return filters.page(shown, [F.col("seq")], "tools", limit, offset)


def tool(c: Corpus, agent: str, session_id: str, seq: int) -> DataFrame:
    """One tool call with all its texts; LookupError if there is none."""
    found = c.tool_calls.where((F.col("agent") == agent) & (F.col("session_id") == session_id) & (F.col("seq") == seq))
    if found.isEmpty():
        raise LookupError(f"no tool call {agent}/{session_id}/{seq}")
    return found


def artifacts(c: Corpus, agent: str | None = None, kind: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Artifacts with their size in bytes, newest first."""
    rows = c.artifacts.where(filters.equal(F.col("agent"), agent) & filters.equal(F.col("kind"), kind))
    return filters.page(rows.select("agent", "kind", "name", F.octet_length("content").cast("bigint").alias("bytes"), "modified_at"), [F.desc("modified_at"), F.col("kind"), F.col("name"), F.col("agent")], "artifacts", limit, offset)


def artifact_kinds(c: Corpus, agent: str | None = None) -> DataFrame:
    """Artifacts by kind, under the same agent filter as the list."""
    return c.artifacts.where(filters.equal(F.col("agent"), agent)).groupBy("kind").agg(F.count(F.lit(1)).alias("artifacts")).orderBy("kind")


def artifact(c: Corpus, agent: str, kind: str, name: str) -> dict[str, DataFrame]:
    """One artifact and its sessions; LookupError if there is none."""
    same = (F.col("agent") == agent) & (F.col("kind") == kind) & (F.col("name") == name)
    found = c.artifacts.where(same)
    if found.isEmpty():
        raise LookupError(f"no artifact {agent}/{kind}/{name}")
    return {"artifact": found, "sessions": c.artifact_links.where(same).orderBy("session_id")}


def recent_files(c: Corpus) -> DataFrame:
    """The newest 120 written or edited files, each path once, at most 20."""
    edits = c.tool_calls.where(F.col("kind").isin("file_write", "file_edit") & (F.col("file_path") != ""))
    newest = edits.orderBy(F.desc("started_at"), F.desc("session_id"), F.desc("seq")).limit(120)
    rank = F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("started_at"), F.desc("session_id"), F.desc("seq")))
    once = newest.withColumn("_r", rank).where("_r = 1")
    return once.select("file_path", "kind", *KEY, "started_at").orderBy(F.desc("started_at"), "file_path").limit(20)


def stats(c: Corpus, as_of: str) -> dict[str, DataFrame]:
    """Overview facets: counts, totals, agents, activity, workspaces, tool kinds, recent files. ``as_of`` is today."""
    today = filters.day(as_of)
    month = f"{today:%Y-%m}-01"
    daily, _ = build_rollups(priced_usage(c))
    tokens = F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_write")
    unpriced = F.col("unpriced_input") + F.col("unpriced_output") + F.col("unpriced_cache_read") + F.col("unpriced_cache_write")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    counts = count(c.sessions, "sessions")
    for df, name in ((c.messages, "messages"), (c.tool_calls, "tool_calls"), (c.tool_calls.where(filters.browsable_command(F.col("kind"), F.col("command"))), "commands"), (c.artifacts, "artifacts"), (active_findings(c), "findings")):
        counts = counts.crossJoin(count(df, name))  # of one row each
    in_month = F.col("day") >= month
    zero = F.lit(0).cast("bigint")
    whole = lambda x: F.coalesce(F.sum(x), zero).cast("bigint")
    usage_by_agent = daily.groupBy("agent").agg(whole(tokens).alias("tokens"), whole("cost_nanos").alias("cost_nanos"), whole(unpriced).alias("unpriced_tokens"))
    by_day = daily.groupBy("day").agg(whole("cost_nanos").alias("cost_nanos"), whole(unpriced).alias("unpriced_tokens"))
    agents = c.sessions.groupBy("agent").agg(F.count(F.lit(1)).alias("sessions"), F.max("modified_at").alias("last_active")).join(usage_by_agent, "agent", "left").na.fill(0, ["tokens", "cost_nanos", "unpriced_tokens"])
    touched = c.sessions.where(F.col("modified_at") >= F.date_sub(F.lit(today), 371).cast("timestamp")).groupBy(day_of(F.col("modified_at")).alias("day")).agg(F.count(F.lit(1)).alias("sessions"))
    return {
        "counts": counts,
        "totals": daily.agg(whole(tokens).alias("tokens"), whole("cost_nanos").alias("cost_nanos"), whole(F.when(in_month, F.col("cost_nanos"))).alias("cost_month_nanos"), whole(unpriced).alias("unpriced_tokens"), whole(F.when(in_month, unpriced)).alias("unpriced_month_tokens")),
        "agents": agents.orderBy(F.desc("cost_nanos"), F.desc("sessions"), "agent"),
        "activity": touched.join(by_day, "day", "left").na.fill(0, ["cost_nanos", "unpriced_tokens"]).orderBy("day"),
        "workspaces": c.sessions.where("cwd <> ''").groupBy("cwd").agg(F.count(F.lit(1)).alias("sessions"), F.max("modified_at").alias("last_active")).orderBy(F.desc("last_active"), "cwd").limit(8),
        "tool_kinds": c.tool_calls.groupBy("kind").agg(F.count(F.lit(1)).alias("calls")).orderBy(F.desc("calls"), "kind"),
        "recent_files": recent_files(c),
    }
