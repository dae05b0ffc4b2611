"""Token usage: ownership across sessions, rollups, and the reads over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoolsight.corpus import Corpus
from spoolsight.functions.scalars import day_of
from spoolsight.operators import filters
from spoolsight.operators.pricing import price
from spoolsight.shared import written

TOKENS = ("input", "output", "cache_read", "cache_write", "cache_write_1h")
UNPRICED = ("unpriced_input", "unpriced_output", "unpriced_cache_read", "unpriced_cache_write")
BLOCK_SECONDS = 18000
# Levels of effort in ascending order.
LEVELS = ("", "minimal", "low", "medium", "high", "xhigh", "max")


def richest_claims(claims: DataFrame) -> DataFrame:
    """One observation of each turn per session: the newest parser's, then the one with more output, then more in all, then
    the later one. A cost reported as other than zero is taken over from the best observation of that parser version which
    has one. Rows without content id are observations of their own.
    """
    total = sum((F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)) for c in TOKENS[:4]), F.lit(0))
    rank = F.struct(F.coalesce("parser_version", F.lit(0)).alias("version"), F.coalesce("output", F.lit(0)).alias("output"), total.alias("total"), F.col("seq"))
    key = ["agent", "session_id", "content_id", "request_id"]
    named = claims.where("content_id <> ''").withColumn("_rank", rank)
    value = F.struct(*(c for c in claims.columns if c not in key))
    costed = F.when(F.coalesce("reported_nanos", F.lit(0)) != 0, F.col("_rank"))
    best = named.groupBy(*key).agg(F.max_by(value, "_rank").alias("v"), F.max("_rank").alias("top"), F.max_by("reported_nanos", costed).alias("cost"), F.max(costed).alias("cost_rank"))
    inherited = F.when((F.coalesce("v.reported_nanos", F.lit(0)) == 0) & (F.col("cost_rank.version") == F.col("top.version")), F.col("cost")).otherwise(F.col("v.reported_nanos"))
    folded = best.select(*key, *(inherited.alias(c) if c == "reported_nanos" else F.col(f"v.{c}").alias(c) for c in claims.columns if c not in key))
    return folded.select(*claims.columns).unionByName(claims.where("content_id = '' or content_id is null"))


def _placed(claims: DataFrame, sessions: DataFrame) -> DataFrame:
    """Owned claims with their session's workspace and times, and whether it is known."""
    about = sessions.select("agent", "session_id", "workspace", F.col("created_at").alias("session_created_at"), F.col("modified_at").alias("_ended"), F.lit(True).alias("_known"))
    placed = claims.join(about, ["agent", "session_id"], "left")
    alone = F.coalesce("content_id", F.lit("")) == ""
    spread = F.when(alone, F.xxhash64("session_id", "seq"))
    order = [F.col("_ended").asc_nulls_last(), F.col("session_created_at").asc_nulls_last(), "session_id", "seq"]
    first = F.row_number().over(Window.partitionBy("agent", "content_id", "request_id", spread).orderBy(*order))
    return placed.withColumn("_r", first).where((F.col("_r") == 1) | alone)


def own_usage(claims: DataFrame, sessions: DataFrame) -> DataFrame:
    """Usage rows that are charged: a turn that several sessions carry belongs to the one that ended first.

    Of equal ends the earlier created session, then the smaller id, then the earlier message owns it; unknown ends come last.
    Rows without content id are never duplicates; they are spread by session and message, and cannot skew the turns' keys.
    """
    return _placed(claims, sessions.withColumn("workspace", F.lit(None))).select(*claims.columns)


def priced_usage(c: Corpus, only: DataFrame | None = None) -> DataFrame:
    """Owned usage with its cost, its session's workspace and times. Ownership is decided before pricing, pricing before any
    sum.

    ``only``: sessions to give the usage of. Who owns a turn is decided among all sessions that carry it, so the turns of the
    asked sessions are looked up by key in all usage, and nothing else of it is ranked or priced.
    """
    claims = c.usage
    if only is not None:
        own = claims.join(only.select("agent", "session_id"), ["agent", "session_id"], "left_semi")
        alone = F.coalesce("content_id", F.lit("")) == ""
        keys = own.where(~alone).select("agent", "content_id", F.coalesce("request_id", F.lit("")).alias("_request")).distinct()
        shared = claims.where(~alone).withColumn("_request", F.coalesce("request_id", F.lit(""))).join(keys, ["agent", "content_id", "_request"], "left_semi").drop("_request")
        claims = shared.unionByName(own.where(alone))
    placed = _placed(claims, c.sessions).where("_known").select(*claims.columns, "workspace", "session_created_at")
    if only is not None:
        placed = placed.join(only.select("agent", "session_id"), ["agent", "session_id"], "left_semi")
    return price(placed, c.rates)


def _sums(prefix: str = "") -> list[Column]:
    whole = lambda name: F.sum(F.coalesce(F.col(name), F.lit(0)).cast("decimal(38,0)")).cast("bigint")
    return [*(F.sum(F.coalesce(F.col(t), F.lit(0))).cast("bigint").alias(t) for t in TOKENS), *(F.sum(u).cast("bigint").alias(u) for u in UNPRICED), whole("amount_nanos").alias("cost_nanos"), whole("reported_cost_nanos").alias("reported_nanos"), whole("estimated_nanos").alias("estimated_nanos")]


def usage_day() -> Column:
    """Day of a usage row; without message time its session's first day, else the empty day."""
    return day_of(F.coalesce("created_at", "session_created_at"))


def build_rollups(priced: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Daily sums by (day, agent, workspace, model), and which sessions were active in each such group.

    ``priced`` is false for a group with any unpriced token. Rows are priced before this, so a provider need not be a key.
    """
    rows = priced.withColumn("day", usage_day())
    keys = ["day", "agent", "workspace", "model"]
    daily = rows.groupBy(*keys).agg(*_sums(), F.count(F.lit(1)).alias("requests"), (F.sum("unpriced_tokens") == 0).alias("priced"))
    return daily, rows.select(*keys, "session_id").distinct()


def write_rollups(daily: DataFrame, members: DataFrame, folder: str) -> None:
    """Store both rollups by day; only the days present are replaced."""
    for name, df in (("daily", daily), ("members", members)):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{folder}/{name}")


def refresh_rollups(old: tuple[DataFrame, DataFrame], priced: DataFrame, dirty: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rollups after some sessions changed: ``dirty`` has their agent and session_id.

    Days on which such a session was or is active are computed anew from all usage of these days; other days are kept.
    """
    daily, members = old
    rows = priced.withColumn("day", usage_day())
    days = members.join(dirty, ["agent", "session_id"], "left_semi").select("day").union(rows.join(dirty, ["agent", "session_id"], "left_semi").select("day")).distinct()
    new_daily, new_members = build_rollups(rows.join(days, "day", "left_semi").drop("day"))
    return daily.join(days, "day", "left_anti").unionByName(new_daily), members.join(days, "day", "left_anti").unionByName(new_members)


TURN = ["agent", "content_id", "request_id"]


def _turns(rows: DataFrame) -> DataFrame:
    """Rows with a content id; a null request counts as an empty one."""
    return rows.where("content_id <> ''").withColumn("request_id", F.coalesce("request_id", F.lit("")))


def usage_owners(claims: DataFrame, sessions: DataFrame) -> DataFrame:
    """Who owns each turn that has a content id: agent, content_id, request_id, session_id, seq."""
    return owners_of(_placed(_turns(claims), sessions.withColumn("workspace", F.lit(None))))


def owners_of(owned: DataFrame) -> DataFrame:
    """The same from rows that are owned already, as of ``own_usage`` or ``priced_usage``; ranks nothing. A turn has one form of its request
    id there: not null in some rows and empty in others."""
    return _turns(owned).select(*TURN, "session_id", "seq")


def owner_moves(claims: DataFrame, sessions: DataFrame, owners: DataFrame, dirty: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What changes owner after the sessions ``dirty`` (agent, session_id) have changed, and all sessions that are dirty then.

    ``owners`` is what ``usage_owners`` gave before. Only keys of turns that a dirty session has or owned are looked at: their copies
    are ranked anew, among all sessions that carry them. A move makes both its sessions dirty, whose keys are looked at
    next, until no session is added. Moves: agent, content_id, request_id, from_session, from_seq, to_session, to_seq; a turn that
    is new comes from null, one that nobody carries any more goes to null. Each round is written; its keys are shuffled,
    and of claims and owners only the rows with these keys. A key is looked at in one round only, as all that carry it are ranked there.
    """
    named, key = _turns(claims), ["agent", "session_id"]
    asked = written(dirty.select(*key).distinct(), "dirty-sessions")
    known, moves, seen = asked, None, None
    while True:
        keys = named.join(asked, key, "left_semi").select(*TURN).union(owners.join(asked, key, "left_semi").select(*TURN)).distinct()
        keys = written(keys if seen is None else keys.join(seen, TURN, "left_anti"), "dirty-turns")
        if seen is not None and keys.isEmpty():
            return moves, known
        seen = keys if seen is None else seen.unionByName(keys)
        now = usage_owners(named.join(keys, TURN, "left_semi"), sessions).select(*TURN, F.col("session_id").alias("to_session"), F.col("seq").alias("to_seq"))
        before = owners.join(keys, TURN, "left_semi").select(*TURN, F.col("session_id").alias("from_session"), F.col("seq").alias("from_seq"))
        same = F.col("from_session").eqNullSafe(F.col("to_session")) & F.col("from_seq").eqNullSafe(F.col("to_seq"))
        here = written(before.join(now, TURN, "full_outer").where(~same), "owner-moves")
        moves = here if moves is None else moves.unionByName(here)
        ends = here.select("agent", F.col("from_session").alias("session_id")).union(here.select("agent", "to_session"))
        asked = written(ends.where("session_id is not null").distinct().join(known, key, "left_anti"), "dirty-sessions")
        if asked.isEmpty():
            return moves, known
        known = known.unionByName(asked)


def touched_days(c: Corpus, members: DataFrame, dirty: DataFrame, moves: DataFrame) -> DataFrame:
    """``day``: where the changed sessions were active when stored or are now, and the days of both rows of every move."""
    key = ["agent", "session_id"]
    stored = members.join(dirty, key, "left_semi").select("day")
    moved = moves.select("agent", F.col("from_session").alias("session_id"), F.col("from_seq").alias("seq"))
    moved = moved.union(moves.select("agent", "to_session", "to_seq")).where("session_id is not null").distinct()
    cells = [*key, "created_at"]
    rows = c.usage.join(dirty, key, "left_semi").select(*cells).union(c.usage.join(moved, [*key, "seq"], "left_semi").select(*cells))
    return stored.union(_dated(rows, c.sessions).select("day")).distinct()


def _dated(claims: DataFrame, sessions: DataFrame) -> DataFrame:
    starts = sessions.select("agent", "session_id", F.col("created_at").alias("session_created_at"))
    return claims.join(starts, ["agent", "session_id"], "left").withColumn("day", usage_day())


def priced_days(c: Corpus, days: DataFrame) -> DataFrame:
    """Owned and priced usage of some days, as ``priced_usage`` gives it. Only claims of these days and, to decide who owns them, other
    copies of their turns are read on; only owned rows of these days are priced. Rows without content id get their day when their session
    is joined."""
    alone = F.coalesce("content_id", F.lit("")) == ""
    request = F.coalesce("request_id", F.lit("")).alias("_request")
    keys = _dated(c.usage.where(~alone), c.sessions).join(days, "day", "left_semi").select("agent", "content_id", request).distinct()
    shared = c.usage.where(~alone).select("*", request).join(keys, ["agent", "content_id", "_request"], "left_semi").drop("_request")
    placed = _placed(shared.unionByName(c.usage.where(alone)), c.sessions).where("_known")
    mine = placed.withColumn("day", usage_day()).join(days, "day", "left_semi")
    return price(mine.select(*c.usage.columns, "workspace", "session_created_at"), c.rates)


def refresh_moved(c: Corpus, old: tuple[DataFrame, DataFrame], dirty: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rollups after the sessions ``dirty`` changed and turns moved (``owner_moves``): the touched days are priced and summed anew, all
    others are kept as they are stored."""
    daily, members = old
    days = written(touched_days(c, members, dirty, moves), "touched-days")
    new_daily, new_members = build_rollups(priced_days(c, days))
    return daily.join(days, "day", "left_anti").unionByName(new_daily), members.join(days, "day", "left_anti").unionByName(new_members)


GROUPS = {"day": "day", "model": "model", "project": "workspace", "agent": "agent"}


def usage_from_rollups(daily: DataFrame, members: DataFrame, group: str = "day", agent: str | None = None, model: str | None = None, project: str | None = None, since: str | None = None, until: str | None = None, limit: int | None = None) -> DataFrame:
    """Tokens, cost and distinct sessions by day, model, project or agent, from the two rollups.

    Sessions cannot be added up over groups, so they are counted from the membership. Days come newest first, other
    groups by cost; ties go by name.
    """
    wanted, key = _usage_filter(group, agent, model, project, since, until, limit), GROUPS[group]
    sums = daily.where(wanted).groupBy(F.col(key).alias("group")).agg(*(F.sum(c).cast("bigint").alias(c) for c in (*TOKENS, *UNPRICED, "cost_nanos", "reported_nanos", "estimated_nanos", "requests")), F.min("priced").alias("priced"))
    sessions = members.where(wanted).groupBy(F.col(key).alias("group")).agg(F.countDistinct("agent", "session_id").alias("sessions"))
    order = [F.desc("group")] if group == "day" else [F.desc("cost_nanos"), F.col("group")]
    return filters.page(sums.join(sessions, "group", "left"), order, "usage", limit)


def _usage_filter(group: str, agent: str | None, model: str | None, project: str | None, since: str | None, until: str | None, limit: int | None) -> Column:
    if group not in GROUPS:
        raise ValueError(f"unknown group: {group}")
    filters.positive("limit", limit)
    window = F.lit(True)
    if since:
        window = window & (F.col("day") >= str(filters.day(since)))
    if until:
        window = window & (F.col("day") <= str(filters.day(until))) & (F.col("day") != "")
    if project:
        window = window & (F.col("workspace") == filters.canonical_argument(project))
    return window & filters.equal(F.col("agent"), agent) & filters.equal(F.col("model"), model)


def usage(c: Corpus, group: str = "day", agent: str | None = None, model: str | None = None, project: str | None = None, since: str | None = None, until: str | None = None, limit: int | None = None) -> DataFrame:
    """As ``usage_from_rollups``, in one pass over the corpus."""
    wanted, key = _usage_filter(group, agent, model, project, since, until, limit), GROUPS[group]
    rows = priced_usage(c).withColumn("day", usage_day()).where(wanted)
    sums = rows.groupBy(F.col(key).alias("group")).agg(*_sums(), F.count(F.lit(1)).alias("requests"), (F.sum("unpriced_tokens") == 0).alias("priced"), F.countDistinct("agent", "session_id").alias("sessions"))
    order = [F.desc("group")] if group == "day" else [F.desc("cost_nanos"), F.col("group")]
    return filters.page(sums, order, "usage", limit)


def usage_pivot(c: Corpus, group: str = "agent", values: list[str] | None = None) -> DataFrame:
    """Daily cost series for export: a column for each group, 0 where a day has none, and whether the day is incomplete."""
    daily, _ = build_rollups(priced_usage(c))
    sums = daily.groupBy("day").pivot(GROUPS[group], values).agg(F.sum("cost_nanos").cast("bigint"))
    whole = daily.groupBy("day").agg((~F.min("priced")).alias("incomplete"))
    return sums.na.fill(0).join(whole, "day").orderBy("day")


def blocks(c: Corpus, agent: str | None = None, limit: int | None = None, as_of: str | None = None) -> DataFrame:
    """Usage by fixed windows of five hours since the epoch, newest first.

    The newest usage day's end is the anchor; windows further back than ``limit`` from it are left out. Rows without message
    time take no part but in that day. ``active``: the window contains ``as_of``.
    """
    default, most = filters.LIMITS["blocks"]
    limit = limit or default
    if limit < 0 or limit > most:
        raise ValueError(f"limit of blocks is 0 to {most}")
    rows = priced_usage(c).where(filters.equal(F.col("agent"), agent)).withColumn("win", F.expr(f"unix_seconds(created_at) div {BLOCK_SECONDS}"))
    sums = rows.groupBy("win").agg(*_sums(), F.countDistinct("agent", "session_id").alias("sessions"), F.count(F.lit(1)).alias("requests"), F.max(usage_day()).alias("day"))
    # one row a window: 1,753 a year
    anchor = F.unix_seconds(F.to_timestamp(F.nullif(F.max("day").over(Window.partitionBy(F.lit(0))), F.lit("")))) + 86400
    sums = sums.withColumn("anchor", anchor).where(f"win >= anchor div {BLOCK_SECONDS} - {int(limit)}").drop("anchor", "day")
    now = F.lit(as_of).cast("timestamp")
    start = F.timestamp_seconds(F.col("win") * BLOCK_SECONDS)
    end = F.timestamp_seconds((F.col("win") + 1) * BLOCK_SECONDS)
    out = sums.select(start.alias("start"), end.alias("end"), *(x for x in sums.columns if x != "win"), F.coalesce((start <= now) & (now < end), F.lit(False)).alias("active"))
    return out.orderBy(F.desc("start")).limit(limit)


def effort(c: Corpus, group: str = "level", agent: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Requests, tokens and cost by level of effort, for each agent or day too. Assistant messages only; no level is a level."""
    if group not in ("level", "agent", "day"):
        raise ValueError(f"unknown group: {group}")
    said = c.messages.where("role = 'assistant'").select("agent", "session_id", "seq", F.coalesce("effort", F.lit("")).alias("level"))
    rows = priced_usage(c).where(filters.equal(F.col("agent"), agent) & filters.day_window(F.col("created_at"), since, until)).join(said, ["agent", "session_id", "seq"])
    keys = {"level": [], "agent": [F.col("agent").alias("group")], "day": [day_of(F.col("created_at")).alias("group")]}[group]
    out = rows.groupBy(*keys, "level").agg(F.count(F.lit(1)).alias("requests"), *_sums())
    place = F.coalesce(F.try_element_at(F.create_map(*(x for k, name in enumerate(LEVELS) for x in (F.lit(name), F.lit(k)))), F.col("level")), F.lit(len(LEVELS)))
    return out.orderBy(*(["group"] if keys else []), place, "level")


def context(c: Corpus, agent: str, session_id: str) -> DataFrame:
    """Prompt size of each request of a session in order, and its peak so far."""
    rows = c.usage.where((F.col("agent") == agent) & (F.col("session_id") == session_id))
    size = F.coalesce("input", F.lit(0)) + F.coalesce("cache_read", F.lit(0)) + F.coalesce("cache_write", F.lit(0))
    sized = rows.select("seq", "created_at", "model", size.alias("prompt_tokens"))
    running = Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)  # one session
    return sized.withColumn("peak", F.max("prompt_tokens").over(running)).orderBy("seq")
