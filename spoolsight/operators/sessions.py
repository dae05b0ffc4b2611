"""Sessions: lists, detail, transcripts, relations and comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoolsight.corpus import Corpus
from spoolsight.functions.scalars import json_pointer
from spoolsight.operators import filters
from spoolsight.operators.usage import priced_usage
from spoolsight.shared import written

SUBAGENT = "subagent_of"
#: Levels that are searched one by one below given roots, before steps double.
LEVELS = 16
#: The nearest nodes above a node that one row holds, at most.
BLOCK = 8
KEY = ["agent", "session_id"]


def descendants(edges: DataFrame, kind: str = SUBAGENT, roots: DataFrame | None = None) -> DataFrame:
    """All (agent, root, node) where node lies below root over edges of a kind; safe with cycles.

    With given ``roots`` the search goes down level by level from them and touches no other tree; only below ``LEVELS`` levels it
    goes on by steps that double. The edges are written once, so a level scans what is stored and derives or shuffles none of it.

    Without, a row for each node has the nearest ``BLOCK`` nodes above it, and the pairs are made of these rows at the end, so
    a pair as such is never shuffled or stored; see ``_forest_pairs``. Only what goes through nodes with several parents or on
    cycles is made distinct; see ``_tangled_pairs``.
    """
    steps = edges.where(F.col("kind") == kind).select("agent", F.col("to_id").alias("node"), F.col("from_id").alias("child"))
    if roots is None:
        return _all_pairs(steps.distinct())
    steps = written(steps, "steps")
    start = roots.select("agent", F.col("session_id").alias("root")).distinct()
    found, ended = _levels_below(steps, start)
    return (found if ended else _doubled_pairs(steps.distinct(), start)).where("node <> root")


def _doubled_pairs(steps: DataFrame, start: DataFrame) -> DataFrame:
    """(agent, root, node) below the roots of ``start``, and these themselves.

    After k rounds all nodes less than 2^k levels below a root are found, and the jumps of 2^k levels that
    lead on from them are made of two jumps of half that length. So the rounds grow with the logarithm of the depth. When a
    round finds nothing new there is nothing more: a deeper node would have had one at just that distance above it. Each
    round is written to the shared folder: a lost executor repeats a part of one round, and plans stay short.
    """
    jump = written(steps, "jumps")
    found = written(start.select("agent", "root", F.col("root").alias("node")), "below")
    while True:
        below = found.join(jump, ["agent", "node"]).select("agent", "root", F.col("child").alias("node")).distinct()
        new = written(below.join(found, ["agent", "root", "node"], "left_anti"), "below-new")
        if new.isEmpty():
            return found
        found = written(found.unionByName(new), "below")
        on = jump.select("agent", F.col("node").alias("child"), F.col("child").alias("next"))
        jump = written(jump.join(on, ["agent", "child"]).select("agent", "node", F.col("next").alias("child")).distinct(), "jumps")


def _all_pairs(steps: DataFrame) -> DataFrame:
    """(agent, root, node) of all nodes below all others; ``steps``: agent, node, child, each once."""
    links = written(steps.where("node <> child").select("agent", F.col("child").alias("node"), F.col("node").alias("up")), "links")
    tangled = written(links.groupBy("agent", "node").agg(F.count(F.lit(1)).alias("ups")).where("ups > 1").select("agent", "node"), "several-parents")
    clean = tangled.isEmpty()
    forest = links if clean else links.join(tangled, ["agent", "node"], "left_anti")
    pairs = _forest_pairs(forest)
    if pairs is None:
        clean = False
        tangled = written(tangled.union(_cycles(forest).select("agent", "node")), "tangled")
        pairs = _forest_pairs(links.join(tangled, ["agent", "node"], "left_anti"))
    return pairs if clean else _tangled_pairs(links, tangled, written(pairs, "forest-pairs"))


def _blocks(links: DataFrame) -> DataFrame:
    """``agent``, ``node`` and ``above``: the nearest ``BLOCK`` nodes above it, nearest first, in a forest of ``links``. Each round doubles
    them; rows of chains that have ended are not moved for themselves any more."""
    rows, size = links.select("agent", "node", F.array("up").alias("above")), 1
    while size < BLOCK:
        full = rows.where(F.size("above") == size).withColumn("_last", F.element_at("above", -1))
        on = rows.select("agent", F.col("node").alias("_last"), F.col("above").alias("_on"))
        longer = full.join(on, ["agent", "_last"], "left").select("agent", "node", F.when(F.col("_on").isNull(), F.col("above")).otherwise(F.concat("above", "_on")).alias("above"))
        rows, size = written(rows.where(F.size("above") < size).unionByName(longer), "above"), 2 * size
        if rows.where(F.size("above") == size).isEmpty():
            break
    return rows


def _forest_pairs(links: DataFrame) -> DataFrame | None:
    """(agent, root, node) in a forest of ``links`` (agent, node, up), each pair once; None if it has a cycle.

    Jumps from each node to the last one of its full block are a forest again, a ``BLOCK`` less deep, which gets blocks of its own, and
    so on. Then a node has the blocks of all nodes at which its jumps end: what is joined is a jump's end for ``BLOCK`` pairs.

    The ends of jumps are among those of the jumps that they are made of. If there are as many, each has one below it that is an end
    too, so following jumps permutes them, and they are on cycles.
    """
    ends = lambda df: df.select("agent", "up").distinct().count()
    levels, before = [], None
    while True:
        blocks = _blocks(links)
        levels.append(blocks)
        jumps = blocks.where(F.size("above") == BLOCK).select("agent", "node", F.element_at("above", -1).alias("up"))
        if jumps.isEmpty():
            break
        before = ends(links) if before is None else before
        if (now := ends(jumps)) == before:
            return None
        links, before = jumps, now
    pairs = levels[-1].select("agent", F.explode("above").alias("root"), "node")
    for blocks in levels[-2::-1]:
        on = blocks.select("agent", F.col("node").alias("root"), "above")
        far = pairs.join(on, ["agent", "root"]).select("agent", F.explode("above").alias("root"), "node")
        pairs = blocks.select("agent", F.explode("above").alias("root"), "node").unionByName(far)
    return pairs


def _tangled_pairs(links: DataFrame, tangled: DataFrame, pairs: DataFrame) -> DataFrame:
    """All pairs, from those in the forest that has no links from the nodes of ``tangled`` upwards: what is above such a node is found
    among such nodes first, then handed down to what hangs on it."""
    key = ["agent", "node"]
    hung = written(pairs.join(tangled.select("agent", F.col("node").alias("root")), ["agent", "root"], "left_semi"), "hung")
    ups = links.join(tangled, key, "left_semi")
    further = ups.join(pairs.select("agent", F.col("node").alias("up"), "root"), ["agent", "up"]).select("agent", "node", "root")
    near = written(ups.select("agent", "node", F.col("up").alias("root")).union(further).distinct(), "near")
    steps = near.join(tangled.select("agent", F.col("node").alias("root")), ["agent", "root"], "left_semi").select("agent", F.col("root").alias("node"), F.col("node").alias("child"))
    among = _doubled_pairs(steps, tangled.select("agent", F.col("node").alias("root"))).select("agent", F.col("root").alias("top"), "node")
    above = among.join(near.select("agent", F.col("node").alias("top"), "root"), ["agent", "top"]).select("agent", "root", "node").distinct()
    above = written(above, "above-tangled")
    handed = hung.select("agent", F.col("root").alias("top"), "node").join(above.select("agent", "root", F.col("node").alias("top")), ["agent", "top"]).select("agent", "root", "node")
    below = hung.select(*key)
    mixed = pairs.join(below, key, "left_semi").unionByName(above).unionByName(handed).where("root <> node").distinct()
    return pairs.join(below, key, "left_anti").unionByName(mixed)


def _levels_below(steps: DataFrame, start: DataFrame) -> tuple[DataFrame, bool]:
    """What lies up to ``LEVELS`` levels below the roots of ``start``, and whether that is all. Only the last level is joined."""
    level = written(start.select("agent", "root", F.col("root").alias("node")), "level")
    found = level
    for _ in range(LEVELS):
        below = level.join(steps, ["agent", "node"]).select("agent", "root", F.col("child").alias("node")).distinct()
        level = written(below.join(found, ["agent", "root", "node"], "left_anti"), "level")
        if level.isEmpty():
            return found, True
        found = found.unionByName(level)
    return found, False


def subtree_totals(edges: DataFrame, values: DataFrame, names: list[str], kind: str = SUBAGENT) -> DataFrame:
    """For every node of an edge what lies below it: ``agent``, ``session_id``, ``sessions`` (how many nodes) and the sums of the columns
    ``names`` of ``values`` (agent, session_id, numbers; nodes without a row count 0).

    A node counts once below another, however it is reached, and never below itself. No list of pairs is made: sums and pointers
    double. When each node has the sum of what is less than 2^k levels below it, and a pointer to the node 2^k levels above, it
    hands that sum to that node, which so has the sum of twice as many levels. Each round has one row a node.

    Cycles: nodes of a cycle have each other and all that hangs on the cycle below them; for everybody else the cycle is cut there.
    Several parents: sums would count a node once a way. Nodes with several parents and those above them are listed in pairs with
    each other instead, each with the sum of what hangs on it and on no other of them.
    """
    links = edges.where(F.col("kind") == kind).select("agent", F.col("from_id").alias("node"), F.col("to_id").alias("up")).where("node <> up").distinct()
    links = written(links, "tree-links")
    sums = ["sessions", *names]
    own = values.select("agent", F.col("session_id").alias("node"), *(F.coalesce(F.col(n), F.lit(0)).cast("decimal(38,0)").alias(n) for n in names))
    nodes = links.select("agent", "node").union(links.select("agent", "up")).distinct()
    numbers = [F.lit(1).cast("decimal(38,0)").alias("sessions"), *(F.coalesce(n, F.lit(0)).cast("decimal(38,0)").alias(n) for n in names)]
    nodes = written(nodes.join(own, ["agent", "node"], "left").select("agent", "node", *numbers), "tree-nodes")

    shared = written(links.groupBy("agent", "node").agg(F.count(F.lit(1)).alias("ups")).where("ups > 1").select("agent", "node"), "several-parents")
    many = not shared.isEmpty()
    if many:  # they and all above them; the edges of the others make a forest, with cycles
        turned = links.select("agent", F.col("node").alias("to_id"), F.col("up").alias("from_id"), F.lit(kind).alias("kind"))
        above = descendants(turned, kind, shared.select("agent", F.col("node").alias("session_id"))).select("agent", "node")
        above = written(above.union(shared).distinct(), "above-several-parents")
        inside = links.join(above, ["agent", "node"], "left_semi").select("agent", F.col("node").alias("from_id"), F.col("up").alias("to_id"), F.lit(kind).alias("kind"))
        pairs = descendants(inside, kind)
        forest = links.join(above, ["agent", "node"], "left_anti")
    else:
        forest = links

    cycles = _cycles(forest)
    cut = forest if cycles is None else forest.join(cycles.select("agent", "node"), ["agent", "node"], "left_anti")
    whole = written(_summed(cut, nodes, sums), "tree-sums")  # each node with what is below it
    below = whole.join(nodes.select("agent", "node", *(F.col(n).alias(f"own_{n}") for n in sums)), ["agent", "node"])
    if cycles is not None:
        rings = cycles.join(whole, ["agent", "node"]).groupBy("agent", "ring").agg(*(F.sum(n).alias(f"ring_{n}") for n in sums))
        below = below.join(cycles.join(rings, ["agent", "ring"]).drop("ring"), ["agent", "node"], "left")
    else:
        below = below.select("*", *(F.lit(None).cast("decimal(38,0)").alias(f"ring_{n}") for n in sums))
    out = below.select("agent", "node", *((F.coalesce(f"ring_{n}", n) - F.col(f"own_{n}")).alias(n) for n in sums))
    if many:
        rest = out.join(above, ["agent", "node"], "left_anti")
        listed = pairs.join(whole, ["agent", "node"]).groupBy("agent", F.col("root").alias("node")).agg(*(F.sum(n).alias(f"listed_{n}") for n in sums))
        hung = out.join(above, ["agent", "node"], "left_semi").join(listed, ["agent", "node"], "left")
        out = rest.unionByName(hung.select("agent", "node", *((F.col(n) + F.coalesce(f"listed_{n}", F.lit(0))).alias(n) for n in sums)))
    return out.select("agent", F.col("node").alias("session_id"), *(F.col(n).cast("bigint").alias(n) for n in sums))


def _doubled(pointers: DataFrame) -> DataFrame:
    """Pointers (agent, node, up, and perhaps least) of twice the length; those that end above a root are gone."""
    on = pointers.select("agent", F.col("node").alias("up"), F.col("up").alias("next"), *([F.col("least").alias("_least")] if "least" in pointers.columns else []))
    least = [F.least("least", "_least").alias("least")] if "least" in pointers.columns else []
    return pointers.join(on, ["agent", "up"]).select("agent", "node", F.col("next").alias("up"), *least)


def _cycles(forest: DataFrame) -> DataFrame | None:
    """``agent``, ``node``, ``ring`` (least node of its cycle) of all nodes on cycles; None without any. Each node has one parent here.

    Of pointers of twice the length the ends are among those before. If there are as many, following a pointer permutes them, so
    they are all on cycles. Then lengths double until no least node changes: pointers of one length that start where the one
    before ended go round the whole cycle, so it is the least of all.
    """
    pointers, before = forest.withColumn("least", F.least("node", "up")), None
    while True:
        pointers = written(_doubled(pointers), "cycle-pointers")
        ends = pointers.select("agent", F.col("up").alias("node")).distinct()
        n = ends.count()
        if n == 0:
            return None
        if n == before:
            break
        before = n
    ring, before = written(pointers.join(ends, ["agent", "node"], "left_semi"), "cycles"), None
    while (now := ring.agg(F.sum(F.xxhash64("agent", "node", "least").cast("decimal(38,0)"))).first()) != before:
        ring, before = written(_doubled(ring), "cycles"), now
    return ring.select("agent", "node", F.col("least").alias("ring"))


def _summed(forest: DataFrame, nodes: DataFrame, sums: list[str]) -> DataFrame:
    """``nodes`` with their sums over themselves and all below them, in a forest."""
    pointers = forest
    while not pointers.isEmpty():
        given = nodes.join(pointers, ["agent", "node"]).groupBy("agent", F.col("up").alias("node")).agg(*(F.sum(n).alias(f"more_{n}") for n in sums))
        nodes = nodes.join(given, ["agent", "node"], "left")
        nodes = nodes.select("agent", "node", *((F.col(n) + F.coalesce(f"more_{n}", F.lit(0))).cast("decimal(38,0)").alias(n) for n in sums))
        nodes, pointers = written(nodes, "subtree-sums"), written(_doubled(pointers), "subtree-pointers")
    return nodes


def session_costs(c: Corpus, only: DataFrame | None = None) -> DataFrame:
    """Tokens and cost per session (of ``only``, if given), from owned usage."""
    sums = lambda n: F.sum(F.col(n).cast("decimal(38,0)")).cast("bigint")
    return priced_usage(c, only).groupBy(*KEY).agg(
        *(F.sum(F.coalesce(F.col(t), F.lit(0))).cast("bigint").alias(t) for t in ("input", "output", "cache_read", "cache_write")),
        sums("amount_nanos").alias("cost_nanos"), sums("reported_cost_nanos").alias("cost_reported_nanos"), sums("estimated_nanos").alias("cost_estimated_nanos"),
        sums("unpriced_tokens").alias("unpriced_tokens"),
    )


def session_summary(c: Corpus, only: DataFrame | None = None) -> DataFrame:
    """One row per session: counts of messages, tool calls and subagents, parent and type of a subagent, tokens and cost.

    Children are counted first and joined then, each child table shuffled once by session. ``only`` restricts which sessions
    are shown, and what is counted and priced for them; who owns a shared turn is still decided among all.
    """
    below = c.relations.where(F.col("kind") == SUBAGENT)
    chosen = (lambda df: df) if only is None else (lambda df: df.join(only.select(*KEY), KEY, "left_semi"))
    up = chosen(below.withColumnRenamed("from_id", "session_id")).groupBy(*KEY).agg(F.min("to_id").alias("parent_id"), F.min(F.get_json_object("evidence", "$.agentType")).alias("subagent_type"))
    down = chosen(below.withColumnRenamed("to_id", "session_id")).groupBy(*KEY).agg(F.count(F.lit(1)).alias("subagents"))
    whole = only is not None and set(c.sessions.columns) <= set(only.columns)
    out = only if whole else chosen(c.sessions)
    for child, name in ((c.messages, "messages"), (c.tool_calls, "tool_calls")):
        out = out.join(chosen(child).groupBy(*KEY).agg(F.count(F.lit(1)).alias(name)), KEY, "left")
    out = out.join(up, KEY, "left").join(down, KEY, "left").join(session_costs(c, only), KEY, "left")
    counts = ["messages", "tool_calls", "subagents", "input", "output", "cache_read", "cache_write", "cost_nanos", "cost_reported_nanos", "cost_estimated_nanos", "unpriced_tokens"]
    return out.select(
        *KEY, "title", "created_at", "modified_at", "cwd", "workspace", "git_branch", *(F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in counts),
        F.coalesce("parent_id", F.lit("")).alias("parent_id"), F.coalesce("subagent_type", F.lit("")).alias("subagent_type"),
    )


def sessions(c: Corpus, agent: str | None = None, project: str | None = None, model: str | None = None, since: str | None = None, until: str | None = None, title: str | None = None, subagents: bool = False, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Session summaries, newest first; subagents' sessions only if asked for. Filters come before the child counts."""
    wanted = filters.equal(F.col("agent"), agent) & filters.day_window(F.col("modified_at"), since, until) & filters.contains(F.col("title"), title)
    if project:
        wanted = wanted & (F.col("workspace") == filters.canonical_argument(project))
    chosen = c.sessions.where(wanted)
    if model:
        chosen = chosen.join(c.messages.where(F.col("model") == model), KEY, "left_semi")
    if not subagents:
        hidden = c.relations.where(F.col("kind") == SUBAGENT).select("agent", F.col("from_id").alias("session_id"))
        chosen = chosen.join(hidden, KEY, "left_anti")
    order = [F.desc("modified_at"), F.desc("session_id"), F.col("agent")]
    paged = written(filters.page(chosen, order, "sessions", limit, offset), "sessions-page")  # 500 rows at most, used many times
    return session_summary(c, paged).orderBy(*order)


def relations_of(c: Corpus, agent: str, session_id: str) -> DataFrame:
    """Edges from and to a session with the other end, and where a fork left its parent."""
    edges = c.relations.where((F.col("agent") == agent) & F.coalesce("resolved", F.lit(True)))
    out = edges.where(F.col("from_id") == session_id).select("*", F.lit("out").alias("direction"), F.col("to_id").alias("other_id"))
    into = edges.where(F.col("to_id") == session_id).select("*", F.lit("in").alias("direction"), F.col("from_id").alias("other_id"))
    both = out.unionByName(into).withColumn("branch", F.nullif(F.get_json_object("evidence", "$.branchUuid"), F.lit("")))
    said = c.messages.where(F.col("agent") == agent).select(F.col("session_id").alias("to_id"), F.col("external_id").alias("branch"), F.col("seq").alias("at_seq"))
    return both.join(said, ["to_id", "branch"], "left").select("kind", "direction", "other_id", "at_seq").orderBy("kind", "direction", "other_id")


def session(c: Corpus, agent: str, session_id: str) -> dict[str, DataFrame]:
    """Everything about one session: summary, relations, models, event counts, line totals, artifacts, its direct subagents, and
    totals over all sessions below it. An unknown session is a LookupError."""
    own = (F.col("agent") == agent) & (F.col("session_id") == session_id)
    root = c.sessions.where(own)
    if root.isEmpty():
        raise LookupError(f"no session {agent}/{session_id}")
    below = descendants(c.relations, SUBAGENT, root).select("agent", F.col("node").alias("session_id"))
    children = written(session_summary(c, below), "sessions-below")
    direct = c.relations.where((F.col("kind") == SUBAGENT) & (F.col("agent") == agent) & (F.col("to_id") == session_id))
    direct = direct.select("agent", F.col("from_id").alias("session_id")).distinct()
    calls = c.tool_calls.where(own)
    return {
        "summary": session_summary(c, root),
        "relations": relations_of(c, agent, session_id),
        "models": c.messages.where(own & (F.col("model") != "")).select("model").distinct().orderBy("model"),
        "events": c.session_events.where(own).groupBy(*KEY, "kind").count().groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("kind", "count"))).alias("counts")),
        "lines": calls.where("lines_added is not null or lines_removed is not null").agg(F.coalesce(F.sum("lines_added"), F.lit(0)).alias("added"), F.coalesce(F.sum("lines_removed"), F.lit(0)).alias("removed"), F.countDistinct(F.nullif("file_path", F.lit(""))).alias("files")),
        "artifacts": c.artifact_links.where(own).select("kind", "name", "relation", "evidence", "anchor_seq").orderBy("kind", "name"),
        "subagents": children.join(direct, KEY, "left_semi").orderBy("created_at", "session_id"),
        "subagent_totals": children.agg(F.count(F.lit(1)).alias("sessions"), *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("messages", "tool_calls", "input", "output", "cache_read", "cache_write", "cost_nanos", "unpriced_tokens"))),
    }


def compare_sessions(c: Corpus, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Metrics of two sessions side by side: metric, left, right, delta. Missing or reversed times make a duration of 0."""
    pick = lambda x: (F.col("agent") == x[0]) & (F.col("session_id") == x[1])
    chosen = c.sessions.where(pick(a) | pick(b))
    rows = session_summary(c, chosen)
    seconds = F.greatest(F.coalesce(F.unix_seconds("modified_at") - F.unix_seconds("created_at"), F.lit(0)), F.lit(0))
    names = ["messages", "tool_calls", "subagents", "input", "output", "cache_read", "cache_write", "cost_nanos", "unpriced_tokens", "duration_seconds"]
    tall = rows.withColumn("duration_seconds", seconds).select(*KEY, F.expr(f"stack({len(names)}, " + ", ".join(f"'{n}', cast({n} as bigint)" for n in names) + ") as (metric, value)"))
    left, right = (tall.where(pick(x)).select("metric", F.col("value").alias(n)) for x, n in ((a, "left"), (b, "right")))
    return left.join(right, "metric", "full_outer").withColumn("delta", F.col("right") - F.col("left")).orderBy("metric")


def transcript(c: Corpus, agent: str, session_id: str, from_seq: int = 0, full: bool = False, thinking: bool = False, limit: int | None = None) -> DataFrame:
    """Messages of a session from a sequence number on. Raw content and thinking only if asked for."""
    filters.positive("from_seq", from_seq)
    rows = c.messages.where((F.col("agent") == agent) & (F.col("session_id") == session_id) & (F.col("seq") >= from_seq))
    columns = ["seq", "external_id", "parent_id", "role", "kind", "created_at", "provider", "model", "is_sidechain", "text", "images", "effort"]
    return filters.page(rows.select(*columns, *(["thinking"] if thinking else []), *(["content"] if full else [])), [F.col("seq")], "transcript", limit)


#: Media types that are given out.
SERVED = ["image/png", "image/jpeg", "image/gif", "image/webp"]


def decoded_images(messages: DataFrame) -> DataFrame:
    """Images of messages, decoded from their content by their pointers: ``agent``, ``session_id``, ``seq``, ``image`` (its place in the
    message), ``media_type``, ``data``, and ``problem`` where there is no data: a type that is not given out, a pointer that leads
    to no text or an empty one, or text that is not base64."""
    each = messages.select(*KEY, "seq", "content", F.posexplode("images").alias("image", "locator")).withColumn("media_type", F.col("locator.media_type"))
    found = json_pointer(F.col("content"), F.col("locator.pointer"))
    text = F.when(F.schema_of_variant(found) == "STRING", F.nullif(F.try_variant_get(found, "$", "string"), F.lit("")))
    served = each.withColumn("_text", F.when(F.col("media_type").isin(*SERVED), text)).withColumn("data", F.try_to_binary("_text", F.lit("base64")))
    problem = F.when(~F.coalesce(F.col("media_type").isin(*SERVED), F.lit(False)), "type is not given out").when(F.col("_text").isNull(), "no data").when(F.col("data").isNull(), "not base64")
    return served.select(*KEY, "seq", "image", "media_type", "data", problem.alias("problem"))


def message_images(c: Corpus, agent: str, session_id: str, seq: int) -> DataFrame:
    """Images of one message, as ``decoded_images`` gives them."""
    rows = c.messages.where((F.col("agent") == agent) & (F.col("session_id") == session_id) & (F.col("seq") == seq))
    return decoded_images(rows).select("image", "media_type", "data", "problem")
