"""Registered queries of upkeep: owners that move, refreshed days, totals of subtrees, and logs that grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spoolsight.corpus import Corpus
from spoolsight.operators import sessions as S
from spoolsight.operators import usage as U
from spoolsight.plans import driver_views as V
from spoolsight.plans.queries import DAILY, OWNED, corpus, query, with_views
from spoolsight.shared import new_folder, written
from spoolsight.sources.growing import read_growing
from spoolsight.sources.lines import split_lines

# -- owners of turns: every third user's sessions ended five days later when they were last stored
_NUMBER = "CAST(substr(session_id, 2, length(session_id) - 12) AS BIGINT)"
_RANKED = "row_number() OVER (PARTITION BY agent, content_id, request_id ORDER BY {0}, created_at, session_id, seq) = 1"


def _before(c: Corpus) -> tuple[Corpus, DataFrame]:
    """The corpus as it was, and the sessions that have changed since."""
    changed = F.expr(f"{_NUMBER} % 3 = 0")
    ended = F.when(changed, F.col("modified_at") + F.expr("INTERVAL 5 DAY")).otherwise(F.col("modified_at"))
    return c.with_tables(sessions=c.sessions.withColumn("modified_at", ended)), c.sessions.where(changed).select("agent", "session_id")


def _stored(c: Corpus) -> Corpus:
    """Usage and sessions are tables that are stored, and upkeep reads them many times; here they are derived, so they are written first."""
    return c.with_tables(sessions=written(c.sessions, "sessions"), usage=written(c.usage, "usage"))


def _moves(c: Corpus) -> DataFrame:
    c = _stored(c)
    was, dirty = _before(c)
    owners = written(U.usage_owners(was.usage, was.sessions), "usage-owners")
    return U.owner_moves(c.usage, c.sessions, owners, dirty)[0]


query("usage_owner_moves", f"""{with_views("v_usage", "v_sessions")},
  a AS (SELECT u.agent, u.content_id, u.request_id, u.session_id, u.seq, s.created_at, s.modified_at AS ended,
        CASE WHEN {_NUMBER} % 3 = 0 THEN s.modified_at + INTERVAL 5 DAY ELSE s.modified_at END AS had_ended
        FROM v_usage u JOIN v_sessions s USING (agent, session_id) WHERE u.content_id <> ''),
  o AS (SELECT agent, content_id, request_id, session_id AS from_session, seq AS from_seq FROM a QUALIFY {_RANKED.format("had_ended")}),
  n AS (SELECT agent, content_id, request_id, session_id AS to_session, seq AS to_seq FROM a QUALIFY {_RANKED.format("ended")})
  SELECT * FROM o JOIN n USING (agent, content_id, request_id) WHERE from_session <> to_session OR from_seq <> to_seq""")(corpus(_moves))  # fmt: skip


@query("refresh_moved_days", f"WITH {OWNED} {DAILY}")
def _refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollups as they were, refreshed by the sessions that changed and the turns that moved; equal to rollups built anew."""
    c = _stored(V.driver_corpus(spark, sf_dir))
    was, dirty = _before(c)
    priced = written(U.priced_usage(was), "priced-usage")
    old = tuple(written(df, "old-rollups") for df in U.build_rollups(priced))
    moves = U.owner_moves(c.usage, c.sessions, written(U.owners_of(priced), "usage-owners"), dirty)[0]
    return U.refresh_moved(c, old, dirty, moves)[0]


# -- totals of subtrees: chains of a hundred; every fifth is a ring, and in every fifth a node has two parents
_KNOTS = """SELECT 'deep' AS agent, concat('d', CAST(event_id AS VARCHAR(20))) AS from_id, concat('d', CAST(up AS VARCHAR(20))) AS to_id, 'subagent_of' AS kind FROM (
  SELECT event_id, event_id - 1 AS up FROM events WHERE event_id % 100 <> 0 UNION ALL SELECT event_id, event_id + 99 FROM events WHERE event_id % 500 = 100
  UNION ALL SELECT event_id, event_id - 10 FROM events WHERE event_id % 500 = 250)"""
_BELOW = """below AS (SELECT agent, to_id AS root, from_id AS node FROM e WHERE from_id <> to_id
    UNION SELECT b.agent, b.root, e.from_id FROM below b JOIN e ON e.agent = b.agent AND e.to_id = b.node),
  nodes AS (SELECT agent, from_id AS session_id FROM e UNION SELECT agent, to_id FROM e)"""


@query("subagent_totals_all", f"""WITH RECURSIVE e AS ({_KNOTS}), {_BELOW},
  v AS (SELECT 'deep' AS agent, concat('d', CAST(event_id AS VARCHAR)) AS node, event_id % 1000 AS work FROM events WHERE event_id % 7 <> 0),
  t AS (SELECT b.agent, b.root, count(*) AS sessions, sum(v.work) AS work FROM below b LEFT JOIN v USING (agent, node) WHERE b.root <> b.node GROUP BY ALL)
  SELECT n.agent, n.session_id, coalesce(t.sessions, 0) AS sessions, CAST(coalesce(t.work, 0) AS BIGINT) AS work FROM nodes n LEFT JOIN t ON t.agent = n.agent AND t.root = n.session_id""")
def _all_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    edges = spark.sql(_KNOTS.replace("FROM events", "FROM {events}"), events=events)
    named = F.concat(F.lit("d"), F.col("event_id").cast("string")).alias("session_id")
    work = events.where("event_id % 7 <> 0").select(F.lit("deep").alias("agent"), named, (F.col("event_id") % 1000).alias("work"))
    return S.subtree_totals(edges, work, ["work"])


query("conversation_totals_all", f"""WITH RECURSIVE {V.view_sql("v_relations")}, e AS (SELECT * FROM v_relations), {_BELOW},
  v AS (SELECT concat('c', CAST(conv_id AS VARCHAR)) AS node, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS characters FROM conversations GROUP BY ALL),
  t AS (SELECT b.agent, b.root, count(*) AS sessions, sum(turns) AS turns, sum(characters) AS characters FROM below b LEFT JOIN v USING (node) WHERE b.root <> b.node GROUP BY ALL)
  SELECT n.agent, n.session_id, coalesce(t.sessions, 0) AS sessions, CAST(coalesce(t.turns, 0) AS BIGINT) AS turns, CAST(coalesce(t.characters, 0) AS BIGINT) AS characters
  FROM nodes n LEFT JOIN t ON t.agent = n.agent AND t.root = n.session_id""")(lambda spark, sf_dir: _conversation_totals(spark, sf_dir))  # fmt: skip


def _conversation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and characters of all conversations below each one."""
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    sizes = said.groupBy(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_id")).agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("characters"))
    return S.subtree_totals(V.view(spark, sf_dir, "v_relations"), sizes.withColumn("agent", F.lit("conv")), ["turns", "characters"])


query("session_direct_subagents", f"""{with_views("v_relations")}, root AS (SELECT min(to_id) AS to_id FROM v_relations WHERE from_id <> to_id)
  SELECT r.agent, r.from_id AS session_id, r.to_id AS parent_id, 'helper' AS subagent_type FROM v_relations r JOIN root USING (to_id) WHERE r.from_id <> r.to_id""")(lambda spark, sf_dir: _direct(spark, sf_dir))  # fmt: skip


def _direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subagents of one session that has more levels below it: only the first level is listed."""
    c = V.driver_corpus(spark, sf_dir)
    edges = c.relations.where("from_id <> to_id")
    root = edges.agg(F.min("to_id")).first()[0]
    names = edges.select("agent", F.col("from_id").alias("session_id")).union(edges.select("agent", "to_id")).distinct()
    rows = names.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in c.sessions.schema.fields if f.name not in names.columns))
    detail = S.session(c.with_tables(sessions=rows.select(*c.sessions.columns), relations=edges), "conv", root)
    return detail["subagents"].select("agent", "session_id", "parent_id", "subagent_type")


# -- logs that grow: sixteen files of conversations, written in three portions
_LOGS = 16


def _grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream over logs that grow between its triggers. Each time a part of a line is left at the end, which the next portion completes;
    after the second time some logs are renamed. All lines come once, with their numbers."""
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("conv_id is not null and turn is not null")
    line = F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"})
    rows = said.select(F.pmod("conv_id", F.lit(_LOGS)).cast("int").alias("log"), F.pmod(F.floor(F.col("conv_id") / _LOGS), F.lit(3)).alias("portion"), "conv_id", "turn", line.alias("value"))
    rows = written(rows, "log-lines")
    folder, index, state, out = (new_folder(spark, n) for n in ("growing-logs", "log-index", "log-state", "log-rows"))
    for portion in range(3):
        rows.groupBy("log").applyInArrow(_log_writer(folder, portion), "log int, bytes long").agg(F.sum("bytes")).collect()
        stream = read_growing(spark, folder, index, suffix=".jsonl", range_bytes=1 << 18)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    lines, _ = split_lines(spark.read.schema("path string, line long, value string").parquet(out))
    field = lambda name, kind: F.try_variant_get("json", f"$.{name}", kind)
    return lines.select(field("conv_id", "bigint").alias("conv_id"), field("turn", "bigint").alias("turn"), field("role", "string").alias("role"), F.length(field("text", "string")).cast("bigint").alias("characters"), "line")


def _log_writer(folder: str, portion: int):
    """Writes a log as it is after a portion: all lines so far and a part of the next one. A repeated task writes the same."""

    def write(group):
        import pyarrow as pa
        import pyarrow.fs as pafs

        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        log = group["log"][0].as_py()
        ordered = group.sort_by([("portion", "ascending"), ("conv_id", "ascending"), ("turn", "ascending"), ("value", "ascending")])
        lines = [(p, v) for p, v in zip(ordered["portion"].to_pylist(), ordered["value"].to_pylist(), strict=True)]
        data = b"".join(v.encode() + b"\n" for p, v in lines if p <= portion)
        later = next((v.encode() for p, v in lines if p > portion), b"")
        old, new = f"{root}/log{log}.jsonl", f"{root}/log{log}.old.jsonl"
        if portion == 2 and log % 4 == 0 and fs.get_file_info(old).type == pafs.FileType.File:
            fs.move(old, new)
        with fs.open_output_stream(new if portion == 2 and log % 4 == 0 else old) as file:
            file.write(data + later[: len(later) // 2])
        return pa.table({"log": pa.array([log], "int32"), "bytes": pa.array([len(data)], "int64")})

    return write


query("ingest_growing_logs", f"""WITH l AS (SELECT conv_id, turn, role, length(text) AS characters, conv_id % {_LOGS} AS log, (conv_id // {_LOGS}) % 3 AS portion FROM conversations)
  SELECT conv_id, turn, role, characters, row_number() OVER (PARTITION BY log ORDER BY portion, conv_id, turn) AS line FROM l""")(_grown)  # fmt: skip


@query("read_logs_in_ranges", "SELECT conv_id, turn, length(text) AS characters, CAST(2 * row_number() OVER (PARTITION BY conv_id % 8 ORDER BY conv_id, turn) AS BIGINT) AS line FROM conversations")
def _ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same reader over finished logs, eight of them, cut into ranges of 64 KiB, a blank line before each line."""
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    value = F.concat(F.lit("\n"), F.to_json(F.struct("conv_id", "turn", "text")))
    order = Window.partitionBy("log").orderBy("conv_id", "turn")
    rows = said.select(F.pmod("conv_id", F.lit(8)).alias("log"), "conv_id", "turn", value.alias("value")).withColumn("place", F.row_number().over(order))
    folder = new_folder(spark, "logs")
    rows.repartition("log").sortWithinPartitions("log", "place").select("log", "value").write.partitionBy("log").text(folder)
    lines, _ = split_lines(read_growing(spark, folder, stream=False, range_bytes=1 << 16))
    field = lambda name, kind: F.try_variant_get("json", f"$.{name}", kind)
    return lines.select(field("conv_id", "bigint").alias("conv_id"), field("turn", "bigint").alias("turn"), F.length(field("text", "string")).cast("bigint").alias("characters"), "line")
