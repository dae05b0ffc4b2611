"""Registered queries of search with accents, of the upkeep of a stored index, and of images in messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoolsight.operators import search as X
from spoolsight.operators import sessions as S
from spoolsight.plans import driver_views as V
from spoolsight.plans.queries import ORACLES, query, with_views
from spoolsight.shared import new_folder, written

# -- messages in French with accents in one letter or as marks of their own; queries without them, and with others
_FRENCH = "concat(CASE event_id % 4 WHEN 0 THEN 'Le Résumé naïf ' WHEN 1 THEN 'un resume naif, ' WHEN 2 THEN 'le résumé très naïf ' ELSE 'Résumé' END, event_type, ' ', CAST(event_id % 50 AS VARCHAR(9)), ' résumé')"


@query("search_accents", f"""{with_views("v_messages")}, d AS (SELECT concat('message/', agent, '/', session_id, '/', CAST(event_id AS VARCHAR)) AS doc, {_FRENCH} AS t FROM (SELECT event_id, event_type, {V.AGENT} AS agent, {V.SESSION} AS session_id FROM events)),
  w AS (SELECT doc, regexp_extract_all(strip_accents(lower(t)), '[\\p{{L}}\\p{{N}}]+') AS l FROM d), n AS (SELECT count(*) AS docs, sum(len(l)) AS tokens FROM w),
  m AS (SELECT doc, l, len(list_filter(range(1, len(l)), lambda i: l[i] = 'resume' AND l[i + 1] = 'naif')) AS a, len(list_filter(l, lambda x: x = '7')) AS b FROM w),
  f AS (SELECT count(*) FILTER (a > 0) AS na, count(*) FILTER (b > 0) AS nb FROM m)
  SELECT doc, round(greatest(ln((docs - na + 0.5) / (na + 0.5)), 1e-6) * a * 2.2 / (a + z) + greatest(ln((docs - nb + 0.5) / (nb + 0.5)), 1e-6) * b * 2.2 / (b + z), 6) AS score
  FROM (SELECT *, 1.2 * (0.25 + 0.75 * len(l) * docs / tokens) AS z FROM m, n), f WHERE a > 0 AND b > 0 ORDER BY score DESC, doc LIMIT 100""")  # fmt: skip
def _accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase and a number, asked for with accents of another form than most texts have."""
    c = V.driver_corpus(spark, sf_dir)
    kind = F.regexp_extract("text", "^([a-z]+)", 1)
    french = F.expr(_FRENCH.replace("event_id", "seq").replace("VARCHAR(9)", "STRING").replace("event_type", "_kind"))
    messages = c.messages.withColumn("_kind", kind).withColumn("text", french).drop("_kind")
    index = X.build_search_index(X.search_documents(c.with_tables(messages=messages, artifacts=c.artifacts.where("false"))))
    return X.ranked(index, "RÉSUMÉ-naïf 7", limit=100).select("doc", F.round("score", 6).alias("score"))


@query("search_index_upkeep", ORACLES["search_index_terms_whole"])
def _upkept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of a stored index after three updates: a fifth of the messages had another text, a seventh of the documents was not
    there yet, and some documents were there that are gone now. Equal to those of an index built anew."""
    c = V.driver_corpus(spark, sf_dir)
    docs = written(X.search_documents(c.with_tables(artifacts=c.artifacts.withColumn("kind", F.lit("plan")))), "search-documents", X.CODEC)
    changed = (F.col("artifact_kind").isNull()) & (F.col("seq") % 5 == 0)
    late = F.coalesce(F.regexp_extract("artifact_name", "([0-9]+)$", 1).cast("bigint") % 7 == 0, F.lit(False))
    was = docs.where(~late).withColumn("text", F.when(changed, F.concat(F.lit("an earlier text "), "text")).otherwise(F.col("text")))
    gone = docs.where("seq % 3 = 0").withColumns({"doc": F.concat(F.lit("gone/"), "doc"), "text": F.lit("of the past")})
    folder = new_folder(spark, "search-index")
    X.build_search_index(was.unionByName(gone)).write(folder, 8)
    X.update_index(spark, folder, docs.where(changed))
    X.update_index(spark, folder, docs.where(late))
    X.update_index(spark, folder, docs.where("false"), gone.select("doc"))
    live = X.read_index(spark, folder).postings
    return live.groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("positions")).alias("occurrences"))


@query("decoded_images", f"""{with_views("v_messages")} SELECT agent, session_id, seq, i AS image, CASE i WHEN 0 THEN CASE seq % 5 WHEN 0 THEN concat('first ', CAST(seq AS VARCHAR)) WHEN 2 THEN concat('second ', CAST(seq AS VARCHAR)) END END AS data,
  CASE i WHEN 1 THEN 'type is not given out' ELSE CASE seq % 5 WHEN 1 THEN 'no data' WHEN 3 THEN 'no data' WHEN 4 THEN 'not base64' END END AS problem FROM v_messages, (VALUES (0), (1)) t(i)""")  # fmt: skip
def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two images a message, the second of a type that is not given out. Pointers lead through a key with a slash and a tilde inside a
    tool's result, to a place that is not there, through a key that is a number, to a number, and to text that is not base64."""
    c = V.driver_corpus(spark, sf_dir)
    encoded = lambda word: F.base64(F.encode(F.concat(F.lit(f"{word} "), F.col("seq").cast("string")), "UTF-8"))
    content = F.format_string(
        '{"content": [{"n": 5, "result": null}, {"result": {"a/b~c": {"data": "%s"}}}], "0": {"data": "%s", "odd": "?*?"}}', encoded("first"), encoded("second"),
    )
    pointer = F.element_at(F.array(*map(F.lit, ("/content/1/result/a~1b~0c/data", "/content/7/result", "/0/data", "/content/0/n", "/0/odd"))), (F.col("seq") % 5 + 1).cast("int"))
    image = lambda kind: F.struct(F.lit(kind).alias("media_type"), pointer.alias("pointer"))
    messages = c.messages.withColumns({"content": content, "images": F.array(image("image/png"), image("image/svg+xml"))})
    return S.decoded_images(messages).select("agent", "session_id", "seq", "image", F.decode("data", "UTF-8").alias("data"), "problem")
