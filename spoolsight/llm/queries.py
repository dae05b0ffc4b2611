"""Queries and oracle SQL of this subpackage, as the entry module registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoolsight.session import ship_package


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_langid_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoolsight.llm import langid_crf

    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = langid_crf.fit(docs.where(~held_out))
    return langid_crf.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoolsight.llm import chunk_recipes

    return chunk_recipes.exact_duplicates(_table(spark, sf_dir, "documents"))


def op4_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoolsight.llm import png_media

    read = png_media.from_media(png_media.to_media(_table(spark, sf_dir, "documents")), payloads=False)
    return read.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.lower(F.hex("feature")).alias("feature"),
    )


def op6_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoolsight.llm import budget_mix

    return budget_mix.mix(_table(spark, sf_dir, "documents"))


def op5_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoolsight.llm import tree_bpe

    return tree_bpe.digests(tree_bpe.encode_decode(_table(spark, sf_dir, "documents"), _tokenizer()))


def op7_simhash_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoolsight.llm import simhash_links

    return simhash_links.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoolsight.llm import prefix_counts

    counted = prefix_counts.prefix_counts(_table(spark, sf_dir, "documents"), _tokenizer())
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op3_record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoolsight.llm import record_files

    return record_files.digests(record_files.write_records(_table(spark, sf_dir, "documents"), _tokenizer()))


def op9_block_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoolsight.llm import block_html

    return block_html.extract(_table(spark, sf_dir, "pages"))


def op11_merkle_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoolsight.llm import merkle_rollup

    told = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = {"text": F.when(told, F.replace("text", F.lit("\n"))).otherwise(F.col("text"))}
    return merkle_rollup.manifest(_table(spark, sf_dir, "documents"), tampered=tampered).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoolsight.llm import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.quantised(_table(spark, sf_dir, "embeddings"), label=label)
    return hard_negatives.mine(rows, rows.where("id % 100 = 0"))


def op13_suffix_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoolsight.llm import suffix_spans

    return suffix_spans.remove_repeats(_table(spark, sf_dir, "documents"), texts_too=False)


def _url_rules() -> list:
    from spoolsight.llm.url_rules import ALLOW, BLOCK, Rule

    return [
        Rule(ALLOW, "com", "/"),
        Rule(BLOCK, "example.com", "/en/"),
        Rule(ALLOW, "www.example.com", "/en/"),
        Rule(BLOCK, "net", "/es/"),
        Rule(BLOCK, "net", "/fr/"),
    ]


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoolsight.llm import url_rules

    return url_rules.judge(_table(spark, sf_dir, "pages"), _url_rules())


def url_rules_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op10: host, path and the listed rule of every page."""
    from spoolsight.llm import url_rules

    return url_rules.match_listed(_table(spark, sf_dir, "pages"), _url_rules())


def budget_mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op6: the size of every document, and its source's size and target (rounded, as sums of doubles
    differ in their last digits)."""
    return op6_budget_mix(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid_crf": op1_langid_crf,
    "op2_chunk_recipes": op2_chunk_recipes,
    "op3_record_files": op3_record_files,
    "op4_png_media": op4_png_media,
    "op5_tree_bpe": op5_tree_bpe,
    "op6_budget_mix": op6_budget_mix,
    "op7_simhash_links": op7_simhash_links,
    "op8_prefix_counts": op8_prefix_counts,
    "op9_block_html": op9_block_html,
    "op10_url_rules": op10_url_rules,
    "op11_merkle_rollup": op11_merkle_rollup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_suffix_spans": op13_suffix_spans,
    "url_rules_listed": url_rules_listed,
    "budget_mix_targets": budget_mix_targets,
}



def _levels(name: str, key: str, levels: int) -> str:
    """CTEs ``name``1 .. of a tree in SQL, over ``name``0 (key, k, n, h): each level's nodes, with the siblings left and right of them."""
    out = []
    for i in range(levels + 1):
        if i:
            out.append(f"""{name}{i} AS (SELECT {key}, k // 3 AS k, n, CASE WHEN n > {3 ** (i - 1)} THEN sha256(string_agg(h, '' ORDER BY k)) ELSE min(h) END AS h
                FROM {name}{i - 1} GROUP BY {key}, k // 3, n)""")
        out.append(f"""{name}s{i} AS (SELECT *, CASE WHEN n > {3**i} THEN coalesce(lag(h, 2) OVER w, '') || coalesce(lag(h) OVER w, '') END AS l,
                coalesce(lead(h) OVER w, '') || coalesce(lead(h, 2) OVER w, '') AS r FROM {name}{i} WINDOW w AS (PARTITION BY {key}, k // 3 ORDER BY k))""")
    return ", ".join(out)


def _ways(name: str, key: str, levels: int, tree: str) -> str:
    """CTEs ``name``1 .. that follow each row of ``name``0 (key, k, proof, now) up a tree."""
    return ", ".join(
        f"""{name}{i + 1} AS (SELECT p.* REPLACE (p.k // 3 AS k, p.proof || CASE WHEN t.l IS NULL THEN '' ELSE t.l || t.r END AS proof,
            CASE WHEN t.l IS NULL THEN p.now ELSE sha256(t.l || p.now || t.r) END AS now)
            FROM {name}{i} p JOIN {tree}s{i} t ON p.k = t.k AND p.{key} IS NOT DISTINCT FROM t.{key})"""
        for i in range(levels)
    )


#: Levels of the trees in SQL: up to 3^14 rows a source and 3^6 sources.
_DEEP, _FLAT = 14, 6
_FRAMED = " || ".join("CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END".format(c) for c in ("doc_id", "source", "lang", "n_chars"))
_CRC32 = """t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), [CAST(0 AS BIGINT) FOR _ IN range(8)]),
              lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM range(256) r(i)))"""
_ODD_TEXT = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
              lambda x, b: xor(x >> 8, t.t[1 + (xor(x, b) & 255)])) & 1"""  # of the register; its complement is the sum

ORACLES: dict[str, str] = {
    "op11_merkle_rollup": f"""
        WITH {_CRC32}, d AS (SELECT doc_id, source, {_FRAMED} AS f, text, CASE WHEN {_ODD_TEXT} = 1 THEN replace(text, chr(10), '') ELSE text END AS other FROM documents, t),
        l AS (SELECT doc_id, source, sha256(f || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
              sha256(f || CASE WHEN other IS NULL THEN '-' ELSE strlen(other) || ':' || other END) AS seen FROM d),
        o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM l),
        a0 AS (SELECT source, k, n, leaf AS h FROM o), {_levels("a", "source", _DEEP)},
        b0 AS (SELECT 0 AS one, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS k, count(*) OVER () AS n, h FROM a{_DEEP}), {_levels("b", "one", _FLAT)},
        u AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM a{_DEEP}),
        p0 AS (SELECT doc_id, source, leaf, k, '' AS proof, seen AS now FROM o), {_ways("p", "source", _DEEP, "a")},
        q0 AS (SELECT p.* REPLACE (u.place AS k), 0 AS one, u.subroot FROM p{_DEEP} p JOIN u ON p.source IS NOT DISTINCT FROM u.source), {_ways("q", "one", _FLAT, "b")}
        SELECT doc_id, leaf, subroot, b.h AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = b.h AS verified FROM q{_FLAT} JOIN b{_FLAT} b ON true""",
    "op12_hard_negatives": """
        WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.id AS anchor_id, a.label = b.label AS same, b.id, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id),
        p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
        n AS (SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
              CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank
              FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
    "op13_suffix_spans": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS y, hex(encode(coalesce(text, ''))) AS x FROM documents),
        w AS (SELECT r, p, y[p + 1 : p + 200] AS s FROM (SELECT r, y, unnest(range(strlen(x) // 2 - 199)) AS p FROM d)),
        f AS (SELECT r, p, p - row_number() OVER (PARTITION BY r ORDER BY p) AS g FROM (SELECT r, p, count(*) OVER (PARTITION BY s) AS n FROM w) WHERE n > 1),
        i AS (SELECT r, min(p) AS s, max(p) + 200 AS e FROM f GROUP BY r, g),
        o AS (SELECT *, coalesce(s > max(e) OVER (PARTITION BY r ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS new FROM i),
        c AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY r ORDER BY s) AS c FROM o),
        m AS (SELECT r, c, min(s) AS s, max(e) AS e FROM c GROUP BY r, c),
        k AS (SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS b FROM m),
        t AS (SELECT r, sum(e - s) AS removed, count(*) AS runs, max(e) AS e, string_agg(d.x[2 * b + 1 : 2 * s], '' ORDER BY s) AS kept FROM k JOIN d USING (r) GROUP BY r)
        SELECT doc_id, CAST(strlen(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(runs, 0) AS BIGINT) AS n_spans,
               sha256(unhex(coalesce(kept, '') || d.x[2 * coalesce(e, 0) + 1 :])) AS kept_sha256
        FROM d LEFT JOIN t USING (r)""",
    "op2_chunk_recipes": """
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
               sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)""",
    "url_rules_listed": """
        WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
             r(h, q) AS (VALUES ('com', '/'), ('example.com', '/en/'), ('www.example.com', '/en/'), ('net', '/es/'), ('net', '/fr/'))
        SELECT page_id, host, path, (SELECT arg_max(h || q, length(h || q)) FROM r WHERE (host = h OR suffix(host, '.' || h)) AND prefix(path, q)) AS rule
        FROM p""",
    "budget_mix_targets": """
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
             s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
             w AS (SELECT *, 2.0 * source_size AS cap, 1.5 * sum(source_size) OVER () AS budget,
                   CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END AS weight FROM s),
             l AS (SELECT a.source, a.cap, a.weight, (a.budget - (SELECT coalesce(sum(b.cap), 0) FROM w b WHERE b.cap / b.weight < a.cap / a.weight))
                   / (SELECT sum(b.weight) FROM w b WHERE b.cap / b.weight >= a.cap / a.weight) AS level FROM w a),
             x AS (SELECT arg_min(level, cap / weight) AS x FROM l WHERE level * weight <= cap)
        SELECT d.doc_id, d.size, w.source_size, round(CAST(least(w.weight * coalesce(x.x, 1e300), w.cap) AS DOUBLE), 3) AS target
        FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source CROSS JOIN x""",
}
