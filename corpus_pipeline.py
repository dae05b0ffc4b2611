"""The corpus pipeline: language, exact and near duplicates, mixture, token ids.

Each stage takes all rows that its predecessor kept, decides with one operator, and returns the rows with its decisions in
effect; the last one returns token ids. The runner (or ``run``) writes every stage's result as Parquet in the shared folder
and reads it back, so a lost executor repeats at most a part of one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spoolsight.llm import budget_mix, chunk_recipes, langid_crf, near_copies, tree_bpe
from spoolsight.shared import written
from spoolsight.session import ship_package


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled rows teach stay, and get that language where ``lang`` is null. Those without
    letters go, those in a language or script that was not taught, and those spread evenly over the languages."""
    ship_package(spark)
    return langid_crf.keep_identified(docs, langid_crf.fit(docs), lang_col="lang")


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return chunk_recipes.drop_duplicates(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that op 7's fingerprints at 2 or fewer differing bits, or five-word shingles at a Jaccard similarity of 0.8, link,
    the row with the smallest doc_id stays."""
    ship_package(spark)
    return near_copies.keep_one_of_each_way(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    ship_package(spark)
    return budget_mix.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row: doc_id, ids, n_tokens, and digests of the ids and of the text decoded from them."""
    import public_tokenizers

    ship_package(spark)
    encoded = tree_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return encoded.select("doc_id", "ids", *tree_bpe.digest_columns())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("exact duplicates", drop_exact_duplicates),
    ("near duplicates", drop_near_duplicates),
    ("mixture", mix_sources),
    ("token ids", encode),
]

#: A conditional random field and a seeded subset sum are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
