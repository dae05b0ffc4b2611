"""Exact deduplication of documents by content-defined chunk recipes, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoolsight.llm.rows import repeat_rows
from spoolsight.shared import written

# White space that counts as one blank.
WHITE = r"[\x20\x09-\x0D]+"
#: Chunks have 64 to 2048 bytes. One ends where the third last byte and the last are of these classes: a property of the content,
#: so that equal passages are cut alike wherever they stand, in whatever script. Only a text that never meets them, such as
#: one repeated character, reaches the upper bound. Classes are residues, so that they are met by the letters of ASCII,
#: by the second bytes of two-byte scripts, and by the later bytes of three-byte ones.
LEAST, MOST = 64, 2048
FIRST, LAST = ("".join(f"\\x{b:02X}" for b in range(256) if b % n == r) for n, r in ((7, 2), (4, 1)))
CHUNK = rf"(?s).{{{LEAST - 3},{MOST - 3}}}?[{FIRST}].(?:[{LAST}]|$)|.{{1,{MOST}}}"
FEW_KEYS = 1_000_000


def normalised(text: Column) -> Column:
    """Null as empty, each run of white space as one blank."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def chunks_of(text: Column) -> Column:
    """The chunks of a text in order, as strings with a character for each byte."""
    return F.regexp_extract_all(F.decode(text.cast("binary"), "ISO-8859-1"), F.lit(CHUNK), F.lit(0))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 64) -> DataFrame:
    """Find documents with equal normalised text; of each group the smallest id stays.

    1. Each text is cut into content-defined chunks where the row is read. Its recipe is the ordered list of the chunks'
       64-bit keys, about 2 % of the text; the recipe, the id and the digest are written, and the text goes no further.
    2. Chunks are deduplicated by key and text, first within each task, so that a distinct chunk moves about once. This
       verifies the keys: a key of one text is that chunk's identifier. Where a key stands for several texts (at 64 bits,
       some ten thousand keys of 10^12), each gets an ordinal, and the documents that hold such chunks also carry the list
       of their ordinals. Of other documents nothing is moved for this.
    3. Documents are grouped by their ordered identifiers. Facts on groups of two or more go back to the members by a
       join that adaptive execution splits where one group holds a large share of the rows.

    Returns doc_id, keep_id, group_size, kept, text_sha256, one row per input row. Null text counts as empty; all empty
    texts are one group. A null id stays only if its group has no other. Where the smallest id repeats, one of its rows
    is kept. An empty table gives an empty result. Other columns are not read. ``key_bits`` shortens the keys, to test
    collisions.
    """
    mask = F.lit((1 << key_bits) - 1 if key_bits < 64 else -1)
    key = lambda c: F.xxhash64(c).bitwiseAND(mask)
    texts = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("text"))
    chunks = chunks_of(F.col("text"))

    recipes = written(
        texts.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.transform(chunks, key).alias("recipe"), F.monotonically_increasing_id().alias("row")),
        "recipes",
    )
    distinct = texts.select(F.explode(chunks).alias("chunk")).select(key(F.col("chunk")).alias("key"), "chunk").distinct()
    unclear = written(distinct.groupBy("key").count().where("count > 1").select("key"), "unclear-keys")
    if not unclear.isEmpty():
        recipes = recipes.join(_ordinals(texts, chunks, key, unclear), "text_sha256", "left")
    else:
        recipes = recipes.withColumn("ordinals", F.lit(None).cast("array<int>"))

    recipes = recipes.withColumn("recipe_key", F.xxhash64("recipe", "ordinals"))
    identifiers = ["recipe_key", "recipe", "ordinals"]
    groups = recipes.groupBy(identifiers).agg(
        F.min("doc_id").alias("keep_id"), F.coalesce(F.min_by("row", "doc_id"), F.min("row")).alias("keep_row"), F.count(F.lit(1)).alias("group_size")
    )
    groups = written(groups.where("group_size > 1"), "equal-groups")
    same = [recipes.recipe_key == groups.recipe_key, recipes.recipe == groups.recipe, recipes.ordinals.eqNullSafe(groups.ordinals)]
    alone = groups.group_size.isNull()
    return recipes.join(groups, same, "left").select(
        recipes.doc_id,
        F.when(alone, recipes.doc_id).otherwise(groups.keep_id).alias("keep_id"),
        F.coalesce(groups.group_size, F.lit(1)).cast("long").alias("group_size"),
        (alone | (recipes.row == groups.keep_row)).alias("kept"),
        recipes.text_sha256,
    )


def _ordinals(texts: DataFrame, chunks: Column, key, unclear: DataFrame) -> DataFrame:
    """For the texts that hold chunks with unclear keys: the ordered list of those chunks' ordinals, by the text's digest.

    The keys are counted, and few enough of them are broadcast, so that chunks are left out where they are cut: only those
    with an unclear key are written, and nothing else is shuffled.
    """
    few = F.broadcast(unclear) if unclear.count() <= FEW_KEYS else unclear
    placed = texts.select(F.sha2("text", 256).alias("text_sha256"), F.posexplode(chunks).alias("pos", "chunk"))
    placed = written(placed.withColumn("key", key(F.col("chunk"))).join(few, "key", "left_semi"), "unclear-chunks").distinct()
    numbered = placed.select("key", "chunk").distinct().withColumn("ordinal", F.row_number().over(Window.partitionBy("key").orderBy("chunk")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "ordinal"))), lambda x: x.ordinal)
    return placed.join(numbered, ["key", "chunk"]).groupBy("text_sha256").agg(ordered.alias("ordinals"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: of equal texts the one with the smallest id."""
    kept = exact_duplicates(docs, id_col, text_col).where("kept").select("doc_id", "text_sha256", F.lit(1))
    return repeat_rows(docs, [F.col(id_col), F.sha2(normalised(F.col(text_col)), 256)], kept)
