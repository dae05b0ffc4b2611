"""Raw log files as numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spoolsight.shared import written

MOST_BYTES = 10 << 20
#: Blocks whose counts are broadcast, some 100 bytes each; with more of them, lines and counts are joined by shuffle.
BLOCKS = 1_000_000


def read_jsonl(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """Lines of JSON log files: ``path``, ``line`` (from 1), ``value``, ``json`` (a VARIANT); and issues for lines that are too long
    or no JSON.

    A large log is split over tasks. Its lines are numbered by their place in a block of the file, on top of how many lines the
    blocks before hold. Only those counts, one row a block, are gathered by file; they are written, counted, and broadcast up to
    ``BLOCKS`` of them, so that no text moves. Blank lines are skipped but counted. Lines of over 10 MiB are skipped and
    reported; a bad line does not stop the file.
    """
    text = spark.read.text(list(paths), lineSep="\n", recursiveFileLookup=True)
    # a block is read by one task, in order, so that these ids follow one another within it
    text = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", "\r$", "").alias("value"))
    blocks = text.groupBy("path", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block")) - F.col("n")
    blocks = written(blocks.withColumn("before", before), "log-blocks")
    blocks = F.broadcast(blocks) if blocks.count() <= BLOCKS else blocks
    number = (F.col("before") + F.col("id") - F.col("first") + 1).alias("line")
    lines = text.join(blocks, ["path", "block"]).select("path", number, "value").where(F.trim("value") != "")
    return split_lines(lines)


def split_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good lines with their parsed value, and issues for the others; the work of ``read_jsonl`` on lines from any source."""
    size = F.octet_length("value")
    parsed = lines.withColumn("json", F.when(size <= MOST_BYTES, F.try_parse_json("value")))
    good = parsed.where("json is not null")
    category = F.when(size > MOST_BYTES, "size_limit").otherwise("bad_json")
    issues = parsed.where("json is null").select(
        F.lit(None).cast("bigint").alias("run_id"), F.when(size > MOST_BYTES, "warning").otherwise("error").alias("severity"), category.alias("category"), F.lit("").alias("agent"), "path", "line",
        F.concat(size.cast("string"), F.lit(" bytes")).alias("detail"),
    )
    return good, issues
