"""Connected components of a link table, by alternating stars over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoolsight.shared import written


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """Least node that each linked node can reach.

    ``links`` has columns ``u`` and ``v`` of one orderable type; direction and repeats do not matter, loops and nulls are
    ignored. Returns ``node`` and ``root``, one row per node of a link with another node; an empty table gives none.

    Large star: every node hands the least node of its neighbourhood to its larger neighbours. Small star: it does so to
    its smaller ones and itself. Alternating both, every component becomes a star around its least node in a number of
    rounds that grows with the logarithm of its size. Each round is written to the shared folder, so lineage stays short.
    Minima are pre-aggregated before they are shuffled; the joins on a node with very many neighbours are split by
    adaptive execution.
    """
    links = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links, before = written(links, name), None
    while True:
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select("v", "v").distinct())
        before = now
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.join(least, both.u == least.n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, name)
        down = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
        met = large.join(down, large.u == down.n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = written(met.union(down.select("n", "m")).distinct(), name)
