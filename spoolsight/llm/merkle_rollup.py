"""Merkle manifest of a dataset: a digest for every row, one for every source, one for all, and a proof for every row.

A source's leaves in their order are numbered; a number's digits to base 3 say where a leaf is in the tree. Grouping the last
digit away makes nodes of three children, so a block of 3^6 leaves becomes one nested struct by grouping its digits away one after
the other. Blocks' nodes are the leaves of the next tier. From the top tier down, a transform over the nested structs
gives every leaf its siblings, and an explode puts the leaves out; no joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoolsight.shared import written

WIDE, DIGITS = 3, 6
BLOCK = WIDE**DIGITS


def digest(*inputs: Column) -> Column:
    """Lowercase hex SHA-256 of the inputs, concatenated."""
    return F.sha2(F.concat(*inputs).cast("binary"), 256)


def framed(value: Column) -> Column:
    """A value with its length in bytes before it, ``-`` for null: distinct rows have distinct texts."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def numbered(leaves: DataFrame, key: str, by: list[Column]) -> DataFrame:
    """Leaves with ``rank`` (from 0) and ``n`` (how many) within their ``key``, by ``by``.

    Rows are sorted by ranges over key and order, and written with the number of their range; a range counts what it has of a key,
    and running sums over these counts say where it starts. So a key with a third of all rows is ranked in many tasks.
    """
    names = [f"_by{k}" for k in range(len(by))]
    ranged = leaves.select("*", *(c.alias(n) for c, n in zip(by, names, strict=True)))
    ranged = ranged.repartitionByRange(F.col(key), *(F.col(n) for n in names)).withColumn("range", F.spark_partition_id())
    ranged = written(ranged, "manifest-ranges")
    counts = ranged.groupBy(key, "range").agg(F.count(F.lit(1)).alias("here"))
    starts = F.sum("here").over(Window.partitionBy(key).orderBy("range")) - F.col("here")
    counts = counts.select(F.col(key).alias("_key"), F.col("range").alias("_range"), starts.alias("start"), F.sum("here").over(Window.partitionBy(key)).alias("n"))
    place = F.row_number().over(Window.partitionBy(key, "range").orderBy(*names)) - 1
    placed = ranged.withColumn("place", place).join(counts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("range") == F.col("_range")))
    return placed.select(*leaves.columns, (F.col("start") + F.col("place")).alias("rank"), "n")


def _tier(nodes: DataFrame, key: str) -> DataFrame:
    """Blocks of nodes (``key``, ``rank``, ``n``, ``node``: a struct with the digest ``h``), one nested struct each: ``key``, ``rank`` (of
    the block), ``n`` (of blocks), ``nest``. A level that a key has no nodes for passes its only node on.

    One shuffle by key and block; every further grouping has a longer key than it, so it shuffles nothing.
    """
    rank = F.col("rank")
    digits = [F.pmod(F.floor(rank / WIDE**d), F.lit(WIDE)).cast("int").alias(f"d{d}") for d in range(DIGITS)]
    now = nodes.select(key, F.floor(rank / BLOCK).alias("block"), *digits, "n", "node").repartition(F.col(key), F.col("block"))
    for d in range(DIGITS):
        rest = [f"d{e}" for e in range(d + 1, DIGITS)]
        kids = F.transform(F.array_sort(F.collect_list(F.struct(f"d{d}", "node"))), lambda k: k["node"])
        now = now.groupBy(key, "block", "n", *rest).agg(kids.alias("kids"))
        merged = digest(F.array_join(F.transform("kids", lambda k: k["h"]), ""))
        h = F.when(F.col("n") > WIDE**d, merged).otherwise(F.col("kids")[0]["h"])
        now = now.select(key, "block", "n", *rest, F.struct(h.alias("h"), (F.col("n") > WIDE**d).alias("made"), "kids").alias("node"))
    return now.select(key, F.col("block").alias("rank"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("node").alias("nest"))


def _paths(nest: Column, depth: int) -> Column:
    """Leaves below a nested node, with the siblings left and right of the way to each, lowest level first."""
    if depth == 0:
        return F.array(F.struct(nest.alias("node"), F.array().cast("array<struct<left:string,right:string>>").alias("path")))
    kids = nest["kids"]
    hexes = F.transform(kids, lambda k: k["h"])

    def below(kid: Column, at: Column) -> Column:
        left = F.array_join(F.slice(hexes, F.lit(1), at), "")
        right = F.array_join(F.slice(hexes, at + 2, F.lit(WIDE)), "")
        step = F.when(nest["made"], F.array(F.struct(left.alias("left"), right.alias("right")))).otherwise(F.array())
        return F.transform(_paths(kid, depth - 1), lambda p: F.struct(p["node"].alias("node"), F.concat(p["path"], step).alias("path")))

    return F.flatten(F.transform(kids, below))


def _unfolded(blocks: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Leaves of blocks that know their way up (``up``): columns ``names`` of the leaf's struct, ``path`` up to the root, ``tops``."""
    out = blocks.select(key, "up", "tops", F.explode(_paths(F.col("nest"), DIGITS)).alias("leaf"))
    return out.select(key, *(F.col(f"leaf.node.{c}").alias(c) for c in names), F.concat("leaf.path", "up").alias("path"), "tops")


def _met(blocks: DataFrame, above: DataFrame, key: str) -> DataFrame:
    """Blocks (``key``, ``rank``, ``nest``) with what the tier above them tells (``up``, ``tops``): rows of both are grouped by the block."""
    nothing = F.lit(None)
    both = blocks.select(key, "rank", "nest", nothing.cast(above.schema["up"].dataType).alias("up"), nothing.cast(above.schema["tops"].dataType).alias("tops"))
    both = both.unionByName(above.select(key, "rank", nothing.cast(blocks.schema["nest"].dataType).alias("nest"), "up", "tops"))
    return both.groupBy(key, "rank").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("nest", "up", "tops")))


def _folded(nodes: DataFrame, key: str, name: str) -> tuple[list[DataFrame], DataFrame]:
    """All tiers of blocks, lowest first, and the topmost nodes: ``key``, ``h``."""
    tiers = []
    while True:
        tiers.append(written(_tier(nodes, key), name))
        most = tiers[-1].agg(F.max("n").alias("n")).first().n
        if (most or 0) <= 1:
            return tiers, tiers[-1].select(key, F.col("nest.h").alias("h"))
        nodes = tiers[-1].select(key, "rank", "n", F.struct(F.col("nest.h").alias("h"), F.col("rank").alias("block")).alias("node"))


def _proved(tiers: list[DataFrame], tops: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Leaves with their ways to the root. ``tops``: ``key``, ``up`` (from the topmost node on) and ``tops``."""
    above = tops.withColumn("rank", F.lit(0).cast("long"))
    for tier in reversed(tiers[1:]):
        leaves = _unfolded(_met(tier, above, key), key, ["block"])
        above = leaves.select(key, F.col("block").alias("rank"), F.col("path").alias("up"), "tops")
    return _unfolded(_met(tiers[0], above, key), key, names)


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: dict[str, Column] | None = None) -> DataFrame:
    """A Merkle tree over ``docs`` and the proof of every row.

    A leaf is the digest of the row's ``columns`` (the first is its id, the second its source), each framed. Per source, leaves ascend
    by id, nulls first, rows with equal ids by their digests; while more than one node remains, every three consecutive ones
    (the last run: fewer, even one) become the digest of theirs. What remains, a lone leaf itself, is the subroot. Subroots by source
    (null first, bytewise) make the root in the same way. Returns, one row per row: the id, leaf, subroot, root, proof (array
    of (left, right): hex digests of the siblings on either side, lowest level first), proof_sha256 (of the siblings in that
    order), folded_root and verified.

    ``tampered`` replaces columns before a leaf is computed anew: folded_root is made from that leaf and the original siblings,
    and verified says whether it is the root. Without it every row is verified. Equal rows have equal leaves and are leaves
    each. An empty table gives an empty result. Other columns are not read.
    """
    id_col, source_col = columns[:2]
    original = [framed(F.col(c)) for c in columns]
    other = [framed((tampered or {}).get(c, F.col(c))) for c in columns]
    leaves = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), digest(*original).alias("h"), digest(*other).alias("seen"))
    nodes = numbered(leaves, "source", [F.col("id"), F.col("h"), F.col("seen")])
    nodes = nodes.select("source", "rank", "n", F.struct("h", "id", "seen").alias("node"))
    tiers, subroots = _folded(nodes, "source", "manifest-tier")

    sources = numbered(subroots.select(F.lit(0).alias("all"), "source", "h"), "all", [F.col("source")])
    sources = sources.select("all", "rank", "n", F.struct("h", "source").alias("node"))
    upper, root = _folded(sources, "all", "manifest-sources")
    no_way = F.array().cast("array<struct<left:string,right:string>>")
    top = root.select("all", no_way.alias("up"), F.struct(F.col("h").alias("root")).alias("tops"))
    ways = _proved(upper, top, "all", ["source", "h"])
    ways = ways.select("source", F.col("path").alias("up"), F.struct(F.col("h").alias("subroot"), "tops.root").alias("tops"))
    ways = written(ways, "manifest-ways")
    out = _proved(tiers, ways, "source", ["h", "id", "seen"])
    fold = F.aggregate("path", F.col("seen"), lambda now, step: digest(step["left"], now, step["right"]))
    proof = F.sha2(F.array_join(F.transform("path", lambda step: F.concat(step["left"], step["right"])), "").cast("binary"), 256)
    out = out.select(F.col("id").alias(id_col), F.col("h").alias("leaf"), "tops.subroot", "tops.root", F.col("path").alias("proof"), proof.alias("proof_sha256"), fold.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
