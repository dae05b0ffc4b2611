"""Near copies: every pair of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more is linked.

Exact: a join over prefixes of the ordered sets finds all such pairs, and each candidate is verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoolsight.llm.graph import components
from spoolsight.llm.resident import release
from spoolsight.llm.rows import repeat_rows
from spoolsight.llm.simhash_links import SEED, fingerprint_words, near_duplicates
from spoolsight.shared import written

SHINGLE = 5
DENSE = 32
#: Shingles met this often in the sample of one text in SAMPLE come last in the order of all. These only set how many candidates
#: there are, never which pairs are found.
SAMPLE, COMMON, COMMON_AT_MOST = 16, 4, 1_000_000
BROADCAST_AT_MOST = 1_000_000
#: Classes of the wide sketch. Sets of over ``MANY`` shingles, most of whose classes are met, also keep how many fall in each.
WIDE, MANY = 2048, 2048
ROWS_AT_ONCE = 128


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct XXH64 of a text's shingles, as longs. Texts of up to five words have one, wordless ones none."""
    return np.unique(np.array(fingerprint_words(text, SHINGLE), "u8").view("i8"))


def _node(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED) - (1 << 63)


def prefix_length(n: int) -> int:
    """Of two sets at 0.8 or more, the first shingle they share is among so many first ones of each; 0 for an empty set."""
    return n - (4 * n + 4) // 5 + 1 if n else 0


def odd_classes(shingles: np.ndarray, classes: int) -> np.ndarray:
    """Longs of bits, for each class of hashes whether a set has an odd number of them."""
    return np.packbits((np.bincount(shingles & (classes - 1), minlength=classes) & 1).astype("u1"), bitorder="little").view("<i8")


def class_counts(shingles: np.ndarray) -> np.ndarray | None:
    """How many hashes of a large set fall in each class; their differences add up to no more than the sets differ by."""
    return np.minimum(np.bincount(shingles & (WIDE - 1), minlength=WIDE), 32767).astype("i2") if len(shingles) > MANY else None


def _lists(arrays: list[np.ndarray | None], kind: str = "i8") -> pa.Array:
    """Arrays as one list column; None is null."""
    starts = np.cumsum([0, *(0 if a is None else len(a) for a in arrays)])
    values = np.concatenate([np.zeros(0, kind), *(a for a in arrays if a is not None)])
    return pa.ListArray.from_arrays(pa.array(starts, "int32", mask=np.array([*(a is None for a in arrays), False])), pa.array(values))


def _few_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))


def common_shingles(texts: DataFrame) -> np.ndarray:
    """Sorted shingles that the sample holds often, the most frequent ones if there are too many to send."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py()))], names=["token"])

    sample = texts.where(F.pmod(F.xxhash64("key"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "token long")
    counted = written(sample.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON), "common-shingles")
    total, least = 0, None
    steps = counted.groupBy(F.least("n", F.lit(10_000)).alias("n")).agg(F.count(F.lit(1)).alias("tokens"))
    for row in sorted(steps.collect(), reverse=True):
        total += row.tokens
        if total > COMMON_AT_MOST:
            break
        least = row.n
    if least is None:
        return np.zeros(0, "i8")
    return np.sort(np.array([r.token for r in counted.where(F.col("n") >= least).select("token").toLocalIterator()], "i8"))


def prefixes(texts: DataFrame, common: np.ndarray) -> DataFrame:
    """Per text: ``node`` (hash of its set), ``n`` (size), ``odd`` (for each of 64 classes of shingles whether it has an odd
    number of them), ``wide`` (so for 2,048 classes), ``many`` (of large sets, how many fall in each) and ``prefix`` (the first shingles in the order of all: common ones last, then by hash)."""
    sent = texts.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        late = sent.value
        for batch in _few_rows(batches):
            nodes, sizes, odd, wide, many, first = [], [], [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py())
                nodes.append(_node(s))
                sizes.append(len(s))
                odd.append(odd_classes(s, 64)[0])
                wide.append(odd_classes(s, WIDE))
                many.append(class_counts(s))
                if len(late) and len(s):
                    at = late[np.minimum(np.searchsorted(late, s), len(late) - 1)] == s
                    s = np.concatenate([s[~at], s[at]])
                first.append(s[: prefix_length(len(s))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(nodes, "int64"), pa.array(sizes, "int32"), pa.array(odd, "int64"), _lists(wide), _lists(many, "i2"), _lists(first)], names=["doc_id", "key", "node", "n", "odd", "wide", "many", "prefix"])

    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, key long, node long, n int, odd long, wide array<long>, many array<short>, prefix array<long>")


def may_reach(a: Column, b: Column) -> Column:
    """False only where two sets that first meet at this shingle cannot be at 0.8: by their sizes, by what follows the shingle in
    each, or by the odd classes, of which no more can differ than shingles do."""
    n, m = a["n"], b["n"]
    after = F.least(n - a["pos"], m - b["pos"])
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * after >= 4 * (n + m)) & (9 * F.bit_count(a["odd"].bitwiseXOR(b["odd"])) <= n + m)


def verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs ``u``, ``v`` at 0.8 or more, by their whole sets. Whole sets are only made for pairs whose wide odd classes, and of
    large sets the counts in them, let them be at 0.8."""
    pairs = written(pairs.distinct(), "met-pairs")
    a, b = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"{x}n"), F.col("wide").alias(f"{x}w"), F.col("many").alias(f"{x}m")) for x in "uv")
    whole = lambda parts: F.aggregate(parts, F.lit(0), lambda x, y: x + y)
    differ = whole(F.zip_with("uw", "vw", lambda x, y: F.bit_count(x.bitwiseXOR(y))))
    more = F.coalesce(whole(F.zip_with("um", "vm", lambda x, y: F.abs(x.cast("int") - y.cast("int")))), F.lit(0))
    pairs = pairs.join(a, "u").join(b, "v").where((9 * differ <= F.col("un") + F.col("vn")) & (9 * more <= F.col("un") + F.col("vn")))
    pairs = written(pairs.select("u", "v"), "candidates")
    ends = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    keys = written(nodes.join(ends, "node", "left_semi").select("key").distinct(), "candidate-texts")
    few = F.broadcast(keys) if keys.count() <= BROADCAST_AT_MOST else keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in _few_rows(batches):
            sets = [shingle_set(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], "int64"), _lists(sets)], names=["node", "shingles"])

    found = texts.join(few, "key", "left_semi").select("text").mapInArrow(run, "node long, shingles array<long>")
    sets = written(found.dropDuplicates(["node"]), "candidate-sets")
    a, b = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"{x}s")) for x in "uv")
    both = pairs.join(a, "u").join(b, "v")
    return both.where(9 * F.size(F.array_intersect("us", "vs")) >= 4 * (F.size("us") + F.size("vs"))).select("u", "v")


def links(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links ``u``, ``v`` that connect exactly what pairs at 0.8 or more connect. ``nodes``: rows of ``prefixes``, distinct sets.

    Sets meet in a cell for each shingle of their prefixes. First, of each cell only a star around one member is verified: the
    one with the fewest shingles that no other prefix has, as a text that many were copied from has none. All cells prefer
    the same one, so that stars repeat few pairs. Then only members of different components are left to try: in a cell of
    up to 32 pairwise inside the row, in a denser one those that are not in its largest component with the members of
    other components. So a large group of near copies makes no square of pairs.
    """
    dealt = nodes.select("node", "n", "odd", F.size("prefix").alias("prefix"), F.posexplode("prefix").alias("pos", "cell"))
    met = written(dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "shared-shingles")
    more = written(dealt.join(met, "cell"), "cells")
    own = more.groupBy("node").agg((F.first("prefix") - F.count(F.lit(1))).alias("own"))
    # what a common cell is joined with is written first, as Spark splits a large key only between two plain exchanges
    centres = written(more.join(own, "node").groupBy("cell").agg(F.min_by(F.struct("node", "n", "pos", "odd"), F.struct("own", "node")).alias("a")), "cell-centres")

    member = F.struct("node", "n", "pos", "odd")
    stars = more.select("cell", member.alias("b")).join(centres, "cell").where((F.col("a.node") != F.col("b.node")) & may_reach(F.col("a"), F.col("b")))
    first = written(verified(stars.select(_pair("a.node", "b.node")).select("p.*"), texts, nodes), "near-links")

    joined = components(first, "near-links-joined")
    apart = written(more.join(joined, "node", "left").select("cell", "members", F.coalesce("root", "node").alias("root"), member.alias("m")), "cells-joined")
    held = apart.where(F.col("members") <= DENSE).groupBy("cell").agg(F.collect_list(F.struct("root", "m")).alias("all")).where(F.size(F.array_distinct("all.root")) > 1)
    tested = F.flatten(F.transform("all", lambda a: F.transform(F.filter("all", lambda b: (a["root"] != b["root"]) & (a["m"]["node"] < b["m"]["node"]) & may_reach(a["m"], b["m"])), lambda b: F.struct(a["m"]["node"].alias("u"), b["m"]["node"].alias("v")))))
    few = held.select(F.explode(tested).alias("p")).select("p.*")

    dense = apart.where(F.col("members") > DENSE)
    largest = dense.groupBy("cell", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("cell").agg(F.max_by("root", "c").alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("cell", "main")
    rest = dense.join(written(largest, "largest-components"), "cell").where("root <> main").select("cell", F.col("root").alias("ra"), F.col("m").alias("a"), "main")
    rest = written(rest, "outside-members")
    others = dense.select("cell", F.col("root").alias("rb"), F.col("m").alias("b"))
    once = (F.col("rb") == F.col("main")) | (F.col("a.node") < F.col("b.node"))
    tried = rest.join(others, "cell").where((F.col("ra") != F.col("rb")) & once & may_reach(F.col("a"), F.col("b")))
    return first.union(verified(few.union(tried.select(_pair("a.node", "b.node")).select("p.*")), texts, nodes))


def _pair(a: str, b: str) -> Column:
    return F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).alias("p")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ``key`` (a hash of the text) and ``root`` (names the component), one row per input row. Equal sets are one node, so
    copies make no pairs; null and wordless texts are one component."""
    texts = _texts(docs, id_col, text_col)
    found = written(prefixes(texts, common_shingles(texts)), "shingle-prefixes")
    nodes = written(found.dropDuplicates(["node"]).select("key", "node", "n", "odd", "wide", "many", "prefix"), "distinct-sets")
    joined = written(components(links(texts, nodes), "near-copies"), "near-roots")
    return found.join(joined, "node", "left").select("doc_id", "key", F.coalesce("root", "node").alias("root"))


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component stays, with all its columns: the smallest id's (of its texts, the one of least hash)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    kept = near_copies(docs, id_col, text_col).groupBy("root").agg(first).select("first.doc_id", "first.key", F.lit(1))
    return repeat_rows(docs, [F.col(id_col), F.xxhash64(text_col)], kept)


def keep_one_of_each_way(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group that fingerprints at 2 or fewer differing bits (op 7) and shingle sets at 0.8 or more link together, with
    all its columns: the smallest id's. Both ways look at all rows. A text is in one group of either way; groups that have a
    text in common are one."""
    by_bits = written(near_duplicates(docs, id_col, text_col).select("key", F.xxhash64(F.lit("bits"), "root").alias("u")).distinct(), "groups-by-bits")
    by_sets = written(near_copies(docs, id_col, text_col).select("doc_id", "key", F.xxhash64(F.lit("sets"), "root").alias("v")), "groups-by-sets")
    joined = components(by_bits.join(by_sets.select("key", "v").distinct(), "key").select("u", "v"), "groups-joined")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    kept = by_sets.join(joined, by_sets.v == joined.node).groupBy("root").agg(first).select("first.doc_id", "first.key", F.lit(1))
    return repeat_rows(docs, [F.col(id_col), F.xxhash64(text_col)], kept)
