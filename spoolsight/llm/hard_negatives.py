"""Hard negatives for embeddings, by the threshold algorithm over sorted lists of every dimension.

An anchor's positives are the rows of its label nearest to it by inner product; a hard negative has another label and a score in a
window that a positive's score sets. Both searches are top-k searches for a sum over dimensions, so both use the same walk: rows
are kept in blocks, a block has the order of its rows in every dimension; an anchor goes down the lists, from the top where
its component is positive and from the bottom where it is negative, scores what it meets, and ends once no row that it has
not met can still count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoolsight.shared import written

#: Rows of a block, and anchors that walk through it in one task.
ROWS, ANCHORS = 8192, 1024
#: Components beyond this are set to it, so that an inner product of 512 of them fits a long.
COMPONENT = 1 << 27
FIRST_DEPTH = 16


class Block:
    """Integer vectors with the order of the rows in each dimension. ``ids`` break ties, smaller ones first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by], vectors[by]
        self.order = np.argsort(self.vectors, axis=0, kind="stable")  # ascending, one column a dimension
        self.values = np.take_along_axis(self.vectors, self.order, axis=0)

    def top(self, anchor: np.ndarray, windows: list[tuple[int, int]], k: int, without: int | None = None) -> list[list[tuple[int, int]]]:
        """For each window (least and greatest score) its ``k`` best rows as (score, id), higher scores first, then smaller ids.

        Sorted access goes as deep in all lists at once, twice as deep in each round; every row met is scored whole (random
        access). The threshold is the score that a row would have with the last value met in each list, so no row that was not
        met has more. A window is done when the threshold is strictly below its k-th score, or below all it admits.
        """
        n = len(self.ids)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        met = np.zeros(n, bool)
        rows, scores = np.zeros(0, "i8"), np.zeros(0, "i8")
        depth, found = 0, [[] for _ in windows]
        left = list(range(len(windows)))
        while left and n:
            deeper = min(n, max(FIRST_DEPTH, 2 * depth))
            now = np.zeros(n, bool)
            now[self.order[n - deeper : n - depth, up]] = True
            now[self.order[depth:deeper, down]] = True
            if deeper == n:
                now[:] = True
            new = np.flatnonzero(now & ~met)
            met[new] = True
            if without is not None:
                new = new[self.ids[new] != without]
            rows, scores = np.append(rows, new), np.append(scores, self.vectors[new] @ anchor)
            depth = deeper
            threshold = int(self.values[n - depth, up] @ anchor[up] + self.values[depth - 1, down] @ anchor[down])
            for w in [*left]:
                low, high = windows[w]
                inside = np.flatnonzero((scores >= low) & (scores <= high))
                if len(inside) > k:
                    least = np.partition(scores[inside], len(inside) - k)[len(inside) - k]
                    inside = inside[scores[inside] >= least]
                best = inside[np.lexsort((rows[inside], -scores[inside]))][:k]  # rows are in the order of ids
                if depth == n or threshold < low or (len(best) == k and threshold < scores[best[-1]]):
                    found[w] = [(int(scores[b]), int(self.ids[rows[b]])) for b in best]
                    left.remove(w)
        return found


def _matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of numbers as rows of ``width``; shorter ones end in zeros."""
    lists = lists.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype("i8")
    out = np.zeros((len(lists), width), "i8")
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def quantised(embeddings: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", label: Column | None = None) -> DataFrame:
    """Rows that take part: ``id``, ``label``, ``vector`` (array of long, floor(scale * x)).

    Rows with a null label, a null vector, a null or non-finite component, or a null id take no part. Of rows that repeat an id the
    least by label and vector is taken. An empty vector scores 0 with all; a shorter one counts as ending in zeros.
    """
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    rows = embeddings.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & finite)
    bounded = lambda c: F.greatest(F.lit(-float(COMPONENT)), F.least(F.lit(float(COMPONENT)), F.lit(float(scale)) * c.cast("double")))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), (F.col(label_col) if label is None else label).alias("label"), F.transform(x, lambda c: F.floor(bounded(c))).alias("vector"))
    return rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row")).select("id", "row.label", "row.vector")


def _dealt(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows with the number of their part among those of their label; a part has about ``size`` of them."""
    parts = rows.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))
    return rows.join(parts, "label").select("id", "label", "vector", F.pmod(F.xxhash64("id"), "parts").alias(name), F.col("parts").alias(f"{name}s"))


def positives(rows: DataFrame, anchors: DataFrame, k: int, width: int) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``positive_score``: the ``k`` best other rows of each anchor's label. Parts of a label's anchors
    meet blocks of its rows; each block gives its own best ones, of which the best stay."""
    blocks, parts = _dealt(rows, ROWS, "block"), _dealt(anchors, ANCHORS, "part")
    blocks = blocks.join(parts.groupBy("label").agg(F.first("parts").alias("parts")), "label")
    blocks = blocks.select("id", "label", "vector", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    many = rows.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / ROWS).alias("blocks"))
    parts = parts.join(many, "label").select("id", "label", "vector", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))

    def run(left, right):
        out = []
        if left.num_rows and right.num_rows:
            block = Block(left["id"].to_numpy(), _matrix(left["vector"], width))
            for a, v in zip(right["id"].to_pylist(), _matrix(right["vector"], width), strict=True):
                out += [(a, i, s) for s, i in block.top(v, [(-(1 << 63), (1 << 63) - 1)], k, without=a)[0]]
        return pa.table({c: pa.array(list(v), "int64") for c, v in zip(("anchor_id", "positive_id", "positive_score"), zip(*out) if out else ((), (), ()), strict=True)})

    by = ["label", "block", "part"]
    met = blocks.groupBy(by).cogroup(parts.groupBy(by)).applyInArrow(run, "anchor_id long, positive_id long, positive_score long")
    best = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    return met.withColumn("place", best).where(F.col("place") <= k).drop("place")


def mine(rows: DataFrame, anchors: DataFrame, low: int = 30, high: int = 90, positives_each: int = 5, negatives_each: int = 10) -> DataFrame:
    """Hard negatives of ``anchors``, rows of ``rows`` (both as ``quantised`` gives them).

    A row's score is its integer inner product with the anchor. An anchor's positives are its ``positives_each`` best other rows of
    its label (all, if fewer). For each, the best ``negatives_each`` rows of other labels with
    low * positive_score <= 100 * score <= high * positive_score are returned, as anchor_id, positive_id, rank (from 1),
    negative_id, positive_score, negative_score; a positive without any has no row. Ties go to smaller ids. Empty tables give
    empty results.

    The anchors are a query set that meets all rows in blocks: each block (8,192 rows of one label at most, about) is joined by its
    number with parts of 1,024 anchors, and gives at most ``negatives_each`` rows for a positive. Labels that hold much have many blocks.
    """
    rows, anchors = written(rows, "negatives-rows"), written(anchors, "negatives-anchors")
    width = max(1, rows.agg(F.max(F.size("vector")).alias("w")).first().w or 1)
    near = written(positives(rows, anchors, positives_each, width), "positives")
    sought = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("positive_id", "positive_score"))).alias("near"))
    sought = written(anchors.join(sought.withColumnRenamed("anchor_id", "id"), "id"), "sought-anchors")
    parts = max(1, -(-sought.count() // ANCHORS))
    blocks = _dealt(rows, ROWS, "block")
    labels = blocks.groupBy("label", "block").agg(F.count(F.lit(1)).alias("n")).select(F.col("label").alias("of"), F.col("block").alias("block"))
    each = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    blocks = blocks.select("id", F.col("label").alias("of"), "vector", "block", each)
    sought = sought.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    # every part of the query set against every block of all rows
    sought = sought.join(labels.select("of", "block", each), "part").where(F.col("label") != F.col("of"))

    def run(left, right):
        out = []
        if left.num_rows and right.num_rows:
            block = Block(left["id"].to_numpy(), _matrix(left["vector"], width))
            for a, v, near in zip(right["id"].to_pylist(), _matrix(right["vector"], width), right["near"].to_pylist(), strict=True):
                windows = [(-(-low * p["positive_score"] // 100), high * p["positive_score"] // 100) for p in near]
                open_ = [w for w, (least, most) in enumerate(windows) if least <= most]
                for w, best in zip(open_, block.top(v, [windows[w] for w in open_], negatives_each), strict=True):
                    out += [(a, near[w]["positive_id"], i, near[w]["positive_score"], s) for s, i in best]
        names = ("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score")
        return pa.table({c: pa.array(list(v), "int64") for c, v in zip(names, zip(*out) if out else [()] * 5, strict=True)})

    by = ["of", "block", "part"]
    met = blocks.groupBy(by).cogroup(sought.groupBy(by)).applyInArrow(run, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= negatives_each).select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")
