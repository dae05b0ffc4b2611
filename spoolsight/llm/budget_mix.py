"""Mixing sources to target weights, each source's budget met by a subset sum over document lengths."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoolsight.llm.rows import repeat_rows
from spoolsight.shared import written

WORD = r"[^\x20\x09-\x0D]+"
#: What the knapsack is left of a budget, unless documents are so long that it needs more.
RESERVE = 1 << 15
RANKED_AT_ONCE = 256


def word_count(text: Column) -> Column:
    """Words of a whole text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """Adds ``target`` to a table of sources (``source``, ``source_size``).

    Sources by code point, null last, take the weights in turn, and share ``share`` times all sizes by weight. A target stops
    at ``most`` times its source's size, and the excess is shared among the others by weight until none is above. This comes
    to one level x with target = min(weight * x, cap); sorting by cap / weight, x follows from running sums.
    The table has one row per source, not per document, so its windows are small.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    number = (F.row_number().over(by_name) - 1) % len(weights)
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (number + 1).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    total = Window.partitionBy(F.lit(0))
    rows = rows.withColumn("budget", F.sum("source_size").over(total) * F.lit(float(share)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    capped_before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.col("budget") - capped_before) / weight_left).withColumn("place", F.row_number().over(order))
    # The first source in this order that its level does not lift above its cap sets the level of all from it on.
    free = F.col("level") * F.col("weight") <= F.col("cap")
    rows = rows.withColumn("x", F.min(F.when(free, F.struct("place", "level"))).over(total)["level"])
    return rows.select("source", "source_size", F.when(F.col("x").isNull(), F.col("cap")).otherwise(F.least(F.col("weight") * F.col("x"), F.col("cap"))).alias("target"))


def fit(lengths: list[int], counts: list[int], budget: int, least: int = RESERVE) -> list[int]:
    """How many documents of each length to take so that their lengths sum up to ``budget``, as near as can be.

    All of the budget but a reserve is met by an equal share of every length, from the longest on, so that large and small
    sources alike are drawn from all lengths: what rounding one length leaves over or short is carried to the next shorter
    ones. What is left is a bounded knapsack over the documents not taken yet (or, should rounding have overshot, over those to
    give back). The reserve is an eighth of the budget at first (``least``, or eight times the longest length, at most);
    while the sum is not the nearest that lengths with their common divisor could make, a larger one is tried, at last the
    whole budget, with which the knapsack alone finds the nearest sum there is. The nearest try holds, the first of equals.
    """
    whole = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= whole:
        return list(counts)
    order = sorted((k for k in range(len(lengths)) if lengths[k] > 0 and counts[k] > 0), key=lambda k: -lengths[k])
    step = math.gcd(*(lengths[k] for k in order))
    perfect = min(budget % step, -budget % step)
    misses = lambda taken: abs(budget - sum(n * t for n, t in zip(lengths, taken, strict=True)))
    enough = max(least, 8 * lengths[order[0]])
    reserve = min(enough, budget // 8)
    best = _spread(lengths, counts, budget, reserve, order, whole)
    while misses(best) > perfect and reserve < budget:
        reserve = min(budget, max(enough, 4 * reserve))
        best = min(best, _spread(lengths, counts, budget, reserve, order, whole), key=misses)
    return best


def _spread(lengths: list[int], counts: list[int], budget: int, reserve: int, order: list[int], whole: int) -> list[int]:
    share, taken, carry = budget - reserve, [0] * len(lengths), 0
    for k in order:
        n, c = lengths[k], counts[k]
        ideal = n * c * share // whole + carry
        taken[k] = min(c, max(0, (2 * ideal + n) // (2 * n)))
        carry = ideal - taken[k] * n
    rest = budget - sum(n * t for n, t in zip(lengths, taken, strict=True))
    if rest >= 0:
        more = _knapsack(lengths, [c - t for c, t in zip(counts, taken, strict=True)], order, rest)
        return [t + m for t, m in zip(taken, more, strict=True)]
    less = _knapsack(lengths, taken, order, -rest)
    return [t - m for t, m in zip(taken, less, strict=True)]


def _knapsack(lengths: list[int], counts: list[int], order: list[int], rest: int) -> list[int]:
    """How many of each length sum up nearest to ``rest``, the lesser sum of two that are as near.

    Dynamic programming over sums, in units of the lengths' common divisor: the bits of one number say which sums can be made,
    and each sum remembers the step that first made it, so that every step uses only documents that earlier ones left. The
    nearest sum above ``rest`` is less than the longest length away, as it would do without one of its documents otherwise.
    """
    order = [k for k in order if counts[k]]
    took = [0] * len(lengths)
    if not order:
        return took
    unit = math.gcd(*(lengths[k] for k in order))
    top = (rest + lengths[order[0]]) // unit
    limit, sums, steps = (1 << top + 1) - 1, 1, []
    first = np.full(top + 1, -1, "i4")  # of each sum, the step that made it
    near = {rest // unit, -(-rest // unit)} if 2 * (rest % unit) == unit else {(2 * rest + unit) // (2 * unit)}
    for k in order:
        n, step, left = lengths[k] // unit, 1, min(counts[k], top // (lengths[k] // unit))
        while left and not any(sums >> s & 1 for s in near):
            step = min(step, left)
            new = sums << n * step & limit & ~sums
            first[_bits(new)] = len(steps)
            steps.append((k, step))
            sums |= new
            left, step = left - step, 2 * step
    made = np.flatnonzero(first >= 0)
    at = min([0, *made.tolist()] if len(made) < 64 else _around(made, rest / unit), key=lambda s: (abs(s * unit - rest), s))
    while at:
        k, step = steps[first[at]]
        took[k] += step
        at -= step * lengths[k] // unit
    return took


def _around(made: np.ndarray, place: float) -> list[int]:
    """The sums next to a place, on both sides."""
    at = int(np.searchsorted(made, place))
    return [0, *made[max(0, at - 1) : at + 1].tolist()]


def _bits(number: int) -> np.ndarray:
    """Places of the bits that are set."""
    raw = np.frombuffer(number.to_bytes((number.bit_length() + 7) // 8, "little"), "u1")
    return np.flatnonzero(np.unpackbits(raw, bitorder="little"))


def mix(
    docs: DataFrame, weights: list[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """How often a mix to target weights takes each document.

    1. Size (words) of every text, where it is read; only id, source, size and a seeded hash go on.
    2. Documents are counted by source and exact size. Sources' targets follow from the counts (``targets``).
    3. A source gives all its documents as often as fits (0 to ``most`` - 1 times); ``fit`` meets the rest of its budget and
       says how many documents of each size go once more (word-less ones never count). It sees a source's counts by size, never its documents.
    4. Of each source and size, that many are chosen by smallest seeded hash. A group of many documents is split into
       hash ranges of about 256; whole ranges are taken by their counts, and ranks are made only within a range.

    Returns doc_id, size, source_size, target, passes, taken (words, repeats counted), and the source and hash that the
    choice went by, one row per input row. Null text has
    size 0; a null source is a source of its own. Reruns agree. Rows that are equal in id, source and text are told apart
    only by which of them comes first; their number taken is the same in any case. Empty tables give empty results; where
    all sizes are 0, targets and taken are 0. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), seeded(seed, id_col, text_col).alias("h"))
    rows = written(rows, "mix-rows")
    counts = written(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    aims = targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), list(weights), share, most)

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        size, target = int(group.source_size.iloc[0]), float(group.target.iloc[0])
        passes = min(int(target // size), int(most)) if size else 0
        once = fit(group["size"].tolist(), group.n.tolist(), max(0, round(target - passes * size)))
        return group.assign(passes=passes, chosen=once)

    source_key = [F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("named")]
    sized = counts.select(*source_key, "size", "n").join(aims.select(*source_key, "source_size", "target"), ["no_source", "named"])
    planned = written(
        sized.groupBy("no_source", "named").applyInPandas(plan, "no_source boolean, named string, size long, n long, source_size long, target double, passes int, chosen long"),
        "mix-plan",
    )
    by = ["no_source", "named", "size"]
    ranges = F.greatest(F.lit(1), F.ceil(F.col("n") / RANKED_AT_ONCE)).cast("long")
    dealt = rows.select("*", *source_key).join(planned, by).withColumn("ranges", ranges)
    # the hash's upper 31 bits, spread over the group's ranges in order
    dealt = dealt.withColumn("range", F.shiftright(F.shiftrightunsigned("h", 33) * F.col("ranges"), 31))
    split = dealt.where("ranges > 1").groupBy(*by, "range").agg(F.count(F.lit(1)).alias("here"))
    before = F.sum("here").over(Window.partitionBy(by).orderBy("range")) - F.col("here")
    split = split.select(*by, "range", before.alias("earlier"))
    ranked = dealt.join(split, [*by, "range"], "left").withColumn("earlier", F.coalesce("earlier", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(*by, "range").orderBy(F.shiftrightunsigned("h", 1), "h", "doc_id"))
    times = F.col("passes") + (F.col("earlier") + rank <= F.col("chosen")).cast("int")
    return ranked.select("doc_id", "size", "source_size", "target", times.alias("passes"), (F.col("size") * times).cast("long").alias("taken"), "source", "h")


def seeded(seed: int, id_col: str, text_col: str) -> Column:
    """Hash that orders documents for selection."""
    return F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))


def apply_mix(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed rows, with all their columns: each document as often as ``mix`` takes it. Documents without words go once for
    each pass, as their source's others do."""
    mixed = mix(docs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    times = mixed.groupBy("doc_id", "source", "h").agg(F.sum("passes").alias("times"))
    return repeat_rows(docs, [F.col(id_col), F.col(source_col), seeded(seed, id_col, text_col)], times)
