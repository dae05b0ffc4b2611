"""Putting decisions on documents into effect on their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def repeat_rows(docs: DataFrame, keys: list[Column], decisions: DataFrame) -> DataFrame:
    """Each row of ``docs`` as often as decided, with all its columns.

    ``keys`` are computed from a row and name it; ``decisions`` has as many key columns, without repeats, and last the number of
    times. Rows without a decision go. Rows with the same key count as one row, so a number says how often in all. Nulls
    match nulls. ``docs`` is shuffled once, by the keys, and not for the window after it; the keys hold the id, so groups of
    copies are spread. Names of ``docs`` cannot clash: key columns get names that it does not have.
    """
    free = (n for k in range(1 << 30) if (n := f"_k{k}") not in docs.columns)
    spelled = lambda c: (F.coalesce(c.cast("string"), F.lit("")), c.isNull())
    names = [next(free) for _ in range(2 * len(keys))]
    times, place = next(free), next(free)
    left = docs.select("*", *(c.alias(n) for c, n in zip((x for c in keys for x in spelled(c)), names, strict=True)))
    told = [F.col(c) for c in decisions.columns]
    right = decisions.select(*(c.alias(n) for c, n in zip((x for c in told[:-1] for x in spelled(c)), names, strict=True)), told[-1].alias(times))
    first = left.join(right, names).withColumn(place, F.row_number().over(Window.partitionBy(*names).orderBy(*names))).where(F.col(place) == 1)
    some = first.where(F.col(times) > 0).withColumn(place, F.explode(F.array_repeat(F.lit(0), F.col(times).cast("int"))))
    return some.select(*(F.col(f"`{c}`") for c in docs.columns))
