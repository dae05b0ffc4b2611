"""Pairs of nodes and what lies below them, against a search of each node by itself, and without pairs in a shuffle."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spoolsight.operators import sessions as S

EDGES = "agent string, from_id string, to_id string, kind string"


def _searched(edges: list[tuple[str, str]]) -> set[tuple[str, str]]:
    below: dict[str, set[str]] = {}
    for child, parent in edges:
        below.setdefault(parent, set()).add(child)
    out = set()
    for root in below:
        todo, seen = [root], set()
        while todo:
            new = below.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        out |= {(root, n) for n in seen if n != root}
    return out


def _random(seed: int) -> list[tuple[str, str]]:
    """A forest with chains, with a few links more: rings, several parents, links to itself."""
    rng = random.Random(seed)
    edges = {(f"n{k}", f"n{max(k - 1, rng.randrange(max(k - 3, 0), k))}") for k in range(1, 90) if k % 45}
    for _ in range(seed % 4 * 2):
        edges.add((f"n{rng.randrange(90)}", f"n{rng.randrange(90)}"))
    return sorted(edges)


@pytest.mark.parametrize("seed", (0, 3))
def test_pairs_are_those_of_a_search(spark, seed):
    edges = _random(seed) + [(f"r{k}", f"r{(k + 1) % 20}") for k in range(20)] * (seed % 2) + [(f"t{k}", "r3") for k in range(3)] * (seed % 2)
    got = S.descendants(spark.createDataFrame([("a", c, p, S.SUBAGENT) for c, p in edges], EDGES).coalesce(1)).collect()
    assert len(got) == len(set(got))
    assert {(r.root, r.node) for r in got} == _searched(edges)


def test_pairs_of_chains_are_not_stored(spark, monkeypatch):
    stored, written = [], S.written

    def counted(df, name):
        out = written(df, name)
        stored.append(out.count())
        return out

    monkeypatch.setattr(S, "written", counted)
    chains = spark.range(2000).select(F.lit("a").alias("agent"), F.concat(F.lit("n"), "id").alias("from_id"), F.concat(F.lit("n"), F.col("id") - F.when(F.col("id") % 100 == 0, 0).otherwise(1)).alias("to_id"), F.lit(S.SUBAGENT).alias("kind"))
    assert S.descendants(chains).count() == 20 * 99 * 50
    assert max(stored) <= 2000
