"""Near copies in the pipeline's stage, against brute force over all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from spoolsight.llm import near_copies


def documents(spark):
    """Copies with few, some and many changed words, a large group of near copies, texts mostly of one shared passage."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    say = lambda n: [word() for _ in range(n)]
    data = [say(rnd.choice([3, 5, 6, 8, 30, 300])) for _ in range(60)]
    for base in [say(200) for _ in range(20)]:
        data.append(base)
        for changes in (1, 2, 3, 4, 5, 6, 9):
            other = list(base)
            for k in rnd.sample(range(200), changes):
                other[k] = word()
            data.append(other)
    base, passage = say(150), say(40)
    for k in range(60):
        other = list(base)
        for i in rnd.sample(range(150), 1 + k % 3):
            other[i] = word()
        data += [other, passage + say(rnd.choice([4, 12, 50]))]
    for base in [say(3000) for _ in range(2)]:  # large sets, which also keep counts
        other, far = list(base), list(base)
        for k in rnd.sample(range(3000), 40):
            other[k] = word()
        for k in rnd.sample(range(3000), 200):
            far[k] = word()
        data += [base, other, far, base[:2000] + say(1000)]
    rows = [(k, " ".join(t)) for k, t in enumerate(data)] + [(1000, None), (1001, ""), (None, " ".join(data[0])), (1002, " ".join(data[70]).upper())]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string")


def brute(docs):
    rows = [(r.doc_id, near_copies.shingle_set(r.text).tolist()) for r in docs.collect()]
    sets, root = [set(s) for _, s in rows], list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if sets[a] == sets[b] or 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared) > 0:
                root[find(a)] = find(b)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    return sorted(min(x for x in g if x is not None) for g in groups.values())


@pytest.mark.parametrize("dense, common", [(32, 4), (3, 1), (100, 10**6)])
def test_stage_links_near_copies(spark, monkeypatch, dense, common):
    monkeypatch.setattr(near_copies, "DENSE", dense)
    monkeypatch.setattr(near_copies, "COMMON", common)
    docs = documents(spark)
    stage = dict(corpus_pipeline.STAGES)["near duplicates"]
    kept = stage(spark, docs, "")
    want = brute(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == want
    assert len(want) < docs.count() - 100


def test_prefix_of_every_size():
    for n in range(1, 500):
        least = min(k for k in range(n + 1) if 5 * k >= 4 * n)
        assert near_copies.prefix_length(n) == n - least + 1
    assert near_copies.prefix_length(0) == 0


def test_sketches_are_lower_bounds():
    rng = np.random.default_rng(3)
    for n in (10, 2000, 3000, 20_000):
        a = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(-(1 << 62), 1 << 62, n // 2)]))
        apart = len(np.setxor1d(a, b))
        bits = np.bitwise_count((near_copies.odd_classes(a, 2048) ^ near_copies.odd_classes(b, 2048)).view("u8")).sum()
        assert bits <= apart
        counts = [near_copies.class_counts(x) for x in (a, b)]
        if n <= near_copies.MANY:
            assert counts[0] is None
        else:
            assert np.abs(counts[0].astype(int) - counts[1]).sum() <= apart and 9 * np.abs(counts[0].astype(int) - counts[1]).sum() > len(a) + len(b)
    lists = near_copies._lists([np.array([1, 2], "i2"), None, np.zeros(0, "i2")], "i2")
    assert lists.to_pylist() == [[1, 2], None, []]
