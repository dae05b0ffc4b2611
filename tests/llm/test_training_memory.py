"""The driver's memory while it trains the language model."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np

from spoolsight.llm import langid_crf


def _sample(words: int) -> list[tuple[str, str]]:
    rng = random.Random(5)
    spelled = ["".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(words)]
    return [(" ".join(spelled[at : at + 100]), "abcd"[at // 100 % 4]) for at in range(0, words, 100)]


def test_training_does_not_hold_what_it_makes_on_the_way_for_all_words():
    texts = _sample(30_000)
    tracemalloc.start()
    try:
        langid_crf.train(texts, rounds=2)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 30_000 * 2_000  # bytes; a word has 29 features here


def test_features_and_sums_in_parts_are_those_of_all(monkeypatch):
    words = [w for text, _ in _sample(500) for w in text.split()] + ["x"]
    ids, starts, hashes = langid_crf._feature_ids(words)
    weights = np.random.default_rng(3).normal(size=(langid_crf.BUCKETS + 1, 3))
    monkeypatch.setattr(langid_crf, "TRAINED_AT_ONCE", 7)
    for whole, parts in zip((ids, starts, hashes), langid_crf._sample_feature_ids(words), strict=True):
        assert (whole == parts).all()
    assert (langid_crf._word_sums(weights, ids, starts) == np.add.reduceat(weights[ids], starts, axis=0)).all()
