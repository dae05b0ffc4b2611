"""Merkle rollup, hard negatives and repeated spans, against plain Python on small awkward tables."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoolsight.llm import hard_negatives, merkle_rollup, suffix_spans
from spoolsight.session import ship_package

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, h string, node string, rank int, path string, key string, data string, u1 string"
CLASH = ("z", "z", 1, "z", "z", "z", "z")


# -- Merkle rollup
def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(hashes):
    """Root and, for each leaf, (left, right) of every level."""
    level, ways, at = list(hashes), [[] for _ in hashes], list(range(len(hashes)))
    while len(level) > 1:
        for k, place in enumerate(at):
            run = level[place // 3 * 3 : place // 3 * 3 + 3]
            ways[k].append(("".join(run[: place % 3]), "".join(run[place % 3 + 1 :])))
        at = [p // 3 for p in at]
        level = [sha(*level[k : k + 3]) for k in range(0, len(level), 3)]
    return level[0], ways


def plain_manifest(rows, change):
    leaf = lambda r, text: sha(*map(framed, (*r[:4], text)))
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    low = lambda v: (v is not None, v if v is not None else 0)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in sources:
        own = sorted(by_source[s], key=lambda r: (low(r[0]), leaf(r, r[4])))
        made[s] = own, *tree([leaf(r, r[4]) for r in own])
    root, up = tree([made[s][1] for s in sources])
    out = []
    for s, over in zip(sources, up, strict=True):
        own, subroot, ways = made[s]
        for r, way in zip(own, ways, strict=True):
            folded = leaf(r, change(r))
            for a, b in way + over:
                folded = sha(a, folded, b)
            out.append((r[0], leaf(r, r[4]), subroot, root, sha(*(x for step in way + over for x in step)), folded, folded == root))
    return out


def manifest_of(spark, rows):
    docs = spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA)
    tampered = {"text": F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"))).otherwise(F.col("text"))}
    got = merkle_rollup.manifest(docs, tampered=tampered)
    return [tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def without_lines(r):
    import zlib

    even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
    return r[4].replace("\n", "") if even and r[4] is not None else r[4]


def test_manifest_equals_a_plain_tree(spark):
    rows = [(k, f"s{k % 3}" if k % 5 else None, "en", k, f"line {k}\nnext") for k in range(61)]
    rows += [(None, None, None, None, None), (7, "s1", "en", 7, "again"), (7, "s1", "en", 7, "again"), (900, "lone", "de", 1, ""), (901, "Ü", None, None, "x\n" * 4000)]
    got = manifest_of(spark, rows)
    assert Counter(got) == Counter(plain_manifest(rows, without_lines))
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 28])
def test_manifest_of_few_rows(spark, n):
    rows = [(k, "a", "en", 1, f"t{k}") for k in range(n)]
    assert Counter(manifest_of(spark, rows)) == Counter(plain_manifest(rows, without_lines) if n else [])


def test_manifest_beyond_one_block(spark, monkeypatch):
    """Blocks of nine leaves: three tiers of a large source, and sources that end in the first or the second tier."""
    monkeypatch.setattr(merkle_rollup, "DIGITS", 2)
    monkeypatch.setattr(merkle_rollup, "BLOCK", 9)
    rows = [(k, "large" if k < 95 else "middle" if k < 115 else f"s{k % 11}", "en", 1, f"t{k}") for k in range(150)]
    assert Counter(manifest_of(spark, rows)) == Counter(plain_manifest(rows, without_lines))


def test_proofs_lead_to_the_root(spark):
    docs = spark.createDataFrame([(k, f"s{k % 4}", None, None, f"t{k}") for k in range(40)], "doc_id long, source string, lang string, n_chars int, text string")
    for r in merkle_rollup.manifest(docs).collect():
        now = r.leaf
        for step in r.proof:
            now = sha(step.left, now, step.right)
        assert now == r.root and r.verified


# -- hard negatives
def plain_negatives(rows, low=30, high=90, k=5, each=10):
    ok = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(c is None or not np.isfinite(c) for c in v):
            continue
        kept = (label, [int(np.floor(256 * c)) for c in v])
        ok[i] = min(ok.get(i, kept), kept)
    out = []
    for a in (i for i in ok if i % 100 == 0):
        score = {i: sum(x * y for x, y in zip(ok[a][1], ok[i][1])) for i in ok if i != a}  # noqa: B905
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if ok[i][0] == ok[a][0]][:k]:
            found = [i for i in order if ok[i][0] != ok[a][0] and low * score[p] <= 100 * score[i] <= high * score[p]][:each]
            out += [(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(found)]
    return out


def mined(spark, rows, block=None, **options):
    table = spark.createDataFrame([(*r, "z", 1) for r in rows], "vec_id long, embedding array<float>, label int, id string, block int")
    all_ = hard_negatives.quantised(table)
    return [tuple(r) for r in hard_negatives.mine(all_, all_.where("id % 100 = 0"), **options).collect()]


def embeddings(n, dims, seed, spread=1.0):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(4, dims))
    labels = rnd.integers(0, 4, n)
    return [(i, [float(np.float32(c)) for c in np.round((centres[k] + spread * rnd.normal(size=dims)) / 4, 2)], int(k)) for i, k in enumerate(labels)]


@pytest.mark.parametrize("dims, spread", [(2, 0.3), (8, 1.0)])
def test_negatives_equal_all_pairs(spark, monkeypatch, dims, spread):
    monkeypatch.setattr(hard_negatives, "ROWS", 60)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    ship_package(spark)
    rows = embeddings(700, dims, dims, spread)
    rows += [(701, None, 1), (702, [0.5] * dims, None), (703, [float("nan")] * dims, 1), (704, [None] * dims, 2), (800, [float("inf")] * dims, 1), (None, [0.5] * dims, 0)]
    rows += [(900, [0.0] * dims, 1), (1000, [0.1], 3), (1001, [], 3), rows[5], rows[100], (1100, [0.2] * dims, 77)]  # zeros, short, empty, repeated, a lone label
    want = plain_negatives(rows)
    got = mined(spark, rows)
    assert Counter(got) == Counter(want) and len(want) > 40


def test_negatives_of_few_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1)]) == []
    rows = [(0, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2), (3, [0.5], 2), (4, [0.95], 2), (5, [-1.0], 2)]
    assert sorted(mined(spark, rows)) == [(0, 1, 1, 2, 65536, 32768), (0, 1, 2, 3, 65536, 32768)]


def test_the_walk_ends_before_it_has_met_all():
    """A row far ahead of the others is found without scoring them all, and ties at the threshold are not lost."""
    rnd = np.random.default_rng(3)
    vectors = rnd.integers(-50, 50, (5000, 3))
    vectors[77] = 900
    block = hard_negatives.Block(np.arange(5000), vectors)
    scored = []
    block.vectors = type("Counted", (), {"__getitem__": lambda self, rows: scored.append(len(rows)) or vectors[rows]})()
    assert block.top(np.array([5, 5, 5]), [(-(1 << 62), 1 << 62)], 1) == [[(13500, 77)]]
    assert sum(scored) < 500
    tied = hard_negatives.Block(np.arange(4000)[::-1].copy(), np.full((4000, 3), 7))
    assert tied.top(np.array([1, 1, 0]), [(0, 100)], 3) == [[(14, 0), (14, 1), (14, 2)]]


# -- repeated spans
def plain_spans(texts, length=200):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone[:-1], strict=True) if not g)
        out.append((len(t), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def awkward_texts():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(300)]
    passages = [" ".join(rnd.choice(words) for _ in range(60)) for _ in range(5)]
    some = lambda n: " ".join(rnd.choice(words) for _ in range(n))

    def text():
        return " ñ ".join(rnd.choice(passages)[rnd.randint(0, 80) :] if rnd.random() < 0.4 else some(rnd.randint(1, 60)) for _ in range(rnd.randint(0, 6)))

    rows = [(k, text()) for k in range(120)]
    long = some(9000)  # longer than what is hashed at once
    rows += [(1000 + k, rows[5][1]) for k in range(5)] + [(7, rows[7][1]), (None, rows[6][1]), (None, None), (2003, ""), (2004, "y" * 199), (2005, "y" * 200), (2006, "y" * 200)]
    rows += [(2000, "x" * 3000), (2001, "ab" * 900 + "q"), (2002, ("0123456789" * 7 + "z") * 40), (2008, long), (2009, long[3000:40000] + " tail")]
    return rows


@pytest.mark.parametrize("many", [suffix_spans.MANY, 3])
def test_spans_equal_all_windows(spark, many):
    """With 3 as the most snippets of a gram in a block, nearly all grams are split."""
    ship_package(spark)
    rows = awkward_texts()
    docs = spark.createDataFrame([(i, t, "z", "z", "z") for i, t in rows], "doc_id long, text string, key string, data string, u1 string")
    want = Counter((i, *w) for (i, _), w in zip(rows, plain_spans([(t or "").encode() for _, t in rows]), strict=True))
    got = suffix_spans.remove_repeats(docs, many=many).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in got)


def test_spans_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_spans.remove_repeats(docs).count() == 0
    assert [tuple(r) for r in suffix_spans.remove_repeats(spark.createDataFrame([(1, None)], "doc_id long, text string"), texts_too=False).collect()] == [(1, 0, 0, 0, hashlib.sha256(b"").hexdigest())]


def test_expansion_gives_the_common_prefixes():
    """By increasing value, as far as the length; the order of suffixes by that many symbols."""
    rnd = np.random.default_rng(1)
    for symbols, n in [(2, 60), (3, 200), (60, 300), (1, 9)]:
        text = rnd.integers(0, symbols, n)
        order = suffix_spans.suffix_order(text, 12)
        turned = [tuple(np.roll(text, -p)[:12]) for p in order]
        assert turned == sorted(turned)
        common = [next((k for k, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), 12) for a, b in zip(turned, turned[1:], strict=False)]
        assert suffix_spans.shared_prefixes(text, order, 12).tolist() == [-1, *common]


def test_block_counts_every_occurrence():
    rnd = random.Random(1)
    for _ in range(60):
        length = rnd.choice([3, 5, 8])
        parts = [np.frombuffer(bytes(rnd.choice(b"ab") if rnd.random() < 0.9 else rnd.randrange(256) for _ in range(rnd.randint(length, 20))), "u1") for _ in range(rnd.randint(1, 8))]
        counts = np.array([rnd.choice([1, 1, 1, 2]) for _ in parts])
        seen = Counter()
        for p, c in zip(parts, counts, strict=True):
            for i in range(len(p) - length + 1):
                seen[p[i : i + length].tobytes()] += int(c)
        want = [[i for i in range(len(p) - length + 1) if seen[p[i : i + length].tobytes()] > 1] for p in parts]
        assert [g.tolist() for g in suffix_spans.repeated_in_block(parts, counts, length)] == want
