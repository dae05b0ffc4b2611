"""The ten operators on small awkward tables, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spoolsight.llm import block_html, budget_mix, byte_bpe, chunk_recipes, graph, langid_crf, png_media, prefix_counts, record_files, rows, simhash_links, tree_bpe, url_rules
from spoolsight.session import ship_package

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
# columns named like those that operators make
SCHEMA = "doc_id long, text string, lang string, source string, n_tokens string, fp string, row string, recipe int, kept string, key string, h string, size string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


def awkward(spark, more=()):
    """Nulls in every column, empty, blank, wordless and long texts, repeated rows, repeated ids."""
    ship_package(spark)
    words = "the and of thing that with some longerword tion Größe ñandú".split()
    rnd = random.Random(5)
    long = " ".join(rnd.choice(words) for _ in range(6000))
    base = [(1, "Hello  world\tagain", "en"), (2, "Hello world again", "en"), (3, None, None), (4, "", "en"), (5, "   \n ", None), (6, long, "en"), (7, long, "de"), (7, long, "de"), (8, "x" * 5000, None), (9, "123 !!", "en"), (None, "Hello world again", None), (None, None, None),
            (10, "<|endoftext|> and <|endof it's we've  two   spaces \U0001f600", "en"), (11, long + " end", "en"), (12, "日本語のテキスト", "ja")]
    return spark.createDataFrame([(i, t, lang, f"s{(i or 0) % 3}" if (i or 0) % 4 else None, *["z"] * 3, 1, *["z"] * 4) for i, t, lang in [*base, *more]], SCHEMA)


def empty(spark):
    return awkward(spark).where("false")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def same(got, want):
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))


# -- 1
def test_language_of_held_out_and_awkward_texts(spark):
    rnd = random.Random(1)
    vocab = {"en": "the and of that with thing er tion".split(), "es": "el de que ción los ado para ñu".split(), "de": "der und die ung sch keit zu für".split()}
    make = lambda lang, n: " ".join(rnd.choice(vocab[lang]) + rnd.choice(["", rnd.choice(vocab[lang])]) for _ in range(n))
    data = [(k, make(lang, rnd.randint(3, 60)), lang) for k, lang in enumerate(sorted(vocab) * 60)]
    ship_package(spark)
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid_crf.fit(docs.where("doc_id < 120"), sample_per_language=40)
    got = {r.doc_id: r for r in langid_crf.predict(docs, model).collect()}
    held = [(k, lang) for k, _, lang in data if k >= 120]
    assert np.mean([got[k].lang_pred == lang for k, lang in held]) >= 0.95 and all(0 <= r.score <= 1 for r in got.values())
    odd = {(r.doc_id, r.lang_pred, r.score) for r in langid_crf.predict(awkward(spark), model).where("doc_id in (3, 4, 5, 9)").collect()}
    assert odd == {(k, "und", 0.0) for k in (3, 4, 5, 9)}
    assert langid_crf.predict(empty(spark), model).count() == 0
    mixed = spark.createDataFrame([(1, "the and of that el de que ción los para der und die für")], "doc_id long, text string")
    words = langid_crf.predict(mixed, model, words=True).first().word_langs
    assert [w.lang for w in words] == ["en"] * 4 + ["es"] * 6 + ["de"] * 4
    kept = langid_crf.keep_identified(awkward(spark), model, min_familiar=0.0)
    assert kept.columns == awkward(spark).columns and not {r.doc_id for r in kept.collect()} & {3, 4, 5, 9}
    told = spark.createDataFrame([(1, data[0][1], None), (2, data[61][1], "de"), (3, "Все люди рождаются свободными и равными", "en"), (4, "zzyq xwvk qqjx vvkz", "es"), (5, None, None)], "doc_id long, text string, lang string")
    assert {(r.doc_id, r.lang) for r in langid_crf.keep_identified(told, model, lang_col="lang").collect()} == {(1, data[0][2]), (2, "de")}
    assert {r.doc_id for r in langid_crf.keep_identified(told, model, languages=[data[61][2]]).collect()} == {2}
    nothing = langid_crf.fit(empty(spark))
    assert {r.lang_pred for r in langid_crf.predict(docs, nothing).collect()} == {"und"}


def test_forward_backward_is_exact_across_blocks(monkeypatch):
    monkeypatch.setattr(langid_crf, "BLOCK", 4)
    rng = np.random.default_rng(0)
    emissions, trans = rng.random((9, 3)) + 0.05, rng.normal(size=(3, 3))
    lengths = np.array([1, 13, 4, 9, 23])
    ids = rng.integers(0, 9, int(lengths.sum()))
    got = langid_crf.marginals(emissions, ids, lengths, trans)
    at = 0
    for n in lengths:
        e, f = emissions[ids[at : at + n]], np.exp(trans)
        a, b = np.zeros((n, 3)), np.ones((n, 3))
        for t in range(n):
            a[t] = ((np.ones(3) if t == 0 else a[t - 1]) @ f) * e[t]
        for t in range(n - 2, -1, -1):
            b[t] = f @ (e[t + 1] * b[t + 1])
        want = a * b / (a * b).sum(axis=1, keepdims=True)
        assert np.allclose(got[at : at + n], want)
        at += n


# -- 2
@pytest.mark.parametrize("bits", [64, 3])
def test_exact_duplicates(spark, bits):
    docs = awkward(spark, [(20, "a b " * 100 + "x", None), (21, "a b " * 100 + "y", None), (22, "a  b " * 100 + "x", None)])
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in texts(docs):
        groups[norm(t)].append(i)
    got = chunk_recipes.exact_duplicates(docs, key_bits=bits).collect()
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    same([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], [(i, least(ids), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids])
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
    left = chunk_recipes.drop_duplicates(docs)
    assert left.columns == docs.columns and sorted(norm(t) for _, t in texts(left)) == sorted(groups)
    assert chunk_recipes.exact_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz ", "абвгдежзийклмнопрстуфхцчшщыэюя ", "あいうえおかきくけこさしすせそたちつてとなにぬねのをん。", "的一是不了人我在有他这为之大来以个中上们国说到时要就出会可也你对生能而子那得于"])
def test_chunks_after_an_insertion(spark, letters):
    """In every script most chunks come back after text is put in before them."""
    rnd = random.Random(2)
    text = "".join(rnd.choice(letters) for _ in range(20_000))
    rows_ = spark.createDataFrame([(1, text), (2, "xyzzy" + text), (3, text[:1000] + "!" + text[1000:])], "n int, text string")
    cut = {r.n: r.chunks for r in rows_.select("n", chunk_recipes.chunks_of(F.col("text")).alias("chunks")).collect()}
    assert all("".join(c).encode("latin-1").decode() == r.text for r in rows_.collect() for c in [cut[r.n]])
    sizes = sorted(map(len, cut[1]))
    assert 64 <= sizes[1] and sizes[len(sizes) // 2] < 300 and sizes[-1] <= 2048
    for n in (2, 3):
        assert len(set(cut[1]) & set(cut[n])) > 0.95 * len(set(cut[1]))


def test_collisions_move_only_their_documents(spark):
    """Where one key stands for several chunks, ordinals come for the texts that hold these chunks alone."""
    docs = spark.createDataFrame([(k, f"{k} " * 400) for k in range(60)], "doc_id long, text string").select(chunk_recipes.normalised(F.col("text")).alias("text"))
    odd = lambda c: c.startswith("7 ") | c.startswith("8 ")
    keyed = lambda c: F.when(odd(c), F.lit(5)).otherwise(F.xxhash64(c))
    chunks = chunk_recipes.chunks_of(F.col("text"))
    got = {r.text_sha256: r.ordinals for r in chunk_recipes._ordinals(docs, chunks, keyed, spark.createDataFrame([(5,)], "key long")).collect()}
    held = {r.digest: r.found for r in docs.select(F.sha2("text", 256).alias("digest"), F.filter(chunks, odd).alias("found")).collect()}
    number = {c: n for n, c in enumerate(sorted({c for found in held.values() for c in found}), 1)}
    assert got == {d: [number[c] for c in found] for d, found in held.items() if found} and 2 <= len(got) < 60


# -- 3
def test_record_files(spark, library, tmp_path):
    docs = awkward(spark)
    index = record_files.write_records(docs, TOKENIZER, folder=f"file://{tmp_path}/rec")
    ids_of = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 0]
    ordered = sorted(texts(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, want = 0, []
    for i, t in ordered:
        ids = ids_of(t)
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    same([(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in record_files.digests(index).collect()], want)
    shuffled = record_files.read_records(index.orderBy(F.rand(3))).collect()
    same([(r.doc_id, tuple(r.ids)) for r in shuffled], [(i, tuple(ids_of(t))) for i, t in ordered])
    assert record_files.digests(record_files.write_records(empty(spark), TOKENIZER)).count() == 0
    record = bytearray(record_files.frame(b"abcd"))
    assert bytes(record_files.unframe(memoryview(record))) == b"abcd"
    for k in range(len(record)):
        broken = record.copy()
        broken[k] ^= 1
        with pytest.raises(ValueError):
            record_files.unframe(memoryview(bytes(broken)))


# -- 4
def test_png_round_trip_and_features(spark):
    docs = awkward(spark)
    got = png_media.from_media(png_media.to_media(docs)).collect()
    want = []
    for i, t in texts(docs):
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        want.append((i, len(raw), payload, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    same([(r.doc_id, r.n_bytes, bytes(r.payload), r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got], want)
    assert all(len(r.feature) == 8 for r in got)
    by_text = defaultdict(set)
    for r in got:
        by_text[r.payload_sha256].add((bytes(r.media), bytes(r.feature)))
    assert {len(v) for v in by_text.values()} == {1}
    assert png_media.from_media(png_media.to_media(empty(spark))).count() == 0


def naive_unfilter(filters, rows_):
    out = np.zeros_like(rows_)
    for y in range(len(rows_)):
        for x in range(rows_.shape[1]):
            a, b, c = int(out[y, x - 1]) if x else 0, int(out[y - 1, x]) if y else 0, int(out[y - 1, x - 1]) if x and y else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out[y, x] = (int(rows_[y, x]) + [0, a, b, (a + b) // 2, near][filters[y]]) & 255
    return out


def test_png_filters_and_damage():
    rng = np.random.default_rng(2)
    for _ in range(60):
        h = int(rng.integers(1, 12))
        filters, rows_ = rng.integers(0, 5, h).astype("u1"), rng.integers(0, 256, (h, 7)).astype("u1")
        assert (png_media.unfilter(filters, rows_) == naive_unfilter(filters, rows_)).all()
    image = rng.integers(0, 256, (5, 64)).astype("u1")
    data = png_media.encode_png(image)
    for k in rng.integers(0, len(data), 60):
        broken = bytearray(data)
        broken[k] ^= 4
        with pytest.raises(ValueError):
            png_media.decode_png(bytes(broken))
    small = png_media.low_frequency_hash(np.tile(np.arange(64, dtype="u1"), (100, 1)))
    assert small == png_media.low_frequency_hash(np.tile(np.arange(64, dtype="u1"), (300, 1)))  # height is averaged out


# -- 5
def test_encode_and_decode(spark, library):
    docs = awkward(spark)
    got = tree_bpe.encode_decode(docs, TOKENIZER).collect()
    want = []
    for i, t in texts(docs):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, tuple(ids), library.decode(ids, skip_special_tokens=False)))
    same([(r.doc_id, tuple(r.ids), r.decoded) for r in got], want)
    assert tree_bpe.encode_decode(empty(spark), TOKENIZER).count() == 0


@pytest.mark.parametrize("leaf", [1, 3, 16])
def test_tree_concatenation_equals_library(library, leaf):
    bpe = byte_bpe.ByteBpe(open(TOKENIZER, encoding="utf-8").read(), leaf)
    rnd = random.Random(leaf)
    parts = ["the", "ing", "a", "aa", "é", "日本", "=", "==", "x", "tion", "_", "1", " ", "  ", "\n", "'ve", "'", "<|endoftext|>", "<|endof", " ", "²", "\x1f", "😀"]
    for _ in range(400):
        s = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 50)))
        assert np.frombuffer(bpe.ids_of([s])[0], "<u4").tolist() == library.encode(s, add_special_tokens=False).ids
    for s in ("a" * 3000, "=" * 777, "日本語" * 300, "".join(rnd.choice("thesing") for _ in range(5000))):
        assert np.frombuffer(bpe.ids_of([s])[0], "<u4").tolist() == library.encode(s, add_special_tokens=False).ids


def test_common_characters_split_as_the_library_splits(library):
    for c in range(0x110000):
        ch = chr(c)
        if not 0xD800 <= c < 0xE000 and not byte_bpe.UNUSUAL.match(ch):
            s = f"a{ch}b1{ch}2!{ch}! {ch} {ch}a"
            assert byte_bpe.SPLIT.findall(s) == [s[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(s)], hex(c)


# -- 6
def fair_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + ([None] if None in sizes else [])
    w = {n: weights[k % 3] for k, n in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[n] for n in free)
        over = [n for n in free if level * w[n] > most * sizes[n]]
        if not over:
            return out | {n: level * w[n] for n in free}
        for n in over:
            out[n] = most * sizes[n]
            left -= out[n]
            free.discard(n)
    return out


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(budget_mix, "RANKED_AT_ONCE", 5)
    rnd = random.Random(4)
    docs = awkward(spark, [(100 + k, " ".join(["w"] * rnd.randint(0, 6)), None) for k in range(300)])
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = {(r.doc_id, r.text): r.source for r in docs.collect()}
    total = Counter()
    for key in texts(docs):
        total[sources[key]] += size(key[1])
    want = fair_targets(total)
    runs = [sorted(map(tuple, budget_mix.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source").collect()), key=str) for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == docs.count()
    taken = Counter()
    for _, n, source_size, target, took, source in runs[0]:
        assert source_size == total[source] and abs(target - want[source]) < 1e-6 and 0 <= took <= 2 * n and (not n or took % n == 0)
        taken[source] += took
    assert all(abs(taken[s] - want[s]) <= 3 for s in want)
    mixed = budget_mix.apply_mix(docs)
    assert mixed.columns == docs.columns and Counter(r.source for r in mixed.collect() for _ in range(size(r.text))) == taken
    assert budget_mix.mix(empty(spark)).count() == 0
    zero = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {(r.target, r.taken) for r in budget_mix.mix(zero).collect()} == {(0.0, 0)}


def nearest(lengths, counts, budget):
    """Distance of the nearest sum there is."""
    sums = 1
    for n, c in zip(lengths, counts):
        for _ in range(c):
            sums |= sums << n
    return next(d for d in range(budget + max(lengths) + 1) if sums >> (budget + d) & 1 or budget >= d and sums >> (budget - d) & 1)


def miss(lengths, counts, budget, **options):
    took = budget_mix.fit(lengths, counts, budget, **options)
    assert len(took) == len(lengths) and all(0 <= t <= c for t, c in zip(took, counts))
    return abs(sum(n * t for n, t in zip(lengths, took)) - budget)


def test_subset_sum_fit():
    rnd = random.Random(3)
    for _ in range(300):
        lengths = rnd.sample(range(1, 60), rnd.randint(1, 7))
        counts = [rnd.randint(1, 5) for _ in lengths]
        budget = rnd.randint(0, sum(n * c for n, c in zip(lengths, counts)))
        assert miss(lengths, counts, budget, least=rnd.choice([1, 10, 1 << 15])) == nearest(lengths, counts, budget)
    assert miss(list(range(1, 3000)), [7] * 2999, 1_234_567) == 0


def test_subset_sum_has_no_bound_where_it_gives_way():
    """Few long documents, on both sides of the reserve and of an eighth of the budget; sums far beyond them."""
    assert miss([860, 1334, 6595, 7528], [1, 1, 5, 6], 33_851) == nearest([860, 1334, 6595, 7528], [1, 1, 5, 6], 33_851) == 16
    rnd = random.Random(9)
    bounds = [budget_mix.RESERVE, 8 * budget_mix.RESERVE]
    for k in range(60):
        lengths = rnd.sample(range(300, 20_000), rnd.randint(2, 6))
        counts = [rnd.randint(1, 6) for _ in lengths]
        whole = sum(n * c for n, c in zip(lengths, counts))
        budget = min(whole, max(0, bounds[k % 2] + rnd.randint(-40, 40))) if k % 3 else rnd.randint(0, whole)
        assert miss(lengths, counts, budget) == nearest(lengths, counts, budget)
    for size in (10**5, 10**6, 10**7):  # many documents of some lengths: within the shortest of them
        lengths = sorted(rnd.sample(range(50, 20_000), 40))
        counts = [1 + 2 * size // (40 * n) for n in lengths]
        budget = rnd.randint(size // 2, size)
        assert miss(lengths, counts, budget) <= lengths[0]
    assert miss([10, 30, 500], [900, 900, 900], 123_456) == 4 and miss([7], [10**6], 3_500_003) == 3


# -- 7
def brute_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(fps))]


def test_fingerprints_and_components(spark):
    rnd = random.Random(8)
    long = [rnd.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rnd.randint(0, 99)) for _ in range(2000)]
    near = [" ".join([*long[:k], "changed", *long[k + 1 :]]) for k in (3, 500, 1200)]
    docs = awkward(spark, [(50, " ".join(long), None), *((51 + k, t, None) for k, t in enumerate(near)), (60, "ONE two", None), (61, "one TWO", None), (62, "Ä b", None), (63, "ä b", None)])
    lower = str.maketrans({c: c + 32 for c in range(65, 91)})
    pairs = texts(docs)
    fps = []
    for _, t in pairs:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    roots = brute_components(fps)
    least = defaultdict(list)
    for (i, _), r in zip(pairs, roots):
        least[r].append(i)
    got = simhash_links.near_duplicates(docs).collect()
    same([(r.doc_id, r.fingerprint, r.component_id) for r in got], [(i, f"{f:016x}", min((x for x in least[r] if x is not None), default=None)) for (i, _), f, r in zip(pairs, fps, roots)])
    kept = simhash_links.keep_one_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(least)
    assert simhash_links.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("dense", [32, 4])
def test_links_of_dense_cells(spark, monkeypatch, dense):
    """Many fingerprints in one ball, zero and all ones, and chains; on both ways of working off a cell."""
    monkeypatch.setattr(simhash_links, "DENSE", dense)
    rnd = random.Random(dense)
    centre = rnd.getrandbits(64)
    fps = {0, (1 << 64) - 1, 1, 1 << 63, centre} | {centre ^ 1 << a ^ 1 << b for a in range(0, 64, 3) for b in range(0, 64, 7)} | {rnd.getrandbits(64) for _ in range(200)}
    chain = rnd.getrandbits(64)
    for k in range(0, 40, 2):
        chain ^= 3 << k
        fps.add(chain)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = graph.components(simhash_links.links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()
    root = {r.node: r.root for r in found}
    got, want = defaultdict(set), defaultdict(set)
    for f, s, r in zip(fps, signed, brute_components(fps)):
        want[r].add(s)
        got[root.get(s, s)].add(s)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_awkward_graphs(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, x) for x in range(101, 130)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)} | {200: 200, 201: 200}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


# -- 8
def test_prefix_counts(spark, library):
    docs = awkward(spark)
    got = prefix_counts.prefix_counts(docs, TOKENIZER)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    same([(r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()], [(i, len((t or "").encode()), count(t or "")) for i, t in texts(docs)])
    row = got.where("doc_id = 10").withColumns({f"b{b}": prefix_counts.longest_prefix(F.col("steps"), b) for b in (0, 1, 4, 999)}).first()
    text = dict(texts(docs.where("doc_id = 10")))[10]
    counts = [count(text[:k]) for k in range(len(text) + 1)]
    assert np.cumsum(np.frombuffer(row.steps, "i1")).tolist() == counts[1:]
    assert [row[f"b{b}"] for b in (0, 1, 4, 999)] == [max(k for k, n in enumerate(counts) if n <= b) for b in (0, 1, 4, 999)]
    assert prefix_counts.prefix_counts(empty(spark), TOKENIZER).count() == 0


def test_every_prefix_of_random_texts(library):
    source = open(TOKENIZER, encoding="utf-8").read()
    counter = prefix_counts.PrefixCounter(byte_bpe.ByteBpe(source), source)
    rnd = random.Random(9)
    parts = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "é", "ß", "日本", "😀", "'s", "'ve", "'", "v", "<|endoftext|>", "<|endof", "!", "...", "===", "1", "23", "_", " ", "²", "\x1f", "tion", "é"]
    for _ in range(250):
        s = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 20)))
        want = [len(library.encode(s[:k], add_special_tokens=False).ids) for k in range(1, len(s) + 1)]
        assert np.cumsum(np.frombuffer(counter.steps([s])[0], "i1")).tolist() == want, s
    long = "".join(rnd.choice("thesing") for _ in range(3000))
    assert int(np.frombuffer(counter.steps([long])[0], "i1").sum(dtype="i8")) == len(library.encode(long, add_special_tokens=False).ids)


# -- 9
PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><p>Site header that says the name of the site and of the owner</p></header><nav><ul><li><a href=x>Home</a></li></ul></nav>
<div class="cookie-notice"><p>We use the cookies of the site and of the others for you, as it is said in the terms.</p></div>
<article><h1>The title</h1><p><b>First&nbsp;paragraph</b> of   the text &amp; more, <a href=y>with a link</a><br>and a break.<p>Short.</p><!-- ad -->
<div class="ad"><p>Buy the thing that is in the shop of the town, and all of it for you.</p></div><form><p>Sign up for the news of the day and of the week</p></form><p>Last &lt;one&gt;</p></article>
<aside><p>The other stories of the site that are read by the most of you</p></aside><div id="comments"><p>I like the text of the page and what it says of the man.</p></div><footer>&copy; 2024</footer></body></html>"""


def test_main_text(spark):
    want = "The title\nFirst paragraph of the text & more, with a link and a break.\nShort.\nLast <one>"
    plain = "<div><p>It was the best of the times and it was the worst of the times, as it is said in the book.</p><p>Yes.</p></div><div><a href=1>One</a> <a href=2>Two</a></div>"
    long = "<article>" + "<p>the word of it</p>" * 5000 + "</article>"
    ship_package(spark)
    data = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", plain), (5, "u", "no markup at all"), (6, "u", long), (6, "u", long), (7, "u", "<p title='a>b' <broken"), (8, "u", "<script>x")]
    pages = spark.createDataFrame([(*r, "z", "z") for r in data], "page_id long, url string, html string, text string, n_chars string")
    got = block_html.extract(pages).collect()
    found = {r.page_id: r.text for r in got}
    assert len(got) == len(data) and all(r.n_chars == len(r.text) for r in got)
    assert found[1] == want and found[2] == "" and found[3] == "" and found[8] == ""
    assert found[None].split("\n")[1] == "Yes." and "One" not in found[None] and found[5] == "no markup at all"
    assert found[6].count("\n") == 4999
    assert block_html.extract(pages.where("false")).count() == 0


# -- 10
RULES = [url_rules.Rule("allow", "com", "/"), url_rules.Rule("block", "example.com", "/en/"), url_rules.Rule("allow", "www.example.com", "/en/"), url_rules.Rule("block", "net", "/es/")]


def brute_mine(labelled, min_support, min_confidence):
    """All antecedents by enumeration."""
    from itertools import combinations

    whole = Counter()
    joint = Counter()
    for toks, label in labelled:
        for n in range(1, len(toks) + 1):
            for s in combinations(sorted(toks), n):
                whole[s] += 1
                joint[s, label] += 1
    least = min_support * len(labelled)
    rules = {(s, label): n / whole[s] for (s, label), n in joint.items() if n >= least and n / whole[s] >= min_confidence}
    return {k: c for k, c in rules.items() if not any(label == k[1] and set(s) < set(k[0]) and other >= c for (s, label), other in rules.items())}


def test_url_rules(spark):
    ship_package(spark)
    urls = ["http://WWW.Example.COM/en/1?q=/x#y", "https://example.com/en/2", "https://a.b.example.com/en/", "http://x.net/es/p", "http://x.net/fr/p", "http://x.org/es/p", "nothing", None, "", "://net/es/", "http://example.com", "ftp://notnet/es/1", "http://a.com?x=://b.net/es/", "http://x.net/es"]
    pages = spark.createDataFrame([(k, u, "z", "z") for k, u in enumerate([*urls, urls[0], urls[3]])], "page_id long, url string, host string, verdict string")
    got = {r.page_id: r for r in url_rules.judge(pages, RULES).collect()}
    assert len(got) == 16
    want = {0: ("www.example.com", "/en/1", "www.example.com/en/", "allow"), 1: ("example.com", "/en/2", "example.com/en/", "block"), 2: ("a.b.example.com", "/en/", "example.com/en/", "block"), 3: ("x.net", "/es/p", "net/es/", "block"), 9: ("net", "/es/", "net/es/", "block"), 12: ("a.com", "", None, None), 10: ("example.com", "", None, None), 11: ("notnet", "/es/1", None, None), 13: ("x.net", "/es", None, None)}
    for k, (host, path, rule, verdict) in want.items():
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule) and (verdict is None or got[k].verdict == verdict)
    assert all((got[k].host, got[k].path, got[k].rule, got[k].verdict) == ("", "", None, "allow") for k in (6, 7, 8))
    assert url_rules.judge(pages.where("false"), RULES).count() == 0


def test_mined_rules_equal_enumeration(spark):
    ship_package(spark)
    rnd = random.Random(6)
    data = []
    for _ in range(120):
        toks = frozenset(rnd.sample("abcdef", rnd.randint(1, 4)))
        data.append((toks, "block" if {"a", "b"} <= toks or rnd.random() < 0.1 else "allow"))
    frame = spark.createDataFrame([(sorted(t), label) for t, label in data], "tokens array<string>, label string")
    mined = url_rules.mine(frame, 0.03, 0.7)
    want = brute_mine(data, 0.03, 0.7)
    assert {(tuple(sorted(w)), label): round(c, 9) for w, label, c, _ in mined} == {k: round(c, 9) for k, c in want.items()}
    rows_ = [(sorted(t),) for t, _ in data] + [([],), (["z"],)]
    got = [r.v for r in spark.createDataFrame(rows_, "tokens array<string>").select(url_rules.matched(mined, F.col("tokens"), "default").alias("v")).collect()]
    first = lambda t: next((label for w, label, *_ in mined if w <= set(t)), "default")
    assert got == [first(t) for (t,) in rows_]


def test_mined_rules_beyond_the_listed_ones(spark):
    """A token that goes with a label on many hosts is learnt; what a listed rule says of itself is not."""
    ship_package(spark)
    rnd = random.Random(10)
    urls = [f"http://h{k % 40}.{rnd.choice(['net', 'org'])}/{rnd.choice(['es', 'fr', 'de'])}/{rnd.choice(['promo', 'news'])}-{k}" for k in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    told = spark.createDataFrame([(u, "block" if "promo" in u else "allow") for u in urls], "url string, label string")
    for local in (20_000, 0):
        got = {r.page_id: r for r in url_rules.judge(pages, RULES, told, local_rules=local).collect()}
        assert len(got) == 400
        for k, u in enumerate(urls):
            assert got[k].verdict == ("block" if "promo" in u or got[k].rule else "allow"), u
        plain = {r.page_id: r for r in url_rules.judge(pages, RULES, local_rules=local).collect()}
        assert all(r.verdict == "allow" for r in plain.values() if not r.rule) and any(r.rule == "net/es/" for r in plain.values())
    found = {r.label: (r.said, r.right) for r in url_rules.held_out_precision(pages, RULES, told).collect()}
    assert found["block"][0] > 20 and found["block"][1] >= 0.9 * found["block"][0]
    assert not url_rules.held_out_precision(pages.where("false"), RULES).collect()


# -- rows
def test_repeat_rows(spark):
    docs = spark.createDataFrame([(1, "a", 5), (1, "a", 5), (None, "b", 6), (2, None, 7), (3, "c", 8)], "doc_id long, text string, _k0 int")
    told = spark.createDataFrame([(1, "a", 3), (None, "b", 1), (2, None, 2), (3, "c", 0)], "a long, b string, n int")
    got = rows.repeat_rows(docs, [F.col("doc_id"), F.col("text")], told)
    assert got.columns == docs.columns
    same([tuple(r) for r in got.collect()], [(1, "a", 5)] * 3 + [(None, "b", 6)] + [(2, None, 7)] * 2)
