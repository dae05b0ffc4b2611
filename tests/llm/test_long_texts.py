"""One text of 20 MB among short ones, through each operator on texts, and what goes in blocks against what goes whole."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spoolsight.llm import budget_mix, byte_bpe, chunk_recipes, langid_crf, png_media, prefix_counts, record_files, simhash_links, tree_bpe
from spoolsight.session import ship_package

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(20)
    vocabulary = ["".join(rnd.choice("etaoinshrdlucmfw") for _ in range(rnd.randint(1, 9))) for _ in range(5000)]
    long = " ".join(rnd.choice(vocabulary) for _ in range(3_300_000))[: 20 << 20]
    ship_package(spark)
    return spark.createDataFrame([(1, "the short one", "en", "a"), (2, long, "en", "a"), (3, None, None, None)], "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="module")
def long(docs):
    return docs.where("doc_id = 2").first().text


def of(df, doc_id=2):
    return df.where(F.col("doc_id") == doc_id).first()


def test_language(docs):
    model = langid_crf.train([("the and of it is a word", "en"), ("der die das und ist ein", "de")])
    found = of(langid_crf.predict(docs, model))
    assert found.lang_pred in ("en", "de") and 0 < found.score <= 1


def test_recipe(docs, long):
    found = of(chunk_recipes.exact_duplicates(docs))
    assert found.kept and found.text_sha256 == hashlib.sha256(long.encode()).hexdigest()


def test_tokens(docs, long):
    ids = np.array(Tokenizer.from_file(PATH).encode(long, add_special_tokens=False).ids, "<u4")
    assert of(prefix_counts.prefix_counts(docs, PATH).select("doc_id", "n_tokens")).n_tokens == len(ids)
    found = of(record_files.digests(record_files.write_records(docs, PATH)))
    assert (found.n_tokens, found.ids_crc32) == (len(ids) + 1, zlib.crc32(np.append(ids, 0).astype("<u4").tobytes()))
    found = of(tree_bpe.digests(tree_bpe.encode_decode(docs, PATH)))
    assert found.n_tokens == len(ids) and found.decoded_sha256 == hashlib.sha256(long.encode()).hexdigest()


def test_media(docs, long):
    raw = long.encode() + bytes(-len(long) % 64)
    found = of(png_media.from_media(png_media.to_media(docs), payloads=False))
    assert found.payload_bytes == len(raw) and found.payload_sha256 == hashlib.sha256(raw).hexdigest() and len(found.feature) == 8


def test_sizes_and_fingerprint(docs, long):
    assert of(budget_mix.mix(docs)).size == len(long.split())
    found = of(simhash_links.fingerprints(docs))
    assert found.fp & (1 << 64) - 1 == simhash_links.long_fingerprint(long)


def test_blocks_equal_wholes(monkeypatch):
    rnd = random.Random(4)
    for n in (0, 1, 2, 3, 50, 5000):
        text = " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(n))
        whole = simhash_links.fingerprint_words(text)
        monkeypatch.setattr(simhash_links, "SHINGLES_AT_ONCE", 7)
        assert simhash_links.long_fingerprint(text) == int(simhash_links.majority_bits(np.array(whole, "u8"), np.array([len(whole)]))[0])
        monkeypatch.undo()
    samples = np.frombuffer(bytes(rnd.choice(b"abc ") for _ in range(64 * 333)), "u1").reshape(-1, 64)
    png, feature = png_media.encode_png(samples), png_media.low_frequency_hash(samples)
    monkeypatch.setattr(png_media, "ROWS_AT_ONCE", 10)
    assert png_media.encode_png(samples) == png and png_media.low_frequency_hash(samples) == feature
    source = open(PATH, encoding="utf-8").read()
    counter = prefix_counts.PrefixCounter(byte_bpe.ByteBpe(source), source)
    piece = bytes(rnd.choice(b"thesinger") for _ in range(3000))
    count = counter._alone(piece)
    monkeypatch.setattr(prefix_counts, "BLOCK", 37)
    assert (counter._alone(piece) == count).all() and count[-1] == len(Tokenizer.from_file(PATH).encode(piece.decode(), add_special_tokens=False).ids)
