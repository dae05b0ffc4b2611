"""SimHash near-duplicates: fingerprints linked through a grid over their segments' bit counts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoolsight.llm.graph import components
from spoolsight.llm.resident import release
from spoolsight.llm.rows import repeat_rows
from spoolsight.shared import written

WORD = rb"[^\x20\x09-\x0D]+"
SHINGLE = 3
SEED = 42
SEGMENTS = 16
DENSE = 32
SHINGLES_AT_ONCE, LONG_TEXT = 100_000, 1 << 20


def fingerprint_words(text: str | None, shingle: int = SHINGLE) -> list[int]:
    """Unsigned XXH64 of every shingle of a text, repeats included; A-Z lower-cased."""
    words = re.findall(WORD, (text or "").encode().lower())
    if not words:
        return []
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    h = xxhash.xxh64_intdigest
    return [h(b" ".join(s), SEED) for s in zip(*(words[k:] for k in range(shingle)))]


def long_fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Fingerprint of one text, of which only some words are held at a time."""
    words = (m[0] for m in re.finditer(WORD, text.encode().lower()))
    counts, total, held = np.zeros(64, "i8"), 0, list(islice(words, shingle - 1))
    while more := list(islice(words, SHINGLES_AT_ONCE)):
        held += more
        hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(held[k:] for k in range(shingle)))), "u8", len(more))
        counts += np.unpackbits(hashes.astype("<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
        total += len(more)
        held = held[len(more) :]
    if not total:  # fewer words than a shingle has
        return int(majority_bits(np.array(fingerprint_words(text, shingle), "u8"), np.array([1]))[0]) if held else 0
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def majority_bits(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each run of ``hashes`` the 64-bit number of the bits set in over half of them; 0 for an empty run."""
    out = np.zeros(len(lengths), "u8")
    some = np.flatnonzero(lengths)
    if len(some):
        bits = np.unpackbits(hashes.astype("<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little")
        starts = np.cumsum(lengths[some]) - lengths[some]
        counts = np.add.reduceat(bits, starts, axis=0, dtype="i4")
        over = (2 * counts > lengths[some][:, None]).astype("u1")
        out[some] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``key`` (a hash of the text) and ``fp`` (64 bits as a long), of whole texts. Null and wordless texts have
    fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            fps: list[np.ndarray] = []
            held: list[list[int]] = []
            size = 0
            texts = batch.column(1)
            for k in range(batch.num_rows):
                text = texts[k].as_py()
                long = text is not None and len(text) > LONG_TEXT
                if not long:
                    held.append(fingerprint_words(text))
                    size += len(held[-1])
                if held and (long or size > SHINGLES_AT_ONCE or k == batch.num_rows - 1):
                    flat = np.fromiter((h for hs in held for h in hs), "u8", size)
                    fps.append(majority_bits(flat, np.array([len(hs) for hs in held])))
                    held, size = [], 0
                if long:
                    fps.append(np.array([long_fingerprint(text)], "u8"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.concatenate(fps).view("i8") if fps else np.zeros(0, "i8"))], names=["doc_id", "key", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, key long, fp long")


def segment_counts(fp: Column) -> Column:
    """Set bits in each of the 16 segments of 4 bits, packed as 16 numbers of 4 bits."""
    ones = F.lit(0x1111111111111111)
    return sum((F.shiftrightunsigned(fp, k).bitwiseAND(ones) for k in range(1, 4)), fp.bitwiseAND(ones))


def cells(fp: Column) -> Column:
    """Grid points at Manhattan distance 1 or less from a fingerprint's segment counts.

    Two points at distance 2 or less have such a grid point in common, and the Manhattan distance of segment counts is
    never more than the number of differing bits.
    """
    point = segment_counts(fp)
    steps = []
    for k in range(SEGMENTS):
        here = F.shiftrightunsigned(point, 4 * k).bitwiseAND(F.lit(15))
        unit = F.lit(1 << (4 * k))
        steps += [F.when(here < 4, point + unit), F.when(here > 0, point - unit)]
    return F.array_compact(F.array(point, *steps))


def links(fps: DataFrame) -> DataFrame:
    """Links ``u``, ``v`` that connect exactly what fingerprints at 2 or fewer differing bits connect.

    ``fps``: distinct values in ``fp``. Grid range join: every fingerprint goes to the cells around its segment counts.
    A cell of two gives one candidate pair. A cell of up to 32 is gathered and its pairs are tested inside the row. Of a
    denser cell no pairs are made: its members meet again on the finest grid, where each segment is one bit and the
    Manhattan distance is the number of differing bits, and each meeting is linked as a star. Everything is verified by
    the exact bit count, or on the finest grid follows from it.
    """
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= 2
    dealt = fps.select("fp", F.explode(cells(F.col("fp"))).alias("cell"))
    met = written(dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1"), "cells")
    pairs = met.where("n = 2").where(near(F.col("u"), F.col("v"))).select("u", "v")

    more = dealt.join(met.where("n > 2").select("cell", "n"), "cell")
    held = more.where(F.col("n") <= DENSE).groupBy("cell").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    tested = F.flatten(F.transform("fps", lambda a: F.transform(F.filter("fps", lambda b: (b > a) & near(a, b)), lambda b: F.struct(a.alias("u"), b.alias("v")))))
    few = held.select(F.explode(tested).alias("p")).select("p.u", "p.v")

    dense = more.where(F.col("n") > DENSE).select("fp").distinct()
    flips = [F.col("fp").bitwiseXOR(F.lit((1 << k) if k < 63 else -(1 << 63))) for k in range(64)]
    fine = dense.select("fp", F.explode(F.array(F.col("fp"), *flips)).alias("middle"))
    least = fine.groupBy("middle").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").select("middle", "v")
    stars = fine.join(least, "middle").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.union(few).union(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every document and the smallest id that it reaches over links.

    Returns doc_id, fingerprint (16 hexadecimal digits), component_id, one row per input row, and then ``key``, a hash of the
    text, and ``root``, a fingerprint that names the component. Null and wordless texts have fingerprint zero, which is linked
    like any other. Equal fingerprints are one node of the graph, so copies make no pairs. Null ids take part and never name
    a component unless it has no other. Other columns are not read.
    """
    found = written(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = written(found.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct-fingerprints")
    joined = written(components(links(nodes.select("fp")), "fingerprint-links"), "fingerprint-roots")
    rooted = joined.join(nodes, nodes.fp == joined.node)
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    linked = joined.join(least, "root").select(F.col("node").alias("fp"), "root", "component_id")
    named = nodes.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least_id").alias("component_id"))
    named = written(named, "components")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.join(named, "fp", "left").select("doc_id", text.alias("fingerprint"), "component_id", "key", "root")


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component stays, with all its columns: the smallest id's (of its texts, the one of least hash)."""
    grouped = near_duplicates(docs, id_col, text_col)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    kept = grouped.groupBy("root").agg(first).select("first.doc_id", "first.key", F.lit(1))
    return repeat_rows(docs, [F.col(id_col), F.xxhash64(text_col)], kept)
