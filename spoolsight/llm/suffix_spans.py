"""Repeated byte strings: removes every byte that a string of ``LENGTH`` bytes covers which also starts anywhere else.

A suffix array of a corpus cannot be dealt over executors, so texts are cut into snippets that are dealt by content such that
all occurrences of a string meet in one block of bounded size; each block has a Burrows-Wheeler transform of its own.

1. Anchors. Of the grams in a window (a string of ``LENGTH`` bytes at one place) the one with the least hash, leftmost on ties, is
   its anchor. Equal windows have equal anchors at equal places. Consecutive windows with one anchor make a snippet.
2. Only snippets whose anchor's gram occurs more than once go on. Equal ones (two 64-bit hashes) are merged, with their number: where
   a gram has no other snippets, they repeat as a whole, and there is nothing to compare. Of all other grams the distinct ones go on.
3. A gram with more than ``MANY`` distinct snippets is split by where its anchor lies in the window: half of the places share more
   bytes on the right, half on the left, and those bytes join the key. Windows of one place are equal or have other keys.
4. In a block, intervals of the transform are expanded backward, breadth first: common prefixes of neighbours come out by
   increasing value, and it ends at ``LENGTH``. Neighbours without a value by then share ``LENGTH`` bytes or more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from spoolsight.llm.resident import release
from spoolsight.shared import written

LENGTH, GRAM = 200, 64
#: A block's bytes, and how many distinct snippets of a gram may meet in one.
BLOCK, MANY = 1 << 19, 512
#: Positions that are hashed at once, few enough to stay in a processor's cache; a place is packed into the low bits of a hash.
AT_ONCE, PLACE = 1 << 15, (1 << 16) - 1
#: Bits of the filter that spares texts without repeats a shuffle: ``SPARSE`` for each marked text, ``FILTER`` at most (8 MiB).
SPARSE, FILTER, WORD = 32, 1 << 26, 1 << 15
_GRAM_BASE, _SNIPPET_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


# -- anchors
def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64 and their inverses."""
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([np.ones(1, "u8"), np.cumprod(np.full(PLACE, b, "u8"))]) for b in (base, pow(base, -1, 1 << 64)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


class _Hashes:
    """Hashes of any strings within a buffer, from running sums."""

    def __init__(self, data: np.ndarray, powers: tuple[np.ndarray, np.ndarray]):
        self.inverse = powers[1]
        self.sums = np.zeros(len(data) + 1, "u8")
        np.cumsum((data.astype("u8") + np.uint64(1)) * powers[0][: len(data)], out=self.sums[1:])

    def grams(self, n: int) -> np.ndarray:
        return _mix((self.sums[n:] - self.sums[:-n]) * self.inverse[: len(self.sums) - n])

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def anchored(data: np.ndarray, ends: np.ndarray, powers, length: int = LENGTH, gram: int = GRAM, keys_only: bool = False) -> dict[str, np.ndarray]:
    """Snippets of a buffer of pieces (``ends``: for each position the end of its piece).

    Columns: ``lo`` (place of the first window), ``span`` (of the last one, less that), ``off`` (of the anchor, less that),
    ``key`` (hash of the gram) and ``sid`` (hash of the snippet), or just ``key``. Only windows within one piece count.
    """
    n = len(data)
    none = {k: np.zeros(0, t) for k, t in (("lo", "i8"), ("span", "i8"), ("off", "i8"), ("key", "i8"), ("sid", "i8"))}
    if n < length:
        return none
    with np.errstate(over="ignore"):
        grams = _Hashes(data, powers[0]).grams(gram)
        least = (grams & ~np.uint64(PLACE)) | np.arange(len(grams), dtype="u8")
        width, have = length - gram + 1, 1
        while have < width:  # the least of twice as many in each step
            step = min(have, width - have)
            least, have = np.minimum(least[:-step], least[step:]), have + step
        anchor = (least & np.uint64(PLACE)).astype("i8")  # of the window at each place
        place = np.arange(len(anchor))
        ends = ends[: len(anchor)]
        fits = place + length <= ends
        turns = np.ones(len(anchor) + 1, bool)  # where windows with another anchor begin, or those of another piece
        turns[1:-1] = (anchor[1:] != anchor[:-1]) | (ends[1:] != ends[:-1])
        turns[1:-1] |= fits[1:] != fits[:-1]
        lo = np.flatnonzero(turns[:-1] & fits)
        if keys_only or not len(lo):
            return none | {"key": grams[anchor[lo]].view("i8")}
        hi, at = np.flatnonzero(turns[1:] & fits), anchor[lo]
        sid = _Hashes(data, powers[1]).between(lo, hi + length) ^ _mix((at - lo).astype("u8") + np.uint64(length))
        return {"lo": lo, "span": hi - lo, "off": at - lo, "key": grams[at].view("i8"), "sid": sid.view("i8")}


def _runs(lo: np.ndarray, key: np.ndarray, sid: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal snippets of a text at equal distances, as periodic texts have: starts of runs, distances, numbers."""
    if not len(lo):
        return np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "i8")
    same = (key[1:] == key[:-1]) & (sid[1:] == sid[:-1]) & (text[1:] == text[:-1])
    step = np.diff(lo)
    joins = same.copy()
    joins[1:] &= ~same[:-1] | (step[1:] == step[:-1])
    starts = np.flatnonzero(np.concatenate([[True], ~joins]))
    count = np.diff(np.append(starts, len(lo)))
    stride = np.where(count > 1, np.append(step, 0)[starts], 0)
    return starts, stride, count


_ANCHORS = "u1 long, u2 long, key long, sid long, lo int, span short, off short, stride short, count int"


def anchors(texts: DataFrame, keys_only: bool = False, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Snippets of all texts (``u1``, ``u2``: name of the text; ``data``: its bytes), or just their keys."""
    names = ["u1", "u2", "key", "sid", "lo", "span", "off", "stride", "count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        powers = _powers(_GRAM_BASE), _powers(_SNIPPET_BASE)
        for batch in batches:
            for rows, starts, data, ends, owner in _buffers(batch.column(2), length):
                a = anchored(data, ends, powers, length, gram, keys_only)
                if keys_only:
                    yield pa.RecordBatch.from_arrays([pa.array(a["key"])], names=["key"])
                    continue
                piece = owner[a["lo"]]
                first, stride, count = _runs(a["lo"], a["key"], a["sid"], piece)
                if not len(first):
                    continue
                of = piece[first]
                row, lo = pa.array(rows[of]), a["lo"][first] + starts[of]
                small = [pa.array(x, "int16") for x in (a["span"][first], a["off"][first], stride)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(a["key"][first]), pa.array(a["sid"][first]), pa.array(lo, "int32"), *small, pa.array(count, "int32")], names=names)

    return texts.select("u1", "u2", "data").mapInArrow(run, "key long" if keys_only else _ANCHORS)


def _buffers(texts: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts, long ones in overlapping pieces, packed into buffers: for each piece its row and what to add to a place in the
    buffer to have the place in the text; the bytes; for each byte the end of its piece and its number."""
    pieces: list[tuple[int, int, np.ndarray]] = []
    size = 0
    for row in range(len(texts)):
        value = texts[row].as_buffer()
        data = np.frombuffer(value, "u1") if value is not None and value.size else np.zeros(0, "u1")
        for at in range(0, max(1, len(data) - length + 1), AT_ONCE):
            part = data[at : at + AT_ONCE + length - 1]
            if len(part) < length:
                continue
            if size + len(part) > PLACE:
                yield _packed(pieces)
                pieces, size = [], 0
            pieces.append((row, at, part))
            size += len(part)
    if pieces:
        yield _packed(pieces)


def _packed(pieces: list[tuple[int, int, np.ndarray]]):
    sizes = np.array([len(p) for _, _, p in pieces])
    ends = np.cumsum(sizes)
    starts = np.array([at for _, at, _ in pieces]) - (ends - sizes)
    return np.array([r for r, _, _ in pieces]), starts, np.concatenate([p for _, _, p in pieces]), np.repeat(ends, sizes), np.repeat(np.arange(len(pieces)), sizes)


# -- the transform
def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Rotations of ``text`` (small numbers) in the order of their first ``depth`` symbols at least.

    Each round orders by three (in texts of over 2^20 symbols two) times as many symbols as the last one, from the ranks it
    left; only rotations that are not told apart yet are sorted again.
    """
    n = len(text)
    bits = max(1, int(text.max()).bit_length())
    have = min(62 // bits, depth)
    key = text.copy()
    for k in range(1, have):
        key = (key << bits) | np.roll(text, -k)
    order = np.argsort(key)
    key = key[order]
    starts = np.concatenate([[True], key[1:] != key[:-1]])  # of groups of equal rotations
    rank = np.empty(n, "i8")
    times = 3 if n <= 1 << 20 else 2
    while have < depth:
        group = np.maximum.accumulate(np.where(starts, np.arange(n, dtype="i4"), 0)).astype("i8")
        rank[order] = group
        still = np.flatnonzero(~(starts & np.append(starts[1:], True)))
        if not len(still):
            break
        who, key = order[still], group[still]
        for k in range(1, times):
            key = key * n + rank[(who + k * have) % n]
        by = np.argsort(key)
        order[still], key = who[by], key[by]
        starts[still] = np.concatenate([[True], key[1:] != key[:-1]])
        have *= times
    return order


class Transform:
    """Burrows-Wheeler transform of a text, with what backward extension needs: where a rotation's predecessor stands, runs of
    equal symbols, and the ranks of symbols in a wavelet matrix."""

    def __init__(self, text: np.ndarray, order: np.ndarray):
        now = text[order - 1].astype("u2")
        self.predecessor = np.empty(len(now), "i4")
        self.predecessor[np.argsort(now, kind="stable")] = np.arange(len(now), dtype="i4")
        self.run = np.append(np.int32(0), np.cumsum(now[1:] != now[:-1], dtype="i4"))
        self.bits = max(1, int(text.max()).bit_length())
        count = np.bincount(text, minlength=1 << self.bits)
        self.before = np.cumsum(count) - count  # where the rotations that begin with a symbol start
        self.levels, self.zeros = [], []
        for bit in reversed(range(self.bits)):
            one = (now >> bit & 1).astype(bool)
            self.levels.append(np.append(np.int32(0), np.cumsum(~one, dtype="i4")))
            self.zeros.append(len(now) - int(one.sum()))
            now = np.concatenate([now[~one], now[one]])
        start = np.flatnonzero(np.concatenate([[True], now[1:] != now[:-1]]))
        self.home = np.zeros(1 << self.bits, "i8")  # where a symbol starts in the lowest level
        self.home[now[start]] = start

    def extended(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of c·w for every symbol c before the strings w of the given intervals."""
        one = self.run[left] == self.run[right - 1]  # before most strings there is one symbol only
        l, r = self._branched(left[~one], right[~one])
        return np.concatenate([self.predecessor[left[one]], l]), np.concatenate([self.predecessor[right[one] - 1] + 1, r])

    def _branched(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        symbol = np.zeros(len(left), "i4")
        for zeros_before, zeros in zip(self.levels, self.zeros, strict=True):
            l0, r0 = zeros_before[left], zeros_before[right]
            l1, r1 = left - l0 + zeros, right - r0 + zeros
            low, high = r0 > l0, r1 > l1
            left, right = np.concatenate([l0[low], l1[high]]), np.concatenate([r0[low], r1[high]])
            symbol = np.concatenate([symbol[low] << 1, symbol[high] << 1 | 1])
        move = self.before[symbol] - self.home[symbol]
        return (left + move).astype("i4"), (right + move).astype("i4")


def shared_prefixes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each neighbour pair of ``order`` (the one before and at a place) the length of their common prefix, ``length`` if it is
    that or more. The first place has none: -1.

    Breadth first: each round has the intervals of strings of one length whose right ends were told last. Each is extended
    backward by every symbol before it; where an extension ends and no value is known yet, the round's number is the value, and
    the extension is an interval of the next round. So every place is set once, by increasing values, and the work is
    that of the places below ``length``.
    """
    n = len(order)
    value = np.full(n + 1, length, "i2")
    value[0] = value[n] = -1
    step, left, right = Transform(text, order), np.zeros(1, "i4"), np.full(1, n, "i4")
    for now in range(length):
        left, right = step.extended(left, right)
        new = value[right] == length
        left, right = left[new], right[new]
        if not len(left):
            break
        value[right] = now
    return value[:n]


def repeated_in_block(snippets: list[np.ndarray], counts: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each snippet the places where a string of ``length`` starts that is in the block more than once; a snippet that occurs
    more than once counts as often."""
    if not snippets:
        return []
    sizes = np.array([len(s) for s in snippets])
    raw = np.concatenate([np.append(s.astype("i8") + 1, 0) for s in snippets])  # 0 ends a snippet
    met = np.bincount(raw, minlength=257) > 0
    text = (np.cumsum(met) - 1)[raw]  # symbols in use are numbered in their order
    begin = np.cumsum(sizes + 1) - sizes - 1
    left = np.repeat(begin + sizes, sizes + 1) - np.arange(len(text))  # symbols before the end of the snippet
    order = suffix_order(text, length)
    common = shared_prefixes(text, order, length)
    twin = common == length
    twin[:-1] |= twin[1:].copy()
    here = np.zeros(len(text), bool)
    here[order[twin]] = True
    here |= np.repeat(counts > 1, sizes + 1)
    here &= left >= length  # a string that runs into the end of its snippet is none
    return [np.flatnonzero(here[b : b + s]) for b, s in zip(begin, sizes, strict=True)]


# -- Spark
def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with the name of the text (rows equal in id and text share one) and its bytes; null is empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("u1"), F.xxhash64(F.lit(1), F.col(id_col), text).alias("u2"), text.cast("binary").alias("data"))


def _marked(names: DataFrame, total: int):
    """A filter over ``u2``: true for every name in the table, and for few others as long as they are fewer than its bits."""
    bits = WORD
    while bits < min(FILTER, SPARSE * total):
        bits *= 2

    def word(group):
        at = group["at"].to_numpy() % WORD
        flags = np.zeros(WORD, "u1")
        flags[at] = 1
        return pa.table({"word": pa.array([int(group["word"][0].as_py())], "int64"), "flags": pa.array([np.packbits(flags).tobytes()], "binary")})

    places = names.select(F.pmod("u2", F.lit(bits)).alias("at")).distinct().select("at", F.floor(F.col("at") / WORD).alias("word"))
    whole = np.zeros(bits // 8, "u1")
    for r in places.groupBy("word").applyInArrow(word, "word long, flags binary").collect():  # 8 MiB at most
        whole[r.word * WORD // 8 : (r.word + 1) * WORD // 8] = np.frombuffer(r.flags, "u1")
    sent = names.sparkSession.sparkContext.broadcast(whole)

    @pandas_udf("boolean")
    def has(u2):
        import pandas as pd

        at = np.mod(u2.to_numpy(), bits)
        return pd.Series(sent.value[at >> 3] >> (7 - (at & 7)).astype("u1") & 1 == 1)

    return has


def _snippets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Bytes of the wanted snippets (``u1``, ``u2``, ``lo``, ``span``, ``off``, ``key``, ``sid``, ``n``), each read from one text."""
    listed = wanted.groupBy("u1", "u2").agg(F.collect_list(F.struct("key", "sid", "n", "lo", "span", "off")).alias("list"))
    both = texts.select("u1", "u2", "data").join(listed, ["u1", "u2"]).select("data", "list")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for row in range(batch.num_rows):
                data, wants = memoryview(batch.column(0)[row].as_buffer()), batch.column(1)[row].values
                cols = {f: wants.field(f) for f in ("key", "sid", "n", "span", "off")}
                lo, span = wants.field("lo").to_numpy(), cols["span"].to_numpy()
                for at in range(0, len(lo), 4096):
                    cut = slice(at, at + 4096)
                    parts = pa.array([data[a : a + s + LENGTH] for a, s in zip(lo[cut], span[cut], strict=True)], "binary")
                    yield pa.RecordBatch.from_arrays([*(c[cut] for c in cols.values()), parts], names=[*cols, "part"])

    return both.mapInArrow(run, "key long, sid long, n long, span short, off short, part binary")


def _split(snippets: DataFrame, many: int) -> tuple[DataFrame, DataFrame | None]:
    """Snippets of which no key has more than ``many``, and of those that were split where their parts are now: ``key``, ``sid`` of
    the snippet, ``shift`` (place of the part in it), ``ckey``, ``csid``.

    A key's snippets hold windows in which the anchor is at places ``x`` to ``y``; at first that is all of them. All windows with
    the anchor at x to y share the x bytes before it and LENGTH - y after its start, so a half of the places has a longer string
    in common, which makes a new key. With x = y the windows themselves are the key, and one distinct part is left.
    """
    ready, moved = [], None
    now = snippets.withColumns({"x": F.lit(0), "y": F.lit(LENGTH - GRAM)})
    while True:
        crowded = now.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > many).select("key")
        crowded = written(crowded, "crowded-keys")
        if crowded.isEmpty():
            ready.append(now)
            break
        ready.append(now.join(crowded, "key", "left_anti"))
        mid = F.floor((F.col("x") + F.col("y")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("x").alias("cx"), mid.alias("cy")), F.struct((mid + 1).alias("cx"), F.col("y").alias("cy")))).alias("half")
        cut = now.join(crowded, "key", "left_semi").select("*", halves).select("*", "half.cx", "half.cy").where("cx <= cy")
        first, last = F.greatest(F.lit(0), F.col("off") - F.col("cy")), F.least(F.col("span"), F.col("off") - F.col("cx"))
        cut = cut.select("*", first.cast("int").alias("q0"), last.cast("int").alias("q1")).where("q0 <= q1")
        part = F.substring("part", F.col("q0") + 1, F.col("q1") - F.col("q0") + LENGTH)
        shared = F.substring("part", F.col("off") - F.col("cx") + 1, F.col("cx") + LENGTH - F.col("cy"))
        cut = cut.select(
            "key", "sid", "n", F.col("q0").alias("shift"), F.xxhash64("key", "cx", "cy", shared).alias("ckey"), F.xxhash64(F.lit(2), "q1", "q0", part).alias("csid"),
            (F.col("q1") - F.col("q0")).cast("short").alias("span"), (F.col("off") - F.col("q0")).cast("short").alias("off"), part.alias("part"), "cx", "cy",
        )
        cut = written(cut, "split-snippets")
        went = cut.select("key", "sid", "shift", "ckey", "csid")
        if moved is not None:
            deeper = went.select(F.col("key").alias("ckey"), F.col("sid").alias("csid"), F.col("shift").alias("more"), F.col("ckey").alias("dkey"), F.col("csid").alias("dsid"))
            on = moved.join(deeper, ["ckey", "csid"], "left")
            went = on.select("key", "sid", (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"), F.coalesce("dkey", "ckey").alias("ckey"), F.coalesce("dsid", "csid").alias("csid"))
        moved = written(went, "split-places")
        firsts = [F.first(c).alias(c) for c in ("span", "off", "part")]
        now = written(cut.groupBy(F.col("ckey").alias("key"), F.col("csid").alias("sid"), F.col("cx").alias("x"), F.col("cy").alias("y")).agg(F.sum("n").alias("n"), *firsts), "parted-snippets")
    out = ready[0]
    for more in ready[1:]:
        out = out.unionByName(more)
    return out.select("key", "sid", "n", "span", "off", "part"), moved


def _repeats(snippets: DataFrame) -> DataFrame:
    """``key``, ``sid``, ``a``, ``b``: runs of places in the snippet where repeated strings start."""
    size = snippets.agg(F.sum(F.length("part") + 1).alias("bytes")).first().bytes or 0
    blocks = max(1, -(-size // BLOCK))

    def run(group):
        release()
        parts = [np.frombuffer(p.as_buffer(), "u1") for p in group["part"]]
        key, sid = group["key"].to_numpy(), group["sid"].to_numpy()
        found = repeated_in_block(parts, group["n"].to_numpy())
        runs = [(k, f[s], f[e]) for k, f in enumerate(found) if len(f) for s, e in _bounds(f)]
        of = np.array([k for k, _, _ in runs], "i8")
        return pa.table({"key": key[of], "sid": sid[of], "a": pa.array([a for _, a, _ in runs], "int32"), "b": pa.array([b for _, _, b in runs], "int32")})

    dealt = snippets.select("key", "sid", "n", "part", F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"))
    return dealt.groupBy("block").applyInArrow(run, "key long, sid long, a int, b int")


def _bounds(places: np.ndarray) -> list[tuple[int, int]]:
    """Indexes of the first and last of each run of consecutive numbers."""
    gaps = np.flatnonzero(np.diff(places) != 1)
    return list(zip(np.concatenate([[0], gaps + 1]), np.append(gaps, len(places) - 1), strict=True))


def repeated_spans(texts: DataFrame, many: int = MANY) -> DataFrame:
    """``u1``, ``u2``, ``s``, ``e``: bytes of the named texts that repeated strings cover; runs may overlap."""
    met = anchors(texts, keys_only=True).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    placed = written(anchors(texts).join(written(met, "repeated-grams"), "key", "left_semi"), "repeated-anchors")
    one = [F.first(c).alias(c) for c in ("u1", "u2", "lo", "span", "off")]
    distinct = placed.groupBy("key", "sid").agg(F.sum("count").alias("n"), *one)
    distinct = written(distinct, "distinct-snippets")
    kinds = distinct.groupBy(F.col("key").alias("gram")).agg(F.count(F.lit(1)).alias("kinds")).where("kinds = 1").select("gram")
    told = written(distinct.join(kinds, F.col("key") == F.col("gram"), "left"), "told-snippets")
    alike = told.where("gram is not null").select("key", "sid", F.lit(0).alias("a"), F.col("span").cast("int").alias("b"))
    wanted = told.where("gram is null")
    some = _marked(wanted.select("u2").distinct(), wanted.count())
    snippets = written(_snippets(texts.where(some("u2")), wanted), "snippets")
    parts, moved = _split(snippets, many)
    runs = written(_repeats(parts), "repeats")
    if moved is not None:
        back = moved.join(runs.select(F.col("key").alias("ckey"), F.col("sid").alias("csid"), "a", "b"), ["ckey", "csid"])
        runs = runs.unionByName(back.select("key", "sid", (F.col("a") + F.col("shift")).alias("a"), (F.col("b") + F.col("shift")).alias("b")))
    on = placed.select("u1", "u2", "key", "sid", "lo", "stride", "count").join(runs.unionByName(alike), ["key", "sid"])
    # the windows of a run of snippets are no further apart than they are long, so what a run covers has no gaps
    return on.select("u1", "u2", (F.col("lo") + F.col("a")).alias("s"), (F.col("lo") + F.col("stride") * (F.col("count") - 1) + F.col("b") + LENGTH).alias("e"))


def _kept(data: memoryview, spans: list[tuple[int, int]]) -> tuple[int, int, list[memoryview]]:
    """Removed bytes, maximal removed runs, and what is left, of sorted spans."""
    removed, runs, at, left = 0, 0, 0, []
    end = None
    for s, e in spans:
        if end is None or s > end:
            runs += 1
            left.append(data[at:s])
        elif e <= end:
            continue
        removed += e - (s if end is None or s > end else end)
        at = end = e if end is None else max(end, e)
    return removed, runs, [*left, data[at:]]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts_too: bool = True, many: int = MANY) -> DataFrame:
    """Every row of ``docs`` with what is left of its text: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``texts_too``
    what is left itself, kept (binary).

    Matches never cross texts; strings are judged on the input. A null text is empty; texts of fewer than 200 bytes keep all.
    Rows may repeat and ids may be null: each row counts as an occurrence. Empty tables give empty results. Other columns are
    not read. Texts are any bytes; what is left need not be valid UTF-8, so it is binary.

    Only texts that may hold repeats are shuffled, by a filter of bounded size; equal snippets travel once.
    """
    texts = _named(docs, id_col, text_col)
    spans = written(repeated_spans(texts, many), "repeated-spans")
    marked = spans.select("u2").distinct()
    has = _marked(marked, marked.count())
    told = texts.select("*", has("u2").alias("some"))
    listed = spans.groupBy("u1", "u2").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("spans"))
    digest: Column = F.sha2("data", 256).alias("kept_sha256")
    whole = told.where("not some").select("doc_id", F.octet_length("data").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), digest, *([F.col("data").alias("kept")] if texts_too else []))

    names = whole.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for row in range(batch.num_rows):
                data, found = memoryview(batch.column(1)[row].as_buffer()), batch.column(2)[row].values
                spans = [] if found is None else list(zip(found.field("s").to_pylist(), found.field("e").to_pylist(), strict=True))
                removed, runs, left = _kept(data, spans)
                kept = b"".join(left)
                values = [len(data), removed, runs]
                columns = [batch.column(0).slice(row, 1), *(pa.array([v], "int64") for v in values), pa.array([hashlib.sha256(kept).hexdigest()])]
                yield pa.RecordBatch.from_arrays(columns + [pa.array([kept], "binary")] * texts_too, names=names)

    kind = texts.schema["doc_id"].dataType.simpleString()
    cut = told.where("some").join(listed, ["u1", "u2"], "left").select("doc_id", "data", "spans")
    return whole.unionByName(cut.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts_too))
