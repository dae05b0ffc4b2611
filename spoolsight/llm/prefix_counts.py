"""Exact token counts at every prefix of a text, by dynamic programming over token ends.

``PrefixCounter`` holds, for a byte-level BPE vocabulary, the tokens by a 64-bit rolling hash of their bytes, and the two
tokens that each token was merged from. For a piece (text that the pre-tokenizer leaves unsplit) it fills, byte by byte,
``last[i]``, the last token of the encoding of the first i bytes, and ``count[i]``, the number of its tokens: of all
vocabulary tokens that end at i, exactly one forms with ``last[i - its length]`` a pair that BPE itself would leave so;
``count[i]`` is then one more than at that place. No prefix is ever encoded.

A text's counts are those of its pieces end to end, save where a prefix splits otherwise than the whole text: inside a
contraction, at the end of a run of white space, inside a special token. Those places are set right one by one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoolsight.llm.byte_bpe import KEPT_LENGTH, ByteBpe
from spoolsight.llm.resident import resident

BASE = np.uint64(0x9E3779B97F4A7C15)
SHORT, BLOCK = 64, 1 << 16
KEPT_PIECES = 700_000
WHITE_RUN = re.compile(r"[^\S\x1c-\x1f]{2,}(?=[^\s]|[\x1c-\x1f])")
ROWS_AT_ONCE = 256


class PrefixCounter:
    def __init__(self, bpe: ByteBpe, source: str):
        self.bpe = bpe
        tokens = {i: b for i, b in enumerate(bpe.token_bytes) if b and i not in bpe.specials.values()}
        size = len(bpe.token_bytes)
        self.first, self.second = np.full(size, -1, "i8"), np.full(size, -1, "i8")
        merges: dict[tuple[int, int], int] = {}
        for pair in json.loads(source)["model"]["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            whole = bpe.vocab[a + b]
            if (bpe.vocab[a], bpe.vocab[b]) not in merges:
                merges[bpe.vocab[a], bpe.vocab[b]] = whole
            if self.first[whole] < 0:
                self.first[whole], self.second[whole] = bpe.vocab[a], bpe.vocab[b]
        # A token whose own bytes are encoded otherwise never ends a prefix.
        own = bpe.bpe([bpe.token_chars[i] for i in tokens])
        tokens = {i: b for (i, b), e in zip(tokens.items(), own, strict=True) if e == [i]}
        self.longest = max(map(len, tokens.values()))
        self.powers = np.ones(self.longest + 1, "u8")
        for k in range(1, self.longest + 1):
            self.powers[k] = int(self.powers[k - 1]) * int(BASE) & 0xFFFFFFFFFFFFFFFF
        hashes = np.array([self._hash(b) for b in tokens.values()], "u8")
        self.token_table = _Table(hashes, np.array(list(tokens), "i8"))
        keys = np.array([a << 32 | b for a, b in merges], "u8")
        self.merge_table = _Table(keys * BASE, np.array(list(merges.values()), "i8"))
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _hash(b: bytes) -> int:
        h = 0
        for c in b:
            h = (h * int(BASE) + c + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def pair_stays(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves each pair of tokens as it is.

        The merges that made both tokens are undone from the newest backwards. Whenever the two tokens that then touch
        could merge at an older rank than what is still to be undone, BPE would have merged them across the border.
        """
        stays = np.ones(len(a), bool)
        at, bound = np.arange(len(a)), np.full(len(a), np.iinfo("i8").max)
        a, b = a.copy(), b.copy()
        while len(at):
            merged = self.merge_table.get((a.astype("u8") << np.uint64(32) | b.astype("u8")) * BASE)
            crossed = (merged >= 0) & (merged < bound)
            stays[at[crossed]] = False
            go = ~crossed
            at, a, b, bound = at[go], a[go], b[go], bound[go]
            right_side = self._undo_right(a, b)
            new_bound = np.where(right_side, b + 1, a)
            a, b = np.where(right_side, a, self.second[a]), np.where(right_side, self.first[b], b)
            # A side that is a single byte has nothing to undo: then the other side goes on.
            stuck_right, stuck_left = right_side & (b < 0), ~right_side & (a < 0)
            go = ~(stuck_right | stuck_left)
            at, a, b, bound = at[go], a[go], b[go], new_bound[go]
        return stays

    def _undo_right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which side's last merge is the newer one; bytes were never merged. Of equal tokens the right one is undone
        first, as BPE merges the leftmost of equal pairs first."""
        made_a, made_b = np.where(self.first[a] < 0, -1, a), np.where(self.first[b] < 0, -1, b)
        return made_b >= made_a

    def piece_steps(self, pieces: list[str]) -> list[bytes]:
        """For each piece the change of the token count at each character, a signed byte each."""
        raw = [p.encode() for p in pieces]
        out: list[bytes] = [b""] * len(pieces)
        short = sorted((k for k, b in enumerate(raw) if len(b) <= SHORT), key=lambda k: -len(raw[k]))
        for at in range(0, len(short), 20_000):
            some = short[at : at + 20_000]
            flat = np.frombuffer(b"".join([raw[k] for k in some]), "u1")
            bounds = np.cumsum([0, *(len(raw[k]) for k in some)])
            cut = _char_steps(flat, self._lockstep([raw[k] for k in some]), bounds)
            end = 0
            for k in some:
                begin, end = end, end + len(pieces[k])
                out[k] = cut[begin:end]
        for k, b in enumerate(raw):
            if len(b) > SHORT:
                out[k] = _char_steps(np.frombuffer(b, "u1"), self._alone(b)[1:], np.array([0, len(b)]))
        return out

    def _lockstep(self, pieces: list[bytes]) -> np.ndarray:
        """Counts after each byte, piece after piece. Pieces come by falling length, and each step of the loop is at the
        same byte position in all of them."""
        lengths = np.array([len(p) for p in pieces])
        width = int(lengths.max(initial=0))
        grid = np.zeros((len(pieces), width), "u8")
        flat = np.frombuffer(b"".join(pieces), "u1")
        inside = np.arange(width)[None, :] < lengths[:, None]
        grid[inside] = flat
        hashes = np.zeros((width + 1, len(pieces)), "u8")
        last, count = np.full((width + 1, len(pieces)), -1, "i8"), np.zeros((width + 1, len(pieces)), "i4")
        for i in range(1, width + 1):
            n = int(np.searchsorted(-lengths, -i, side="right"))
            hashes[i, :n] = hashes[i - 1, :n] * BASE + grid[:n, i - 1] + np.uint64(1)
            open_rows = np.arange(n)
            for size in range(min(i, self.longest), 0, -1):
                token = self.token_table.get(hashes[i, open_rows] - hashes[i - size, open_rows] * self.powers[size])
                hit = np.flatnonzero(token >= 0)
                if not len(hit):
                    continue
                rows, token = open_rows[hit], token[hit]
                fits = np.ones(len(hit), bool) if size == i else self.pair_stays(last[i - size, rows], token)
                done = rows[fits]
                last[i, done], count[i, done] = token[fits], count[i - size, done] + 1
                keep = np.ones(len(open_rows), bool)
                keep[hit[fits]] = False
                open_rows = open_rows[keep]
                if not len(open_rows):
                    break
            if len(open_rows):
                raise ValueError("a prefix has no encoding: the vocabulary lacks some byte")
        return count[1:].T[inside]

    def _alone(self, piece: bytes) -> np.ndarray:
        """One long piece, a block at a time: all token ends in a block are looked up at once, then its places are filled one by
        one."""
        n = len(piece)
        last, count = np.full(n + 1, -1, "i4"), np.zeros(n + 1, "i4")
        for start in range(0, n, BLOCK):
            end, low = min(n, start + BLOCK), max(0, start - self.longest)
            hashes = np.zeros(end - low + 1, "u8")
            h = 0
            for i, c in enumerate(piece[low:end], 1):
                h = (h * int(BASE) + c + 1) & 0xFFFFFFFFFFFFFFFF
                hashes[i] = h
            ends: list[list[tuple[int, int]]] = [[] for _ in range(end - start)]
            for size in range(min(end, self.longest), 0, -1):
                first = max(start + 1, size) - low
                token = self.token_table.get(hashes[first:] - hashes[first - size : len(hashes) - size] * self.powers[size])
                for k in np.flatnonzero(token >= 0).tolist():
                    ends[first + k + low - start - 1].append((size, int(token[k])))
            for i, found in enumerate(ends, start + 1):
                for size, token in found:
                    if size == i or self.one_pair_stays(int(last[i - size]), token):
                        last[i], count[i] = token, count[i - size] + 1
                        break
        return count

    @lru_cache(maxsize=200_000)  # noqa: B019  one counter a worker
    def one_pair_stays(self, a: int, b: int) -> bool:
        return bool(self.pair_stays(np.array([a]), np.array([b]))[0])

    def learn(self, pieces: list[str]) -> None:
        """Put the change of the count at each character of every piece into ``known``, a signed byte each."""
        known = self.known
        missing = [p for p in dict.fromkeys(pieces) if p not in known]
        if len(known) + len(missing) > KEPT_PIECES:
            known.clear()
            missing = list(dict.fromkeys(pieces))
        known.update(zip(missing, self.piece_steps(missing), strict=True))
        for p in known.keys() & {"'re", "'ve", "'ll"}:  # as prefixes, their first two characters are two pieces
            total = int(np.frombuffer(known[p], "i1").sum())
            known[p] = np.array([1, 1, total - 2], "i1").tobytes()

    def steps(self, texts: list[str]) -> list[bytes]:
        """For each text the change of its token count at each character, a signed byte each."""
        split = [self.bpe.split(t) for t in texts]
        known, specials = self.known, self.bpe.specials
        needed = set().union(*split).difference(known, specials)
        if needed:
            self.learn(sorted(needed))
        out = []
        for text, pieces in zip(texts, split, strict=True):
            special = any(s in text for s in specials)
            try:
                steps = b"".join([b"\x00" * (len(p) - 1) + b"\x01" if p in specials else known[p] for p in pieces] if special else map(known.__getitem__, pieces))
            except KeyError:  # the table was just emptied to make room
                self.learn([p for p in pieces if p not in specials])
                steps = b"".join(b"\x00" * (len(p) - 1) + b"\x01" if p in specials else known[p] for p in pieces)
            out.append(self._mended(text, pieces, steps) if special or WHITE_RUN.search(text) else steps)
        for p in needed:
            if len(p) > KEPT_LENGTH:
                known.pop(p, None)
        return out

    def _mended(self, text: str, pieces: list[str], steps: bytes) -> bytes:
        """Set right the prefixes that end in white space before a word, or inside a special token."""
        out, specials = np.frombuffer(steps, "i1").astype("i4"), self.bpe.specials
        at = begin = 0
        for k, p in enumerate(pieces):
            if p in specials:
                self._within_special(text, begin, at, p, out)
                begin = at + len(p)
            elif k + 1 < len(pieces) and pieces[k + 1] not in specials and _white(p) and not _white(pieces[k + 1]):
                # the piece before a word, less the blank that the word takes: as a prefix, the run is one piece
                nxt = pieces[k + 1]
                if nxt[0] == " ":
                    self._run_end(p + " ", at + len(p), out)
            elif k + 1 < len(pieces) and _white(p) and _white(pieces[k + 1]) and pieces[k + 1] not in specials:
                # a run whose last character no word takes is two pieces
                self._run_end(p + pieces[k + 1], at + len(p), out)
            at += len(p)
        return _bytes(out)

    def _run_end(self, run: str, at: int, out: np.ndarray) -> None:
        if run not in self.known:
            self.learn([run])
        step = int(np.frombuffer(self.known[run], "i1")[-1])
        if at + 1 < len(out):
            out[at + 1] += out[at] - step
        out[at] = step

    def _within_special(self, text: str, begin: int, at: int, special: str, out: np.ndarray) -> None:
        """Prefixes that end inside a special token split as ordinary text, from the last word border before it on."""
        start = at
        while start > begin and not (start < at and _white(text[start]) and not _white(text[start - 1])):
            start -= 1
        before, whole = int(out[start:at].sum()), 1
        had = before
        for j in range(1, len(special)):
            now = sum(len(self.bpe.bpe([self.bpe.chars(p)])[0]) for p in self.bpe.split(text[start : at + j]))
            out[at + j - 1], had = now - had, now
        out[at + len(special) - 1] = before + whole - had


def _white(s: str) -> bool:
    """White space in the sense of the split rule; Python also counts four control characters as such."""
    return s.isspace() and not ("\x1c" <= s[0] <= "\x1f")


def _char_steps(flat: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> bytes:
    """Counts after each byte of pieces end to end (``bounds``: where they begin), as changes at each character."""
    ends = np.ones(len(flat), bool)
    ends[:-1] = (flat[1:] & 0xC0) != 0x80
    before = np.zeros(len(flat), counts.dtype)
    kept = np.flatnonzero(ends)
    before[kept[1:]] = counts[kept[:-1]]
    first = np.searchsorted(kept, bounds[:-1][np.diff(bounds) > 0])
    before[kept[first]] = 0
    return _bytes((counts - before)[kept])


def _bytes(steps: np.ndarray) -> bytes:
    """Steps as signed bytes; a step is at most the tokens of the bytes that one character can change."""
    if len(steps) and (steps.min() < -128 or steps.max() > 127):
        raise OverflowError("a step of the token count does not fit in a signed byte")
    return steps.astype("i1").tobytes()


class _Table:
    """Open-addressing table from 64-bit keys to values; -1 where a key is absent."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys, self.values = np.zeros(1 << self.bits, "u8"), np.full(1 << self.bits, -1, "i8")
        self.mask, self.shift = np.uint64((1 << self.bits) - 1), np.uint64(64 - self.bits)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = self.values[slot] < 0
            self.keys[slot[free]], self.values[slot[free]] = keys[left[free]], values[left[free]]
            lost = self.values[slot] != values[left]
            left, slot = left[lost], (slot[lost] + np.uint64(1)) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys ^ keys >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> self.shift

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self.values[slot]
        wrong = np.flatnonzero((self.keys[slot] != keys) & (out >= 0))
        while len(wrong):
            slot[wrong] = (slot[wrong] + np.uint64(1)) & self.mask
            out[wrong] = self.values[slot[wrong]]
            wrong = wrong[(self.keys[slot[wrong]] != keys[wrong]) & (out[wrong] >= 0)]
        return out


def counter(source: str) -> PrefixCounter:
    """This worker's counter for a tokenizer file."""
    return resident(("prefix counter", hash(source)), lambda: PrefixCounter(ByteBpe(source), source))


def prefix_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count tokens at every prefix of every whole text.

    Returns ``doc_id``, ``n_bytes``, ``n_tokens`` and ``steps binary``: for each character a signed byte, the change of the
    token count when the prefix grows by it. The running sum of ``steps`` is the exact count at each prefix, and its end is
    ``n_tokens``; ``longest_prefix`` answers budgets from it.

    No shuffle. Null text counts as empty: 0 bytes, 0 tokens, no steps. Null, repeated or tied ids are passed on row by
    row; other columns are not read.
    """
    source = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(source.value)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                steps = known.steps(texts)
                totals = [int(np.frombuffer(s, "i1").sum(dtype="i8")) for s in steps]
                sizes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array(steps, pa.binary())], names=["doc_id", "n_bytes", "n_tokens", "steps"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, steps binary")


def longest_prefix(steps: Column, budget: int) -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens, from stored steps; nothing is encoded again."""

    def longest(stored: pd.Series) -> pd.Series:
        out = []
        for s in stored:
            within = np.flatnonzero(np.cumsum(np.frombuffer(s or b"", "i1"), dtype="i8") <= budget)
            out.append(int(within[-1]) + 1 if len(within) else 0)
        return pd.Series(out, dtype="int64")

    return F.pandas_udf(longest, "long")(steps)
