"""A byte-level BPE tokenizer file, opened for work inside tasks.

The tokenizer JSON is read on the driver and broadcast (it is a vocabulary file of fixed size, not data). Each Python
worker builds one ``ByteBpe`` and keeps it, with a bounded table of pieces that it has already encoded, for all
tasks that it runs.

``split`` cuts a text exactly where the library's pre-tokenizer does; ``ids_of`` returns the ids of such pieces. A piece
of up to ``leaf`` bytes goes to the library's BPE model as it is, a longer one by ``tree_concat``.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

import numpy as np

from spoolsight.llm.resident import resident

# The split rule of the byte-level pre-tokenizer, spelled out for common characters. A text with any other
# character is "unusual": the library itself then splits it.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏΑ-ΡΣ-ώЀ-ҁҊ-ԯぁ-ゖァ-ヺ一-鿯가-힣"
SPLIT = re.compile(rf" ?[{LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?[^\s\d{LETTERS}]+|\s+(?!\S)|\s+")
UNUSUAL = re.compile(rf"[^\x00-\x1b\x20-\x84\x86-\xb1\xb4\xb6-\xb8\xbb\xbf×÷‐-‧‰-⁞₠-₿{LETTERS}]")
#: The table of pieces holds so many, none of over so many characters, so that its bytes are bounded too.
KEPT_PIECES, KEPT_LENGTH = 400_000, 64
#: Pieces are joined by a byte that UTF-8 never has; the library cuts them apart again.
JOIN, JOINED = "\udcff", 0xFF
PIECES_AT_ONCE = 1024


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


class ByteBpe:
    """One opened tokenizer. Only byte-level BPE without normaliser is accepted; anything else raises ValueError."""

    def __init__(self, source: str, leaf: int = 16, kept: int = KEPT_PIECES):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        spec = json.loads(source)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or model["type"] != "BPE":
            raise ValueError("a byte-level BPE tokenizer without normalizer and prefix space is needed")
        self.library = Tokenizer.from_str(source)
        self.library.no_truncation()
        self.library.no_padding()
        self.raw = Tokenizer(self.library.model)  # BPE over exactly the characters between two blanks
        self.raw.pre_tokenizer = CharDelimiterSplit(" ")
        self.leaf, self.kept = leaf, kept
        chars = byte_alphabet()
        self.to_chars = {b: c if b != JOINED else " " for b, c in enumerate(chars)}
        self.from_chars = {ord(c): b for b, c in enumerate(chars)}
        self.specials = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.cut_specials = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.vocab: dict[str, int] = model["vocab"]
        size = max([*self.vocab.values(), *self.specials.values()]) + 1
        self.token_chars = [""] * size
        self.token_bytes = [b""] * size
        for token, i in self.vocab.items():
            self.token_chars[i] = token
            self.token_bytes[i] = bytes(map(self.from_chars.__getitem__, map(ord, token))) if token not in self.specials else token.encode()
        for token, i in self.specials.items():
            self.token_bytes[i] = token.encode()
        if not self.vocab.keys() >= set(chars):
            raise ValueError("the vocabulary lacks some byte")
        self.lengths = np.array([len(t) for t in self.token_chars])
        self.known: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        """Pieces of ``text`` in order; a special token is a piece of its own."""
        if self.cut_specials is not None and "<" in text and self.cut_specials.search(text):
            out: list[str] = []
            for k, part in enumerate(self.cut_specials.split(text)):
                out += [part] if k % 2 else self._split(part)
            return out
        return self._split(text)

    def _split(self, text: str) -> list[str]:
        if UNUSUAL.search(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)] if text else []
        return SPLIT.findall(text)

    def chars(self, piece: str) -> str:
        """``piece`` in the alphabet of the vocabulary, a character for each UTF-8 byte."""
        return piece.encode("utf-8").decode("latin-1").translate(self.to_chars)

    def bpe(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each text of vocabulary characters, taken as unsplit; one parallel library call."""
        return [np.frombuffer(p, "<u4").tolist() for p in self._packed([" ".join(some) for some in _runs(pieces)], [np.array([len(p) for p in some]) for some in _runs(pieces)])]

    def _packed(self, joined: list[str], sizes: list[np.ndarray]) -> list[bytes]:
        """Ids, as little-endian unsigned 32-bit integers, of each text of vocabulary characters among those joined by blanks.

        ``sizes``: how many characters each has. Tokens never cross a blank and lose no character, so a text's tokens end
        where the running sum of token lengths is the running sum of sizes.
        """
        out: list[bytes] = []
        for encoding, size in zip(self.raw.encode_batch_fast(joined, add_special_tokens=False), sizes, strict=True):
            ids = np.array(encoding.ids, "<u4")
            ends = 4 * np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(size)) + 4
            packed, begin = ids.tobytes(), 0
            for end in ends.tolist():
                out.append(packed[begin:end])
                begin = end
        return out

    def unsplit(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of pieces that need no halving."""
        joined, sizes = [], []
        for some in _runs(pieces):
            raw = JOIN.join(some).encode("utf-8", "surrogateescape")
            joined.append(raw.decode("latin-1").translate(self.to_chars))
            sizes.append(np.diff(np.flatnonzero(np.frombuffer(b"\xff" + raw + b"\xff", "u1") == JOINED)) - 1)
        return self._packed(joined, sizes)

    def learn(self, pieces: list[str]) -> None:
        """Put the packed ids of every piece into ``known``."""
        known = self.known
        missing = [p for p in dict.fromkeys(pieces) if p not in known]
        if not missing:
            return
        if len(known) + len(missing) > self.kept:
            known.clear()
            missing = list(dict.fromkeys(pieces))
        specials, leaf = self.specials, self.leaf
        short, long = [], []
        for p in missing:
            if p in specials:
                known[p] = np.uint32(specials[p]).tobytes()
            elif len(p) * 4 <= leaf or len(p.encode()) <= leaf:
                short.append(p)
            else:
                long.append(p)
        known.update(zip(short, self.unsplit(short), strict=True))
        if long:
            found = tree_concat([self.chars(p) for p in long], self.bpe, self.token_chars, leaf)
            known.update((p, np.array(ids, "<u4").tobytes()) for p, ids in zip(long, found, strict=True))

    def ids_of(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in texts]
        known = self.known
        missing = set().union(*split).difference(known)
        if missing:
            self.learn(sorted(missing))
        try:
            out = [b"".join(map(known.__getitem__, pieces)) for pieces in split]
        except KeyError:  # the table was just emptied to make room
            self.learn([p for pieces in split for p in pieces])
            out = [b"".join(map(known.__getitem__, pieces)) for pieces in split]
        for p in missing:
            if len(p) > KEPT_LENGTH:
                del known[p]
        return out

    def decode(self, ids: list[int]) -> str:
        """As the library decodes with special tokens kept: bytes of all tokens, malformed UTF-8 replaced."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", errors="replace")


def tree_concat(pieces: list[str], bpe: Callable[[list[str]], list[list[int]]], token_chars: list[str], leaf: int) -> list[list[int]]:
    """BPE ids of unsplit texts by halving, and by repairing the joins.

    Every text over ``leaf`` characters is halved until its parts are short. All parts of all texts are encoded by one
    parallel call. Then neighbours are joined level by level: a window of the last tokens of the left and the first of the
    right side is encoded anew, and it doubles until its first token is the left side's token there and its last token the
    right side's (or the window has reached that side's end). A token sequence is the BPE encoding of its text exactly if
    each two neighbouring tokens are the encoding of their own text; so one agreeing token on each side proves the whole.
    The windows of all joins of a level go into one parallel call.
    """
    bounds = [_halves(len(p), leaf) for p in pieces]
    flat = [p[a:b] for p, cuts in zip(pieces, bounds, strict=True) for a, b in zip(cuts, cuts[1:])]
    encoded = iter(bpe(flat) if flat else [])
    rows = [[next(encoded) for _ in range(len(cuts) - 1)] for cuts in bounds]
    while True:
        jobs = [(r, k) for r, row in enumerate(rows) for k in range(0, len(row) - 1, 2)]
        if not jobs:
            return [row[0] if row else [] for row in rows]
        joined: dict[tuple[int, int], list[int]] = {}
        width = 1
        while jobs:
            windows = ["".join(map(token_chars.__getitem__, rows[r][k][-width:] + rows[r][k + 1][:width])) for r, k in jobs]
            again = []
            for (r, k), w in zip(jobs, bpe(windows), strict=True):
                a, b = rows[r][k], rows[r][k + 1]
                left, right = min(width, len(a)), min(width, len(b))
                if (left == len(a) or w[0] == a[-left]) and (right == len(b) or w[-1] == b[right - 1]):
                    joined[r, k] = a[: len(a) - left] + w + b[right:]
                else:
                    again.append((r, k))
            jobs, width = again, 2 * width
        rows = [[joined.get((r, k), row[k]) for k in range(0, len(row), 2)] for r, row in enumerate(rows)]


def _runs(pieces: list[str]) -> list[list[str]]:
    return [pieces[at : at + PIECES_AT_ONCE] for at in range(0, len(pieces), PIECES_AT_ONCE)]


def _halves(n: int, leaf: int) -> list[int]:
    """Cut points of ``n`` characters, halved until no part is over ``leaf``."""
    parts = 1
    while n > leaf * parts:
        parts *= 2
    return [n * k // parts for k in range(parts + 1)] if n else [0]


def opened(source: str, leaf: int = 16, kept: int = KEPT_PIECES) -> ByteBpe:
    """This worker's tokenizer for ``source``. The library takes as many threads as Spark grants a Python worker."""
    os.environ.setdefault("RAYON_NUM_THREADS", os.environ.get("OMP_NUM_THREADS", "1"))
    return resident(("tokenizer", hash(source), leaf, kept), lambda: ByteBpe(source, leaf, kept))
