"""Texts as grey PNG images in binary columns, read back with checksum tests, and cosine-transform hashes of them.

An image is 64 samples wide, so a payload padded to a multiple of 64 bytes fills whole rows. Encoding and decoding use
zlib for the compressed stream and numpy for the rest: chunk framing, CRC tests, row filters and their inversion.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 64
LEVEL = 6
# Fixed values of the format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)
SIDE, LOW = 32, 8
ROWS_AT_ONCE = 4096


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(samples: np.ndarray) -> bytes:
    """A grey 8-bit PNG of a two-dimensional array. Each row takes the filter, of none, left and up, whose output has the
    least sum of absolute signed values. Large images are filtered some rows at a time."""
    height, width = samples.shape
    rows = np.empty((height, width + 1), "u1")
    for at in range(0, height, ROWS_AT_ONCE):
        some = samples[at : at + ROWS_AT_ONCE]
        left, above = np.zeros_like(some), np.zeros_like(some)
        left[:, 1:], above[1:] = some[:, :-1], some[:-1]
        if at:
            above[0] = samples[at - 1]
        tried = np.stack([some, some - left, some - above])
        filters = np.abs(tried.view("i1").astype("i2")).sum(axis=2).argmin(axis=0)
        rows[at : at + len(some), 0] = filters
        rows[at : at + len(some), 1:] = tried[filters, np.arange(len(some))]
    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """Samples of a grey 8-bit PNG without interlacing; ValueError on any damage."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, header, stream, ended = 8, b"", [], False
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("cut chunk")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) != size or len(data) < at + 12 + size or struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"bad checksum of chunk {kind!r}")
        at += 12 + size
        if kind == b"IHDR":
            header = body
        elif kind == b"IDAT":
            stream.append(body)
        elif kind == b"IEND":
            ended = True
            break
        elif not kind[0] & 0x20:
            raise ValueError(f"unknown critical chunk {kind!r}")
    if len(header) != 13 or not ended:
        raise ValueError("header or end is missing")
    width, height, depth, colour, compression, filtering, interlace = struct.unpack(">IIBBBBB", header)
    if (depth, colour, compression, filtering, interlace) != (8, 0, 0, 0, 0):
        raise ValueError("not grey, 8-bit and plain")
    try:
        raw = zlib.decompress(b"".join(stream))
    except zlib.error as e:
        raise ValueError("bad compressed stream") from e
    if len(raw) != height * (width + 1):
        raise ValueError("wrong size of image data")
    rows = np.frombuffer(raw, "u1").reshape(height, width + 1)
    return unfilter(rows[:, 0], rows[:, 1:])


def unfilter(filters: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undo the row filters. Rows without or with left filter need no other row; runs of up rows are running sums from the
    row before the run. Average and Paeth rows go one by one, and cut the work into stretches."""
    if len(filters) and int(filters.max()) > PAETH:
        raise ValueError("unknown filter")
    out = rows.copy()
    left = filters == SUB
    out[left] = np.cumsum(rows[left], axis=1, dtype="u1")
    hard = np.flatnonzero(filters >= AVERAGE)
    bounds = [0, *(int(k) for h in hard for k in (h, h + 1)), len(rows)]
    for a, b in zip(bounds, bounds[1:]):
        if a == b:
            continue
        if filters[a] >= AVERAGE:
            out[a] = _by_sample(int(filters[a]), rows[a], out[a - 1] if a else np.zeros_like(rows[0]))
            continue
        sums = np.cumsum(out[a:b], axis=0, dtype="u1")
        up = filters[a:b] == UP
        fixed = np.where(up, -1, np.arange(b - a))
        base = np.maximum.accumulate(fixed)  # the last row of the stretch that is no up row
        known = base >= 0
        before = np.zeros_like(sums)
        later = known & (base > 0)
        before[later] = sums[base[later] - 1]
        if a and not known.all():
            before[~known] = np.uint8(0) - out[a - 1]
        done = sums - before
        out[a:b][up] = done[up]
    return out


def _by_sample(kind: int, row: np.ndarray, above: np.ndarray) -> np.ndarray:
    out, left, corner = [], 0, 0
    for value, up in zip(row.tolist(), above.tolist(), strict=True):
        if kind == AVERAGE:
            guess = left + up >> 1
        else:
            far = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
            guess = left if far[0] <= far[1] and far[0] <= far[2] else up if far[1] <= far[2] else corner
        left, corner = value + guess & 255, up
        out.append(left)
    return np.array(out, "u1")


def _cosines() -> np.ndarray:
    k, n = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * (2 * n + 1) * k / (2 * SIDE))


COSINES = _cosines()


def low_frequency_hash(samples: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest cosine coefficients of the image, averaged down to 32 x 32, lie above the median of
    all but the first. Each small sample is the mean of its area of the image, part rows and columns in proportion."""
    small = _averaged(_averaged(samples).T).T
    low = np.rint(COSINES @ small @ COSINES.T * 1e6)
    return np.packbits(low.ravel() > np.median(low.ravel()[1:])).tobytes()


def _averaged(rows: np.ndarray) -> np.ndarray:
    """Rows averaged to 32, by differences of running sums at fractional places. The running sums of many rows are only made
    at these places."""
    n = len(rows)
    places = np.arange(SIDE + 1) * n / SIDE
    whole = np.minimum(places.astype(int), n - 1)
    if n > ROWS_AT_ONCE:
        parts = [rows[a:b].sum(axis=0, dtype="f8") for a, b in zip([0, *whole[:-1]], whole)]
        at = np.cumsum(parts, axis=0) + (places - whole)[:, None] * rows[whole]
    else:
        sums = np.concatenate([np.zeros((1, rows.shape[1])), np.cumsum(rows, axis=0, dtype="f8")])
        at = sums[whole] + (places - whole)[:, None] * (sums[whole + 1] - sums[whole])
    return np.diff(at, axis=0) * (SIDE / n)


def padded(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and the text with bytes 0 up to a positive multiple of 64."""
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole texts as PNG: ``doc_id``, ``n_bytes`` (unpadded), ``media binary``.

    No shuffle, a row at a time. Null text counts as empty and becomes one row of zeros. Equal texts give equal bytes. Ids
    may be null or repeat. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            sizes, media = [], []
            for text in batch.column(1):
                size, payload = padded(text.as_py())
                sizes.append(size)
                media.append(encode_png(np.frombuffer(payload, "u1").reshape(-1, WIDTH)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, media binary")


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def from_media(media: DataFrame, payloads: bool = True) -> DataFrame:
    """Read images back, with all checksum tests, and compute features from the samples.

    Adds to the rows of ``to_media``: ``payload binary`` (unless ``payloads`` is False), its size, SHA-256 and the CRC-32 of its
    last 64 bytes, and ``feature binary``, the low-frequency hash. A damaged image fails the job; a null one gives nulls.
    """
    names = ["doc_id", "n_bytes", "media", *(["payload"] if payloads else []), "payload_bytes", "payload_sha256", "tail_crc32", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            out: dict[str, list] = {n: [] for n in names[3:]}
            for data in batch.column(2):
                samples = None if data.as_py() is None else decode_png(data.as_py())
                payload = None if samples is None else samples.tobytes()
                found = {} if payload is None else {"payload": payload, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]), "feature": low_frequency_hash(samples)}
                for n, column in out.items():
                    column.append(found.get(n))
            kinds = {"payload": pa.binary(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "feature": pa.binary()}
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, kinds[n]) for n, v in out.items())], names=names)

    kinds = {"payload": "binary", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "feature": "binary"}
    schema = f"doc_id {media.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary, " + ", ".join(f"{n} {kinds[n]}" for n in names[3:])
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def distance(a: Column, b: Column) -> Column:
    """Differing bits of two features."""
    as_long = lambda c: F.conv(F.hex(c), 16, 10).cast("decimal(20,0)")
    signed = lambda c: F.when(as_long(c) >= F.lit(1 << 63).cast("decimal(20,0)"), as_long(c) - F.lit(1 << 64).cast("decimal(21,0)")).otherwise(as_long(c)).cast("long")
    return F.bit_count(signed(a).bitwiseXOR(signed(b)))
