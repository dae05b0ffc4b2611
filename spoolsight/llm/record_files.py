"""Token ids in length-delimited binary record files, with an offset index for shuffled reads.

File format (all numbers little-endian): 16 bytes of header, ``SPLREC01``, the bytes per id (2 or 4) as unsigned 32-bit
and four bytes 0; then for each record

    length of payload in bytes     unsigned 64-bit
    masked checksum of the length  unsigned 32-bit
    payload                        the ids, unsigned, 2 or 4 bytes each
    masked checksum of the payload unsigned 32-bit

A checksum is CRC-32, masked by rotating it 15 bits to the right and adding 0xa282ead8, so that a checksum stored among
data that is itself checksummed does no harm. The index is a Parquet table with one row per record: the file, the record's
offset and length in it, its place in the file, and the number of ids in the file before it.

Files are written in the tasks, below the shared folder, each under a name of its own attempt. The index is what commits
them: it names the files of the attempts that ended well, so what a lost executor left behind is never read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoolsight.llm.byte_bpe import opened
from spoolsight.shared import new_folder, written

# Fixed values of the format.
MAGIC = b"SPLREC01"
MASK_ADD = 0xA282EAD8
HEADER = "<8sII"
LENGTH = "<QI"
CHECK = "<I"
HEADER_SIZE, LENGTH_SIZE, CHECK_SIZE = map(struct.calcsize, (HEADER, LENGTH, CHECK))
ROWS_AT_ONCE = 256
#: Bytes of text that go to one file; unsplit text of up to so many bytes is encoded in one piece.
FILE_BYTES, LEAF = 256 << 20, 4096
READ_AT_ONCE = 8 << 20


def masked(data: bytes | memoryview) -> int:
    """Masked checksum of ``data``."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_ADD) & 0xFFFFFFFF


def frame(payload: bytes | memoryview) -> bytes:
    """One record as it stands in a file."""
    size = struct.pack("<Q", len(payload))
    return b"".join((struct.pack(LENGTH, len(payload), masked(size)), payload, struct.pack(CHECK, masked(payload))))


def unframe(record: memoryview) -> memoryview:
    """The payload of a record; ValueError where a length or a checksum is wrong."""
    size, check = struct.unpack_from(LENGTH, record)
    if masked(bytes(record[:8])) != check or len(record) != LENGTH_SIZE + size + CHECK_SIZE:
        raise ValueError("damaged record length")
    payload = record[LENGTH_SIZE : LENGTH_SIZE + size]
    if masked(payload) != struct.unpack_from(CHECK, record, LENGTH_SIZE + size)[0]:
        raise ValueError("damaged record payload")
    return payload


def write_records(docs: DataFrame, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Encode whole texts and write them in ascending order of id; returns the index as a written table.

    Rows are dealt by ranges of the id into files, and sorted within each: file after file, record after record, ids ascend
    (nulls first; rows with the same id stand by a hash of their text, and may fill several files). There is a file for each
    ``FILE_BYTES`` of text, and no fewer than the session has shuffle partitions. The order is made before encoding, so that
    each text is moved once and encoded once. ``end_id`` is appended to every document; null text counts as empty. Index
    columns: doc_id, part, path, seq, offset, length, before, n_tokens.
    """
    spark = docs.sparkSession
    source = spark.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))
    folder = folder or new_folder(spark, "records")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // FILE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = opened(source.value, LEAF)
        width = 2 if len(bpe.token_bytes) <= 1 << 16 else 4
        end_mark = int(end_id).to_bytes(4, "little")
        part = TaskContext.get().partitionId()
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        path = f"part-{part:06d}-{uuid.uuid4().hex}.rec"
        out, offset, seq, before = None, HEADER_SIZE, 0, 0
        try:
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                    batch = whole.slice(at, ROWS_AT_ONCE)
                    if out is None:
                        fs.create_dir(base, recursive=True)
                        out = fs.open_output_stream(f"{base}/{path}")
                        out.write(struct.pack(HEADER, MAGIC, width, 0))
                    packed = [ids + end_mark for ids in bpe.ids_of([t or "" for t in batch.column(1).to_pylist()])]
                    counts = np.array([len(ids) // 4 for ids in packed])
                    payloads = memoryview(np.frombuffer(b"".join(packed), "<u4").astype(f"<u{width}")).cast("B")
                    ends = np.cumsum(counts)
                    records = [frame(payloads[a * width : b * width]) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                    out.write(b"".join(records))
                    lengths = np.array([len(r) for r in records])
                    n = batch.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), pa.array([part] * n, pa.int32()), pa.array([path] * n), pa.array(np.arange(seq, seq + n)), pa.array(offset + np.cumsum(lengths) - lengths), pa.array(lengths), pa.array(before + ends - counts), pa.array(counts)],
                        names=["doc_id", "part", "path", "seq", "offset", "length", "before", "n_tokens"],
                    )
                    offset, seq, before = offset + int(lengths.sum()), seq + n, before + int(ends[-1])
        finally:
            if out is not None:
                out.close()

    keyed = rows.withColumn("key", F.xxhash64("text"))
    dealt = keyed.repartitionByRange(files, "doc_id", "key").sortWithinPartitions("doc_id", "key", "text").select("doc_id", "text")
    index = dealt.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, part int, path string, seq long, offset long, length long, before long, n_tokens long")
    return written(index.withColumn("folder", F.lit(folder)), "record-index")


def read_records(index: DataFrame, summary: Callable[[np.ndarray], int] | None = None) -> DataFrame:
    """Read the records that an index, or any part of it in any order, names.

    Returns the index's doc_id, part and before with ``ids array<long>``; or, where ``summary`` is given, with ``n_tokens`` and
    the number that it makes of the ids (as unsigned 32-bit integers), so that they need not leave the task. Records that follow one another in a file are
    fetched by one read of bounded size; every length and checksum is tested.
    """

    kinds = {"doc_id": index.schema["doc_id"].dataType.simpleString(), "part": "int", "before": "long"}
    kinds |= {"ids": "array<long>"} if summary is None else {"n_tokens": "long", "summary": "long"}
    columns = list(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened_fs: dict = {}
        name, file, width = None, None, 2
        for batch in batches:
            folders, paths = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            offsets, lengths = batch.column(5).to_pylist(), batch.column(6).to_pylist()
            at = 0
            while at < batch.num_rows:
                end = at + 1
                while end < batch.num_rows and paths[end] == paths[at] and offsets[end] == offsets[end - 1] + lengths[end - 1] and offsets[end] + lengths[end] - offsets[at] <= READ_AT_ONCE:
                    end += 1
                if (folders[at], paths[at]) != name:
                    name = folders[at], paths[at]
                    if folders[at] not in opened_fs:
                        opened_fs[folders[at]] = pyarrow.fs.FileSystem.from_uri(folders[at])
                    fs, base = opened_fs[folders[at]]
                    file = fs.open_input_file(f"{base}/{paths[at]}")
                    magic, width, _ = struct.unpack(HEADER, file.read_at(HEADER_SIZE, 0))
                    if magic != MAGIC:
                        raise ValueError(f"no record file: {paths[at]}")
                block = memoryview(file.read_at(offsets[end - 1] + lengths[end - 1] - offsets[at], offsets[at]))
                ids = [np.frombuffer(unframe(block[o - offsets[at] : o - offsets[at] + n]), f"<u{width}") for o, n in zip(offsets[at:end], lengths[at:end], strict=True)]
                some = batch.slice(at, end - at)
                if summary is None:
                    ends = np.cumsum([0, *map(len, ids)]).astype("int32")
                    found = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype("i8")))]
                else:
                    found = [pa.array([len(x) for x in ids], pa.int64()), pa.array([summary(x.astype("<u4")) for x in ids], pa.int64())]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), *found], names=columns)
                at = end

    rows = index.select("doc_id", "part", "before", "folder", "path", "offset", "length")
    return rows.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in kinds.items()))


def starts(index: DataFrame) -> DataFrame:
    """Ids in all earlier files, per file: a running sum over one row per file."""
    per_file = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return per_file.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))


def digests(index: DataFrame) -> DataFrame:
    """Contract columns of the query, from the records read back. ``start`` adds the ids of all earlier files (one row a
    file, so the broadcast side is as small as the list of files) to those before it in its own file."""
    read = read_records(index, summary=zlib.crc32)
    start = (F.col("base") + F.col("before")).alias("start")
    return read.join(F.broadcast(starts(index)), "part").select("doc_id", start, "n_tokens", F.col("summary").alias("ids_crc32"))
