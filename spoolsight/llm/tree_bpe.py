"""BPE encoding and decoding by tree concatenation."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoolsight.llm.byte_bpe import opened

ROWS_AT_ONCE = 256
KEPT_PIECES = 250_000  # beside the ids and texts of a pipeline's last stage


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = 16) -> DataFrame:
    """Encode whole texts and decode the ids again.

    Returns ``doc_id``, ``ids array<int>`` and ``decoded string``. The pre-tokenizer cuts a text into pieces; a piece of over
    ``leaf`` bytes, which it leaves unsplit, is encoded by halves, and the joins are repaired by growing windows
    (``byte_bpe.tree_concat``). Special strings inside a text become special tokens, as the library does by default.

    No shuffle: rows are handled where they are read. Null text counts as empty: no ids, decoded ''. Null, repeated or
    tied ids are passed on row by row. Other columns of ``docs`` are not read, so their names cannot clash.
    """
    source = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = opened(source.value, leaf, KEPT_PIECES)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                packed = bpe.ids_of([t or "" for t in batch.column(1).to_pylist()])
                flat = np.frombuffer(b"".join(packed), "<i4")
                ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype("int32")
                ids = flat.tolist()
                decoded = [bpe.decode(ids[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>, decoded string")


def digest_columns() -> list[Column]:
    """Number of ids and digests of the ids (decimal, joined by commas) and of the decoded text."""
    return [
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    ]


def digests(encoded: DataFrame) -> DataFrame:
    """Contract columns of the query, derived from the ids and the decoded text."""
    return encoded.select("doc_id", *digest_columns())
