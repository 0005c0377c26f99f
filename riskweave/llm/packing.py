"""Packing by power-of-two decomposition: no sequence crosses documents, none needs padding."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vocabulary
from .common import remembered, table

LONGEST = 1024  # tokens of a sequence at most; a power of two
END = 0  # id that closes every document
TEXTS_AT_A_TIME = 256

_COLUMNS = "doc_id long, start long, length long, tokens binary, ids_crc32 long, doc_tokens long"
_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("tokens", pa.binary()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
    ]
)


def lengths(tokens: int, longest: int = LONGEST) -> np.ndarray:
    """Lengths of a document's pieces: as many of the longest as fit, then its binary digits."""
    whole, rest = divmod(tokens, longest)
    digits = [1 << k for k in reversed(range(longest.bit_length())) if rest >> k & 1]
    return np.array([longest] * whole + digits, dtype=np.int64)


def pack(documents: DataFrame, longest: int = LONGEST) -> DataFrame:
    """One row per piece; each piece is a sequence of its own, of a power-of-two length.

    Null and empty texts are the closing id alone. Rows that repeat a doc_id, or have none, are
    documents of their own. ``tokens`` holds the ids as little-endian unsigned 32-bit numbers.
    Sequences of one length form a bucket that a trainer reads with one batch size; ``bucket``
    writes them so. Nothing is shuffled: documents are cut where they are read, and
    ``sequence_id`` counts within the reading task.
    """

    def pieces(batches):
        encode = _encoder()
        for batch in batches:
            # A few rows at a time, so that a task never holds the pieces of a whole batch.
            for at in range(0, batch.num_rows, TEXTS_AT_A_TIME):
                yield _cut(batch.slice(at, TEXTS_AT_A_TIME), encode, longest)

    return (
        documents.select("doc_id", "text")
        .mapInArrow(pieces, _COLUMNS)
        .withColumn("sequence_id", F.monotonically_increasing_id())
        .withColumn("offset", F.lit(0).cast("long"))
    )


def bucket(packed: DataFrame, path: str) -> None:
    """Write sequences in one folder per length."""
    packed.write.partitionBy("length").parquet(path)


def _encoder() -> vocabulary.Encoder:
    return remembered(vocabulary.Encoder, vocabulary.Encoder)


def _cut(batch: pa.RecordBatch, encode: vocabulary.Encoder, longest: int) -> pa.RecordBatch:
    rows = []
    texts = [text or "" for text in batch.column("text").to_pylist()]
    for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(texts), strict=True):
        ids = np.append(ids, np.uint32(END)).astype("<u4").tobytes()
        start, total = 0, len(ids) // 4
        for length in lengths(total, longest).tolist():
            piece = ids[4 * start : 4 * (start + length)]
            rows.append((doc_id, start, length, piece, zlib.crc32(piece), total))
            start += length
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, _SCHEMA.types, strict=True)], schema=_SCHEMA
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, without the ids themselves."""
    return pack(table(spark, sf_dir, "documents", "doc_id", "text")).drop("tokens")
