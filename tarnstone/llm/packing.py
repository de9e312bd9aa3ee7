"""Packing by power-of-two decomposition.

A document of n ids is cut into pieces of the most tokens a sequence may have, as long as they fit, and
then into the powers of two that sum to the rest, largest first. Every piece is a sequence of its own and
equal lengths share a bucket, so no sequence crosses documents and none needs padding. Sequence ids are
numbered by bucket, so a bucket's sequences are one range of ids. There is no shuffle: each task cuts its
own documents, and a lost task repeats with the same ids.

Defined cases: null text is empty and gives the end id alone; rows that repeat are packed each on its own; a
null doc_id is carried along; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import slices
from .tokens import encoder

#: Bytes of text encoded at a time.
SLICE = 4_000_000
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, bucket int, ids binary"


def piece_lengths(n: int, most: int) -> list[int]:
    """The lengths that a document of ``n`` ids is cut into; ``most`` is a power of two."""
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 2, -1, -1) if n >> b & 1]


def end_documents(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with the end id behind each document's own, and the new sizes."""
    return np.insert(ids, np.cumsum(sizes), end_id).astype(np.uint32, copy=False), sizes + 1


def _cut(batches, path: str, most: int, end_id: int):
    part = TaskContext.get().partitionId()
    made = [0] * most.bit_length()
    for batch in batches:
        texts, doc_ids = batch.column(1), batch.column(0).to_pylist()
        for lo, hi in slices(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist(), SLICE):
            ids, sizes = end_documents(*encoder(path).encode(texts.slice(lo, hi - lo)), end_id)
            rows: tuple[list, ...] = ([], [], [], [], [], [], [])
            at = 0
            for doc_id, n in zip(doc_ids[lo:hi], sizes.tolist(), strict=True):
                start = 0
                for length in piece_lengths(n, most):
                    b = length.bit_length() - 1
                    for column, x in zip(rows, (doc_id, start, length, n, b << 56 | part << 32 | made[b], b, at + start), strict=True):
                        column.append(x)
                    made[b] += 1
                    start += length
                at += n
            doc, start, length, n, seq, bucket, begin = rows
            offsets = np.append(np.array(begin, np.int32), at).astype(np.int32) * 4
            data = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(n, pa.int64()), pa.array(seq, pa.int64()), pa.array([0] * len(doc), pa.int64()), pa.array(bucket, pa.int32()), data], names=[x.split()[0] for x in SCHEMA.split(", ")])


def pack(docs: DataFrame, tokenizer: str, most: int = 4096, end_id: int = 2) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text): a row per piece, with its ids as little-endian unsigned 32-bit integers."""
    if most < 1 or most & (most - 1):
        raise ValueError("most must be a power of two")
    return docs.select("doc_id", "text").mapInArrow(lambda b: _cut(b, tokenizer, most, end_id), SCHEMA)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder per length, so that a batch of equal-length sequences is a slice of one folder's files."""
    pieces.write.partitionBy("bucket").parquet(path)
