"""Token ids in Arrow files with fixed-size-list batches.

The documents are dealt out by ranges of doc_id and each range is one shard: a file in Arrow's file format
whose batches hold ``ids``, a fixed-size list of so many unsigned integers (16 bits where the vocabulary
fits), and ``mask``, the same shape of booleans, false on the padding at a shard's end. All sequences are
equally long and lie uncompressed, so sequence k is at a known place and is read from a memory map without a
copy. Beside each shard lies an index file: doc_id, start (in the shard) and n_tokens of its documents.

A task attempt writes files of names of its own, and the manifest, a table that Spark commits, names those of the
attempt that counts; so attempts that repeat or run twice do no harm on any file system, and nothing is renamed or
replaced. :func:`sweep` deletes what no manifest names. Defined cases: null text is empty and holds the end id alone; null doc_ids come first; rows that
repeat a doc_id are each written, ordered by a hash of the text, those of one text too in any shard of their range; an
empty table gives no documents.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import slices
from .packing import SLICE, end_documents
from .tokens import encoder

#: Sequences in a batch.
ROWS = 64
MANIFEST = "shard long, file string, docs long, tokens long"
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class _Shard:
    """Writes one shard: sequences as they fill, and the index."""

    def __init__(self, uri: str, shard: int, length: int, wide: bool):
        self.fs, self.path = _folder(uri)
        self.fs.create_dir(self.path, recursive=True)
        self.kind, self.length, self.shard = np.dtype("<u4" if wide else "<u2"), length, shard
        value = pa.uint32() if wide else pa.uint16()
        self.schema = pa.schema([("ids", pa.list_(pa.field("item", value, False), length)), ("mask", pa.list_(pa.field("item", pa.bool_(), False), length))])
        self.file = f"{shard:06d}-{uuid.uuid4().hex}"
        self.out = [self.fs.open_output_stream(self.name(x)) for x in ("ids", "index")]
        self.files = [pa.ipc.new_file(o, s) for o, s in zip(self.out, (self.schema, INDEX), strict=True)]
        self.rest, self.total, self.docs = np.empty(0, self.kind), 0, 0

    def name(self, what: str) -> str:
        return f"{self.path}/{what}-{self.file}.arrow"

    def add(self, doc_ids: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        starts = self.total + np.cumsum(sizes) - sizes
        self.files[1].write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(starts), pa.array(sizes.astype(np.int64))], schema=INDEX))
        self.total += len(ids)
        self.docs += len(sizes)
        ids = np.concatenate([self.rest, ids.astype(self.kind)])
        step = ROWS * self.length
        whole = len(ids) // step * step
        for i in range(0, whole, step):
            self.put(ids[i : i + step], step)
        self.rest = ids[whole:]

    def put(self, ids: np.ndarray, real: int) -> None:
        mask = pa.array(np.arange(len(ids)) < real)
        lists = [pa.FixedSizeListArray.from_arrays(x, type=t) for x, t in zip((pa.array(ids), mask), self.schema.types, strict=True)]
        self.files[0].write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> tuple[int, int]:
        if n := len(self.rest):
            self.put(np.pad(self.rest, (0, -n % self.length)), n)
        for f, o in zip(self.files, self.out, strict=True):
            f.close()
            o.close()
        return self.docs, self.total


class TokenFile:
    """Random access to a shard: ``sequence(k)`` and ``ids(start, n)`` are views of the memory map where they lie in one batch."""

    def __init__(self, uri: str, file: str):
        where, path = _folder(uri)
        self.open = [pa.memory_map(f"{path}/{x}-{file}.arrow") if isinstance(where, fs.LocalFileSystem) else where.open_input_file(f"{path}/{x}-{file}.arrow") for x in ("ids", "index")]
        self.file, self.index = (pa.ipc.open_file(x) for x in self.open)
        self.length = self.file.schema.field("ids").type.list_size

    def flat(self, batch: int) -> np.ndarray:
        return self.file.get_batch(batch).column(0).flatten().to_numpy(zero_copy_only=True)

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        batch = self.file.get_batch(k // ROWS)
        ids, mask = batch.column(0)[k % ROWS], batch.column(1)[k % ROWS]
        return ids.values.to_numpy(zero_copy_only=True), mask.values.to_numpy(zero_copy_only=False)

    def ids(self, start: int, n: int) -> np.ndarray:
        step = ROWS * self.length
        parts = [self.flat(b)[max(0, start - b * step) : start + n - b * step] for b in range(start // step, (start + max(n, 1) - 1) // step + 1)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def write_token_files(docs: DataFrame, tokenizer: str, path: str, length: int = 2048, end_id: int = 2) -> DataFrame:
    """Write all ``docs`` (doc_id, text) in ascending doc_id order into the shared folder ``path``; the manifest (shard, file, docs, tokens)."""

    def write(batches):
        shard = None
        for batch in batches:
            texts = batch.column(1)
            for lo, hi in slices(pc.binary_length(texts).to_pylist(), SLICE):
                enc = encoder(tokenizer)
                if shard is None:
                    shard = _Shard(path, TaskContext.get().partitionId(), length, enc.raw.get_vocab_size() > 1 << 16)
                shard.add(batch.column(0).slice(lo, hi - lo), *end_documents(*enc.encode(texts.slice(lo, hi - lo)), end_id))
        if shard is not None:
            n, total = shard.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard.shard], "file": [shard.file], "docs": [n], "tokens": [total]})

    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    ordered = rows.repartitionByRange("doc_id", "h", "row").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian, 32 bits) of every document in the files."""

    def read(batches):
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = TokenFile(path, name)
                for k in range(file.index.num_record_batches):
                    docs = file.index.get_batch(k)
                    starts, sizes = docs.column(1).to_pylist(), docs.column(2).to_pylist()
                    for lo, hi in slices(sizes, SLICE // 4):
                        ids = file.ids(starts[lo], sum(sizes[lo:hi])).astype("<u4")
                        offsets = np.cumsum([0, *sizes[lo:hi]], dtype=np.int32) * 4
                        data = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
                        yield pa.RecordBatch.from_arrays([docs.column(0).slice(lo, hi - lo), pa.array([base + x for x in starts[lo:hi]], pa.int64()), docs.column(2).slice(lo, hi - lo), data], names=["doc_id", "start", "n_tokens", "ids"])

    shards = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    placed = shards.select("file", "shard", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    # a task per shard: by number, as tasks are not to be merged for being small in rows
    return placed.repartitionByRange(max(1, shards.count()), "shard").select("file", "base").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def sweep(spark: SparkSession, path: str) -> int:
    """Delete the token and index files below ``path`` that its manifest doesn't name, left by attempts that failed; how many."""
    where, folder = _folder(path)
    named = {r["file"] for r in spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("file").toLocalIterator()}  # a row per shard
    left = [f.path for f in where.get_file_info(fs.FileSelector(folder)) if f.path.endswith(".arrow") and f.base_name.removesuffix(".arrow").partition("-")[2] not in named]
    for f in left:
        where.delete_file(f)
    return len(left)
