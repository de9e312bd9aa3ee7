"""Exact top-k search by a bit-sliced index.

Vectors are quantised to integers, floor(1024 x). Rows are kept in blocks; for each dimension a block holds one
bitmap per bit of the (offset) value, a bit per row. For a query, the slices of all dimensions are added with
bitmap arithmetic, each weighted by the query's value (a query value is a few shifted additions, a negative
one adds the complement), carry-save, into slices of the sum. Only the most significant slices of each dimension are
added; what the others can still contribute is bounded, and the rows that may be among the best are found by
going down the sum's slices from the most significant. Those boundary rows get their exact scores.

Queries come in blocks of a bounded number. Each block is broadcast once against all index blocks (a task keeps k rows
per query), the partial lists meet by query, and the block's result is written before the next one is read, so that
no more than one block is on the driver or on an executor. The index is written once, a file's row groups to a block, and each block of
queries is a folder of its own: going through them reads the index and shuffles nothing of it. Every row is indexed; results are exact, so recall is 1.

Rows with values beyond 31 bits are kept in blocks of their own, without slices, and scored by integers of any size.

Defined cases: vectors that are null, hold nulls or non-finite components, and rows with a null vec_id, take no part;
components of any finite size do. A score beyond the range of a long counts as the end of that range. Rows that share
a query's vec_id are its own and are no candidates. Repeated query rows (same id and vector) are one query; rows of
one id and different vectors are queries of their own, each with its ranks. Vectors of different lengths are not
compared. Equal scores: the smaller vec_id first. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh_path, materialise, spread

SCALE = 1024
#: Values of this size or more are wide: they have no slices.
WIDE = 1 << 31
#: Wide rows in a block.
WIDE_BLOCK = 1 << 12
LONG = (1 << 63) - 1
#: Rows in a block, a multiple of 64.
BLOCK = 1 << 16
#: Bytes of query vectors that are broadcast together, on average.
QUERY_BYTES = 16_000_000
#: Slices of each dimension that are added before boundary rows are resolved.
ADDED = 7


def is_wide(x: np.ndarray) -> np.ndarray:
    """Which rows of doubles have a value of WIDE or more."""
    return (np.abs(x) >= WIDE / SCALE).any(axis=1)


def quantise(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of rows that aren't wide."""
    return np.floor(SCALE * x).astype(np.int64)


def quantise_wide(x: np.ndarray) -> np.ndarray:
    """The same of any finite doubles, as Python's integers: doubles from 2 ** 53 on are integers themselves."""
    values = [int(v) * SCALE if abs(v) >= 1 << 53 else math.floor(v * SCALE) for v in x.ravel().tolist()]
    return np.array([*values, None], dtype=object)[:-1].reshape(x.shape)


def scores(exact: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of rows and a query, exactly; beyond the range of a long its end."""
    if exact.dtype != object and query.dtype != object and in_range(exact, query):
        return exact.astype(np.int64) @ query
    out: list[int] = []
    for i in range(0, len(exact), WIDE_BLOCK):
        out += [min(max(int(s), -LONG - 1), LONG) for s in exact[i : i + WIDE_BLOCK].astype(object) @ query.astype(object)]
    return np.array(out, np.int64)


def in_range(exact: np.ndarray, query: np.ndarray) -> bool:
    """Whether no sum on the way can leave the range of a long."""
    most = int(np.abs(exact).max()) if exact.size else 0
    return most * sum(abs(int(q)) for q in query) <= LONG


def to_slices(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows x dims) integers to bitmaps (dims x bits x words), most significant first; the dims' offsets; rows' padding mask."""
    n, dims = values.shape
    low = values.min(axis=0)
    u = (values - low).T
    bits = max(1, int(u.max()).bit_length())
    padded = np.zeros((dims, -(-n // 64) * 64), np.int64)
    padded[:, :n] = u
    planes = np.stack([np.packbits((padded >> b & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8") for b in range(bits - 1, -1, -1)], axis=1)
    real = np.packbits(np.arange(padded.shape[1]) < n, bitorder="little").view("<u8")
    return planes, low, real


def add_slices(columns: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Carry-save addition: ``columns[w]`` are bitmaps of weight 2**w; the sum's slices, least significant first."""
    out: list[np.ndarray] = []
    w = 0
    while w < len(columns):
        at = columns[w]
        while len(at) > 1:
            if w + 1 == len(columns):
                columns.append([])
            if len(at) >= 3:
                a, b, c = at.pop(), at.pop(), at.pop()
                ab = a ^ b
                at.append(ab ^ c)
                columns[w + 1].append((a & b) | (ab & c))
            else:
                a, b = at.pop(), at.pop()
                at.append(a ^ b)
                columns[w + 1].append(a & b)
        out.append(at[0] if at else None)
        w += 1
    return out


def count_bits(x: np.ndarray) -> int:
    return int(np.bitwise_count(x).sum())


def kth_largest(sums: list, rows: np.ndarray, k: int) -> int:
    """The k-th largest of the rows' sums, slice by slice from the most significant down."""
    sure, value = 0, 0
    among = rows  # rows that agree with the value so far
    for w in range(len(sums) - 1, -1, -1):
        ones = among & sums[w] if sums[w] is not None else np.zeros_like(among)
        n = count_bits(ones)
        if sure + n >= k:
            among, value = ones, value | 1 << w
        else:
            sure += n
            among = among & ~ones
    return value


def at_least(sums: list, rows: np.ndarray, value: int) -> np.ndarray:
    """The rows whose sum is ``value`` or more."""
    if value <= 0:
        return rows
    more, same = np.zeros_like(rows), rows
    for w in range(max(len(sums), value.bit_length()) - 1, -1, -1):
        s = sums[w] if w < len(sums) and sums[w] is not None else np.zeros_like(rows)
        if value >> w & 1:
            same = same & s
        else:
            more = more | (same & s)
            same = same & ~s
    return more | same


def candidates(planes: np.ndarray, real: np.ndarray, query: np.ndarray, k: int, added: int = ADDED) -> np.ndarray:
    """Numbers of rows that hold all of the block's k best (and ties) for ``query``."""
    bits = planes.shape[1]
    use = min(added, bits)
    columns: list[list[np.ndarray]] = [[] for _ in range(use)]
    for d in np.flatnonzero(query):
        q = abs(int(query[d]))
        for j in range(use):
            s = planes[d, j] if query[d] > 0 else ~planes[d, j]
            w = use - 1 - j
            for b in range(q.bit_length()):
                if q >> b & 1:
                    while len(columns) <= w + b:
                        columns.append([])
                    columns[w + b].append(s)
    sums = add_slices(columns)
    if count_bits(real) <= k:
        return np.flatnonzero(np.unpackbits(real.view(np.uint8), bitorder="little"))
    best = kth_largest(sums, real, k)
    # what is not added is between 0 and (2**r - 1) * sum of |query|, in units of 2**r
    r = bits - use
    slack = -(-((1 << r) - 1) * int(np.abs(query).sum()) // (1 << r))
    return np.flatnonzero(np.unpackbits(at_least(sums, real, best - slack).view(np.uint8), bitorder="little"))


def _usable(vectors: DataFrame) -> DataFrame:
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(fine)


def _matrices(batch: pa.RecordBatch, column: int):
    """(rows, matrix) of the lists of each length."""
    lists = batch.column(column)
    sizes, offsets = lists.value_lengths().to_numpy(), lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)
    for dims in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dims)
        yield at, flat[(offsets[at][:, None] + np.arange(dims)).ravel()].reshape(len(at), dims) if dims else np.empty((len(at), 0))


def build_index(vectors: DataFrame) -> DataFrame:
    """A written table of blocks from ``vectors`` (vec_id, embedding): dims, bits, ids, exact, slices and real.

    ``exact`` holds the quantised values as 32-bit integers, for boundary rows; in blocks of wide rows (bits 0) the
    components themselves.
    """

    def run(batches):
        held: dict[tuple[int, bool], list] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, x in _matrices(batch, 1):
                wide = is_wide(x)
                for kind in (False, True):
                    if (wide == kind).any():
                        key, rows = (x.shape[1], kind), wide == kind
                        held.setdefault(key, []).append((ids[at][rows], x[rows]))
                        if sum(len(i) for i, _ in held[key]) >= (WIDE_BLOCK if kind else BLOCK):
                            yield from pack(key, held, False)
        for key in list(held):
            yield from pack(key, held, True)

    def pack(key, held, last):
        dims, wide = key
        ids, x = (np.concatenate(c) for c in zip(*held.pop(key), strict=True))
        size = WIDE_BLOCK if wide else BLOCK
        for i in range(0, len(ids), size):
            if not last and i + size > len(ids):
                held[key] = [(ids[i:], x[i:])]
                return
            part, rows = ids[i : i + size], x[i : i + size]
            exact, planes, real = rows.astype("<f8"), np.empty((dims, 0, 0), np.uint64), np.empty(0, np.uint64)
            if dims and not wide:
                planes, _, real = to_slices(quantise(rows))
                exact = quantise(rows).astype("<i4")
            yield pa.RecordBatch.from_pydict({"dims": pa.array([dims], pa.int32()), "bits": pa.array([planes.shape[1]], pa.int32()), "ids": [part.tobytes()], "exact": [exact.tobytes()], "slices": [planes.tobytes()], "real": [real.tobytes()]})

    return materialise(spread(_usable(vectors)).mapInArrow(run, "dims int, bits int, ids binary, exact binary, slices binary, real binary"), "bit-slices")


def search_block(ids: np.ndarray, exact: np.ndarray, planes: np.ndarray, real: np.ndarray, queries: list, k: int):
    """(vec_ids, scores) of the k best of one block for each query (id, values)."""
    for qid, q in queries:
        rows = np.arange(len(ids))
        if planes.size and q.dtype != object and in_range(exact, q):
            # rows of the query's own id are no candidates but count among the k: make room for them
            rows = candidates(planes, real, q, k + int(np.count_nonzero(ids == qid)))
        rows = rows[ids[rows] != qid]
        score = scores(exact[rows], q)
        if len(rows) > k:
            edge = np.partition(score, len(score) - k)[len(score) - k]
            rows, score = rows[score >= edge], score[score >= edge]
        order = np.lexsort((ids[rows], ~score))[:k]
        yield ids[rows[order]], score[order]


def block_best(index: DataFrame, shared, k: int) -> DataFrame:
    """q, query_id, vec_id and score of the k best rows that each task of the index has for each of a block of queries, a broadcast list (q, id, components)."""

    def run(batches):
        asked: dict[int, list] = {}
        for q, i, x in shared.value:
            asked.setdefault(len(x), []).append((q, i, quantise_wide(x) if is_wide(x[None, :])[0] else quantise(x)))
        best: dict[int, tuple] = {}
        for batch in batches:
            for r in batch.to_pylist():
                ids, dims = np.frombuffer(r["ids"], np.int64), r["dims"]
                if dims and not r["bits"]:
                    exact = quantise_wide(np.frombuffer(r["exact"], "<f8").reshape(len(ids), dims))
                else:
                    exact = np.frombuffer(r["exact"], "<i4").reshape(len(ids), dims)
                real = np.frombuffer(r["real"], np.uint64)
                planes = np.frombuffer(r["slices"], np.uint64).reshape(dims, r["bits"], len(real))
                mine = asked.get(dims, [])
                for (q, i, _), (v, s) in zip(mine, search_block(ids, exact, planes, real, [x[1:] for x in mine], k), strict=True):
                    if q in best:
                        v, s = np.concatenate([best[q][1], v]), np.concatenate([best[q][2], s])
                        order = np.lexsort((v, ~s))[:k]
                        v, s = v[order], s[order]
                    best[q] = (i, v, s)
        for q, (i, v, s) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.full(len(v), q), np.full(len(v), i), v, s)], names=["q", "query_id", "vec_id", "score"])

    return index.mapInArrow(run, "q long, query_id long, vec_id long, score long")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows of ``vectors`` for each of ``queries`` (both vec_id, embedding)."""
    spark = vectors.sparkSession
    index = build_index(vectors)
    asked = materialise(_usable(queries).distinct().withColumn("q", F.monotonically_increasing_id()), "numbered-queries")
    fields = "vec_id long, embedding array<double>, q long"
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dims")).first()
    blocks = max(1, -(-size["n"] * max(1, size["dims"] or 1) * 8 // QUERY_BYTES))
    path, laid = fresh_path(spark, "topk"), fresh_path(spark, "queries")
    asked.withColumn("of", F.pmod(F.xxhash64("q"), F.lit(blocks))).repartition("of").write.partitionBy("of").parquet(laid)
    by_block = spark.read.schema(f"{fields}, of long").parquet(laid)
    for b in range(blocks):
        rows = by_block.where(F.col("of") == b).collect()  # a block of queries
        shared = spark.sparkContext.broadcast([(r["q"], r["vec_id"], np.array(r["embedding"], float)) for r in rows])
        ranked = block_best(index, shared, k).withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")))
        ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
        shared.destroy()
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(path)
