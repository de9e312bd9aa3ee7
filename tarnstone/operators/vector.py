"""Exact vector search. Vectors are stored at length one, so cosine similarity is one dot product."""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import EngineError
from ..functions.vectors import cosine
from ..shared import fresh_path, materialise
from .fusion import ranked

#: Bytes of query vectors that are broadcast at once; more queries are taken in blocks.
QUERY_BYTES = 16_000_000


def check_stamp(chunks: DataFrame, stamp: dict) -> bool:
    """Whether there are embedded rows at all; refuses if any row's stamp (provider, model, dimensions) differs.

    ``chunks`` is what holds the stamps: the embedded rows, or the table of different stamps that an ingest keeps.
    """
    held = chunks.where(F.col("embedding").isNotNull()) if "embedding" in chunks.columns else chunks
    seen = held.select("stamp.*").distinct().limit(3).collect()
    for row in seen:
        if row.asDict() != stamp:
            raise EngineError("validation_error", f"the corpus is embedded with {json.dumps(row.asDict())}, the query with {json.dumps(stamp)}", "embedding")
    return bool(seen)


def stamp_refusals(chunks: DataFrame, stamp: dict, *by: str) -> DataFrame:
    """What :func:`check_stamp` says of many corpora at once: ``by``, embedded (how many rows) and refusal, null where a question of that stamp may be asked."""
    held = chunks.where("stamp IS NOT NULL")
    other = F.to_json(F.col("stamp"))
    asked = F.to_json(F.struct(*(F.lit(stamp[k]).cast(t).alias(k) for k, t in (("provider", "string"), ("model", "string"), ("dimensions", "int")))))
    differs = F.min(F.when(other != asked, other))  # the first of those that differ
    said = F.when(differs.isNotNull(), F.concat(F.lit("the corpus is embedded with "), differs, F.lit(", the query with "), asked))
    return held.groupBy(*by).agg(F.count("*").alias("embedded"), said.alias("refusal"))


#: Similarities that a task holds at once, rows of what it sends at once.
TILE, SENT = 2_000_000, 100_000


class _Best:
    """Of each query, the rows so far that may be among its ``depth`` best by score, then chunk_id; scores will be rounded to ``digits``.

    A rounded score is told by its number of units. Where rounding could go either way, a row counts for others as the lower one and is kept
    as the higher one, so none is lost; all other ties are cut by id, so that what is held stays bounded.
    """

    def __init__(self, queries: int, floor: float, depth: int, digits: int | None):
        self.depth, self.unit = depth, None if digits is None else 10.0**digits
        self.unsure = None if digits is None else max(1e-4, self.unit * 1e-15)  # units by which a product may be off
        self.least = np.full(queries, floor if digits is None else floor - 1 / self.unit)  # scores below can't be kept
        self.held, self.new, self.parts = 0, 0, []

    def take(self, sim: np.ndarray, fine: np.ndarray, ids: pa.Array) -> None:
        r, q = np.nonzero((sim >= self.least) & fine[:, None])
        if len(r):
            self.parts.append((q, ids.take(pa.array(r)), sim[r, q]))
            self.new += len(r)
            if self.new > max(self.held, len(self.least) * min(self.depth, 100)):
                self._cut()

    def _cut(self) -> None:
        query = np.concatenate([p[0] for p in self.parts])
        chunk, score = pa.concat_arrays([p[1] for p in self.parts]), np.concatenate([p[2] for p in self.parts])
        low = high = score
        if self.unit is not None:
            units = score * self.unit
            low, high = np.floor(units + 0.5 - self.unsure), np.floor(units + 0.5 + self.unsure)
        table = pa.table({"query": query, "low": low, "chunk": chunk})
        order = pc.sort_indices(table, [("query", "ascending"), ("low", "descending"), ("chunk", "ascending")], null_placement="at_start").to_numpy()
        query, low, high = query[order], low[order], high[order]
        begin = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
        size = np.diff(np.append(begin, len(query)))
        nth = np.arange(len(query)) - np.repeat(begin, size)
        full = size >= self.depth
        last = np.where(full, low[np.minimum(begin + self.depth - 1, len(low) - 1)], -np.inf)
        keep = (nth < self.depth) | (low != high) & (high >= np.repeat(last, size))
        least = last[full] if self.unit is None else (last[full] - 0.5 - 2 * self.unsure) / self.unit
        self.least[query[begin][full]] = np.maximum(self.least[query[begin][full]], least)
        order = order[keep]
        self.parts = [(query[keep], chunk.take(pa.array(order)), score[order])]
        self.held, self.new = len(order), 0

    def lists(self):
        """Queries' numbers, chunk_ids and scores."""
        if self.parts:
            self._cut()
            query, chunk, score = self.parts[0]
            for at in range(0, len(query), SENT):
                yield pa.array(query[at : at + SENT]), chunk[at : at + SENT], pa.array(score[at : at + SENT])


def similarities(chunks: DataFrame, queries: DataFrame, floor: float, depth: int, digits: int | None = None) -> DataFrame:
    """query_id, chunk_id, score and rank of each query's ``depth`` best rows at or above ``floor``; scores are rounded first, if ``digits`` are given.

    ``chunks``: chunk_id and embedding; ``queries``: query_id and embedding. Queries are broadcast in blocks of a
    bounded size; each task multiplies slices of its rows with a block and keeps the ``depth`` best so far per query (:class:`_Best`), so
    what it holds is bounded and what is shuffled is a list per query and task. Where there are several blocks, each one's result is written before the next
    is read. Vectors that are null, hold nulls or components that aren't finite, have length zero or another number of components take no part.
    """
    usable = queries.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select("query_id", "embedding")
    count = usable.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dims")).first()
    blocks = max(1, -(-count["n"] * 8 * (count["dims"] or 1) // QUERY_BYTES))
    spark = chunks.sparkSession
    sc, path = spark.sparkContext, fresh_path(spark, "similarities")
    kind, of = dict(queries.dtypes)["query_id"], dict(chunks.dtypes)["chunk_id"]
    kind = "bigint" if kind == "int" else kind
    if blocks > 1:
        usable = materialise(usable.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).repartition("block").sortWithinPartitions("block"), "asked")
    for b in range(blocks):
        part = (usable if blocks == 1 else usable.where(F.col("block") == b)).collect()  # a block of queries
        by_size: dict[int, tuple[list, list]] = {}
        for r in part:
            if all(x is not None and math.isfinite(x) for x in r["embedding"]) and any(r["embedding"]):
                ids, rows = by_size.setdefault(len(r["embedding"]), ([], []))
                ids.append(r["query_id"])
                rows.append(r["embedding"])
        asked = {}
        for dims, (ids, rows) in by_size.items():
            m = np.array(rows, float)
            asked[dims] = (pa.array(ids, pa.int64() if kind == "bigint" else pa.string()), m / np.sqrt((m * m).sum(axis=1))[:, None])
        shared = sc.broadcast(asked)

        def run(batches, shared=shared):
            best = {dims: _Best(len(ids), floor, depth, digits) for dims, (ids, _) in shared.value.items()}
            for batch in batches:
                for dims, (_, m) in shared.value.items():
                    lists = batch.column(1)
                    fit = pc.fill_null(pc.equal(pc.list_value_length(lists), dims), False)
                    lists, chunk_ids = lists.filter(fit), batch.column(0).filter(fit)
                    step = max(1, TILE // len(m))
                    for at in range(0, len(lists), step):
                        rows = pc.fill_null(lists[at : at + step].flatten(), float("nan")).to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
                        lengths = np.sqrt((rows * rows).sum(axis=1))
                        fine = np.isfinite(lengths) & (lengths > 0)
                        sim = (np.where(fine[:, None], rows, 0) @ m.T) / np.where(fine, lengths, 1)[:, None]
                        best[dims].take(sim, fine, chunk_ids[at : at + step])
            for dims, (ids, _) in shared.value.items():
                for query, chunk, score in best[dims].lists():
                    yield pa.RecordBatch.from_arrays([ids.take(query), chunk, score], names=["query_id", "chunk_id", "score"])

        got = chunks.select("chunk_id", "embedding").mapInArrow(run, f"query_id {kind}, chunk_id {of}, score double")
        if digits is not None:
            got = got.withColumn("score", F.round("score", digits))
        best = ranked(got.where(F.col("score") >= floor), depth)
        if blocks == 1:
            return best
        best.write.mode("append").parquet(path)
        shared.destroy()
    return spark.read.schema(f"query_id {kind}, chunk_id {of}, score double, rank int").parquet(path)


#: Bytes of queries that the plan of expressions takes.
FEW_BYTES = 8_000_000


def similarities_sql(chunks: DataFrame, queries: DataFrame, floor: float, depth: int, digits: int | None = None) -> DataFrame:
    """The same as a plan of expressions alone, for queries of FEW_BYTES at most, which meet all rows by broadcast; more go to :func:`similarities`.

    The floor is applied to the ranked rows, which gives the same rows: before, it would become a join condition and each cosine be taken twice.
    """
    size = queries.agg(F.sum(F.lit(16) + F.lit(8) * F.size("embedding")).alias("bytes")).first()["bytes"] or 0
    if size > FEW_BYTES:
        return similarities(chunks, queries, floor, depth, digits)
    usable = lambda c: F.coalesce(F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(c, lambda x: x != 0), F.lit(False))
    q = F.broadcast(queries.where(usable("embedding")).select("query_id", F.col("embedding").alias("q"), F.size("embedding").alias("dims")))
    sim = cosine(F.col("embedding"), F.col("q"))
    rows = chunks.where(usable("embedding")).select("chunk_id", "embedding", F.size("embedding").alias("dims"))
    scored = rows.join(q, "dims").select("query_id", "chunk_id", (F.round(sim, digits) if digits is not None else sim).alias("score"))
    return ranked(scored, depth).where(F.col("score") >= floor)


def read_back(vectors: DataFrame, probes: DataFrame | list[float], stamp: dict | None = None) -> DataFrame:
    """The nearest vector of the same stamp and its cosine distance, of one probe; or of each of a table's (query_id, embedding), with that id.

    A probe of a table without a neighbour has no row.
    """
    same = vectors if stamp is None else vectors.where((F.col("stamp.provider") == stamp["provider"]) & (F.col("stamp.model") == stamp["model"]) & (F.col("stamp.dimensions") == stamp["dimensions"]))
    if isinstance(probes, DataFrame):
        near = similarities(same.select(F.col("id").alias("chunk_id"), "embedding"), probes, -1.0, 1, digits=12)
        return near.select("query_id", F.col("chunk_id").alias("id"), (1 - F.col("score")).alias("distance"))
    distance = 1 - cosine(F.col("embedding"), F.array(*map(F.lit, map(float, probes))))
    return same.select("id", distance.alias("distance")).orderBy("distance", "id").limit(1)


# --- stored vectors by pivot ---------------------------------------------------------------------

#: Pivots at most, and vectors of a block on average.
PIVOTS, BLOCK = 512, 2048


def _units(lists: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have a usable vector of that length, and the vectors at length one."""
    fit = pc.fill_null(pc.equal(pc.list_value_length(lists), dims), False)
    rows = pc.fill_null(lists.filter(fit).flatten(), float("nan")).to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
    lengths = np.sqrt((rows * rows).sum(axis=1))
    at = np.flatnonzero(fit.to_numpy(zero_copy_only=False))
    fine = np.isfinite(lengths) & (lengths > 0)
    return at[fine], rows[fine] / lengths[fine, None]


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32()), pa.array(rows.ravel()))


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


class PivotIndex:
    """Vectors of one length stored beside their nearest pivots, for exact search that skips blocks.

    Pivots are vectors drawn by a hash of their ids, the square root of as many as there are, PIVOTS at most. A block is a range of vectors of
    about one pivot and angle. Angles obey the triangle inequality, so no vector of a block with angles from ``near`` to ``far`` of its pivot is
    closer to a question than the question's own angle to the pivot allows; blocks beyond the last of a question's best so far are never read for it.
    Results are those of :func:`similarities`, up to rounding of the last digits; unusable vectors are left out.
    """

    def __init__(self, chunks: DataFrame, dims: int, pivots: int | None = None, block: int = BLOCK):
        self.dims, self.kind = dims, dict(chunks.dtypes)["chunk_id"]
        spark, total = chunks.sparkSession, chunks.count()
        wanted = pivots or min(PIVOTS, max(1, int(total**0.5)))
        drawn = chunks.where(F.size("embedding") == dims).orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(wanted).select(F.col("embedding").cast("array<double>")).toArrow()
        centres = _units(drawn.column(0).combine_chunks(), dims)[1] if drawn.num_rows else np.empty((0, dims))
        self.centres = centres if len(centres) else np.eye(1, dims)
        shared = spark.sparkContext.broadcast(self.centres)  # ``wanted`` vectors

        def place(batches):
            for batch in batches:
                at, rows = _units(batch.column(1), dims)
                if len(at):
                    angle = _angles(rows, shared.value)
                    nearest = angle.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(nearest, pa.int32()), pa.array(angle[np.arange(len(at)), nearest]), batch.column(0).take(pa.array(at)), _lists(rows)], names=["pivot", "angle", "chunk_id", "embedding"])

        placed = materialise(chunks.select("chunk_id", F.col("embedding").cast("array<double>")).mapInArrow(place, f"pivot int, angle double, chunk_id {self.kind}, embedding array<double>"), "placed")
        dealt = placed.repartitionByRange(max(1, -(-total // block)), "pivot", "angle", "chunk_id").withColumn("range", F.spark_partition_id())
        self.vectors = materialise(dealt, "by-pivot")
        self.blocks = materialise(self.vectors.groupBy("range", "pivot").agg(F.min("angle").alias("near"), F.max("angle").alias("far"), F.count("*").alias("n")), "pivot-blocks")

    def _score(self, pairs: DataFrame, questions: DataFrame) -> DataFrame:
        """query_id, chunk_id and score of the vectors of blocks beside questions: ``pairs`` (query_id, range, pivot)."""
        rows = self.vectors.join(pairs, ["range", "pivot"]).join(questions, "query_id")
        return rows.select("query_id", "chunk_id", F.aggregate(F.zip_with("embedding", "unit", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x).alias("score"))

    def search(self, queries: DataFrame, floor: float, depth: int) -> tuple[DataFrame, dict[str, int]]:
        """query_id, chunk_id, score and rank of each query's ``depth`` best at or above ``floor``; and how many blocks of how many were read, summed over queries."""
        spark, dims, shared = queries.sparkSession, self.dims, queries.sparkSession.sparkContext.broadcast(self.centres)
        kind = dict(queries.dtypes)["query_id"]

        def place(batches):
            for batch in batches:
                at, rows = _units(batch.column(1), dims)
                if len(at):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), _lists(rows), _lists(_angles(rows, shared.value))], names=["query_id", "unit", "angles"])

        asked = queries.select("query_id", F.col("embedding").cast("array<double>")).mapInArrow(place, f"query_id {kind}, unit array<double>, angles array<double>")
        asked = materialise(asked, "placed-queries")
        units = asked.select("query_id", "unit")
        # each question meets the blocks' bounds, not their vectors; a block's row is its range, pivot and two angles
        bounds = asked.select("query_id", F.posexplode("angles").alias("pivot", "at")).join(F.broadcast(self.blocks), "pivot")
        least = F.greatest(F.col("near") - F.col("at"), F.col("at") - F.col("far"), F.lit(0.0))
        bounds = bounds.select("query_id", "range", "pivot", "n", least.alias("least"), F.abs(F.col("at") - (F.col("near") + F.col("far")) / 2).alias("middle"))
        upto = Window.partitionBy("query_id").orderBy("least", "middle", "range", "pivot").rowsBetween(Window.unboundedPreceding, -1)
        bounds = materialise(bounds.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))), "bounds")
        first = bounds.where(F.col("before") < depth)
        known = materialise(ranked(self._score(first.select("query_id", "range", "pivot"), units), depth), "first-best")
        edge = known.groupBy("query_id").agg(F.count("*").alias("held"), F.min("score").alias("edge"))
        # a score is the cosine of an angle of ``least`` at least; what is lost in rounding is far below the margin
        can = F.cos("least") + 1e-9
        still = bounds.where(F.col("before") >= depth).join(edge, "query_id", "left").where((can >= floor) & ((F.coalesce("held", F.lit(0)) < depth) | (can >= F.col("edge"))))
        still = materialise(still.select("query_id", "range", "pivot"), "second")
        best = ranked(known.drop("rank").unionByName(self._score(still, units)).where(F.col("score") >= floor), depth)
        return best, {"read": first.count() + still.count(), "blocks": bounds.count()}
