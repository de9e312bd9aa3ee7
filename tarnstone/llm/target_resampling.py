"""Importance resampling towards a target distribution, long texts in overlapping chunks.

Features are all runs of one to three words, hashed to buckets. A bucket's gain is the log ratio of how often the target
texts and all texts have it; a document weighs the sum of its features' gains, and Gumbel noise drawn from its id makes the
best scores a sample by weight. A text longer than ``CHUNK`` bytes is split at word boundaries: a chunk carries the two words
that follow it and owns the features that start in it, so that every feature counts once. The chunks are dealt to all tasks,
whatever text they come from, and their counts and weights are summed by document.

Counts are summed per task and then by bucket; the gains are a vector of ``BUCKETS`` numbers that every task gets. Ranks are given
across ranges of scores, each behind the number of rows in those before it, so that no task sees all rows.

Defined cases: null and blank texts have no features and weigh 0. Repeated rows are rows of their own: they score alike and are
drawn or not by place. A row without a doc_id is hashed as an empty id, and comes last among equal scores. Equal scores: the smaller doc_id first. An
empty table gives an empty result; with no target text every gain follows from T = 0. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, slices, spread

BUCKETS = 10_000
#: Words of the longest feature.
LONGEST = 3
#: Bytes of a chunk, on average.
CHUNK = 1 << 16
#: Bytes of texts that are taken out of Arrow at a time.
SLICE = 1 << 22
#: Rows that are ranked in one range, on average.
RANKED = 500_000

#: Bytes to themselves in words (A to Z in lower case), to a space between words.
_FOLD = bytes((b | 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def to_words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def chunks(text: bytes, size: int):
    """(chunk, owned) of a text: its words joined by spaces, the next LONGEST - 1 words carried behind the owned ones."""
    words = to_words(text)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    at = 0
    while at < len(words):
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
        upto = max(upto, at + 1)
        yield b" ".join(words[at : upto + LONGEST - 1]), upto - at
        at = upto


def features(texts: list[bytes], owned: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of features by their first word (words x LONGEST), which of them there are, and the texts' word offsets.

    A chunk has the features of its first ``owned`` words; None: of all.
    """
    lists = [to_words(t) for t in texts]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    words = [w for x in lists for w in x]
    n = len(words)
    at = np.arange(n)
    end = np.repeat(offsets[1:], sizes)
    own = np.repeat(offsets[:-1] + [s if o is None else o for s, o in zip(sizes.tolist(), owned, strict=True)], sizes) if n else end
    buckets, there = np.zeros((n, LONGEST), np.int64), np.zeros((n, LONGEST), bool)
    spaced = [b" " + w for w in words]
    crc = list(map(zlib.crc32, words))
    for k in range(LONGEST):  # a feature's hash goes on from that of the feature one word shorter
        if k:
            crc = list(map(zlib.crc32, spaced[k:], crc[: n - k]))
        held = max(0, n - k)
        buckets[:held, k] = np.fromiter(crc, np.int64, held) % BUCKETS
        there[:, k] = (at + k < end) & (at < own)
    return buckets, there, offsets


def _units(batch: pa.RecordBatch, text: int, own: int | None):
    """Row ranges of a bounded number of bytes, with the features of their texts."""
    column = pc.fill_null(batch.column(text).cast(pa.binary()), b"")
    for lo, hi in slices(pc.binary_length(column).to_pylist(), SLICE):
        owned = [None] * (hi - lo) if own is None else batch.column(own).slice(lo, hi - lo).to_pylist()
        yield lo, hi, *features(column.slice(lo, hi - lo).to_pylist(), owned)


class Texts:
    """Texts as units of bounded size: short texts where they are, the chunks of long ones in a written table dealt to all tasks."""

    def __init__(self, texts: DataFrame, chunk: int = CHUNK):
        is_long = F.octet_length("text") > 2 * chunk
        kept = [c for c in texts.columns if c != "text"]
        self.short = spread(texts.where(~F.coalesce(is_long, F.lit(False))).select(*kept, "text"))
        long = texts.where(is_long).select(F.struct(*kept, F.monotonically_increasing_id().alias("row")).alias("of"), "text")

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    of = batch.column(0).slice(i, 1)
                    for nth, (part, owned) in enumerate(chunks(batch.column(1)[i].as_py().encode(), chunk)):
                        yield pa.RecordBatch.from_arrays([of, pa.array([nth]), pa.array([owned], pa.int32()), pa.array([part], pa.binary())], names=["of", "nth", "owned", "text"])

        of = long.schema["of"].dataType.simpleString()
        parts = long.mapInArrow(run, f"of {of}, nth long, owned int, text binary")
        self.parts = materialise(parts.repartition(parts.sparkSession.sparkContext.defaultParallelism, F.col("of.row"), "nth"), "chunks")


def bucket_counts(texts: Texts) -> tuple[np.ndarray, int]:
    """How often each bucket occurs, and their sum."""

    def counted(text, own):
        def run(batches):
            total = np.zeros(BUCKETS, np.int64)
            for batch in batches:
                for _, _, buckets, there, _ in _units(batch, text, own):
                    total += np.bincount(buckets[there], minlength=BUCKETS)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(at), "n": pa.array(total[at])})

        return run

    each = texts.short.select("text").mapInArrow(counted(0, None), "bucket long, n long").unionByName(texts.parts.select("text", "owned").mapInArrow(counted(0, 1), "bucket long, n long"))
    out = np.zeros(BUCKETS, np.int64)
    for r in each.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[r["bucket"]] = r["n"]
    return out, int(out.sum())


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of both models), by bucket, each count raised by one."""
    s_all, t_all = int(source.sum()), int(target.sum())
    one = lambda s, t: math.floor(1000 * math.log(float((t + 1) * (s_all + BUCKETS)) / float((s + 1) * (t_all + BUCKETS))))
    return np.array([one(s, t) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(texts: Texts, gain: np.ndarray) -> DataFrame:
    """The columns of each row of ``texts`` but the text, with n_words, n_features and weight."""
    shared = texts.short.sparkSession.sparkContext.broadcast(gain)  # BUCKETS numbers
    kept = texts.short.columns[:-1]
    counted = "n_words long, n_features long, weight long"

    def weighed(names, text, own):
        def run(batches):
            for batch in batches:
                found = np.zeros((3, batch.num_rows), np.int64)
                for lo, hi, buckets, there, offsets in _units(batch, text, own):
                    each = np.stack([there[:, 0], there.sum(axis=1), np.where(there, shared.value[buckets], 0).sum(axis=1)])
                    before = np.concatenate([np.zeros((3, 1), np.int64), np.cumsum(each, axis=1)], axis=1)
                    found[:, lo:hi] = before[:, offsets[1:]] - before[:, offsets[:-1]]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *map(pa.array, found)], names=[*names, "n_words", "n_features", "weight"])

        return run

    fields = lambda rows: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    short = texts.short.mapInArrow(weighed(kept, len(kept), None), f"{fields(texts.short.select(*kept))}, {counted}")
    parts = texts.parts.select("of", "text", "owned").mapInArrow(weighed(["of"], 1, 2), f"{fields(texts.parts.select('of'))}, {counted}")
    long = parts.groupBy("of").agg(*(F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")))
    return short.unionByName(long.select(*(F.col("of").getField(c).alias(c) for c in kept), "n_words", "n_features", "weight"))


def gumbel(doc_id: Column) -> Column:
    """floor(-1000 * ln(-ln(u))) with u from the id's hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit("42:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` (a written table) with ``rank`` from 1 in ``order``: dealt to ranges of the order, numbered in each behind those before it."""
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANKED))
    dealt = materialise(rows.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    counts = dealt.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return dealt.join(F.broadcast(counts), "range").select(*rows.columns, (F.col("before") + nth).alias("rank"))


def draw(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_features, weight, score and, where drawn, rank.

    Of the rows with ``least_words`` words, ``percent`` hundredths with the best scores are drawn; ``target`` has the column text.
    """
    texts = Texts(docs.select("doc_id", "text"), chunk)
    gain = gains(bucket_counts(texts)[0], bucket_counts(Texts(target.select("text"), chunk))[0])
    scored = materialise(weigh(texts, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"))), "scores")
    may = scored.where(F.col("n_words") >= least_words)
    places = ranked(may, F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    drawn = F.when(F.col("rank") <= percent * may.count() // 100, F.col("rank").cast("long"))
    columns = ("doc_id", "n_features", "weight", "score")
    return places.select(*columns, drawn.alias("rank")).unionByName(scored.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20) -> DataFrame:
    """doc_id and text of the documents that are drawn, with their ranks; rows that repeat an id share its best rank."""
    best = draw(docs, target, percent, least_words).where("rank IS NOT NULL").groupBy("doc_id").agg(F.min("rank").alias("rank"))
    return docs.select(F.col("doc_id").alias("id"), "text").join(best, F.col("id").eqNullSafe(F.col("doc_id"))).select("doc_id", "text", "rank")
