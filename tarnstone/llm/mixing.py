"""Mixing sources to target weights by entropy balancing.

Of all ways to give documents rates between 0 and ``most`` that make each source's expected words equal its
target, the one closest to rate 1 in relative entropy is exponentially tilted: rate = min(most, exp(l * size)),
with one multiplier l per source. The multipliers solve the convex dual; they are found by Newton steps inside
a bracket that always holds the solution. A rate depends on source and size only, so the steps run over
counted cells (source, size), not over documents; the multipliers themselves stay in a table, whatever the
number of sources. Rates become whole copies cell by cell: fractions are carried along the sizes of a source,
and what is then left of its target is made up in cells of fitting sizes. A cell's copies are dealt to its documents
in hashed buckets whose shares sum to them exactly. All of it is DataFrame operations.

Defined cases: null or blank text has size 0 and keeps one copy; a null source is a source of its own, after all
others; a null doc_id is allowed; an empty table gives an empty result. Rows that repeat doc_id and text may
differ by one copy in :func:`plan`, and share the smaller count in :func:`mix`. Extra columns of whatever name
are kept by :func:`mix` and ignored by :func:`plan`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, lookup, materialise, same

#: Rows of a cell that are ranked together, on average, in cells of up to MOST_BUCKETS times as many; larger ones have as many buckets.
RANKED, MOST_BUCKETS = 256, 1 << 16


def targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """source, source_size and target of each source of ``sizes`` (source, size).

    ``weights`` repeat along the sources by code point, null last, and share all words. A target stops at ``most``
    times its source's size and the excess goes to the others by weight: that is the water level at which
    min(most * size, level * weight) sum to all words.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # numbered across ranges of sources: within each range, behind the counts of those before it
    ranges = materialise(by_source.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()), "sources")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    counts = ranges.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    nth = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (nth % len(weights) + 1).cast("int"))
    t = materialise(ranges.join(F.broadcast(counts), "range").select("source", "source_size", w.alias("weight"), (most * F.col("source_size")).alias("cap")), "weights")
    full, level = -1, 0.0
    while True:  # a step is one aggregation; the level only rises, so sources only become full
        is_full = F.col("cap") <= level * F.col("weight")
        s = t.agg(F.sum("source_size").alias("total"), F.sum(F.when(is_full, F.col("cap")).otherwise(0.0)).alias("caps"), F.sum(F.when(is_full, 0.0).otherwise(F.col("weight"))).alias("open"), F.count(F.when(is_full, 1)).alias("full")).first()
        if not s["open"] or s["full"] == full:
            break
        full, level = s["full"], (s["total"] - s["caps"]) / s["open"]
    return t.select("source", "source_size", F.least("cap", F.lit(float(level)) * F.col("weight")).alias("target"))


def multipliers(cells: DataFrame, most: float, within: float = 1e-7, steps: int = 60) -> DataFrame:
    """source and multiplier: the dual's solution by safeguarded Newton steps, all sources at once.

    ``cells``: source, n, x (size over the source's mean size), size, target, source_size. A step is one
    aggregation over the cells; ends when each source's words are within ``within`` of its target.
    """
    ratio = F.col("target") / F.col("source_size")
    state = cells.where("size > 0").groupBy("source").agg(F.min("x").alias("xmin"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    low, high = F.when(ratio < 1, F.log(ratio) / F.col("xmin")).otherwise(0.0), F.when(ratio < 1, 0.0).otherwise(math.log(most) / F.col("xmin"))
    full = ratio > most * (1 - within)
    start = F.when(full, high).otherwise(F.log(ratio))
    state = materialise(state.select("source", "target", low.alias("low"), high.alias("high"), start.alias("l"), full.alias("done")), "multipliers")
    for _ in range(steps):
        if state.where("NOT done").isEmpty():
            break
        open_ = same(cells.select("source", "n", "size", "x"), state.where("NOT done").select("source", "l"), "source")
        e = F.exp(F.col("l") * F.col("x"))
        words = F.col("n") * F.col("size")
        sums = open_.groupBy("source").agg(F.sum(words * F.least(F.lit(float(most)), e)).alias("got"), F.sum(F.when(e < most, words * F.col("x") * e).otherwise(0.0)).alias("slope"))
        s = same(state, sums, "source", how="left")
        s = s.withColumns({"low": F.when(F.col("got") < F.col("target"), F.col("l")).otherwise(F.col("low")), "high": F.when(F.col("got") > F.col("target"), F.col("l")).otherwise(F.col("high"))})
        step = F.col("l") - (F.col("got") - F.col("target")) / F.col("slope")
        inside = (F.col("slope") > 0) & (step > F.col("low")) & (step < F.col("high"))
        near = F.col("done") | (F.abs(F.col("got") - F.col("target")) <= within * F.col("target"))
        state = materialise(s.select("source", "target", "low", "high", F.when(near, F.col("l")).when(inside, step).otherwise((F.col("low") + F.col("high")) / 2).alias("l"), near.alias("done")), "multipliers")
    return state.select("source", F.col("l").alias("multiplier"))


def _whole_copies(cells: DataFrame, most: float, passes: int = 3) -> DataFrame:
    """``cells`` (source, size, n, rate, target ...) with ``copies``, the whole number of copies of all its documents together."""
    along = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    want = F.col("n") * F.col("rate")
    top = F.floor(F.col("n") * F.lit(float(most)))
    c = cells.withColumns({"base": F.floor(want), "part": F.when(F.col("size") > 0, want - F.floor(want)).otherwise(0.0)}).withColumn("carried", F.sum("part").over(along))
    more = F.floor(F.col("carried") + 0.5) - F.floor(F.col("carried") - F.col("part") + 0.5)
    c = materialise(c.withColumn("copies", F.least(F.col("base") + more, top)).drop("base", "part", "carried"), "cells")
    for _ in range(passes):  # what is left of a target goes to the largest sizes that fit it
        left = c.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("left"))
        free = F.when(F.col("left") > 0, top - F.col("copies")).otherwise(F.col("copies"))
        d = same(c, left, "source")
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("left")) & (free > 0)
        pick = d.where(fits).groupBy("source").agg(F.max("size").alias("picked"), F.first("left").alias("left"))
        d = same(c, pick, "source", how="left")
        step = F.least(F.floor(F.abs("left") / F.col("size")), free) * F.signum("left").cast("long")
        c = materialise(d.withColumn("copies", F.col("copies") + F.when(F.col("size") == F.col("picked"), step).otherwise(0)).drop("picked", "left"), "cells")
    return c


def plan(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, text_hash, source, size, source_size, target, rate, copies."""
    sizes = materialise(docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"), F.xxhash64("text").alias("text_hash")), "sizes")
    counts = sizes.groupBy("source", "size").agg(F.count("*").alias("n"))
    aims = materialise(targets(sizes, weights, most), "targets")
    mean = sizes.groupBy("source").agg(F.avg("size").alias("mean"))
    cells = materialise(same(same(counts, aims, "source"), mean, "source").withColumn("x", F.col("size") / F.greatest("mean", F.lit(1e-9))).drop("mean"), "cells")
    tilted = same(cells, multipliers(cells, most), "source", how="left")
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("target") >= most * F.col("source_size") * (1 - 1e-7), float(most)).otherwise(F.round(F.least(F.lit(float(most)), F.exp(F.col("multiplier") * F.col("x"))), 9))
    cells = _whole_copies(tilted.withColumn("rate", rate).drop("multiplier", "x"), most)
    # a cell's copies are shared evenly; the remainder goes to rows by a hash of doc_id and text, ranked in buckets of a bounded size
    each = F.floor(F.col("copies") / F.col("n"))
    cells = materialise(cells.withColumns({"each": each, "rest": F.col("copies") - each * F.col("n"), "buckets": F.least(F.ceil(F.col("n") / RANKED), F.lit(MOST_BUCKETS))}), "cells")
    rows = lookup(sizes, cells, "source", "size").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash"), F.col("buckets")))
    group = Window.partitionBy("source", "size", "bucket")
    nth = F.row_number().over(group.orderBy(F.xxhash64(F.lit(7), "doc_id", "text_hash"), "doc_id", "text_hash"))
    rows = materialise(rows.select("doc_id", "text_hash", "source", "size", "source_size", "target", "rate", "n", "each", "rest", "bucket", nth.alias("nth")), "ranked")
    # a bucket's share of the remainder: what is due up to and with it, less what was due before it
    upto = F.sum("m").over(Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    buckets = rows.where("rest > 0").groupBy("source", "size", "bucket", "n", "rest").agg(F.count("*").alias("m")).withColumn("upto", upto)
    due = lambda c: F.expr(f"CAST(CAST(rest AS DECIMAL(19, 0)) * ({c}) DIV n AS BIGINT)")
    buckets = buckets.select("source", "size", "bucket", (due("upto") - due("upto - m")).alias("share"))
    dealt = same(rows, buckets, "source", "size", "bucket", how="left")
    return dealt.select("doc_id", "text_hash", "source", "size", "source_size", "target", "rate", (F.col("each") + F.coalesce(F.col("nth") <= F.col("share"), F.lit(False)).cast("long")).alias("copies"))


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """``docs`` with each row repeated as the mix takes it; rows with no copy go. All columns stay."""
    names = docs.columns
    taken = plan(docs, weights, most).groupBy("doc_id", "text_hash").agg(F.min("copies").alias("copies"))
    rows = docs.select(F.struct(*(docs[c] for c in names)).alias("doc"), docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("text_hash"))
    kept = same(rows, taken, "doc_id", "text_hash").where("copies > 0")
    return kept.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*(F.col("doc").getField(c).alias(c) for c in names))
