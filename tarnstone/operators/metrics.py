"""Retrieval metrics over results and expected passages: outcomes, recall, MRR, nDCG, per split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLITS = ("tuning", "heldout")
NDCG_DEPTH = 10


def outcomes(items: DataFrame, results: DataFrame) -> DataFrame:
    """item_id, split, status, first_hit_rank, hit_ranks, dcg and expected_count of every item.

    ``items``: item_id, split, expected (array of hashes), unresolvable; ``results``: item_id, rank, hash. A result
    position counts whenever its hash is expected, repeated texts included.
    """
    wanted = items.select("item_id", F.explode(F.array_distinct("expected")).alias("hash"))
    hits = results.join(wanted, ["item_id", "hash"]).groupBy("item_id").agg(F.sort_array(F.collect_list("rank")).alias("hit_ranks"))  # k ranks at most
    out = items.join(hits, "item_id", "left").withColumn("hit_ranks", F.when(F.col("unresolvable") | F.col("hit_ranks").isNull(), F.array().cast("array<int>")).otherwise(F.col("hit_ranks").cast("array<int>")))
    status = F.when(F.col("unresolvable"), "unresolvable").when(F.size("hit_ranks") > 0, "hit").otherwise("miss")
    dcg = F.aggregate(F.filter("hit_ranks", lambda r: r <= NDCG_DEPTH), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    return out.select("item_id", "split", status.alias("status"), F.try_element_at("hit_ranks", F.lit(1)).alias("first_hit_rank"), "hit_ranks", dcg.alias("dcg"), F.size("expected").alias("expected_count"))


def slices(found: DataFrame) -> DataFrame:
    """split, items, recall_at_5, recall_at_10, mrr, ndcg_at_10 and unresolvable of both splits; null where a split has no item."""
    ideal = F.aggregate(F.slice(F.sequence(F.lit(1), F.lit(NDCG_DEPTH)), F.lit(1), F.least("expected_count", F.lit(NDCG_DEPTH))), F.lit(0.0), lambda s, p: s + 1 / F.log2(p + 1))
    within = lambda k: F.avg(F.coalesce((F.col("first_hit_rank") <= k).cast("double"), F.lit(0.0)))
    ndcg = F.when(ideal > 0, F.col("dcg") / ideal).otherwise(0.0)
    measured = found.where("status <> 'unresolvable'").groupBy("split").agg(F.count("*").alias("items"), within(5).alias("recall_at_5"), within(10).alias("recall_at_10"), F.avg(F.coalesce(1 / F.col("first_hit_rank"), F.lit(0.0))).alias("mrr"), F.avg(ndcg).alias("ndcg_at_10"))
    apart = found.groupBy("split").agg(F.count(F.when(F.col("status") == "unresolvable", 1)).alias("unresolvable"))
    both = found.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    return both.join(measured, "split", "left").join(apart, "split", "left").fillna({"unresolvable": 0})


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """split, metric, before, after and delta of two results of :func:`slices`."""
    long = lambda d, name: d.unpivot("split", ["recall_at_5", "recall_at_10", "mrr", "ndcg_at_10"], "metric", name)
    return long(a, "before").join(long(b, "after"), ["split", "metric"]).withColumn("delta", F.col("after") - F.col("before"))
