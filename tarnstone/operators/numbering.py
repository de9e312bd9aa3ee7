"""Consecutive numbers within keys, however many rows a key has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import materialise


def numbered(rows: DataFrame, name: str, by: list[str], *order: Column) -> DataFrame:
    """``rows`` with a column ``name``: 1, 2, 3 ... along ``order`` within each key ``by``; null is a key like any other.

    Rows are dealt to ranges of key and order, so a large key takes several tasks; each numbers its own behind the counts of the
    ranges before it. Ties are numbered in any order, but the same one for all readers of the result.
    """
    dealt = materialise(rows.repartitionByRange(*(F.col(c) for c in by), *order).withColumn("_range", F.spark_partition_id()), "ranges")
    key = F.struct(F.lit(0).alias("_"), *by)
    dealt = dealt.withColumn("_key", key)
    upto = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range that a key is in
    counts = dealt.groupBy("_range", "_key").agg(F.count("*").alias("_n")).select(F.col("_range").alias("_r"), F.col("_key").alias("_k"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    local = dealt.withColumn("_nth", F.row_number().over(Window.partitionBy("_range", "_key").orderBy(*order)))
    found = local.join(counts, (F.col("_range") == F.col("_r")) & F.col("_key").eqNullSafe(F.col("_k")))
    return found.select(*rows.columns, (F.col("_before") + F.col("_nth")).alias(name))
