"""Snapshots bucketed by a key, so that joins on it exchange nothing."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from ..shared import delete, fresh_path


def publish(rows: DataFrame, key: str, buckets: int, path: str) -> str:
    """Write ``rows`` as a table in the session's catalog, bucketed and sorted by ``key``, with its files at ``path``; its name.

    Tables of as many buckets meet by that key where they are. One task writes a bucket, so a table has as many files.
    """
    name = f"tarnstone_{uuid.uuid4().hex}"
    rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return name


@contextlib.contextmanager
def published(spark: SparkSession, key: str, *tables: DataFrame, buckets: int | None = None) -> Iterator[list[DataFrame]]:
    """Bucketed copies of ``tables``, for as long as the block lasts."""
    n = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    made = [(publish(t, key, n, path), path) for t in tables for path in [fresh_path(spark, "bucketed")]]
    try:
        yield [spark.table(name) for name, _ in made]
    finally:
        for name, path in made:
            spark.sql(f"DROP TABLE {name}")
            delete(spark, path)
