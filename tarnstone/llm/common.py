"""What the operators of this subpackage share: the shared folder, written tables, text slices."""

from __future__ import annotations

import contextlib
import contextvars
import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves in local mode; on a cluster that is an error,
    as no machine's own folder is visible to the others.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:  # with its file system spelt out, as Arrow doesn't know Spark's default one
        where = spark._jvm.org.apache.hadoop.fs.Path(at)
        return re.sub("^file:/+", "file:///", where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()).rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/tarnstone-shared"


#: Paths handed out to the owner that is at work here; threads have owners of their own.
_owned: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("owned", default=None)


@contextlib.contextmanager
def owned():
    """The list of what is written to the shared folder by this thread within the block, for :func:`clean`."""
    paths: list[str] = []
    before = _owned.set(paths)
    try:
        yield paths
    finally:
        _owned.reset(before)


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tarnstone/{name}-{uuid.uuid4().hex}"
    if (paths := _owned.get()) is not None:
        paths.append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession, paths: list[str], *keep: DataFrame) -> None:
    """Delete the tables of an owner (:func:`owned`), but for those that ``keep`` scans; other owners' tables stay.

    Call it once the results of the operators used are written elsewhere: they read these tables.
    """
    kept = {f.rpartition("/")[0].split("/tarnstone/")[-1] for df in keep for f in df.inputFiles()}
    hadoop = spark._jvm.org.apache.hadoop.fs
    for path in list(paths):
        if path.split("/tarnstone/")[-1] not in kept:
            where = hadoop.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            paths.remove(path)


def ascii_lower(c: Column) -> Column:
    """Lower-case A to Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: A key is heavy if it has at least 1 / HEAVY of the rows: no more than so many keys are.
HEAVY = 1024


def same(a: DataFrame, b: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """Join on ``keys`` of the same names, null equal to null; the keys of ``b`` go."""
    b = b.withColumnsRenamed({k: f"{k}_of_b" for k in keys})
    on = reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[f"{k}_of_b"]) for k in keys))
    return a.join(b, on, how).drop(*(f"{k}_of_b" for k in keys))


def lookup(rows: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """Inner join of ``rows`` with ``found``, which has few rows of each key, null equal to null.

    Heavy keys' rows of ``found`` are broadcast (those of HEAVY keys at most), so that a common key's rows aren't
    brought together; the other keys are shuffled. The keys have the same types on both sides. ``rows`` is read
    four times, so it should be a written table or cheap.
    """
    total, key = rows.count(), F.xxhash64(*keys)
    heavy = [r["key"] for r in rows.groupBy(key.alias("key")).agg(F.count("*").alias("n_of_key")).where(F.col("n_of_key") * HEAVY >= total).collect()]  # HEAVY at most
    if not heavy:
        return same(rows, found, *keys)
    hot = key.isin(heavy)
    return same(rows.where(hot), F.broadcast(found.where(hot)), *keys).unionByName(same(rows.where(~hot), found.where(~hot), *keys))


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over as many tasks as there are cores, where a file gives fewer; at any larger size this does nothing."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(sizes, most: int):
    """Consecutive (begin, end) ranges of rows whose sizes sum to ``most`` at most, one row at least."""
    begin, held, i = 0, 0, -1
    for i, n in enumerate(sizes):
        if i > begin and held + n > most:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin <= i:
        yield begin, i + 1
