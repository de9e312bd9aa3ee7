"""Admission: fingerprint, dedupe by content, first wins, everything else reported as a duplicate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialise


def admit(files: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """``files`` (corpus_id, filename, content, media_type, arrival ...) with fingerprint, first_filename and duplicate.

    Of equal content in a corpus the earliest arrival is admitted, ties to the smaller name, of rows that tie in both
    exactly one, unless ``existing`` (corpus_id, fingerprint, filename) already has it. It is decided on numbered rows
    without their content, and verdicts come back by row: broadcast where they are few, else contents are shuffled by row
    once. ``files`` should be a written table or a scan, as its rows are numbered each time it is read.
    """
    marked = files.withColumn("fingerprint", F.sha2("content", 256)).withColumn("row", F.monotonically_increasing_id())
    key = ["corpus_id", "digest"]
    digest = F.coalesce("fingerprint", F.lit("")).alias("digest")  # files without content are equal, too
    slim = materialise(marked.select("row", "corpus_id", digest, "arrival", "filename"), "admission")
    first = slim.groupBy(*key).agg(F.min(F.struct("arrival", "filename", "row")).alias("first"))
    known = F.lit(None).cast("string").alias("known")
    if existing is not None:
        first = first.join(existing.groupBy("corpus_id", digest).agg(F.min("filename").alias("known")), key, "left")
    else:
        first = first.select("*", known)
    own = (F.col("row") == F.col("first.row")) & F.col("known").isNull()
    verdicts = materialise(slim.join(first, key).select("row", F.coalesce("known", "first.filename").alias("first_filename"), (~own).alias("duplicate")), "verdicts")
    return marked.join(verdicts, "row").drop("row")


def duplicate_report(files: DataFrame) -> DataFrame:
    """Fingerprints that occur more than once, how often, and the first of them."""
    return files.groupBy("fingerprint").agg(F.count("*").alias("copies"), F.min("id").alias("first_id")).where("copies > 1")
