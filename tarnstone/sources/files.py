"""File sources: uploads of single files, ZIP batches unfolded into entries, Parquet tables by schema."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MAX_BATCH_ENTRIES, MAX_UPLOAD_BYTES
from ..functions.text import sniff_media_type

ENTRY = "array<struct<path:string,content:binary,reason:string>>"


def read_uploads(spark: SparkSession, path: str, glob: str | None = None, most: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """filename, content, byte_size, media_type and reason (why a file is refused, else null). Too large files aren't read further."""
    reader = spark.read.format("binaryFile")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return label(files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.when(F.col("length") <= most, F.col("content")).alias("content"), F.col("length").alias("byte_size")), most)


def label(files: DataFrame, most: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """Adds media_type and reason to rows (filename, content, byte_size)."""
    media = sniff_media_type(F.col("filename"), F.col("content"))
    reason = F.when(F.col("byte_size") > most, "too_large").when(F.col("media_type").isNull(), "unsupported_type")
    return files.withColumn("media_type", media).withColumn("reason", reason)


def unzip(content: Column, most_entries: int = MAX_BATCH_ENTRIES, most_bytes: int = MAX_UPLOAD_BYTES) -> Column:
    """(path, content, reason) of each entry but folders; an archive that can't be read is one entry of reason ``corrupt``."""

    def entries(data: bytes) -> list[dict]:
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                infos = [i for i in z.infolist() if not i.is_dir()]
                if len(infos) > most_entries:
                    return [{"path": None, "content": None, "reason": "too_many_entries"}]
                out = []
                for i in infos:
                    if i.file_size > most_bytes:
                        out.append({"path": i.filename, "content": None, "reason": "too_large"})
                    else:
                        body = z.read(i)
                        nested = body[:4] == b"PK\x03\x04"
                        out.append({"path": i.filename, "content": None if nested else body, "reason": "nested_zip" if nested else None})
                return out
        except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError, ValueError, OSError):
            return [{"path": None, "content": None, "reason": "corrupt"}]

    @F.pandas_udf(ENTRY)
    def run(archives: pd.Series) -> pd.Series:
        return archives.map(lambda d: entries(bytes(d)) if d is not None else None)

    return run(content)


def expand_batches(batches: DataFrame) -> DataFrame:
    """A row per entry of ``batches`` (batch_id, content): batch_id, filename, content, byte_size, media_type, reason."""
    each = batches.select("batch_id", F.explode(unzip(F.col("content"))).alias("e"))
    named = each.select("batch_id", F.coalesce("e.path", F.lit("")).alias("filename"), "e.content", F.length("e.content").cast("long").alias("byte_size"), F.col("e.reason").alias("refused"))
    return label(named).withColumn("reason", F.coalesce("refused", "reason")).drop("refused")
