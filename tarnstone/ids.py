"""Derived identities: the same content at the same place always has the same id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *parts), 256)


def fingerprint(content: Column) -> Column:
    """Of an archive's bytes, or of a text's UTF-8."""
    return F.sha2(content, 256)


def plugin_stamp(name: Column, version: Column) -> Column:
    return F.concat_ws("@", name, version)


def section_id(archive: Column, stamp: Column, generation: Column, index: Column) -> Column:
    return _hash(archive, stamp, generation.cast("string"), index.cast("string"))


def chunk_id(corpus: Column, archive: Column, stamp: Column, generation: Column, index: Column, content: Column) -> Column:
    return _hash(corpus, archive, stamp, generation.cast("string"), index.cast("string"), F.sha2(content, 256))


def vector_id(text: Column, provider: Column, model: Column, dims: Column) -> Column:
    return F.sha2(F.concat(text, F.lit("\n"), F.concat_ws("/", provider, model, dims.cast("string"))), 256)
