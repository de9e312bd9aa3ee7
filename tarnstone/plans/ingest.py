"""Ingest as one plan: files to sections to chunks with derived ids, events by the way, generations flipped at the end."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ids
from ..config import ChunkingParams
from ..functions.embedding import STAMP, deterministic_embedding, embed_column
from ..operators import fts, generations, gold, reads, validate
from ..operators.chunking import chunk_column
from ..operators.parsers import SHIPPED, Plugin, parse_column
from ..shared import materialise
from ..sources import sinks
from ..sources.sinks import insert_ignore, read, read_or_empty, sweep, write_aside


def parsed(files: DataFrame, plugins: Sequence[Plugin] = SHIPPED) -> DataFrame:
    """``files`` (source_id, corpus_id, fingerprint, generation, media_type, content) with what the parsers made of them.

    status: ingested, empty or failed; failure is a struct, never an exception. The content is dropped.
    """
    p = files.withColumn("p", parse_column(F.col("media_type"), F.col("content"), plugins)).drop("content")
    p = p.select("*", "p.plugin_name", "p.plugin_version", "p.confidence", "p.candidates", "p.document", F.col("p.failure").alias("failure")).drop("p")
    found = F.when(F.col("document").isNotNull(), validate.violations(F.col("document")))
    invalid = reads.scrub_failure(F.lit("malformed"), F.lit("transform"), F.array_join(found, "; "))
    p = p.withColumn("failure", F.coalesce("failure", F.when(F.size(found) > 0, invalid)))
    status = F.when(F.col("failure").isNotNull(), "failed").when(F.size("document.sections") == 0, "empty").otherwise("ingested")
    return p.withColumn("status", status)


def sections(p: DataFrame) -> DataFrame:
    """A row per section with its id and display artifact."""
    stamp = ids.plugin_stamp(F.col("plugin_name"), F.col("plugin_version"))
    each = p.where("status = 'ingested'").select("source_id", "generation", "fingerprint", stamp.alias("stamp"), F.col("document.artifacts").alias("artifacts"), F.explode("document.sections").alias("s"))
    shown = F.try_element_at(F.filter("artifacts", lambda a: a["id"] == F.col("s.anchor.artifact_id")), F.lit(1))
    return each.select(ids.section_id(F.col("fingerprint"), F.col("stamp"), F.col("generation"), F.col("s.index")).alias("id"), "source_id", "generation", F.col("s.index").alias("section_index"), "s.path", "s.kind", "s.heading", "s.content", "s.anchor", shown.alias("display_artifact"))


def chunks(p: DataFrame, params: ChunkingParams = ChunkingParams()) -> DataFrame:
    """A row per chunk with its id, section ids and anchor; not embedded yet."""
    stamp = ids.plugin_stamp(F.col("plugin_name"), F.col("plugin_version"))
    each = p.where("status = 'ingested'").select("source_id", "corpus_id", "generation", "fingerprint", "plugin_name", "plugin_version", stamp.alias("at"), F.col("document.sections").alias("sections"), F.explode(chunk_column(F.col("document.sections"), params)).alias("c"))
    chunk = ids.chunk_id(F.col("corpus_id"), F.col("fingerprint"), F.col("at"), F.col("generation"), F.col("c.chunk_index"), F.col("c.content"))
    of = F.transform("c.section_indexes", lambda i: ids.section_id(F.col("fingerprint"), F.col("at"), F.col("generation"), i))
    anchor = F.get("sections", F.col("c.anchor_section_index"))["anchor"]
    return each.select(chunk.alias("id"), "source_id", "corpus_id", "generation", "c.chunk_index", "c.content", of.alias("section_ids"), anchor.alias("anchor"), "c.oversized", "plugin_name", "plugin_version")


def embed(rows: DataFrame, existing: DataFrame, stamp: dict = STAMP, embedder: Callable = deterministic_embedding) -> DataFrame:
    """Embeds rows whose id isn't embedded yet; the vector always comes with its stamp."""
    pending = rows.join(existing.where("embedding IS NOT NULL").select("id"), "id", "left_anti")
    made = embed_column(F.col("content"), stamp["dimensions"], embedder).cast("array<float>")
    return pending.withColumn("embedding", made).withColumn("stamp", F.struct(F.lit(stamp["provider"]).alias("provider"), F.lit(stamp["model"]).alias("model"), F.lit(stamp["dimensions"]).alias("dimensions")))


#: Stages of a clean run and their events, in order; fixed values.
STEPS = (("detect", ("started", "completed")), ("extract", ("started", "completed")), ("transform", ("completed",)), ("chunk", ("started", "completed")), ("embed", ("started", "completed")), ("index", ("started", "completed")), ("commit", ("completed",)))


def events(p: DataFrame) -> DataFrame:
    """The trail of each source: source_id, ordinal, stage, event, ok, detail. A failure ends it."""
    clean = [(s, e) for s, es in STEPS for e in es]
    rows = F.array(*(F.struct(F.lit(i).alias("ordinal"), F.lit(s).alias("stage"), F.lit(e).alias("event")) for i, (s, e) in enumerate(clean)))
    upto = {s: next(i for i, (x, e) in enumerate(clean) if x == s) for s, _ in STEPS}
    at = F.lit(len(clean))
    for stage, i in upto.items():
        at = F.when(F.col("failure.stage") == stage, i + (clean[i][1] == "started")).otherwise(at)
    ended = F.when(F.col("failure").isNotNull(), F.array(F.struct(at.alias("ordinal"), F.col("failure.stage").alias("stage"), F.lit("failed").alias("event")))).otherwise(F.array().cast("array<struct<ordinal:int,stage:string,event:string>>"))
    each = p.select("source_id", "failure", F.explode(F.concat(F.slice(rows, F.lit(1), at), ended)).alias("e")).select("source_id", "e.*", "failure")
    return each.select("source_id", "ordinal", "stage", "event", (F.col("event") != "failed").alias("ok"), F.when(F.col("event") == "failed", F.col("failure.message")).alias("detail"))


def postings(rows: DataFrame, language: str = "english") -> DataFrame:
    """Postings of chunks as they are stored: by part and lexeme, with the source and generation that make them visible."""
    return fts.stored(fts.postings(rows.select(F.col("id").alias("chunk_id"), "content", "source_id", "generation"), language))


def ingest(files: DataFrame, store: str, params: ChunkingParams = ChunkingParams(), plugins: Sequence[Plugin] = SHIPPED, embedder: Callable = deterministic_embedding, stamp: dict = STAMP, language: str = "english") -> dict[str, int]:
    """Run over ``files`` into the folder ``store``: sections, chunks, postings, stamps, events, then the pointer table ``sources``; what the
    generations now visible replace is swept. Each step is made once and written; runs have folders of their own on the way.

    Repeating a run is a no-op: ids are derived, so inserts conflict and the pointer comes out the same.
    """
    spark = files.sparkSession
    p = materialise(parsed(files, plugins), "parsed")
    counts = {"sections": insert_ignore(sections(p), f"{store}/document_sections")["inserted"]}
    fresh = materialise(chunks(p, params), "chunks")
    typed = fresh.limit(0).withColumn("embedding", F.array().cast("array<float>")).withColumn("stamp", F.struct(*(F.lit(v).alias(k) for k, v in stamp.items())))
    none = spark.createDataFrame([], typed.schema)
    counts |= insert_ignore(fresh, f"{store}/chunks", "id", lambda new: embed(new, none, stamp, embedder))
    fresh_ids = fresh.select("id", "content", "source_id", "generation")

    def post(seen: sinks.State):
        old = sinks.read_state(spark, f"{store}/postings", seen)
        new = fresh_ids if old is None else fresh_ids.join(old.select(F.col("chunk_id").alias("id")).distinct(), "id", "left_anti")
        name = write_aside(postings(materialise(new, "to-post"), language), f"{store}/postings", "part")
        return [*seen.folders, name], [name]

    sinks.attempt(spark, f"{store}/postings", post)
    sinks.compact(spark, f"{store}/postings", "part")
    sinks.append(events(p), f"{store}/ingestion_events")
    heads = p.select(F.col("source_id").alias("id"), "corpus_id", "fingerprint", "plugin_name", "plugin_version", "status", F.col("failure").alias("last_error"))
    ready = p.where("status <> 'failed'").select("source_id", "generation", F.size("document.sections").alias("sections"))

    def point(known: DataFrame | None) -> DataFrame:
        """Only this run's heads are appended, whatever others have committed since it began."""
        at = heads.withColumn("current_generation", F.lit(None).cast("int")) if known is None else heads.join(known.select("id", "current_generation"), "id", "left")
        return generations.flip(at, ready).select(*heads.columns, "current_generation")

    sinks.upsert(spark, f"{store}/sources", "id", point)
    after = materialise(read(spark, f"{store}/sources"), "heads")
    for name in ("document_sections", "chunks", "postings"):
        counts[f"swept_{name}"] = sweep(f"{store}/{name}", spark, after)
    of_chunks = fresh.groupBy("source_id").agg(F.count("*").alias("chunks"))
    made = materialise(ready.join(of_chunks, "source_id", "left").select(F.col("source_id").alias("id"), "generation", F.col("sections").cast("long").alias("sections"), F.coalesce("chunks", F.lit(0)).alias("chunks")), "counts")

    def count(held: DataFrame | None) -> DataFrame:
        """What this run made replaces what was counted of older generations; nothing else is counted again."""
        known = made.withColumn("known", F.lit(None).cast("int")) if held is None else made.join(held.select("id", F.col("generation").alias("known")), "id", "left")
        return known.where("sections > 0 AND (known IS NULL OR known < generation)").drop("known")

    sinks.upsert(spark, f"{store}/source_counts", "id", count, "id string, generation int, sections bigint, chunks bigint")

    def stamps(_: DataFrame | None) -> DataFrame:
        held = gold.current(read_or_empty(spark, f"{store}/chunks", typed), read(spark, f"{store}/sources"))
        return held.where("stamp IS NOT NULL").select("stamp").distinct()

    sinks.update(spark, f"{store}/stamps", stamps)
    return counts
