"""One folder of tables and all that can be done with it: admit, ingest, search, label, evaluate, look back.

Tables live below ``root`` as Parquet and change by compare-and-set. Receipts, events and evaluation states are only ever appended; labels
and heads of sources are keyed tables, of which a change appends what it changes; of an evaluation the latest state counts.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .config import ChunkingParams, RetrievalConfig
from .errors import EngineError
from .functions.embedding import STAMP, deterministic_embedding
from .operators import admit, generations, gold, metrics, parsers, reads
from .plans import ingest, search
from .shared import delete, materialise
from .sources import files as uploads
from .sources import sinks

ADMITTED = "id string, corpus_id string, batch_id string, fingerprint string, filename string, media_type string, content binary, byte_size bigint, created_at timestamp"
BATCHES = "id string, filename string, status string, entry_report array<struct<path:string,status:string,reason:string>>, created_at timestamp"
RUNS = "id string, config string, gold_snapshot string, status string, metrics string, error string, at double"
GOLD = "item_id string, question string, expected array<struct<chunk_id:string,source_id:string,content_sha256:string>>, split string, notes string, created_at timestamp"
GOLD_COLUMNS = ("item_id", "question", "expected", "split", "notes", "created_at")
CHECKS = "id string, status string, vector_id string, readback_distance double, at double"
HEADS = "id string, corpus_id string, fingerprint string, plugin_name string, plugin_version string, status string, last_error struct<class:string,stage:string,message:string>, current_generation int"


class Library:
    def __init__(self, spark: SparkSession, root: str, embedder: Callable = deterministic_embedding, stamp: dict = STAMP, plugins: Sequence[parsers.Plugin] = parsers.SHIPPED, params: ChunkingParams = ChunkingParams(), language: str = "english"):
        self.spark, self.root, self.embedder, self.stamp, self.plugins, self.params, self.language = spark, root, embedder, stamp, plugins, params, language

    def table(self, name: str, schema: str) -> DataFrame:
        return sinks.read_or_empty(self.spark, f"{self.root}/{name}", self.spark.createDataFrame([], schema))

    # --- uploads

    def upload(self, path: str, glob: str | None = None, corpus: str = "default") -> DataFrame:
        """Admit the files of ``path``; archives are unfolded. What was refused or is a duplicate, with the reason."""
        found = uploads.read_uploads(self.spark, path, glob).withColumn("batch_id", F.lit(None).cast("string"))
        archives = found.where("media_type = 'application/zip'").withColumn("batch_id", F.sha2(F.concat(F.lit(f"{corpus}:"), F.sha2("content", 256)), 256))
        entries = uploads.expand_batches(archives.select("batch_id", "content"))
        every = materialise(found.where("media_type IS NULL OR media_type <> 'application/zip'").unionByName(entries), "uploads")  # archives are unfolded once
        fine = every.where("reason IS NULL").withColumns({"corpus_id": F.lit(corpus), "arrival": F.col("filename")})
        known = self.table("admitted", ADMITTED)
        judged = admit.admit(fine, known.select("corpus_id", "fingerprint", "filename"))
        new = judged.where("NOT duplicate").select(F.sha2(F.concat_ws(":", "corpus_id", "fingerprint"), 256).alias("id"), "corpus_id", "batch_id", "fingerprint", "filename", "media_type", "content", "byte_size", F.current_timestamp().alias("created_at"))
        refused = every.where("reason IS NOT NULL").select("batch_id", "filename", "reason")
        report = refused.unionByName(judged.where("duplicate").select("batch_id", "filename", F.lit("duplicate").alias("reason")))
        told = materialise(report, "refused")
        sinks.append(told.withColumn("created_at", F.current_timestamp()), f"{self.root}/refusals")
        listed = refused.select("batch_id", "filename", F.lit("skipped").alias("status"), "reason").unionByName(judged.select("batch_id", "filename", F.when(F.col("duplicate"), "skipped").otherwise("admitted").alias("status"), F.when(F.col("duplicate"), "duplicate").alias("reason"))).where("batch_id IS NOT NULL")
        entry = F.struct(F.col("filename").alias("path"), "status", "reason")
        grouped = listed.groupBy("batch_id").agg(F.sort_array(F.collect_list(entry)).alias("entry_report"))  # as many entries as a batch may have
        state = F.when(F.exists("entry_report", lambda e: e["reason"].isin("corrupt", "too_many_entries")), "failed").when(F.exists("entry_report", lambda e: e["status"] == "admitted"), "expanded").otherwise("empty")
        names = archives.groupBy("batch_id").agg(F.min("filename").alias("filename"))
        batches = names.join(grouped, "batch_id", "left").select(F.col("batch_id").alias("id"), "filename", F.coalesce(state, F.lit("empty")).alias("status"), "entry_report", F.current_timestamp().alias("created_at"))
        sinks.insert_ignore(batches, f"{self.root}/batches")
        sinks.insert_ignore(new, f"{self.root}/admitted")
        delete(self.spark, every.inputFiles()[0].rpartition("/")[0])
        return told

    def ingest(self, again: DataFrame | None = None) -> dict[str, int]:
        """Parse, chunk and embed what isn't ingested yet, or ``again`` (source_id, target_generation)."""
        admitted, heads = self.table("admitted", ADMITTED), self.table("sources", HEADS)
        if again is None:
            todo = admitted.join(heads.select("id"), "id", "left_anti").withColumn("generation", F.lit(1))
        else:
            todo = admitted.join(again.select(F.col("source_id").alias("id"), F.col("target_generation").alias("generation")), "id")
        rows = todo.select(F.col("id").alias("source_id"), "corpus_id", "fingerprint", "generation", "media_type", "content")
        return ingest.ingest(rows, self.root, self.params, self.plugins, self.embedder, self.stamp, self.language)

    def reingest(self, plugin: str, version: str) -> dict[str, int]:
        return self.ingest(generations.to_reingest(self.table("sources", HEADS), plugin, version))

    # --- reads

    def sources(self) -> DataFrame:
        heads = self.table("sources", HEADS).select("id", F.col("status").alias("head"), "plugin_name", "plugin_version", "current_generation", "last_error")
        return self.table("admitted", ADMITTED).drop("content").join(heads, "id", "left").withColumn("status", F.coalesce("head", F.lit("queued"))).drop("head")

    def counts(self) -> DataFrame:
        """source_id, sections and chunks of each source's current generation, as commits keep them."""
        return reads.kept_counts(self.table("sources", HEADS), self.table("source_counts", "id string, generation int, sections bigint, chunks bigint"))

    def chunks(self) -> DataFrame:
        """What readers see: chunks of current generations."""
        return self._current("chunks")

    def _current(self, name: str) -> DataFrame:
        stored = sinks.read(self.spark, f"{self.root}/{name}")
        if stored is None:
            raise EngineError("not_found", "nothing has been ingested yet")
        return gold.current(stored, self.table("sources", HEADS))

    def timeline(self, limit: int | None = None, offset: int | None = None) -> DataFrame:
        return reads.page(reads.timeline(self.sources(), self.table("batches", BATCHES)), limit, offset)

    def ticket(self, kind: str, id_: str) -> dict:
        """State and trail of a source or a batch."""
        if kind == "batch":
            row = self.table("batches", BATCHES).where(F.col("id") == id_).first()
            if row is None:
                raise EngineError("not_found", f"no batch {id_}")
            members = self.sources().where(F.col("batch_id") == id_).groupBy("status").count().collect()
            return row.asDict(True) | {"members": {r["status"]: r["count"] for r in members}}
        row = self.sources().where(F.col("id") == id_).first()
        if kind != "source" or row is None:
            raise EngineError("not_found", f"no {kind} {id_}")
        trail = self.table("ingestion_events", "source_id string, ordinal int, stage string, event string, ok boolean, detail string").where(F.col("source_id") == id_)
        return row.asDict(True) | {"trail": [(r["stage"], r["event"], r["ok"]) for r in trail.orderBy("ordinal").collect()]}

    # --- search

    def search(self, queries: dict | DataFrame, config: RetrievalConfig = RetrievalConfig(), origin: str = "api", scorer=None) -> DataFrame:
        """Results of all queries, with their scores as one struct; their receipts are written first, whole rows each, so that what is
        returned is on record. ``queries``: texts by id, or a table query_id, query; a refused one has neither (:meth:`refused`)."""
        checked, took = search.check_queries(self.spark, queries).where("refusal IS NULL").drop("refusal"), {}
        posted, stamps = self._current("postings"), sinks.read(self.spark, f"{self.root}/stamps")
        with search.timed(took, "total"):
            results = materialise(search.search(self.chunks(), checked, config, self.language, self.embedder, self.stamp, scorer, posted, stamps, took), "results")
        asked = checked.select(F.col("query_id").cast("string").alias("query_id"), "query")
        stored = sinks.receipts(results.withColumn("query_id", F.col("query_id").cast("string")), asked, config.to_json(), origin, self.stamp, took).withColumn("id", F.sha2(F.concat_ws("|", "id", F.lit(repr(time.time()))), 256)).withColumn("created_at", F.current_timestamp())
        back = materialise(stored, "receipts")
        sinks.append(back, f"{self.root}/retrieval_runs")
        delete(self.spark, results.inputFiles()[0].rpartition("/")[0])
        flat = back.select("query_id", F.col("id").alias("run_id"), F.explode("results").alias("r")).select("query_id", "run_id", "r.*")
        return search.grouped_scores(flat)

    def refused(self, queries: dict | DataFrame) -> DataFrame:
        """query_id and refusal of the questions that a search leaves out."""
        return search.check_queries(self.spark, queries).where("refusal IS NOT NULL").select("query_id", "refusal")

    def _receipts(self) -> DataFrame:
        found = sinks.read(self.spark, f"{self.root}/retrieval_runs")
        if found is None:
            raise EngineError("not_found", "nothing has been searched yet")
        return found

    def runs(self, limit: int | None = None, offset: int | None = None) -> DataFrame:
        return reads.page(self._receipts().drop("results"), limit, offset)

    def receipt(self, id_: str) -> DataFrame:
        """A run's lines, each with whether its passage has been superseded since."""
        lines = sinks.receipt_lines(self._receipts().where(F.col("id") == id_))
        return gold.superseded(lines, self.chunks()).orderBy("rank")

    # --- labels and evaluation

    def gold(self) -> DataFrame:
        items = self.table("gold_items", GOLD)
        return items.join(gold.needs_reconfirmation(items, self.chunks()), "item_id").orderBy("created_at", "item_id") if not items.isEmpty() else items

    def add_gold(self, questions: Sequence[tuple[str, str, Sequence[str]]], notes: str = "") -> None:
        """(item_id, question, chunk ids); every fourth of all becomes held out."""
        asked = [(n, i, q, list(c), notes) for n, (i, q, c) in enumerate(questions, 1)]
        new = gold.resolve_expected(self.spark.createDataFrame(asked, "nth int, item_id string, question string, chunk_ids array<string>, notes string"), self.chunks())

        def add(held: DataFrame | None) -> DataFrame:
            before = 0 if held is None else held.count()  # of the state that this is committed against
            split = F.when((F.col("nth") + before) % 4 == 0, "heldout").otherwise("tuning")
            return new.withColumns({"split": split, "created_at": F.current_timestamp()}).select(*GOLD_COLUMNS)

        sinks.upsert(self.spark, f"{self.root}/gold_items", "item_id", add, GOLD)

    def relabel_gold(self, item_id: str, chunk_ids: Sequence[str]) -> None:
        change = gold.resolve_expected(self.spark.createDataFrame([(item_id, list(chunk_ids))], "item_id string, chunk_ids array<string>"), self.chunks())
        sinks.upsert(self.spark, f"{self.root}/gold_items", "item_id", lambda held: None if held is None else gold.relabel(held.join(change.select("item_id"), "item_id", "left_semi"), change), GOLD)

    def _state(self, **row) -> None:
        at = self.spark.createDataFrame([{"id": None, "config": None, "gold_snapshot": None, "status": None, "metrics": None, "error": None, "at": time.time()} | row], RUNS)
        sinks.append(at, f"{self.root}/eval_runs")

    def evals(self, limit: int = 200) -> DataFrame:
        """The latest state of each run, newest first."""
        w = Window.partitionBy("id").orderBy(F.col("at").desc())
        every = self.table("eval_runs", RUNS).withColumn("nth", F.row_number().over(w))
        return every.where("nth = 1").drop("nth").orderBy(F.col("at").desc(), "id").limit(limit)

    def create_eval(self, config: RetrievalConfig = RetrievalConfig()) -> str:
        """Pin the labels as they are; the run's id."""
        items = self.table("gold_items", GOLD)
        snapshot = [json.loads(r[0]) for r in items.orderBy("created_at", "item_id").select(F.to_json(F.struct(*items.columns))).collect()]  # what people labelled
        if not snapshot:
            raise EngineError("validation_error", "there are no labelled questions", "eval")
        text = json.dumps(snapshot)
        id_ = self.spark.range(1).select(F.sha2(F.lit(f"{config.to_json()}|{text}|{time.time()!r}"), 256)).first()[0]
        self._state(id=id_, config=config.to_json(), gold_snapshot=text, status="running")
        return id_

    def execute_eval(self, id_: str) -> DataFrame:
        """Run a created evaluation, once; its slices. A failure is recorded and raised."""
        row = self.evals().where(F.col("id") == id_).first()
        if row is None or row["status"] != "running":
            raise EngineError("validation_error", f"evaluation {id_} is not there to be run", "eval")
        pinned = row.asDict()
        try:
            config = RetrievalConfig(**json.loads(row["config"]))
            items = self.spark.createDataFrame([{k: x.get(k) for k in ("item_id", "question", "split", "expected")} for x in json.loads(row["gold_snapshot"])], "item_id string, question string, split string, expected array<struct<chunk_id:string,source_id:string,content_sha256:string>>")
            _, slices = search.evaluate(items, self.chunks(), config, language=self.language, embedder=self.embedder, stamp=self.stamp, posted=self._current("postings"), stamps=sinks.read(self.spark, f"{self.root}/stamps"))
            found = [r.asDict() for r in slices.collect()]
        except Exception as e:
            self._state(**(pinned | {"status": "failed", "error": str(e)[:500], "at": time.time()}))
            raise
        self._state(**(pinned | {"status": "completed", "metrics": json.dumps(found), "at": time.time()}))
        return slices

    def compare_evals(self, before: str, after: str) -> DataFrame:
        schema = "split string, items bigint, recall_at_5 double, recall_at_10 double, mrr double, ndcg_at_10 double, unresolvable bigint"
        sides = []
        for id_ in (before, after):
            row = self.evals().where((F.col("id") == id_) & (F.col("status") == "completed")).first()
            if row is None:
                raise EngineError("not_found", f"no completed evaluation {id_}")
            sides.append(self.spark.createDataFrame(json.loads(row["metrics"]), schema))
        return metrics.compare(*sides)

    def self_check(self, text: str) -> dict:
        """Store a text's vector and read it back as its own nearest neighbour; what happened at each seam is on record, failures too."""
        id_, seams = uuid.uuid4().hex, []
        out = {"run_id": id_, "vector_id": None, "readback_distance": None, "ok": False}
        try:
            seam = "embedding"
            made = self.embedder(text, self.stamp["dimensions"])
            seams.append((id_, seam, True, f"{len(made)} dimensions"))
            seam = "store"
            stamp = F.struct(*(F.lit(v).alias(k) for k, v in self.stamp.items()))
            key = F.sha2(F.concat(F.lit(text), F.lit("\n"), F.lit("/".join(str(v) for v in self.stamp.values()))), 256)
            row = self.spark.range(1).select(key.alias("id"), F.lit(text).alias("content"), F.array(*map(F.lit, made)).alias("embedding"), stamp.alias("stamp"))
            written = sinks.insert_ignore(row, f"{self.root}/vectors")
            seams.append((id_, seam, True, f"{written['inserted']} inserted"))
            seam = "readback"
            out |= search.self_check(sinks.read_or_empty(self.spark, f"{self.root}/vectors", row), text, self.embedder, self.stamp)
            seams.append((id_, seam, out["ok"], f"distance {out['readback_distance']}"))
        except Exception as e:
            seams.append((id_, seam, False, str(e)[:500]))
            raise
        finally:
            sinks.append_seam_events(self.spark.createDataFrame(seams, "run_id string, seam string, ok boolean, detail string").coalesce(1), f"{self.root}/check_events")
            run = self.spark.createDataFrame([(id_, "succeeded" if out["ok"] else "failed", out["vector_id"], out["readback_distance"], time.time())], CHECKS)
            sinks.append(run, f"{self.root}/check_runs")
        return out

    def checks(self, limit: int = 50) -> DataFrame:
        return self.table("check_runs", CHECKS).orderBy(F.col("at").desc(), "id").limit(limit)

    def check(self, id_: str) -> dict:
        """A check run with its events in order and its stored vector."""
        row = self.table("check_runs", CHECKS).where(F.col("id") == id_).first()
        if row is None:
            raise EngineError("not_found", f"no check {id_}")
        events = sinks.read(self.spark, f"{self.root}/check_events").where(F.col("run_id") == id_).orderBy("id").collect()
        vector = sinks.read(self.spark, f"{self.root}/vectors").where(F.col("id") == row["vector_id"]).first() if row["vector_id"] else None
        return row.asDict() | {"events": [(e["seam"], e["ok"], e["detail"]) for e in events], "vector": vector and vector.asDict(True)}
