"""Explicit schemas of all tables; nothing is inferred."""

from __future__ import annotations

ANCHOR = "struct<artifact_id:string,element_id:string,char_start:int,char_end:int>"
SECTION = f"struct<index:int,path:array<string>,kind:string,heading:string,content:string,anchor:{ANCHOR}>"
ARTIFACT = "struct<id:string,kind:string,content:string,title:string>"
DOCUMENT = f"struct<contract_version:string,title:string,language:string,sections:array<{SECTION}>,artifacts:array<{ARTIFACT}>,warnings:array<string>>"
DRAFT_CHUNK = "struct<chunk_index:int,content:string,section_indexes:array<int>,anchor_section_index:int,oversized:boolean>"
FAILURE = "struct<class:string,stage:string,message:string>"
STAMP = "struct<provider:string,model:string,dimensions:int>"
SCORES = "struct<fts:double,vector:double,fused:double,rerank:double>"

TABLES = {
    "corpora": "id string, name string",
    "source_archives": "fingerprint string, bytes binary, byte_size bigint, media_type string",
    "batches": f"id string, corpus_id string, fingerprint string, filename string, status string, entry_report array<struct<path:string,status:string,reason:string>>, last_error {FAILURE}, created_at timestamp",
    "sources": f"id string, corpus_id string, batch_id string, fingerprint string, filename string, media_type string, status string, plugin_name string, plugin_version string, detect_confidence double, current_generation int, last_error {FAILURE}, created_at timestamp",
    "document_sections": f"id string, source_id string, generation int, section_index int, path array<string>, kind string, heading string, content string, anchor {ANCHOR}, display_artifact {ARTIFACT}",
    "chunks": f"id string, source_id string, corpus_id string, generation int, chunk_index int, content string, section_ids array<string>, anchor {ANCHOR}, oversized boolean, plugin_name string, plugin_version string, embedding array<float>, stamp {STAMP}",
    "ingestion_events": "id string, source_id string, batch_id string, stage string, event string, ok boolean, detail string, duration_ms bigint, created_at timestamp",
    "jobs": "id string, kind string, payload string, status string, attempts int, max_attempts int, run_at timestamp, claimed_by string, claimed_at timestamp, last_error string, created_at timestamp",
    "retrieval_runs": f"id string, query string, config string, origin string, stamp {STAMP}, stage_timings map<string,double>, result_count int, results array<struct<rank:int,chunk_id:string,source_id:string,generation:int,content:string,section_ids:array<string>,anchor:{ANCHOR},content_sha256:string,scores:{SCORES},prerank_position:int>>, created_at timestamp",
    "gold_items": "id string, corpus_id string, question string, expected array<struct<chunk_id:string,source_id:string,content_sha256:string>>, split string, notes string, created_at timestamp, updated_at timestamp",
    "eval_runs": "id string, corpus_id string, config string, gold_snapshot string, status string, metrics string, error string, created_at timestamp",
    "skeleton_check_runs": "id string, status string, outcome string, vector_id string, readback_distance double, created_at timestamp",
    "skeleton_check_events": "id bigint, run_id string, seam string, ok boolean, detail string, created_at timestamp",
    "skeleton_vectors": f"id string, content string, embedding array<float>, stamp {STAMP}",
}

#: Allowed values, fixed.
SECTION_KINDS = ("prose", "stat_block", "table", "spell_entry", "unclassified")
SOURCE_STATUS = ("queued", "processing", "ingested", "failed", "empty")
BATCH_STATUS = ("expanding", "expanded", "failed", "empty")
JOB_STATUS = ("queued", "claimed", "succeeded", "failed")
STAGES = ("detect", "extract", "transform", "chunk", "embed", "index", "commit", "expand", "admit")
EVENTS = ("started", "completed", "failed", "skipped")
