"""A library from upload to comparison of evaluations."""

import io
import zipfile

import pytest

from tarnstone.config import RetrievalConfig
from tarnstone.errors import EngineError
from tarnstone.library import Library


def test_library(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.md").write_bytes(b"# Caves\nGoblins sleep in deep caves.\n# Rivers\nFerries cross at dawn.")
    (inbox / "b.md").write_bytes(b"# Caves\nGoblins sleep in deep caves.\n# Rivers\nFerries cross at dawn.")
    (inbox / "c.pdf").write_bytes(b"%PDF-1.7")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("d.html", "<body><h1>Markets</h1><p>Merchants sell spices.</body>")
        z.writestr("e.html", "<p>no heading")
        z.writestr("f.bin", b"\x00")
    (inbox / "batch.zip").write_bytes(out.getvalue())
    lib = Library(spark, str(tmp_path / "store"))
    refused = {r.filename: r.reason for r in lib.upload(str(inbox)).collect()}
    assert refused == {"b.md": "duplicate", "c.pdf": "unsupported_type", "f.bin": "unsupported_type"}
    assert {r.status for r in lib.sources().collect()} == {"queued"}
    lib.ingest()
    by_name = {r.filename: r for r in lib.sources().collect()}
    assert {n: r.status for n, r in by_name.items()} == {"a.md": "ingested", "d.html": "ingested", "e.html": "failed"}
    assert {r.filename for r in lib.upload(str(inbox)).where("reason = 'duplicate'").collect()} == {"a.md", "b.md", "d.html", "e.html"}
    batch = by_name["d.html"].batch_id
    ticket = lib.ticket("batch", batch)
    assert ticket["status"] == "expanded" and ticket["members"] == {"ingested": 1, "failed": 1} and len(ticket["entry_report"]) == 3
    assert lib.ticket("source", by_name["a.md"].id)["trail"][-1] == ("commit", "completed", True)
    with pytest.raises(EngineError):
        lib.ticket("source", "none")
    assert [r.kind for r in lib.timeline().collect()].count("batch") == 1 and lib.timeline(1).count() == 1

    config = RetrievalConfig(min_similarity=0.9)
    hits = lib.search({"q": "goblin caves", "r": "nothing here"}, config).collect()
    assert [h.query_id for h in hits] == ["q"] and "Goblins" in hits[0].content
    assert sorted(r.result_count for r in lib.runs().collect()) == [0, 1]
    assert [r.superseded for r in lib.receipt(hits[0].run_id).collect()] == [False]

    with pytest.raises(EngineError):
        lib.create_eval(config)
    chunk = {c.content.split()[0]: c.id for c in lib.chunks().collect()}
    lib.add_gold([("g1", "goblin caves", [hits[0].chunk_id]), ("g2", "spices", [chunk["Merchants"]]), ("g3", "ferries", [hits[0].chunk_id]), ("g4", "merchants", [chunk["Merchants"]])])
    assert [r.split for r in lib.gold().collect()].count("heldout") == 1
    first = lib.create_eval(config)
    got = {r.split: r for r in lib.execute_eval(first).collect()}
    assert got["tuning"].recall_at_5 == 1 and got["heldout"].mrr == 1
    with pytest.raises(EngineError):
        lib.execute_eval(first)  # once only
    lib.relabel_gold("g3", [chunk["Merchants"]])
    second = lib.create_eval(config)
    lib.execute_eval(second)
    assert {(r.split, r.delta < 0) for r in lib.compare_evals(first, second).where("metric = 'mrr'").collect()} == {("tuning", True), ("heldout", False)}
    assert [r.status for r in lib.evals().collect()] == ["completed", "completed"]

    assert lib.reingest("markdown", "1.0.0")["inserted"] == 1
    assert lib.sources().where("filename = 'a.md'").first().current_generation == 2 and lib.chunks().count() == 2
    assert not any(r.needs_reconfirmation for r in lib.gold().collect())  # the texts are the same
    check = lib.self_check("hello")
    assert check["ok"] and lib.self_check("hello")["vector_id"] == check["vector_id"]
    assert lib.checks().count() == 2 and [e[:2] for e in lib.check(check["run_id"])["events"]] == [("embedding", True), ("store", True), ("readback", True)]
    with pytest.raises(EngineError):
        lib.check("none")
    run = lib.runs().first()
    assert run.stamp.model == "deterministic-v1" and {"embed", "vector", "fts", "total"} <= set(run.stage_timings)
