"""Tables under pointers: nothing is lost between a read and a commit, folders stay few, readers see whole states."""

import datetime
import threading

import pytest
from pyspark.sql import functions as F

from tarnstone import errors
from tarnstone.library import Library
from tarnstone.plans import ingest
from tarnstone.schemas import TABLES
from tarnstone.sources import sinks
from tarnstone.streaming import pipeline

BASE = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
JOBS = "id string, kind string, payload string"


def at(s):
    return BASE + datetime.timedelta(seconds=s)


def jobs(spark, *ids, kind="work"):
    return spark.createDataFrame([(i, kind, "{}") for i in ids], JOBS)


def states(spark, path):
    return {r.id: (r.status, r.attempts, r.claimed_by) for r in sinks.read(spark, path, TABLES["jobs"]).collect()}


def test_a_handler_that_enqueues_loses_nothing(spark, tmp_path):
    path = f"{tmp_path}/jobs"
    pipeline.enqueue(jobs(spark, "a"), path, as_of=at(0))
    made = []
    assert pipeline.work(spark, path, {"work": lambda rows: made.append(pipeline.enqueue(jobs(spark, "b"), path, as_of=at(1))["inserted"])}, as_of=at(1)) == 1
    assert made == [1] and {i: s for i, (s, *_) in states(spark, path).items()} == {"a": "succeeded", "b": "queued"}


def test_two_claimers_between_each_others_read_and_commit(spark, tmp_path, monkeypatch):
    """The second one claims and commits after the first has read: the first one is given other jobs."""
    path, real, between = f"{tmp_path}/jobs", sinks.commit, []
    pipeline.enqueue(jobs(spark, *"abcd"), path, as_of=at(0))

    def interrupted(*args):
        if not between:
            between.append(None)
            between.append(pipeline.claim(spark, path, "second", at(1), 2))
        return real(*args)

    monkeypatch.setattr(sinks, "commit", interrupted)
    first = pipeline.claim(spark, path, "first", at(1), 2)
    assert {r.id for r in between[1].collect()} == {"a", "b"} and {r.id for r in first.collect()} == {"c", "d"}
    assert states(spark, path) == {i: ("claimed", 1, "second" if i in "ab" else "first") for i in "abcd"}
    assert pipeline.claim(spark, path, "third", at(1)) is None


def test_workers_at_once_share_the_jobs(spark, tmp_path):
    path, out = f"{tmp_path}/jobs", {}
    pipeline.enqueue(jobs(spark, *(f"j{i}" for i in range(9))), path, as_of=at(0))

    def worker(name):
        out[name] = [r.id for _ in range(2) if (c := pipeline.claim(spark, path, name, at(1), 2)) is not None for r in c.collect()]

    threads = [threading.Thread(target=worker, args=(f"w{i}",)) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    every = sorted(i for ids in out.values() for i in ids)
    assert len(every) == len(set(every)) == 9


def test_an_outcome_counts_only_while_its_claim_does(spark, tmp_path):
    path = f"{tmp_path}/jobs"
    pipeline.enqueue(jobs(spark, "a"), path, as_of=at(0))
    slow = pipeline.claim(spark, path, "slow", at(0))
    assert pipeline.claim(spark, path, "other", at(60)) is None
    other = pipeline.claim(spark, path, "other", at(61))  # put back and claimed again
    assert states(spark, path)["a"] == ("claimed", 2, "other")
    nothing = spark.createDataFrame([], "id string, error string")
    assert pipeline.settle(spark, path, slow, nothing, at(62)) == 0 and states(spark, path)["a"][0] == "claimed"
    assert pipeline.settle(spark, path, other, nothing, at(62)) == 1 and states(spark, path)["a"] == ("succeeded", 2, "other")
    assert pipeline.work(spark, path, {}, as_of=at(500)) == 0


def test_finished_jobs_are_not_written_again(spark, tmp_path):
    path = f"{tmp_path}/jobs"
    pipeline.enqueue(jobs(spark, *(f"j{i}" for i in range(50))), path, as_of=at(0))
    before = set(sinks.folders(spark, path)[1])
    pipeline.work(spark, path, {"work": lambda rows: None}, as_of=at(1), limit=2)
    new = [x for x in sinks.folders(spark, path)[1] if x not in before]
    assert before <= set(sinks.folders(spark, path)[1]) and [spark.read.parquet(f"{path}/{x}").count() for x in new] == [2, 2]


def test_a_large_number_of_small_changes(spark, tmp_path):
    path = f"{tmp_path}/t"
    want = {}
    for n in range(60):
        want |= {f"k{n % 7}": n, f"n{n}": n}
        rows = spark.createDataFrame([(f"k{n % 7}", n), (f"n{n}", n)], "id string, x int").coalesce(1)
        sinks.upsert(spark, path, "id", lambda held, rows=rows: rows, "id string, x int")
    assert len(sinks.folders(spark, path)[1]) <= sinks.MOST_FOLDERS
    assert {r.id: r.x for r in sinks.read(spark, path).collect()} == want
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith(sinks.IN)]) <= sinks.MOST_FOLDERS + 2 * sinks.KEPT
    assert sinks._mergeable([1000, 10, 9, 8]) == 1 and sinks._mergeable([1000, 400, 300, 200]) == 0 and sinks._mergeable([1000, 100, 10, 1]) == 3


def test_appended_ids_grow_and_batches_come_once(spark, tmp_path):
    path, rows = f"{tmp_path}/events", spark.createDataFrame([(r, "s", True, None) for r in "ab"], "run_id string, seam string, ok boolean, detail string")
    for _ in range(3):
        sinks.append_seam_events(rows, path)
    got = [r.id for r in sinks.read(spark, path).orderBy("created_at", "id").collect()]
    assert len(set(got)) == 6 and got == sorted(got)
    other = f"{tmp_path}/once"
    for batch in (0, 1, 1, 0, 2):  # replayed after a crash between the append and the checkpoint
        sinks.append(spark.range(3), other, once=("stream", batch))
    sinks.append(spark.range(3), other, once=("another", 0))
    assert sinks.read(spark, other).count() == 12


def test_changes_at_once_all_count(spark, tmp_path):
    path = f"{tmp_path}/n"
    sinks.swap_pointer(spark.createDataFrame([(0,)], "n int"), path)

    def more():
        for _ in range(3):
            sinks.update(spark, path, lambda held: held.select((F.col("n") + 1).alias("n")))

    threads = [threading.Thread(target=more) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sinks.read(spark, path).first().n == 9
    seen = sinks.folders(spark, path)[0]
    sinks.append(spark.createDataFrame([(1,)], "n int"), path)
    with pytest.raises(sinks.Conflict):
        sinks.swap_pointer(spark.createDataFrame([(2,)], "n int"), path, seen)
    with pytest.raises(errors.EngineError):
        sinks.commit(spark, path, seen, [])


def files(spark, source, body, generation=1):
    df = spark.createDataFrame([(source, "c", generation, "text/markdown", bytearray(body))], "source_id string, corpus_id string, generation int, media_type string, content binary")
    return df.withColumn("fingerprint", F.sha2("content", 256))


def test_two_ingests_at_once_keep_both_heads(spark, tmp_path, monkeypatch):
    store, real, between = str(tmp_path / "store"), sinks.upsert, []
    ingest.ingest(files(spark, "s0", b"# a\nzero"), store)

    def interrupted(*args):
        if not between and args[1].endswith("/sources"):
            between.append(None)
            ingest.ingest(files(spark, "s2", b"# a\ntwo"), store)
        return real(*args)

    monkeypatch.setattr(sinks, "upsert", interrupted)
    ingest.ingest(files(spark, "s1", b"# a\none"), store)
    heads = {r.id: (r.status, r.current_generation) for r in sinks.read(spark, f"{store}/sources").collect()}
    assert heads == {f"s{i}": ("ingested", 1) for i in range(3)}
    assert {r.content for r in sinks.read(spark, f"{store}/chunks").collect()} == {"zero", "one", "two"}
    assert {r.lexeme for r in sinks.read(spark, f"{store}/postings").collect()} == {"zero", "on", "two"}


def test_labels_added_at_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.md").write_bytes(b"# Caves\nGoblins sleep.")
    lib = Library(spark, str(tmp_path / "store"))
    lib.upload(str(inbox))
    lib.ingest()
    chunk = lib.chunks().first().id
    threads = [threading.Thread(target=lib.add_gold, args=([(f"g{i}{j}", "goblins", [chunk]) for j in range(2)],)) for i in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted((r.item_id, r.split) for r in lib.gold().collect() if r.split == "heldout") in ([("g01", "heldout")], [("g11", "heldout")]) and lib.gold().count() == 4


def test_numbers_within_keys_of_any_size(spark):
    from tarnstone.operators import gold, numbering

    rows = [(i, "big" if i % 10 else None, (i * 7) % 50) for i in range(400)] + [(1000, "one", 1)]
    df = spark.createDataFrame(rows, "id int, corpus string, at int").repartition(3)
    got = numbering.numbered(df, "n", ["corpus"], F.col("at"), F.col("id"))
    want = {}
    for i, c, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        want.setdefault(c, []).append(i)
    assert {r.id: r.n for r in got.collect()} == {i: n for ids in want.values() for n, i in enumerate(ids, 1)}
    split = gold.default_split(df, "at", "id", "corpus")
    assert {r.id for r in split.where("split = 'heldout'").collect()} == {i for ids in want.values() for i in ids[3::4]}
    assert numbering.numbered(df.limit(0), "n", ["corpus"], F.col("at")).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(corpus" not in plan  # no task gets a whole corpus


def test_a_sweep_writes_no_row_again(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.createDataFrame([(f"s{i % 5}", g, f"{i}:{g}") for i in range(50) for g in (1, 2)], "source_id string, generation int, id string")
    for g in (1, 2):
        sinks.insert_ignore(rows.where(f"generation = {g}"), path)
    before, early = sinks.folders(spark, path)[1], sinks.read(spark, path)
    heads = spark.createDataFrame([("s0", 2), ("s1", 2), ("s2", 1), ("s9", 2)], "id string, current_generation int")
    assert sinks.sweep(path, spark, heads) == 20 and sinks.folders(spark, path)[1] == before
    left = sinks.read(spark, path)
    assert left.count() == 80 and left.where("source_id IN ('s0', 's1') AND generation = 1").isEmpty() and early.count() == 100
    assert sinks.sweep(path, spark, heads) == 0
    again = heads.where("id = 's0'").withColumn("current_generation", F.lit(3))
    sinks.insert_ignore(spark.createDataFrame([("s0", 3, "new")], rows.schema), path)
    assert sinks.sweep(path, spark, again) == 10
    want = sorted(r.id for r in sinks.read(spark, path).collect())
    assert sinks.compact(spark, path, most=1) and len(sinks.folders(spark, path)[1]) == 1
    assert sorted(r.id for r in sinks.read(spark, path).collect()) == want and len(want) == 71
    assert sinks.REMOVED not in sinks.state(spark, path).notes


def test_counts_kept_by_commits(spark, tmp_path):
    from tarnstone.operators import reads

    inbox, lib = tmp_path / "in", Library(spark, str(tmp_path / "store"))
    inbox.mkdir()
    for i in range(3):
        (inbox / f"{i}.md").write_bytes(b"".join(b"# h%d\ntext %d\n" % (k, i) for k in range(i + 1)))
    lib.upload(str(inbox))
    lib.ingest()
    (inbox / "more.md").write_bytes(b"# only\none")
    lib.upload(str(inbox))
    lib.ingest()
    for _ in range(2):
        heads = sinks.read(spark, f"{lib.root}/sources")
        afresh = reads.source_counts(heads, sinks.read(spark, f"{lib.root}/document_sections"), sinks.read(spark, f"{lib.root}/chunks"))
        flat = lambda df: sorted((r.source_id, r.sections, r.chunks) for r in df.collect())
        assert flat(lib.counts()) == flat(afresh) and sum(r.sections for r in afresh.collect()) == 7
        lib.reingest("markdown", "1.0.0")


def test_joins_in_place_exchange_nothing(spark):
    from tarnstone.operators import gold
    from tarnstone.sources import buckets

    chunks = spark.createDataFrame([(i % 20, 1 + i % 2, f"text {i}") for i in range(200)], "source_id int, generation int, content string")
    heads = spark.createDataFrame([(i, 2 if i % 2 else 1) for i in range(15)], "source_id int, current_generation int")
    results = chunks.select("source_id", F.sha2("content", 256).alias("content_sha256")).unionByName(spark.createDataFrame([(1, "0" * 64), (99, "1" * 64)], "source_id int, content_sha256 string"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with buckets.published(spark, "source_id", chunks, heads, results, buckets=5) as (c, h, r):
            at = gold.current_in_place(c, h)
            flags = gold.superseded_in_place(r, at.select("source_id", F.sha2("content", 256).alias("content_sha256")).distinct())
            plan = flags._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and plan.count("Join") == 2
            want = gold.superseded(results, gold.current(chunks, heads.withColumnRenamed("source_id", "id")))
            assert sorted(map(tuple, flags.collect())) == sorted((x.source_id, x.content_sha256, x.superseded) for x in want.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_archives_are_read_by_entry(spark, tmp_path):
    import io
    import zipfile

    from tarnstone.sources import archives, files

    def made(entries):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, body in entries:
                z.writestr(name, body)
        return out.getvalue()

    inner = made([("x.md", b"x")])
    (tmp_path / "a.zip").write_bytes(made([(f"d/{i}.md", b"# t\n" + b"x" * 1000) for i in range(40)] + [("big.md", b"y" * 5000), ("in.zip", inner), ("f/", b"")]))
    (tmp_path / "b.zip").write_bytes(b"PK\x03\x04 and nothing more")
    (tmp_path / "c.zip").write_bytes(made([(f"{i}.md", b"z") for i in range(60)]))
    (tmp_path / "d.txt").write_bytes(b"no archive")
    df = archives.read_archives(spark, str(tmp_path), mostEntries=50, mostBytes=2000, partBytes=8000)
    got = sorted((r.archive.rpartition("/")[2], r.path or "", r.reason or "", len(r.content or b"")) for r in df.collect())
    assert got == sorted([("a.zip", f"d/{i}.md", "", 1004) for i in range(40)] + [("a.zip", "big.md", "too_large", 0), ("a.zip", "in.zip", "nested_zip", 0), ("b.zip", "", "corrupt", 0), ("c.zip", "", "too_many_entries", 0)])
    assert df.rdd.getNumPartitions() > 6 and df.where("archive LIKE '%a.zip'").select(F.spark_partition_id()).distinct().count() > 5
    whole = spark.createDataFrame([("a", bytearray((tmp_path / "a.zip").read_bytes()))], "batch_id string, content binary")
    old = files.expand_batches(whole).select(F.col("filename").alias("path"), "content").where("content IS NOT NULL")
    assert sorted(map(tuple, df.where("content IS NOT NULL AND byte_size < 2000").select("path", "content").collect())) == sorted(r for r in map(tuple, old.collect()) if len(r[1]) <= 2000)
